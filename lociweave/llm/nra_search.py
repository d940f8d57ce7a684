"""Ranked lexical search by NRA over impact-sorted postings (operator 12).

One pass reduces every document to its number of terms and the counts of those terms that the items
ask for; these slim rows are stored, and global counts (documents, terms, document
frequencies) come from them.  Then each batch of documents is a segment: its postings are sorted by
term and falling impact, and NRA reads the lists of an item in step, block by block:

- the *lower* end of a document's interval is the sum of the impacts read so far,
- the *upper* end adds, for each list in which it was not met, the impact at which that
  list stands (zero at its end); a document that no list has shown has the sum of all these,
- documents whose upper end falls under the tenth best lower end are out for good; those
  with an equal one stay, since ties go to the smaller id.

Reading goes on until every document that is still in has an interval of one value, so
membership, ties and scores are all final.  The tenth best score of a task's
earlier segments is the bar for its later ones, so most lists are left early.

Scale: no posting is shuffled; a task hands on ten rows per item, and Spark keeps ten of
them.  Items go to the workers in blocks of ``BLOCK_BYTES`` of text, one block at a time.

Null and wordless texts have no terms, score nothing and count for no statistic.  Every row of
the items is an item of its own, also where ids repeat or are null; so is every document row,
and among equal scores a null doc_id comes last.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame, hash_words
from lociweave.operators.ordered import running_total

#: Text bytes of the items that go through one scan.
BLOCK_BYTES = 4 << 20
#: Postings of each list in the first block of reads; every later block has four times as many.
FIRST_DEPTH = 32

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has terms: their number, and the
    vocabulary's terms in it, by number and count."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = hash_words(text.as_py() or "", _FOLD)
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    ids.append(doc)
                    sizes.append(len(words))
                    terms.append(list(found))
                    counts.append(list(found.values()))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def term_weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight of each term by the number of documents that have it."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * frequency + 1))).astype(np.int64)


class Segment:
    """Impact-sorted postings of some documents: list t is the range first[t] to first[t + 1]."""

    def __init__(self, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        norm = 10 + (90 * sizes * n_docs) // n_terms
        doc = np.repeat(np.arange(len(sizes)), lengths)
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[doc]))
        order = np.lexsort((-impact, terms))
        self.doc, self.impact, self.size = doc[order], impact[order], len(sizes)
        self.first = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that can be among the k best or tie with them, given that
        k documents elsewhere have ``bar`` or more; scores are final and above zero."""
        begin, end = self.first[terms], self.first[terms + 1]
        begin, end = begin[begin < end], end[begin < end]
        lower, live = np.zeros(self.size, np.int64), np.ones(self.size, bool)
        read_doc, read_list = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, depth = begin, FIRST_DEPTH
        while True:
            upto = np.minimum(at + depth, end)
            n = upto - at
            place = np.repeat(upto - np.cumsum(n), n) + np.arange(n.sum())
            which = np.repeat(np.arange(len(n)), n)
            doc, impact = self.doc[place], self.impact[place]
            inside = live[doc]
            np.add.at(lower, doc[inside], impact[inside])
            read_doc, read_list = np.concatenate((read_doc, doc[inside])), np.concatenate((read_list, which[inside]))
            at = upto
            stands = np.where(at < end, self.impact[np.minimum(at, len(self.impact) - 1)], 0) if len(at) else np.zeros(0, np.int64)
            upper = lower + stands.sum()
            np.subtract.at(upper, read_doc, stands[read_list])
            if self.size >= k:
                bar = max(bar, int(np.partition(lower, self.size - k)[self.size - k]))
            live &= (upper >= bar) & (upper > 0)
            if not (live & (upper > lower)).any():
                found = np.flatnonzero(live & (lower > 0))
                return found, lower[found]
            depth *= 4


def _ahead(row: tuple) -> tuple:
    score, doc = row
    return -score, doc is None, doc or 0


def block_scores(rows: DataFrame, asked: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item (number, terms)."""
    shared = rows.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        top: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            segment = Segment(batch.column(1).to_numpy(), lengths, lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), weight, n_docs, n_terms)
            for i, (_, terms) in enumerate(items):
                found, scores = segment.best(terms, k, top[i][-1][0] if len(top[i]) == k else 0)
                if len(found):
                    top[i] = sorted([*top[i], *zip(scores.tolist(), [ids[d] for d in found], strict=True)], key=_ahead)[:k]
        flat = [(item, doc, score) for (item, _), rows in zip(items, top, strict=True) for score, doc in rows]
        columns = list(zip(*flat, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above zero of every
    item (item_id, text), equal scores by ascending doc_id."""
    d = doc_frame(docs)
    own = cut_lineage(items.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("item")))
    placed = cut_lineage(running_total(own, [], ["item"], F.octet_length("text") + 1, "upto").withColumn("block", F.floor((F.col("upto") - 1) / BLOCK_BYTES)))
    out = d.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        vocabulary: dict[bytes, int] = {}
        asked = []
        for item, text in placed.filter(F.col("block") == block).select("item", "text").toLocalIterator():
            terms = dict.fromkeys(hash_words(text, _FOLD))
            asked.append((item, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64)))
        rows = cut_lineage(postings(d, vocabulary))
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not vocabulary:
            continue
        frequency = np.zeros(len(vocabulary), np.int64)
        for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            frequency[term] = n
        out = out.unionByName(block_scores(rows, asked, term_weights(frequency, n_docs), n_docs, n_terms, k))
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = out.withColumn("rank", turn).filter(F.col("rank") <= k)
    return best.join(own.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
