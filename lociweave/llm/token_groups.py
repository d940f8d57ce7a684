"""Exact Jaccard join of word shingles through a token-group matrix (operator 11).

Two documents link if the sets of their shingles have a Jaccard similarity of ``percent`` or
more.  Similar documents are put into groups of bounded size, each group with the union of its
members' tokens: its column of the matrix.  A query can only have a partner in a group if
the union holds ``percent`` of the query's tokens, so a group is opened, and its members are
compared exactly, for those queries alone.

Which rows of the matrix are looked at at all is decided by keys that no linked pair can
miss.  Sizes are cut into intervals [l, l * 100 / percent]; partners are in one interval or in
two adjacent ones.  In an interval whose sets can differ by at most D tokens, tokens are dealt by
hash to D + 1 parts, and by pigeonhole partners agree on all tokens of one part.  A key is
such a part, some ten tokens, so a passage that many documents share makes none.

1. Leaders: of the sets that share a key the one that shares most is the leader, and the
   others are queries to it, a group of one.  Most near copies are linked here, so m copies
   of a text cost about m comparisons.
2. Groups: sets whose keys still hold several components gather about their leaders, in
   blocks; every block queries the blocks with which it shares such a key.

Sets with equal tokens (two 64-bit sums) are one *form*.  Tokens are 64-bit hashes; two
different shingles of one pair collide with a probability under 1e-12.  The components of all
links, not the links, are the result.

Null and wordless texts have no shingles and link with nothing, not with one another;
repeated rows come back as often as they occur; a null doc_id gets its component's smallest id
(null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame, hash_words
from lociweave.llm.golay_simhash import _LOWER
from lociweave.llm.shingle_jaccard import _PLACE, _mixed
from lociweave.operators.graph import connected_components

#: Words that are hashed at once, members of a group, tokens of a group, and queries that meet one copy of a group.
WORDS, MEMBERS, TOKENS, QUERIES = 200_000, 64, 100_000, 256
#: Rows that are broadcast at most (16 bytes each); more go through a shuffle.
BROADCAST_ROWS = 200_000


def intervals(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(least size, number of parts) of each interval of sizes, past ``upto`` by one."""
    least, parts = [1], []
    while True:
        last = least[-1] * 100 // percent
        parts.append(2 * last * (100 - percent) // (100 + percent) + 1)
        if least[-1] > upto:
            return np.array(least), np.array(parts)
        least.append(last + 1)


def shingle_sets(texts: list[list[bytes]], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingles of each text, text after text; a text with fewer
    words is one shingle."""
    n_words = np.array([len(w) for w in texts], np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, (w for words in texts for w in words)), np.uint64, n_words.sum())
    begin = np.cumsum(n_words) - n_words
    mixed = np.zeros(len(own), np.uint64)
    n = len(own) - shingle + 1
    if n > 0:
        total = np.full(n, shingle, np.uint64)
        for j in range(shingle):
            total += own[j : j + n] * _PLACE[j]
        mixed[:n] = _mixed(total)
    short = (n_words > 0) & (n_words < shingle)
    for at, k in zip(begin[short], n_words[short], strict=True):
        mixed[at] = _mixed((own[at : at + k] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k))[0]
    n_all = np.where(short, 1, np.maximum(n_words - shingle + 1, 0))
    hashes = mixed[np.repeat(begin - (np.cumsum(n_all) - n_all), n_all) + np.arange(n_all.sum())]
    ends = np.cumsum(n_all)
    for a, b in zip(ends - n_all, ends, strict=True):
        hashes[a:b].sort()
    doc = np.repeat(np.arange(len(texts)), n_all)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(texts))


def part_keys(hashes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of keys) of each set: the parts of its interval of sizes and of the next one."""
    least, parts = intervals(percent, int(sizes.max(initial=1)))
    place = np.searchsorted(least, np.maximum(sizes, 1), side="right") - 1
    doc, spread = np.repeat(np.arange(len(sizes)), sizes), _mixed(hashes ^ _PLACE[8])
    out, counts = [], []
    for step in (0, 1):
        n = np.where(sizes > 0, parts[place + step], 0)
        first = np.cumsum(n) - n
        sums = np.zeros(n.sum(), np.uint64)
        np.add.at(sums, first[doc] + (hashes % n[doc].astype(np.uint64)).astype(np.int64), spread)
        part = np.arange(len(sums)) - np.repeat(first, n)
        sums += np.repeat((place + step).astype(np.uint64), n) * _PLACE[9] + part.astype(np.uint64) * _PLACE[10]
        out.append(_mixed(sums))
        counts.append(n)
    # the two runs of a set stand together
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(sizes)), n) for n in counts]), kind="stable")
    return np.concatenate(out)[order].view(np.int64), counts[0] + counts[1]


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Runs of rows with the words of their last column, of some WORDS words."""
    for batch in batches:
        texts, held, start = [], 0, 0
        for at, text in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(hash_words(text.as_py() or "", _LOWER))
            held += len(texts[-1])
            if held >= WORDS or at + 1 == len(batch):
                yield batch.slice(start, len(texts)), texts
                texts, held, start = [], 0, at + 1


def set_sums(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit values of each set; zero for an empty one."""
    ends = np.cumsum(sizes)
    out = []
    for k in (11, 12):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(hashes ^ _PLACE[k]), dtype=np.uint64)))
        out.append((total[ends] - total[ends - sizes]).view(np.int64))
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_id, form, form2, size) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _in_blocks(batches):
            hashes, sizes = shingle_sets(texts, shingle)
            yield pa.record_batch([rows.column(0), rows.column(1), *map(pa.array, set_sums(hashes, sizes)), pa.array(sizes)], names=["doc_id", "text_id", "form", "form2", "size"])

    return docs.select("doc_id", "text_id", "text").mapInArrow(run, "doc_id long, text_id long, form long, form2 long, size long")


def form_keys(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(form, key): the keys of all forms; of equal sets a task gives keys to the first only, so
    that copies do not make a key hot.

    Sets are made once more here: keys stored with the sketches took half as much disk as the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, texts in _in_blocks(batches):
            hashes, sizes = shingle_sets(texts, shingle)
            forms = set_sums(hashes, sizes)
            first = np.zeros(len(texts), bool)
            for i, pair in enumerate(zip(*[f.tolist() for f in forms], strict=True)):
                if sizes[i] and pair not in seen:
                    seen.add(pair)
                    first[i] = True
            keys, n = part_keys(hashes[np.repeat(first, sizes)], np.where(first, sizes, 0), percent)
            yield pa.record_batch([pa.array(np.repeat(forms[0], n)), pa.array(keys)], names=["form", "key"])

    return docs.select("text").mapInArrow(run, "form long, key long")


def token_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the tokens of each of the nodes (node, doc_id, text_id).

    A task gives a node once; rows that repeat id and text may give it in several tasks, which adds no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, texts in _in_blocks(batches):
            nodes = rows.column(0).to_pylist()
            new = [i for i, node in enumerate(nodes) if node not in seen and not seen.add(node)]
            hashes, sizes = shingle_sets([texts[i] for i in new], shingle)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.record_batch([pa.array([nodes[i] for i in new], pa.int64()), lists], names=["node", "hashes"])

    wanted = nodes.select("node", F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"))
    if nodes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, (F.col("text_id") == F.col("_text_id")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return cut_lineage(found.select("node", "text").mapInArrow(run, "node long, hashes array<long>"))


class Group:
    """Members of a group by token: the union of their tokens, and who has each."""

    def __init__(self, members: list[np.ndarray], labels: list[int]):
        tokens = np.concatenate(members)
        order = np.argsort(tokens, kind="stable")
        self.who, self.labels = np.repeat(np.arange(len(members)), [len(m) for m in members])[order], np.array(labels)
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.first, self.sizes = np.append(self.first, len(tokens)), np.array([len(m) for m in members])

    def partners(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Labels of the members that link with a query; none unless the union has enough of it."""
        at = np.searchsorted(self.union, query)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == query]
        if 100 * len(at) < percent * len(query):
            return self.labels[:0]
        n = self.first[at + 1] - self.first[at]
        shared = np.bincount(self.who[np.repeat(self.first[at + 1] - np.cumsum(n), n) + np.arange(n.sum())], minlength=len(self.sizes))
        return self.labels[100 * shared >= percent * (len(query) + self.sizes - shared)]


def linked(members: DataFrame, queries: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of the queries (group, node, label) and of the members (group, node, label)
    of their groups with which they link.

    The queries of a group are cut into chunks, each of which meets a copy of the group's members;
    they are sorted together, members first, and a task holds one group at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, labels, group = None, [], [], None
        for batch in batches:
            lists = batch.column(4)
            values, ends = lists.flatten().to_numpy(), np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy(zero_copy_only=False))))
            found: set[tuple[int, int]] = set()
            for i, (g, chunk, asks, label) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)):
                if (g, chunk) != at:
                    at, members, labels, group = (g, chunk), [], [], None
                own = values[ends[i] : ends[i + 1]]
                if not asks:
                    members.append(own.copy())
                    labels.append(label)
                    continue
                group = group or Group(members, labels)
                found.update((label, int(b)) for b in group.partners(own, percent) if b != label)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    queries = cut_lineage(queries)
    copies = queries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("copies"))
    asked = queries.join(copies, "group").select("group", F.pmod(F.xxhash64("node"), "copies").alias("chunk"), F.lit(1).alias("asks"), "label", "node")
    held = members.join(copies, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("chunk"), F.lit(0).alias("asks"), "label", "node")
    rows = held.unionByName(asked).join(tokens, "node").select("group", "chunk", "asks", "label", "hashes")
    return rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "asks").mapInArrow(run, "a long, b long").distinct()


def form_components(docs: DataFrame, forms: DataFrame, keyed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the forms that have a link; keyed has (key, form) of all of them."""
    own = Window.partitionBy("key")  # at most a row per task and form: the keys are dealt out once
    shared = keyed.withColumn("low", F.min("form").over(own)).withColumn("high", F.max("form").over(own)).filter("low < high")
    open_ = cut_lineage(shared.select("key", "form").distinct().join(forms.select("form", "node"), "form").select("key", "node"))
    counts = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degree = open_.join(counts, "key").groupBy("node").agg(F.sum("n").alias("degree"))
    open_ = cut_lineage(open_.join(degree, "node"))
    tokens = token_sets(docs, forms.join(degree.select("node"), "node", "left_semi"), shingle)

    leaders = cut_lineage(open_.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead")).select("key", "lead"))
    led = cut_lineage(open_.join(leaders, "key").select("key", "node", "lead"))
    asks = led.filter("node <> lead.node").select(F.col("lead.node").alias("group"), "node", F.col("node").alias("label")).distinct()
    alone = led.select(F.col("lead.node").alias("group")).distinct().select("group", F.col("group").alias("node"), F.col("group").alias("label"))
    links = cut_lineage(linked(alone, asks, tokens, percent))

    groups = connected_components(links)
    now = led.join(groups, "node", "left").select("key", "node", "lead", F.coalesce("component", "node").alias("label"))
    split = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    left = cut_lineage(now.join(split, "key", "left_semi"))
    about = left.groupBy("node").agg(F.max("lead")["node"].alias("lead"), F.first("label").alias("label")).join(forms.select("node", "size"), "node")
    blocks = about.groupBy("lead").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("size") / TOKENS)).alias("blocks"))
    members = cut_lineage(about.join(blocks, "lead").select(F.xxhash64("lead", F.pmod(F.xxhash64("node"), "blocks")).alias("group"), "node", "label"))
    among = members.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    held = cut_lineage(left.select("key", "node").join(members, "node").select("key", "group").distinct().join(among, "group"))
    a, b = (held.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("group", "low", "high")]) for s in "ab")
    several = (F.least("low_a", "low_b") < F.greatest("high_a", "high_b")) & (F.col("group_a") <= F.col("group_b"))
    meets = a.join(b, "key").filter(several).select("group_a", "group_b", "low_b", "high_b").distinct()
    asks = meets.join(members, F.col("group_a") == F.col("group")).filter("low_b < high_b or low_b <> label").select(F.col("group_b").alias("group"), "node", "label")
    more = linked(members, asks, tokens, percent)
    # links of the second step are between components of the first
    return connected_components(cut_lineage(links.union(more)))


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id
    that links reach, itself included."""
    if not 50 < percent < 100:
        raise ValueError("percent is between 50 and 100")
    d = doc_frame(docs).withColumn("text_id", F.xxhash64("text"))
    rows = cut_lineage(sketches(d, shingle).withColumn("row", F.monotonically_increasing_id()))
    some = rows.filter("size > 0")
    forms = cut_lineage(some.groupBy("form", "form2").agg(F.min("row").alias("node"), F.min(F.struct("doc_id", "text_id")).alias("of"), F.min("doc_id").alias("least"), F.max("size").alias("size")).select("form", "form2", "node", "size", "least", "of.doc_id", "of.text_id"))
    found = form_components(d, forms, form_keys(d, shingle, percent), shingle, percent)
    grouped = cut_lineage(forms.join(found, "node", "left").select("form", "form2", "least", F.coalesce("component", "node").alias("component")))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("form", "form2", "component_id")
    linked_rows = some.join(named, ["form", "form2"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return linked_rows.unionByName(rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
