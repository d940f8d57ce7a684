"""Benchmark decontamination with an FM-index per training shard (operator 7).

Test items are cut into windows of ten consecutive words (an item with fewer
words is one window).  Documents are taken in shards of about ``shard_words``
words; each shard gets an FM-index over word numbers: a suffix array by prefix
doubling, its Burrows-Wheeler transform in a wavelet matrix (a wavelet tree
stored level by level), and suffix positions sampled every few words.  All
windows are searched at once by backward search, occurrences are located by
walking to the next sampled position, and overlapping hits are merged to the
spans to remove.

Words that occur in no window can be part of no hit, and neither can a run of
other words that is shorter than the shortest window; the index holds the
remaining runs, each closed by a separator, so the result is unchanged and the
index stays in proportion to what can match.

One pass over the documents, no shuffle: a window never leaves its document.
The windows are a stated query set.  Tasks cut them and build them into blocks of about
``block_windows`` windows, which are broadcast; each task goes through them one by one.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import ship_package
from lociweave.llm.common import cut_lineage, doc_frame, hash_words

#: A-Z to a-z; digits, a-z and non-ASCII bytes are word bytes; all others separate.
WORD_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Every so many words of a run have their suffix position stored.
SAMPLE = 8


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Suffix array of a text given its symbols' ranks, by prefix doubling.

    Only suffixes that still tie are sorted again.  A unique last symbol is expected.
    """
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ordered[1:] != ordered[:-1])), np.arange(n), 0))
    place = np.empty(n, np.int64)  # first row of the group of suffixes that tie
    place[order] = head
    step = 1
    while True:
        size = np.bincount(place, minlength=n)
        tied = np.flatnonzero(size[place] > 1)
        if not len(tied):
            break
        after = np.where(tied + step < n, place[np.minimum(tied + step, n - 1)] + 1, 0)
        key = place[tied] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = place[tied]
        index = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), index, 0))
        row = group + index - first
        change = np.concatenate(([True], key[1:] != key[:-1]))
        place[tied] = row[np.maximum.accumulate(np.where(change, index, 0))]
        step *= 2
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    return order


class WaveletMatrix:
    """Rank queries on a sequence of small integers, one bit level at a time."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            self.levels.append((shift, ones, len(values) - int(ones[-1])))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start, end = np.zeros_like(end), end.copy()
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """FM-index over runs of symbols (1 or more), each closed by a separator (0)."""

    def __init__(self, text: np.ndarray, n_symbols: int) -> None:
        n = len(text)
        closing = text == 0
        n_runs = int(closing.sum())
        self.order = suffix_array(np.where(closing, np.cumsum(closing) - 1, n_runs + text))
        self.last = text[self.order - 1]
        self.ranks = WaveletMatrix(self.last, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        start = np.concatenate(([0], np.flatnonzero(closing)[:-1] + 1))
        offset = np.arange(n) - np.repeat(start, np.diff(np.concatenate((start, [n]))))
        sampled = (offset % SAMPLE == 0)[self.order]
        self.sampled = sampled
        self.sample_row = np.cumsum(sampled) - 1
        self.sample = self.order[sampled]
        del self.order

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of each pattern (rows of equal length) by backward search."""
        n = len(self.last)
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        live = np.arange(len(patterns))
        for at in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, at]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows, by steps back to the nearest sampled position."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            at = live[done]
            out[at] = self.sample[self.sample_row[rows[at]]] + steps[at]
            live = live[~done]
            symbol = self.last[rows[live]]
            rows[live] = self.first[symbol] + self.ranks.rank(symbol, rows[live])
            steps[live] += 1
        return out


@dataclass
class Windows:
    """A block of distinct windows by length, with the items each belongs to."""

    vocab: dict[bytes, int]
    patterns: list[np.ndarray]
    items: list[np.ndarray]
    bounds: list[np.ndarray]
    names: list[str]


def cut_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(gram, item), distinct: the windows of every item, each as its words joined by blanks.

    Rows without an id or without words have no windows; rows with one id are one item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = hash_words(text.as_py() or "", WORD_FOLD)
                if name is not None and words:
                    own = {b" ".join(words[at : at + width]) for at in range(max(1, len(words) - width + 1))}
                    yield pa.record_batch([pa.array(list(own), pa.binary()), pa.array([name] * len(own))], names=["gram", "item"])

    ship_package(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return items.mapInArrow(run, "gram binary, item string").distinct()


def build_block(rows: list[tuple[bytes, str]]) -> Windows:
    """The block of some (gram, item) rows."""
    owners: dict[bytes, list[str]] = {}
    for gram, item in sorted(rows):
        owners.setdefault(gram, []).append(item)
    windows = {gram: gram.split() for gram in owners}
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for x in windows.values() for w in x}))}
    number = {n: i for i, n in enumerate(sorted({n for x in owners.values() for n in x}))}
    made = Windows(vocab, [], [], [], list(number))
    for size in sorted({len(x) for x in windows.values()}):
        same = [gram for gram, x in windows.items() if len(x) == size]
        made.patterns.append(np.array([[vocab[w] for w in windows[gram]] for gram in same], np.int32))
        made.items.append(np.array([number[n] for gram in same for n in owners[gram]], np.int32))
        made.bounds.append(np.cumsum([0] + [len(owners[gram]) for gram in same]))
    return made


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the number of the range each comes from."""
    size = end - start
    who = np.repeat(np.arange(len(size)), size)
    return np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + start[who], who


def search_shard(words: list[bytes], ends: np.ndarray, block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits of a block in a shard: begin and end word of each, and (document, item) pairs.

    words: the shard's documents one after another; ends: where each document ends.
    """
    none = np.zeros(0, np.int64)
    shortest = block.patterns[0].shape[1] if block.patterns else 0
    ids = np.fromiter(map(block.vocab.get, words, repeat(0)), np.int64, len(words))
    known = ids > 0
    opens = known & ~np.concatenate(([False], known[:-1]))
    begins = ends[:-1][ends[:-1] < len(words)]
    opens[begins] = known[begins]
    start = np.flatnonzero(opens)
    stop_at = np.concatenate((np.flatnonzero(~known), ends, start))
    stop_at.sort()
    stop = stop_at[np.searchsorted(stop_at, start, side="right")] if len(start) else none
    long = stop - start >= shortest
    start, stop = start[long], stop[long]
    if not len(start) or not shortest:
        return none, none, np.zeros((0, 2), np.int64)
    at, run = spread(start, stop + 1)  # one place more for the separator
    closing = at == stop[run]
    text = np.where(closing, 0, ids[np.minimum(at, len(ids) - 1)])
    index = FMIndex(text, len(block.vocab))
    first, last, pairs = [], [], []
    for patterns, items, bounds in zip(block.patterns, block.items, block.bounds, strict=True):
        low, high = index.search(patterns)
        rows, window = spread(low, high)
        found = at[index.locate(rows)]
        first.append(found)
        last.append(found + patterns.shape[1])
        doc = np.searchsorted(ends, found, side="right")
        once = np.unique(np.stack([doc, window], axis=1), axis=0)
        which, owner = spread(bounds[once[:, 1]], bounds[once[:, 1] + 1])
        pairs.append(np.stack([once[owner, 0], items[which]], axis=1))
    return np.concatenate(first), np.concatenate(last), np.unique(np.concatenate(pairs), axis=0)


def shared_blocks(docs: DataFrame, benchmark: DataFrame, width: int, block_windows: int) -> list:
    """Broadcasts of the blocks of a benchmark's windows, each pickled.

    Windows are cut, made distinct, dealt by ranges of (gram, item) and built into blocks
    by tasks; the driver passes one block of about ``block_windows`` rows on at a time.
    """
    rows = cut_lineage(cut_windows(benchmark, width))
    n_blocks = -(-rows.count() // block_windows)
    if not n_blocks:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if own:
            yield pa.record_batch([pa.array([pickle.dumps(build_block(own))], pa.binary())], names=["block"])

    built = cut_lineage(rows.repartitionByRange(n_blocks, "gram", "item").mapInArrow(run, "block binary"))
    return [docs.sparkSession.sparkContext.broadcast(bytes(r["block"])) for r in built.toLocalIterator()]


def shards(texts: pa.Array, shard_words: int) -> Iterator[tuple[range, list[list[bytes]]]]:
    """Shards of a batch: row ranges and their documents' words, about ``shard_words`` each."""
    first, held, words = 0, 0, []
    for row, text in enumerate(texts):
        words.append(hash_words(text.as_py() or "", WORD_FOLD))
        held += len(words[-1])
        if held >= shard_words:
            yield range(first, row + 1), words
            first, held, words = row + 1, 0, []
    if words:
        yield range(first, len(texts)), words


def examine(texts: list[list[bytes]], blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Of a shard: words and hit words by document, which words are hit, items by document."""
    words = [w for t in texts for w in t]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    turns = np.zeros(len(words) + 1, np.int64)
    items_of: list[set[str]] = [set() for _ in texts]
    for shared in blocks:
        block = pickle.loads(shared.value)
        first, last, pairs = search_shard(words, ends, block)
        np.add.at(turns, first, 1)
        np.add.at(turns, last, -1)
        for doc, item in pairs.tolist():
            items_of[doc].add(block.names[item])
    hit = np.cumsum(turns[:-1]) > 0
    upto = np.concatenate(([0], np.cumsum(hit)))
    return sizes, upto[ends] - upto[ends - sizes], hit, [sorted(x) for x in items_of]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:int,last:int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 400_000, block_windows: int = 200_000) -> DataFrame:
    """Hits of the benchmark's windows in every document.

    spans are the merged hits as word numbers (first included, last excluded); items
    are the item ids with an occurring window, sorted as strings.  Null and wordless
    texts have no words and no hits; repeated rows are returned as often as they occur.
    A worker holds the pickled blocks, some 50 bytes a window, and one block unpacked.
    """
    blocks = shared_blocks(docs, benchmark, width, block_windows)

    def shard(ids: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes, n_hit, hit, names = examine(texts, blocks)
        ends = np.cumsum(sizes)
        spans = []
        for end, size, n in zip(ends, sizes, n_hit, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[end - size : end].view(np.int8), [0])))) if n else np.zeros(0, np.int64)
            spans.append([{"first": int(a), "last": int(b)} for a, b in edge.reshape(-1, 2)])
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(digests), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(names, pa.list_(pa.string()))]
        return pa.record_batch(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in shards(batch.column(1), shard_words):
                yield shard(batch.column(0).slice(rows.start, len(rows)), texts)

    return doc_frame(docs).mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 400_000, block_windows: int = 200_000) -> DataFrame:
    """The documents without a hit, with their columns; one pass, no shuffle.

    Null, empty and wordless texts have no hit and stay; rows that repeat stay or go
    together; without windows every document stays; an empty table gives an empty result.
    """
    blocks = shared_blocks(docs, benchmark, width, block_windows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in shards(batch.column(at), shard_words):
                clean = examine(texts, blocks)[1] == 0
                yield batch.slice(rows.start, len(rows)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
