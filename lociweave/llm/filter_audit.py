"""Audit of how filters overlap, from decision diagrams of failure masks (operator 13).

Every document has a mask with one bit per filter that it fails.  Spark counts the masks of
each part, so a part is at most 2^k rows whatever its number of documents, and of those a
count-weighted decision diagram is built: a level per filter, a branch for passing and one for
failing, equal subdiagrams stored once, leaves with the counts of one mask and every node
with the sum of its leaves.  Exchanging two adjacent levels touches the nodes of these levels only;
a chain of such swaps visits all k! orders.  In each order the path on which every filter
passes tells what each step removes: the count of the failing branch that leaves it.

Texts count as identical if their SHA-256 agrees.  A null text is an empty one, a null part
the empty string; a null doc_id neither repeats another row nor is repeated by one; rows that
repeat a doc_id are documents of their own, and an identical text fails only where a smaller
doc_id has it.  A document is good (toxic) if any of its labels says so.  An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame

#: Filters by letter; the bit of a letter is its place here.
FILTERS = "ABCDE"
#: Limits of the text filters: words, distinct words in percent, capitals in percent.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3

_SYMBOLS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))


def text_failures(text: bytes, n_chars: int) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()  # of bytes: blank and 9 to 13
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words), 100 * capitals > MAX_CAPITALS * n_chars, _SYMBOLS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def failing_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of every document: the filters that look at its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(2)).to_pylist()
            masks, digests = [], []
            for text, n in zip(batch.column(2), sizes, strict=True):
                raw = text.as_buffer().to_pybytes()
                masks.append(text_failures(raw, n))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    d = doc_frame(docs, "doc_id", "lang", "text")
    return d.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters that they fail.

    Texts are read once; the slim rows are stored, and the joins by digest and by doc_id are
    ones whose large keys Spark splits.
    """
    rows = cut_lineage(failing_texts(docs))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("quality", "toxic")])
    known = known.groupBy("doc_id").agg(F.max("quality").cast("long").alias("good"), F.max("toxic").cast("long").alias("toxic"))
    whole = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + repeats).alias("mask")).join(known, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return whole.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


class Diagram:
    """A decision diagram of masks: ``levels[k]`` maps a node to its (passing, failing) nodes,
    ``weight`` a node to the sums of the counts below it, ``order[k]`` is the filter of level k."""

    def __init__(self, counts: dict[int, tuple[int, ...]], n_filters: int):
        width = len(next(iter(counts.values())))
        self.order, self.levels, self.weight = list(range(n_filters)), [{} for _ in range(n_filters)], {}
        self._ids, leaves = count(), {}
        below = []
        for leaf in range(1 << n_filters):  # the first filter is the highest bit of a leaf's place
            held = tuple(counts.get(sum(1 << i for i in range(n_filters) if leaf >> (n_filters - 1 - i) & 1), (0,) * width))
            if held not in leaves:
                leaves[held] = next(self._ids)
                self.weight[leaves[held]] = held
            below.append(leaves[held])
        for k in range(n_filters - 1, -1, -1):
            unique: dict[tuple[int, int], int] = {}
            below = [self._node(unique, below[i], below[i + 1]) for i in range(0, len(below), 2)]
            self.levels[k] = {node: pair for pair, node in unique.items()}
        self.root = below[0]

    def _node(self, unique: dict[tuple[int, int], int], passing: int, failing: int) -> int:
        """The node of a level with these branches, made if there is none."""
        if (passing, failing) not in unique:
            node = unique[passing, failing] = next(self._ids)
            self.weight[node] = tuple(a + b for a, b in zip(self.weight[passing], self.weight[failing], strict=True))
        return unique[passing, failing]

    def swap(self, k: int) -> None:
        """Exchange the filters of levels k and k + 1; nodes above and below stay as they are."""
        unique: dict[tuple[int, int], int] = {}
        upper, lower = self.levels[k], self.levels[k + 1]
        for node, (passing, failing) in upper.items():
            (pp, pf), (fp, ff) = lower[passing], lower[failing]
            upper[node] = self._node(unique, pp, fp), self._node(unique, pf, ff)
        for node in lower.keys() - unique.values():
            del self.weight[node]
        self.levels[k + 1] = {node: pair for pair, node in unique.items()}
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(counts kept, counts removed) of each step along the path that passes everything."""
        out, node = [], self.root
        for level in self.levels:
            node, failing = level[node]
            out.append((self.weight[node], self.weight[failing]))
        return out


def swap_places(n: int) -> list[int]:
    """Places k whose swaps of k and k + 1, one after another, lead through all orders of n once."""
    if n < 2:
        return []
    out, down = [], True
    for inner in [*swap_places(n - 1), None]:  # the last one walks through, between swaps of the others
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            out.append(inner + down)
        down = not down
    return out


def audit_part(counts: dict[int, tuple[int, int, int]], filters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    of every order and step; counts has (documents, good, toxic) by mask."""
    diagram, walked = Diagram(counts, len(filters)), []
    for place in [None, *swap_places(len(filters))]:
        if place is not None:
            diagram.swap(place)
        walked.append((list(diagram.order), diagram.steps()))
    fails, alone, in_all = {}, {}, dict.fromkeys(range(len(filters)), 0)
    for order, steps in walked:
        fails[order[0]], alone[order[-1]] = steps[0][1][0], steps[-1][1][0]
        for f, (_, removed) in zip(order, steps, strict=True):
            in_all[f] += removed[0]
    out = []
    for order, steps in walked:
        name = "".join(filters[f] for f in order)
        out += [(name, k, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], in_all[f]) for k, (f, (kept, removed)) in enumerate(zip(order, steps, strict=True), 1)]
    return out


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of the filters in each part, from (part, mask, n, good, toxic).

    A part is one group of at most 2^k rows here; its result has k! times k rows, so this is
    meant for a handful of filters.
    """
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts = {m: (n, good, toxic) for m, n, good, toxic in frame[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        out = pd.DataFrame(audit_part(counts, filters), columns=columns)
        out.insert(0, "part", key[0])
        return out

    return masks.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns[2:]))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over every document; one row per part, order and step."""
    return audit(failure_masks(docs, labels))
