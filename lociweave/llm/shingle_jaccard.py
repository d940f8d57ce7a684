"""Near copies by the Jaccard similarity of word shingles, for the pipeline's stage.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; the connected components of the links are the groups.
A fingerprint's distance cannot decide that: at 0.8 about 10 of 64 majority bits
differ, far beyond what the Golay keys of operator 8 cover.

Candidates are texts that share one of 30 keys of five MinHash values each.  A pair
at exactly 0.8 shares none with probability (1 - 0.8^5)^30 = 7e-6, a closer pair with
less.  Every candidate pair that could still join two groups is decided by its exact
Jaccard similarity, so no two texts are linked without it.

Scale: texts with the same words are one *form* and cost one row.  First the forms of a
key meet its centre, the form that shares keys most (of edited copies the text they
come from), then what is left meets the next centre.  So m near copies of one text cost
about m exact checks, not m(m-1)/2.  Forms whose keys still hold several groups, as
those of texts with a common passage do, meet by their rarest shingles: two texts at
0.8 have one of them in common for certain, and a common passage is none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame, hash_words
from lociweave.llm.golay_simhash import _LOWER, keep_first
from lociweave.operators.graph import connected_components

#: MinHash values by key and number of keys; rounds in which one form of each key meets the others.
ROWS, BANDS = 5, 30
STARS = 2

_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DRAWN = np.random.default_rng(8).integers(0, 1 << 64, size=(3, ROWS * BANDS + 64), dtype=np.uint64)
_TIMES, _PLUS, _PLACE = _DRAWN[0, : ROWS * BANDS] | np.uint64(1), _DRAWN[1, : ROWS * BANDS], _DRAWN[2] | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out += own[j : j + n] * _PLACE[j]
    return np.unique(_mixed(out))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The 30 candidate keys of a set of shingle hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS]).view(np.int64)


def _form(text: Column) -> Column:
    """A hash of the lower-cased words, as ``hash_words`` separates them."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWERED), r"[\t-\r ]+", " ")))


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, form, size, keys): size counts the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for t in batch.column(2):
                hashes = shingle_hashes(hash_words(t.as_py() or "", _LOWER), shingle)
                sizes.append(len(hashes))
                keys.append(band_keys(hashes))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists], names=["doc_id", "form", "size", "keys"])

    return docs.select("doc_id", "form", "text").mapInArrow(run, "doc_id long, form long, size long, keys array<long>")


def similar(pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b) of the pairs (a, b, text_a, text_b) whose shingle sets are similar enough, exactly."""

    def shingles(text: str) -> set[tuple[bytes, ...]]:
        words = hash_words(text, _LOWER)
        return set(zip(*[words[i:] for i in range(min(shingle, len(words)))], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            close = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, left = a, shingles(text_a.as_py())
                right = shingles(text_b.as_py())
                shared = len(left & right)
                close.append(shared > 0 and shared / (len(left) + len(right) - shared) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def rare_shingles(docs: DataFrame, forms: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(form, hash, turn): of each of the forms the rarest shingles among them, turn 1 first, so
    many that two forms which are similar enough have one of these in common for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for form, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_hashes(hash_words(text.as_py(), _LOWER), shingle).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(hashes), form)), pa.array(hashes)], names=["form", "hash"])

    every = cut_lineage(form_texts(docs, forms).mapInArrow(run, "form long, hash long"))
    counted = every.join(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash")
    size, turn = F.count(F.lit(1)).over(Window.partitionBy("form")), F.row_number().over(Window.partitionBy("form").orderBy("n", "hash"))
    placed = counted.withColumn("size", size).withColumn("turn", turn)
    return cut_lineage(placed.filter((F.col("turn") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1) & (F.col("n") > 1)).select("form", "hash", "turn"))


def form_texts(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, text): a text of each of the forms."""
    of = docs.select("form", F.coalesce("text", F.lit("")).alias("text")).join(forms, "form", "left_semi")
    return of.groupBy("form").agg(F.first("text").alias("text"))


def similar_links(docs: DataFrame, forms: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links between forms (form, size, keys) whose components are those of all
    candidate pairs that are similar enough; docs has a text of each form."""

    def decided(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs.distinct())
        wanted = pairs.select(F.col("a").alias("form")).union(pairs.select("b")).distinct()
        texts = cut_lineage(form_texts(docs, wanted))
        of = lambda end: texts.select(F.col("form").alias(end), F.col("text").alias(f"text_{end}"))
        return cut_lineage(similar(pairs.join(of("b"), "b").join(of("a"), "a"), similarity, shingle))

    sized = lambda x, y: F.least(x, y) / F.greatest(x, y) >= similarity
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    keyed = forms.select("form", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_ = cut_lineage(keyed.join(shared, "key"))
    degree = open_.groupBy("form").agg(F.sum("n").alias("degree"))
    open_ = cut_lineage(open_.join(degree, "form").select("key", "form", "size", "degree", F.col("form").alias("component")))
    links = open_.select(F.col("form").alias("a"), F.col("form").alias("b")).limit(0)
    for _ in range(STARS):
        centre = open_.groupBy("key").agg(F.max(F.struct("degree", "form", "size", "component")).alias("centre"))
        star = cut_lineage(open_.join(centre, "key").filter(F.col("form") != F.col("centre.form")))
        found = star.filter((F.col("component") != F.col("centre.component")) & sized(F.col("size"), F.col("centre.size")))
        links = links.union(decided(found.select(*pair(F.col("form"), F.col("centre.form")))))
        groups = connected_components(links).withColumnRenamed("node", "form")
        rest = star.select("key", "form", "size", "degree").join(groups, "form", "left").select("key", "form", "size", "degree", F.coalesce("component", "form").alias("component"))
        mixed = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
        open_ = cut_lineage(rest.join(mixed, "key", "left_semi"))
    rest = open_.select("form", "size", "component").distinct()
    rare = rare_shingles(docs, rest.select("form"), similarity, shingle).join(rest, "form")
    left = rare.select("hash", F.col("form").alias("a"), F.col("size").alias("size_a"), F.col("turn").alias("turn_a"), F.col("component").alias("group_a"))
    right = rare.select("hash", F.col("form").alias("b"), F.col("size").alias("size_b"), F.col("turn").alias("turn_b"), F.col("component").alias("group_b"))
    # after the first shingle in common, only later ones can be
    enough = 1 + F.least(F.col("size_a") - F.col("turn_a"), F.col("size_b") - F.col("turn_b")) >= (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-6
    apart = (F.col("a") < F.col("b")) & (F.col("group_a") != F.col("group_b")) & sized(F.col("size_a"), F.col("size_b"))
    met = left.join(right, (left["hash"] == right["hash"]) & apart & enough)
    return links.union(decided(met.select("a", "b")))


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of every document; component_id is the smallest doc_id of the group.

    Texts with the same words are one group, and so are null and wordless texts; a null
    doc_id gets its group's smallest id (null if the group has none).
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the candidate keys are made for similarities of 0.8 or more")
    d = doc_frame(docs).withColumn("form", _form(F.col("text")))
    sketches = cut_lineage(_sketches(d, shingle))
    forms = cut_lineage(sketches.groupBy("form").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("doc_id").alias("least")))
    groups = connected_components(similar_links(d, forms, similarity, shingle))
    grouped = cut_lineage(forms.select("form", "least").join(groups, forms["form"] == groups["node"], "left").select("form", "least", F.coalesce("component", "form").alias("component")))
    totals = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return sketches.select("doc_id", "form").join(grouped.join(totals, "component").select("form", "component_id"), "form").select("doc_id", "component_id")


def keep_one_copy(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null and wordless texts are one group; documents without an id stay; of rows that
    repeat an id and a text one stays; an empty table gives an empty result.
    """
    return keep_first(docs, near_copies(docs, similarity, shingle))
