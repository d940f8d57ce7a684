"""SimHash near-duplicates through Golay-code fuzzy hashing (operator 8).

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of
its word shingles.  Fingerprints at most ``max_bits`` (3) apart are linked and
the connected components of those links are the near-duplicate groups.

Links are found without comparing all pairs.  The fingerprint is cut into three
segments of 22, 21 and 21 bits.  Each segment, padded to 23 bits, is decoded with the
perfect binary Golay code: the index of its codeword is its *index key*; those of the
segment and of all its one-bit neighbours (six as a rule) are its *probe keys*, so the
index key of a segment is among the probe keys of every segment one bit away.  By
pigeonhole, three differing bits either leave one segment untouched and another with
one bit at most, or put one bit into each segment, which leaves a half of every segment
untouched.  So two families of keys meet every linked pair, and the exact Hamming
distance decides: a whole segment with the Golay key of another one (six pairs), and
the Golay key of the first segment with a half of each of the others (four choices).
Each key has 33 bits or more, so what meets by chance stays few among billions.

Scale: texts are read once and reduced to (doc_id, fingerprint); everything
after works on distinct fingerprints, so groups of exact copies cost one row.
The join emits verified links only; AQE splits the partition of a key that many
fingerprints share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame, hash_words
from lociweave.operators.graph import connected_components

#: Fixed values of the binary Golay code: generator polynomial
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, length and dimension.
GOLAY_POLY = 0b110001110101
GOLAY_BITS = 23
GOLAY_DATA = 12

#: (shift, width) of the three segments of a 64-bit fingerprint.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: (whole segment, segment by Golay key), and (halves of the second and of the third segment).
WHOLE_AND_NEAR = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
HALVES = ((0, 0), (0, 1), (1, 0), (1, 1))

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(GOLAY_BITS - 1, GOLAY_BITS - GOLAY_DATA - 1, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY_POLY << (bit - 11)), rest)
    return rest


def _error_table() -> np.ndarray:
    """Error pattern of weight three or less for each of the 2048 syndromes."""
    one = 1 << np.arange(GOLAY_BITS, dtype=np.int64)
    i, j, k = np.meshgrid(*[np.arange(GOLAY_BITS)] * 3, indexing="ij")
    errors = np.unique(np.concatenate(([0], (one[i] | one[j] | one[k]).ravel())))
    table = np.zeros(1 << 11, dtype=np.int64)
    table[_syndrome(errors)] = errors
    return table


_TABLE: list[np.ndarray] = []


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word (the code is perfect)."""
    if not _TABLE:
        _TABLE.append(_error_table())
    words = words.astype(np.int64)
    return (words ^ _TABLE[0][_syndrome(words)]) >> (GOLAY_BITS - GOLAY_DATA)


def segment_keys(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Index keys and probe keys (one column per probe; repeats are -1) of each segment."""
    index, probes = [], []
    for shift, width in SEGMENTS:
        seg = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
        near = np.sort(golay_index(seg[:, None] ^ flips[None, :]), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        index.append(golay_index(seg))
        probes.append(-np.sort(-near, axis=1))
    return index, probes


def simhash(words: list[bytes], shingle: int) -> int:
    """Unsigned 64-bit majority fingerprint of a document's lower-cased words."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), 42)
    parts = [words[i : i + n] for i in range(shingle)]
    hashes = np.fromiter((digest(b" ".join(x), 42) for x in zip(*parts, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((ones * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as the signed 64-bit form; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((simhash(hash_words(t.as_py() or "", _LOWER), shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return doc_frame(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def exact_parts(fp: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Each segment's value, and its lower 10 and its other bits."""
    whole = [((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    return whole, [(w & 1023, w >> 10) for w in whole]


def golay_keys(distinct: DataFrame, probes: bool) -> DataFrame:
    """(key, fp): the join keys of each fingerprint, ten with index keys, or one row for
    each of them and each probe key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                fp = fps[at : at + 4096]
                index, near = segment_keys(fp.view(np.uint64))
                whole, half = exact_parts(fp.view(np.uint64))
                exact = [(whole[a], b) for a, b in WHOLE_AND_NEAR] + [(half[1][i] << 11 | half[2][j], 0) for i, j in HALVES]
                for number, (part, segment) in enumerate(exact):
                    golay = near[segment] if probes else index[segment][:, None]
                    who, which = np.nonzero(golay >= 0)
                    key = (part[who] << GOLAY_DATA | golay[who, which]) << 4 | number
                    yield pa.record_batch([pa.array(key, pa.int64()), pa.array(fp[who], pa.int64())], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def fingerprint_links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at most ``max_bits`` apart, each found once or more.

    Probes of the smaller fingerprint meet index keys of the larger one; the cover is
    complete up to three bits.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys cover up to 3 differing bits")
    left = golay_keys(distinct, probes=True).select("key", F.col("fp").alias("a"))
    right = golay_keys(distinct, probes=False).select("key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return left.join(right, (left["key"] == right["key"]) & close).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) of every document.

    component_id is the smallest doc_id that links reach, itself included.  Null and
    wordless texts have fingerprint zero and link like any other; repeated rows are
    returned as often as they occur; a null doc_id gets its group's smallest id
    (null if the group has none).  An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    groups = connected_components(fingerprint_links(distinct, max_bits))
    grouped = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    totals = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_copies"))
    named = grouped.join(totals, "component").select("fp", "component_id", "n_copies")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, jaccard: float | None = None) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    With ``jaccard`` texts whose five-word shingles are that similar are linked as well, and the
    groups are the components of both kinds of links: edited copies often differ in more bits.
    """
    groups = near_duplicates(docs, shingle, max_bits).select("doc_id", "component_id")
    if jaccard is not None:
        from lociweave.llm.shingle_jaccard import near_copies

        both = groups.unionByName(near_copies(docs, jaccard)).filter("doc_id <> component_id")
        found = connected_components(both.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        groups = found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    return keep_first(docs, groups)


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each group (doc_id, component_id).

    Documents without an id cannot lose to another and all stay, each a group of its own
    in the second step, so they pile up nowhere; of rows that repeat one id and text, one
    stays.
    """
    losers = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.join(losers, "doc_id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("doc_id", "__simhash_text", "__simhash_row").orderBy("__simhash_text"))
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return rest.withColumn("__simhash_text", F.xxhash64("text")).withColumn("__simhash_row", alone).withColumn("__simhash_turn", turn).filter("__simhash_turn = 1").select(*docs.columns)
