"""Registered queries of the stores: tables are written, copied, appended and read back.

Stand-ins as in ``queries``: a row of ``embeddings`` is a feature over 64 individuals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.cluster import scratch_dir
from lociweave.functions import columns as c
from lociweave.operators import relational
from lociweave.plans.import_queries import _letter, _text
from lociweave.plans.queries import _LONG, HITS, _features, _hits, _rounded, _t, register
from lociweave.sources import tables, text_import


def _long(rows):
    return rows.select("feature_id", F.posexplode("values").alias("ind", "value")).select("feature_id", F.col("ind").cast("long").alias("ind"), F.round("value", 6).alias("value"))


def _stored(spark, sf_dir) -> str:
    store = scratch_dir(spark)
    tables.append_matrix(_features(spark, sf_dir), store, "m")
    return store


@register(f"SELECT feature_id, CAST(ind - 2 AS BIGINT) AS ind, round(v, 6) AS value FROM {_LONG} WHERE feature_id >= 10 AND ind >= 2 AND ind < 60")
def stored_block(spark, sf_dir):
    """A block of a stored matrix that begins at a feature and goes past the last one."""
    store = _stored(spark, sf_dir)
    n = tables.read_table(spark, store, "m").count()
    return _long(tables.read_block(spark, store, "m", 10, n, 3, 58))


@register(f"SELECT feature_id, CAST(ind AS BIGINT) AS ind, round(v, 6) AS value FROM {_LONG} WHERE feature_id BETWEEN 6 AND (SELECT max(vec_id) - 4 FROM embeddings)")
def stored_column_slice(spark, sf_dir):
    """One column of a table from an offset on, by number of rows."""
    store = _stored(spark, sf_dir)
    last = tables.read_table(spark, store, "m").agg(F.max("feature_id")).first()[0]
    rows = tables.read_column(spark, store, "m", "values", 5, last - 9).withColumn("at", F.monotonically_increasing_id())
    return _long(relational.row_numbers(rows, ["at"], "k").select((F.col("k") + 5).alias("feature_id"), "values"))


@register(f"SELECT feature_id, CAST(63 - ind AS BIGINT) AS ind, round(v, 6) AS value FROM {_LONG} WHERE feature_id % 3 = 1 UNION ALL SELECT feature_id, CAST(63 - ind AS BIGINT), round(v, 6) FROM {_LONG} WHERE feature_id % 3 = 1 AND feature_id % 2 = 0")
def copied_features(spark, sf_dir):
    """Features copied by an index, with repeats, in two appends; individuals turned round."""
    store = _stored(spark, sf_dir)
    index = _features(spark, sf_dir).filter("feature_id % 3 = 1").select(F.col("feature_id").alias("pos"), "feature_id")
    tables.copy_features(spark, store, "m", index, "n")
    tables.copy_features(spark, store, "m", index.filter("feature_id % 2 = 0"), "n")
    return _long(tables.take_individuals(tables.read_table(spark, store, "n"), list(range(64, 0, -1))))


@register("SELECT t AS table_name, c AS column_name, k AS type, CASE WHEN t = 'both' THEN 2 ELSE 1 END * n AS n_rows FROM (SELECT count(*) AS n FROM lineitem), (VALUES ('one', 'l_suppkey', 'bigint'), ('one', 'l_quantity', 'double'), ('both', 'l_suppkey', 'bigint'), ('both', 'l_quantity', 'double')) x(t, c, k)")
def described_store(spark, sf_dir):
    """Tables of a store after one was appended to another twice."""
    store = scratch_dir(spark)
    tables.write_table(_t(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), store, "one")
    for _ in range(2):
        tables.append_table(spark, store, "one", "both")
    return tables.describe_store(spark, store, ["one", "both"])


@register("SELECT s_suppkey AS i, l_linenumber AS j, count(*) * CASE WHEN s_suppkey <= 16 AND l_linenumber <= 16 THEN 2.0::DOUBLE ELSE 1.0 END AS value FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2")
def stored_pair_blocks(spark, sf_dir):
    """A pair table in tiles; the first tile is written again and replaces the stored one."""
    store = scratch_dir(spark)
    pairs = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    tables.write_pair_block(pairs, store, "p", 16)
    tables.write_pair_block(pairs.filter("i <= 16 and j <= 16").withColumn("value", F.col("value") * 2), store, "p", 16)
    return tables.read_table(spark, store, "p", ["i", "j", "value"])


@register("SELECT s_nationkey AS gene, s_suppkey, round(s_acctbal, 2) AS weight FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 10)")
def stored_by_gene(spark, sf_dir):
    """One folder per gene; the folders of the genes asked for are read."""
    store = scratch_dir(spark)
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("gene"), "s_suppkey", F.round("s_acctbal", 2).alias("weight"))
    tables.write_by_chromosome(rows, store, "weights", "gene")
    return tables.read_table(spark, store, "weights").join(rows.filter("s_suppkey <= 10").select("gene").distinct(), "gene", "left_semi").select("gene", "s_suppkey", "weight")


@register(f"SELECT CAST(feature_id + 1 AS BIGINT) AS line_no, round(sum(round(v, 5)), 4) + 0.0::DOUBLE AS total FROM {_LONG} WHERE feature_id % 5 = 2 GROUP BY 1")
def matrix_text_rows(spark, sf_dir):
    """Listed lines of a text matrix."""
    f = _features(spark, sf_dir).orderBy("feature_id")
    path = scratch_dir(spark)
    f.select(F.array_join(F.transform("values", lambda x: F.round(x, 5).cast("string")), " ").alias("value")).write.text(path)
    lines = _features(spark, sf_dir).filter("feature_id % 5 = 2").select((F.col("feature_id") + 1).alias("line_no"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return text_import.matrix_rows(spark, path, lines).select("line_no", (F.round(total, 4) + F.lit(0.0)).alias("total"))


@register("SELECT p_partkey, chr(CAST(65 + p_partkey % 4 AS INT)) AS ref, CASE WHEN p_size % 7 > 0 THEN chr(CAST(65 + p_size % 4 AS INT)) END AS alt, 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS gene FROM part")
def split_alleles(spark, sf_dir):
    """ref and alt from an allele column, which may lack the second; identifiers without version."""
    allele = F.concat_ws("/", _letter(F.col("p_partkey")), F.when(F.col("p_size") % 7 > 0, _letter(F.col("p_size"))))
    rows = _t(spark, sf_dir, "part").select("p_partkey", allele.alias("allele"), F.printf(F.lit("ENSG%011d.12"), "p_partkey").alias("g"))
    return text_import.split_alleles(rows).select("p_partkey", "ref", "alt", c.strip_version(F.col("g")).alias("gene"))


@register(f"""
WITH e AS (SELECT DISTINCT l_partkey AS rsid FROM lineitem), k AS (SELECT rsid FROM e WHERE rsid % 3 = 0),
l AS (SELECT a.rsid AS i, b.rsid AS j FROM e a JOIN e b ON b.rsid BETWEEN a.rsid AND a.rsid + 6)
SELECT 'effect' AS part, k.rsid AS i, k.rsid AS j, round(sum(theta), 2) AS value FROM k JOIN {HITS} h ON h.pos = k.rsid GROUP BY 1, 2, 3
UNION ALL SELECT 'ld', i, j, round(1.0 / (1 + j - i), 2) FROM l WHERE i IN (FROM k) AND j IN (FROM k)""")
def summary_bundle(spark, sf_dir):
    """Effects and LD pairs of a list of variants."""
    effects = _hits(spark, sf_dir).groupBy(F.col("pos").alias("rsid")).agg(F.sum("theta").alias("theta"))
    pairs = effects.select(F.col("rsid").alias("i"), F.explode(F.sequence("rsid", F.col("rsid") + 6)).alias("j")).join(effects.select(F.col("rsid").alias("j")), "j", "left_semi").withColumn("r", 1 / (1 + F.col("j") - F.col("i")))
    own, near = tables.summary_bundle(effects, pairs, effects.filter("rsid % 3 = 0").select("rsid"))
    rows = own.select(F.lit("effect").alias("part"), F.col("rsid").alias("i"), F.col("rsid").alias("j"), F.col("theta").alias("value")).unionByName(near.select(F.lit("ld").alias("part"), "i", "j", F.col("r").alias("value")))
    return _rounded(rows, {"value": 2})
