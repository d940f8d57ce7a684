"""Registered queries of the matrix scans, the distance-banded LD and the linkage graph.

Stand-ins as in ``queries``: a row of ``embeddings`` is a feature over 64 individuals;
features with an even number are variants, the others genes, and a feature's chromosome
is its label.  Variants lie 0.3 cM and 1000 positions apart in the order of their number.
The graph's vertices are events; events of one user within ``REACH`` seconds are linked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions import columns as c
from lociweave.functions.tdist import t_critical
from lociweave.operators import graph, ld, matrix, regress, relational
from lociweave.plans import studies
from lociweave.plans.queries import _LONG, _features, _rounded, _t, register

# ---------------------------------------------------------------- scans

_LINKED = "(SELECT vec_id AS feature_id, label, vec_id % 2 AS kind FROM embeddings)"


def _kind(spark, sf_dir, kind: int) -> DataFrame:
    return _features(spark, sf_dir).filter(F.col("feature_id") % 2 == kind)


def _legend(spark, sf_dir, kind: int) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 2 == kind)
    own = e.select(F.col("vec_id").alias("feature_id"), F.col("label").alias("chrom"), (F.col("vec_id") * 1000).alias("pos"))
    if kind == 0:
        return own
    return own.select("feature_id", "chrom", F.col("pos").alias("start"), (F.col("pos") + 5000).alias("end"), F.col("feature_id").alias("fgeneid"))


_SCAN = f"""
s AS (SELECT feature_id, avg(v) AS m, sum(v * v) AS raw, count(*) AS n FROM {_LONG} GROUP BY 1),
z AS (SELECT feature_id, ind, v, v - m AS d FROM {_LONG} JOIN s USING (feature_id)),
q AS (SELECT feature_id, sqrt(sum(d * d)) AS norm FROM z GROUP BY 1),
p AS (SELECT a.feature_id AS snp, b.feature_id AS gene, sum(a.v * b.v) AS xy, sum(a.d * b.d) AS dd FROM z a JOIN z b ON a.ind = b.ind WHERE a.feature_id % 2 = 0 AND b.feature_id % 2 = 1 GROUP BY 1, 2),
r AS (SELECT snp, gene, xy / s.raw AS beta, dd / (qa.norm * qb.norm) AS r, n FROM p JOIN s ON s.feature_id = snp JOIN q qa ON qa.feature_id = snp JOIN q qb ON qb.feature_id = gene),
t AS (SELECT *, sqrt(n - 2) * r / sqrt(1 - r * r) AS t FROM r)"""


@register(f"WITH {_SCAN} SELECT snp, gene, round(beta, 6) AS beta, round(beta / t, 6) AS se, round(t, 4) AS t FROM t WHERE abs(t) > 2.5")
def gene_snp_scan(spark, sf_dir):
    """All variants against all genes; pairs over the threshold leave the workers."""
    scan = matrix.pair_scan(_kind(spark, sf_dir, 0), _kind(spark, sf_dir, 1), t_crit=2.5)
    return _rounded(scan, {"beta": 6, "se": 6, "t": 4})


_CIS_T, _TRANS_T = t_critical(0.05, 63), t_critical(0.005, 63)


@register(f"""
WITH {_SCAN}, l AS (SELECT t.*, a.label = b.label AND ((snp * 1000 > gene * 1000 AND snp * 1000 < gene * 1000 + 5000) OR abs(snp * 1000 - gene * 1000) < 30000 OR abs(snp * 1000 - gene * 1000 - 5000) < 30000) AS is_cis, a.label AS chrom
  FROM t JOIN {_LINKED} a ON a.feature_id = snp JOIN {_LINKED} b ON b.feature_id = gene)
SELECT chrom, gene AS fgeneid, snp * 1000 AS pos, round(beta, 6) AS theta, round(beta / t, 6) AS serr, is_cis FROM l WHERE abs(t) > CASE WHEN is_cis THEN {_CIS_T!r} ELSE {_TRANS_T!r} END""")
def cis_trans_scan(spark, sf_dir):
    found = studies.cis_trans_scan(_kind(spark, sf_dir, 0), _legend(spark, sf_dir, 0), _kind(spark, sf_dir, 1), _legend(spark, sf_dir, 1), 63, cis_p=0.05, trans_p=0.005, reach=30_000)
    return _rounded(found, {"theta": 6, "serr": 6})


@register(f"WITH {_SCAN} SELECT snp, round(beta, 6) AS beta, round(t, 4) AS t FROM t WHERE gene = 1")
def single_trait_scan(spark, sf_dir):
    """All variants against the trait of the first gene."""
    trait = _kind(spark, sf_dir, 1).filter("feature_id = 1").first()["values"]
    return _rounded(matrix.single_trait_scan(_kind(spark, sf_dir, 0), trait).select("snp", "beta", "t"), {"beta": 6, "t": 4})


@register(f"""
WITH x AS (SELECT a.ind, a.v AS x1, b.v AS x2 FROM {_LONG} a JOIN {_LONG} b ON a.ind = b.ind WHERE a.feature_id = 0 AND b.feature_id = 1),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM x), k AS (SELECT ind, x1 - m1 AS x1, x2 - m2 AS x2 FROM x, m),
g AS (SELECT sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12 FROM k),
y AS (SELECT feature_id, ind, v - avg(v) OVER (PARTITION BY feature_id) AS y FROM {_LONG}),
b AS (SELECT feature_id, sum(y * x1) AS y1, sum(y * x2) AS y2 FROM y JOIN k USING (ind) GROUP BY 1),
f AS (SELECT feature_id, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM b, g)
SELECT feature_id, CAST(ind AS BIGINT) AS ind, round(y - b1 * x1 - b2 * x2, 6) + 0.0::DOUBLE AS value FROM y JOIN k USING (ind) JOIN f USING (feature_id)""")
def covariate_residuals(spark, sf_dir):
    """All features without what an intercept and two covariates of the individuals explain."""
    f = _features(spark, sf_dir)
    two = f.filter("feature_id in (0, 1)").select(F.col("feature_id").alias("which"), F.posexplode("values").alias("ind", "v"))
    covariates = two.groupBy("ind").agg(*[F.max(F.when(F.col("which") == k, F.col("v"))).alias(f"x{k}") for k in (0, 1)])
    left = matrix.residualise(f, matrix.covariate_basis(covariates, "ind", ["x0", "x1"]))
    return left.select("feature_id", F.posexplode("values").alias("ind", "value")).select("feature_id", F.col("ind").cast("long").alias("ind"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


# ---------------------------------------------------------------- LD

_TH, _RATE = c.panel_theta(ld.PANEL), 4 * ld.POPULATION / 100 / (2 * ld.PANEL)
_BAND = f"""
WITH d AS (SELECT feature_id, ind, v - avg(v) OVER (PARTITION BY feature_id) AS d, feature_id * 0.3::DOUBLE AS map FROM {_LONG}),
x AS (SELECT feature_id, map, sum(d * d) / (count(*) - 1) * {(1 - _TH) ** 2!r} + {0.5 * _TH * (1 - 0.5 * _TH)!r} AS v FROM d GROUP BY 1, 2),
n AS (SELECT a.feature_id AS i, b.feature_id AS j, exp(-(b.map - a.map) * {_RATE!r}) AS decay, sqrt(a.v * b.v) AS scale FROM x a JOIN x b ON a.feature_id < b.feature_id AND b.feature_id - a.feature_id < 10),
ld AS (SELECT i, j, {(1 - _TH) ** 2!r} * decay * any_value(c) / any_value(scale) AS r FROM (SELECT n.*, c FROM n JOIN (SELECT a.feature_id AS ci, b.feature_id AS cj, sum(a.d * b.d) / (count(*) - 1) AS c FROM d a JOIN d b ON a.ind = b.ind AND a.feature_id < b.feature_id AND b.feature_id - a.feature_id < 10 GROUP BY 1, 2) ON ci = i AND cj = j) WHERE decay >= 0.001 GROUP BY i, j, decay)
"""


def _mapped(spark, sf_dir) -> DataFrame:
    return _features(spark, sf_dir).withColumn("map", F.col("feature_id") * 0.3)


@register(_BAND + "SELECT i, j, round(r, 6) + 0.0::DOUBLE AS r FROM ld UNION ALL SELECT feature_id, feature_id, 1.0 FROM x")
def banded_ld(spark, sf_dir):
    """Shrunk correlations of all features within the map distance at which they decay."""
    pairs = ld.ld_pairs(_mapped(spark, sf_dir), key=None)
    return pairs.select("i", "j", (F.round("r", 6) + F.lit(0.0)).alias("r"))


@register(_BAND + "SELECT i AS src, j AS dst, round(r, 6) AS weight FROM ld WHERE r * r > 0.0004")
def banded_ld_edges(spark, sf_dir):
    return _rounded(ld.ld_edges(ld.ld_pairs(_mapped(spark, sf_dir), key=None), 0.02), {"weight": 6})


@register(_BAND + "SELECT i, j, round(r, 6) + 0.0::DOUBLE AS r FROM ld WHERE i % 3 > 0 AND j % 3 > 0 UNION ALL SELECT feature_id, feature_id, 1.0 FROM x WHERE feature_id % 3 > 0")
def ld_of_subsets(spark, sf_dir):
    """LD of two overlapping subsets of the features, put together."""
    kept = _mapped(spark, sf_dir).filter("feature_id % 3 > 0")
    middle = kept.agg(F.floor(F.median("feature_id"))).first()[0]
    parts = [ld.ld_pairs(kept.filter(F.col("feature_id") <= middle + 40), key=None), ld.ld_pairs(kept.filter(F.col("feature_id") > middle - 40), key=None)]
    return ld.concat_pairs(*parts).select("i", "j", (F.round("r", 6) + F.lit(0.0)).alias("r"))


# ---------------------------------------------------------------- the linkage graph

REACH = 28_800

_EVENTS = "(SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type, value FROM events)"
_LINKS = f"SELECT a.event_id AS a, b.event_id AS b FROM {_EVENTS} a JOIN {_EVENTS} b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.pos - b.pos) <= {REACH}"
_SESSIONS = f"""
o AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) <= {REACH} THEN 0 ELSE 1 END AS opens FROM {_EVENTS}),
w AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o),
g AS (SELECT event_id, user_id, event_type, value, min(event_id) OVER (PARTITION BY user_id, session) AS "group" FROM w)"""


def linkage_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All events as vertices, and links between a user's events within REACH."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    pairs = relational.band_join(events, "user_id", "pos", "event_id", REACH)
    return events.select(F.col("event_id").alias("vertex")), pairs.select(F.col("event_id_i").alias("src"), F.col("event_id_j").alias("dst"))


@register(f'WITH {_SESSIONS} SELECT event_id AS vertex, "group" FROM g')
def graph_components(spark, sf_dir):
    return graph.subgraphs(*linkage_graph(spark, sf_dir))


@register(f"""
WITH RECURSIVE l AS ({_LINKS}),
w(round, v, color) AS (
  SELECT 0, event_id, CASE WHEN event_id NOT IN (SELECT a FROM l WHERE b < a) THEN 0 END FROM events
  UNION ALL
  SELECT w.round + 1, w.v, CASE WHEN w.color IS NOT NULL THEN w.color WHEN n.waits = 0 THEN list_min(list_filter(range(0, len(n.used) + 1), lambda x: NOT list_contains(n.used, x))) END
  FROM w LEFT JOIN (SELECT l.a, count(*) FILTER (c.color IS NULL) AS waits, list(c.color) FILTER (c.color IS NOT NULL) AS used FROM l JOIN w c ON c.v = l.b WHERE l.b < l.a GROUP BY l.a) n ON n.a = w.v
  WHERE EXISTS (SELECT 1 FROM w x WHERE x.color IS NULL))
SELECT v AS vertex, CAST(color AS INT) AS color FROM w WHERE round = (SELECT max(round) FROM w)""")
def graph_colouring(spark, sf_dir):
    """First fit in the order of the vertices."""
    return graph.colouring(*linkage_graph(spark, sf_dir), priority="id")


_P = "((v * 48271 % 65537) / 65537.0::DOUBLE)"


@register(f"""
WITH RECURSIVE l AS (SELECT a, b, (b * 48271 % 65537, b) < (a * 48271 % 65537, a) AS earlier FROM ({_LINKS})),
w(round, v, stays) AS (
  SELECT 0, event_id, CAST(NULL AS BOOLEAN) FROM events
  UNION ALL
  SELECT w.round + 1, w.v, CASE WHEN w.stays IS NOT NULL THEN w.stays WHEN n.kept > 0 THEN false WHEN coalesce(n.waits, 0) = 0 THEN true END
  FROM w LEFT JOIN (SELECT l.a, count(*) FILTER (c.stays) AS kept, count(*) FILTER (c.stays IS NULL) AS waits FROM l JOIN w c ON c.v = l.b WHERE l.earlier GROUP BY l.a) n ON n.a = w.v
  WHERE EXISTS (SELECT 1 FROM w x WHERE x.stays IS NULL))
SELECT v AS vertex, round({_P}, 8) AS p FROM w WHERE stays AND round = (SELECT max(round) FROM w)""")
def clumped_hits(spark, sf_dir):
    """Of linked events the one with the smallest p stays."""
    vertices, edges = linkage_graph(spark, sf_dir)
    return _rounded(graph.clump(vertices.withColumn("p", (F.col("vertex") * 48_271 % 65_537) / 65_537), edges), {"p": 8})


@register(f"""
WITH {_SESSIONS} SELECT gene, "group", snp, round(p, 8) AS p FROM (
  SELECT event_type AS gene, "group", event_id AS snp, 1 / (1 + value) AS p, rank() OVER (PARTITION BY event_type, "group" ORDER BY 1 / (1 + value)) AS r FROM g) WHERE r = 1""")
def lead_variants(spark, sf_dir):
    """Of each event type and component the events with the greatest value."""
    hits = _t(spark, sf_dir, "events").select(F.col("event_type").alias("gene"), F.col("event_id").alias("snp"), (1 / (1 + F.col("value"))).alias("p"))
    return _rounded(graph.lead_variants(hits, graph.subgraphs(*linkage_graph(spark, sf_dir))).select("gene", "group", "snp", "p"), {"p": 8})


# ---------------------------------------------------------------- tails, mixtures, bins


@register("SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN 1 - 2 / pi() * atan(l_quantity / 10) ELSE 1 - (l_quantity / 10) / sqrt(2 + power(l_quantity / 10, 2)) END, 9) AS p FROM lineitem")
def tail_probabilities(spark, sf_dir):
    """Two-sided tails of t with one and two degrees of freedom, which have closed forms."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_quantity") / 10).alias("t"))
    return _rounded(regress.with_p(rows, (1 + F.col("l_linenumber") % 2).cast("double")).drop("t"), {"p": 9})


@register("SELECT CAST(floor(l_quantity / 5) + 1 AS BIGINT) AS bin_x, CAST(floor(l_extendedprice / 10000) + 1 AS BIGINT) AS bin_y, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 60 AND l_extendedprice >= 0 AND l_extendedprice < 120000 GROUP BY 1, 2")
def histogram_of_pairs(spark, sf_dir):
    """Counts in two-dimensional bins."""
    return relational.histogram_2d(_t(spark, sf_dir, "lineitem"), ("l_quantity", 0.0, 60.0, 12), ("l_extendedprice", 0.0, 120_000.0, 12))


@register("SELECT l_partkey AS snp, count(DISTINCT l_suppkey) AS genes, round(min(CASE WHEN l_returnflag = 'A' THEN 1 / (1 + l_extendedprice) END), 10) AS p_first, round(min(CASE WHEN l_returnflag = 'R' THEN 1 / (1 + l_extendedprice) END), 10) AS p_second FROM lineitem GROUP BY 1")
def genes_per_variant(spark, sf_dir):
    """Genes of each variant, and its smallest p in each of two studies."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("snp"), F.col("l_suppkey").alias("gene"), "l_returnflag", (1 / (1 + F.col("l_extendedprice"))).alias("p"))
    first, second = (rows.filter(F.col("l_returnflag") == f) for f in "AR")
    return _rounded(relational.genes_per_variant(rows, first, second), {"p_first": 10, "p_second": 10})
