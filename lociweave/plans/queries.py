"""Registered queries of the association operators over the driver's tables, with their SQL.

Stand-ins: in ``lineitem`` a supplier is a gene, a part a position, a line number a
chromosome, the quantity an effect and the price another study's effect; rows of
``embeddings`` are individuals (or features) and array positions features (or
individuals); in ``events`` a user is a chromosome and seconds are positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage
from lociweave.functions import columns as c
from lociweave.operators import ld, matrix, mixture, regress, relational
from lociweave.plans import studies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as association results: fgeneid, pos, chrom, theta, beta, serr."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("fgeneid"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("chrom"), F.col("l_quantity").alias("theta"), F.col("l_extendedprice").alias("beta"), (0.01 + F.col("l_tax")).alias("serr"), "l_returnflag", "l_orderkey", "l_discount")


HITS = "(SELECT l_suppkey AS fgeneid, l_partkey AS pos, l_linenumber AS chrom, l_quantity AS theta, l_extendedprice AS beta, 0.01 + l_tax AS serr, l_returnflag, l_orderkey, l_discount FROM lineitem)"


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(x, digits[x]).alias(x) if x in digits else F.col(x) for x in df.columns])


_GATED = f"""h AS (SELECT * FROM {HITS} WHERE fgeneid IN (SELECT fgeneid FROM {HITS} GROUP BY 1 HAVING count(DISTINCT theta) > 3 AND count(DISTINCT beta) > 3))"""
_ORIGIN_SUMS = "sum(theta * theta / (serr * serr)) AS xx, sum(theta * ln(beta) / (serr * serr)) AS xy, sum(ln(beta) * ln(beta) / (serr * serr)) AS yy, count(*) AS n"


@register(f"""
WITH {_GATED}, s AS (SELECT fgeneid, {_ORIGIN_SUMS} FROM h GROUP BY 1),
f AS (SELECT fgeneid, n, xy / xx AS slope, sqrt(greatest(yy - xy / xx * xy, 0) / (n - 1)) AS sigma, xx, yy, greatest(yy - xy / xx * xy, 0) AS rss FROM s)
SELECT fgeneid, n, round(slope, 8) AS slope, round(sigma / sqrt(xx), 8) AS se, round(slope / (sigma / sqrt(xx)), 4) AS t, round(sigma, 5) AS sigma, round(1 - rss / yy, 8) AS r2 FROM f""")
def weighted_origin_regression(spark, sf_dir):
    fit = studies.effect_regression(_hits(spark, sf_dir), "fgeneid", F.ln("beta"), F.col("theta"), 1 / (F.col("serr") * F.col("serr")), ["theta", "beta"])
    return _rounded(fit, {"slope": 8, "se": 8, "t": 4, "sigma": 5, "r2": 8})


_INTERCEPT = f"""
WITH m AS (SELECT fgeneid, sum(theta / serr) / sum(1 / serr) AS mx, sum(beta / serr) / sum(1 / serr) AS my FROM {HITS} GROUP BY 1),
s AS (SELECT h.fgeneid, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((theta - mx) * (theta - mx) / serr) AS xx, sum((theta - mx) * (beta - my) / serr) AS xy, sum((beta - my) * (beta - my) / serr) AS yy
  FROM {HITS} h JOIN m USING (fgeneid) GROUP BY 1),
f AS (SELECT *, xy / xx AS slope, my - xy / xx * mx AS intercept, sqrt(greatest(yy - xy / xx * xy, 0) / (n - 2)) AS sigma FROM s)
"""


@register(_INTERCEPT + "SELECT fgeneid, n, round(intercept, 4) AS intercept, round(slope, 5) AS slope, round(sigma / sqrt(xx), 5) AS se, round(slope / (sigma / sqrt(xx)), 4) AS t FROM f")
def weighted_intercept_regression(spark, sf_dir):
    fit = regress.intercept_regression(_hits(spark, sf_dir), ["fgeneid"], F.col("beta"), F.col("theta"), 1 / F.col("serr"))
    return _rounded(fit.select("fgeneid", "n", "intercept", "slope", "se", "t"), {"intercept": 4, "slope": 5, "se": 5, "t": 4})


@register(_INTERCEPT + f"SELECT fgeneid, pos, chrom, l_orderkey, round(intercept + slope * theta, 3) AS fitted, round(beta - intercept - slope * theta, 3) AS resid FROM {HITS} h JOIN f USING (fgeneid)")
def regression_residuals(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    fit = regress.intercept_regression(hits, ["fgeneid"], F.col("beta"), F.col("theta"), 1 / F.col("serr"))
    return _rounded(regress.fitted_rows(hits, fit, ["fgeneid"], F.col("beta"), F.col("theta")).select("fgeneid", "pos", "chrom", "l_orderkey", "fitted", "resid"), {"fitted": 3, "resid": 3})


@register(f"""
WITH o AS (SELECT fgeneid, sum(theta * beta / serr) / sum(theta * theta / serr) AS b, count(*) AS n0 FROM {HITS} WHERE l_returnflag <> 'A' GROUP BY 1),
m AS (SELECT fgeneid, sum(theta / serr) / sum(1 / serr) AS mx, sum(beta / serr) / sum(1 / serr) AS my FROM {HITS} WHERE l_returnflag = 'A' GROUP BY 1),
s AS (SELECT h.fgeneid, count(*) AS n1, any_value(mx) AS mx, any_value(my) AS my, sum((theta - mx) * (beta - my) / serr) / sum((theta - mx) * (theta - mx) / serr) AS b FROM {HITS} h JOIN m USING (fgeneid) WHERE l_returnflag = 'A' GROUP BY 1),
j AS (SELECT o.fgeneid, n0 + n1 AS n, o.b AS b1, s.my - s.b * s.mx AS b2, s.b - o.b AS b3 FROM o JOIN s USING (fgeneid))
SELECT fgeneid, n, 'theta' AS term, round(b1, 3) AS estimate FROM j UNION ALL SELECT fgeneid, n, 'is_cis', round(b2, 3) FROM j UNION ALL SELECT fgeneid, n, 'theta:is_cis', round(b3, 3) FROM j""")
def interaction_regression(spark, sf_dir):
    cis = (F.col("l_returnflag") == "A").cast("double")
    fit = regress.design_regression(_hits(spark, sf_dir), ["fgeneid"], F.col("beta"), {"theta": F.col("theta"), "is_cis": cis, "theta:is_cis": F.col("theta") * cis}, 1 / F.col("serr"))
    return fit.select("fgeneid", "n", "term", F.round("estimate", 3).alias("estimate"))


@register(f"""
WITH h AS (SELECT *, floor((pos - min(pos) OVER (PARTITION BY chrom) + 1) / 20) + 1 AS block, abs(theta / serr) AS abs_t FROM {HITS}),
k AS (SELECT *, rank() OVER (PARTITION BY chrom, fgeneid, block ORDER BY abs_t DESC) AS r FROM h WHERE abs_t > 300)
SELECT chrom, fgeneid, CAST(block AS BIGINT) AS block, pos, l_orderkey, round(abs_t, 6) AS abs_t FROM k WHERE r = 1""")
def top_hit_per_block(spark, sf_dir):
    hits = studies.top_hit_per_block(_hits(spark, sf_dir), 300.0, 20)
    return hits.select("chrom", "fgeneid", "block", "pos", "l_orderkey", F.round("abs_t", 6).alias("abs_t"))


def _bh_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, 1 / (1 + l_extendedprice) AS p FROM lineitem),
r AS (SELECT *, row_number() OVER ({part} ORDER BY p, l_orderkey, l_linenumber, l_partkey) AS rn, count(*) OVER ({part}) AS n FROM p),
a AS (SELECT *, least(1, min(p * n / rn) OVER ({part} ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, round(q, 10) AS q FROM a"""


def _bh(spark, sf_dir, by):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (1 / (1 + F.col("l_extendedprice"))).alias("p"))
    return _rounded(relational.adjusted_p(rows, "p", "q", by).drop("p"), {"q": 10})


@register(_bh_sql(""))
def bh_adjust(spark, sf_dir):
    return _bh(spark, sf_dir, [])


@register(_bh_sql("l_returnflag"))
def bh_adjust_by_group(spark, sf_dir):
    return _bh(spark, sf_dir, ["l_returnflag"])


@register("""
SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':1'), c_custkey) AS r FROM customer) WHERE r <= 5""")
def strata_sample(spark, sf_dir):
    return relational.strata_sample(_t(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", 5).select("c_custkey", "c_nationkey")


@register("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def keep_first(spark, sf_dir):
    return relational.keep_first(_t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"), "event_type")
    genes = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("gene"), F.col("pos").alias("start"), (F.col("pos") + 3600).alias("end"))
    return events.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("snp"), "pos"), genes


_SPANS = """
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type FROM events),
g AS (SELECT user_id, event_id AS gene, pos AS s, pos + 3600 AS t FROM e WHERE event_type = 'purchase'),
p AS (SELECT user_id, event_id AS snp, pos FROM e WHERE event_type <> 'purchase')
"""


@register(_SPANS + "SELECT g.user_id, gene, snp FROM g JOIN p ON g.user_id = p.user_id AND pos BETWEEN s - 7200 AND t + 7200")
def cis_window_join(spark, sf_dir):
    snps, genes = _spans(spark, sf_dir)
    return relational.interval_join(snps, genes, "user_id", "pos", "start", "end", 7200, bucket=20_000).select("user_id", "gene", "snp")


@register(_SPANS + "SELECT g.user_id, gene, snp, (pos > s AND pos < t) OR abs(pos - s) < 3600 OR abs(pos - t) < 3600 AS is_cis FROM g JOIN p ON g.user_id = p.user_id AND pos > s - 7200 AND pos < t + 7200")
def cis_flagged_pairs(spark, sf_dir):
    snps, genes = _spans(spark, sf_dir)
    near = relational.interval_join(snps, genes, "user_id", "pos", "start", "end", 7200, inclusive=False, bucket=20_000)
    return near.select("user_id", "gene", "snp", relational.cis_flag(F.col("pos"), F.col("start"), F.col("end"), 3600).alias("is_cis"))


@register("""
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events)
SELECT a.user_id, a.event_id AS event_i, b.event_id AS event_j, b.pos - a.pos AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND (a.pos, a.event_id) < (b.pos, b.event_id) AND b.pos - a.pos <= 1800""")
def band_pairs(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    pairs = relational.band_join(events, "user_id", "pos", "event_id", 1800)
    return pairs.select(F.col("user_id_i").alias("user_id"), F.col("event_id_i").alias("event_i"), F.col("event_id_j").alias("event_j"), (F.col("pos_j") - F.col("pos_i")).alias("gap"))


def _moments_sql(first: str, second: str) -> str:
    return f"""
m AS (
  SELECT i, j, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy
  FROM (SELECT i, j, CAST(embedding[i] AS DOUBLE) AS x, CAST(embedding[j] AS DOUBLE) AS y FROM embeddings, range({first}) a(i), range({second}) b(j) WHERE i <= j AND embedding IS NOT NULL) GROUP BY 1, 2),
r AS (SELECT *, sxy / sxx AS slope, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM m),
t AS (SELECT *, CASE WHEN 1 - r * r > 0 THEN sqrt(n - 2) * r / sqrt(1 - r * r) END AS t FROM r),
cov AS (SELECT i, j, (sxy - sx * sy / n) / (n - 1) AS value FROM m)"""


def _moments(spark, sf_dir) -> DataFrame:
    return matrix.cross_moments(_t(spark, sf_dir, "embeddings"), "embedding")


@register(f"WITH {_moments_sql('1, 33', '33, 65')} SELECT i, j, n, round(slope, 6) AS slope, round(r, 6) AS r, round(t, 4) AS t FROM t")
def pair_scan(spark, sf_dir):
    scan = matrix.moments_to_scan(_moments(spark, sf_dir).filter("i <= 32 and j > 32"))
    return _rounded(scan.select("i", "j", "n", "slope", "r", "t"), {"slope": 6, "r": 6, "t": 4})


@register(f"WITH {_moments_sql('1, 33', '33, 65')} SELECT i, count(*) AS n_pairs, round(avg(CASE WHEN abs(t) > 1.5 THEN 1.0 ELSE 0.0 END), 6) AS share FROM t GROUP BY 1")
def pair_significance_share(spark, sf_dir):
    scan = matrix.moments_to_scan(_moments(spark, sf_dir).filter("i <= 32 and j > 32"))
    return _rounded(matrix.significance_share(scan, "i", 1.5), {"share": 6})


def _features(spark, sf_dir) -> DataFrame:
    """embeddings as a matrix table: a row is a feature, a position an individual."""
    return _t(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("feature_id"), F.col("embedding").cast("array<double>").alias("values"))


_LONG = "(SELECT vec_id AS feature_id, unnest(range(0, len(embedding))) AS ind, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@register(f"SELECT feature_id, ind, round(v - avg(v) OVER (PARTITION BY feature_id), 6) AS value FROM {_LONG}")
def residualise_on_mean(spark, sf_dir):
    rows = matrix.residualise_on_mean(_features(spark, sf_dir))
    return rows.select("feature_id", F.posexplode("values").alias("ind", "value")).select("feature_id", F.col("ind").cast("long").alias("ind"), F.round("value", 6).alias("value"))


@register(f"SELECT feature_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM {_LONG} GROUP BY 1")
def feature_mean_sd(spark, sf_dir):
    return _rounded(matrix.feature_summary(_features(spark, sf_dir)).withColumn("n", F.col("n").cast("long")), {"mean": 6, "sd": 6})


@register(f"SELECT CAST(ind AS BIGINT) AS ind, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM {_LONG} GROUP BY 1")
def individual_mean_sd(spark, sf_dir):
    return _rounded(matrix.individual_summary(_features(spark, sf_dir)).withColumn("ind", F.col("ind").cast("long")), {"mean": 6, "sd": 6})


@register(f"SELECT CAST(ind AS BIGINT) AS ind, round(sum((v - m) * ((feature_id % 7) - 3) / 10), 4) AS score FROM (SELECT *, avg(v) OVER (PARTITION BY feature_id) AS m FROM {_LONG}) GROUP BY 1")
def genetic_score(spark, sf_dir):
    f = _features(spark, sf_dir)
    score = matrix.genetic_score(f, f.select("feature_id", ((F.col("feature_id") % 7 - 3) / 10).alias("beta")))
    return score.select(F.col("ind").cast("long").alias("ind"), F.round("score", 4).alias("score"))


_DOSE = "CASE WHEN v < -0.1 THEN 0.0 WHEN v < 0.1 THEN 1.0 ELSE 2.0 END"


@register(f"""
WITH d AS (SELECT feature_id, ind, {_DOSE} AS g FROM {_LONG}),
s AS (SELECT feature_id, avg(g) AS m, stddev_samp(g) AS sd FROM d GROUP BY 1 HAVING least(avg(g) / 2, 1 - avg(g) / 2) >= 0.01 AND stddev_samp(g) > 0),
z AS (SELECT feature_id, ind, (g - m) / sd AS z FROM d JOIN s USING (feature_id))
SELECT CAST(a.ind AS BIGINT) AS i, CAST(b.ind AS BIGINT) AS j, round(sum(a.z * b.z) / (SELECT count(*) FROM s), 6) + 0.0::DOUBLE AS value FROM z a JOIN z b ON a.feature_id = b.feature_id AND a.ind <= b.ind GROUP BY 1, 2""")
def relationship_matrix(spark, sf_dir):
    dose = F.transform("values", lambda v: F.when(v < -0.1, 0.0).when(v < 0.1, 1.0).otherwise(2.0))
    pairs = matrix.relationship_matrix(_features(spark, sf_dir).select(dose.alias("values")))
    return pairs.select("i", "j", (F.round("value", 6) + F.lit(0.0)).alias("value"))  # no negative zero


@register(f"WITH {_moments_sql('1, 65', '1, 65')} SELECT i, j, round(value, 7) AS value FROM cov")
def covariance_pairs(spark, sf_dir):
    return _rounded(matrix.moments_to_covariance(_moments(spark, sf_dir)), {"value": 7})


@register(f"WITH {_moments_sql('1, 65', '1, 65')} SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE round(r, 6) END AS value FROM r")
def covariance_to_correlation(spark, sf_dir):
    return _rounded(matrix.covariance_to_correlation(matrix.moments_to_covariance(_moments(spark, sf_dir))), {"value": 6})


def _ld(spark, sf_dir) -> DataFrame:
    cov = matrix.moments_to_covariance(_moments(spark, sf_dir))
    positions = spark.range(1, 65).select("id", (F.col("id") * 0.3).alias("map"))
    return ld.ld_from_covariance(cov, positions)


_TH = c.panel_theta(ld.PANEL)
_LD_SQL = f"""
WITH {_moments_sql('1, 65', '1, 65')},
s AS (SELECT i, j, CASE WHEN i = j THEN {(1 - _TH) ** 2!r} * value + {0.5 * _TH * (1 - 0.5 * _TH)!r} ELSE {(1 - _TH) ** 2!r} * value * exp(-abs(0.3 * j - 0.3 * i) * {4 * ld.POPULATION / 100 / (2 * ld.PANEL)!r}) END AS v, exp(-abs(0.3 * j - 0.3 * i) * {4 * ld.POPULATION / 100 / (2 * ld.PANEL)!r}) AS decay FROM cov),
ld AS (SELECT s.i, s.j, CASE WHEN s.i = s.j THEN 1.0 ELSE s.v / sqrt(a.v * b.v) END AS r FROM s JOIN s a ON a.i = s.i AND a.j = s.i JOIN s b ON b.i = s.j AND b.j = s.j WHERE s.decay >= 0.001)
"""


@register(_LD_SQL + "SELECT i, j, round(r, 7) AS r FROM ld")
def ld_pairs(spark, sf_dir):
    return _rounded(_ld(spark, sf_dir), {"r": 7})


@register(_LD_SQL + "SELECT i AS src, j AS dst, round(r, 7) AS weight FROM ld WHERE i < j AND r * r > 0.0001")
def ld_edges(spark, sf_dir):
    return _rounded(ld.ld_edges(_ld(spark, sf_dir), 0.01), {"weight": 7})


_B, _S = "(l_discount - 0.05)", "(0.01 + l_tax)"


def _mu_sql(pi: str, slab: str) -> str:
    log = lambda v: f"(-{_B} * {_B} / (2 * ({v})) - ln({v}) / 2 - {0.9189385332046727})"
    return f"(1 / (1 + exp(least(ln((1 - {pi}) / {pi}) + {log(f'{_S} * {_S}')} - {log(f'{slab} + {_S} * {_S}')}, 700.0))))"


_EM = ["WITH s0 AS (SELECT DISTINCT l_linenumber AS chrom, CAST(0.3 AS DOUBLE) AS pi, CAST(0.01 AS DOUBLE) AS slab FROM lineitem)"]
for _k in (1, 2):
    _mu = _mu_sql("pi", "slab")
    _EM.append(f"s{_k} AS (SELECT chrom, avg(mu) AS pi, greatest(sum(mu * ({_B} * {_B} - {_S} * {_S})) / sum(mu), 1e-12) AS slab FROM (SELECT chrom, l_discount, l_tax, {_mu} AS mu FROM lineitem JOIN s{_k - 1} ON l_linenumber = chrom) GROUP BY 1)")


def _effects(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("chrom"), (F.col("l_discount") - 0.05).alias("beta"), (0.01 + F.col("l_tax")).alias("se"), "l_orderkey", "l_partkey")


@register(", ".join(_EM) + " SELECT chrom, round(pi, 8) AS pi, round(slab, 8) AS slab FROM s2")
def mixture_em_steps(spark, sf_dir):
    effects = _effects(spark, sf_dir)
    # stored, so that the join knows how small the parameters are and does not deal the effects by chromosome
    params = cut_lineage(effects.select("chrom").distinct().select("chrom", F.lit(0.3).alias("pi"), F.lit(0.01).alias("slab")))
    for _ in range(2):
        params = cut_lineage(mixture.em_step(effects, params, "chrom").select("chrom", "pi", "slab"))
    return _rounded(params, {"pi": 8, "slab": 8})


@register(f"SELECT l_orderkey, l_partkey, l_linenumber AS chrom, round({_mu_sql('0.3', '0.01')}, 6) AS mu FROM lineitem")
def inclusion_probability(spark, sf_dir):
    mu = mixture.inclusion_probability(F.col("beta"), F.col("se"), F.lit(0.3), F.lit(0.01))
    return _effects(spark, sf_dir).select("l_orderkey", "l_partkey", "chrom", F.round(mu, 6).alias("mu"))


_LOGD = lambda v: f"(-{_B} * {_B} / (2 * ({v})) - ln({v}) / 2 - {0.9189385332046727})"
_MU_G = _mu_sql("pi", "tau")


@register(f"""
WITH g(pi, tau) AS (VALUES (0.1::DOUBLE, 0.01::DOUBLE), (0.1, 0.001), (0.5, 0.01), (0.5, 0.001)),
r AS (SELECT pi, tau, l_discount, l_tax, {_MU_G} AS mu FROM lineitem, g)
SELECT pi, tau, round(-sum(mu * ({_LOGD(f'tau + {_S} * {_S}')} + ln(pi)) + (1 - mu) * ({_LOGD(f'{_S} * {_S}')} + ln(1 - pi))), 2) AS negative_loglik FROM r GROUP BY 1, 2""")
def likelihood_grid(spark, sf_dir):
    return _rounded(mixture.likelihood_grid(_effects(spark, sf_dir), [(p, t) for p in (0.1, 0.5) for t in (0.01, 0.001)]), {"negative_loglik": 2})


@register(f"""
WITH j AS (SELECT a.fgeneid, a.theta AS ta, b.theta AS tb, b.serr AS sb FROM {HITS} a JOIN {HITS} b ON a.fgeneid = b.fgeneid AND a.pos = b.pos WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'),
k AS (SELECT fgeneid, count(*) AS pairs, sum(ta / (sb * sb)) / sum(1 / (sb * sb)) AS mx, sum(tb / (sb * sb)) / sum(1 / (sb * sb)) AS my FROM j GROUP BY 1 HAVING count(*) > 4)
SELECT fgeneid, any_value(pairs) AS pairs, round(sum((ta - mx) * (tb - my) / (sb * sb)) / sum((ta - mx) * (ta - mx) / (sb * sb)), 5) AS slope FROM j JOIN k USING (fgeneid) GROUP BY 1""")
def replication(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("fgeneid", "pos", "theta", "serr", "l_returnflag", (F.col("theta") > 25).alias("cis"))
    a, b = (hits.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AR")
    return studies.replication(a, b, ["fgeneid", "pos"], "fgeneid", "cis", ("_a", "_b")).select("fgeneid", "pairs", F.round("slope", 5).alias("slope"))


@register("SELECT o_custkey AS k FROM (SELECT o_custkey FROM orders INTERSECT ALL (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer))")
def multiset_intersect(spark, sf_dir):
    cust = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return relational.multiset_intersect(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), cust.union(cust), "k")


@register("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def set_intersect(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@register("SELECT p_partkey, CAST(ntile(7) OVER (ORDER BY p_partkey) AS BIGINT) AS chunk_id FROM part")
def chunks(spark, sf_dir):
    return relational.chunks(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey", count=7)


@register("SELECT p_partkey, CAST(floor((p_partkey - 1) / 64) + 1 AS BIGINT) AS tile FROM part")
def tiles(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", relational.tile_number(F.col("p_partkey"), 64).alias("tile"))


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@register("SELECT c_custkey, round(coalesce(v, 0), 2) AS v FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_join_fill(spark, sf_dir):
    most = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return _rounded(relational.left_join_fill(_t(spark, sf_dir, "customer").select("c_custkey"), most, ["c_custkey"], {"v": 0.0}), {"v": 2})


@register("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@register("SELECT n_nationkey, r_regionkey AS chunk FROM nation CROSS JOIN region")
def parameter_grid(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(_t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("chunk"))))


@register("""
WITH v AS (SELECT p_partkey, CASE WHEN p_size % 24 = 23 THEN 'X' WHEN p_size % 24 = 22 THEN 'Y' ELSE CAST(p_size % 24 + 1 AS VARCHAR) END AS ch, chr(CAST(65 + p_partkey % 4 AS INT)) AS ref, chr(CAST(65 + p_size % 4 AS INT)) AS alt, p_retailprice AS w, p_name FROM part)
SELECT p_partkey, CAST(p_partkey AS INT) AS gene_number, 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS gene_id, CAST(CASE WHEN ch = 'X' THEN 23 ELSE TRY_CAST(ch AS INT) END AS VARCHAR) AS chrom, CAST(p_partkey AS INT) AS pos, ref, alt,
  CAST(ref < alt AS INT) AS flip, round(CASE WHEN ref < alt THEN -w ELSE w END, 2) AS weight, round(CASE WHEN ref < alt THEN ln(1 / w) ELSE ln(w) END, 8) AS log_effect, len(p_name) - len(replace(p_name, 'e', '')) AS n_e, 'chr' || ch || '_' || p_partkey AS locus FROM v""")
def identifier_functions(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    ch = F.when(F.col("p_size") % 24 == 23, "X").when(F.col("p_size") % 24 == 22, "Y").otherwise((F.col("p_size") % 24 + 1).cast("string"))
    letter = lambda x: F.chr(F.lit(65) + x % 4)
    v = p.select("p_partkey", "p_retailprice", "p_name", ch.alias("ch"), F.concat_ws("_", ch, F.col("p_partkey").cast("string"), letter(F.col("p_partkey")), letter(F.col("p_size")), F.lit("b37")).alias("id"), F.printf(F.lit("ENSG%011d.4"), "p_partkey").alias("g"))
    ref, alt = c.variant_part(F.col("id"), "ref"), c.variant_part(F.col("id"), "alt")
    flip = c.flip_flag(ref, alt)
    return v.select(
        "p_partkey", c.gene_number(F.col("g")).alias("gene_number"), c.gene_id(c.gene_number(F.col("g"))).alias("gene_id"), c.chromosome(c.variant_part(F.col("id"), "chrom")).cast("string").alias("chrom"), c.variant_part(F.col("id"), "pos").alias("pos"), ref.alias("ref"), alt.alias("alt"), flip.alias("flip"),
        F.round(c.flip_effect(F.col("p_retailprice"), flip), 2).alias("weight"), F.round(c.log_effect(F.col("p_retailprice"), ref, alt), 8).alias("log_effect"), c.symbol_count(F.col("p_name"), "e").cast("long").alias("n_e"), c.locus_name(F.col("ch"), F.col("p_partkey")).alias("locus"),
    )


@register("""
WITH p AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(corr(a, r), 6) AS r FROM p WHERE a IS NOT NULL AND r IS NOT NULL""")
def pivot_complete_corr(spark, sf_dir):
    wide = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_quantity")).dropna(subset=["A", "R"])
    return wide.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("A", "R"), 6).alias("r"))


@register("SELECT p_partkey, p_brand, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 8) AS share FROM part")
def percent_rank(spark, sf_dir):
    return _rounded(relational.share_rank(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", "share", ["p_brand"]).drop("p_retailprice"), {"share": 8})


@register("SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS r FROM part")
def average_rank(spark, sf_dir):
    return relational.average_rank(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", "r")


@register("SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 3")
def top_n(spark, sf_dir):
    return relational.top_n(_t(spark, sf_dir, "supplier"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 3).select("s_suppkey", "s_nationkey")


_TRIPLETS = "(SELECT least(l_suppkey, l_linenumber) AS i, greatest(l_suppkey, l_linenumber) AS j, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def _triplets(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.least("l_suppkey", "l_linenumber").alias("i"), F.greatest("l_suppkey", "l_linenumber").alias("j"), F.col("l_quantity").alias("value"))
    return matrix.sum_triplets(rows)


@register(f"SELECT i, j, round(value, 2) AS value FROM {_TRIPLETS} UNION ALL SELECT j, i, round(value, 2) FROM {_TRIPLETS} WHERE i <> j")
def sparse_symmetric(spark, sf_dir):
    return _rounded(matrix.symmetric(matrix.sparsify(_triplets(spark, sf_dir))), {"value": 2})


@register(f"SELECT j, CAST(coalesce(sum(n) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, n FROM (SELECT j, count(*) AS n FROM {_TRIPLETS} GROUP BY 1)")
def sparse_pointers(spark, sf_dir):
    return matrix.column_pointers(_triplets(spark, sf_dir))


@register("""
SELECT label, CAST(width AS BIGINT) AS bin, count(*) AS n FROM (SELECT label, floor((x + 1) / 0.1) + 1 AS width FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) WHERE x >= -1 AND x < 1) GROUP BY 1, 2""")
def histogram_by_group(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return relational.histogram(e, "x", -1.0, 1.0, 20, ["label"])


@register("SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(var_samp(l_quantity), 5) AS var_l_quantity, round(avg(abs(l_quantity)), 6) AS mean_abs_l_quantity FROM lineitem GROUP BY 1")
def group_summary(spark, sf_dir):
    return _rounded(regress.group_summary(_t(spark, sf_dir, "lineitem"), "l_suppkey", ["l_quantity"]), {"mean_l_quantity": 6, "var_l_quantity": 5, "mean_abs_l_quantity": 6})


@register("SELECT l_orderkey, l_linenumber, l_suppkey, round((l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w, 6) AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def standardise(spark, sf_dir):
    return _rounded(relational.standardise(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "z").select("l_orderkey", "l_linenumber", "l_suppkey", "z"), {"z": 6})


@register("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN '1' WHEN p_size > 10 AND p_size <= 25 THEN '2' WHEN p_size > 25 AND p_size <= 40 THEN '3' END AS bin FROM part")
def binned(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", c.cut_right(F.col("p_size"), [0, 10, 25, 40]).cast("string").alias("bin"))


@register("WITH d AS (SELECT o_totalprice - 150000 AS d FROM orders) SELECT count(*) AS n, round(avg(d), 3) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d")
def paired_t(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("base", F.lit(150_000.0))
    return _rounded(regress.paired_t(o, "o_totalprice", "base").select("n", "mean_difference", "t"), {"mean_difference": 3, "t": 6})


@register("SELECT l_suppkey AS gene, count(*) AS ntot, count(*) FILTER (p < 0.2) AS nsig, round(avg(CASE WHEN p < 0.2 THEN 1.0 ELSE 0.0 END), 8) AS psig, round(abs(0.5 - median(p)), 8) AS median_gap, round(abs(1.0 / 12 - var_samp(p)), 8) AS variance_gap FROM (SELECT l_suppkey, l_discount * 10 AS p FROM lineitem) GROUP BY 1")
def candidate_ranking(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), (F.col("l_discount") * 10).alias("p"))
    return _rounded(studies.candidate_ranking(p, cutoff=0.2), {"psig": 8, "median_gap": 8, "variance_gap": 8})


@register(f"""
WITH a AS (SELECT fgeneid, count(*) AS n_all, sum(theta * beta / serr) / sum(theta * theta / serr) AS slope_all FROM {HITS} GROUP BY 1),
b AS (SELECT fgeneid, count(*) AS n_independent, sum(theta * beta / serr) / sum(theta * theta / serr) AS slope_independent FROM {HITS} WHERE pos IN (SELECT p_partkey FROM part WHERE p_size <= 20) GROUP BY 1)
SELECT fgeneid, n_all, round(slope_all, 4) AS slope_all, n_independent, round(slope_independent, 4) AS slope_independent FROM a JOIN b USING (fgeneid)""")
def restricted_refit(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    fit = studies.restricted_refit(hits, _t(spark, sf_dir, "part").filter("p_size <= 20").select(F.col("p_partkey").alias("pos")), ["pos"], "fgeneid", F.col("beta"), F.col("theta"), 1 / F.col("serr"))
    return _rounded(fit.select("fgeneid", "n_all", "slope_all", "n_independent", "slope_independent"), {"slope_all": 4, "slope_independent": 4})


@register("SELECT count(*) AS n, round(corr(a.l_quantity, b.l_quantity), 6) AS r, round(avg(abs(a.l_quantity - b.l_quantity)), 6) AS mean_abs_difference FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def weight_agreement(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").alias("weight"), "l_returnflag")
    a, b = (rows.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AR")
    return _rounded(studies.weight_agreement(a, b, ["l_suppkey", "l_partkey"]), {"r": 6, "mean_abs_difference": 6})


@register("SELECT l_suppkey, count(*) AS n, CAST(count(*) FILTER (l_discount <> 0) AS BIGINT) AS nonzero, round(avg(CASE WHEN l_discount <> 0 THEN 1.0 ELSE 0.0 END), 8) AS share FROM lineitem GROUP BY 1")
def nonzero_share(spark, sf_dir):
    return _rounded(regress.nonzero_share(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount"), {"share": 8})


@register("SELECT vec_id, len(list_filter(embedding, lambda x: round(CAST(x AS DOUBLE), 1) <> CAST(x AS DOUBLE))) = 0 AS categorical FROM embeddings")
def categorical_covariates(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", c.categorical(F.col("embedding").cast("array<double>")).alias("categorical"))


@register("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def linear_trend(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@register("SELECT l_suppkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def nest_unnest(spark, sf_dir):
    rows = relational.nest(_t(spark, sf_dir, "lineitem"), "l_suppkey", ["l_linenumber", "l_quantity", "l_discount"])
    return relational.unnest(rows, "l_suppkey")


@register("SELECT fgeneid, pos, theta, CASE WHEN cis THEN serr END AS serr, cis AS is_cis FROM (SELECT *, l_returnflag = 'A' AS cis FROM " + HITS + ")")
def merged_cis_trans(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    cis, trans = hits.filter("l_returnflag = 'A'").select("fgeneid", "pos", "theta", "serr"), hits.filter("l_returnflag <> 'A'").select("fgeneid", "pos", "theta")
    return studies.merged_cis_trans(cis, trans)


@register("""
WITH n AS (SELECT l_suppkey, 1 / sum(1 / (1000 * (power(0.01 + l_tax, 2) + power(l_discount - 0.05, 2) / 1000))) AS i FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(1 / i, 4) AS nsum, round(sqrt(0.5 / (0.1 / i)), 8) AS slab_sd FROM n""")
def effect_scale(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") - 0.05).alias("beta"), (0.01 + F.col("l_tax")).alias("se"))
    return _rounded(mixture.effect_scale(e, "l_suppkey", 1000.0, 0.5, 0.1), {"nsum": 4, "slab_sd": 8})
