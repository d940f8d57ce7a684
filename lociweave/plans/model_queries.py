"""Registered queries of the elastic-net paths, principal components, LD pruning, harmonised
matrices and distributions, with their SQL.

Stand-ins as in ``queries`` and ``scan_queries``.  For the elastic nets each of the 64 positions of
``embeddings`` is a gene, the positions up to eight places away are its cis variants, and
rows are individuals in ten folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage, scratch_dir
from lociweave.functions.tdist import t_critical, t_quantile
from lociweave.operators import ld, matrix, mixture, regress
from lociweave.operators.ordered import row_numbers
from lociweave.plans import studies
from lociweave.plans.queries import _LONG, _TRIPLETS, _features, _moments_sql, _mu_sql, _rounded, _t, _triplets, register
from lociweave.plans.scan_queries import _LINKED, _SCAN, _kind, _legend

# ---------------------------------------------------------------- elastic-net paths

ALPHA, STEPS, RATIO, REACH = 0.95, 40, 0.01, 8


def elastic_net_fits(spark, sf_dir) -> DataFrame:
    """The path of each position on the positions near it, over all rows."""
    moments = matrix.cross_moments(_t(spark, sf_dir, "embeddings"), "embedding", F.pmod("vec_id", F.lit(10)))
    genes = spark.range(1, 65).select(F.col("id").alias("gene"))
    sets = genes.select("gene", F.explode(F.sequence(F.greatest(F.col("gene") - REACH, F.lit(1)), F.least(F.col("gene") + REACH, F.lit(64)))).alias("snp"))
    return regress.elastic_nets(cut_lineage(moments), sets, ALPHA, STEPS, RATIO)


_SYMMETRIC = """
e AS (SELECT i AS p, sqrt(value * (n - 1) / n) AS sd FROM cov JOIN m USING (i, j) WHERE i = j),
rr AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE r END AS r FROM r UNION ALL SELECT j, i, r FROM r WHERE i <> j),
big AS (SELECT list(own ORDER BY i) AS g FROM (SELECT i, list(r ORDER BY j) AS own FROM rr GROUP BY i)),
sds AS (SELECT list(sd ORDER BY p) AS s FROM e)"""
# proximal gradient steps of every gene and lambda at once: another way to the same optimum
_WEIGHTS_SQL = f"""
WITH RECURSIVE {_moments_sql('1, 65', '1, 65')}, {_SYMMETRIC},
f AS (SELECT gene, list_filter(range(greatest(gene - {REACH}, 1), least(gene + {REACH}, 64) + 1), lambda p: p <> gene) AS ps FROM range(1, 65) t(gene)),
q AS (SELECT gene, ps, s, list_transform(ps, lambda a: list_transform(ps, lambda b: g[a][b])) AS gram, list_transform(ps, lambda a: g[a][gene] * s[gene]) AS xy FROM f, big, sds),
k AS (SELECT q.*, step, list_max(list_transform(xy, lambda x: abs(x))) / {ALPHA} * power(10.0, log10({RATIO}) * (step - 1) / {STEPS - 1}) AS lam FROM q, range(1, {STEPS + 1}) t(step)),
w(turn, gene, step, b) AS (
  SELECT 0, gene, step, list_transform(ps, lambda p: 0.0::DOUBLE) FROM k
  UNION ALL
  SELECT turn + 1, w.gene, w.step, list_transform(range(1, len(ps) + 1), lambda i:
    list_transform([b[i] + 0.5 * (xy[i] - list_dot_product(gram[i], b) - lam * {1 - ALPHA} * b[i])], lambda z: sign(z) * greatest(abs(z) - 0.5 * lam * {ALPHA}, 0))[1])
  FROM w JOIN k ON k.gene = w.gene AND k.step = w.step WHERE turn < 120),
o AS (SELECT k.gene, k.step, lam, unnest(ps) AS snp, unnest(list_transform(range(1, len(ps) + 1), lambda i: b[i] / s[ps[i]])) AS weight FROM w JOIN k ON k.gene = w.gene AND k.step = w.step WHERE turn = 120)
"""


@register(_WEIGHTS_SQL + "SELECT gene, CAST(step AS INT) AS step, round(lam, 7) AS lambda, snp, round(weight, 6) AS weight FROM o WHERE round(weight, 6) <> 0")
def elastic_net_weights(spark, sf_dir):
    """Weights at every lambda of every gene's path."""
    return _rounded(regress.path_weights(elastic_net_fits(spark, sf_dir)), {"lambda": 7, "weight": 6}).filter("weight <> 0")


@register(_WEIGHTS_SQL + ", n AS (SELECT gene, step, any_value(lam) AS lam, count(*) FILTER (abs(weight) > 1e-9) AS nzero FROM o GROUP BY 1, 2) SELECT gene, CAST(step AS INT) AS step, round(lam, 7) AS lambda, CAST(nzero AS BIGINT) AS nzero FROM n")
def elastic_net_path_sizes(spark, sf_dir):
    """Lambda and number of weights at every step of every gene's path."""
    return _rounded(regress.path_overall(elastic_net_fits(spark, sf_dir)).select("gene", "step", "lambda", "nzero"), {"lambda": 7})


@register()
def elastic_net_overall(spark, sf_dir):
    """The cross-validated path, with each gene's choices of lambda."""
    fits = cut_lineage(elastic_net_fits(spark, sf_dir))
    return regress.path_overall(fits).join(regress.path_choices(fits), "gene")


# ---------------------------------------------------------------- principal components


def _components_sql(n: int, last: str) -> str:
    """Principal components by repeated squaring and deflation of the Gram matrix."""
    out = f"""
WITH RECURSIVE d AS (SELECT feature_id, ind + 1 AS p, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z FROM {_LONG} WINDOW w AS (PARTITION BY feature_id)),
zs AS (SELECT feature_id, list(z ORDER BY p) AS z FROM d GROUP BY 1),
g1 AS (SELECT list(own ORDER BY i) AS g FROM (SELECT i, list(v ORDER BY j) AS own FROM (SELECT a.p AS i, b.p AS j, sum(a.z * b.z) AS v FROM d a JOIN d b USING (feature_id) GROUP BY 1, 2) GROUP BY i))"""
    scaled = "list_transform({m}, lambda x: list_transform(x, lambda y: y / list_sum(list_transform(range(1, len({m}) + 1), lambda i: {m}[i][i]))))"
    for c in range(1, n + 1):
        out += f""",
s{c}(turn, p) AS (
  SELECT 0, {scaled.format(m='g')} FROM g{c}
  UNION ALL
  SELECT turn + 1, {scaled.format(m='q')} FROM (SELECT turn, list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, b))) AS q FROM s{c} WHERE turn < 26)),
c{c} AS (SELECT {c} AS component, p, list_sum(list_transform(range(1, len(g) + 1), lambda i: list_dot_product(g[i], p[i]))) AS value, g FROM s{c}, g{c} WHERE turn = 26),
g{c + 1} AS (SELECT list_transform(range(1, len(g) + 1), lambda i: list_transform(range(1, len(g) + 1), lambda j: g[i][j] - value * p[i][j])) AS g FROM c{c})"""
    return out + ", c AS (" + " UNION ALL ".join(f"SELECT component, p, value FROM c{c}" for c in range(1, n + 1)) + ")" + last


@register(_components_sql(3, " SELECT CAST(component AS INT) AS component, CAST(i - 1 AS BIGINT) AS ind, round(value / (len(p) - 1), 6) AS variance, round(value * p[i][i], 6) AS squared FROM c, range(1, 65) t(i)"))
def component_scores(spark, sf_dir):
    """Variance and squared scores of each of the first three principal components."""
    variances, scores, _ = matrix.principal_components(_features(spark, sf_dir), 3)
    shares = spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(variances)], "component int, variance double")
    return scores.join(shares, "component").select("component", "ind", F.round("variance", 6).alias("variance"), F.round(F.col("score") * F.col("score"), 6).alias("squared"))


@register(_components_sql(3, " SELECT CAST(component AS INT) AS component, feature_id, round(list_dot_product(z, list_transform(p, lambda x: list_dot_product(x, z))) / value, 8) AS squared FROM c, zs"))
def component_loadings(spark, sf_dir):
    """Squared loadings of every feature on each of the first three principal components."""
    _, _, loadings = matrix.principal_components(_features(spark, sf_dir), 3)
    return loadings.select("component", "feature_id", F.round(F.col("loading") * F.col("loading"), 8).alias("squared"))


# ---------------------------------------------------------------- LD pruning

WINDOW, CUT = 60_000, 0.15
_UNIT = f"(SELECT feature_id, ind, d / sqrt(sum(d * d) OVER (PARTITION BY feature_id)) AS u FROM (SELECT feature_id, ind, v - avg(v) OVER (PARTITION BY feature_id) AS d FROM {_LONG}))"
# rounds in which a vertex stays once all earlier linked ones have gone, and goes once one stays
_ROUNDS = """
w(round, v, stays) AS (
  SELECT 0, v, CAST(NULL AS BOOLEAN) FROM all_v
  UNION ALL
  SELECT w.round + 1, w.v, CASE WHEN w.stays IS NOT NULL THEN w.stays WHEN n.kept > 0 THEN false WHEN coalesce(n.waits, 0) = 0 THEN true END
  FROM w LEFT JOIN (SELECT l.a, count(*) FILTER (c.stays) AS kept, count(*) FILTER (c.stays IS NULL) AS waits FROM l JOIN w c ON c.v = l.b GROUP BY l.a) n ON n.a = w.v
  WHERE EXISTS (SELECT 1 FROM w x WHERE x.stays IS NULL)),
stay AS (SELECT v FROM w WHERE stays AND round = (SELECT max(round) FROM w))"""


@register(f"""
WITH RECURSIVE all_v AS (SELECT vec_id AS v, label, vec_id * 1000 AS pos FROM embeddings),
l AS (SELECT a.v AS a, b.v AS b FROM all_v a JOIN all_v b ON a.label = b.label AND b.v < a.v AND a.pos - b.pos <= {WINDOW} JOIN {_UNIT} x ON x.feature_id = a.v JOIN {_UNIT} y ON y.feature_id = b.v AND y.ind = x.ind GROUP BY 1, 2 HAVING abs(sum(x.u * y.u)) > {CUT}),
{_ROUNDS}
SELECT v AS feature_id, label AS chrom, v * 1000 AS pos FROM stay JOIN all_v USING (v)""")
def window_pruned_variants(spark, sf_dir):
    """Variants that a greedy scan in the order of position keeps."""
    rows = _t(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("feature_id"), F.col("label").alias("chrom"), (F.col("vec_id") * 1000).alias("pos"), F.col("embedding").cast("array<double>").alias("values"))
    return ld.ld_prune(rows, WINDOW, CUT).select("feature_id", "chrom", "pos")


CIS_P, TRANS_P, CIS_CUT, TRANS_CUT, LD_REACH = 0.1, 0.02, 0.1, 0.15, 150_000


@register(f"""
WITH RECURSIVE {_SCAN},
h AS (
  SELECT row_number() OVER (ORDER BY abs(t) DESC, snp, gene) AS v, t.*, a.label AS chrom, a.label = b.label AND abs(snp * 1000 - gene * 1000) < 30000 AS is_cis
  FROM t JOIN {_LINKED} a ON a.feature_id = snp JOIN {_LINKED} b ON b.feature_id = gene WHERE t IS NOT NULL),
all_v AS (SELECT v, gene, snp, chrom, is_cis FROM h WHERE abs(t) > CASE WHEN is_cis THEN {t_critical(CIS_P, 63)!r} ELSE {t_critical(TRANS_P, 63)!r} END),
near AS (SELECT a.v AS a, b.v AS b, a.is_cis, least(a.snp, b.snp) AS i, greatest(a.snp, b.snp) AS j FROM all_v a JOIN all_v b ON a.gene = b.gene AND a.is_cis = b.is_cis AND a.chrom = b.chrom AND b.v < a.v AND abs(a.snp - b.snp) * 1000 <= {LD_REACH}),
c AS (SELECT i, j, sum(x.u * y.u) AS r FROM (SELECT DISTINCT i, j FROM near) JOIN {_UNIT} x ON x.feature_id = i JOIN {_UNIT} y ON y.feature_id = j AND y.ind = x.ind GROUP BY 1, 2),
l AS (SELECT a, b FROM near JOIN c USING (i, j) WHERE abs(r) > CASE WHEN is_cis THEN {CIS_CUT} ELSE {TRANS_CUT} END),
{_ROUNDS}
SELECT gene, snp AS feature_id, chrom, is_cis FROM stay JOIN all_v USING (v)""")
def ld_pruned_hits(spark, sf_dir):
    """Hits of each gene and class that LD pruning in the order of p keeps."""
    variants = _kind(spark, sf_dir, 0).join(_legend(spark, sf_dir, 0), "feature_id")
    genes = _kind(spark, sf_dir, 1).join(_legend(spark, sf_dir, 1), "feature_id")
    kept = ld.pruned_scan(variants, genes, t_critical(CIS_P, 63), t_critical(TRANS_P, 63), CIS_CUT, TRANS_CUT, LD_REACH, 30_000)
    return kept.select("gene", "feature_id", "chrom", "is_cis")


# ---------------------------------------------------------------- matrices and legends


@register(f"SELECT i, j, round(value, 2) AS value FROM {_TRIPLETS} UNION ALL SELECT j, i, round(value, 2) FROM {_TRIPLETS} WHERE i <> j")
def compressed_columns_read(spark, sf_dir):
    """A symmetric matrix from its upper half in column-compressed order: row indexes and pointers."""
    upper = cut_lineage(_triplets(spark, sf_dir))
    entries = row_numbers(upper, ["j", "i"], "at").select((F.col("at") - 1).alias("at"), "i", "value")
    return _rounded(matrix.from_column_pointers(entries, matrix.column_pointers(upper), symmetric_half=True), {"value": 2})


@register(f"""
WITH {_SCAN}, k AS (SELECT *, CASE WHEN abs(t) > 2.0 THEN 1.0 ELSE 0.0 END AS hit FROM t)
SELECT feature_id, label AS chrom, round(share, 6) AS share FROM (SELECT snp AS feature_id, avg(hit) AS share FROM k GROUP BY 1 UNION ALL SELECT gene, avg(hit) FROM k GROUP BY 1) JOIN {_LINKED} USING (feature_id)""")
def scan_legend_shares(spark, sf_dir):
    """Both legends of a scan with each feature's share of significant pairs."""
    snps, genes = matrix.scan_legends_of(_kind(spark, sf_dir, 0), _kind(spark, sf_dir, 1), _legend(spark, sf_dir, 0), _legend(spark, sf_dir, 1), 2.0)
    both = snps.select("feature_id", "chrom", F.col("sig_genes").alias("share")).unionByName(genes.select("feature_id", "chrom", F.col("sig_snps").alias("share")))
    return _rounded(both, {"share": 6})


@register(f"""
WITH k AS (SELECT vec_id, label AS chrom, row_number() OVER (ORDER BY label, vec_id) AS feature_id FROM embeddings JOIN part ON p_partkey = vec_id),
v AS (SELECT k.*, l.v, CASE WHEN l.v > 0 THEN 1.0 ELSE 0.0 END AS h, CASE WHEN l.v < -0.1 THEN 0.0 WHEN l.v < 0.1 THEN 1.0 ELSE 2.0 END AS g, ind FROM k JOIN {_LONG} l ON l.feature_id = vec_id)
SELECT 'haplotypes' AS kind, chrom, feature_id, sum((ind + 1) * CASE WHEN vec_id % 2 = 1 THEN 1 - h ELSE h END) AS total FROM v GROUP BY 2, 3
UNION ALL SELECT 'genotypes', chrom, feature_id, sum((ind + 1) * CASE WHEN vec_id % 3 = 0 THEN 2 - g ELSE g END) FROM v GROUP BY 2, 3
UNION ALL SELECT 'legend', chrom, feature_id, CAST(vec_id AS DOUBLE) FROM k""")
def harmonised_matrices(spark, sf_dir):
    """The variants of three tables, written as aligned legend, flipped panel haplotypes and flipped
    study genotypes by chromosome, and read back."""
    e = _t(spark, sf_dir, "embeddings").filter("embedding is not null")
    own = e.select(F.col("label").alias("chrom"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("feature_id"), "vec_id")
    panel = own.select("chrom", "pos", F.col("vec_id").alias("rsid"), F.lit(0.0).alias("map"), "feature_id", (F.col("vec_id") % 2).cast("int").alias("doFlip"))
    study = own.select("chrom", "pos", "feature_id", (F.col("vec_id") % 3 == 0).cast("int").alias("doFlip"))
    gwas = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("rsid"), F.col("p_retailprice").alias("beta"), F.lit(1.0).alias("serrg"))
    f, path = _features(spark, sf_dir), scratch_dir(spark)
    haplotypes = f.select("feature_id", F.transform("values", lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("values"))
    genotypes = f.select("feature_id", F.transform("values", lambda v: F.when(v < -0.1, 0.0).when(v < 0.1, 1.0).otherwise(2.0)).alias("values"))
    studies.write_harmonised(studies.three_way(gwas, study, panel), haplotypes, genotypes, path)
    total = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    kinds = [spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("kind"), F.col("chrom").cast(dict(own.dtypes)["chrom"]).alias("chrom"), "feature_id", total.alias("total")) for k in ("haplotypes", "genotypes")]
    legend = spark.read.parquet(f"{path}/legend").select(F.lit("legend").alias("kind"), F.col("chrom").cast(dict(own.dtypes)["chrom"]).alias("chrom"), "feature_id", F.col("panel_id").cast("double").alias("total"))
    return kinds[0].unionByName(kinds[1]).unionByName(legend)


# ---------------------------------------------------------------- distributions and mixtures

# P(|T| > t) of an odd number of degrees of freedom: 1 - 2/pi (a + sin a sum_k c_k cos^(2k+1) a), c_k = c_(k-1) 2k / (2k+1)
_TAIL = """
a AS (SELECT i, j, t, atan(abs(t) / sqrt(n - 1)) AS a, CAST((n - 3) / 2 AS BIGINT) AS terms FROM t WHERE i <= 32 AND j > 32),
c AS (SELECT k, exp(sum(CASE WHEN k = 0 THEN 0 ELSE ln(2.0 * k / (2.0 * k + 1)) END) OVER (ORDER BY k)) AS c FROM range(0, (SELECT max(terms) + 1 FROM a)) r(k))
SELECT i, j, round(any_value(t), 7) AS t, round(1 - 2 / pi() * (any_value(a) + sin(any_value(a)) * sum(c * power(cos(a), 2 * k + 1))), 8) AS p FROM a JOIN c ON k <= terms GROUP BY i, j"""


@register(f"WITH {_moments_sql('1, 33', '33, 65')},{_TAIL}")
def scan_tail_probabilities(spark, sf_dir):
    """Two-sided p of the pair scan, by the continued fraction."""
    moments = matrix.cross_moments(_t(spark, sf_dir, "embeddings"), "embedding")
    scan = matrix.moments_to_scan(moments.filter("i <= 32 and j > 32"))
    return _rounded(regress.with_p(scan, (F.col("n") - 1).cast("double")).select("i", "j", "t", "p"), {"t": 7, "p": 8})


@register("""
WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber, (1 + l_quantity) / 52 AS p FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN tan(pi() / 2 * (1 - p)) ELSE (1 - p) * sqrt(2 / (1 - (1 - p) * (1 - p))) END, 6) AS t FROM p""")
def tail_quantiles(spark, sf_dir):
    """The |t| of a two-sided p with one and two degrees of freedom, which have closed forms."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", ((1 + F.col("l_quantity")) / 52).alias("p"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(t_quantile(F.col("p"), (1 + F.col("l_linenumber") % 2).cast("double")), 6).alias("t"))


_S2 = "(0.01 + l_tax) * (0.01 + l_tax)"
_B1 = "(l_discount - 0.05)"


@register(f"""
WITH RECURSIVE d AS (SELECT l_linenumber AS chrom, l_discount, l_tax, count(*) AS c FROM lineitem GROUP BY 1, 2, 3),
s(turn, chrom, pi, slab, gap) AS (
  SELECT 0, chrom, 0.3::DOUBLE, 0.01::DOUBLE, 1.0::DOUBLE FROM d GROUP BY chrom
  UNION ALL
  SELECT turn + 1, chrom, new_pi, new_slab, greatest(abs(new_pi - pi), abs(new_slab - slab)) FROM (
    SELECT any_value(turn) AS turn, chrom, any_value(pi) AS pi, any_value(slab) AS slab, sum(c * mu) / sum(c) AS new_pi, greatest(sum(c * mu * ({_B1} * {_B1} - {_S2})) / sum(c * mu), 1e-12) AS new_slab
    FROM (SELECT d.*, turn, pi, slab, {_mu_sql('pi', 'slab')} AS mu FROM d JOIN s USING (chrom) WHERE (SELECT max(gap) FROM s) >= 1e-9) GROUP BY chrom))
SELECT chrom, round(pi, 6) AS pi, round(slab, 8) AS slab, turn AS steps, true AS converged FROM s WHERE turn = (SELECT max(turn) FROM s)""")
def mixture_fit(spark, sf_dir):
    """The fit of each chromosome, until it settles."""
    effects = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("chrom"), (F.col("l_discount") - 0.05).alias("beta"), (0.01 + F.col("l_tax")).alias("se"))
    fit = mixture.fit_em(effects, "chrom", pi=0.3, slab=0.01, tolerance=1e-9, max_steps=2000)
    return _rounded(fit.select("chrom", "pi", "slab", "steps", "converged"), {"pi": 6, "slab": 8})
