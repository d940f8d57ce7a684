"""More registered queries: joins and filters by name, stores, and whole study plans.

Stand-ins as in ``queries``; parts are panel variants (p_partkey position, p_size map).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lociweave.cluster import scratch_dir
from lociweave.functions import columns as c
from lociweave.operators import matrix, mixture, regress, relational
from lociweave.operators.ordered import row_numbers
from lociweave.plans import studies
from lociweave.plans.queries import _LONG, HITS, _features, _hits, _rounded, _t, register
from lociweave.sources import tables


@register(f"SELECT fgeneid, pos, l_orderkey, chrom FROM {HITS} WHERE abs(theta / serr) > 500")
def significant_rows(spark, sf_dir):
    return relational.significant(_hits(spark, sf_dir), "theta", "serr", 500.0).select("fgeneid", "pos", "l_orderkey", "chrom")


@register(f"SELECT fgeneid, pos, l_orderkey FROM {HITS} WHERE pos IN (SELECT pos FROM {HITS} GROUP BY 1 HAVING count(*) > 35)")
def group_size_gate(spark, sf_dir):
    return relational.group_size_gate(_hits(spark, sf_dir), "pos", 35).select("fgeneid", "pos", "l_orderkey")


@register(f"SELECT fgeneid, pos, l_orderkey, theta FROM (SELECT *, rank() OVER (PARTITION BY fgeneid ORDER BY beta DESC) AS r FROM {HITS}) WHERE r = 1")
def group_minimum(spark, sf_dir):
    return relational.group_minimum(_hits(spark, sf_dir), ["fgeneid"], -F.col("beta")).select("fgeneid", "pos", "l_orderkey", "theta")


@register(f"SELECT feature_id, count(*) AS n FROM {_LONG} GROUP BY 1 HAVING stddev_samp(v) > 0.12")
def varying_features(spark, sf_dir):
    """Features whose standard deviation is known and over a limit."""
    return matrix.feature_summary(_features(spark, sf_dir)).filter("sd > 0.12").select("feature_id", F.col("n").cast("long").alias("n"))


@register("SELECT l_orderkey, l_linenumber, p_brand, o_orderstatus FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size > 45")
def inner_join(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey").join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "p_brand", "o_orderstatus")


@register("SELECT n_nationkey AS nationkey, n_name AS name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def natural_join(spark, sf_dir):
    a = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    return relational.natural_join(a, _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nationkey")))


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counts_by_type(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@register("SELECT l_suppkey, count(*) AS ntot, count(*) FILTER (l_tax < 0.03) AS nsig, round(avg(CASE WHEN l_tax < 0.03 THEN 1.0 ELSE 0.0 END), 8) AS psig, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def conditional_share(spark, sf_dir):
    hit = F.col("l_tax") < 0.03
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("ntot"), F.count_if(hit).alias("nsig"), F.round(F.avg(hit.cast("double")), 8).alias("psig"), F.count_distinct("l_partkey").alias("parts"))


@register("SELECT o_orderstatus, round(min(o_totalprice), 2) AS least, round(quantile_cont(o_totalprice, 0.25), 2) AS q1, round(median(o_totalprice), 2) AS mid, round(quantile_cont(o_totalprice, 0.75), 2) AS q3, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1")
def five_numbers(spark, sf_dir):
    found = relational.group_quantiles(_t(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", {"least": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "most": 1.0})
    return _rounded(found, {c: 2 for c in ("least", "q1", "mid", "q3", "most")})


@register("SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS size, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")
def group_positions(spark, sf_dir):
    own = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sizes = own.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("size"))
    return row_numbers(own, ["c_custkey"], "place", ["c_nationkey"]).join(sizes, "c_nationkey").select("c_custkey", "c_nationkey", "size", "place")


@register("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def largest_balances(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@register(f"SELECT feature_id, ind, round(CASE WHEN feature_id % 2 = 1 THEN abs(2 - v) ELSE v END, 6) + 0.0::DOUBLE AS value FROM (SELECT feature_id, ind, round(v, 3) AS v FROM {_LONG})")
def flipped_dosages(spark, sf_dir):
    f = _features(spark, sf_dir).select("feature_id", F.transform("values", lambda x: F.round(x, 3)).alias("values"))
    rows = studies.flipped(f, f.select("feature_id", (F.col("feature_id") % 2).alias("doFlip")))
    return rows.select("feature_id", F.posexplode("values").alias("ind", "value")).select("feature_id", F.col("ind").cast("long").alias("ind"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


@register("SELECT p_partkey, round(exp(-p_size * p_size / 800.0::DOUBLE) / sqrt(2 * pi() * 400), 10) AS density, round(-log10(1.0::DOUBLE / (1 + p_size)), 8) AS score, greatest(p_size - 20, 0) AS start FROM part")
def densities(spark, sf_dir):
    x = F.col("p_size").cast("double")
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(c.normal_density(x, F.lit(400.0)), 10).alias("density"), F.round(c.minus_log10(1 / (1 + x)), 8).alias("score"), F.greatest(F.col("p_size") - 20, F.lit(0)).alias("start"))


@register("SELECT event_id, CASE WHEN props LIKE '{\"k\": %}' THEN regexp_extract(props, '\"k\": ([0-9]+)', 1) END AS k, string_split(event_type, 'c')[1] AS head FROM events")
def captured_parts(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", c.capture(F.col("props"), '"k": ([0-9]+)').alias("k"), F.split("event_type", "c")[0].alias("head"))


@register("SELECT p_partkey AS pos, s_suppkey AS study_id FROM part JOIN supplier ON p_partkey = s_suppkey")
def panel_intersection(spark, sf_dir):
    panel = _t(spark, sf_dir, "part").select(F.lit(1).alias("chrom"), F.col("p_partkey").alias("pos"))
    study = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("chrom"), F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("feature_id"))
    return studies.panel_intersection(panel, study).select("pos", "study_id")


@register("""
SELECT rsid, panel_id, study_id, round(beta, 2) AS beta FROM (
  SELECT p_size AS rsid, p_partkey AS panel_id, s_suppkey AS study_id, n_nationkey * 0.5::DOUBLE AS beta, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey, s_suppkey) AS r
  FROM part JOIN nation ON p_size = n_nationkey JOIN supplier ON p_partkey = s_suppkey) WHERE r = 1""")
def three_way_harmonised(spark, sf_dir):
    panel = _t(spark, sf_dir, "part").select(F.lit(1).alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("rsid"), F.lit(0.0).alias("map"), F.col("p_partkey").alias("feature_id"), F.lit(0).alias("doFlip"))
    study = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("chrom"), F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("feature_id"), F.lit(0).alias("doFlip"))
    gwas = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rsid"), (F.col("n_nationkey") * 0.5).alias("beta"), F.lit(1.0).alias("serrg"))
    return studies.three_way(gwas, study, panel).select("rsid", "panel_id", "study_id", F.round("beta", 2).alias("beta"))


@register("SELECT feature_id, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT vec_id AS feature_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE label IN (1, 3)) GROUP BY 1")
def panel_subset(spark, sf_dir):
    panel = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature_id"), F.col("label").alias("rsid"), F.lit(0.0).alias("map"))
    rows = studies.panel_subset(panel, _features(spark, sf_dir), spark.createDataFrame([(1,), (3,)], "rsid int"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("feature_id", F.size("values").cast("long").alias("n"), F.round(total, 4).alias("total"))


@register("SELECT l_suppkey AS fgeneid, vec_id AS feature_id FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 45) JOIN embeddings ON vec_id BETWEEN l_suppkey * 10 - 15 AND l_suppkey * 10 + 19")
def gene_with_cis(spark, sf_dir):
    genes = _t(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_suppkey").distinct().select(F.lit(1).alias("chrom"), (F.col("l_suppkey") * 10).alias("start"), (F.col("l_suppkey") * 10 + 4).alias("end"), F.col("l_suppkey").alias("fgeneid"))
    snps = _features(spark, sf_dir).select("feature_id", F.lit(1).alias("chrom"), F.col("feature_id").alias("pos"))
    return studies.gene_with_cis(F.col("fgeneid").isNotNull(), genes, snps, _features(spark, sf_dir), 15).select("fgeneid", "feature_id")


@register("""
WITH e AS (SELECT l_suppkey AS snp, avg(l_discount) - 0.05 AS beta, 0.01 + avg(l_tax) AS se FROM lineitem GROUP BY 1),
l AS (SELECT a.snp AS src, a.beta, a.se, b.se AS col_se FROM e a JOIN e b ON b.snp = a.snp + 1)
SELECT src, round(exp(-beta * beta / (2 * v)) / sqrt(2 * pi() * v), 6) AS mean_density FROM (SELECT *, se * se * (1 + 0.04 / (col_se * col_se)) * 0.5 AS v FROM l)""")
def pair_likelihood(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("snp")).agg((F.avg("l_discount") - 0.05).alias("beta"), (0.01 + F.avg("l_tax")).alias("se"))
    edges = e.select(F.col("snp").alias("src"), (F.col("snp") + 1).alias("dst"), F.lit(0.2).alias("weight"))
    return _rounded(mixture.pair_likelihood(edges, e, 0.5), {"mean_density": 6})


@register("SELECT s_suppkey AS gene, round(s_acctbal, 2) AS performance, count(*) AS n, round(avg(l_discount), 8) AS mean_weight, round(var_samp(l_discount), 8) AS var_weight FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2")
def gene_performance(spark, sf_dir):
    weights = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_discount").alias("weight"))
    performance = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gene"), F.round("s_acctbal", 2).alias("performance"))
    return _rounded(studies.gene_performance(weights, performance).select("gene", "performance", "n", "mean_weight", "var_weight"), {"mean_weight": 8, "var_weight": 8})


@register("SELECT c_custkey AS fgeneid, round(c_acctbal / 10000, 8) AS h_first, round(s_acctbal / 10000, 8) AS h_second FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_acctbal / 10000 > 1e-6 AND s_acctbal / 10000 > 1e-6")
def heritability_table(spark, sf_dir):
    first = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fgeneid"), F.lit("V(G)/Vp").alias("Source"), (F.col("c_acctbal") / 10000).alias("Variance"))
    second = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fgeneid"), F.lit("V(G)/Vp").alias("Source"), (F.col("s_acctbal") / 10000).alias("Variance"))
    return _rounded(studies.heritability_table(first.union(first.withColumn("Source", F.lit("Vp"))), second), {"h_first": 8, "h_second": 8})


@register("SELECT l_suppkey AS gene, l_partkey AS at, round(estimate - 1.96 * se, 6) AS lower, round(estimate + 1.96 * se, 6) AS upper FROM (SELECT *, l_quantity * (1 + l_tax) AS estimate, 0.01 + l_discount AS se, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(l_quantity * (1 + l_tax)) DESC) AS r FROM lineitem) WHERE r = 1")
def path_summary(spark, sf_dir):
    path = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("at"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("estimate"), (0.01 + F.col("l_discount")).alias("se"))
    return _rounded(studies.path_summary(path).select("gene", "at", "lower", "upper"), {"lower": 6, "upper": 6})


@register("SELECT c_custkey AS ensid, round(o_totalprice, 2) AS vegp, CAST(o_custkey AS VARCHAR) AS gene FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders) JOIN customer ON o_custkey = c_custkey WHERE r = 1")
def annotated_genes(spark, sf_dir):
    results = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("gene"), F.col("o_totalprice").alias("vegp"))
    annotation = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("gene"), F.col("c_custkey").alias("ensid"))
    return _rounded(studies.annotate_genes(results, annotation), {"vegp": 2})


@register("""
WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx, sum(l_discount) AS sz, sum(l_quantity * l_discount) AS sxz, sum(l_discount * l_discount) AS szz, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy, sum(l_discount * l_extendedprice) AS szy, l_returnflag FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, n, 'quantity' AS term, round(((sxy - sx * sy / n) * (szz - sz * sz / n) - (szy - sz * sy / n) * (sxz - sx * sz / n)) / ((sxx - sx * sx / n) * (szz - sz * sz / n) - power(sxz - sx * sz / n, 2)), 3) AS estimate FROM s""")
def pooled_design(spark, sf_dir):
    terms = {"one": F.lit(1.0), "quantity": F.col("l_quantity"), "discount": F.col("l_discount")}
    fit = regress.design_regression(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), terms, F.lit(1.0))
    return fit.filter("term = 'quantity'").select("l_returnflag", "n", "term", F.round("estimate", 3).alias("estimate"))


@register("SELECT vec_id AS feature_id, round(CAST(embedding[3] AS DOUBLE), 6) AS second_of_block, pos FROM embeddings JOIN (SELECT vec_id AS id, vec_id + 1 AS pos FROM embeddings WHERE label = 2 UNION ALL SELECT vec_id, vec_id + 2 FROM embeddings WHERE label = 2) ON vec_id = id")
def stored_matrix_block(spark, sf_dir):
    """Write a matrix table, read features by an index with repeats, and a block of individuals."""
    store = scratch_dir(spark)
    tables.append_matrix(_features(spark, sf_dir), store, "m")
    own = _t(spark, sf_dir, "embeddings").filter("label = 2").select((F.col("vec_id") + 1).alias("pos"), F.col("vec_id").alias("feature_id"))
    index = own.union(own.select(F.col("pos") + 1, "feature_id"))
    rows = tables.read_features(spark, store, "m", index)
    return rows.select("feature_id", F.round(F.slice("values", 2, 2)[1], 6).alias("second_of_block"), "pos")


@register("SELECT l_linenumber AS chrom, l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber IN (2, 3) AND l_quantity > 40 GROUP BY 1, 2")
def stored_by_chromosome(spark, sf_dir):
    """Write one folder per chromosome, append, and read two of them with a pushed predicate."""
    store = scratch_dir(spark)
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("chrom"), "l_suppkey", "l_quantity")
    tables.write_by_chromosome(rows.filter("chrom <= 2"), store, "hits")
    tables.write_by_chromosome(rows.filter("chrom > 2"), store, "hits")
    found = tables.read_table(spark, store, "hits", where="chrom in (2, 3) and l_quantity > 40")
    return found.groupBy("chrom", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@register("""
WITH d AS (SELECT vec_id AS i, unnest(range(0, len(embedding))) AS k, unnest(embedding) AS v FROM embeddings),
u AS (SELECT i, i + k AS j, round(CAST(v AS DOUBLE), 6) AS value FROM d)
SELECT i, j, value FROM u UNION ALL SELECT j, i, value FROM u WHERE i <> j""")
def banded_to_sparse(spark, sf_dir):
    band = _features(spark, sf_dir).select(F.col("feature_id").alias("i"), F.col("values").alias("diagonals"))
    return _rounded(tables.band_to_pairs(band).withColumn("j", F.col("j").cast("long")), {"value": 6})
