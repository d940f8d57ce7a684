"""Registered queries of the text importers: tables are written as the formats' text and imported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import scratch_dir
from lociweave.plans.queries import _LONG, _rounded, _t, register
from lociweave.sources import tables, text_import


def _text(df: DataFrame, name: str, sep: str = "\t", header: bool = True) -> str:
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.option("sep", sep).option("header", header).csv(path)
    return path


def _letter(number):
    return F.chr(F.lit(65) + number % 4)


_VARIANT_SQL = "CASE WHEN l_linenumber = 7 THEN 23 WHEN l_linenumber = 6 THEN NULL ELSE l_linenumber END AS chrom, chr(CAST(65 + l_partkey % 4 AS INT)) AS ref, chr(CAST(65 + l_suppkey % 4 AS INT)) AS alt"


@register(f"""
WITH v AS (SELECT *, {_VARIANT_SQL} FROM lineitem)
SELECT CAST(l_suppkey AS INT) AS fgeneid, CAST(chrom AS INT) AS chrom, CAST(l_partkey AS INT) AS pos, CAST(ref < alt AS INT) AS flip, round(CASE WHEN ref < alt THEN -l_quantity ELSE l_quantity END, 4) AS weight, round(l_tax, 4) AS serr, round(l_discount, 4) AS p
FROM v WHERE chrom IS NOT NULL""")
def imported_eqtl_pairs(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    chrom = F.when(F.col("l_linenumber") == 7, "X").when(F.col("l_linenumber") == 6, "Y").otherwise(F.col("l_linenumber").cast("string"))
    text = li.select(F.printf(F.lit("ENSG%011d.2"), "l_suppkey").alias("gene_id"), F.concat_ws("_", chrom, F.col("l_partkey").cast("string"), _letter(F.col("l_partkey")), _letter(F.col("l_suppkey")), F.lit("b37")).alias("variant_id"), F.col("l_discount").alias("pval_nominal"), F.col("l_quantity").alias("slope"), F.col("l_tax").alias("slope_se"))
    rows = text_import.eqtl_pairs(spark, _text(text, "pairs"))
    return rows.select("fgeneid", "chrom", "pos", F.col("doFlip").alias("flip"), F.round("weight", 4).alias("weight"), F.round("serr", 4).alias("serr"), F.round("pval_e", 4).alias("p"))


@register("""
WITH g AS (SELECT o_orderkey, 1 + o_totalprice / 100000 AS odds, chr(CAST(65 + o_orderkey % 4 AS INT)) AS a1, chr(CAST(65 + o_custkey % 4 AS INT)) AS a2 FROM orders WHERE o_orderstatus <> 'P')
SELECT CAST(o_orderkey AS INT) AS rsid, CAST(a1 > a2 AS INT) AS flip, round(CASE WHEN a1 > a2 THEN ln(1 / odds) ELSE ln(odds) END, 6) + 0.0::DOUBLE AS beta FROM g""")
def imported_gwas_summary(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    direction = F.when(F.col("o_orderstatus") == "P", F.lit("+" * 14 + "?")).otherwise(F.lit("+" * 9 + "-" * 6))
    text = o.select(F.lit(1).alias("CHR"), F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("SNP"), F.col("o_custkey").alias("BP"), _letter(F.col("o_orderkey")).alias("A1"), _letter(F.col("o_custkey")).alias("A2"), (1 + F.col("o_totalprice") / 100000).alias("OR"), F.lit(0.1).alias("SE"), F.lit(0.5).alias("P"), direction.alias("Direction"))
    raw = spark.read.csv(_text(text, "gwas"), sep="\t", header=True, schema="CHR int, SNP string, BP int, A1 string, A2 string, OR double, SE double, P double, Direction string")
    rows = text_import.gwas_summary(raw)
    return rows.select("rsid", F.col("doFlip").alias("flip"), (F.round("beta", 6) + F.lit(0.0)).alias("beta"))


@register("""
SELECT CAST(c_custkey AS INT) AS rsid, round(CASE WHEN chr(CAST(65 + c_custkey % 4 AS INT)) < chr(CAST(65 + c_nationkey % 4 AS INT)) THEN -c_acctbal ELSE c_acctbal END, 2) AS beta FROM customer WHERE c_nationkey <> 3""")
def imported_quantitative_gwas(spark, sf_dir):
    cust = _t(spark, sf_dir, "customer")
    name = F.when(F.col("c_nationkey") == 3, F.lit("chr3:77")).otherwise(F.concat(F.lit("rs"), F.col("c_custkey").cast("string")))
    text = cust.select(name.alias("MarkerName"), _letter(F.col("c_custkey")).alias("Allele1"), _letter(F.col("c_nationkey")).alias("Allele2"), F.col("c_acctbal").alias("b"), F.lit(0.1).alias("SE"), F.lit(9).alias("N"))
    raw = spark.read.csv(_text(text, "trait", " "), sep=" ", header=True, schema="MarkerName string, Allele1 string, Allele2 string, b double, SE double, N int")
    return _rounded(text_import.quantitative_gwas(raw).select("rsid", "beta"), {"beta": 2})


#: Columns of the written texts: all positions of an embedding.
SAMPLES = 64


def _samples(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").filter("embedding is not null")
    return e.select("vec_id", "label", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(f"s{i}") for i in range(SAMPLES)])


@register(f"""
WITH s AS (SELECT feature_id, round(sum(round(v, 5)), 5) AS total FROM {_LONG} WHERE ind < {SAMPLES} GROUP BY 1)
SELECT row_number() OVER (ORDER BY CASE WHEN label = 9 THEN 23 ELSE label + 1 END, vec_id) AS feature_id, CAST(CASE WHEN label = 9 THEN 23 ELSE label + 1 END AS INT) AS chrom, CAST(vec_id AS INT) AS fgeneid, total + 0.0::DOUBLE AS total
FROM embeddings JOIN s ON vec_id = feature_id""")
def imported_expression(spark, sf_dir):
    s = _samples(spark, sf_dir)
    chrom = F.when(F.col("label") == 9, "X").otherwise((F.col("label") + 1).cast("string"))
    text = s.select(chrom.alias("#chr"), F.col("vec_id").alias("start"), (F.col("vec_id") + 5).alias("end"), F.printf(F.lit("ENSG%011d.7"), "vec_id").alias("gene_id"), *[f"s{i}" for i in range(SAMPLES)])
    legend, values = text_import.expression_bed(spark, _text(text, "expression"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return legend.join(values, "feature_id").select("feature_id", "chrom", "fgeneid", (F.round(total, 5) + F.lit(0.0)).alias("total"))


@register(f"""
WITH s AS (SELECT feature_id, round(sum(round(v, 5)), 5) AS total FROM {_LONG} WHERE ind < {SAMPLES} GROUP BY 1),
g AS (SELECT vec_id, label + 1 AS chrom, chr(CAST(65 + vec_id % 4 AS INT)) AS ref, chr(CAST(65 + label % 4 AS INT)) AS alt FROM embeddings WHERE label < 9)
SELECT CAST(chrom AS INT) AS chrom, CAST(vec_id AS INT) AS pos, ref || '/' || alt AS allele, CAST(ref < alt AS INT) AS flip, total + 0.0::DOUBLE AS total FROM g JOIN s ON vec_id = feature_id""")
def imported_genotypes(spark, sf_dir):
    s = _samples(spark, sf_dir)
    chrom = F.when(F.col("label") == 9, "Y").otherwise((F.col("label") + 1).cast("string"))
    text = s.select(F.concat_ws("_", chrom, F.col("vec_id").cast("string"), _letter(F.col("vec_id")), _letter(F.col("label")), F.lit("b37")).alias("Id"), *[f"s{i}" for i in range(SAMPLES)])
    legend, values = text_import.genotype_text(spark, _text(text, "genotypes"), drop_unplaced=True)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return legend.join(values, "feature_id").select("chrom", "pos", "allele", F.col("doFlip").alias("flip"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


@register("SELECT 'r' || r_regionkey AS individual, r_regionkey + 1.0::DOUBLE AS first, r_regionkey * 2.0::DOUBLE AS second FROM region")
def imported_covariates(spark, sf_dir):
    """One column per region and one row per covariate, turned to one row per region."""
    r = _t(spark, sf_dir, "region")
    rows = r.select(F.lit("age").alias("ID"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("who"), (F.col("r_regionkey") + 1.0).alias("v")).union(r.select(F.lit("dose"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.col("r_regionkey") * 2.0))
    text = rows.groupBy("ID").pivot("who", [f"r{i}" for i in range(5)]).agg(F.first("v"))
    c = text_import.covariates(spark, _text(text, "covariates"))
    return c.select("individual", F.col("values")[0].alias("first"), F.col("values")[1].alias("second"))


@register("SELECT 7 AS chrom, 'rs' || p_partkey AS rsid, CAST(min(p_partkey) AS INT) AS pos, round(p_partkey * 0.01::DOUBLE, 4) AS map FROM part GROUP BY p_partkey")
def imported_panel(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    rsid = F.concat(F.lit("rs"), F.col("p_partkey").cast("string"))
    legend = _text(p.select(rsid.alias("rsid"), F.col("p_partkey").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt")), "chr7_legend", " ")
    gen_map = _text(p.select(rsid, "p_partkey", F.round(F.col("p_partkey") * 0.01, 4)), "chr7_map", " ", header=False)
    return text_import.reference_panel(spark, legend, gen_map).select("chrom", "rsid", "pos", F.round("map", 4).alias("map"))


@register("SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def exported_delimited(spark, sf_dir):
    """Write delimited text with a header and read it back."""
    path = scratch_dir(spark)
    tables.write_delimited(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), path)
    return _rounded(spark.read.csv(path, sep="\t", header=True, schema="s_suppkey long, s_acctbal double"), {"s_acctbal": 2})
