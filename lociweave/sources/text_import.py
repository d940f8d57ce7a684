"""Importers of text formats: panels, expression, genotypes, covariates, summary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.functions import columns as c
from lociweave.operators.ordered import row_numbers
from lociweave.operators.relational import keep_first, natural_join


#: Where a row stands in its files: path, block within the file, number within the block's task.
_PLACE = ["_file", "_block", "_line"]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of text files with their place, which does not depend on how Spark packs files into tasks."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, value) of a text file, or of a folder's files in the order of their names.

    A compressed file is one partition anyway; other lines are numbered by ranges of their place.
    """
    return row_numbers(_placed(spark.read.text(path)), _PLACE, "line_no").select("line_no", "value")


def reference_panel(spark: SparkSession, legend_path: str, map_path: str, subset: DataFrame | None = None) -> DataFrame:
    """Legend joined with the genetic map on rsid, pos and chrom: rsid, chrom, pos, ref, alt, map, snp_id.

    The chromosome comes from the file name.  Repeated snp_id, then map_id, then
    (chrom, pos) keep their first row.  ``subset`` is a table of snp_id to keep.
    """
    chrom = F.regexp_extract(F.input_file_name(), r"chr([0-9]+)", 1).cast("int")
    legend = spark.read.csv(legend_path, sep=" ", header=True, schema="rsid string, pos int, ref string, alt string").withColumn("chrom", chrom)
    legend = row_numbers(_placed(legend), _PLACE, "snp_id", ["chrom"]).drop(*_PLACE)
    gen_map = spark.read.csv(map_path, sep=" ", schema="rsid string, pos int, map double").withColumn("chrom", chrom)
    gen_map = row_numbers(_placed(gen_map), _PLACE, "map_id", ["chrom"]).drop(*_PLACE)
    both = natural_join(legend, gen_map)
    for key in (["chrom", "snp_id"], ["chrom", "map_id"], ["chrom", "pos"]):
        both = keep_first(both, key, ["snp_id", "map_id"])
    both = both if subset is None else both.join(subset, "snp_id", "left_semi")
    return both.drop("map_id").orderBy("chrom", "snp_id")


def matrix_rows(spark: SparkSession, path: str, rows: DataFrame, sep: str = " ") -> DataFrame:
    """(line_no, values) of listed lines (column line_no) of a text matrix; all must exist."""
    wanted = rows.select("line_no").distinct()
    found = read_lines(spark, path).join(wanted, "line_no", "left_semi").select("line_no", F.transform(F.split("value", sep), lambda x: x.cast("double")).alias("values"))
    if found.count() != wanted.count():
        raise ValueError("the file has fewer lines than asked for")
    return found


def expression_bed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gene legend (feature_id, chrom, start, end, fgeneid) and matrix table of an expression BED file."""
    raw = spark.read.csv(path, sep="\t", header=True)
    first, start, end, gene, *samples = raw.columns
    rows = raw.select(c.chromosome(F.col(first)).alias("chrom"), F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end"), c.gene_number(F.col(gene)).alias("fgeneid"), F.array(*[F.col(f"`{s}`").cast("double") for s in samples]).alias("values"))
    rows = row_numbers(rows, ["chrom", "start", "fgeneid"], "feature_id")
    return rows.drop("values"), rows.select("feature_id", "values")


def genotype_text(spark: SparkSession, path: str, drop_unplaced: bool = False) -> tuple[DataFrame, DataFrame]:
    """SNP legend (feature_id, chrom, pos, ref, alt, allele, doFlip) and matrix table of dosages.

    With ``drop_unplaced`` rows without chromosome or position go, as the variant-array
    layout asks.  Flipping is a step of its own (``flip_dosage``).
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    key, *samples = raw.columns
    v = F.col(key)
    ref, alt = c.variant_part(v, "ref"), c.variant_part(v, "alt")
    rows = raw.select(c.chromosome(c.variant_part(v, "chrom")).alias("chrom"), c.variant_part(v, "pos").alias("pos"), ref.alias("ref"), alt.alias("alt"), F.concat_ws("/", ref, alt).alias("allele"), c.flip_flag(ref, alt).alias("doFlip"), F.array(*[F.col(f"`{s}`").cast("double") for s in samples]).alias("values"))
    rows = rows.dropna(subset=["chrom", "pos"]) if drop_unplaced else rows
    rows = row_numbers(rows, ["chrom", "pos", "ref", "alt"], "feature_id")
    return rows.drop("values"), rows.select("feature_id", "values")


def split_alleles(legend: DataFrame) -> DataFrame:
    """ref and alt from an allele column ref/alt."""
    parts = F.split("allele", "/")
    return legend.withColumn("ref", F.try_element_at(parts, F.lit(1))).withColumn("alt", F.try_element_at(parts, F.lit(2)))


def covariates(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(individual, id-ordered names, values): one row per individual from one row per covariate."""
    raw = spark.read.csv(path, sep=sep, header=True)
    key, *samples = raw.columns
    long = raw.unpivot([key], samples, "individual", "value")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("name"), F.col("value").cast("double").alias("value"))))
    return long.groupBy("individual").agg(pairs.alias("p")).select("individual", F.col("p.name").alias("names"), F.col("p.value").alias("values"))


def eqtl_pairs(spark: SparkSession, path: str) -> DataFrame:
    """eQTL pair text: fgeneid, chrom, pos, doFlip, weight (sign changed on a flip), serr, pval_e and
    the other columns; rows without chromosome or position go."""
    raw = spark.read.csv(path, sep="\t", header=True)
    v = F.col("variant_id")
    flip = c.flip_flag(c.variant_part(v, "ref"), c.variant_part(v, "alt"))
    other = [x for x in raw.columns if x not in ("gene_id", "variant_id", "slope", "slope_se", "pval_nominal")]
    out = raw.select(c.gene_number(F.col("gene_id")).alias("fgeneid"), c.chromosome(c.variant_part(v, "chrom")).alias("chrom"), c.variant_part(v, "pos").alias("pos"), flip.alias("doFlip"), c.flip_effect(F.col("slope").cast("double"), flip).alias("weight"), F.col("slope_se").cast("double").alias("serr"), F.col("pval_nominal").cast("double").alias("pval_e"), *other)
    return out.dropna(subset=["chrom", "pos"])


def gwas_summary(raw: DataFrame, studies: int = 15) -> DataFrame:
    """chrom, rsid, pos, beta, serrg, pvalg of rows whose direction is known in all studies.

    The odds ratio is inverted where A1 sorts after A2, and beta is its log.
    """
    d = F.col("Direction")
    known = c.symbol_count(d, "+") + c.symbol_count(d, "-") == studies
    odds = F.when(F.col("A1") > F.col("A2"), F.try_divide(F.lit(1.0), F.col("OR"))).otherwise(F.col("OR"))
    return raw.filter(known).select(F.col("CHR").alias("chrom"), c.rs_number(F.col("SNP")).alias("rsid"), F.col("BP").alias("pos"), (F.col("A1") > F.col("A2")).cast("int").alias("doFlip"), F.ln(odds).alias("beta"), F.col("SE").alias("serrg"), F.col("P").alias("pvalg"))


def quantitative_gwas(raw: DataFrame) -> DataFrame:
    """rsid, beta (sign changed where Allele1 sorts before Allele2), serrg, N; rows without rsid go."""
    flip = F.col("Allele1") < F.col("Allele2")
    return raw.select(c.rs_number(F.col("MarkerName")).alias("rsid"), F.when(flip, -F.col("b")).otherwise(F.col("b")).alias("beta"), F.col("SE").alias("serrg"), "N").dropna(subset=["rsid"])
