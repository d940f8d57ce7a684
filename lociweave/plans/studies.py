"""Association studies as plans over the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage
from lociweave.functions.columns import block_number, flip_dosage
from lociweave.functions.tdist import t_critical
from lociweave.operators.matrix import cis_trans_pairs
from lociweave.operators.ordered import row_numbers
from lociweave.operators.regress import elastic_nets_of_values, intercept_regression, origin_regression
from lociweave.operators.relational import distinct_gate, group_minimum, group_quantiles, interval_join, keep_first, suffixed_join


def top_hit_per_block(hits: DataFrame, t_crit: float, block: int = 20_000, chrom: str = "chrom", pos: str = "pos", gene: str = "fgeneid", effect: str = "theta", error: str = "serr", gwas: DataFrame | None = None) -> DataFrame:
    """The most significant hit of each gene in each position block of a chromosome, ties kept.

    The threshold is a predicate; blocks are counted from the smallest position of all
    variants of the chromosome, significant or not; the largest |t| is the smallest p.
    The first positions, one row per chromosome, are broadcast: a join dealt by chromosome would
    leave the hits, and then the partial minima of all their blocks, in one task per chromosome.
    """
    first = hits.groupBy(F.col(chrom).alias("_chrom")).agg(F.min(pos).alias("_first"))
    t = F.abs(F.try_divide(F.col(effect), F.col(error)))
    kept = hits.withColumn("abs_t", t).filter(F.col("abs_t") > t_crit)
    kept = kept if gwas is None else kept.join(gwas, [chrom, pos])
    placed = kept.join(F.broadcast(first), F.col(chrom) == F.col("_chrom")).withColumn("block", block_number(F.col(pos), F.col("_first"), block)).drop("_chrom", "_first")
    return group_minimum(placed, [chrom, gene, "block"], -F.col("abs_t"))


def cis_trans_scan(snps: DataFrame, snp_legend: DataFrame, genes: DataFrame, gene_legend: DataFrame, df: float, cis_p: float = 0.05, trans_p: float = 5e-5, reach: int = 1_000_000) -> DataFrame:
    """(chrom, fgeneid, pos, theta, serr, is_cis) of the pairs that pass their class's threshold.

    The legends give each feature its place before the scan; the workers apply both thresholds.
    """
    left = snps.join(snp_legend.select("feature_id", "chrom", "pos"), "feature_id")
    right = genes.join(gene_legend.select("feature_id", "chrom", "start", "end", "fgeneid"), "feature_id")
    return cis_trans_pairs(left, right, t_critical(cis_p, df), t_critical(trans_p, df), reach)


def panel_intersection(panel: DataFrame, study: DataFrame) -> DataFrame:
    """Panel variants that the study has, by (chrom, pos), with the study's feature_id."""
    return panel.join(study.select("chrom", "pos", F.col("feature_id").alias("study_id")), ["chrom", "pos"])


def three_way(gwas: DataFrame, study: DataFrame, panel: DataFrame) -> DataFrame:
    """Variants of all three tables, one row per rsid: the panel's rsid links to the GWAS and
    its position to the study."""
    linked = panel.select("chrom", "pos", "rsid", "map", F.col("feature_id").alias("panel_id"), F.col("doFlip").alias("panel_flip")).join(gwas.select("rsid", "beta", "serrg"), "rsid")
    both = linked.join(study.select("chrom", "pos", F.col("feature_id").alias("study_id"), F.col("doFlip").alias("study_flip")), ["chrom", "pos"])
    return keep_first(both, ["rsid"], ["panel_id", "study_id"])


def write_harmonised(joined: DataFrame, panel: DataFrame, study: DataFrame, path: str) -> None:
    """Write ``three_way``'s variants as three tables partitioned by chromosome: ``legend``,
    ``haplotypes`` of the panel and ``genotypes`` of the study.

    feature_id numbers the variants anew in the order of (chrom, pos, rsid) and is the same in all
    three; alleles are counted the other way where the panel's, or the study's, flip flag is 1.
    """
    legend = cut_lineage(row_numbers(joined, ["chrom", "pos", "rsid"], "feature_id"))
    legend.write.partitionBy("chrom").parquet(f"{path}/legend")
    for name, matrix, id_, flip, ploidy in (("haplotypes", panel, "panel_id", "panel_flip", 1), ("genotypes", study, "study_id", "study_flip", 2)):
        own = legend.select("chrom", "feature_id", F.col(id_).alias("_id"), F.col(flip).alias("_flip"))
        rows = own.join(matrix.select(F.col("feature_id").alias("_id"), "values"), "_id")
        rows.select("chrom", "feature_id", flip_dosage(F.col("values"), F.col("_flip"), ploidy).alias("values")).write.partitionBy("chrom").parquet(f"{path}/{name}")


def flipped(matrix: DataFrame, legend: DataFrame, ploidy: int = 2) -> DataFrame:
    """Features with the allele counted the other way where the legend's doFlip is 1."""
    return matrix.join(legend.select("feature_id", "doFlip"), "feature_id").select("feature_id", flip_dosage(F.col("values"), F.col("doFlip"), ploidy).alias("values"))


def panel_subset(panel: DataFrame, matrix: DataFrame, keys: DataFrame) -> DataFrame:
    """(feature_id, map, values) of the panel's features listed by rsid or by position."""
    on = ["rsid"] if "rsid" in keys.columns else ["chrom", "pos"]
    return panel.join(keys.select(*on).distinct(), on, "left_semi").select("feature_id", "map").join(matrix, "feature_id")


def gene_with_cis(gene: Column, genes: DataFrame, snps: DataFrame, matrix: DataFrame, reach: int = 1_000_000) -> DataFrame:
    """(fgeneid, feature_id, pos, values): the cis variants of the genes a predicate picks."""
    own = genes.filter(gene).select("chrom", "start", "end", "fgeneid")
    near = interval_join(snps.select("feature_id", "chrom", "pos"), own, "chrom", "pos", "start", "end", reach)
    return near.select("fgeneid", "feature_id", "pos").join(matrix, "feature_id")


def cis_elastic_nets(genes: DataFrame, expression: DataFrame, snps: DataFrame, matrix: DataFrame, reach: int = 1_000_000, alpha: float = 0.95) -> DataFrame:
    """Elastic-net paths of every gene with two or more cis variants: one row per gene and step."""
    near = interval_join(snps.select("feature_id", "chrom", "pos"), genes.select("chrom", "start", "end", F.col("feature_id").alias("gene")), "chrom", "pos", "start", "end", reach)
    y = expression.select(F.col("feature_id").alias("gene"), F.col("values").alias("y"))
    return elastic_nets_of_values(near.select("gene", "feature_id").join(y, "gene").join(matrix, "feature_id").select("gene", F.col("feature_id").alias("snp"), "values", "y"), alpha)


def effect_regression(hits: DataFrame, gene: str, response: Column, predictor: Column, weight: Column, gate: list[str], more_than: int = 3) -> DataFrame:
    """Regression through the origin of each gene that has enough distinct effects."""
    return origin_regression(distinct_gate(hits, gene, gate, more_than), [gene], response, predictor, weight)


def replication(first: DataFrame, second: DataFrame, keys: list[str], gene: str, cis: str, suffixes: tuple[str, str], more_than: int = 4) -> DataFrame:
    """Pairs of both studies, with a both-cis flag and each gene's regression of one effect on the other.

    Genes need more than ``more_than`` pairs.  theta and serr are the effect and error.
    """
    a, b = suffixes
    both = suffixed_join(first, second, keys, suffixes).withColumn("both_cis", F.coalesce(F.col(cis + a) & F.col(cis + b), F.lit(False)).cast("int"))
    sizes = both.groupBy(gene).agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") > more_than)
    fit = intercept_regression(both.join(sizes, gene, "left_semi"), [gene], F.col("theta" + b), F.col("theta" + a), F.try_divide(F.lit(1.0), F.col("serr" + b) * F.col("serr" + b)))
    return sizes.join(fit, gene)


def merged_cis_trans(cis: DataFrame, trans: DataFrame) -> DataFrame:
    """Both result tables as one, with is_cis; columns that one lacks are null."""
    return cis.withColumn("is_cis", F.lit(True)).unionByName(trans.withColumn("is_cis", F.lit(False)), allowMissingColumns=True)


def candidate_ranking(p: DataFrame, gene: str = "gene", cutoff: float = 1e-3) -> DataFrame:
    """Per gene the share of p under the cutoff and how far p is from uniform in median and variance."""
    sums = p.groupBy(gene).agg(F.count(F.lit(1)).alias("ntot"), F.count_if(F.col("p") < cutoff).alias("nsig"), F.avg((F.col("p") < cutoff).cast("double")).alias("psig"), F.abs(1 / 12 - F.var_samp("p")).alias("variance_gap"))
    middle = group_quantiles(p, [gene], "p", {"median_gap": 0.5}).select(F.col(gene).alias("_gene"), F.abs(0.5 - F.col("median_gap")).alias("median_gap"))
    return sums.join(middle, F.col(gene).eqNullSafe(F.col("_gene")), "left").select(gene, "ntot", "nsig", "psig", "median_gap", "variance_gap")


def heritability_table(first: DataFrame, second: DataFrame, least: float = 1e-6) -> DataFrame:
    """(fgeneid, h_first, h_second): the V(G)/Vp rows of two result tables (fgeneid, Source, Variance)."""
    pick = lambda df, name: df.filter(F.col("Source") == "V(G)/Vp").select("fgeneid", F.col("Variance").alias(name))
    return pick(first, "h_first").join(pick(second, "h_second"), "fgeneid").filter((F.col("h_first") > least) & (F.col("h_second") > least))


def restricted_refit(hits: DataFrame, independent: DataFrame, keys: list[str], gene: str, y: Column, x: Column, weight: Column) -> DataFrame:
    """Each gene's slope on all hits and on the hits of an independent variant set, side by side."""
    full = origin_regression(hits, [gene], y, x, weight)
    part = origin_regression(hits.join(independent.select(*keys).distinct(), keys, "left_semi"), [gene], y, x, weight)
    return suffixed_join(full, part, [gene], ("_all", "_independent"))


def gene_performance(weights: DataFrame, performance: DataFrame, gene: str = "gene", columns: tuple[str, ...] = ("weight",)) -> DataFrame:
    """Per-gene count, mean and variance of weights joined onto a performance table."""
    from lociweave.operators.regress import group_summary

    return performance.join(group_summary(weights, gene, list(columns)), gene)


def path_summary(path: DataFrame, gene: str = "gene", estimate: str = "estimate", se: str = "se", z: float = 1.96) -> DataFrame:
    """Of each gene the path row with the largest |estimate|, with confidence bounds."""
    best = group_minimum(path, [gene], -F.abs(F.col(estimate)))
    return best.withColumn("lower", F.col(estimate) - z * F.col(se)).withColumn("upper", F.col(estimate) + z * F.col(se))


def weight_agreement(first: DataFrame, second: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """(n, r, mean_abs_difference) of two weight tables on common keys."""
    both = suffixed_join(first, second, keys, ("_a", "_b"))
    a, b = F.col(f"{weight}_a"), F.col(f"{weight}_b")
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), F.avg(F.abs(a - b)).alias("mean_abs_difference"))


def annotate_genes(results: DataFrame, annotation: DataFrame) -> DataFrame:
    """(ensid, vegp, gene): gene-level results by name joined to ids, first row per id by p."""
    return keep_first(results.join(annotation, "gene"), ["ensid"], ["vegp", "gene"]).select("ensid", "vegp", "gene")
