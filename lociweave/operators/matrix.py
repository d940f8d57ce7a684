"""Matrix tables and all-pairs association.

A matrix table has one row per feature: (feature_id, values array<double>), with one
value per individual in a fixed order.  Features are the partitioned side; products
run as GEMMs inside Arrow batches.  Tables of individuals with an array of features go
through ``cross_moments``, which adds up partial Gram matrices per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage, ship_package
from lociweave.operators.ordered import last_value, running_total

#: Largest block of a matrix that is sent to all executors at once.
BLOCK_BYTES = 64 << 20
#: Rows of the two sides of a product that a worker holds at once.
TILE = (256, 2048)


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in values]).reshape(len(values), -1)


def covariate_basis(covariates: DataFrame, order: str, columns: list[str]) -> np.ndarray:
    """Orthonormal basis (individuals x k) of an intercept and the covariates.

    The covariate table has one row per individual and is read to the driver: it is
    k numbers per individual, whatever the number of features.
    """
    rows = covariates.orderBy(order).select(*[F.col(c).cast("double") for c in columns]).toArrow()
    x = np.column_stack([np.ones(rows.num_rows), *[rows.column(c).to_numpy() for c in columns]])
    q, r = np.linalg.qr(x)
    return q[:, np.abs(np.diag(r)) > 1e-10 * max(1.0, np.abs(np.diag(r)).max())]


def residualise(matrix: DataFrame, basis: np.ndarray) -> DataFrame:
    """values - Q Q' values for each feature row."""
    ship_package(matrix.sparkSession)
    q = matrix.sparkSession.sparkContext.broadcast(basis)
    at = matrix.columns.index("values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at).to_pylist()) if len(batch) else np.zeros((0, len(q.value)))
            if len(batch) and x.shape[1] != len(q.value):
                raise ValueError("a feature has another number of individuals than the covariates")
            yield batch.set_column(at, "values", pa.array(list(x - (x @ q.value) @ q.value.T), pa.list_(pa.float64())))

    return matrix.mapInArrow(run, matrix.schema)


def residualise_on_mean(matrix: DataFrame) -> DataFrame:
    """``residualise`` on the intercept alone, as a column expression."""
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")
    return matrix.withColumn("_mean", mean).withColumn("values", F.transform("values", lambda x: x - F.col("_mean"))).drop("_mean")


def feature_summary(matrix: DataFrame) -> DataFrame:
    """(feature_id, n, mean, sd) of each feature row; sd has n - 1 and is null for one value."""
    n = F.size("values")
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / n
    rows = matrix.select("feature_id", "values", n.alias("n"), mean.alias("mean"))
    ss = F.aggregate("values", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return rows.select("feature_id", "n", "mean", F.sqrt(F.try_divide(ss, (F.col("n") - 1).cast("double"))).alias("sd"))


def individual_summary(matrix: DataFrame) -> DataFrame:
    """(ind, n, mean, sd) of each position over all features.

    Each partition merges one (n, mean, squares) array per batch, so a row per position and
    partition is shuffled and no row per value.
    """
    ship_package(matrix.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, squares = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0).to_pylist())
                gap, both = x.mean(axis=0) - mean, n + len(x)
                squares = squares + ((x - x.mean(axis=0)) ** 2).sum(axis=0) + gap**2 * (n * len(x) / both)
                n, mean = both, mean + gap * (len(x) / both)
        if n:
            yield pa.record_batch([pa.array(c) for c in (np.arange(len(mean), dtype=np.int32), np.full(len(mean), n), mean, squares)], names=["ind", "n", "mean", "squares"])

    parts = cut_lineage(matrix.select("values").mapInArrow(run, "ind int, n long, mean double, squares double"))
    means = parts.groupBy("ind").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    gap = F.col("mean") - F.col("_mean")
    merged = parts.join(means, "ind").groupBy("ind").agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("squares") + F.col("n") * gap * gap).alias("_squares"))
    return merged.select("ind", "n", "mean", F.sqrt(F.try_divide(F.col("_squares"), (F.col("n") - 1).cast("double"))).alias("sd"))


def pair_scan(snps: DataFrame, genes: DataFrame, t_crit: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All-pairs regression (snp, gene, beta, se, t) of two matrix tables.

    beta is the slope without intercept, t comes from the Pearson correlation with n - 2,
    and se = beta / t; constant features and |r| = 1 give nulls.  With ``t_crit`` only
    pairs with a larger |t| leave the worker.  Genes are the small side: they are cut
    into blocks of at most ``block_bytes``, and each block is broadcast and meets the SNP
    partitions in a scan of its own, so the SNP table is read once per block.
    """

    def made(snp: pd.DataFrame, gene: pd.DataFrame, i: np.ndarray, j: np.ndarray, beta: np.ndarray, se: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"snp": snp["feature_id"].to_numpy()[i], "gene": gene["feature_id"].to_numpy()[j], "beta": beta, "se": se, "t": t})

    out = scan_blocks(snps.select("feature_id", "values"), genes.select("feature_id", "values"), _found_pairs(t_crit, made), "snp long, gene long, beta double, se double, t double", block_bytes)
    return out.select("snp", "gene", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("beta", "se", "t")])


def cis_trans_pairs(snps: DataFrame, genes: DataFrame, cis_t: float, trans_t: float, reach: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(chrom, fgeneid, pos, theta, serr, is_cis) of the pairs whose |t| exceeds their class's threshold.

    snps: (feature_id, values, chrom, pos); genes: (feature_id, values, chrom, start, end, fgeneid).
    The class comes from the positions inside the worker that forms the product, so a pair
    between the two thresholds never leaves it, and no legend is joined afterwards.
    """
    kinds = dict(snps.dtypes) | {"fgeneid": dict(genes.dtypes)["fgeneid"]}

    def made(snp: pd.DataFrame, gene: pd.DataFrame, i: np.ndarray, j: np.ndarray, beta: np.ndarray, se: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        pos, start, end = snp["pos"].to_numpy(float)[i], gene["start"].to_numpy(float)[j], gene["end"].to_numpy(float)[j]
        same = (snp["chrom"].to_numpy()[i] == gene["chrom"].to_numpy()[j]) & snp["chrom"].notna().to_numpy()[i]
        cis = same & (((pos > start) & (pos < end)) | (np.abs(pos - start) < reach) | (np.abs(pos - end) < reach))
        rows = pd.DataFrame({"chrom": snp["chrom"].to_numpy()[i], "fgeneid": gene["fgeneid"].to_numpy()[j], "pos": snp["pos"].to_numpy()[i], "theta": beta, "serr": se, "is_cis": cis})
        return rows[np.abs(t) > np.where(cis, cis_t, trans_t)]

    left, right = snps.select("feature_id", "values", "chrom", "pos"), genes.select("feature_id", "values", "chrom", "start", "end", "fgeneid")
    return scan_blocks(left, right, _found_pairs(min(cis_t, trans_t), made), f"chrom {kinds['chrom']}, fgeneid {kinds['fgeneid']}, pos {kinds['pos']}, theta double, serr double, is_cis boolean", block_bytes)


def scan_shares(snps: DataFrame, genes: DataFrame, t_crit: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(feature_id, is_gene, n_pairs, share): of each feature of a scan the share of its pairs whose
    |t| exceeds the critical value.

    The workers count and no pair leaves them: a row per variant and block, and a row per gene
    and task are all that is shuffled.
    """

    def counted(frames: Iterator[pd.DataFrame], gene: pd.DataFrame, e: np.ndarray) -> Iterator[pd.DataFrame]:
        seen, hits = 0, np.zeros(len(gene), np.int64)
        for frame in frames:
            own = np.zeros(len(frame), np.int64)
            for part, at, g in _parts(frame):
                for to, i, j, *_ in tile_pairs(g, e, t_crit, effects=False):
                    own[at : at + len(part)] += np.bincount(i, minlength=len(part))
                    hits[to : to + TILE[1]] += np.bincount(j, minlength=len(hits[to : to + TILE[1]]))
            seen += len(frame)
            yield pd.DataFrame({"feature_id": frame["feature_id"], "is_gene": False, "n_pairs": len(gene), "hits": own})
        if seen:
            yield pd.DataFrame({"feature_id": gene["feature_id"], "is_gene": True, "n_pairs": seen, "hits": hits})

    counts = scan_blocks(snps.select("feature_id", "values"), genes.select("feature_id", "values"), counted, "feature_id long, is_gene boolean, n_pairs long, hits long", block_bytes)
    sums = counts.groupBy("feature_id", "is_gene").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("hits").alias("hits"))
    return sums.select("feature_id", "is_gene", "n_pairs", (F.col("hits") / F.col("n_pairs")).alias("share"))


def _parts(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, int, np.ndarray]]:
    """Runs of rows of a frame with their place and their matrix."""
    for at in range(0, len(frame), TILE[0]):
        part = frame.iloc[at : at + TILE[0]]
        yield part, at, _matrix(part["values"].tolist())


def _found_pairs(t_crit: float | None, made: Callable) -> Callable:
    """Rows that ``made`` gives of the pairs of each tile, which are all or exceed ``t_crit``."""

    def run(frames: Iterator[pd.DataFrame], gene: pd.DataFrame, e: np.ndarray) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, _, g in _parts(frame):
                for to, *found in tile_pairs(g, e, t_crit):
                    yield made(part, gene.iloc[to : to + TILE[1]], *found)

    return run


def scan_blocks(snps: DataFrame, genes: DataFrame, scan: Callable, schema: str, block_bytes: int, dealt: bool = False) -> DataFrame:
    """Rows that ``scan`` gives of each SNP partition (frames) and gene block (frame, matrix)."""
    ship_package(snps.sparkSession)
    sc = snps.sparkSession.sparkContext
    # a few small files would leave most cores without work, and a pair costs more than a row
    snps = snps if dealt else snps.repartition(2 * sc.defaultParallelism, "feature_id")
    out = None
    for block in _blocks(genes, block_bytes):
        shared = sc.broadcast((block.drop(columns="values"), _matrix(block["values"].tolist())))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return scan(frames, *shared.value)

        rows = snps.mapInPandas(run, schema)
        out = rows if out is None else out.unionByName(rows)
    return snps.sparkSession.createDataFrame([], schema) if out is None else out


def tile_pairs(g: np.ndarray, e: np.ndarray, t_crit: float | None = None, effects: bool = True) -> Iterator[tuple]:
    """(first, i, j, beta, se, t) of the pairs of rows of two arrays in tiles of ``TILE[1]`` rows of the
    second, j from the tile's first; all pairs, or those whose |t| exceeds ``t_crit``.

    A tile is all that is held, however many rows the second array has.  With a threshold
    beta, se and t are formed for what exceeds it; without ``effects`` beta and se are null.
    """
    if g.shape[1] != e.shape[1]:
        raise ValueError("the two matrices have different numbers of individuals")
    n = g.shape[1]
    bar = None if t_crit is None or t_crit <= 0 or n <= 2 else t_crit / np.sqrt(n - 2 + t_crit * t_crit) * (1 - 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        raw, gc = (g * g).sum(axis=1), g - g.mean(axis=1, keepdims=True)
        u = gc / np.sqrt((gc * gc).sum(axis=1, keepdims=True))
        for to in range(0, len(e), TILE[1]):
            own = e[to : to + TILE[1]]
            ec = own - own.mean(axis=1, keepdims=True)
            r = u @ (ec / np.sqrt((ec * ec).sum(axis=1, keepdims=True))).T
            i, j = np.nonzero(np.ones(r.shape, bool) if bar is None else np.abs(r) > bar)
            r = r[i, j]
            t = np.sqrt(n - 2) * r / np.sqrt(1 - r * r)
            t[~np.isfinite(t)] = np.nan
            if t_crit is not None:
                kept = np.abs(t) > t_crit
                i, j, t = i[kept], j[kept], t[kept]
            beta = (g @ own.T)[i, j] / raw[i] if effects else np.full(len(i), np.nan)
            se = beta / t
            beta[~np.isfinite(beta)] = np.nan
            se[~np.isfinite(se)] = np.nan
            yield to, i, j, beta, se, t


def scan_block(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """beta, se, t of all pairs of rows of two arrays over the same individuals."""
    if g.shape[1] != e.shape[1]:
        raise ValueError("the two matrices have different numbers of individuals")
    n = g.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = (g @ e.T) / (g * g).sum(axis=1)[:, None]
        gc, ec = g - g.mean(axis=1, keepdims=True), e - e.mean(axis=1, keepdims=True)
        r = (gc @ ec.T) / np.sqrt((gc * gc).sum(axis=1)[:, None] * (ec * ec).sum(axis=1)[None, :])
        t = np.sqrt(n - 2) * r / np.sqrt(1 - r * r)
        t[~np.isfinite(t)] = np.nan
        se = beta / t
    beta[~np.isfinite(beta)] = np.nan
    se[~np.isfinite(se)] = np.nan
    return beta, se, t


def _blocks(matrix: DataFrame, block_bytes: int) -> Iterator[pd.DataFrame]:
    """A matrix table in blocks of rows on the driver, one at a time."""
    rows, held = [], 0
    for row in matrix.orderBy("feature_id").toLocalIterator():
        rows.append(row)
        held += 8 * len(row["values"])
        if held >= block_bytes:
            yield pd.DataFrame(rows, columns=matrix.columns)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=matrix.columns)


def _merge_moments(first: tuple, second: tuple) -> tuple:
    """(n, means, co-moments) of two sets of rows as those of both."""
    if first is None:
        return second
    n = first[0] + second[0]
    gap = second[1] - first[1]
    return n, first[1] + gap * (second[0] / n), first[2] + second[2] + np.outer(gap, gap) * (first[0] * second[0] / n)


def cross_moments(individuals: DataFrame, column: str, by: Column | None = None) -> DataFrame:
    """(i, j, n, mx, my, cxx, cyy, cxy) of all pairs i <= j of array positions (from 1): means,
    and sums of products of deviations from the means; per value of ``by`` (a long), if given.

    Each partition merges (n, means, co-moments) of its batches, and Spark merges those of the
    partitions about the common means, so no large sums cancel.  Only k(k+1)/2 rows per
    partition are shuffled, whatever the number of individuals.  Null arrays are left out.
    """
    ship_package(individuals.sparkSession)
    names = ["by", "i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            groups = batch.column(1).to_numpy(zero_copy_only=False)
            x = _matrix(batch.column(0).to_pylist()) if len(batch) else None
            for g in np.unique(groups):
                own = x[groups == g]
                mean = own.mean(axis=0)
                held[int(g)] = _merge_moments(held.get(int(g)), (len(own), mean, (own - mean).T @ (own - mean)))
        for g, (n, mean, co) in held.items():
            i, j = np.triu_indices(len(mean))
            square = np.diag(co)
            columns = [np.full(len(i), g), i + 1, j + 1, np.full(len(i), n), mean[i], mean[j], square[i], square[j], co[i, j]]
            yield pa.record_batch([pa.array(c) for c in columns], names=names)

    rows = individuals.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("x"), (F.lit(0) if by is None else by).cast("long").alias("by")).filter("by is not null")
    parts = cut_lineage(rows.mapInArrow(run, "by long, i long, j long, n long, mx double, my double, cxx double, cyy double, cxy double"))
    means = parts.filter("i = j").groupBy("by", "i").agg((F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("m"))
    near = parts.join(means.withColumnRenamed("m", "_mx"), ["by", "i"]).join(means.select("by", F.col("i").alias("j"), F.col("m").alias("_my")), ["by", "j"])
    dx, dy, n = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my"), F.col("n")
    merged = near.groupBy("by", "i", "j").agg(F.sum("n").alias("n"), F.first("_mx").alias("mx"), F.first("_my").alias("my"), *[F.sum(F.col(c) + n * x * y).alias(c) for c, x, y in (("cxx", dx, dx), ("cyy", dy, dy), ("cxy", dx, dy))])
    return merged.select(*(names if by is not None else names[1:]))


def moments_to_scan(moments: DataFrame) -> DataFrame:
    """(i, j, n, slope, r, t, se) of pairs of positions: i explains j.

    slope is that of the line through the origin; positions that do not vary, up to
    rounding, have no r.
    """
    raw = lambda c, x, y: F.col(c) + F.col("n") * F.col(x) * F.col(y)
    varies = lambda c, m: F.col(c) > F.col("n") * F.pow(F.col(m) * 1e-12, 2)
    r = F.when(varies("cxx", "mx") & varies("cyy", "my"), F.try_divide("cxy", F.sqrt("cxx") * F.sqrt("cyy")))
    scored = moments.select("i", "j", "n", F.try_divide(raw("cxy", "mx", "my"), raw("cxx", "mx", "mx")).alias("slope"), r.alias("r"))
    left = 1 - F.col("r") * F.col("r")
    scored = scored.withColumn("t", F.when(left > 0, F.sqrt((F.col("n") - 2).cast("double")) * F.try_divide(F.col("r"), F.sqrt(left))))
    return scored.withColumn("se", F.try_divide("slope", "t"))


def moments_to_covariance(moments: DataFrame) -> DataFrame:
    """(i, j, value): sample covariances of positions, upper triangle with diagonal."""
    return moments.filter("n > 1").select("i", "j", (F.col("cxy") / (F.col("n") - 1)).alias("value"))


def significance_share(scan: DataFrame, by: str, t_crit: float) -> DataFrame:
    """Share of a feature's pairs with |t| over a critical value."""
    return scan.groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.coalesce(F.abs("t") > t_crit, F.lit(False)).cast("double")).alias("share"))


def scan_legends(scan: DataFrame, snp_legend: DataFrame, gene_legend: DataFrame, t_crit: float) -> tuple[DataFrame, DataFrame]:
    """Both legends (feature_id, ...) with ``sig_genes``, a variant's share of genes whose |t| exceeds the
    critical value, and ``sig_snps``, a gene's share of variants; null for features without pairs."""
    share = lambda by, name: significance_share(scan, by, t_crit).select(F.col(by).alias("feature_id"), F.col("share").alias(name))
    return snp_legend.join(share("snp", "sig_genes"), "feature_id", "left"), gene_legend.join(share("gene", "sig_snps"), "feature_id", "left")


def scan_legends_of(snps: DataFrame, genes: DataFrame, snp_legend: DataFrame, gene_legend: DataFrame, t_crit: float) -> tuple[DataFrame, DataFrame]:
    """``scan_legends`` of the scan of two matrix tables, which is counted once and never listed."""
    shares = cut_lineage(scan_shares(snps, genes, t_crit))
    own = lambda is_gene, name: shares.filter(F.col("is_gene") == is_gene).select("feature_id", F.col("share").alias(name))
    return snp_legend.join(own(False, "sig_genes"), "feature_id", "left"), gene_legend.join(own(True, "sig_snps"), "feature_id", "left")


def covariance_to_correlation(pairs: DataFrame) -> DataFrame:
    """(i, j, value) covariances scaled by both variances; unit diagonal, null without variance."""
    var = pairs.filter("i = j").select(F.col("i").alias("k"), F.col("value").alias("v"))
    a, b = var.select(F.col("k").alias("i"), F.col("v").alias("vi")), var.select(F.col("k").alias("j"), F.col("v").alias("vj"))
    scaled = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.try_divide(F.col("value"), F.sqrt(F.greatest(F.col("vi") * F.col("vj"), F.lit(0.0)))))
    return pairs.join(a, "i").join(b, "j").select("i", "j", scaled.alias("value"))


def sparsify(pairs: DataFrame) -> DataFrame:
    """Pairs whose value is not zero."""
    return pairs.filter("value <> 0")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both triangles of an upper triangle."""
    return pairs.select("i", "j", "value").union(pairs.filter("i <> j").select(F.col("j"), F.col("i"), F.col("value")))


def sum_triplets(triplets: DataFrame) -> DataFrame:
    """(i, j, value) with repeated places added up."""
    return triplets.groupBy("i", "j").agg(F.sum("value").alias("value"))


def column_pointers(pairs: DataFrame) -> DataFrame:
    """(j, first, n): where each column's entries begin in column-compressed order."""
    counts = pairs.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, [], ["j"], F.col("n"), "_upto").select("j", (F.col("_upto") - F.col("n")).alias("first"), "n")


def from_column_pointers(entries: DataFrame, pointers: DataFrame, symmetric_half: bool = False) -> DataFrame:
    """(i, j, value) of a column-compressed matrix: entries (at, i, value) in storage order, at
    from 0, and pointers (j, first, n) as ``column_pointers`` makes them.

    An entry's column is the last one that begins at or before it: an as-of value over offsets,
    by ranges, so no task sees the whole stream.  Columns without entries are skipped.  With
    ``symmetric_half`` the other triangle is added.
    """
    begins = pointers.filter("n > 0").select(F.col("first").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("j").alias("own"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("value"))
    rows = begins.unionByName(entries.select(F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dict(pointers.dtypes)["j"]).alias("own"), F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value")))
    placed = last_value(rows, [], ["at", "kind"], F.col("own"), "j").filter("kind = 1").select("i", F.col("j").cast("long").alias("j"), "value")
    return symmetric(placed) if symmetric_half else placed


def genetic_score(matrix: DataFrame, effects: DataFrame) -> DataFrame:
    """(ind, score): sum over features of (value - feature mean) * effect, by array position.

    effects: (feature_id, beta).  Each partition adds up one array of the individuals, so the
    shuffle has one row per individual and partition, and no row per value.
    """
    ship_package(matrix.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0).to_pylist())
                part = batch.column(1).to_numpy() @ (x - x.mean(axis=1, keepdims=True))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["ind", "term"])

    rows = matrix.join(effects.filter("beta is not null"), "feature_id").select("values", F.col("beta").cast("double").alias("beta"))
    return rows.mapInArrow(run, "ind int, term double").groupBy("ind").agg(F.sum("term").alias("score"))


def single_trait_scan(snps: DataFrame, trait: np.ndarray) -> DataFrame:
    """(snp, beta, se, t) of one phenotype against all features."""
    spark = snps.sparkSession
    gene = spark.createDataFrame([(0, [float(x) for x in trait])], "feature_id long, values array<double>")
    return pair_scan(snps, gene).drop("gene")


def relationship_matrix(genotypes: DataFrame, min_frequency: float = 0.01, tile: int = 512) -> DataFrame:
    """(i, j, value), i <= j: Gram matrix of individuals over standardised dosages.

    Features with a minor allele frequency below the minimum or without variance are left
    out; the result is divided by the features used.  Individuals are cut into tiles:
    each batch of features gives one product per pair of tiles, which leaves the worker at once,
    so a worker holds a batch and a tile; Spark adds the products up, on the map side
    first, and can spill.
    """
    ship_package(genotypes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _matrix(batch.column(0).to_pylist())
            if not g.size:
                continue
            f = g.mean(axis=1) / 2
            z = _standardised(g[np.minimum(f, 1 - f) >= min_frequency])
            for a in range(0, g.shape[1], tile):
                for b in range(a, g.shape[1], tile):
                    product = z[:, a : a + tile].T @ z[:, b : b + tile]
                    i, j = np.indices(product.shape)
                    upper = i + a <= j + b
                    yield pa.record_batch([pa.array(c) for c in ((i + a)[upper], (j + b)[upper], product[upper], np.full(int(upper.sum()), len(z)))], names=["i", "j", "value", "used"])

    parts = genotypes.select("values").mapInArrow(run, "i long, j long, value double, used long")
    summed = parts.groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum("used").alias("used"))
    return summed.select("i", "j", F.try_divide("value", F.col("used").cast("double")).alias("value"))


def _standardised(rows: np.ndarray) -> np.ndarray:
    """Rows that vary, with mean 0 and variance 1."""
    sd = rows.std(axis=1, ddof=1) if len(rows) else np.zeros(0)
    rows, sd = rows[sd > 0], sd[sd > 0]
    return (rows - rows.mean(axis=1, keepdims=True)) / sd[:, None] if len(rows) else rows


def _gram_times(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """Z' Z block of the standardised feature rows Z: an (individuals x columns) array."""
    shared = matrix.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.T.shape)
        for batch in batches:
            if len(batch):
                z = _standardised(_matrix(batch.column(0).to_pylist()))
                total += (z @ shared.value).T @ z
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["column", "values"])

    parts = matrix.select("values").mapInArrow(run, "column long, values array<double>")
    sums = parts.select("column", F.posexplode("values").alias("ind", "value")).groupBy("column", "ind").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(block.shape)
    out[sums.column("ind").to_numpy(), sums.column("column").to_numpy()] = sums.column("value").to_numpy()
    return out


def tall_qr(matrix: DataFrame, block: np.ndarray, fan_in: int = 32) -> np.ndarray:
    """The R of a QR of Z block, for the standardised feature rows Z, a tall and narrow matrix.

    Each partition keeps the R of its rows; then the R of ``fan_in`` partitions are stacked
    and decomposed again, and so on, so no task sees more than that many.
    """
    shared = matrix.sparkSession.sparkContext.broadcast(block)
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if len(batch):
                r = np.linalg.qr(np.vstack([r, _standardised(_matrix(batch.column(0).to_pylist())) @ shared.value]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    def stack(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, width)) for x in frame["r"]]), mode="r")
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // fan_in], "r": [r.ravel().tolist()]})

    parts = cut_lineage(matrix.select("values").mapInArrow(run, "part long, r array<double>"))
    while parts.count() > fan_in:
        parts = cut_lineage(parts.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(stack, "part long, r array<double>"))
    held = [np.reshape(row["r"], (-1, width)) for row in parts.orderBy("part").collect()]
    return np.linalg.qr(np.vstack([*held, np.zeros((width, width))]), mode="r")


def principal_components(matrix: DataFrame, k: int, oversample: int = 10, tolerance: float = 1e-12, max_rounds: int = 40, seed: int = 1) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Variances, scores (ind, component, score) and loadings (feature_id, component, loading)
    of the first k principal components; features are centred and scaled.

    Randomised block Krylov range finder: a random block of k + oversample columns is
    multiplied by Z' Z once per round, one pass over the feature rows, until the k leading
    values settle; a tall-skinny QR of Z times the basis then gives them without squaring.  The
    driver holds the basis, individuals times a few blocks, and never a Gram matrix.
    Signs are arbitrary; features without variance have no loading; with fewer than k
    components there are fewer rows.
    """
    spark = matrix.sparkSession
    ship_package(spark)
    first = matrix.select(F.size("values").alias("n")).first()
    if first is None:
        return np.zeros(0), spark.createDataFrame([], "ind long, component int, score double"), spark.createDataFrame([], "feature_id long, component int, loading double")
    n = first["n"]
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, k + oversample))))[0]
    basis, image, before = block, _gram_times(matrix, block), np.zeros(k)
    for _ in range(max_rounds):
        leading = np.linalg.eigvalsh(basis.T @ image)[::-1][:k]
        if basis.shape[1] >= n or (len(leading) == k and np.abs(leading - before).max() <= tolerance * leading[0]):
            break
        before = np.resize(leading, k)
        fresh = image[:, -block.shape[1] :]
        for _ in range(2):  # twice, so that rounding leaves no part of the basis
            fresh = fresh - basis @ (basis.T @ fresh)
        q, r = np.linalg.qr(fresh)
        keep = np.abs(np.diag(r)) > 1e-10 * max(leading[0], 1e-300)
        block = q[:, keep][:, : n - basis.shape[1]]
        if not block.shape[1]:
            break
        basis, image = np.hstack([basis, block]), np.hstack([image, _gram_times(matrix, block)])
    _, value, right = np.linalg.svd(tall_qr(matrix, basis))
    used = [c for c in range(min(k, len(value))) if value[c] > 1e-9 * value[0]]
    vectors, value = (basis @ right.T)[:, used], value[used]
    shared = spark.sparkContext.broadcast(vectors / value)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist()) if len(batch) else np.zeros((0, n))
            varies = x.std(axis=1) > 0 if len(x) else np.zeros(0, bool)
            weights = _standardised(x) @ shared.value
            ids = np.repeat(batch.column(0).to_numpy()[varies], weights.shape[1])
            yield pa.record_batch([pa.array(ids), pa.array(np.tile(np.arange(1, weights.shape[1] + 1, dtype=np.int32), len(weights))), pa.array(weights.ravel())], names=["feature_id", "component", "loading"])

    loadings = matrix.select(F.col("feature_id").cast("long").alias("feature_id"), "values").mapInArrow(load, "feature_id long, component int, loading double")
    scores = [(int(a), c + 1, float(vectors[a, c] * value[c])) for c in range(len(value)) for a in range(n)]
    return value**2 / (n - 1), spark.createDataFrame(scores, "ind long, component int, score double"), loadings
