"""Weighted regressions per group from sums, elastic nets per gene, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import ship_package
from lociweave.functions.tdist import t_tail


def origin_regression(df: DataFrame, by: list[str], y: Column, x: Column, weight: Column) -> DataFrame:
    """Weighted regression through the origin per group: (by, n, slope, se, t, sigma, r2).

    Closed form of four sums, so one partial aggregate; se is null for one row.
    """
    rows = df.select(*by, y.cast("double").alias("_y"), x.cast("double").alias("_x"), weight.cast("double").alias("_w")).dropna(subset=["_y", "_x", "_w"])
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_xx"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("_xy"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_yy"))
    slope = F.try_divide("_xy", "_xx")
    rss = F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0))
    out = s.withColumn("slope", slope).withColumn("sigma", F.sqrt(F.try_divide(rss, (F.col("n") - 1).cast("double"))))
    out = out.withColumn("se", F.try_divide(F.col("sigma"), F.sqrt("_xx"))).withColumn("t", F.try_divide("slope", "se"))
    return out.withColumn("r2", 1 - F.try_divide(rss, F.col("_yy"))).select(*by, "n", "slope", "se", "t", "sigma", "r2")


def intercept_regression(df: DataFrame, by: list[str], y: Column, x: Column, weight: Column) -> DataFrame:
    """Weighted regression with intercept per group: (by, n, intercept, slope, se, t, sigma, r2).

    Sums are taken about the group's weighted means in a second aggregate, which keeps
    large magnitudes from cancelling; groups without spread in x give nulls.
    """
    rows = df.select(*by, y.cast("double").alias("_y"), x.cast("double").alias("_x"), weight.cast("double").alias("_w")).dropna(subset=["_y", "_x", "_w"])
    means = rows.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")).alias("_mx"), F.try_divide(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).alias("_my"))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    s = rows.join(means, on).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * dx * dx).alias("_xx"), F.sum(F.col("_w") * dx * dy).alias("_xy"), F.sum(F.col("_w") * dy * dy).alias("_yy"))
    rss = F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0))
    out = s.withColumn("slope", F.when(F.col("_xx") > 0, F.try_divide("_xy", "_xx"))).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    out = out.withColumn("sigma", F.when(F.col("n") > 2, F.sqrt(F.try_divide(rss, (F.col("n") - 2).cast("double"))))).withColumn("se", F.try_divide(F.col("sigma"), F.sqrt("_xx")))
    return out.withColumn("t", F.try_divide("slope", "se")).withColumn("r2", 1 - F.try_divide(rss, F.col("_yy"))).select(*by, "n", "intercept", "slope", "se", "t", "sigma", "r2")


def design_regression(df: DataFrame, by: list[str], y: Column, terms: dict[str, Column], weight: Column) -> DataFrame:
    """Weighted least squares of any small design per group: (by, n, term, estimate, se, t).

    One aggregate gathers the normal equations, a row of k(k+1)/2 + k + 2 sums per group;
    only those rows are solved in Python.  A singular design gives nulls.
    """
    ship_package(df.sparkSession)
    names = list(terms)
    k = len(names)
    rows = df.select(*by, y.cast("double").alias("_y"), weight.cast("double").alias("_w"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(terms.values())]).dropna(subset=["_y", "_w", *[f"_x{i}" for i in range(k)]])
    w = F.col("_w")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(w * F.col("_y") * F.col("_y")).alias("yy")]
    sums += [F.sum(w * F.col(f"_x{i}") * F.col("_y")).alias(f"b{i}") for i in range(k)]
    sums += [F.sum(w * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    grouped = rows.groupBy(*by).agg(*sums)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = np.stack([np.stack([f[f"a{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(k)], axis=1) for i in range(k)], axis=1)
            b = np.stack([f[f"b{i}"].to_numpy(float) for i in range(k)], axis=1)
            n, yy = f["n"].to_numpy(), f["yy"].to_numpy(float)
            # terms of unit length, so that large and small ones solve alike
            length = np.sqrt(np.einsum("gii->gi", a))
            scale = np.where(length > 0, 1 / np.where(length > 0, length, 1), 0.0)
            unit = a * scale[:, :, None] * scale[:, None, :]
            full = np.linalg.matrix_rank(unit) == k if len(f) else np.zeros(0, bool)
            inverse = np.linalg.inv(np.where(full[:, None, None], unit, np.eye(k)))
            est = np.einsum("gij,gj->gi", inverse, b * scale) * scale
            rss = np.maximum(yy - np.einsum("gi,gi->g", est, b), 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                se = np.sqrt(np.maximum(np.einsum("gii->gi", inverse), 0) * (rss / (n - k))[:, None]) * scale
                se[n <= k] = np.nan
                est[~full], se[~full] = np.nan, np.nan
                t = np.where(se > 0, est / se, np.nan)
            out = f[[*by, "n"]].loc[f.index.repeat(k)].reset_index(drop=True)
            yield out.assign(term=np.tile(names, len(f)), estimate=est.ravel(), se=se.ravel(), t=t.ravel())

    kinds = dict(df.select(*by).dtypes)
    solved = grouped.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, term string, estimate double, se double, t double")
    return solved.select(*by, "n", "term", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("estimate", "se", "t")])


def with_p(fit: DataFrame, df: Column, tails: int = 2) -> DataFrame:
    """Adds the tail probability of the column t."""
    ship_package(fit.sparkSession)
    return fit.withColumn("p", t_tail(F.col("t"), df, tails))


def fitted_rows(df: DataFrame, fit: DataFrame, by: list[str], y: Column, x: Column) -> DataFrame:
    """Rows with .fitted and .resid of their group's regression."""
    coefficients = fit.select(*by, *(["intercept"] if "intercept" in fit.columns else [F.lit(0.0).alias("intercept")]), "slope")
    return df.join(coefficients, by).withColumn("fitted", F.col("intercept") + F.col("slope") * x).withColumn("resid", y - F.col("fitted")).drop("intercept", "slope")


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_difference, se, t, df) of two columns over rows that have both."""
    d = (F.col(a) - F.col(b)).cast("double")
    s = df.select(d.alias("d")).dropna().agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"))
    return s.select("n", "mean_difference", F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double"))).alias("se")).withColumn("t", F.try_divide("mean_difference", "se")).withColumn("df", F.col("n") - 1)


#: Bytes of the correlation matrices that are fitted in one batch, at least one matrix.
BATCH_BYTES = 128 << 20
#: Columns of a table of fits.
FIT_COLUMNS = ["gene", "step", "lambda", "cv_mean", "cv_sd", "nzero", "weights"]
FIT_SCHEMA = "gene long, step int, lambda double, cv_mean double, cv_sd double, nzero long, weights array<struct<snp: long, weight: double>>"


def elastic_net_path(gram: np.ndarray, xy: np.ndarray, alpha: float, lambdas: np.ndarray, tolerance: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """Coefficients (lambdas x problems x features) of a batch of problems, from correlations of
    features (problems x features x features) and with the response (problems x features).

    Batched active-set coordinate descent: all problems take a coordinate's step at once;
    only coordinates that are not zero somewhere are cycled until they settle, then every
    coordinate is looked at and those that leave zero join them.  Lambdas (problems x lambdas) are
    warm-started.  A feature without variance has a zero row and stays zero.
    """
    diagonal = np.einsum("bii->bi", gram)
    beta, fitted = np.zeros_like(xy), np.zeros_like(xy)  # fitted = gram @ beta
    out = []

    def cycle(features: np.ndarray, lam: np.ndarray) -> float:
        largest = 0.0
        for j in features:
            z = xy[:, j] - fitted[:, j] + diagonal[:, j] * beta[:, j]
            scale = diagonal[:, j] + lam * (1 - alpha)
            past = np.abs(z) - lam * alpha
            past = np.where(past > 1e-12 * lam * alpha, past, 0.0)  # at the largest lambda all weights are zero
            new = np.where(diagonal[:, j] > 0, np.sign(z) * past / np.where(scale > 0, scale, 1), 0.0)
            step = new - beta[:, j]
            if step.any():
                fitted[:] += gram[:, :, j] * step[:, None]
                beta[:, j] = new
                largest = max(largest, float(np.abs(step).max()))
        return largest

    for k in range(lambdas.shape[1]):
        lam, every = lambdas[:, k], np.arange(xy.shape[1])
        for _ in range(rounds):
            if cycle(every, lam) < tolerance:
                break
            active = np.flatnonzero((beta != 0).any(axis=0))
            for _ in range(rounds):
                if cycle(active, lam) < tolerance:
                    break
        out.append(beta.copy())
    return np.array(out)


def _problem(n: float, mean: np.ndarray, co: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlations of features, with the response, sds) of moments whose last position is the response."""
    sd = np.sqrt(np.diag(co)[:-1] / n)
    sd = np.where(np.diag(co)[:-1] > n * (1e-12 * mean[:-1]) ** 2, sd, 0.0)
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    return co[:-1, :-1] / n * scale[:, None] * scale[None, :], co[:-1, -1] / n * scale, scale


def fit_elastic_net(folds: list[tuple[float, np.ndarray, np.ndarray]], alpha: float = 0.95, n_lambdas: int = 40, ratio: float = 0.01) -> dict[str, np.ndarray]:
    """The path and its cross-validation from (n, means, co-moments) of each fold, whose last
    position is the response: lambda, cv_mean, cv_sd, nzero and weights on the features' own scale.

    The whole data and the data without each fold are one batch of problems.  cv_mean is the
    mean squared error on the held-out folds, weighted by their rows, cv_sd its standard error.
    """
    from lociweave.operators.matrix import _merge_moments

    others = [None] * len(folds)
    for f in range(len(folds)):
        for g, part in enumerate(folds):
            if g != f:
                others[f] = _merge_moments(others[f], part)
    whole = None
    for part in folds:
        whole = _merge_moments(whole, part)
    problems = [whole, *[o for o in others if o is not None]]
    top = np.abs(_problem(*whole)[1]).max(initial=0) / alpha
    lambdas = top * np.logspace(0, np.log10(ratio), n_lambdas) if top > 0 else np.zeros(1)
    at_once = max(1, BATCH_BYTES // (8 * len(whole[1]) ** 2))  # wide windows go through in several batches
    paths = []
    for at in range(0, len(problems), at_once):
        gram, xy, scale = (np.array(x) for x in zip(*[_problem(*p) for p in problems[at : at + at_once]], strict=True))
        paths.append(elastic_net_path(gram, xy, alpha, np.broadcast_to(lambdas, (len(xy), len(lambdas)))) * scale[None])
    path = np.concatenate(paths, axis=1)
    errors, sizes = [], []
    for f, (n, mean, co) in enumerate(folds if len(problems) > 1 else []):
        beta = path[:, f + 1]
        _, trained, _ = problems[f + 1]
        shift = mean[-1] - trained[-1] - beta @ (mean[:-1] - trained[:-1])
        errors.append((co[-1, -1] - 2 * beta @ co[:-1, -1] + np.einsum("ki,ij,kj->k", beta, co[:-1, :-1], beta)) / n + shift**2)
        sizes.append(n)
    nothing = np.full(len(lambdas), np.nan)
    mean = np.average(errors, axis=0, weights=sizes) if errors else nothing
    sd = np.sqrt(np.average((np.array(errors) - mean) ** 2, axis=0, weights=sizes) / (len(errors) - 1)) if len(errors) > 1 else nothing
    return {"lambda": lambdas, "cv_mean": mean, "cv_sd": sd, "nzero": (path[:, 0] != 0).sum(axis=1), "weights": path[:, 0]}


def elastic_nets(moments: DataFrame, sets: DataFrame, alpha: float = 0.95, n_lambdas: int = 40, ratio: float = 0.01) -> DataFrame:
    """One row per gene and step of its path: (gene, step, lambda, cv_mean, cv_sd, nzero,
    weights array<struct<snp, weight>>), weights of all features of the gene.

    moments: ``cross_moments`` of all positions by fold, column ``by``; sets: (gene, snp) positions.
    Spark sums the moments once for all genes, and a gene gathers those of its own window:
    p(p+1)/2 numbers per fold, whatever the number of individuals.  Genes with one
    variant or none are skipped.
    """
    ship_package(moments.sparkSession)
    own = sets.select(F.col("gene").cast("long").alias("gene"), F.col("snp").cast("long").alias("snp")).filter("gene <> snp").distinct()
    enough = own.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gene")
    members = own.join(enough, "gene", "left_semi").unionByName(enough.select("gene", F.col("gene").alias("snp")))
    pairs = members.withColumnRenamed("snp", "i").join(members.select("gene", F.col("snp").alias("j")), "gene").filter("i <= j")
    gathered = pairs.join(moments, ["i", "j"]).select("gene", "by", "i", "j", "n", "mx", "my", "cxy")

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        gene = int(key[0])
        snps = [s for s in sorted(set(frame["i"]) | set(frame["j"])) if s != gene]
        place = {s: k for k, s in enumerate([*snps, gene])}
        folds = []
        for _, part in frame.groupby("by", sort=True):
            i, j = part["i"].map(place).to_numpy(), part["j"].map(place).to_numpy()
            mean, co = np.zeros(len(place)), np.zeros((len(place), len(place)))
            mean[i], mean[j] = part["mx"], part["my"]
            co[i, j] = co[j, i] = part["cxy"]
            folds.append((float(part["n"].iloc[0]), mean, co))
        return _fit_rows(gene, snps, folds, alpha, n_lambdas, ratio)

    return _without_nan(gathered.groupBy("gene").applyInPandas(fit, FIT_SCHEMA))


def elastic_nets_of_values(cis: DataFrame, alpha: float = 0.95, folds: int = 10, n_lambdas: int = 40, ratio: float = 0.01) -> DataFrame:
    """``elastic_nets`` of matrix tables: cis has one row per gene and cis variant, (gene, snp, values
    array, y array).

    For windows with more variants than individuals, where the values are the smaller form: a
    group is a gene's cis window, which does not grow with the genome.  Folds are by
    position, so reruns agree.  Genes with one variant or none are skipped.
    """
    ship_package(cis.sparkSession)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < 2:
            return pd.DataFrame(columns=FIT_COLUMNS)
        frame = frame.sort_values("snp")
        rows = np.array([*frame["values"], frame["y"].iloc[0]], float)
        parts = [rows[:, f :: min(folds, rows.shape[1])] for f in range(min(folds, rows.shape[1]))]
        means = [p.mean(axis=1) for p in parts]
        return _fit_rows(int(key[0]), list(frame["snp"]), [(float(p.shape[1]), m, (p - m[:, None]) @ (p - m[:, None]).T) for p, m in zip(parts, means, strict=True)], alpha, n_lambdas, ratio)

    return _without_nan(cis.select(F.col("gene").cast("long").alias("gene"), F.col("snp").cast("long").alias("snp"), "values", "y").groupBy("gene").applyInPandas(fit, FIT_SCHEMA))


def _fit_rows(gene: int, snps: list, folds: list[tuple[float, np.ndarray, np.ndarray]], alpha: float, n_lambdas: int, ratio: float) -> pd.DataFrame:
    made = fit_elastic_net(folds, alpha, n_lambdas, ratio)
    rows = [(gene, k + 1, float(lam), float(made["cv_mean"][k]), float(made["cv_sd"][k]), int(made["nzero"][k]), [{"snp": int(s), "weight": float(w)} for s, w in zip(snps, made["weights"][k], strict=True)]) for k, lam in enumerate(made["lambda"])]
    return pd.DataFrame(rows, columns=FIT_COLUMNS)


def _without_nan(fits: DataFrame) -> DataFrame:
    return fits.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c.startswith("cv_") else F.col(c) for c in FIT_COLUMNS])


def path_overall(fits: DataFrame) -> DataFrame:
    """(gene, step, lambda, cv_mean, cv_sd, nzero): the cross-validated path of each gene."""
    return fits.drop("weights")


def path_choices(fits: DataFrame) -> DataFrame:
    """(gene, lambda_min, lambda_1se, cv_min): the lambda with the least cross-validated error and
    the largest one within a standard error of it, each the larger of equals."""
    best = fits.groupBy("gene").agg(F.min(F.struct("cv_mean", (-F.col("lambda")).alias("less"), "cv_sd")).alias("best"))
    rows = fits.join(best, "gene").filter(F.col("cv_mean") <= F.col("best.cv_mean") + F.coalesce("best.cv_sd", F.lit(0.0)))
    return rows.groupBy("gene").agg((-F.first("best")["less"]).alias("lambda_min"), F.max("lambda").alias("lambda_1se"), F.first("best")["cv_mean"].alias("cv_min"))


def path_weights(fits: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(gene, step, lambda, snp, weight): the weights that are not zero, at every lambda, or at each
    gene's lambda_min if ``path_choices`` are given."""
    rows = fits if chosen is None else fits.join(chosen.select("gene", F.col("lambda_min").alias("lambda")), ["gene", "lambda"])
    return rows.select("gene", "step", "lambda", F.inline("weights")).filter("weight <> 0")


def nonzero_share(weights: DataFrame, by: str = "gene", weight: str = "weight") -> DataFrame:
    """(by, n, nonzero, share) of weights that are not zero; null counts as zero."""
    nz = (F.coalesce(F.col(weight), F.lit(0.0)) != 0).cast("int")
    return weights.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(nz).alias("nonzero"), F.avg(nz.cast("double")).alias("share"))


def group_summary(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group: rows, and mean, variance and mean absolute value of columns."""
    parts = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        parts += [F.avg(c).alias(f"mean_{c}"), F.var_samp(c).alias(f"var_{c}"), F.avg(F.abs(c)).alias(f"mean_abs_{c}")]
    return df.groupBy(by).agg(*parts)
