"""Spike-and-slab mixtures of effects: EM, inclusion probability, likelihood grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions.columns import log_normal_density

#: The slab variance never falls below this: the published step can turn negative.
FLOOR = 1e-12


def inclusion_probability(beta: Column, error: Column, pi: Column, slab: Column) -> Column:
    """Posterior probability of the slab N(0, slab + error^2) against the spike N(0, error^2)."""
    odds = F.ln(F.try_divide(1 - pi, pi)) + log_normal_density(beta, error * error) - log_normal_density(beta, slab + error * error)
    return F.try_divide(F.lit(1.0), 1 + F.exp(F.least(odds, F.lit(700.0))))


def em_step(effects: DataFrame, params: DataFrame, by: str, beta: str = "beta", error: str = "se") -> DataFrame:
    """One E and M step: (by, pi, slab, loglik) from (by, pi, slab).

    One join with the parameter table, a row per group, and one partial aggregate.
    loglik is that of the parameters the step starts from.
    """
    b, s = F.col(beta), F.col(error)
    mu = inclusion_probability(b, s, F.col("pi"), F.col("slab"))
    on = log_normal_density(b, F.col("slab") + s * s) + F.ln("pi")
    off = log_normal_density(b, s * s) + F.ln(1 - F.col("pi"))
    both = F.greatest(on, off) + F.log1p(F.exp(-F.abs(on - off)))
    rows = effects.join(params.select(by, "pi", "slab"), by).withColumn("_mu", mu).withColumn("_ll", both)
    moved = F.try_divide(F.sum(F.col("_mu") * (b * b - s * s)), F.sum("_mu"))
    return rows.groupBy(by).agg(F.avg("_mu").alias("pi"), F.greatest(moved, F.lit(FLOOR)).alias("slab"), F.sum("_ll").alias("loglik"))


def fit_em(effects: DataFrame, by: str, pi: float = 0.1, slab: float = 1.0, tolerance: float = 1e-6, max_steps: int = 200, beta: str = "beta", error: str = "se") -> DataFrame:
    """(by, pi, slab, loglik, steps, converged) of each group.

    The state between steps is the parameter table, a row per group.
    """
    from lociweave.cluster import cut_lineage

    params = cut_lineage(effects.select(by).distinct().select(by, F.lit(pi).alias("pi"), F.lit(slab).alias("slab")))
    for step in range(1, max_steps + 1):
        after = cut_lineage(em_step(effects, params, by, beta, error))
        old = params.select(by, F.col("pi").alias("_pi"), F.col("slab").alias("_slab"))
        gap = after.join(old, by).agg(F.max(F.greatest(F.abs(F.col("pi") - F.col("_pi")), F.abs(F.col("slab") - F.col("_slab"))))).first()[0] or 0.0
        params = after
        if gap < tolerance:
            break
    return params.select(by, "pi", "slab", "loglik", F.lit(step).alias("steps"), F.lit(gap < tolerance).alias("converged"))


def likelihood_grid(effects: DataFrame, grid: list[tuple[float, float]], beta: str = "beta", error: str = "se") -> DataFrame:
    """(pi, tau, negative_loglik): the negated expected complete log-likelihood at each grid point.

    Each row is expanded by the grid, a fixed list of parameters, and summed on the map side.
    """
    points = F.array(*[F.struct(F.lit(float(p)).alias("pi"), F.lit(float(t)).alias("tau")) for p, t in grid])
    b, s = F.col(beta), F.col(error)
    rows = effects.select(b.alias(beta), s.alias(error), F.inline(points))
    mu = inclusion_probability(b, s, F.col("pi"), F.col("tau"))
    on = log_normal_density(b, F.col("tau") + s * s) + F.ln("pi")
    off = log_normal_density(b, s * s) + F.ln(1 - F.col("pi"))
    return rows.groupBy("pi", "tau").agg((-F.sum(mu * on + (1 - mu) * off)).alias("negative_loglik"))


def pair_likelihood(edges: DataFrame, effects: DataFrame, slab: float) -> DataFrame:
    """(src, mean_density): mean over a variant's links of N(row beta; 0, row_se^2 (1 + r^2 / col_se^2) slab).

    edges: (src, dst, weight); effects: (snp, beta, se).
    """
    a = effects.select(F.col("snp").alias("src"), F.col("beta").alias("row_beta"), F.col("se").alias("row_se"))
    b = effects.select(F.col("snp").alias("dst"), F.col("se").alias("col_se"))
    variance = F.col("row_se") * F.col("row_se") * (1 + F.try_divide(F.col("weight") * F.col("weight"), F.col("col_se") * F.col("col_se"))) * slab
    density = F.exp(-F.col("row_beta") * F.col("row_beta") / (2 * variance)) / F.sqrt(2 * math.pi * variance)
    return edges.join(a, "src").join(b, "dst").groupBy("src").agg(F.avg(density).alias("mean_density"))


def effect_scale(effects: DataFrame, by: str, n: float, heritability: float, pi: float) -> DataFrame:
    """(by, nsum, slab_sd): nsum = sum 1 / (n s^2) with s^2 = se^2 + beta^2 / n, slab_sd = sqrt(h / (pi nsum))."""
    s2 = F.col("se") * F.col("se") + F.col("beta") * F.col("beta") / n
    sums = effects.groupBy(by).agg(F.sum(F.try_divide(F.lit(1.0), n * s2)).alias("nsum"))
    return sums.withColumn("slab_sd", F.sqrt(F.try_divide(F.lit(heritability), pi * F.col("nsum"))))
