"""Operators against plain numpy and on hand-made cases."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import columns as c
from lociweave.functions.tdist import t_critical, t_tail, upper_tail
from lociweave.operators import graph, ld, matrix, mixture, regress, relational
from lociweave.plans import model_queries, studies

RNG = np.random.default_rng(7)
N_IND, N_SNP, N_GENE = 30, 40, 12
G = RNG.integers(0, 3, (N_SNP, N_IND)).astype(float)
G[5] = 1.0  # a variant without variance
E = RNG.normal(size=(N_GENE, N_IND))
E[3] = 2 * G[7] + 1  # a perfect fit
MAP = np.cumsum(np.where(np.arange(N_SNP) % 9 == 8, 2.7, 0.31))


def frame(spark, values, **columns):
    rows = [(i + 1, [float(x) for x in v], *[col[i] for col in columns.values()]) for i, v in enumerate(values)]
    kinds = "".join(f", {k} {'double' if isinstance(v[0], float) else 'long'}" for k, v in columns.items())
    return spark.createDataFrame(rows, "feature_id long, values array<double>" + kinds)


def test_residuals_are_orthogonal_to_the_basis(spark):
    cov = spark.createDataFrame([(i, float(RNG.normal()), float(RNG.normal()), 1.0) for i in range(N_IND)], "id int, a double, b double, one double")
    q = matrix.covariate_basis(cov, "id", ["a", "b", "one"])
    assert q.shape == (N_IND, 3)  # a covariate that repeats the intercept adds nothing
    left = np.array([r["values"] for r in matrix.residualise(frame(spark, G), q).orderBy("feature_id").collect()])
    assert np.abs(left @ q).max() < 1e-9
    assert np.allclose(left, G - G @ q @ q.T)


def test_residualise_checks_sizes(spark):
    with pytest.raises(Exception, match="number of individuals"):
        matrix.residualise(frame(spark, G[:, :5]), np.eye(N_IND)[:, :2]).collect()


@pytest.mark.parametrize("block_bytes", [1, 64 << 20])
def test_pair_scan(spark, block_bytes):
    got = {(r["snp"], r["gene"]): r for r in matrix.pair_scan(frame(spark, G), frame(spark, E), block_bytes=block_bytes).collect()}
    assert len(got) == N_SNP * N_GENE
    for (s, g), r in got.items():
        x, y = G[s - 1], E[g - 1]
        assert math.isclose(r["beta"], (x @ y) / (x @ x), abs_tol=1e-9)
        if s == 6:
            assert r["t"] is None and r["se"] is None
        elif (s, g) != (8, 4):
            rho = np.corrcoef(x, y)[0, 1]
            t = math.sqrt(N_IND - 2) * rho / math.sqrt(1 - rho * rho)
            assert math.isclose(r["t"], t, rel_tol=1e-6, abs_tol=1e-9)


def test_thresholded_scan_is_a_subset(spark):
    full = matrix.pair_scan(frame(spark, G), frame(spark, E))
    cut = matrix.pair_scan(frame(spark, G), frame(spark, E), t_crit=1.5)
    want = {(r["snp"], r["gene"]) for r in full.filter("abs(t) > 1.5").collect()}
    assert {(r["snp"], r["gene"]) for r in cut.collect()} == want


def test_single_trait_and_moments_agree(spark):
    scan = {r["snp"]: r["t"] for r in matrix.single_trait_scan(frame(spark, G), E[0]).collect()}
    people = spark.createDataFrame([([*map(float, G[:, i]), float(E[0, i])],) for i in range(N_IND)], "x array<double>")
    by_moments = matrix.moments_to_scan(matrix.cross_moments(people, "x").filter(F.col("j") == N_SNP + 1)).collect()
    for r in by_moments:
        if r["i"] <= N_SNP and scan[r["i"]] is not None:
            assert math.isclose(r["t"], scan[r["i"]], rel_tol=1e-6, abs_tol=1e-8)


def test_covariance_to_correlation(spark):
    s = np.cov(RNG.normal(size=(7, 50)))
    rows = [(i + 1, j + 1, float(s[i, j])) for i in range(7) for j in range(i, 7)]
    got = matrix.covariance_to_correlation(spark.createDataFrame(rows, "i long, j long, value double")).collect()
    d = np.sqrt(np.diag(s))
    for r in got:
        assert math.isclose(r["value"], s[r["i"] - 1, r["j"] - 1] / d[r["i"] - 1] / d[r["j"] - 1], rel_tol=1e-12)


def dense_ld(h, positions, m=85, ne=11490.672741, cutoff=1e-3):
    theta = c.panel_theta(m)
    s = np.cov(h)
    d = np.abs(positions[:, None] - positions[None, :])
    decay = np.exp(-4 * ne * d / 100 / (2 * m))
    decay[decay < cutoff] = 0
    shrunk = (1 - theta) ** 2 * s * decay
    np.fill_diagonal(shrunk, (1 - theta) ** 2 * np.diag(s) + 0.5 * theta * (1 - 0.5 * theta))
    v = np.sqrt(np.diag(shrunk))
    r = shrunk / v[:, None] / v[None, :]
    np.fill_diagonal(r, 1)
    return r


def test_ld_against_dense(spark):
    assert math.isclose(c.panel_theta(85), 0.00102911160, rel_tol=1e-8)
    assert math.isclose(c.band_width(1e-3, 85, 11490.672741), 2.5549383, rel_tol=1e-7)
    want = dense_ld(G, MAP)
    rows = ld.ld_pairs(frame(spark, G, map=[float(x) for x in MAP]), key=None).collect()
    got = {(r["i"], r["j"]): r["r"] for r in rows}
    assert len(got) == len(rows)
    for i in range(N_SNP):
        for j in range(i, N_SNP):
            if (i + 1, j + 1) in got:
                assert math.isclose(got[i + 1, j + 1], want[i, j], rel_tol=1e-9, abs_tol=1e-12)
            else:
                assert want[i, j] == 0


def test_ld_shuffled_rows_and_edges(spark):
    order = RNG.permutation(N_SNP)
    df = frame(spark, G, map=[float(x) for x in MAP]).orderBy(F.rand(3)).repartition(3)
    pairs = ld.ld_pairs(df, key=None)
    edges = ld.ld_edges(pairs, 0.1).collect()
    want = dense_ld(G, MAP)
    assert len(edges) == (np.abs(np.triu(want, 1)) > 0.1).sum()
    assert len(order) == N_SNP
    assert ld.concat_pairs(pairs, pairs).count() == pairs.count()


def test_components_and_colouring_against_plain_python(spark):
    edges = [(int(a), int(b)) for a, b in RNG.integers(0, 60, (50, 2)) if a != b] + [(i, i + 1) for i in range(100, 130)]
    nodes = list(range(131))
    v, e = spark.createDataFrame([(n,) for n in nodes], "vertex long"), spark.createDataFrame(edges, "src long, dst long")
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["vertex"]: r["group"] for r in graph.subgraphs(v, e).collect()} == {n: root(n) for n in nodes}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}
    first_fit = {}
    for n in nodes:
        first_fit[n] = next(k for k in range(200) if k not in {first_fit.get(m) for m in near[n]})
    small = [n for n in nodes if n < 60 or n > 120]
    vs = v.filter(F.col("vertex").isin(small))
    es = e.filter(F.col("src").isin(small) & F.col("dst").isin(small))
    near_small = {n: near[n] & set(small) for n in small}
    expected = {}
    for n in small:
        expected[n] = next(k for k in range(200) if k not in {expected.get(m) for m in near_small[n]})
    assert {r["vertex"]: r["color"] for r in graph.colouring(vs, es, priority="id").collect()} == expected


def test_empty_graph(spark):
    v, e = spark.createDataFrame([], "vertex long"), spark.createDataFrame([], "src long, dst long")
    assert graph.subgraphs(v, e).count() == 0
    assert graph.colouring(v, e).count() == 0


def test_t_distribution():
    # known quantiles of Student's t
    for p, df, t in ((0.05, 10, 2.2281388520), (0.01, 30, 2.7499956536), (0.05, 337, 1.9670), (0.001, 5, 6.8688266259)):
        assert math.isclose(t_critical(p, df), t, rel_tol=1e-4)
    assert math.isclose(float(upper_tail(np.array([0.0]), np.array([5.0]))[0]), 0.5, rel_tol=1e-9)
    assert math.isclose(float(upper_tail(np.array([1.0]), np.array([1.0]))[0]), 0.25, rel_tol=1e-9)
    assert 0 < float(upper_tail(np.array([40.0]), np.array([337.0]))[0]) < 1e-100


def test_t_tail_keeps_nulls(spark):
    rows = spark.createDataFrame([(2.2281388520,), (None,), (-2.2281388520,)], "t double").select(t_tail(F.col("t"), 10).alias("p")).collect()
    assert math.isclose(rows[0]["p"], 0.05, rel_tol=1e-6) and rows[1]["p"] is None and math.isclose(rows[2]["p"], 0.05, rel_tol=1e-6)


def test_regression_gates_and_small_groups(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.1), ("a", 3.0, 5.9), ("b", 1.0, 1.0), ("c", None, 1.0), ("d", 0.0, 1.0), ("d", 0.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fit = {r["g"]: r for r in regress.origin_regression(df, ["g"], F.col("y"), F.col("x"), F.lit(1.0)).collect()}
    assert math.isclose(fit["a"]["slope"], (2 + 8.2 + 17.7) / 14) and fit["b"]["se"] is None and "c" not in fit and fit["d"]["slope"] is None
    with_cut = {r["g"]: r for r in regress.intercept_regression(df, ["g"], F.col("y"), F.col("x"), F.lit(1.0)).collect()}
    slope, cut = np.polyfit([1, 2, 3], [2, 4.1, 5.9], 1)
    assert math.isclose(with_cut["a"]["slope"], slope) and math.isclose(with_cut["a"]["intercept"], cut) and with_cut["d"]["slope"] is None
    design = regress.design_regression(df, ["g"], F.col("y"), {"x": F.col("x")}, F.lit(1.0)).filter("g = 'a'").first()
    assert math.isclose(design["estimate"], fit["a"]["slope"]) and math.isclose(design["se"], fit["a"]["se"])


def test_bh_with_ties_and_nulls(spark):
    p = [0.01, 0.02, 0.02, 0.5, None, 0.04]
    df = spark.createDataFrame(list(enumerate(p)), "row_id int, p double")
    got = {r["row_id"]: r["q"] for r in relational.adjusted_p(df, "p", "q").collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    want, least = {}, 1.0
    for k in range(len(known), 0, -1):
        least = min(least, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = least
    assert got[4] is None and all(math.isclose(got[i], w) for i, w in want.items())


def test_em_raises_the_likelihood_and_finds_the_slab(spark):
    n = 4000
    on = RNG.random(n) < 0.2
    se = RNG.uniform(0.05, 0.15, n)
    beta = RNG.normal(size=n) * np.sqrt(se**2 + on * 0.5)
    df = spark.createDataFrame([(1, float(b), float(s)) for b, s in zip(beta, se, strict=True)], "g int, beta double, se double")
    params = spark.createDataFrame([(1, 0.1, 1.0)], "g int, pi double, slab double")
    likelihood = []
    for _ in range(3):
        row = mixture.em_step(df, params, "g").first()
        likelihood.append(row["loglik"])
        params = spark.createDataFrame([(1, row["pi"], row["slab"])], "g int, pi double, slab double")
    assert likelihood[0] < likelihood[1] < likelihood[2]
    fit = mixture.fit_em(df, "g", tolerance=1e-3, max_steps=15).first()
    assert abs(fit["pi"] - 0.2) < 0.06 and abs(fit["slab"] - 0.5) < 0.15


def fold_moments(x, y, folds):
    rows = np.column_stack([x, y])
    parts = [rows[f::folds] for f in range(folds)]
    return [(float(len(p)), p.mean(axis=0), (p - p.mean(axis=0)).T @ (p - p.mean(axis=0))) for p in parts]


def plain_elastic_net(x, y, lam, alpha, rounds=20_000):
    """Proximal gradient on centred rows and standardised features, back on the features' scale."""
    sd = x.std(axis=0)
    z, c = (x - x.mean(axis=0)) / sd, y - y.mean()
    step = 1 / (np.linalg.eigvalsh(z.T @ z / len(y))[-1] + lam)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        g = b + step * (z.T @ (c - z @ b) / len(y) - lam * (1 - alpha) * b)
        b = np.sign(g) * np.maximum(np.abs(g) - step * lam * alpha, 0)
    return b / sd


def test_elastic_net_path_and_cross_validation_against_plain_fits():
    x = RNG.normal(size=(83, 6)) * [1, 2, 0.1, 1, 1, 5] + [0, 1e3, 0, -7, 0, 1]
    x[:, 4] = 0.9 * x[:, 0] + 0.1 * x[:, 4]
    y = x @ np.array([1.5, 0, 0, -0.7, 0, 0.1]) + RNG.normal(size=83) * 0.5 + 40
    folds = 5
    made = regress.fit_elastic_net(fold_moments(x, y, folds), 0.9, n_lambdas=7)
    for k, lam in enumerate(made["lambda"]):
        assert np.allclose(made["weights"][k], plain_elastic_net(x, y, lam, 0.9), atol=1e-6)
        assert made["nzero"][k] == (made["weights"][k] != 0).sum()
    assert made["nzero"][0] == 0 and set(np.flatnonzero(made["weights"][-1])) >= {0, 3}
    for k in (1, 4):
        errors, sizes = [], []
        for f in range(folds):
            held = np.arange(83) % folds == f
            b = plain_elastic_net(x[~held], y[~held], made["lambda"][k], 0.9)
            base = y[~held].mean() - x[~held].mean(axis=0) @ b
            errors.append(((y[held] - base - x[held] @ b) ** 2).mean())
            sizes.append(held.sum())
        mean = np.average(errors, weights=sizes)
        assert math.isclose(made["cv_mean"][k], mean, rel_tol=1e-5)
        assert math.isclose(made["cv_sd"][k], math.sqrt(np.average((np.array(errors) - mean) ** 2, weights=sizes) / (folds - 1)), rel_tol=1e-4)


def test_elastic_nets_from_moments_equal_those_from_values(spark):
    x = RNG.normal(size=(40, 4))
    x[:, 3] = x[:, 0] - 0.3 * x[:, 2] + RNG.normal(size=40) * 0.1
    people = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)
    moments = matrix.cross_moments(people, "x", F.pmod("id", F.lit(10)))
    sets = spark.createDataFrame([(4, 1), (4, 2), (4, 3), (4, 4), (1, 2)], "gene long, snp long")  # gene 1 has one variant
    first = regress.elastic_nets(moments, sets, 0.95, n_lambdas=5)
    cis = spark.createDataFrame([(4, s + 1, [float(v) for v in x[:, s]], [float(v) for v in x[:, 3]]) for s in range(3)], "gene long, snp long, values array<double>, y array<double>")
    second = regress.elastic_nets_of_values(cis, 0.95, n_lambdas=5)
    a, b = ({r["step"]: r for r in df.collect()} for df in (first, second))
    assert set(a) == set(b) == {1, 2, 3, 4, 5} and {r["gene"] for r in a.values()} == {4}
    for k, r in a.items():
        assert math.isclose(r["cv_mean"], b[k]["cv_mean"], rel_tol=1e-8) and r["nzero"] == b[k]["nzero"]
        assert np.allclose([w["weight"] for w in r["weights"]], [w["weight"] for w in b[k]["weights"]], atol=1e-9)
    chosen = regress.path_choices(first).first()
    least = min(a.values(), key=lambda r: (r["cv_mean"], -r["lambda"]))
    assert chosen["lambda_min"] == least["lambda"] and chosen["lambda_1se"] == max(r["lambda"] for r in a.values() if r["cv_mean"] <= least["cv_mean"] + least["cv_sd"])
    at_best = {r["snp"]: r["weight"] for r in regress.path_weights(first, regress.path_choices(first)).collect()}
    assert at_best == {w["snp"]: w["weight"] for w in least["weights"] if w["weight"]}


def test_elastic_nets_skip_single_variant_genes(spark):
    y = [float(v) for v in RNG.normal(size=20)]
    rows = [(1, s, [float(v) for v in RNG.normal(size=20)], y) for s in range(1)] + [(2, s, [float(v) + (s == 0) * w for v, w in zip(RNG.normal(size=20) * 0.1, y, strict=True)], y) for s in range(3)]
    rows += [(3, s, [1.0] * 20, y) for s in range(2)]  # nothing varies
    got = regress.path_weights(regress.elastic_nets_of_values(spark.createDataFrame(rows, "gene long, snp long, values array<double>, y array<double>"))).collect()
    assert {r["gene"] for r in got} == {2} and any(r["snp"] == 0 for r in got)


def test_moments_of_values_with_a_large_mean(spark):
    x = RNG.normal(size=(400, 3))
    x[:, 1] = 0.5 * x[:, 0] + x[:, 1]
    far = x + [1e8, -1e8, 0.1]
    far[:, 2] = 0.1  # does not vary
    people = spark.createDataFrame([([float(v) for v in row],) for row in far], "x array<double>").repartition(7)
    scan = {(r["i"], r["j"]): r for r in matrix.moments_to_scan(matrix.cross_moments(people, "x")).collect()}
    assert math.isclose(scan[1, 2]["r"], np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs_tol=1e-6)
    assert scan[1, 3]["r"] is None and scan[1, 2]["n"] == 400
    cov = {(r["i"], r["j"]): r["value"] for r in matrix.moments_to_covariance(matrix.cross_moments(people, "x")).collect()}
    assert math.isclose(cov[1, 2], np.cov(x[:, 0], x[:, 1])[0, 1], rel_tol=1e-6)


def test_interval_and_band_joins_against_brute_force(spark):
    points = [(int(k), i, int(p)) for i, (k, p) in enumerate(zip(RNG.integers(0, 3, 200), RNG.integers(-500, 3000, 200), strict=True))]
    spans = [(int(k), i, int(s), int(s + w)) for i, (k, s, w) in enumerate(zip(RNG.integers(0, 3, 20), RNG.integers(0, 2500, 20), RNG.integers(0, 900, 20), strict=True))]
    p, s = spark.createDataFrame(points, "k int, id int, pos long"), spark.createDataFrame(spans, "k int, gene int, start long, end long")
    for inclusive in (True, False):
        got = sorted((r["id"], r["gene"]) for r in relational.interval_join(p, s, "k", "pos", "start", "end", 50, inclusive, bucket=130).collect())
        inside = (lambda x, a, b: a - 50 <= x <= b + 50) if inclusive else (lambda x, a, b: a - 50 < x < b + 50)
        assert got == sorted((i, g) for k, i, x in points for kk, g, a, b in spans if k == kk and inside(x, a, b))
    band = [(r["id_i"], r["id_j"]) for r in relational.band_join(p, "k", "pos", "id", 60).collect()]
    want = {(i, j) for k, i, x in points for kk, j, y in points if k == kk and (x, i) < (y, j) and y - x <= 60}
    assert len(band) == len(set(band)) and set(band) == want


def test_chunks_need_one_of_size_and_count(spark):
    df = spark.range(10).toDF("id")
    with pytest.raises(ValueError):
        relational.chunks(df, "id")
    sizes = sorted(r["count"] for r in relational.chunks(df, "id", size=4).groupBy("chunk_id").count().collect())
    assert sizes == [3, 3, 4]


def test_relationship_matrix_is_the_same_for_any_tile(spark):
    dose = RNG.integers(0, 3, (30, 11)).astype(float)
    f = dose.mean(axis=1) / 2
    z = dose[(np.minimum(f, 1 - f) >= 0.01) & (dose.std(axis=1) > 0)]
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, ddof=1, keepdims=True)
    want = z.T @ z / len(z)
    for tile in (1, 4, 512):
        rows = matrix.relationship_matrix(frame(spark, dose).repartition(3), tile=tile).collect()
        assert len(rows) == 66 and all(r["i"] <= r["j"] and math.isclose(r["value"], want[r["i"], r["j"]], abs_tol=1e-12) for r in rows)


@pytest.mark.parametrize(("n_features", "n_ind", "k"), [(25, 8, 2), (60, 40, 5), (4, 30, 6)])
def test_principal_components_against_svd(spark, n_features, n_ind, k):
    x = RNG.normal(size=(n_features, n_ind)) + np.outer(RNG.normal(size=n_features), RNG.normal(size=n_ind)) * 3
    x = np.vstack([x, np.full(n_ind, 4.0)])  # without variance
    z = x[:-1] - x[:-1].mean(axis=1, keepdims=True)
    z /= z.std(axis=1, ddof=1, keepdims=True)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    value, scores, loadings = matrix.principal_components(frame(spark, x).repartition(5), k, oversample=3)
    n = min(k, n_features)
    assert len(value) == n and np.allclose(value, s[:n] ** 2 / (n_ind - 1), rtol=1e-8)
    got = {(r["component"], r["ind"]): r["score"] for r in scores.collect()}
    load = {(r["component"], r["feature_id"]): r["loading"] for r in loadings.collect()}
    assert len(got) == n * n_ind and len(load) == n * n_features
    for c in range(min(n, 2)):  # the two that stand out
        a, b = np.array([got[c + 1, i] for i in range(n_ind)]), np.array([load[c + 1, i + 1] for i in range(n_features)])
        sign = np.sign(a @ vt[c])
        assert np.allclose(a * sign, vt[c] * s[c], atol=1e-5) and np.allclose(b * sign, u[:, c], atol=1e-5)


def test_components_of_nothing(spark):
    value, scores, loadings = matrix.principal_components(frame(spark, RNG.normal(size=(2, 4))).limit(0), 2)
    assert len(value) == 0 and scores.count() == 0 and loadings.count() == 0


def test_tall_qr_in_a_tree(spark):
    x = RNG.normal(size=(50, 6))
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
    block = RNG.normal(size=(6, 3))
    r = matrix.tall_qr(frame(spark, x).repartition(9), block, fan_in=2)
    assert np.allclose(r.T @ r, (z @ block).T @ (z @ block))


def test_ld_is_the_same_for_any_tile(spark):
    chrom = [1 + i % 2 for i in range(N_SNP)]
    df = frame(spark, G, map=[float(x) for x in MAP], chrom=chrom)
    want = {(r["chrom"], r["i"], r["j"]): r["r"] for r in ld.ld_pairs(df).collect()}
    for tile in (1, 7):
        got = {(r["chrom"], r["i"], r["j"]): r["r"] for r in ld.ld_pairs(df, tile=tile).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert all(i == j or chrom[i - 1] == chrom[j - 1] == c for c, i, j in want)


def test_dense_buckets_are_split(spark):
    """All rows in one bucket: no cell has more rows of a side than some multiple of the bound."""
    rows = spark.createDataFrame([(1, i, i % 50) for i in range(900)], "k int, id int, pos long")
    left = right = rows.withColumn("_k", F.col("k")).withColumn("_b", F.lit(0))
    a, b = relational._split_buckets(left, right, ["_k", "_b"], 60)
    assert max(r["count"] for side in (a, b) for r in side.groupBy("_k", "_b", "_cell").count().collect()) < 2 * 60
    pairs = [(r["id_i"], r["id_j"]) for r in relational.band_join(rows, "k", "pos", "id", 100, most=60).collect()]
    assert len(pairs) == len(set(pairs)) == 900 * 899 // 2
    spans = spark.createDataFrame([(1, i, 0, 49) for i in range(70)], "k int, gene int, start long, end long")
    met = [(r["id"], r["gene"]) for r in relational.interval_join(rows, spans, "k", "pos", "start", "end", most=20).collect()]
    assert len(met) == len(set(met)) == 900 * 70


def sequential_prune(variants, window, cut):
    kept = []
    for f, c, pos, v in sorted(variants, key=lambda x: (x[1], x[2], x[0])):
        near = [k for k in kept if k[1] == c and pos - k[2] <= window]
        r = lambda a, b: abs(np.corrcoef(a, b)[0, 1]) if np.std(a) > 0 and np.std(b) > 0 else 0.0
        if all(r(v, k[3]) <= cut for k in near):
            kept.append((f, c, pos, v))
    return {k[0] for k in kept}


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_ld_pruning_equals_a_sequential_scan(spark, partitions):
    rng = np.random.default_rng(partitions)
    values = np.cumsum(rng.normal(size=(120, 12)), axis=0)  # neighbours are alike
    values[40] = 2.0
    rows = [(i, 1 + i // 90, float(10 * (i // 2)), [float(x) for x in v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "feature_id long, chrom int, pos double, values array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for window, cut in ((60, 0.5), (400, 0.7)):
            got = {r["feature_id"] for r in ld.ld_prune(df, window, cut).collect()}
            assert got == sequential_prune(rows, window, cut)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ld.ld_prune(df.limit(0), 10, 0.5).count() == 0


def test_pruned_hits_against_a_greedy_loop(spark):
    rng = np.random.default_rng(3)
    values = np.repeat(rng.normal(size=(10, 15)), 4, axis=0) + rng.normal(size=(40, 15)) * 0.5
    hits = [(g, s, 1 + s // 20, 100 * s, float(rng.random() ** 3), bool((s + g) % 2)) for g in range(5) for s in range(40) if rng.random() < 0.8] + [(None, 1, 1, 0, 0.0, True), (1, 2, 1, 200, None, True)]
    hits += hits[:3]  # repeated rows
    df = spark.createDataFrame(hits, "gene long, feature_id long, chrom int, pos long, p double, is_cis boolean")
    matrix_rows = spark.createDataFrame([(s, [float(x) for x in v]) for s, v in enumerate(values)], "feature_id long, values array<double>")
    got = sorted((r["gene"], r["feature_id"], r["is_cis"]) for r in ld.pruned_hits(df, matrix_rows, 0.5, 0.2, 0.6, 0.7, 500).collect())
    want = []
    for g, cis in {(h[0], h[5]) for h in hits if h[0] is not None}:
        kept = []
        for _, s, c, pos, _, _ in sorted({h for h in hits if h[0] == g and h[5] == cis and h[4] is not None and h[4] < (0.5 if cis else 0.2)}, key=lambda h: (h[4], h[1])):
            if all(k[1] != c or abs(k[2] - pos) > 500 or abs(np.corrcoef(values[s], values[k[0]])[0, 1]) <= (0.6 if cis else 0.7) for k in kept):
                kept.append((s, c, pos))
        want += [(g, k[0], cis) for k in kept]
    assert got == sorted(want)


def test_compressed_columns_round_trip(spark):
    rows = sorted({(int(j), int(i)) for i, j in RNG.integers(0, 9, (40, 2)) if i <= j})
    upper = spark.createDataFrame([(i, j, float(i + 10 * j)) for j, i in rows], "i long, j long, value double").repartition(3)
    entries = spark.createDataFrame([(at, i, float(i + 10 * j)) for at, (j, i) in enumerate(rows)], "at long, i long, value double").repartition(4)
    empty = spark.createDataFrame([(100, len(rows), 0), (-1, 0, 0)], "j long, first long, n long")  # columns without entries
    pointers = matrix.column_pointers(upper).unionByName(empty)
    got = sorted(tuple(r) for r in matrix.from_column_pointers(entries, pointers).collect())
    assert got == sorted((i, j, float(i + 10 * j)) for j, i in rows)
    both = matrix.from_column_pointers(entries, pointers, symmetric_half=True)
    assert sorted(tuple(r) for r in both.collect()) == sorted(tuple(r) for r in matrix.symmetric(upper).collect())


def test_group_quantiles_against_numpy(spark):
    rows = [(g, float(v)) for g in (1, 2, None) for v in RNG.integers(0, 9, 1 + 20 * (g or 1))] + [(2, None), (3, None)]
    got = {r["g"]: r for r in relational.group_quantiles(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}).collect()}
    assert set(got) == {1, 2, None}
    for g in got:
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose([got[g][c] for c in "abcd"], np.quantile(own, [0, 0.3, 0.5, 1]))


def test_hot_keys_are_nested_in_parts(spark):
    rows = [(1, i) for i in range(500)] + [(2, i) for i in range(5)] + [(None, 7), (None, 7)]
    nested = relational.nest(spark.createDataFrame(rows, "k long, v long"), "k", ["v"], most=50).collect()
    assert max(len(r["data"]) for r in nested) < 100 and sum(r["k"] == 1 for r in nested) > 5
    assert sorted((r["k"] or 0, x["v"]) for r in nested for x in r["data"]) == sorted((k or 0, v) for k, v in rows)
    assert [len(r["data"]) for r in nested if r["k"] == 2] == [5]


def test_individual_summaries_merge_over_partitions(spark):
    x = RNG.normal(size=(90, 4)) + 1e7
    rows = {r["ind"]: r for r in matrix.individual_summary(frame(spark, x).repartition(6)).collect()}
    for i in range(4):
        assert rows[i]["n"] == 90 and math.isclose(rows[i]["mean"], x[:, i].mean(), rel_tol=1e-12) and math.isclose(rows[i]["sd"], x[:, i].std(ddof=1), rel_tol=1e-6)


def test_t_quantiles_invert_tails(spark):
    from lociweave.functions.tdist import t_quantile

    rows = [(float(p), float(df)) for p in (1.0, 0.5, 0.05, 1e-9) for df in (1, 3, 337)] + [(0.0, 3.0), (None, 3.0), (1.5, 3.0)]
    df = spark.createDataFrame(rows, "p double, df double").withColumn("t", t_quantile(F.col("p"), F.col("df")))
    for r in df.withColumn("back", t_tail(F.col("t"), F.col("df"))).collect():
        assert r["t"] is None if r["p"] in (0.0, None, 1.5) else math.isclose(r["back"], r["p"], rel_tol=1e-9)


def test_stacked_designs_of_any_scale(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2)) * [1e-4, 1e5]
    y = 3e4 * x[:, 0] + 2e-5 * x[:, 1] + rng.normal(size=60)
    rows = [(i % 3, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(7, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g long, a double, b double, y double")
    got = {(r["g"], r["term"]): r for r in regress.design_regression(df, ["g"], F.col("y"), {"a": F.col("a"), "b": F.col("b")}, F.lit(1.0)).collect()}
    assert got[7, "a"]["estimate"] is None
    for g in range(3):
        own = np.arange(60) % 3 == g
        est, rss, _, _ = np.linalg.lstsq(x[own], y[own], rcond=None)
        assert np.allclose([got[g, "a"]["estimate"], got[g, "b"]["estimate"]], est, rtol=1e-7)
        se = np.sqrt(np.diag(np.linalg.inv(x[own].T @ x[own])) * rss[0] / 18)
        assert np.allclose([got[g, "a"]["se"], got[g, "b"]["se"]], se, rtol=1e-6)


def test_studies(spark):
    gene_legend = spark.createDataFrame([(i + 1, 1, 1000 * i, 1000 * i + 500, 100 + i) for i in range(N_GENE)], "feature_id long, chrom int, start long, end long, fgeneid int")
    snp_legend = spark.createDataFrame([(i + 1, 1 + i % 2, 300 * i) for i in range(N_SNP)], "feature_id long, chrom int, pos long")
    got = studies.cis_trans_scan(frame(spark, G), snp_legend, frame(spark, E), gene_legend, N_IND - 1, cis_p=0.3, trans_p=0.05, reach=400).collect()
    cis_t, trans_t = t_critical(0.3, N_IND - 1), t_critical(0.05, N_IND - 1)
    want = 0
    for s in range(N_SNP):
        for g in range(N_GENE):
            _, _, t = matrix.scan_block(G[s : s + 1], E[g : g + 1])
            x, a, b = 300 * s, 1000 * g, 1000 * g + 500
            near = s % 2 == 0 and (a < x < b or abs(x - a) < 400 or abs(x - b) < 400)
            want += bool(abs(np.nan_to_num(t[0, 0])) > (cis_t if near else trans_t))
    assert len(got) == want
    nets = studies.cis_elastic_nets(gene_legend, frame(spark, E), snp_legend, frame(spark, G), reach=2000)
    assert nets.columns == regress.FIT_COLUMNS and nets.count() >= 0


def test_flip_and_nan(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0], 1, float("nan")), ([0.0, 1.0, 2.0], 0, 1.0)], "v array<double>, f int, x double")
    rows = df.select(c.flip_dosage(F.col("v"), F.col("f")).alias("v"), c.null_if_nan(F.col("x")).alias("x")).collect()
    assert rows[0]["v"] == [2.0, 1.0, 0.0] and rows[0]["x"] is None and rows[1]["v"] == [0.0, 1.0, 2.0]


def test_stages_are_stored_and_dropped(spark):
    from lociweave.cluster import cut_lineage, drop_stages

    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and "Scan parquet" in df._jdf.queryExecution().toString() or df.inputFiles()
    drop_stages(spark)
    assert cut_lineage(spark.range(3)).count() == 3


def test_scan_tiles_are_bounded_and_complete():
    import tracemalloc

    rng = np.random.default_rng(12)
    g, e = rng.normal(size=(200, 8)), rng.normal(size=(30_000, 8))
    g[3], e[5] = 2.0, 0.0  # constant features have no t
    tracemalloc.start()
    got = {}
    for to, i, j, beta, se, t in matrix.tile_pairs(g, e, 9.0):
        got |= {(a, to + b): x for a, b, *x in zip(i.tolist(), j.tolist(), beta, se, t, strict=True)}
    assert tracemalloc.get_traced_memory()[1] < 30_000_000  # one array of all pairs is 48 MB
    tracemalloc.stop()
    beta, se, t = matrix.scan_block(g, e)
    want = set(zip(*np.nonzero(np.abs(np.nan_to_num(t)) > 9.0), strict=True))
    assert set(got) == want and len(want) > 100
    assert all(np.allclose(x, (beta[p], se[p], t[p]), rtol=1e-8) for p, x in got.items())
    every = list(matrix.tile_pairs(g[:4], e[:9]))
    assert sum(len(x[1]) for x in every) == 36 and np.isnan(every[0][5]).sum() == 12


def test_t_functions_see_each_distinct_value_once():
    from lociweave.functions import tdist

    asked = []
    back = tdist._by_distinct(lambda p, df: asked.append(len(p)) or p + df, np.tile([0.1, 0.2, np.inf], 400), np.repeat([1.0, 2.0], 600))
    assert asked == [6] and np.array_equal(back, np.tile([0.1, 0.2, np.inf], 400) + np.repeat([1.0, 2.0], 600))
    t = tdist.quantiles(np.array([0.5, 0.25, 1e-290, 0.45, 0.6, np.nan]), np.array([3.0, 1.0, 2.0, 337.0, 3.0, 3.0]))
    assert t[0] == 0 and math.isclose(t[1], 1.0, rel_tol=1e-13) and np.isnan(t[4:]).all()
    assert np.allclose(tdist.upper_tail(t[1:4], np.array([1.0, 2.0, 337.0])), [0.25, 1e-290, 0.45], rtol=1e-11, atol=0)


def test_em_query_broadcasts_its_parameters(spark, sf_dir):
    from lociweave.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # less than the effects
    try:
        assert "SortMergeJoin" not in QUERIES["mixture_em_steps"](spark, sf_dir)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_top_hits_are_not_dealt_by_chromosome(spark):
    rows = [(c, g, p, float(1 + (7 * p + g) % 5), 0.5) for c in (1, 2) for g in (1, 2) for p in range(3, 40)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a large table
    try:
        best = studies.top_hit_per_block(spark.createDataFrame(rows, "chrom long, fgeneid long, pos long, theta double, serr double"), 3.0, 10)
        plan = best._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["chrom"], r["fgeneid"], r["block"], r["pos"]) for r in best.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[chrom#\d+L?\], \[", plan)
    most = {}
    for c_, g, p, theta, serr in rows:
        if theta / serr > 3:
            most.setdefault((c_, g, (p - 3 + 1) // 10 + 1), []).append((theta / serr, p))
    assert got == sorted((*k, p) for k, v in most.items() for t, p in v if t == max(v)[0])


@pytest.mark.parametrize(("size", "halo", "block_bytes"), [(4, 1, 1), (7, 1.5, 64 << 20), (1024, 2, 64 << 20)])
def test_pruned_scan_against_a_greedy_loop(spark, monkeypatch, size, halo, block_bytes):
    rng = np.random.default_rng(5)
    values = np.repeat(rng.normal(size=(20, 15)), 3, axis=0) + rng.normal(size=(60, 15)) * 0.6
    values[8], values[21] = 2.0, values[20]  # no variance; equal variants
    genes = rng.normal(size=(9, 15)) + values[rng.integers(0, 60, 9)] * 0.5
    place = [(1 + s // 30, 100 * s) for s in range(60)]
    starts = [(1 + g % 2, 700 * g) for g in range(7)] + [(None, 2000), (1, None)]
    left = [(s, [float(x) for x in v], *place[s]) for s, v in enumerate(values)] + [(99, [1.0] * 15, None, 5)]
    left += left[:2]  # repeated rows
    right = [(g, [float(x) for x in v], *starts[g]) for g, v in enumerate(genes)]
    monkeypatch.setattr(ld, "PAIRS", 50)
    got = ld.pruned_scan(spark.createDataFrame(left, "feature_id long, values array<double>, chrom int, pos long"), spark.createDataFrame(right, "feature_id long, values array<double>, chrom int, start long"), 0.7, 1.0, 0.3, 0.4, 500, 800, size=size, halo=halo, block_bytes=block_bytes).collect()
    want = []
    for g, (chrom, start) in enumerate(starts):
        hits = []
        for s, (c_, pos) in enumerate(place):
            near, same = None if start is None else abs(pos - start) < 800, None if chrom is None else chrom == c_
            cis = False if near is False or same is False else None if near is None or same is None else True
            r = 0.0 if s == 8 else np.corrcoef(values[s], genes[g])[0, 1]
            t = abs(math.sqrt(13) * r / math.sqrt(1 - r * r))
            if cis is not None and t > (0.7 if cis else 1.0):
                hits.append((-round(t, 8), s, c_, pos, cis))
        for cls in (True, False):
            kept = []
            for _, s, c_, pos, cis in sorted(hits):
                if cis == cls and all(k[1] != c_ or abs(k[2] - pos) > 500 or abs(np.corrcoef(values[s], values[k[0]])[0, 1]) <= (0.3 if cis else 0.4) for k in kept):
                    kept.append((s, c_, pos))
            want += [(g, *k, cls) for k in kept]
    assert sorted(tuple(r) for r in got) == sorted(want) and any(w[-1] for w in want) and len(want) > 50


def test_pruned_scan_lists_the_hits_in_doubt_alone(spark, sf_dir, monkeypatch):
    listed = [0]
    decide = ld.pruned_hits

    def counted(hits, *rest):
        listed.append(hits.count())
        return decide(hits, *rest)

    monkeypatch.setattr(ld, "pruned_hits", counted)
    n = model_queries.ld_pruned_hits(spark, sf_dir).count()
    assert n > 20 and sum(listed) < n / 20


def test_pruned_scan_of_empty_tables(spark):
    left = spark.createDataFrame([], "feature_id long, values array<double>, chrom int, pos long")
    right = spark.createDataFrame([(1, [1.0, 2.0, 4.0], 1, 5)], "feature_id long, values array<double>, chrom int, start long")
    assert ld.pruned_scan(left, right, 1, 1, 0.3, 0.3, 500, 800).count() == 0
    assert ld.pruned_scan(right.withColumnRenamed("start", "pos"), right.limit(0), 1, 1, 0.3, 0.3, 500, 800).count() == 0
