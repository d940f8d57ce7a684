"""Every registered association query against its SQL, and those without SQL by property."""

import pytest
from compare import same_as_sql
from pyspark.sql import functions as F

from lociweave.plans import import_queries, model_queries, scan_queries, store_queries, study_queries  # noqa: F401 - they register their queries
from lociweave.plans.queries import ORACLE_SQL, QUERIES
from lociweave.plans.scan_queries import linkage_graph


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    same_as_sql(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_colouring_is_proper(spark, sf_dir):
    colours = {r["vertex"]: r["color"] for r in QUERIES["graph_colouring"](spark, sf_dir).collect()}
    vertices, edges = linkage_graph(spark, sf_dir)
    assert set(colours) == {r["vertex"] for r in vertices.collect()}
    assert all(colours[r["src"]] != colours[r["dst"]] for r in edges.collect())


def test_clumped_hits_are_independent_and_maximal(spark, sf_dir):
    kept = {r["vertex"] for r in QUERIES["clumped_hits"](spark, sf_dir).collect()}
    vertices, edges = linkage_graph(spark, sf_dir)
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    for (v,) in vertices.collect():
        assert (v in kept) != bool(near.get(v, set()) & kept)


def test_tail_probabilities_fall_with_t(spark, sf_dir):
    rows = sorted((abs(r["t"]), r["p"]) for r in QUERIES["scan_tail_probabilities"](spark, sf_dir).filter(F.col("t").isNotNull()).collect())
    assert all(0 < p <= 1 for _, p in rows)
    assert all(a[1] >= b[1] - 1e-12 for a, b in zip(rows, rows[1:], strict=False))


def test_elastic_net_overall_has_each_genes_choices(spark, sf_dir):
    rows = QUERIES["elastic_net_overall"](spark, sf_dir).collect()
    assert {r["gene"] for r in rows} == set(range(1, 65)) and all(r["cv_mean"] > 0 and r["lambda_min"] <= r["lambda_1se"] for r in rows)
    for gene in (1, 30):
        own = [r for r in rows if r["gene"] == gene]
        assert min(own, key=lambda r: (r["cv_mean"], -r["lambda"]))["lambda"] == own[0]["lambda_min"]
