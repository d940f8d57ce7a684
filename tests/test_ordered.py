"""Distributed scans against plain Python."""

import random

from pyspark.sql import functions as F

from lociweave.operators import ordered, relational


def test_running_totals_minima_and_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i * 7919 % 1000, rng.randint(-50, 50)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = {(r["g"], r["o"]): (r["t"], r["m"]) for r in ordered.minimum_from_here(ordered.running_total(df, ["g"], ["o"], F.col("v"), "t"), ["g"], ["o"], F.col("v"), "m").collect()}
    for g, o, _ in rows:
        same = [(oo, v) for gg, oo, v in rows if gg == g]
        assert got[g, o] == (sum(v for oo, v in same if oo <= o), min(v for oo, v in same if oo >= o))
    numbers = {r["o"]: r["n"] for r in ordered.row_numbers(df, ["o", "v"], "n").collect()}
    assert [numbers[o] for o in sorted(o for _, o, _ in rows)] == list(range(1, 701))
    assert ordered.row_numbers(df.limit(0), ["o"], "n").count() == 0


def test_ranks_with_ties_and_nulls(spark):
    rows = [(1, 5.0), (1, 5.0), (1, None), (1, 9.0), (2, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    assert sorted((r["g"], r["s"]) for r in relational.share_rank(df, "v", "s", ["g"]).collect()) == [(1, 0.0), (1, 1 / 3), (1, 1 / 3), (1, 1.0), (2, 0.0)]
    assert sorted(r["r"] for r in relational.average_rank(df.filter("g = 1"), "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_next_value(spark):
    rows = [(g, i * 7919 % 1000) for i in range(300) for g in ("a", "b") if i % 3 or g == "a"]
    got = {(r["g"], r["o"]): r["n"] for r in ordered.next_value(spark.createDataFrame(rows, "g string, o long").repartition(4), ["g"], "o", "n").collect()}
    for g, o in rows:
        assert got[g, o] == min((oo for gg, oo in rows if gg == g and oo > o), default=None)


def test_last_value(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i * 7919 % 500, rng.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    got = {(r["g"], r["o"]): r["l"] for r in ordered.last_value(df, ["g"], ["o"], F.col("v"), "l").collect()}
    for g, o, _ in rows:
        past = [(oo, v) for gg, oo, v in rows if gg == g and oo <= o and v is not None]
        assert got[g, o] == (max(past)[1] if past else None)
