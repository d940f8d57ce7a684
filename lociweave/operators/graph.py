"""Components, colouring and clumping of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage
from lociweave.operators.relational import group_minimum


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected edge table (a, b); component is the smallest node.

    Alternating large-star and small-star rounds: every round is one union, one
    grouped minimum and one join on the edge list, and no node's neighbourhood
    is gathered in one task.  Rounds end when the edge list no longer changes.
    """
    current = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct()
        current = cut_lineage(small)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select("b", "b")).distinct()


def subgraphs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, group) of all vertices (column vertex); a vertex without edges is its own group."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return vertices.join(found, vertices["vertex"] == found["node"], "left").select("vertex", F.coalesce("component", "vertex").alias("group"))


def colouring(vertices: DataFrame, edges: DataFrame, priority: str = "hash", max_rounds: int = 1000) -> DataFrame:
    """(vertex, color) with no two linked vertices of one colour, by Jones-Plassmann rounds.

    A vertex takes the smallest free colour once all neighbours of a smaller priority have
    one.  priority "id" equals sequential first fit in id order, "hash" needs fewer rounds
    on long chains, and any other name is a column of the vertices (ties by id).
    """
    rank = {"hash": F.xxhash64("vertex"), "id": F.lit(0)}.get(priority)
    ranked = vertices.select("vertex", F.struct((rank if rank is not None else F.col(priority)).alias("p"), F.col("vertex").alias("v")).alias("rank"))
    a, b = ranked.select(F.col("vertex").alias("src"), F.col("rank").alias("ra")), ranked.select(F.col("vertex").alias("dst"), F.col("rank").alias("rb"))
    links = edges.filter("src <> dst").select("src", "dst").join(a, "src").join(b, "dst")
    waits = cut_lineage(links.select(F.when(F.col("ra") < F.col("rb"), F.col("src")).otherwise(F.col("dst")).alias("first"), F.when(F.col("ra") < F.col("rb"), F.col("dst")).otherwise(F.col("src")).alias("then")).distinct())
    # waits: the links to vertices without a colour; used: (then, color) that those of them have met
    fresh = cut_lineage(vertices.select("vertex").join(waits.select(F.col("then").alias("vertex")).distinct(), "vertex", "left_anti").withColumn("color", F.lit(0)))
    done, used = fresh, waits.select("then", F.lit(0).alias("color")).limit(0)
    for _ in range(max_rounds):
        met = waits.join(fresh.select(F.col("vertex").alias("first"), "color"), "first", "left")
        met = cut_lineage(met)
        waits = met.filter("color is null").select("first", "then")
        used = cut_lineage(used.unionByName(met.filter("color is not null").select("then", "color")).distinct())
        ready = used.join(waits.select("then").distinct(), "then", "left_anti").groupBy("then").agg(F.collect_set("color").alias("_used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("_used")), F.col("_used")))
        fresh = cut_lineage(ready.select(F.col("then").alias("vertex"), free.alias("color")))
        if not fresh.limit(1).count():
            if waits.limit(1).count():
                raise RuntimeError("colouring made no progress")
            return done
        done = done.unionByName(fresh)
        used = used.join(fresh.select(F.col("vertex").alias("then")), "then", "left_anti")
    raise RuntimeError(f"colouring did not end in {max_rounds} rounds")


def lead_variants(hits: DataFrame, groups: DataFrame, by: str = "gene", p: str = "p") -> DataFrame:
    """Of each gene and component the hits with the smallest p, ties kept."""
    return group_minimum(hits.join(groups.select(F.col("vertex").alias("snp"), "group"), "snp"), [by, "group"], F.col(p))


def clump(vertices: DataFrame, edges: DataFrame, p: str = "p") -> DataFrame:
    """Vertices that greedy clumping keeps: in order of p, a vertex stays unless it is linked
    to one that stays.

    Rounds: open vertices whose open neighbours all come later stay, their neighbours go.
    Only the vertices and links that are still open are carried on, and each round writes
    what it has settled, so a round costs what is left.
    """
    ranked = vertices.select("vertex", F.struct(F.col(p).alias("p"), F.col("vertex").alias("v")).alias("rank"))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    a, b = ranked.select(F.col("vertex").alias("src"), F.col("rank").alias("ra")), ranked.select(F.col("vertex").alias("dst"), F.col("rank").alias("rb"))
    live = cut_lineage(both.join(a, "src").join(b, "dst").select("src", "dst", (F.col("rb") < F.col("ra")).alias("earlier")))
    kept = cut_lineage(vertices.select("vertex").join(live.select(F.col("src").alias("vertex")).distinct(), "vertex", "left_anti"))
    while live.limit(1).count():
        # a vertex without open links is settled: it stayed, or it has nothing left to wait for
        stay = cut_lineage(live.groupBy("src").agg(F.max("earlier").alias("waits")).filter("not waits").select(F.col("src").alias("vertex")))
        go = live.join(stay.select(F.col("vertex").alias("src")), "src", "left_semi").select(F.col("dst").alias("vertex"))
        closed = cut_lineage(stay.unionByName(go).distinct())
        rest = live.join(closed.select(F.col("vertex").alias("src")), "src", "left_anti")
        after = cut_lineage(rest.join(closed.select(F.col("vertex").alias("dst")), "dst", "left_anti"))
        alone = rest.select("src").distinct().join(after.select("src").distinct(), "src", "left_anti").select(F.col("src").alias("vertex"))
        kept, live = kept.unionByName(stay).unionByName(cut_lineage(alone)), after
    return vertices.join(kept, "vertex", "left_semi")
