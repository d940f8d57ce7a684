"""Distance-banded, shrunk correlation (LD) as a pair table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage, ship_package
from lociweave.functions.columns import band_width, panel_theta, shrunk_covariance
from lociweave.operators.graph import clump
from lociweave.operators.matrix import BLOCK_BYTES, TILE as PRODUCT, scan_blocks
from lociweave.operators.ordered import row_numbers
from lociweave.operators.relational import band_join, interval_join

#: Panel size, effective population size and decay cutoff.
PANEL, POPULATION, CUTOFF = 85, 11490.672741, 1e-3


#: Features of a tile.
TILE = 1024


def ld_pairs(matrix: DataFrame, m: int = PANEL, ne: float = POPULATION, cutoff: float = CUTOFF, key: str | None = "chrom", tile: int = TILE) -> DataFrame:
    """(chrom, i, j, r) of a matrix table with columns feature_id, map, values and the key.

    i comes before j in the order of map and number, and pairs further apart than the
    cutoff's map distance are left out.  Features are numbered in that order, by ranges, and
    cut into tiles of equally many; every pair of tiles that come near enough to each other is
    a cell, one matrix product.  So a task holds two tiles, however dense the map
    is, and a feature travels once for each tile in its reach.  The diagonal is 1.
    """
    ship_package(matrix.sparkSession)
    theta, width = panel_theta(m), band_width(cutoff, m, ne) * (1 + 1e-9)
    name = key or "chrom"
    keyed = matrix if key else matrix.withColumn("chrom", F.lit(0))
    rows = keyed.select(F.col(name).alias("_key"), "feature_id", F.col("map").cast("double").alias("map"), "values")
    placed = row_numbers(rows.select("_key", "feature_id", "map"), ["map", "feature_id"], "_row", ["_key"])
    tiles = cut_lineage(placed.select("feature_id", F.col("_key").alias("_own"), "map", F.floor((F.col("_row") - 1) / tile).alias("tile")))
    spans = tiles.groupBy("_own", "tile").agg(F.min("map").alias("low"), F.max("map").alias("high"))
    # each tile's reach meets the beginnings of later tiles; one row per tile on both sides
    spans = spans.withColumn("_hash", F.xxhash64("_own"))
    begins = spans.select("_hash", F.col("low").alias("begin"), F.col("tile").alias("tile_b"), F.col("_own").alias("_own_b"))
    near = interval_join(begins, spans.select("_hash", "low", F.col("high").alias("high_a"), F.col("tile").alias("tile_a"), F.col("_own").alias("_cell_key"), (F.col("high") + width).alias("reach")), "_hash", "begin", "low", "reach", bucket=width)
    cells = cut_lineage(near.filter(F.col("_own_b").eqNullSafe(F.col("_cell_key")) & (F.col("tile_a") <= F.col("tile_b"))).select("_cell_key", "tile_a", "tile_b"))
    side = lambda which, number: tiles.join(cells, F.col("_own").eqNullSafe(F.col("_cell_key")) & (F.col("tile") == F.col(which))).select(F.col("_cell_key"), "tile_a", "tile_b", F.lit(number).alias("side"), "feature_id")
    dealt = side("tile_a", 0).unionByName(side("tile_b", 1)).join(rows, "feature_id").filter(F.col("_key").eqNullSafe(F.col("_cell_key"))).drop("_key")
    rate, half = 4 * ne / 100 / (2 * m), 0.5 * theta * (1 - 0.5 * theta)

    def cell_product(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first, second = (frame[frame["side"] == s].sort_values(["map", "feature_id"]) for s in (0, 1))
        x, y = _centred(first["values"].tolist()), _centred(second["values"].tolist())
        n = x.shape[1] - 1
        gap = second["map"].to_numpy()[None, :] - first["map"].to_numpy()[:, None]
        near = gap <= width
        if key[1] == key[2]:
            near &= np.triu(np.ones(gap.shape, bool), 1)
        decay = np.exp(-gap * rate)
        vx, vy = ((1 - theta) ** 2 * (v * v).sum(axis=1) / n + half for v in (x, y))
        r = (1 - theta) ** 2 * (x @ y.T) / n * np.where(decay >= cutoff, decay, 0.0) / np.sqrt(vx[:, None] * vy[None, :])
        a, b = np.nonzero(near)
        return pd.DataFrame({"_key": [key[0]] * len(a), "i": first["feature_id"].to_numpy()[a], "j": second["feature_id"].to_numpy()[b], "r": r[a, b]})

    kind = dict(rows.dtypes)["_key"]
    off = dealt.groupBy("_cell_key", "tile_a", "tile_b").applyInPandas(cell_product, f"_key {kind}, i long, j long, r double")
    diagonal = rows.select(F.col("_key").alias(name), F.col("feature_id").alias("i"), F.col("feature_id").alias("j"), F.lit(1.0).alias("r"))
    return off.select(F.col("_key").alias(name), "i", "j", F.when(~F.isnan("r"), F.col("r")).alias("r")).unionByName(diagonal)


def _centred(values: list) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in values])
    with np.errstate(invalid="ignore"):
        return x - x.mean(axis=1, keepdims=True)


def ld_from_covariance(covariance: DataFrame, positions: DataFrame, m: int = PANEL, ne: float = POPULATION, cutoff: float = CUTOFF) -> DataFrame:
    """(i, j, r) within the band from a covariance pair table and (id, map) positions."""
    theta = panel_theta(m)
    a, b = positions.select(F.col("id").alias("i"), F.col("map").alias("map_i")), positions.select(F.col("id").alias("j"), F.col("map").alias("map_j"))
    near = covariance.join(a, "i").join(b, "j").withColumn("d", F.abs(F.col("map_j") - F.col("map_i"))).filter(F.col("d") <= band_width(cutoff, m, ne) * (1 + 1e-9))
    diagonal = F.col("i") == F.col("j")
    shrunk = near.select("i", "j", shrunk_covariance(F.col("value"), F.col("d"), theta, m, ne, cutoff, diagonal).alias("value"))
    var = shrunk.filter("i = j").select(F.col("i").alias("k"), F.col("value").alias("v"))
    vi, vj = var.select(F.col("k").alias("i"), F.col("v").alias("vi")), var.select(F.col("k").alias("j"), F.col("v").alias("vj"))
    r = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.try_divide(F.col("value"), F.sqrt(F.col("vi") * F.col("vj"))))
    return shrunk.join(vi, "i").join(vj, "j").select("i", "j", r.alias("r"))


def ld_edges(pairs: DataFrame, cut: float = 0.1) -> DataFrame:
    """(src, dst, weight): pairs of different features whose |r| exceeds the cut."""
    return pairs.filter((F.col("i") < F.col("j")) & (F.col("r") * F.col("r") > cut * cut)).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("r").alias("weight"))


def concat_pairs(*tables: DataFrame) -> DataFrame:
    """Pair tables of chunks as one; a place that several chunks computed appears once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates(["i", "j"])


def ld_prune(variants: DataFrame, window: float, cut: float, key: str = "chrom", max_rounds: int | None = None) -> DataFrame:
    """The variants (key, feature_id, pos, values) that a greedy scan in the order of (pos, feature_id)
    keeps: each one whose |r| with every kept variant at most ``window`` before it is ``cut`` or less.

    The order is cut into ranges, and every range is scanned by itself at first.  What a range
    keeps near its end is carried over the border, and the ranges whose carried variants have
    changed are scanned again, until none changes: the first range is right at once, and a range
    is right a round after those before it, so the end equals one sequential scan.
    Ranges usually fall into step after a few variants, so two or three rounds do.  A task holds the
    kept variants of one window.  A null position is left out; a variant without variance
    has no r and stays.
    """
    ship_package(variants.sparkSession)
    rows = variants.filter("pos is not null").select(F.col(key).alias("_key"), F.col("feature_id").cast("long").alias("feature_id"), F.col("pos").cast("double").alias("pos"), F.col("values").cast("array<double>").alias("values"))
    rows = cut_lineage(rows.repartitionByRange("_key", "pos", "feature_id").withColumn("_part", F.spark_partition_id()))
    kind = dict(rows.dtypes)["_key"]
    starts = rows.groupBy("_part", "_key").agg(F.min("pos").alias("_low")).select(F.col("_part").alias("_to"), F.col("_key").alias("_to_key"), "_low")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for batch in batches:
            lists = batch.column(4)
            values, ends = lists.flatten().to_numpy(), np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy(zero_copy_only=False))))
            stays = []
            for i, (part, own, pos, carried) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 5)], strict=True)):
                if (part, own) != at:
                    at, kept = (part, own), []
                kept = [x for x in kept if pos - x[0] <= window]
                z = values[ends[i] : ends[i + 1]] - values[ends[i] : ends[i + 1]].mean()
                length = np.sqrt(z @ z)
                z = z / length if length > 0 else z
                good = carried or not kept or bool((np.abs(np.array([x[1] for x in kept]) @ z) <= cut).all())
                if good:
                    kept.append((pos, z))
                stays.append(good and not carried)
            yield batch.select([0, 1, 2, 3, 4]).filter(pa.array(stays, pa.bool_()))

    def scanned(part_rows: DataFrame, carried: DataFrame) -> DataFrame:
        both = part_rows.withColumn("_carried", F.lit(False)).unionByName(carried.withColumn("_carried", F.lit(True)))
        placed = both.repartitionByRange("_part").select("_part", "_key", "pos", "feature_id", "values", "_carried")
        ordered = placed.sortWithinPartitions("_part", "_key", "pos", "feature_id")
        return cut_lineage(ordered.mapInArrow(scan, f"_part int, _key {kind}, pos double, feature_id long, values array<double>"))

    used = rows.limit(0)
    kept = scanned(rows, used)
    n_parts = starts.agg(F.count_distinct("_to")).first()[0]
    for _ in range(max_rounds or n_parts + 1):
        reach = F.col("_key").eqNullSafe(F.col("_to_key")) & (F.col("_to") > F.col("_part")) & (F.col("_low") - F.col("pos") <= window)
        carried = cut_lineage(kept.join(F.broadcast(starts), reach).select(F.col("_to").alias("_part"), "_key", "pos", "feature_id", "values"))
        told = lambda df, name: df.groupBy("_part").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum(F.xxhash64("feature_id").cast("decimal(38,0)")).alias(f"h_{name}"))
        both = told(carried, "new").join(told(used, "old"), "_part", "full")
        changed = cut_lineage(both.filter("not (n_new <=> n_old and h_new <=> h_old)").select("_part"))
        if not changed.limit(1).count():
            break
        again = scanned(rows.join(F.broadcast(changed), "_part", "left_semi"), carried.join(F.broadcast(changed), "_part", "left_semi"))
        kept = cut_lineage(kept.join(F.broadcast(changed), "_part", "left_anti").unionByName(again))
        used = carried
    else:
        raise RuntimeError("the scan has not settled")
    on = F.col("_key").eqNullSafe(F.col(key)) & (F.col("_id") == F.col("feature_id"))
    return variants.join(kept.select("_key", F.col("feature_id").alias("_id")), on, "left_semi")


def pair_correlations(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """(i, j, r) of listed pairs of features; null where one does not vary.

    For hit-driven work: r is formed for the pairs asked for and no others.
    """
    centred = F.transform("values", lambda x: x - F.col("_mean"))
    unit = matrix.select("feature_id", "values", (F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")).alias("_mean")).select("feature_id", centred.alias("d"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    unit = unit.withColumn("ss", dot("d", "d"))
    a, b = (unit.select(F.col("feature_id").alias(n), F.col("d").alias(f"d_{n}"), F.col("ss").alias(f"ss_{n}")) for n in "ij")
    both = pairs.select("i", "j").distinct().join(a, "i").join(b, "j")
    return both.select("i", "j", F.try_divide(dot("d_i", "d_j"), F.sqrt("ss_i") * F.sqrt("ss_j")).alias("r"))


def pruned_hits(hits: DataFrame, matrix: DataFrame, cis_p: float = 0.05, trans_p: float = 5e-5, cis_cut: float = 0.8, trans_cut: float = 0.8, reach: float = 1_000_000) -> DataFrame:
    """The hits (gene, feature_id, chrom, pos, p, is_cis) that pass their class's p cutoff and that
    LD pruning keeps: within each gene and class, in the order of (p, feature_id), a hit stays
    unless its |r| with one that stays, at most ``reach`` away, exceeds the class's cutoff.

    r is computed between hits of one gene and class alone, each pair of features once, and
    the greedy sets of all genes are one table of links whose open part shrinks.  Rows whose
    gene, feature, p or place is null are left out; repeated rows of a gene, feature and class
    count once.
    """
    passing = hits.filter(F.col("p") < F.when(F.col("is_cis"), cis_p).otherwise(trans_p)).dropna(subset=["gene", "feature_id", "chrom", "pos", "is_cis"])
    first = passing.groupBy("gene", "feature_id", "is_cis").agg(F.min(F.struct("p", "chrom", "pos")).alias("_first")).select("gene", "feature_id", "is_cis", "_first.*")
    own = cut_lineage(first.withColumn("vertex", F.monotonically_increasing_id()))
    own = own.withColumn("_set", F.concat_ws(":", F.col("gene").cast("string"), F.col("is_cis").cast("string"), F.col("chrom").cast("string")))
    near = cut_lineage(band_join(own, "_set", "pos", "vertex", reach, ["feature_id", "is_cis"]).select(F.col("vertex_i").alias("src"), F.col("vertex_j").alias("dst"), F.least("feature_id_i", "feature_id_j").alias("i"), F.greatest("feature_id_i", "feature_id_j").alias("j"), F.col("is_cis_i").alias("is_cis")))
    tight = F.abs("r") > F.when(F.col("is_cis"), cis_cut).otherwise(trans_cut)
    links = near.join(pair_correlations(near, matrix), ["i", "j"]).filter(tight).select("src", "dst")
    ranked = own.withColumn("_order", F.struct("p", "feature_id"))
    return clump(ranked, links, "_order").select("gene", "feature_id", "chrom", "pos", "p", "is_cis")


#: Variants of a range of a pruned scan, and pairs of hits of one gene that a worker compares at once.
RANGE, PAIRS = 1024, 2_000_000
#: States of a hit inside a range.
OPEN, STAYS, GOES, DOUBT = range(4)


def pruned_scan(variants: DataFrame, genes: DataFrame, cis_t: float, trans_t: float, cis_cut: float, trans_cut: float, reach: float, cis_reach: float, size: int = RANGE, halo: float = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(gene, feature_id, chrom, pos, is_cis): ``pruned_hits`` of an all-pairs scan, whose hits are never listed.

    variants: (feature_id, values, chrom, pos); genes: (feature_id, values, chrom, start).  A pair is
    cis on one chromosome with |pos - start| under ``cis_reach``, and a hit if its |t| exceeds its
    class's threshold; hits of a gene and class are taken by falling |t| (to ten decimals), then by feature_id.

    Variants are cut into ranges of ``size`` in the order of place; a worker forms the product of a
    range, with ``halo`` times the reach on both sides, and prunes there.  A hit's state is certain
    unless it hangs on hits beyond the halo.  Only the hits in doubt, and those that stay and have a
    link over the border to a later one, leave the first pass; ``pruned_hits`` decides them by the
    table of their links.  The second pass gives what stays for certain.  So a task holds a range
    with its halo, and what is shuffled are the variants and the hits in doubt.  Rows with a null
    feature, chromosome or place are left out, as are pairs whose class is null; of rows that repeat an id
    the least counts.
    """
    if halo < 1:
        raise ValueError("the halo is at least one reach")
    ship_package(variants.sparkSession)
    once = lambda df, *columns: df.filter("feature_id is not null").groupBy("feature_id").agg(F.min(F.struct(*columns, F.col("values").cast("array<double>").alias("values"))).alias("_least")).select("feature_id", "_least.*")
    rows = cut_lineage(once(variants.dropna(subset=["chrom", "pos"]), "chrom", "pos"))
    genes = cut_lineage(once(genes, "chrom", "start"))
    numbered = row_numbers(rows.select("chrom", "pos", "feature_id"), ["pos", "feature_id"], "_row", ["chrom"])
    own = cut_lineage(numbered.select("chrom", "pos", "feature_id", F.floor((F.col("_row") - 1) / size).alias("own")))
    spans = own.groupBy("chrom", F.col("own").alias("range")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    step = spans.agg(F.avg(F.col("high") - F.col("low"))).first()[0]
    kinds = dict(rows.dtypes)
    schema = f"gene {dict(genes.dtypes)['feature_id']}, feature_id {kinds['feature_id']}, chrom {kinds['chrom']}, pos {kinds['pos']}, is_cis boolean, t double, open boolean"
    wanted = ["gene", "feature_id", "chrom", "pos", "is_cis"]
    if step is None:
        return variants.sparkSession.createDataFrame([], schema).select(*wanted)
    near = interval_join(own, spans, "chrom", "pos", "low", "high", halo * reach, bucket=max(float(step), halo * reach, 1e-9)) if reach else own.withColumn("range", F.col("own")).join(spans, ["chrom", "range"])
    near = near.select("chrom", "range", F.col("feature_id").alias("_id"), (F.col("own") == F.col("range")).alias("core"), "low", "high")
    placed = near.join(rows.withColumnRenamed("chrom", "_chrom"), F.col("_id") == F.col("feature_id")).drop("_id", "_chrom")
    tasks = 4 * variants.sparkSession.sparkContext.defaultParallelism
    dealt = cut_lineage(placed).repartitionByRange(tasks, "chrom", "range").sortWithinPartitions("chrom", "range", "pos", "feature_id")

    def scan(certain: bool):
        def run(frames: Iterator[pd.DataFrame], gene: pd.DataFrame, e: np.ndarray) -> Iterator[pd.DataFrame]:
            e = _unit(e)
            for frame in _ranges(frames):
                yield from _range_hits(frame, gene, e, (trans_t, cis_t), (trans_cut, cis_cut), reach, cis_reach, halo * reach, certain)

        return scan_blocks(dealt, genes, run, schema, block_bytes, dealt=True)

    border = cut_lineage(scan(False))
    stay = scan(True).select(*wanted)
    doubtful = border.filter("open").select("gene", "feature_id", "is_cis")
    if not doubtful.limit(1).count():
        return stay
    settled = pruned_hits(border.withColumn("p", -F.col("t")), rows, 1.0, 1.0, cis_cut, trans_cut, reach)
    return stay.unionByName(settled.join(doubtful, ["gene", "feature_id", "is_cis"], "left_semi").select(*wanted))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows about their means and of length one; without variance, NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = x - x.mean(axis=1, keepdims=True)
        return z / np.sqrt((z * z).sum(axis=1, keepdims=True))


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one range at a time, of frames sorted by range."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        names = frame[["chrom", "range"]]
        cuts = np.flatnonzero((names != names.shift()).any(axis=1).to_numpy())
        for a, b in zip(cuts, [*cuts[1:], len(frame)], strict=True):
            part = frame.iloc[a:b]
            if held and (held[0]["range"].iloc[0], held[0]["chrom"].iloc[0]) != (part["range"].iloc[0], part["chrom"].iloc[0]):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _range_hits(frame: pd.DataFrame, gene: pd.DataFrame, e: np.ndarray, t_crit: tuple[float, float], cuts: tuple[float, float], reach: float, cis_reach: float, halo: float, certain: bool) -> Iterator[pd.DataFrame]:
    """The hits of a range's own variants that stay for certain; or else those in doubt and those that
    stay and have a link to a later hit of another range.

    e: unit rows of the genes; t_crit, cuts: of trans and of cis pairs.
    """
    u, pos, core = _unit(np.array(frame["values"].tolist(), float)), frame["pos"].to_numpy(float), frame["core"].to_numpy(bool)
    if u.shape[1] != e.shape[1]:
        raise ValueError("the two matrices have different numbers of individuals")
    df, chrom, ids = u.shape[1] - 2, frame["chrom"].iloc[0], frame["feature_id"].to_numpy()
    if df < 1:
        return
    edge = (pos - reach < float(frame["low"].iloc[0]) - halo) | (pos + reach > float(frame["high"].iloc[0]) + halo)
    upto = np.searchsorted(pos, pos + reach, side="right")
    bars = [t / np.sqrt(df + t * t) * (1 - 1e-9) for t in t_crit]
    for to in range(0, len(e), PRODUCT[1]):
        some = gene.iloc[to : to + PRODUCT[1]]
        r = np.abs(e[to : to + PRODUCT[1]] @ u.T)
        start, own = some["start"].to_numpy(float), some["chrom"].notna().to_numpy() & (some["chrom"] == chrom).to_numpy()
        blank = some["chrom"].isna().to_numpy()
        over = r > bars[0]
        # the few genes with a variant in reach, or with an unknown place, have thresholds by pair
        special = np.flatnonzero(blank | (own & ~((start + cis_reach <= pos[0]) | (start - cis_reach >= pos[-1]))))
        cis = np.zeros((len(special), len(pos)), bool)
        if len(special):
            with np.errstate(invalid="ignore"):
                close = np.abs(pos[None, :] - start[special][:, None]) < cis_reach
            cis = close & own[special][:, None]
            unknown = np.where(blank[special][:, None], close | np.isnan(start[special])[:, None], own[special][:, None] & np.isnan(start[special])[:, None])
            over[special] = (r[special] > np.where(cis, bars[1], bars[0])) & ~unknown
        g, v = np.nonzero(over)
        row = np.full(len(some), -1)
        row[special] = np.arange(len(special))
        kind = np.zeros(len(g), np.int64)
        if len(special):
            kind = np.where(row[g] >= 0, cis[row[g], v], False).astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.sqrt(df) * r[g, v] / np.sqrt(1 - r[g, v] * r[g, v])
        kept = np.isfinite(t) & (t > np.where(kind == 1, t_crit[1], t_crit[0]))
        g, v, kind, t = g[kept], v[kept], kind[kept], np.round(t[kept], 10)
        group = 2 * g + kind
        if kind.any():
            order = np.argsort(group * len(pos) + v, kind="stable")
            g, v, kind, t, group = g[order], v[order], kind[order], t[order], group[order]
        place = group * len(pos) + v
        n = np.searchsorted(place, group * len(pos) + upto[v]) - np.arange(len(v)) - 1
        for a, b in _runs(group, n):
            early, late = _links(u, v[a:b], t[a:b], kind[a:b], n[a:b], ids, cuts)
            state = _states(b - a, early, late, edge[v[a:b]])
            own_hit = core[v[a:b]]
            if certain:
                listed = own_hit & (state == STAYS)
            else:
                crosses = np.zeros(b - a, bool)
                crosses[early[~own_hit[late]]] = True
                listed = own_hit & ((state == DOUBT) | ((state == STAYS) & crosses))
            at = a + np.flatnonzero(listed)
            if len(at):
                rows = frame.iloc[v[at]]
                yield pd.DataFrame({"gene": some["feature_id"].to_numpy()[g[at]], "feature_id": ids[v[at]], "chrom": rows["chrom"].to_numpy(), "pos": rows["pos"].to_numpy(), "is_cis": kind[at] == 1, "t": t[at], "open": state[listed] == DOUBT})


def _runs(group: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole groups with some PAIRS pairs."""
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group)) if len(group) else np.zeros(0, np.int64)
    total, at = np.concatenate(([0], np.cumsum(n))), 0
    while at < len(group):
        k = max(np.searchsorted(total[ends], total[at] + PAIRS, side="right") - 1, np.searchsorted(ends, at, side="right"))
        yield at, int(ends[k])
        at = int(ends[k])


def _links(u: np.ndarray, v: np.ndarray, t: np.ndarray, kind: np.ndarray, n: np.ndarray, ids: np.ndarray, cuts: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) hits of each pair, the n next ones of each, whose |r| exceeds its class's cutoff."""
    a = np.repeat(np.arange(len(v)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
    tight, step = np.zeros(len(a), bool), max(1, PAIRS // u.shape[1])
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        tight[at : at + step] = np.abs(np.einsum("ij,ij->i", u[v[x]], u[v[y]])) > np.where(kind[x] == 1, cuts[1], cuts[0])
    a, b = a[tight], b[tight]
    first = (t[a] > t[b]) | ((t[a] == t[b]) & (ids[v[a]] < ids[v[b]]))
    return np.where(first, a, b), np.where(first, b, a)


def _states(n: int, early: np.ndarray, late: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The state of n hits by their links: a hit goes if an earlier linked one stays; it stays if all of
    them go; it is in doubt if one is, or if it lies at the edge, where links are missing."""
    state, doubt = np.full(n, OPEN, np.int8), edge.copy()
    while True:
        known = state[early]
        state[late[known == STAYS]] = GOES
        live = (state[late] == OPEN) & (known != GOES)
        early, late = early[live], late[live]
        waits = np.zeros(n, bool)
        waits[late[state[early] == OPEN]] = True
        doubt[late[state[early] == DOUBT]] = True
        ready = (state == OPEN) & ~waits
        if not ready.any():
            return state
        state[ready] = np.where(doubt[ready], DOUBT, STAYS)
