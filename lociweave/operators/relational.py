"""Filters, joins, windows and set operations that plain DataFrame verbs do not name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage
from lociweave.operators.ordered import minimum_from_here, row_numbers, running_total


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order (distinct that keeps the first)."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def group_minimum(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """All rows of each key with the smallest value, ties kept.

    The minimum is a partial aggregate joined back, so a hot key is not one window.
    """
    marked = df.withColumn("_value", value)
    least = marked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_value").alias("_least"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_value") == F.col("_least")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return marked.join(least, cond).select(*df.columns)


def significant(df: DataFrame, effect: str, error: str, t_crit: float) -> DataFrame:
    """Rows whose |effect / error| exceeds a critical value; a plain predicate."""
    return df.filter(F.abs(F.try_divide(F.col(effect), F.col(error))) > t_crit)


def distinct_gate(df: DataFrame, key: str, columns: list[str], more_than: int) -> DataFrame:
    """Rows of the keys that have more than so many distinct values in each column."""
    counts = df.groupBy(key).agg(*[F.count_distinct(c).alias(f"_n_{c}") for c in columns])
    for c in columns:
        counts = counts.filter(F.col(f"_n_{c}") > more_than)
    return df.join(counts.select(key), key, "left_semi")


def group_size_gate(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows of the keys that have more than so many rows."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than).select(key), key, "left_semi")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, how)


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join that renames columns which clash, by suffixes."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, on)


def left_join_fill(left: DataFrame, right: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Left join with defaults for columns that find no partner."""
    return left.join(right, on, "left").fillna(fill)


#: Rows of one side of a bucket that a task sees at most, about; a fuller bucket is split.
BUCKET_ROWS = 20_000


def _split_buckets(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_cell``, so that rows of a bucket (the keys, named alike on both sides)
    that would meet still meet exactly once.

    Rows are counted per bucket.  A bucket with more than ``most`` rows on a side is cut
    into a grid: a row of the left side stands in one line of it, a row of the right side in one
    column, each by hash, and meets the other side's rows where they cross.
    """
    counts = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    full = cut_lineage(counts(left, "_lines").join(counts(right, "_columns"), keys).filter("_lines > 1 or _columns > 1"))
    if not full.limit(1).count():
        return left.withColumn("_cell", F.lit(0).cast("long")), right.withColumn("_cell", F.lit(0).cast("long"))
    place = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns]), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one = F.lit(1).cast("long")
    lines, columns = F.coalesce("_lines", one), F.coalesce("_columns", one)
    cut = lambda df, own, other, cell: df.withColumn("_own", place(df, F.lit(2**31 - 1).cast("long"))).join(full, keys, "left").withColumn("_own", F.pmod(F.col("_own"), own)).withColumn("_other", F.explode(every(other))).withColumn("_cell", cell).drop("_own", "_other", "_lines", "_columns")
    return cut(left, lines, columns, F.col("_own") * columns + F.col("_other")), cut(right, columns, lines, F.col("_other") * columns + F.col("_own"))


def interval_join(points: DataFrame, spans: DataFrame, key: str, pos: str, start: str, end: str, reach: int = 0, inclusive: bool = True, bucket: float = 1_000_000, most: int = BUCKET_ROWS) -> DataFrame:
    """Points within [start - reach, end + reach] of spans of the same key.

    Catalyst would run this as a nested loop per key: both sides are cut into buckets
    instead, a span is listed in each bucket it touches and a point is in one, so every
    pair meets once in an equi-join and a dense key is spread over its buckets; a bucket
    with more than ``most`` rows on a side is split further.
    """
    low, high = F.col(start) - reach, F.col(end) + reach
    listed = spans.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end))).withColumn("_bucket", F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket)))).withColumn("_k", F.col(key)).drop(key)
    placed = points.withColumn("_bucket", F.floor(F.col(pos) / bucket)).withColumn("_k", F.col(key))
    placed, listed = _split_buckets(placed, listed, ["_k", "_bucket"], most)
    inside = (F.col(pos) >= low) & (F.col(pos) <= high) if inclusive else (F.col(pos) > low) & (F.col(pos) < high)
    return placed.join(listed, ["_k", "_bucket", "_cell"]).filter(inside).drop("_k", "_bucket", "_cell")


def cis_flag(pos: Column, start: Column, end: Column, reach: int) -> Column:
    """Inside the span or strictly within reach of its start or its end."""
    return ((pos > start) & (pos < end)) | (F.abs(pos - start) < reach) | (F.abs(pos - end) < reach)


def band_join(df: DataFrame, key: str | None, pos: str, row_id: str, width: float, columns: list[str] | None = None, most: int = BUCKET_ROWS) -> DataFrame:
    """All pairs of rows of one key at most ``width`` apart, each once, as <column>_i, <column>_j.

    Positions are cut into buckets of the band's width: the lower row stays in its own
    bucket and the upper row is listed in its own and the one below, so a pair meets
    exactly once in an equi-join; a bucket with more than ``most`` rows on a side is split
    further.
    """
    wanted = list(dict.fromkeys([*([key] if key else []), row_id, pos, *(columns or [])]))
    placed = df.select(*wanted, F.floor(F.col(pos) / F.lit(width)).alias("_b"), (F.col(key) if key else F.lit(0)).alias("_k"))
    low = placed.select(*[F.col(c).alias(f"{c}_i") for c in wanted], "_k", "_b")
    high = placed.select(*[F.col(c).alias(f"{c}_j") for c in wanted], "_k", F.explode(F.array("_b", F.col("_b") - 1)).alias("_b"))
    low, high = _split_buckets(low, high, ["_k", "_b"], most)
    p_i, p_j, i, j = (F.col(f"{c}_{s}") for c in (pos, row_id) for s in "ij")
    after = (p_i < p_j) | ((p_i == p_j) & (i < j))
    return low.join(high, ["_k", "_b", "_cell"]).filter(after & (p_j - p_i <= width)).drop("_k", "_b", "_cell")


def adjusted_p(df: DataFrame, p: str, out: str, by: list[str] | None = None, order: str = "row_id") -> DataFrame:
    """Benjamini-Hochberg adjusted p, over the whole table or per group; null p stays null.

    Equal p values share one result, so ranks come from counts per distinct p, which are
    stored: the table is read for them and for the result.
    """
    by = by or []
    own = df.filter(F.col(p).isNotNull())
    counts = cut_lineage(own.groupBy(*by, p).agg(F.count(F.lit(1)).alias("_c")))
    sizes = counts.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.sum("_c").alias("_n"))
    ranked = running_total(counts, by, [p], F.col("_c"), "_rank")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    ranked = ranked.join(sizes, same).select(*by, p, (F.col(p) * F.col("_n") / F.col("_rank")).alias("_q"))
    adjusted = minimum_from_here(ranked, by, [p], F.col("_q"), out).withColumn(out, F.least(F.lit(1.0), out))
    on = F.lit(True)
    right = adjusted.select(*[F.col(c).alias(f"_{c}") for c in (*by, p)], out)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(right, on & (F.col(p) == F.col(f"_{p}")), "left").select(*df.columns, out)


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rank with ties at their mean rank."""
    by = by or []
    counts = cut_lineage(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")))
    ranks = running_total(counts, by, [value], F.col("_c"), "_upto").select(*[F.col(c).alias(f"_{c}") for c in (*by, value)], (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    on = F.col(value).eqNullSafe(F.col(f"_{value}"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(ranks, on).select(*df.columns, out)


def share_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Share of the other rows with a smaller value (percent_rank), over the table or per group."""
    by = by or []
    counts = cut_lineage(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")))
    sizes = counts.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.sum("_c").alias("_n"))
    same, on = F.lit(True), F.col(value).eqNullSafe(F.col(f"_{value}"))
    for b in by:
        same, on = same & F.col(f"_{b}").eqNullSafe(F.col(f"_g_{b}")), on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    ranks = running_total(counts, by, [value], F.col("_c"), "_upto").select(*[F.col(c).alias(f"_{c}") for c in (*by, value)], (F.col("_upto") - F.col("_c")).alias("_below"))
    shares = ranks.join(sizes, same).withColumn(out, F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1)).otherwise(0.0))
    return df.join(shares, on).select(*df.columns, out)


def group_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, a column per (name, share), between two values by
    linear interpolation; nulls are left out, and groups without a value.

    Selection by rank: counts per distinct value are run up over ranges of (group, value), and
    the values at the two ranks around each share are picked out, so no group's values are
    held in one task.
    """
    own = df.filter(F.col(value).isNotNull())
    counts = cut_lineage(own.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")))
    sizes = counts.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    ranked = running_total(counts, by, [value], F.col("_c"), "_upto").join(sizes, same)
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto")), F.col(value).cast("double")))
    picked, out = [], []
    for k, (name, share) in enumerate(shares.items()):
        place = (F.col("_n") - 1) * F.lit(float(share))
        picked += [at(F.floor(place) + 1).alias(f"_low{k}"), at(F.ceil(place) + 1).alias(f"_high{k}"), F.first(place - F.floor(place)).alias(f"_part{k}")]
        out.append((F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * F.col(f"_part{k}")).alias(name))
    return ranked.groupBy(*by).agg(*picked).select(*by, *out)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_turn") <= n).drop("_turn")


def strata_sample(df: DataFrame, by: list[str], row_id: str, n: int, seed: int = 1) -> DataFrame:
    """A simple random sample of n rows (or all) of each stratum, the same on every run.

    Rows are ordered by the MD5 of id and seed, so ids of any type will do and another
    seed gives another sample.
    """
    mixed = F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))).cast("binary"))
    return top_n(df.withColumn("_mixed", mixed), by, [F.col("_mixed"), F.col(row_id)], n).drop("_mixed")


def standardise(df: DataFrame, by: list[str], value: str, out: str, divisor: str = "sd") -> DataFrame:
    """(value - group mean) / group sd, or / group variance; null without spread.

    Means and spreads are a partial aggregate joined back, so a hot group is not one window.
    """
    spread = F.stddev_samp(value) if divisor == "sd" else F.var_samp(value)
    groups = df.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.avg(value).alias("_mean"), spread.alias("_spread"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return df.join(groups, same).select(*df.columns, F.try_divide(F.col(value) - F.col("_mean"), F.col("_spread")).alias(out))


def multiset_intersect(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of both tables, each as often as in the table that has it less often, sorted."""
    return left.select(column).intersectAll(right.select(column)).orderBy(column)


def chunks(df: DataFrame, order: str, size: int | None = None, count: int | None = None) -> DataFrame:
    """chunk_id by equal chunks of a row order; exactly one of size and count is given.

    Rows are numbered by ranges of the order, so no task sees the whole table.
    """
    if (size is None) == (count is None):
        raise ValueError("give either size or count")
    total = df.count()
    n = count if count is not None else max(1, -(-total // size))
    big, rest = total // n if n else 0, total % n if n else 0
    edge = rest * (big + 1)
    chunk = F.when(F.col("_row") < edge, F.floor(F.col("_row") / max(1, big + 1))).otherwise(rest + F.floor((F.col("_row") - edge) / max(1, big)))
    return row_numbers(df, [order], "_number").withColumn("_row", F.col("_number") - 1).withColumn("chunk_id", (chunk + 1).cast("long")).drop("_row", "_number")


def tile_number(index: Column, size: int) -> Column:
    """1-based tile of a 1-based index."""
    return (F.floor((index - 1) / F.lit(size)) + 1).cast("long")


def histogram_2d(df: DataFrame, x: tuple[str, float, float, int], y: tuple[str, float, float, int]) -> DataFrame:
    """(bin_x, bin_y, n) of two columns, each given as (name, from, to, bins); bins count from
    1, and values outside are left out."""
    inside, place = F.lit(True), []
    for name, low, high, bins in (x, y):
        inside = inside & (F.col(name) >= low) & (F.col(name) < high)
        place.append((F.floor((F.col(name) - low) / ((high - low) / bins)) + 1).cast("long"))
    return df.filter(inside).groupBy(place[0].alias("bin_x"), place[1].alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def genes_per_variant(pairs: DataFrame, first: DataFrame, second: DataFrame, snp: str = "snp", gene: str = "gene", p: str = "p") -> DataFrame:
    """(snp, genes, p_first, p_second): the distinct genes of each variant, and its smallest p
    in each of two studies, null where a study lacks it."""
    least = lambda df, name: df.groupBy(snp).agg(F.min(p).alias(name))
    counted = pairs.groupBy(snp).agg(F.count_distinct(gene).alias("genes"))
    return counted.join(least(first, "p_first"), snp, "left").join(least(second, "p_second"), snp, "left")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts of equal-width bins, one row per non-empty bin and group; values outside are left out."""
    bin_ = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")
    return df.filter((F.col(value) >= low) & (F.col(value) < high)).groupBy(*(by or []), bin_).agg(F.count(F.lit(1)).alias("n"))


def nest(df: DataFrame, key: str, columns: list[str], most: int = 100_000) -> DataFrame:
    """(key, part, data): the rows of each key as arrays of structs.

    A key has one array, part 0, unless it has more than ``most`` rows: those are dealt by
    hash to parts of about that many, so no array and no task grows with a hot key.
    """
    own = df.select(key, *columns)
    hot = own.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts")).filter("_parts > 1")
    dealt = own.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*columns), F.col("_parts")), F.lit(0)))
    return dealt.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("data"))


def unnest(df: DataFrame, key: str) -> DataFrame:
    """The rows of ``nest``."""
    return df.select(key, F.inline("data"))
