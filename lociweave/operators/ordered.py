"""Running totals, minima and row numbers over an order, without one task per group.

A window over a whole table or a hot group runs in one task.  Here the rows are
range-partitioned by (group, order) and written once, so that every row's partition is
fixed; each partition runs its own window, and the partitions' totals, one row per
partition and group in it, are what the later partitions start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage


def _spread(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with the number of their range partition, stored."""
    return cut_lineage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def _in_parts(rows: DataFrame) -> DataFrame:
    """The stored rows, whole range partitions together; ranges of part numbers deal them out
    evenly, where a hash of few numbers would put several into one task."""
    return rows.repartitionByRange("_part")


def _join_start(rows: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's ``_start`` in their partition.

    A group that goes on from one partition to the next is the last one there and the first
    one here, so there are at most as many starts as partitions, and they are broadcast.
    """
    on = F.col("_part") == F.col("_s_part")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_s_{b}"))
    return rows.join(F.broadcast(starts.filter("_start is not null")), on, "left").drop("_s_part", *[f"_s_{b}" for b in by])


def _scan(df: DataFrame, by: list[str], order: list[str], value: Column, out: str, total, merge, backward: bool, in_order: bool = False) -> DataFrame:
    rows = _spread(df, by, order).withColumn("_value", value)
    if in_order:  # a partition's last value is that of its greatest row
        at = F.struct(*order, "_value")
        parts = rows.groupBy(*by, "_part").agg(F.max(F.when(F.col("_value").isNotNull(), at))["_value"].alias("_total"))
    else:
        parts = rows.groupBy(*by, "_part").agg(total("_value").alias("_total"))
    step = Window.partitionBy(*by).orderBy(F.desc("_part") if backward else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_part").alias("_s_part"), *[F.col(b).alias(f"_s_{b}") for b in by], total("_total").over(step).alias("_start"))
    keys = [F.desc(o) for o in order] if backward else [F.col(o) for o in order]
    inside = Window.partitionBy("_part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    scanned = _join_start(_in_parts(rows).withColumn("_inside", total("_value").over(inside)), starts, by)
    return scanned.select(*df.columns, merge(F.col("_start"), F.col("_inside")).alias(out))


def running_total(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of a value over the group's rows up to each row; the order must be total."""
    return _scan(df, by, order, value, out, F.sum, lambda start, inside: F.coalesce(start, F.lit(0)) + inside, False)


def minimum_from_here(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the smallest value over the group's rows from each row on; the order must be total."""
    return _scan(df, by, order, value, out, F.min, F.least, True)


def last_value(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the last value that is not null of the group's rows up to each row; rows that tie
    in the order must have equal values."""
    last = lambda c: F.last(c, ignorenulls=True)
    return _scan(df, by, order, value, out, last, lambda start, inside: F.coalesce(inside, start), False, in_order=True)


def row_numbers(df: DataFrame, order: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Adds row numbers from 1 in an order, over the table or per group."""
    return running_total(df, by or [], order, F.lit(1), out).withColumn(out, F.col(out).cast("long"))


def next_value(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """Adds the group's next value of the order column, null for the last row; the order must be total."""
    rows = _spread(df, by, [order])
    parts = rows.groupBy(*by, "_part").agg(F.min(order).alias("_least"))
    later = Window.partitionBy(*by).orderBy("_part")
    starts = parts.select(F.col("_part").alias("_s_part"), *[F.col(b).alias(f"_s_{b}") for b in by], F.lead("_least").over(later).alias("_start"))
    inside = F.lead(order).over(Window.partitionBy("_part", *by).orderBy(order))
    return _join_start(_in_parts(rows).withColumn("_inside", inside), starts, by).select(*df.columns, F.coalesce("_inside", "_start").alias(out))
