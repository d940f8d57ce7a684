"""Stored tables: column tables, matrix tables and pair tables on Parquet.

A store is a folder with one Parquet folder per table.  Rows are addressed by an
explicit ``feature_id`` made at import and never by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, store: str, name: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """All or chosen columns of a table, with an optional predicate; both reach the scan."""
    df = spark.read.parquet(f"{store}/{name}")
    df = df if where is None else df.filter(where)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, store: str, name: str, partition_by: list[str] | None = None) -> None:
    """Write a table, or append to it if it exists; then the columns must be the same."""
    path = f"{store}/{name}"
    if _exists(df.sparkSession, path):
        stored = df.sparkSession.read.parquet(path)
        if set(stored.columns) != set(df.columns):
            raise ValueError(f"columns differ: stored {sorted(stored.columns)}, given {sorted(df.columns)}")
        df = df.select(*[F.col(c).cast(t) for c, t in stored.dtypes])
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_column(spark: SparkSession, store: str, name: str, column: str, offset: int | None = None, count: int | None = None) -> DataFrame:
    """One column, or the slice of ``count`` rows from a 0-based offset by feature_id.

    Reading past the end is an error.
    """
    df = read_table(spark, store, name)
    if offset is None:
        return df.select(column)
    last = df.agg(F.max("feature_id")).first()[0]
    if last is None or offset + count > last:
        raise IndexError(f"rows {offset} to {offset + count} of {last}")
    return df.filter(F.col("feature_id").between(offset + 1, offset + count)).orderBy("feature_id").select(column)


def read_block(spark: SparkSession, store: str, name: str, first: int, count: int, ind_first: int | None = None, ind_count: int | None = None) -> DataFrame:
    """Features first .. first + count - 1 of a matrix table, clipped at its end; and a
    range of individuals (1-based) if asked."""
    df = read_table(spark, store, name).filter(F.col("feature_id").between(first, first + count - 1))
    return df if ind_first is None else df.withColumn("values", F.slice("values", ind_first, ind_count))


def read_features(spark: SparkSession, store: str, name: str, index: DataFrame) -> DataFrame:
    """Features by an index table (pos, feature_id), in its order and as often as it names them."""
    return index.join(read_table(spark, store, name), "feature_id").orderBy("pos")


def take_individuals(matrix: DataFrame, index: list[int]) -> DataFrame:
    """The values of some individuals (1-based), in the given order."""
    return matrix.withColumn("values", F.transform(F.array(*map(F.lit, index)), lambda i: F.element_at("values", i)))


def append_matrix(df: DataFrame, store: str, name: str) -> None:
    """Append features; each must have as many individuals as those stored."""
    wanted = F.size("values")
    if _exists(df.sparkSession, f"{store}/{name}"):
        stored = read_table(df.sparkSession, store, name).agg(F.max(wanted)).first()[0]
        if df.filter(wanted != stored).limit(1).count():
            raise ValueError(f"a feature has another number of individuals than the stored {stored}")
    write_table(df, store, name)


def copy_features(spark: SparkSession, store: str, name: str, index: DataFrame, target: str) -> int:
    """Copy features by index to another table; the number copied must equal the index's."""
    part = read_features(spark, store, name, index)
    n, wanted = part.count(), index.count()
    if n != wanted:
        raise ValueError(f"{n} of {wanted} features found")
    append_matrix(part.drop("pos"), store, target)
    return n


def append_table(spark: SparkSession, store: str, source: str, target: str) -> None:
    """Append one stored table to another."""
    write_table(read_table(spark, store, source), store, target)


def describe_store(spark: SparkSession, store: str, names: list[str]) -> DataFrame:
    """(table_name, column_name, type, n_rows) of stored tables."""
    out = []
    for name in names:
        df = read_table(spark, store, name)
        n = df.count()
        out += [(name, c, t, n) for c, t in df.dtypes]
    return spark.createDataFrame(out, "table_name string, column_name string, type string, n_rows long")


#: Tiles of a pair table that one folder holds, by row and by column, and files of a folder at most per write.
FOLDER_TILES, FOLDER_FILES = 256, 8


def write_pair_block(pairs: DataFrame, store: str, name: str, tile: int) -> None:
    """Write a block of a pair table; its (row, column) tiles replace stored ones.

    A folder holds a square of tiles, so a large table has few folders and files.  The folders that
    the block touches are written anew: their stored tiles that the block lacks, and the block.
    """
    spark, path = pairs.sparkSession, f"{store}/{name}"
    at = lambda c: F.floor((F.col(c) - 1) / tile)
    folder = lambda c: F.coalesce(F.floor(F.col(c) / FOLDER_TILES), F.lit(-1))
    block = pairs.withColumn("row_block", at("i")).withColumn("col_block", at("j")).withColumn("row_folder", folder("row_block")).withColumn("col_folder", folder("col_block"))
    if _exists(spark, path):
        block = cut_lineage(block)
        tiles = block.select("row_folder", "col_folder", "row_block", "col_block").distinct()
        touched = [(r["row_folder"], r["col_folder"]) for r in tiles.select("row_folder", "col_folder").distinct().toLocalIterator()]
        stored = spark.read.schema(block.schema).parquet(path)
        gone = tiles.select(F.col("row_block").alias("_row"), F.col("col_block").alias("_col"))
        for first in range(0, len(touched), 256):
            some = touched[first : first + 256]
            own = spark.createDataFrame(some, "row_folder long, col_folder long")
            old = stored.filter(F.col("row_folder").isin(sorted({r for r, _ in some}))).join(F.broadcast(own), ["row_folder", "col_folder"], "left_semi")
            left = old.join(gone, F.col("row_block").eqNullSafe(F.col("_row")) & F.col("col_block").eqNullSafe(F.col("_col")), "left_anti")
            both = left.select(block.columns).unionByName(block.join(F.broadcast(own), ["row_folder", "col_folder"], "left_semi").select(block.columns))
            _write_folders(cut_lineage(both), path)
    else:
        _write_folders(block, path)


def _write_folders(block: DataFrame, path: str) -> None:
    dealt = block.repartition("row_folder", "col_folder", F.pmod("row_block", F.lit(FOLDER_FILES)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("row_folder", "col_folder").parquet(path)


def band_to_pairs(band: DataFrame) -> DataFrame:
    """(i, j, value) of both triangles from rows (i, diagonals): the value d places right of
    the diagonal is at (i, i + d)."""
    upper = band.select("i", F.posexplode("diagonals").alias("d", "value")).select("i", (F.col("i") + F.col("d")).alias("j"), "value").filter("value is not null")
    return upper.union(upper.filter("i <> j").select("j", "i", "value"))


def summary_bundle(effects: DataFrame, ld: DataFrame, rsids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effects and LD pairs of a list of rsids; every one must have an effect row.

    ld: (i, j, r) by rsid.
    """
    own = effects.join(rsids.select("rsid").distinct(), "rsid", "left_semi")
    if own.select("rsid").distinct().count() != rsids.select("rsid").distinct().count():
        raise ValueError("an rsid of the list has no effect row")
    keys = rsids.select("rsid").distinct()
    near = ld.join(keys.withColumnRenamed("rsid", "i"), "i", "left_semi").join(keys.withColumnRenamed("rsid", "j"), "j", "left_semi")
    return own, near


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an external database through JDBC; projections and filters are pushed down."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header."""
    df.write.option("sep", sep).option("header", True).csv(path)


def write_by_chromosome(df: DataFrame, store: str, name: str, column: str = "chrom") -> None:
    """One folder per chromosome; a read of one chromosome is pruned to its folder."""
    write_table(df, store, name, [column])
