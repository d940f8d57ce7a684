"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.cluster import cut_lineage, ship_package

__all__ = ["cut_lineage", "doc_frame", "each_copy", "hash_words", "table"]

#: Columns of the document table and their types.
DOC_COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_frame(docs: DataFrame, *columns: str) -> DataFrame:
    """The document columns that operators read, cast; extra columns are left out."""
    ship_package(docs.sparkSession)
    wanted = columns or ("doc_id", "text")
    return docs.select(*[F.col(c).cast(DOC_COLUMNS[c]).alias(c) for c in wanted])


def hash_words(text: str, fold: bytes) -> list[bytes]:
    """UTF-8 words of a text after a byte translation that maps separators to blanks."""
    return text.encode("utf-8", "surrogatepass").translate(fold).split()


#: Copies of a row that one step numbers.
COPIES = 1000


def each_copy(rows: DataFrame, n: str, out: str) -> DataFrame:
    """Each row as often as its column ``n`` says, numbered from 0 in the column ``out``.

    A row with many copies is cut into blocks of COPIES first, and the blocks are dealt
    out, so neither an array nor a task grows with the number of copies.
    """
    last = lambda c: F.sequence(F.lit(0).cast("long"), c)
    few = rows.filter(F.col(n) <= COPIES).withColumn(out, F.explode(last(F.col(n) - 1)))
    blocks = rows.filter(F.col(n) > COPIES).withColumn("__block", F.explode(last(F.floor((F.col(n) - 1) / COPIES))))
    inside = last(F.least(F.lit(COPIES), F.col(n) - F.col("__block") * COPIES) - 1)
    many = blocks.repartition(*[F.col(f"`{c}`") for c in blocks.columns]).withColumn(out, F.explode(inside)).withColumn(out, F.col(out) + F.col("__block") * COPIES).drop("__block")
    return few.unionByName(many)
