"""Getting the package's code to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions and models that run in Python workers refer to the package by name.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lociweave-")) / "lociweave_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without one gets a temporary folder; executors on other machines
    could not see it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with this application's other stages."""
    return f"{_stages(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor
    costs a reread and not the work before it."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stages(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
