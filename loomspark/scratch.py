"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes an execution's shuffle files when it ends; what a written table was made from isn't needed any more.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: set[str] = set()


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as Spark's readers name files."""
    fs, at = _at(spark, path)
    return fs.makeQualified(at).toString()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode may the setting be missing, then a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(os.path.abspath(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")), "_work")
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder. What the application leaves there is deleted when the driver exits."""
    own = f"{shared_folder(spark)}/loomspark-{spark.sparkContext.applicationId}"
    if own not in _MADE:
        _MADE.add(own)
        fs, at = _at(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for t in tables:
        fs, at = _at(t.sparkSession, t.cut_path)
        fs.delete(at, True)
