"""Incremental ingest keyed by content hash, and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists


def delta(listing: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """path, state of every path in either side (path, hash): parsed, skipped or removed."""
    both = listing.select("path", F.col("hash").alias("new")).join(stored.select("path", F.col("hash").alias("old")), "path", "full_outer")
    same = F.col("new").eqNullSafe(F.col("old")) & F.lit(not force)
    return both.select("path", F.when(F.col("new").isNull(), "removed").when(same, "skipped").otherwise("parsed").alias("state"))


def counters(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("parsed", "skipped", "removed")])


def replace_rows(stored: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "file") -> DataFrame:
    """The stored rows without those of changed or removed paths, and the fresh rows: upsert, replacement, prune and cascade in one anti-join."""
    gone = changes.filter("state <> 'skipped'").select(F.col("path").alias(key))
    return stored.join(gone.hint("merge"), key, "left_anti").unionByName(fresh)


def write_version(df: DataFrame, table: str, version: int) -> str:
    """Writes a new version folder; readers switch once it is complete (its _SUCCESS file stands)."""
    path = f"{table}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines; files that stand aren't touched."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log, in order of its files; none if it was never written to."""
    if not exists(spark, path):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path)
