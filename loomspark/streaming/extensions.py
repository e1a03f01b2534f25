"""Streaming forms of the incremental operators; extensions, since the batch semantics have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import request_costs
from ..sources.files import REQUEST


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REQUEST).json(folder)


def windowed_costs(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and cost for each window and model, with a watermark on ts (seconds since the epoch)."""
    timed = request_costs(requests.select("ts", "model", "fresh_in", "cached_in", "out")).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "model").agg(F.count("*").alias("requests"), F.sum("cost_usd").alias("cost_usd"))


def reindex(files: DataFrame, upsert, checkpoint: str):
    """A stream of files (path, text, hash, lang) whose batches go to upsert(batch, id); start() it with a trigger."""
    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def log_once(decisions: DataFrame, late: str = "1 day") -> DataFrame:
    """A decision stream (conv_id, last_turn, at, ...) without entries that were appended before."""
    return decisions.withWatermark("at", late).dropDuplicatesWithinWatermark(["conv_id", "last_turn"])
