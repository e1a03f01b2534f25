"""Distilling older turns of conversations into a decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_mentions, first_line
from .budget import last_k


NO_REQUEST, NO_ANSWER = "(nothing asked)", "(nothing answered)"


def now_seconds() -> Column:
    """Seconds since the epoch."""
    return F.unix_micros(F.current_timestamp()) / 1e6


def distill(turns: DataFrame, now=None, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One decision for each conversation: first user line, first assistant line, the first ten files mentioned, in order."""
    said = lambda role: F.coalesce(F.min_by("text", F.when(F.col("role") == role, F.col(order))), F.lit(""))
    per = turns.groupBy(key).agg(
        said("user").alias("user"), said("assistant").alias("assistant"), F.array_sort(F.collect_list(F.struct(order, file_mentions(F.col("text")).alias("files")))).alias("all")
    )
    files = F.slice(F.array_distinct(F.flatten(F.transform("all", lambda x: x["files"]))), 1, 10)
    text = lambda c, other: F.when(F.length(first_line(F.col(c), 160)) > 0, first_line(F.col(c), 160)).otherwise(F.lit(other))
    return per.select(key, text("user", NO_REQUEST).alias("decision"), text("assistant", NO_ANSWER).alias("rationale"), files.alias("files_touched"), *([now.alias("timestamp")] if now is not None else []))


def compress(turns: DataFrame, k: int = 4, key: str = "conv_id", order: str = "turn", now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The decisions of the turns before the last k, with the time `now` (the current one by default), and counts for each conversation (compressed, kept_verbatim)."""
    marked = last_k(turns, k, key, order)
    counts = marked.groupBy(key).agg(F.count_if("older").alias("compressed"), F.count_if(~F.col("older")).alias("kept_verbatim"))
    return distill(marked.filter("older").drop("older"), now_seconds() if now is None else now, key, order), counts


def log_tail(log: DataFrame, limit: int, order: tuple[str, ...] = ("timestamp", "pos")) -> DataFrame:
    """The last `limit` entries in the log's order, by time and then place; 0 keeps all."""
    tail = log if limit == 0 else log.orderBy(*map(F.desc, order)).limit(limit)
    return tail.orderBy(*order)


def new_entries(entries: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Entries whose keys the log doesn't hold, so that a repeated request appends nothing."""
    return entries.join(log.select(*keys).distinct(), keys, "left_anti")


def render_line(decision: str = "decision", rationale: str = "rationale", files: str = "files_touched"):
    touched = F.when(F.size(files) > 0, F.array_join(files, ", ")).otherwise(F.lit("—"))
    return F.concat(F.lit("- "), F.col(decision), F.lit(" ("), F.col(rationale), F.lit(") ["), touched, F.lit("]"))
