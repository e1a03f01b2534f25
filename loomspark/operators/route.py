"""Routing of tasks to model tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The task classes.
FRONTIER = ["reasoning", "codegen"]
MECHANICAL = ["summarize", "classify", "distill", "commit_msg", "relevance"]
TIERS = ["cheap_cloud", "frontier", "local"]


def tier(task: Column, forced: str | None = None, prefer_local: bool = True) -> Column:
    """The tier of a task; a forced tier wins, and an unknown task is safe with the frontier."""
    if forced:
        return F.lit(forced)
    return F.when(task.isin(MECHANICAL), F.lit("local" if prefer_local else "cheap_cloud")).otherwise(F.lit("frontier"))


def reason(task: Column, forced: str | None = None, prefer_local: bool = True) -> Column:
    if forced:
        return F.lit("forced")
    mechanical = "mechanical task, local model" if prefer_local else "mechanical task, cheap cloud tier"
    return F.when(task.isin(FRONTIER), "needs the frontier model").when(task.isin(MECHANICAL), mechanical).otherwise("unknown task, safe default")


def model(tier_column: Column, models: dict[str, str]) -> Column:
    """The tier's model; an unknown tier falls to the frontier's."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in models.items() for x in kv])[tier_column], F.lit(models["frontier"]))
