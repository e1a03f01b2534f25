"""Prompts in six layers with budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, token_count
from ..sources.files import Budgets
from .budget import Counter, clip_head, newest_fit

# Layers in order and those that are cached.
LAYERS = {"system": 1, "repo_map": 2, "decision_log": 3, "snippets": 4, "verbatim": 5, "user": 6}
CACHED = [1, 2, 3]


def verbatim_text(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", counter: Counter = token_count) -> DataFrame:
    """key, text of the newest turns that fit, oldest first."""
    kept = newest_fit(turns, budget, key, order, counter)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), F.concat_ws(": ", "role", "text").alias("line"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("text"))


def snippets_text(fitted: DataFrame, key: str = "set_id") -> DataFrame:
    """key, text of fitted items with column rungs: dropped and blank ones are left out."""
    body = F.get("rungs", F.col("level"))
    kept = fitted.filter(~F.col("dropped")).select(key, "item_idx", body.alias("body")).filter(~is_blank(F.col("body")))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "body"))), lambda x: x["body"]), "\n\n").alias("text"))


def assemble(layers: dict[str, DataFrame], budgets: Budgets = Budgets(), key: str = "conv_id", counter: Counter = token_count) -> DataFrame:  # noqa: B008
    """key, layer, text, cached, tokens of the blocks that aren't blank. layers: name to (key, text); map and log are clipped to their budgets."""
    parts = []
    for name, df in layers.items():
        df = df.select(key, "text")
        if name in ("repo_map", "decision_log"):
            df = clip_head(df, "text", budgets.share(name), counter=counter).select(key, F.col("clipped").alias("text"))
        parts.append(df.withColumn("layer", F.lit(LAYERS[name])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(~is_blank(F.col("text"))).select(key, "layer", "text", F.col("layer").isin(CACHED).alias("cached"), counter(F.col("text")).alias("tokens"))


def notes(layers: dict[str, DataFrame], budgets: Budgets = Budgets(), reports: DataFrame | None = None, key: str = "conv_id", counter: Counter = token_count) -> DataFrame:  # noqa: B008
    """key, note: a layer that was clipped, and the note of a fit report (key, note), in order."""
    rows = [df.filter(counter(F.col("text")) > budgets.share(name)).select(key, F.lit(LAYERS[name]).alias("layer"), F.lit(f"{name} clipped to {budgets.share(name)} tokens").alias("note")) for name, df in layers.items() if name in ("repo_map", "decision_log")]
    if reports is not None:
        rows.append(reports.filter("note IS NOT NULL").select(key, F.lit(LAYERS["snippets"]).alias("layer"), "note"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "note"))), lambda x: x["note"]).alias("notes"))


def reshape(blocks: DataFrame, style: str = "system", key: str = "conv_id") -> DataFrame:
    """key, payload: the JSON that goes to a model. style 'system' has the cached parts in `system` and one user message; 'messages' has a system message before it."""
    parts = to_messages(blocks, key)
    user = F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))
    if style == "system":
        body = F.struct("system", F.array(user).alias("messages"))
    else:
        joined = F.array_join(F.transform("system", lambda x: x["text"]), "\n\n")
        head = F.array(F.struct(F.lit("system").alias("role"), joined.alias("content")))
        body = F.struct(F.when(F.size("system") > 0, F.concat(head, F.array(user))).otherwise(F.array(user)).alias("messages"))
    return parts.select(key, F.to_json(body).alias("payload"))


def totals(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """Cached, fresh and all tokens, and the last cached layer of each prompt."""
    zero = F.lit(0).cast("long")
    cached = F.coalesce(F.sum(F.when(F.col("cached"), F.col("tokens"))), zero)
    fresh = F.coalesce(F.sum(F.when(~F.col("cached"), F.col("tokens"))), zero)
    return blocks.groupBy(key).agg(cached.alias("cached_tokens"), fresh.alias("fresh_tokens"), F.sum("tokens").alias("total_tokens"), F.max(F.when(F.col("cached"), F.col("layer"))).alias("breakpoint_after"))


def to_text(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("layer", "text")))
    return blocks.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("prompt"))


def to_messages(blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, system (array of text and cache marker, which the last cached part has), user (the rest, joined)."""
    rows = F.array_sort(F.collect_list(F.struct("layer", "text", "cached")))
    per = blocks.groupBy(key).agg(rows.alias("rows"))
    cached = F.filter("rows", lambda x: x["cached"])
    system = F.transform(cached, lambda x, i: F.struct(x["text"].alias("text"), (i == F.size(cached) - 1).alias("cache_marker")))
    user = F.array_join(F.transform(F.filter("rows", lambda x: ~x["cached"]), lambda x: x["text"]), "\n\n")
    return per.select(key, system.alias("system"), user.alias("user"))
