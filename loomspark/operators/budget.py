"""Fitting ranked items, turns and texts into token budgets, by windows over any number of sets at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines, token_count


#: Counts the tokens of a text column; the estimate by default, a tokenizer's pandas UDF can be given.
Counter = Callable[[Column], Column]


def prefix_fit(ranked: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: Column, header: int = 0) -> DataFrame:
    """The leading rows of each set whose running cost and header stay within the budget. Costs are positive."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(cost).over(w) + F.lit(header)).filter(F.col("used") <= budget)


def newest_fit(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", counter: Counter = token_count) -> DataFrame:
    """The newest turns of each conversation within the budget; the newest stays even if it alone is over."""
    cost = counter(F.concat_ws(": ", "role", "text"))
    w = Window.partitionBy(key).orderBy(F.desc(order))
    used = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("used", used).withColumn("age", F.row_number().over(w)).filter((F.col("age") == 1) | (F.col("used") <= budget))


def last_k(turns: DataFrame, k: int = 4, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds `older`: whether a turn is before the last k. k = 0 keeps all turns."""
    return turns.withColumn("older", (F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) > k) & F.lit(k > 0))


def clip_head(texts: DataFrame, text: str, budget: int, marker: str = "… (clipped)", counter: Counter = token_count) -> DataFrame:
    """Adds `clipped`: the text if it fits, else its leading lines that do and a marker line. Works within a row."""
    lines = split_lines(F.col(text))
    step = lambda a, x: F.struct((a["used"] + counter(x)).alias("used"), (a["n"] + F.when(a["used"] + counter(x) <= budget, 1).otherwise(0)).alias("n"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))
    n = F.aggregate(lines, zero, step, lambda a: a["n"])
    head = F.array_join(F.slice(lines, F.lit(1), n), "\n")
    return texts.withColumn("clipped", F.when((F.length(text) == 0) | (counter(F.col(text)) <= budget), F.col(text)).otherwise(F.concat(head, F.lit("\n" + marker))))


def greedy_fit(items: DataFrame, budget: Column, key: str = "set_id", idx: str = "item_idx") -> DataFrame:
    """Demotes and drops items (set_id, item_idx, costs array<bigint> by rung, relevance, priority) until each set fits.

    Demotions go to the item with the least relevance for each token, the first of equals; then the droppable item
    (priority <= 0) with the least (priority, relevance). As windows: steps of all items sorted by the running maximum of
    their density are the order of the greedy loop, and a step runs while every total before it is over the budget.
    Returns the items with level, dropped and cost.
    """
    steps = items.select(key, idx, "relevance", "costs", F.posexplode("costs").alias("level", "cost")).filter(F.col("level") < F.size("costs") - 1)
    density = F.col("relevance") / F.greatest(F.lit(1), F.col("cost"))
    own = Window.partitionBy(key, idx).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.get("costs", F.col("level") + 1) - F.col("cost")
    steps = steps.select(key, idx, "level", delta.alias("delta"), F.max(density).over(own).alias("head"))
    start = items.groupBy(key).agg(F.sum(F.get("costs", F.lit(0))).alias("start"))
    line = Window.partitionBy(key).orderBy("head", idx, "level")
    before = F.col("start") + F.coalesce(F.sum("delta").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ran = steps.join(start, key).withColumn("before", before).withColumn("least", F.min("before").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    done = ran.groupBy(key, idx).agg(F.count_if(F.col("least") > budget).alias("level"))
    ended = ran.groupBy(key).agg((F.min("before") > budget).alias("all_over"), F.sum("delta").alias("shrunk"))
    levelled = items.join(done, [key, idx], "left").join(start, key).join(ended, key, "left").withColumn("level", F.coalesce("level", F.lit(0)).cast("int"))
    levelled = levelled.withColumn("cost", F.get("costs", F.col("level")))
    total = F.col("start") + F.coalesce("shrunk", F.lit(0))
    exhausted = F.coalesce("all_over", F.lit(True)) & (total > budget)
    drops = Window.partitionBy(key).orderBy(F.col("droppable").desc(), "priority", "relevance", idx)
    gone = F.coalesce(F.sum("cost").over(drops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = levelled.withColumn("droppable", F.col("priority") <= 0).withColumn("dropped", exhausted & F.col("droppable") & (total - gone > budget))
    return out.select(*items.columns, "level", "cost", "dropped")


def fit_report(fitted: DataFrame, budget: Column, key: str = "set_id") -> DataFrame:
    """One row for each set: fit, tokens before and after, demotions, drops, note."""
    after = F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("cost"))), F.lit(0))
    out = fitted.groupBy(key).agg(F.sum(F.get("costs", F.lit(0))).alias("tokens_before"), after.alias("tokens_after"), F.sum("level").alias("demotions"), F.count_if("dropped").alias("drops"))
    return out.withColumn("fit", F.col("tokens_after") <= budget).withColumn("note", F.when(~F.col("fit"), F.lit("budget exceeded; nothing left to demote or drop")))
