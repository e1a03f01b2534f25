"""Request costs and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: List prices in USD for a million tokens (fresh input, cached input, output). A mapping of model names to such triples can be given instead.
PRICES = {"top": (15.0, 1.5, 75.0), "middle": (3.0, 0.3, 15.0), "small": (0.8, 0.08, 4.0)}
DEFAULT = "middle"


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in (prices or PRICES).items()], "model string, p_in double, p_cached double, p_out double")


def request_costs(requests: DataFrame, prices: dict | None = None, default: tuple = PRICES[DEFAULT]) -> DataFrame:
    """Adds cache_hit_rate, cost_usd and naive_usd (all input at the full price) to rows with model, fresh_in, cached_in, out."""
    table = F.broadcast(price_table(requests.sparkSession, prices))  # a few rows from the code
    joined = requests.join(table, "model", "left")
    p_in, p_cached, p_out = (F.coalesce(c, F.lit(v)) for c, v in zip(("p_in", "p_cached", "p_out"), default, strict=True))
    total = F.col("fresh_in") + F.col("cached_in")
    made = {"cache_hit_rate", "cost_usd", "naive_usd"}  # a log's rows have some of them
    return joined.select(
        *[c for c in requests.columns if c not in made],
        F.when(total > 0, F.col("cached_in") / total).otherwise(0.0).alias("cache_hit_rate"),
        ((F.col("fresh_in") * p_in + F.col("cached_in") * p_cached + F.col("out") * p_out) / 1e6).alias("cost_usd"),
        ((total * p_in + F.col("out") * p_out) / 1e6).alias("naive_usd"),
    )


def record(requests: DataFrame, prices: dict | None = None, now: Column | None = None) -> DataFrame:
    """Log rows of requests (model, fresh_in, cached_in, out, command): with the time, hit rate and cost."""
    at = (F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now).cast("double")
    costs = request_costs(requests, prices)
    return costs.select(at.alias("ts"), "model", "fresh_in", "cached_in", "out", "cache_hit_rate", "cost_usd", F.coalesce("command", F.lit("")).alias("command"))


def summary(costs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Requests, tokens, hit rate (a ratio of sums) and costs, over all or for each key."""
    total = F.sum("fresh_in") + F.sum("cached_in")
    out = costs.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.sum("fresh_in").alias("fresh_in"), F.sum("cached_in").alias("cached_in"), F.sum("out").alias("out"),
        F.coalesce(F.when(total > 0, F.sum("cached_in") / total), F.lit(0.0)).alias("cache_hit_rate"), F.sum("cost_usd").alias("cost"), F.sum("naive_usd").alias("naive"),
    )
    return out.select(*keys, "requests", "fresh_in", "cached_in", "out", F.round("cache_hit_rate", 4).alias("cache_hit_rate"), F.round("cost", 4).alias("cost_usd"), F.round("naive", 4).alias("cost_without_cache_usd"), F.round(F.col("naive") - F.col("cost"), 4).alias("saved_usd"))
