"""Exact dedup by content sort.

Normalised texts are written once, range-partitioned at sampled splitters (first characters, then digest) and sorted outside
memory by these and the whole text, which places equal texts next to each other; Spark's window operator then compares
neighbours in full and the smallest identifier of a run stays. The digest only breaks ties of the order.

A content with many copies would fill one range. Such contents are found first (digests with many rows, then their rows
grouped by whole content, which combines before its shuffle) and their copies get a salt, so that a run stays small; a row
belongs to a hot content if its whole text equals it. Each hot content has over 1/max_hot of the rows, so there are at most
`max_hot` and all their texts together have at most max_hot times the mean length: that bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import cut

#: A run of [\x20\x09-\x0D] that isn't already a single space; replacing only these equals replacing every run.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: Characters of a text that stand in the range key.
HEAD = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: bool = False, min_hot: int = 256, max_hot: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; with payload also `row`, a struct of the input columns.

    Null text counts as empty; empty texts form one group. Whole texts are compared, however long. A null identifier sorts
    last and is kept only where the whole group has none. Rows that repeat an identifier and text: one of them is kept. Other
    columns pass through in `row`, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, RUN, " ")
    base = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.when(~text.eqNullSafe(norm) | F.col(text_col).isNull(), F.struct(F.col(text_col).alias("t"))).alias("_raw")).alias("_row")] if payload else []))
    base = base.withColumn("_sha", F.coalesce(F.sha2("_norm", 256), F.lit("")))  # never null: spares a filter that would hash again
    base = cut(base, "normalised")
    least = max(min_hot, base.count() // max_hot)
    often = base.groupBy("_sha").agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select("_sha")
    whole = base.join(F.broadcast(often), "_sha", "left_semi").groupBy("_sha", "_norm").agg(F.count("*").alias("_n"), F.min("_id").alias("_least")).filter(F.col("_n") > least)
    hot = cut(whole.select(F.col("_sha").alias("_hot_sha"), F.col("_norm").alias("_hot_norm"), "_n", "_least"), "hot")
    salted = base.join(F.broadcast(hot), (F.col("_sha") == F.col("_hot_sha")) & (F.col("_norm") == F.col("_hot_norm")), "left").drop("_hot_sha", "_hot_norm").withColumn(
        "_salt", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / F.lit(least))).cast("int"))
    )
    # Splitters are sampled from the texts' first characters and, where those are shared, their digests: the driver gets short keys.
    ranged = salted.withColumn("_head_bytes", F.substring("_norm", 1, HEAD)).repartitionByRange("_head_bytes", "_sha", "_salt")
    run = Window.partitionBy("_head_bytes", "_sha", "_salt", "_norm").orderBy(F.col("_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = ranged.select("*", F.row_number().over(run).alias("_k"), F.first("_id").over(run).alias("_head"), F.count("*").over(whole).alias("_size"))
    keep = F.when(F.col("_n").isNotNull(), F.col("_least")).otherwise(F.col("_head"))
    if payload:
        from_row = [F.when(F.col("_row._raw").isNotNull(), F.col("_row._raw.t")).otherwise(F.col("_norm")).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    head_of_all = F.col("_id").eqNullSafe(keep) & ((F.col("_salt") == F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / F.lit(least)))) | F.col("_n").isNull())
    return out.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_n", "_size").cast("long").alias("group_size"),
        ((F.col("_k") == 1) & head_of_all).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.struct(*from_row).alias("row")] if payload else []),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .textops import load

    return exact_dedup(load(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
