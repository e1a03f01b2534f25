"""Labelled training rows: folds by the identifier's checksum and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """text, label (0 or 1) of at most `most` labelled documents outside the held-out fold, chosen by a hash of the identifier.

    Null labels and identifiers are left out; of labels that repeat an identifier the largest counts, of texts that repeat
    one the first in order. The labels' identifiers are bounded by `most`, so they are broadcast, and so are the rows.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return chosen.groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("text", F.col("_label").alias("label"))
