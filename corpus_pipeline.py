"""A training corpus from raw documents: toxicity, exact dedup, SimHash near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result to the shared folder and reads it again as the next one's input. Rows whose identifier is null
are kept or dropped by the same rules, equal to other nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.op1_sentencepiece import encode_decode
from loomspark.llm.op6_toxicity import toxicity
from loomspark.llm.op7_exact import exact_dedup
from loomspark.llm.op8_decontaminate import decontaminate
from loomspark.llm.op10_simhash import simhash_components
from loomspark.llm.textops import cut, load
from loomspark.ship import ship

#: No SQL: the first and third stages have none.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't predict to be toxic."""
    ship(spark)
    return toxicity(docs, load(spark, sf_dir, "labels"), keep=tuple(docs.columns)).filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts."""
    ship(spark)
    return exact_dedup(docs, payload=True).filter("kept").select("row.*")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the struct of identifier and text hash that tells rows apart, under a name that no column has."""
    name, taken = "key", {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return docs.withColumn(name, F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))), name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of linked fingerprints; of rows that repeat identifier and text, one."""
    ship(spark)
    keyed, key = _keyed(docs)
    found = cut(simhash_components(keyed.select("doc_id", "text", F.col(key).alias("key")), keep=("key",)), "near")
    order = F.struct(F.col("key.id").isNull().alias("null"), "key")
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("fp"))
    best = cut(found.groupBy(group.alias("g")).agg(F.min(order).alias("best")).select(F.col("best.key").alias(key)), "best")
    kept = keyed.join(F.broadcast(best) if best.count() <= MOST_BROADCAST else best, key, "left_semi")
    twice = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")  # only repeated rows need their texts brought together
    return (kept if twice.isEmpty() else kept.dropDuplicates([key])).drop(key)


#: Rows to keep that are broadcast at most; more of them are joined by shuffle.
MOST_BROADCAST = 500_000

#: A text with so many words of benchmark passages goes, however long it is.
LEAST_HIT = 8


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. A passage of LEAST_HIT words is enough; shorter items, which are everyday phrases, must be a twentieth of the text."""
    ship(spark)
    keyed, key = _keyed(docs)
    found = decontaminate(keyed.select("doc_id", "text", F.col(key).alias("key")), load(spark, sf_dir, "benchmark"), keep=("key",))
    gone = found.filter(F.col("contaminated") | (F.col("n_hit") >= LEAST_HIT)).select(F.col("key").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").drop(key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' digest and the decoded text's digest of each document."""
    ship(spark)
    return encode_decode(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
