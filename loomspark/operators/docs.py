"""Document conversion with a content-addressed cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists
from ..sources.files import TEXTLIKE, suffix, utf8


def html_text(html: Column) -> Column:
    """Text of an HTML page: no scripts, styles, comments or tags; white space made single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


CACHE = "digest string, markdown string"


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The stored conversions; none if there are none yet."""
    return spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)


def convert_stored(documents: DataFrame, cache_path: str) -> DataFrame:
    """convert() with the cache in a folder, to which new conversions are appended."""
    spark = documents.sparkSession
    out, fresh = convert(documents, cached(spark, cache_path))
    fresh.write.mode("append").parquet(cache_path)
    known = cached(spark, cache_path)
    return out.select("path", "digest").join(known, "digest", "left").select("path", "digest", F.coalesce("markdown", stub(F.col("path"))).alias("markdown"))


def stub(path: Column) -> Column:
    return F.concat(F.lit("<!-- can't be converted: "), path, F.lit(" -->"))


def convert(documents: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (path, content binary) and cache (digest, markdown) give (path, digest, markdown) and new cache rows. Failures aren't cached."""
    hashed = documents.select("path", "content", F.sha2("content", 256).alias("digest"))
    misses = hashed.join(cache.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min_by(F.struct("path", "content"), "path").alias("d")).select("digest", "d.*")
    kind = suffix(F.col("path"))
    text = utf8(F.col("content"))
    fresh = misses.select("digest", F.when(kind.isin(*TEXTLIKE), text).when(kind.isin(".html", ".htm"), html_text(text)).alias("markdown")).filter("markdown IS NOT NULL")
    known = cache.select("digest", "markdown").unionByName(fresh)
    return hashed.select("path", "digest").join(known, "digest", "left").select("path", "digest", F.coalesce("markdown", stub(F.col("path"))).alias("markdown")), fresh
