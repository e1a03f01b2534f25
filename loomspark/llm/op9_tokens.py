"""Token counts with a digest cache.

A cache table holds (digest of the content, digest of the tokenizer version, count). Contents are their own normal form
(null is empty): any other would change counts. Digests whose pair isn't stored are reduced, on narrow rows, to one document
each; the texts of these documents alone are encoded, and their counts are appended to the cache.

Up to `most_broadcast` such documents are named to the tasks by a broadcast, and texts are encoded where they are read; more
are named by a join, which moves texts, each once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import chunks, cut, load, work_dir

TOKENIZER = "byte_bpe_50k.json"
CACHE = "digest string, version string, n_tokens bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


#: Letters, numbers and white space of the texts that are split here: characters whose classes no Unicode version changed.
#: Any other character, or a special token's text, sends the whole text to the library.
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f]*")
_PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
#: Parts remembered by each Python worker.
MEMO = 300_000


def _counts(texts: list[str], tok, specials: list[str], memo: dict[str, int] | None) -> list[int]:
    """Token counts. With a memo, plain texts are split at the tokenizer's own part boundaries and each distinct part is encoded once."""
    library = lambda xs: [len(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
    out: list[int] = [0] * len(texts)
    parts: dict[int, list[str]] = {}
    rest: list[int] = []
    for i, t in enumerate(texts):
        if memo is not None and _PLAIN.fullmatch(t) and not any(s in t for s in specials):
            parts[i] = _PARTS.findall(t)
        else:
            rest.append(i)
    for i, n in zip(rest, library([texts[i] for i in rest]), strict=True):
        out[i] = n
    if parts:
        if len(memo) > MEMO:
            memo.clear()
        new = list({p for x in parts.values() for p in x if p not in memo})
        memo.update(zip(new, library(new), strict=True))
        get = memo.__getitem__
        for i, x in parts.items():
            out[i] = sum(map(get, x))
    return out


def _splits_alike(path: str) -> tuple[bool, list[str]]:
    """Whether the tokenizer is byte-level BPE with the known part pattern and nothing else; the special tokens' texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, post = spec.get("pre_tokenizer") or {}, spec.get("post_processor")
    alike = spec["model"]["type"] == "BPE" and spec["model"].get("dropout") is None and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and post is None
    return bool(alike), [t["content"] for t in spec.get("added_tokens") or []]


def _encode(path: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        alike, specials = _splits_alike(path)
        memo: dict[str, int] | None = {} if alike else None
        seen: set[str] = set()
        for b in chunks(batches, 1 << 19):
            if len(seen) > MEMO:
                seen.clear()
            new = []
            for i, d in enumerate(b.column("digest").to_pylist()):
                if d not in seen:  # rows that repeat both identifier and text stand for one digest
                    seen.add(d)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(_counts(b.column("text").to_pylist(), tok, specials, memo), pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str | None = None, limit: int = 512, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per input row. The cache at cache_path is read if it exists and gets the misses' counts.

    Null text counts as empty, which has no tokens. Whole texts are encoded, however long. Rows that repeat an identifier or
    text each get their count; of rows with one digest the one with the smallest identifier is encoded, null if all are; of
    counts that a cache holds twice the largest is used, and they are equal. Null identifiers stay null; other columns aren't
    read. An empty table gives no rows and appends none.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    version = version_of(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))
    rows = cut(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    stored = _stored(spark, cache_path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti").select(F.col("doc_id").alias("_id"), F.unhex("digest").alias("_digest")), "misses")
    few = misses.count() <= most_broadcast
    # The join is on identifier and digest, so that copies are dropped without gathering them.
    named = keyed.join(F.broadcast(misses) if few else misses, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.unhex("digest") == F.col("_digest")), "left_semi")
    fresh = named.select("digest", "text").mapInArrow(_encode(path), "digest string, n_tokens bigint")
    fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    # Written out, so that the join below can split a digest that many rows have.
    counts = cut(_stored(spark, cache_path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every run encodes all distinct contents."""
    return count_tokens(load(spark, sf_dir, "documents"), work_dir(spark, "token-cache"))
