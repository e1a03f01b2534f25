r"""Benchmark decontamination with a distributed positional inverted index.

build_index() stores the postings of the test terms in the corpus once: rows (tid, r, pos), where tid numbers the terms and r
the documents, in files of one shard of documents each, sorted by term, so that making them moves nothing and a term's list
is one run of a file. A document's header is the posting of a term that no text has; it holds the document's identifier and
number of words.

A window of test terms is looked up from its rarest term (by the lists' lengths): every posting of that term gives a place
where the window would start. The list of the second rarest term, adjusted by its offset, is intersected with these places,
and then the lists of the rest. Places that all lists hold are exact phrase matches; proximity_matches() asks instead that a
span of few more words than the window holds all its terms. Only places leave a scan of the index, never texts.

Test terms and places that are asked for are broadcast up to `most_broadcast` rows. More of them are joined by shuffle: terms
with a salt, since one term's list may be long, and places by (term, document, position), of which each stands once, with the
lists of the terms asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import ascii_lower, cut, load

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: The header's term and its number: separators are in no word.
HEADER, HEADER_ID = " ", -1
MOST_BROADCAST = 600_000
SALTS = 32


def tokens(text: Column) -> Column:
    """Words by splitting; a text that begins or ends with separators has an empty token there, which matches nothing."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, terms: all runs of `size` words; the whole item if it has fewer, but not none."""
    w = items.select(F.col("item_id").alias("item_id"), F.filter(tokens(F.col("text")), lambda x: x != "").alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1))))
    return w.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("terms")).distinct()


def numbered_terms(windows: DataFrame) -> DataFrame:
    """term, tid of the terms of windows and the header's; written out."""
    terms = windows.select(F.explode("terms").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid"))
    return cut(terms.unionByName(windows.sparkSession.createDataFrame([(HEADER, HEADER_ID)], "term string, tid bigint")), "terms")


def _with_terms(postings: DataFrame, terms: DataFrame, key: str, most: int) -> DataFrame:
    """Postings (r, pos, key, ...) joined with rows of terms (key, ...; written out)."""
    if terms.count() <= most:
        return postings.join(F.broadcast(terms), key)
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64("r", "pos"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def build_index(docs: DataFrame, terms: DataFrame, keep: tuple[str, ...] = (), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The stored postings of docs (doc_id, text) for terms (term, tid): tid, r, pos (from 1), and in headers (pos 0) row (doc_id and the columns named in keep) and n_words."""
    row = F.struct("doc_id", *keep)
    words = docs.select(F.monotonically_increasing_id().alias("r"), row.alias("row"), tokens(F.col("text")).alias("w"))
    empty = lambda at: F.when(F.element_at("w", at) == "", 1).otherwise(0)
    n = F.size("w") - empty(1) - F.when(F.size("w") > 1, empty(-1)).otherwise(0)
    each = words.select("r", "row", n.cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(HEADER)), "w")).alias("pos", "term"))
    head = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    return cut(_with_terms(each, terms, "term", most_broadcast).select("tid", "r", "pos", head("row"), head("n_words")).sortWithinPartitions("tid"), "postings")


def _plan(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """Each term of each window (w, item_id, len) whose terms all have postings: tid, off (from 0), rank (0: the rarest; the first of equals by number and place); written out."""
    each = windows.select("w", "item_id", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term")).join(terms, "term")
    counts = cut(index.groupBy("tid").agg(F.count("*").alias("n")), "counts")  # so that the join can split a term of many windows
    lists = each.join(counts, "tid").groupBy("w", "item_id", "len").agg(F.sort_array(F.collect_list(F.struct("n", "tid", "off"))).alias("by"))
    return cut(lists.filter(F.size("by") == F.col("len")).select("w", "item_id", "len", F.posexplode("by").alias("rank", "x")).select("w", "item_id", "len", "rank", "x.tid", "x.off"), "search")


def _postings(index: DataFrame) -> DataFrame:
    return index.select("tid", "r", "pos").filter("pos > 0")


def _held(index: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """Of places (tid, r, pos, ...; written out), those that have a posting."""
    asked = cut(places.select("tid", "r", "pos").distinct(), "asked")
    if asked.count() <= most:
        there = _postings(index).join(F.broadcast(asked), ["tid", "r", "pos"])
    else:
        lists = cut(asked.select("tid").distinct(), "lists")
        there = _postings(index).join(F.broadcast(lists) if lists.count() <= most else lists, "tid", "left_semi").join(asked, ["tid", "r", "pos"])
    return places.join(cut(there, "there"), ["tid", "r", "pos"])


def phrase_matches(index: DataFrame, windows: DataFrame, terms: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Every exact occurrence of windows (w, item_id, terms): r, item_id, start and end positions of words (end is exclusive)."""
    plan = _plan(index, windows, terms)
    start = F.col("pos") - F.col("off")
    first = _with_terms(_postings(index), cut(plan.filter("rank = 0").drop("rank"), "rarest"), "tid", most_broadcast)
    first = cut(first.select("w", "item_id", "len", "r", start.alias("start")).filter("start > 0"), "places")

    def kept(found: DataFrame, ranks: str) -> DataFrame:
        lists = plan.filter(ranks).select("w", "tid", "off")
        return _held(index, cut(found.join(lists, "w").select("w", "item_id", "len", "r", "start", "tid", (F.col("start") + F.col("off")).alias("pos")), "places"), most_broadcast)

    second = cut(kept(first, "rank = 1").select("w", "item_id", "len", "r", "start"), "places")
    whole = kept(second, "rank > 1").groupBy("w", "item_id", "len", "r", "start").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("len") - 2)
    out = first.filter("len = 1").unionByName(second.filter("len = 2")).unionByName(whole.drop("n"))
    return out.select("r", "item_id", "start", (F.col("start") + F.col("len")).alias("end"))


def proximity_matches(index: DataFrame, windows: DataFrame, terms: DataFrame, slop: int = 4, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Windows all of whose distinct terms stand, in any order, within a span of the window's length plus `slop` words: r, item_id, pos (of the rarest term)."""
    plan = _plan(index, windows, terms)
    reach = F.col("len") + F.lit(slop)
    each = plan.groupBy("w", "item_id", "len", "tid").agg(F.min("rank").alias("rank"))
    kinds = each.groupBy("w").agg(F.count("*").alias("kinds"))
    rarest = cut(each.filter("rank = 0").join(kinds, "w").drop("rank"), "rarest")
    places = cut(_with_terms(_postings(index), rarest, "tid", most_broadcast).select("w", "item_id", reach.alias("reach"), "kinds", "r", F.col("pos").alias("at")), "places")
    asked = places.join(each.select("w", "tid"), "w")
    near = _postings(index).join(asked, ["tid", "r"]).filter(F.abs(F.col("pos") - F.col("at")) < F.col("reach"))
    found = near.groupBy("w", "item_id", "reach", "kinds", "r", "at").agg(F.collect_set(F.struct("pos", "tid")).alias("all"))
    inside = lambda p: F.filter("all", lambda x: (x["pos"] >= p["pos"]) & (x["pos"] < p["pos"] + F.col("reach")))
    spans = lambda p: (p["pos"] <= F.col("at")) & (F.col("at") < p["pos"] + F.col("reach")) & (F.size(F.array_distinct(F.transform(inside(p), lambda x: x["tid"]))) == F.col("kinds"))
    return found.filter(F.exists("all", spans)).select("r", "item_id", F.col("at").alias("pos")).distinct()


def searched(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = (), size: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of docs for the terms of items' windows, the numbered windows and the numbered terms."""
    windows = cut(windows_of(items, size).withColumn("w", F.monotonically_increasing_id()), "windows")
    terms = numbered_terms(windows)
    return build_index(docs, terms, keep, most_broadcast), windows, terms


def headers(index: DataFrame) -> DataFrame:
    """r, row and n_words of each document of an index."""
    return index.filter(F.col("tid") == HEADER_ID).select("r", "row", "n_words")


def decontaminate(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = (), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the columns of docs named in keep; one row per input row.

    Null or empty texts have no words and no hits; their items_sha256 is that of the empty string. Items without words
    match nothing; equal windows of one item count once. Rows that repeat an identifier each get the result of their own
    text, whatever its length, and null identifiers stay null. Other columns of docs aren't read. An empty table gives no rows.
    """
    index, windows, terms = searched(docs.select("doc_id", "text", *keep), items, keep, most_broadcast=most_broadcast)
    hits = phrase_matches(index, windows, terms, most_broadcast).groupBy("r").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    )
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    hits = hits.select("r", F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"]).alias("n"), "ids")
    out = headers(index).join(hits, "r", "left")
    hit, ids = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "row.doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), *[F.col(f"row.`{c}`").alias(c) for c in keep]
    )


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS k
       FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS t(p) WHERE len(w) > 0),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, p, ln.n, array_to_string(w[p:p + ln.n - 1], ' ') AS k FROM d, ln, unnest(range(1, len(w) - ln.n + 2)) AS t(p) WHERE len(w) >= ln.n),
m AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
