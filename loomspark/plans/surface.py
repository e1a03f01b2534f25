"""Queries over the engine's sources, sinks, logs, prompts and commands, and their SQL; they are added to the registry's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import assemble, budget, docs, edits, graph, ingest, memory, parse, telemetry
from ..scratch import work_dir
from ..sources import files
from ..streaming import extensions
from . import registry
from .engine import Engine, parse_slash
from .registry import _BLOCKS as _BLOCKS_SQL
from .registry import _COST, _DELTA, _FIT, _REQUESTS, _blocks, _code, _listings, _requests, _sets, _table, query

QUERIES, ORACLES, FLAGSHIP = registry.QUERIES, registry.ORACLES, registry.FLAGSHIP

# Sources.
_PATHS = ["src/m{}.py", "node_modules/a{}.js", "lib/B{}.TS", "docs/c{}.md", "x/build/d{}.go", "e{}.PDF", "noext{}"]


def _cases(values: list[str], key: str = "doc_id") -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _path_sql(pattern: str, number: str) -> str:
    a, b = pattern.split("{}")
    return f"'{a}' || {number} || '{b}'"


@query(f"""SELECT {_cases([_path_sql(p, "doc_id") for p in _PATHS])} AS path, doc_id % 7 IN (0, 2) AS source, {_cases(["'python'", "'javascript'", "'typescript'", "NULL", "'go'", "NULL", "NULL"])} AS lang,
doc_id % 7 IN (3, 5) AS convertible FROM documents""")
def source_listing(spark, sf):
    """What a tree's listing keeps, with languages and documents."""
    path = F.expr(_cases([_path_sql(p, "string(doc_id)") for p in _PATHS]))
    return _table(spark, sf, "documents").select(path.alias("path")).select("path", files.is_source(F.col("path")).alias("source"), files.language(F.col("path")).alias("lang"), files.is_convertible(F.col("path")).alias("convertible"))


def _lines(frame, key: str, good, extra, less):
    """Log lines by the key's remainder: whole, with one key more, blank, broken, a list, with a key less."""
    k = F.col(key) % 6
    return frame.select(F.when(k == 0, F.to_json(good)).when(k == 1, F.to_json(extra)).when(k == 2, "").when(k == 3, "{bad").when(k == 4, "[1]").otherwise(F.to_json(less)).alias("value"))


@query("""SELECT CAST(event_id AS DOUBLE) AS ts, event_type AS model, event_id AS fresh_in, event_id * 2 AS cached_in, event_id % 5 AS "out", 0.5::DOUBLE AS cache_hit_rate, event_id * 0.25::DOUBLE AS cost_usd,
CASE WHEN event_id % 6 = 1 THEN 'map' ELSE '' END AS command FROM events WHERE event_id % 6 IN (0, 1)""")
def request_log_lines(spark, sf):
    """Log lines with exactly the keys of a request, with or without a command, are read; others are passed over."""
    i = F.col("event_id")
    cols = [i.cast("double").alias("ts"), F.col("event_type").alias("model"), i.alias("fresh_in"), (i * 2).alias("cached_in"), (i % 5).alias("out"), F.lit(0.5).alias("cache_hit_rate"), (i * 0.25).alias("cost_usd")]
    return files.requests(_lines(_table(spark, sf, "events"), "event_id", F.struct(*cols), F.struct(*cols, F.lit("map").alias("command")), F.struct(*cols[1:])))


@query("SELECT 'd' || doc_id AS decision, lang AS rationale, 'a,' || source AS files_touched, CAST(doc_id AS DOUBLE) AS timestamp FROM documents WHERE doc_id % 6 = 0")
def decision_log_lines(spark, sf):
    i = F.col("doc_id")
    cols = [F.concat(F.lit("d"), i.cast("string")).alias("decision"), F.col("lang").alias("rationale"), F.array(F.lit("a"), F.col("source")).alias("files_touched"), i.cast("double").alias("timestamp")]
    found = files.decisions(_lines(_table(spark, sf, "documents"), "doc_id", F.struct(*cols), F.struct(*cols, F.lit(1).alias("more")), F.struct(*cols[:-1])))
    return found.select("decision", "rationale", F.array_join("files_touched", ",").alias("files_touched"), "timestamp")


def _payloads(spark, sf):
    """A chat payload for each conversation; the content of odd turns is a list of blocks."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array(part("text", F.substring("text", 1, 5)), part("image", F.lit(None).cast("string")), part("text", F.expr("substring(text, 6)")))
    one = F.when(F.col("turn") % 2 == 1, F.to_json(F.struct("role", blocks.alias("content")))).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    each = _table(spark, sf, "conversations").select("conv_id", "turn", one.alias("m"))
    messages = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), ",")
    return each.groupBy("conv_id").agg(F.concat(F.lit('{"system":[{"text":"one"},{"text":"two"}],"messages":['), messages, F.lit("]}")).alias("payload"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations")
def payload_turns(spark, sf):
    return files.payload_turns(_payloads(spark, sf)).withColumn("turn", F.col("turn").cast("bigint"))


@query("SELECT DISTINCT conv_id, 'one' || chr(10) || 'two' AS system FROM conversations")
def payload_system(spark, sf):
    return files.payload_system(_payloads(spark, sf))


@query("SELECT * FROM (VALUES ('repo_map', 38400::BIGINT), ('decision_log', 19200), ('snippets', 67200), ('verbatim', 67200)) AS t(layer, tokens)")
def layer_budgets(spark, sf):
    shares = files.Budgets()
    return spark.createDataFrame([(k, shares.share(k)) for k in ("repo_map", "decision_log", "snippets", "verbatim")], "layer string, tokens bigint")


# Stores and logs.


@query(f"WITH {_DELTA} SELECT path, h AS hash FROM n")
def replaced_rows(spark, sf):
    """Rows of changed and removed paths go, those of parsed ones come: what stays are the new listing's."""
    new, old = _listings(spark, sf)
    changes = ingest.delta(new, old)
    return ingest.replace_rows(old, new.join(changes.filter("state = 'parsed'"), "path", "left_semi").select("path", "hash"), changes, "path")


@query(f"""WITH {_REQUESTS} SELECT CAST(event_id AS DOUBLE) AS ts, model, fresh_in, cached_in, "out", round(hit, 6) AS cache_hit_rate, round(cost, 9) AS cost_usd, '' AS command FROM c""")
def recorded_requests(spark, sf):
    """Requests are recorded, appended to a log of JSON lines and read again."""
    log = work_dir(spark, "requests")
    rows = _requests(spark, sf).withColumn("command", F.lit(""))
    for half in (0, 1):
        ingest.append_log(telemetry.record(rows.filter(F.col("event_id") % 2 == half), now=F.col("event_id")), log)
    return files.requests(ingest.read_log(spark, log)).withColumn("cache_hit_rate", F.round("cache_hit_rate", 6)).withColumn("cost_usd", F.round("cost_usd", 9))


_DISTILLED = """x2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 4 AS older FROM conversations),
o AS (SELECT conv_id, trim(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), ' ' || chr(10)) AS u, trim(coalesce(arg_min(text, turn) FILTER (role = 'assistant'), ''), ' ' || chr(10)) AS s FROM x2 WHERE older GROUP BY conv_id),
l AS (SELECT conv_id, '- ' || CASE WHEN u = '' THEN '(nothing asked)' ELSE substring(string_split(u, chr(10))[1], 1, 160) END || ' (' || CASE WHEN s = '' THEN '(nothing answered)' ELSE substring(string_split(s, chr(10))[1], 1, 160) END || ') [—]' AS line FROM o)"""


@query(f"WITH {_DISTILLED} SELECT CAST(conv_id AS DOUBLE) AS timestamp, line FROM l ORDER BY conv_id DESC LIMIT 10")
def decision_log_tail(spark, sf):
    """Decisions are appended to a log and its last ten rendered."""
    log = work_dir(spark, "decisions")
    made = memory.compress(_table(spark, sf, "conversations"), now=F.col("conv_id").cast("double"))[0]
    ingest.append_log(made.select("decision", "rationale", "files_touched", "timestamp"), log)
    return memory.log_tail(files.decisions(ingest.read_log(spark, log)), 10).select("timestamp", memory.render_line().alias("line"))


_MENTIONS = r"regexp_extract_all(text, '[\p{L}\p{N}_./\\-]+\.[\p{L}\p{N}_]{1,5}')"


@query(f"""WITH e AS (SELECT doc_id // 50 AS conv_id, doc_id * 1000 + i AS spot, m[i] AS f FROM (SELECT doc_id, {_MENTIONS} AS m FROM documents), unnest(range(1, len(m) + 1)) AS t(i)),
d AS (SELECT conv_id, f, min(spot) AS spot FROM e GROUP BY conv_id, f), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS n FROM d)
SELECT g.conv_id, coalesce(s, '') AS files_touched FROM (SELECT DISTINCT doc_id // 50 AS conv_id FROM documents) g LEFT JOIN (SELECT conv_id, string_agg(f, ',' ORDER BY spot) AS s FROM k WHERE n <= 10 GROUP BY conv_id) USING (conv_id)""")
def files_touched(spark, sf):
    """Documents as turns of conversations: the first ten files mentioned, in order."""
    turns = _table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).cast("bigint").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    return memory.distill(turns).select("conv_id", F.array_join("files_touched", ",").alias("files_touched"))


_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(c, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""


@query(f"""WITH p AS (SELECT page_id, html || page_id AS c, 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.TXT' ELSE '.pdf' END AS path FROM pages)
SELECT path, sha256(c) AS digest, sha256(CASE page_id % 3 WHEN 0 THEN {_TEXT} WHEN 1 THEN c ELSE '<!-- can''t be converted: ' || path || ' -->' END) AS markdown_sha256 FROM p""")
def convert_documents(spark, sf):
    """A quarter of the documents is converted and stored first; the stored conversions serve the second time."""
    cache = work_dir(spark, "documents")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".html").when(F.col("page_id") % 3 == 1, ".TXT").otherwise(".pdf"))
    rows = _table(spark, sf, "pages").select("page_id", name.alias("path"), F.concat("html", F.col("page_id").cast("string")).cast("binary").alias("content"))
    docs.convert_stored(rows.filter("page_id % 4 = 0"), cache)
    return docs.convert_stored(rows, cache).select("path", "digest", F.sha2("markdown", 256).alias("markdown_sha256"))


# Graph seeds and other languages.


@query("""SELECT p_name AS name, CAST(3 * max(CASE WHEN p_name IN (SELECT min(p_name) FROM part) THEN 1 ELSE 0 END) + sum(CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 2 ELSE 0 END + CASE WHEN p_brand = (SELECT max(p_brand) FROM part) THEN 1 ELSE 0 END) AS DOUBLE) AS weight
FROM part GROUP BY p_name HAVING weight > 0""")
def seed_weights(spark, sf):
    part = _table(spark, sf, "part")
    name, low, high = part.agg(F.min("p_name"), F.min("p_brand"), F.max("p_brand")).first()
    return graph.seed_weights(part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("file")), [low], [name], [high])


def _scripts(spark, sf):
    k = F.col("p_partkey").cast("string")
    rows = [F.lit("import x from 'y'"), F.concat(F.lit("export class A"), k, F.lit(" {")), F.lit("}"), F.concat(F.lit("export async function g"), k, F.lit("(a) {")), F.concat(F.lit("  const h"), k, F.lit(" = async (b) => 1")), F.lit("let v = 3")]
    return _table(spark, sf, "part").select(F.concat(k, F.lit(".ts")).alias("path"), F.concat_ws("\n", *rows).alias("text"))


@query("""SELECT p_partkey || '.ts' AS file, 'A' || p_partkey AS name, 'class' AS kind, 2 AS start_line, 2 AS end_line, 'export class A' || p_partkey || ' {' AS signature FROM part
UNION ALL SELECT p_partkey || '.ts', 'g' || p_partkey, 'function', 4, 4, 'export async function g' || p_partkey || '(a) {' FROM part
UNION ALL SELECT p_partkey || '.ts', 'h' || p_partkey, 'function', 5, 5, 'const h' || p_partkey || ' = async (b) => 1' FROM part""")
def parse_other_symbols(spark, sf):
    return parse.symbols(parse.lines(_scripts(spark, sf)))


@query("SELECT p_partkey || '.ts' AS file, '<module>' AS src, 'import x from ''y''' AS dst, 'imports' AS kind, 1 AS n FROM part")
def parse_other_edges(spark, sf):
    return parse.edges(parse.lines(_scripts(spark, sf))).drop("pos")


# Prompts.
_SNIPPETS = f"""{_FIT}, sn AS (SELECT f.set_id, f.item_idx, CASE f.level WHEN 0 THEN coalesce(text, '') WHEN 1 THEN substring(coalesce(text, ''), 1, 80) ELSE CAST(doc_id AS VARCHAR) END AS body
FROM f JOIN documents ON doc_id = f.set_id * 10 + f.item_idx WHERE NOT dropped)"""
#: The snippets' tables have names of their own: both use b.
_SIX = f"""{_SNIPPETS}, sx AS (SELECT set_id, string_agg(body, chr(10) || chr(10) ORDER BY item_idx) AS text FROM sn WHERE trim(body, ' ' || chr(10) || chr(9)) <> '' GROUP BY set_id), {_BLOCKS_SQL.replace("b AS (", "b3 AS (", 1)}, {_DISTILLED},
six AS (SELECT * FROM b3 UNION ALL SELECT conv_id, 2, 'map of ' || conv_id FROM x WHERE age = 1 UNION ALL SELECT conv_id, 3, line FROM l UNION ALL SELECT set_id, 4, text FROM sx WHERE set_id IN (SELECT conv_id FROM x)),
z AS (SELECT * FROM six WHERE trim(text, ' ' || chr(10)) <> '')"""


def _six(spark, sf):
    """All layers of each conversation: the decision log of its older turns, and the set of documents with its number as snippets."""
    turns = _table(spark, sf, "conversations")
    convs = turns.select("conv_id").distinct()
    three = _blocks(spark, sf)
    layer = lambda n: three.filter(F.col("layer") == n).select("conv_id", "text")
    log = memory.compress(turns, now=F.lit(0.0))[0].select("conv_id", memory.render_line().alias("text"))
    snippets = assemble.snippets_text(budget.greedy_fit(_sets(spark, sf), F.lit(300))).withColumnRenamed("set_id", "conv_id").join(convs, "conv_id", "left_semi")
    maps = convs.select("conv_id", F.concat(F.lit("map of "), F.col("conv_id").cast("string")).alias("text"))
    return assemble.assemble({"system": layer(1), "repo_map": maps, "decision_log": log, "snippets": snippets, "verbatim": layer(5), "user": layer(6)})


@query(f"WITH {_SIX} SELECT conv_id, layer, sha256(text) AS text_sha256, layer <= 3 AS cached, {_COST.format('text')} AS tokens FROM z")
def assemble_six_layers(spark, sf):
    return _six(spark, sf).select("conv_id", "layer", F.sha2("text", 256).alias("text_sha256"), "cached", "tokens")


@query(f"WITH {_SIX} SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY layer)) AS prompt_sha256 FROM z GROUP BY conv_id")
def prompt_text(spark, sf):
    return assemble.to_text(_six(spark, sf)).select("conv_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"""WITH {_SIX} SELECT conv_id, string_agg(layer || ':' || CASE WHEN layer = m THEN 'true' ELSE 'false' END, ',' ORDER BY layer) FILTER (layer <= 3) AS system_parts, sha256(string_agg(text, chr(10) || chr(10) ORDER BY layer) FILTER (layer <= 3)) AS system_sha256,
sha256(string_agg(text, chr(10) || chr(10) ORDER BY layer) FILTER (layer > 3)) AS user_sha256 FROM (SELECT *, max(layer) FILTER (layer <= 3) OVER (PARTITION BY conv_id) AS m FROM z) GROUP BY conv_id""")
def prompt_messages(spark, sf):
    blocks = _six(spark, sf)
    cached = blocks.filter("cached").groupBy("conv_id").agg(F.array_sort(F.collect_list("layer")).alias("layers"))
    parts = F.array_join(F.transform(F.arrays_zip("layers", "system"), lambda x: F.concat(x["layers"].cast("string"), F.lit(":"), x["system"]["cache_marker"].cast("string"))), ",")
    joined = F.array_join(F.transform("system", lambda x: x["text"]), "\n\n")
    return assemble.to_messages(blocks).join(cached, "conv_id").select("conv_id", parts.alias("system_parts"), F.sha2(joined, 256).alias("system_sha256"), F.sha2("user", 256).alias("user_sha256"))


@query(f"""WITH {_BLOCKS_SQL}, z AS (SELECT * FROM b WHERE trim(text, ' ' || chr(10)) <> ''), g AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY layer) FILTER (layer > 3) AS u FROM z GROUP BY conv_id)
SELECT conv_id, 'You answer briefly.' AS system, 'true' AS cache_marker, sha256(u) AS user_sha256, 'You answer briefly.' AS first_message, sha256(u) AS second_sha256 FROM g""")
def prompt_payloads(spark, sf):
    """The payload in both styles."""
    blocks = _blocks(spark, sf)
    get = F.get_json_object
    a = assemble.reshape(blocks, "system").select("conv_id", get("payload", "$.system[0].text").alias("system"), get("payload", "$.system[0].cache_marker").alias("cache_marker"), F.sha2(get("payload", "$.messages[0].content"), 256).alias("user_sha256"))
    b = assemble.reshape(blocks, "messages").select("conv_id", get("payload", "$.messages[0].content").alias("first_message"), F.sha2(get("payload", "$.messages[1].content"), 256).alias("second_sha256"))
    return a.join(b, "conv_id")


# Commands.
_SLASH = ["/a 'b c' d", '/a "b', "/", "x", "  /findcode foo bar", "/usr/bin"]


@query("SELECT * FROM (VALUES ('/a ''b c'' d', 'a', 'b c|d'), ('/a \"b', 'a', '\"b'), ('/', NULL, NULL), ('x', NULL, NULL), ('  /findcode foo bar', 'findcode', 'foo|bar'), ('/usr/bin', 'usr/bin', '')) AS t(text, name, args)")
def slash_commands(spark, sf):
    return spark.createDataFrame([(t, *((p[0], "|".join(p[1])) if (p := parse_slash(t)) else (None, None))) for t in _SLASH], "text string, name string, args string")


def _engine(spark, sf) -> Engine:
    engine = Engine(spark)
    sources = _code(spark, sf)
    engine.take_in(sources.select("path", "text", content_hash(F.col("text")).alias("hash"), files.language(F.col("path")).alias("lang")))
    return engine


_OLDER = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 4 AS older FROM conversations"


@query(f"""WITH p AS (SELECT count(*) AS n, min(p_partkey) AS k FROM part), o AS ({_OLDER}) SELECT command, fact, CAST(value AS BIGINT) AS value FROM (
SELECT 'index' AS command, 'parsed' AS fact, 0 AS value UNION ALL SELECT 'index', 'skipped', n FROM p UNION ALL SELECT 'index', 'removed', 0 UNION ALL SELECT 'index', 'symbols', 4 * n FROM p
UNION ALL SELECT 'findcode C', 'count', 1 UNION ALL SELECT 'findcode run', 'count', n FROM p UNION ALL SELECT 'findcode', 'miss', 1 UNION ALL SELECT 'openfile', 'file', 1 UNION ALL SELECT 'openfile ../x', 'miss', 1
UNION ALL SELECT 'showrepo', 'budget', 38400 UNION ALL SELECT 'shortreply', 'diff_mode', 1 UNION ALL SELECT 'changeai local', 'local', 1 UNION ALL SELECT 'changeai', 'valid', 3
UNION ALL SELECT 'clearchat', 'compressed', count(*) FILTER (older) FROM o UNION ALL SELECT 'clearchat', 'kept_verbatim', count(*) FILTER (NOT older) FROM o
UNION ALL SELECT 'showstats', 'requests', 2 UNION ALL SELECT 'showstats', 'fresh_in', 3000000 UNION ALL SELECT 'showstats', 'cost_cents', 3465 UNION ALL SELECT 'applychanges', 'ok', 1 UNION ALL SELECT 'applychanges', 'files', 1 UNION ALL SELECT 'applychanges nothing', 'ok', 0)""")
def command_facts(spark, sf):
    """What each command tells, over the sources written from the part table and the conversations."""
    e = _engine(spark, sf)
    k = _table(spark, sf, "part").agg(F.min("p_partkey")).first()[0]
    path = e.files.filter(F.col("path").endswith(f"/{k}.py")).select("path").first()[0]
    again = e.take_in(e.files)
    e.record("top", 2_000_000, 0, 0)
    e.record("none", 1_000_000, 500_000, 100_000, "showrepo")
    cost = e.dispatch("/showstats")[1]
    turns = e.dispatch("/clearchat", turns=_table(spark, sf, "conversations"))[1]
    done = e.dispatch("/applychanges", text=edits.make_block(path, "return len(a)", "return a"))[1]
    ai = e.dispatch("/changeai local")[1]
    rows = [
        *(("index", x, again[x]) for x in ("parsed", "skipped", "removed", "symbols")), ("findcode C", "count", e.dispatch(f"/findcode C{k}")[1]["count"]), ("findcode run", "count", e.dispatch("/findcode run")[1]["count"]),
        ("findcode", e.dispatch("/findcode nothing")[1]["kind"], 1), ("openfile", e.dispatch(f"/openfile {path}")[1]["kind"], 1), ("openfile ../x", e.dispatch("/openfile ../x")[1]["kind"], 1), ("showrepo", "budget", e.dispatch("/showrepo")[1]["budget"]),
        ("shortreply", "diff_mode", int(e.dispatch("/shortreply")[1]["diff_mode"])), ("changeai local", ai["tier"], 1), ("changeai", "valid", len(e.dispatch("/changeai odd")[1]["valid"])), *(("clearchat", x, n) for x, n in turns.items()),
        ("showstats", "requests", cost["requests"]), ("showstats", "fresh_in", cost["fresh_in"]), ("showstats", "cost_cents", round(100 * cost["cost_usd"])), ("applychanges", "ok", int(done["ok"])), ("applychanges", "files", len(done["files"])),
        ("applychanges nothing", "ok", int(e.dispatch("/applychanges", text="no block")[1]["ok"])),
    ]
    return spark.createDataFrame(rows, "command string, fact string, value bigint")


# Streams (extensions).


def _drained(stream, out: str, mode: str = "append", save: str = "append") -> None:
    """Runs a stream over what there is, into a folder."""
    write = lambda batch, _: batch.write.mode(save).parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()


@query(f"""WITH {_REQUESTS} SELECT CAST(event_id * 60 // 86400 AS BIGINT) AS day, model, count(*) AS requests, round(sum(cost), 4) AS cost_usd FROM c GROUP BY ALL""")
def streaming_costs(spark, sf):
    """Costs by day of a stream of request lines; each event stands for a minute."""
    folder, out = work_dir(spark, "stream"), work_dir(spark, "costs")
    rows = _requests(spark, sf).withColumn("ts", (F.col("event_id") * 60).cast("double")).select("ts", "model", "fresh_in", "cached_in", "out")
    rows.write.json(folder)
    _drained(extensions.windowed_costs(extensions.request_stream(spark, folder), "1 day"), out, "complete", "overwrite")
    day = F.floor(F.unix_seconds("window.start") / 86400).cast("bigint")
    return spark.read.parquet(out).select(day.alias("day"), "model", "requests", F.round("cost_usd", 4).alias("cost_usd"))


@query("SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def streaming_log_once(spark, sf):
    """Decisions that a stream brings twice are logged once."""
    folder, out = work_dir(spark, "stream"), work_dir(spark, "log")
    made = _table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).withColumn("at", F.timestamp_seconds(F.col("conv_id") + 86_400))
    for _ in range(2):
        made.write.mode("append").parquet(folder)
    _drained(extensions.log_once(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(folder), "1000 days"), out)
    return spark.read.parquet(out).select("conv_id", "last_turn")


@query(f"WITH {_DELTA} SELECT path, coalesce(n.h, o.h) AS hash FROM o FULL JOIN n USING (path)")
def streaming_reindex(spark, sf):
    """A listing and a later one come as a stream; rows of paths that come again are replaced."""
    folder, out = work_dir(spark, "stream"), work_dir(spark, "index")
    new, old = _listings(spark, sf)
    seen: list[str] = []

    def upsert(batch, number):
        state = spark.read.parquet(seen[-1]) if seen else batch.limit(0)
        merged = state.join(batch.select("path").hint("merge"), "path", "left_anti").unionByName(batch)
        seen.append(ingest.write_version(merged, out, number))

    for part in (old, new):  # one batch each, of any number of files
        part.write.mode("append").parquet(folder)
        extensions.reindex(spark.readStream.schema(old.schema).parquet(folder), upsert, f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(old.schema).parquet(seen[-1])
