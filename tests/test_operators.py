"""Operators on authored rows, against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.operators import assemble, budget, docs, edits, graph, ingest, memory, parse, route, telemetry
from loomspark.plans.engine import Engine, parse_slash
from loomspark.sources import files

PY = '''import os
limit = 3
default = 1


class Outer:
    class Inner:
        def run(self):
            return helper(1)

    def go(self,
        x):
        return self.run()  # later(2)

    top = helper(3)

async def late():
    helper(4)

def helper(n):
    return [i for i in range(n)]

else:
'''


def cost(s):
    return max(1, math.ceil(len(s) / 4))


def test_text_functions_equal_python(spark):
    samples = ["", " ", "a\nb", "a\r\nb\n", "\x1c x\x85y ", "é z", "  tab\t", "a\n\nb\x0bc", "emoji 😀" * 3, "a/b.py, ünï.tx x.c1"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: r for r in rows.select("i", text.strip(F.col("s")).alias("strip"), text.split_lines(F.col("s")).alias("lines"), text.token_count(F.col("s")).alias("n"), text.indent(F.col("s")).alias("d"), text.file_mentions(F.col("s")).alias("f")).collect()}
    for i, s in enumerate(samples):
        assert got[i]["strip"] == s.strip()
        assert got[i]["lines"] == s.splitlines()
        assert got[i]["n"] == cost(s)
        assert got[i]["d"] == len(s) - len(s.lstrip())
        assert got[i]["f"] == re.findall(r"[\w./\\-]+\.\w{1,5}", s)


def python_fit(items, limit):
    """The greedy loop."""
    level, alive = [0] * len(items), list(range(len(items)))
    now = lambda i: items[i][0][level[i]]
    while sum(now(i) for i in alive) > limit:
        can = [i for i in alive if level[i] < len(items[i][0]) - 1]
        if can:
            level[min(can, key=lambda i: items[i][1] / max(1, now(i)))] += 1
            continue
        drop = [i for i in alive if items[i][2] <= 0]
        if not drop:
            break
        alive.remove(min(drop, key=lambda i: (items[i][2], items[i][1])))
    return [(level[i], i not in alive) for i in range(len(items))]


def test_greedy_fit_equals_the_loop(spark):
    rnd = random.Random(5)
    sets = [[([rnd.randint(0, 30) for _ in range(rnd.randint(1, 4))], rnd.choice([0.0, 0.5, 1.0, 2.0, 7.5]), rnd.randint(-1, 2)) for _ in range(rnd.randint(1, 6))] for _ in range(120)]
    rows = [(s, i, *item) for s, items in enumerate(sets) for i, item in enumerate(items)]
    df = spark.createDataFrame(rows, "set_id int, item_idx int, costs array<bigint>, relevance double, priority int")
    got = {(r["set_id"], r["item_idx"]): (r["level"], r["dropped"]) for r in budget.greedy_fit(df, F.lit(25)).collect()}
    for s, items in enumerate(sets):
        assert [got[s, i] for i in range(len(items))] == python_fit(items, 25), items


def test_clip_and_last_k(spark):
    df = spark.createDataFrame([(1, "aaaa\nbbbb\ncccc"), (2, ""), (3, "x")], "id int, t string")
    assert {r["id"]: r["clipped"] for r in budget.clip_head(df, "t", 2).collect()} == {1: "aaaa\nbbbb\n… (clipped)", 2: "", 3: "x"}
    turns = spark.createDataFrame([(1, i) for i in range(5)], "conv_id int, turn int")
    assert sorted(r["turn"] for r in budget.last_k(turns, 2).filter("older").collect()) == [0, 1, 2]
    assert budget.last_k(turns, 0).filter("older").count() == 0


def test_newest_turn_stays(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a" * 40), (1, 1, "user", "b" * 400)], "conv_id int, turn int, role string, text string")
    assert [r["turn"] for r in budget.newest_fit(turns, 10).collect()] == [1]


def test_parse(spark):
    df = spark.createDataFrame([("m.py", PY), ("a.ts", "import x from 'y'\nexport class A {}\nexport async function f(a) {}\nconst g = async (b) => 1\n")], "path string, text string")
    numbered = parse.lines(df)
    got = {(r["file"], r["name"], r["kind"], r["start_line"], r["end_line"]) for r in parse.symbols(numbered).collect()}
    assert got == {
        ("m.py", "limit", "variable", 2, 2), ("m.py", "Outer", "class", 6, 16), ("m.py", "Inner", "class", 7, 10), ("m.py", "run", "method", 8, 10), ("m.py", "go", "method", 11, 14),
        ("m.py", "helper", "function", 20, 22), ("m.py", "else", "variable", 23, 23), ("a.ts", "A", "class", 2, 2), ("a.ts", "f", "function", 3, 3), ("a.ts", "g", "function", 4, 4),
    }
    edges = {(r["src"], r["dst"], r["kind"], r["n"]) for r in parse.edges(numbered).collect()}
    assert ("<module>", "import os", "imports", 1) in edges and ("<module>", "import x from 'y'", "imports", 1) in edges
    assert ("Inner", "helper", "calls", 9) in edges and ("<module>", "run", "calls", 13) in edges and ("<module>", "later", "calls", 13) in edges
    assert ("<module>", "late", "calls", 17) in edges and not any(d == "range" for _, d, _, _ in edges)


def test_pagerank_forms_agree(spark):
    rnd = random.Random(2)
    n = 12
    links = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(25)})
    seeds = {1: 3.0, 4: 1.0}
    t = [seeds.get(i, 0) / 4 for i in range(n)]
    rank = [1 / n] * n
    out = {i: [b for a, b in links if a == i] for i in range(n)}
    for _ in range(4):
        lost = sum(rank[i] for i in range(n) if not out[i])
        rank = [0.15 * t[i] + 0.85 * (lost * t[i] + sum(rank[j] / len(out[j]) for j in range(n) if i in out[j])) for i in range(n)]
    nodes, adj = spark.createDataFrame([(i,) for i in range(n)], "node int"), spark.createDataFrame(links, "src int, dst int")
    weights = spark.createDataFrame(list(seeds.items()), "node int, weight double")
    for most in (10**6, 0):
        got = {r["node"]: r["score"] for r in graph.pagerank(nodes, adj, weights, rounds=4, one_task_edges=most).collect()}
        assert all(abs(got[i] - rank[i]) < 1e-12 for i in range(n))


def test_representative(spark):
    df = spark.createDataFrame([("a", "variable", "f", 1), ("a", "function", "f", 5)], "name string, kind string, file string, start_line int")
    assert graph.representatives(df).first()["kind"] == "function"
    assert graph.representatives(df, "variable").first()["kind"] == "variable"


def test_edits(spark):
    two = edits.make_block("a.txt", "x  = 1", "x = 2") + "\n" + edits.make_block("a.txt", "x = 2", "x = 3") + "\n" + edits.make_block("n/new.txt", "", "hi")
    texts = spark.createDataFrame([(1, two), (2, "none"), (3, edits.make_block("../up", "a", "b"))], "doc_id bigint, text string")
    hunks = edits.parse_blocks(texts)
    have = spark.createDataFrame([("a.txt", "x = 1\ny = 2\n")], "path string, text string")
    results = edits.apply_hunks(hunks, have)
    got = {(r["doc_id"], r["hunk_idx"]): r for r in results.collect()}
    assert got[1, 0]["ok"] and got[1, 0]["new_text"] == "x = 2\ny = 2\n"
    assert got[1, 1]["new_text"] == "x = 3\ny = 2\n" and got[1, 2]["detail"] == "file is new"
    assert not got[3, 0]["ok"]
    done = {r["doc_id"]: (r["ok"], r["good"], r["total"]) for r in edits.outcomes(texts, results).collect()}
    assert done == {1: (True, 3, 3), 2: (False, 0, 0), 3: (False, 0, 1)}
    assert edits.locate("a\nb\n", "zzzz") is None and edits.locate("abc", "") == (0, 0, 1.0)


def test_json_logs(spark):
    lines = ['{"decision":"d","rationale":"r","files_touched":["a"],"timestamp":1.5}', "", "[1]", "{bad", '{"decision":"d"}', '{"decision":"d","rationale":"r","files_touched":[],"timestamp":1,"more":2}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert files.decisions(df).count() == 1
    row = '{"ts":1,"model":"top","fresh_in":1,"cached_in":2,"out":3,"cache_hit_rate":0.5,"cost_usd":0.1%s}'
    assert files.requests(spark.createDataFrame([(row % "",), (row % ',"command":"c"',), (row % ',"x":1',)], "value string")).count() == 2


def test_payload(spark):
    df = spark.createDataFrame([(1, '{"system":[{"text":"s1"},{"text":"s2"}],"messages":[{"role":"user","content":"hi"},{"content":[{"type":"text","text":"a"},{"text":"b"}]}]}')], "conv_id int, payload string")
    assert [(r["turn"], r["role"], r["content"]) for r in files.payload_turns(df).orderBy("turn").collect()] == [(0, "user", "hi"), (1, "user", "ab")]
    assert files.payload_system(df).first()["system"] == "s1\ns2"


def test_distill_and_render(spark):
    turns = spark.createDataFrame([(1, 0, "user", "  fix a.py\nmore"), (1, 1, "assistant", "see b.py and a.py"), (1, 2, "user", "x")], "conv_id int, turn int, role string, text string")
    log, counts = memory.compress(turns, 1)
    r = log.first()
    assert (r["decision"], r["rationale"], r["files_touched"]) == ("fix a.py", "see b.py and a.py", ["a.py", "b.py"])
    assert tuple(counts.first())[1:] == (2, 1)
    assert log.select(memory.render_line()).first()[0] == "- fix a.py (see b.py and a.py) [a.py, b.py]"


def test_docs_cache(spark):
    d = spark.createDataFrame([("a.md", b"# A"), ("b.md", b"# A"), ("c.html", b"<p>x &amp; y<script>z</script></p>"), ("d.pdf", b"%")], "path string, content binary")
    out, fresh = docs.convert(d, spark.createDataFrame([], "digest string, markdown string"))
    assert {r["path"]: r["markdown"] for r in out.collect()} == {"a.md": "# A", "b.md": "# A", "c.html": "x & y", "d.pdf": "<!-- can't be converted: d.pdf -->"}
    assert fresh.count() == 2


def test_assemble(spark):
    t = lambda *r: spark.createDataFrame(list(r), "conv_id int, text string")
    blocks = assemble.assemble({"system": t((1, "sys")), "decision_log": t((1, "  ")), "repo_map": t((1, "map")), "user": t((1, "ask"))})
    assert tuple(assemble.totals(blocks).first()) == (1, 2, 1, 3, 2)
    m = assemble.to_messages(blocks).first()
    assert [(x["text"], x["cache_marker"]) for x in m["system"]] == [("sys", False), ("map", True)] and m["user"] == "ask"
    assert assemble.to_text(blocks).first()["prompt"] == "sys\n\nmap\n\nask"


def test_telemetry_default_price_and_empty(spark):
    df = spark.createDataFrame([("none", 1_000_000, 0, 0)], "model string, fresh_in bigint, cached_in bigint, out bigint")
    assert telemetry.request_costs(df).first()["cost_usd"] == pytest.approx(3.0)
    assert telemetry.summary(telemetry.request_costs(df.limit(0))).first()["requests"] == 0


def test_route(spark):
    df = spark.createDataFrame([("codegen",), ("distill",), ("odd",)], "task string")
    assert [r[0] for r in df.select(route.tier(F.col("task"))).collect()] == ["frontier", "local", "frontier"]


def test_streaming_costs(spark, tmp_path):
    from loomspark.streaming.extensions import request_stream, windowed_costs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts":10,"model":"top","fresh_in":1000000,"cached_in":0,"out":0}\n{"ts":20,"model":"top","fresh_in":0,"cached_in":0,"out":0}\n')
    q = windowed_costs(request_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("costs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["requests"], r["cost_usd"]) for r in spark.table("costs").collect()] == [(2, 15.0)]


def test_engine(spark, tmp_path):
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "skip.py").write_text("def no():\n    pass\n")
    (tmp_path / "m.py").write_text(PY)
    e = Engine(spark, str(tmp_path))
    text_, facts = e.begin()
    assert facts["parsed"] == 1 and "class Outer:" in text_ and "no()" not in text_
    assert e.index()["skipped"] == 1
    (tmp_path / "m.py").write_text("def other():\n    return 1\n")
    assert e.index()["parsed"] == 1 and e.symbols.count() == 1
    assert "return 1" in e.dispatch("/findcode other")[0] and e.dispatch("/findcode helper")[1]["kind"] == "miss"
    assert e.dispatch("/openfile m.py")[1]["kind"] == "file" and e.dispatch("/openfile ../x")[1]["kind"] == "miss"
    text_, facts = e.dispatch("/applychanges", text=edits.make_block("m.py", "return 1", "return 2"))
    assert facts["ok"] and facts["files"]["m.py"].endswith("return 2\n")
    assert e.dispatch("/showstats")[1]["requests"] == 0 and "/findcode" in e.dispatch("/nope")[0]
    assert e.dispatch("/changeai local")[1]["tier"] == "local" and e.dispatch("/shortreply")[1]["diff_mode"]
    (tmp_path / "m.py").unlink()
    assert e.index()["removed"] == 1 and e.symbols.count() == 0


def test_slash():
    assert parse_slash("  /a 'b c' d") == ("a", ["b c", "d"])
    assert parse_slash('/a "b') == ("a", ['"b'])
    assert parse_slash("/") is None and parse_slash("x") is None


def test_ingest_versions(spark, tmp_path):
    df = spark.range(3)
    path = ingest.write_version(df, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 3


def test_config(tmp_path):
    assert files.load_config(str(tmp_path / "none")).budgets.share("repo_map") == 38_400
    p = tmp_path / "c.toml"
    p.write_text(files.config_toml(files.Config(files.Budgets(window=1000), enabled_commands=("begin",))))
    assert files.load_config(str(p)).budgets.window == 1000
    p.write_text("[budgets]\nnone = 1\n")
    with pytest.raises(TypeError):
        files.load_config(str(p))


def test_pagerank_passes_over_unlisted_nodes(spark):
    """Edges to or from a node that isn't listed count in neither form; no mass is lost."""
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    links = [(0, 1), (1, 2), (2, 0)]
    odd = spark.createDataFrame([*links, (0, 9), (9, 1), (None, 2), (3, None)], "src int, dst int")
    plain = spark.createDataFrame(links, "src int, dst int")
    for most in (10**6, 0):
        a, b = ({r["node"]: r["score"] for r in graph.pagerank(nodes, x, rounds=3, one_task_edges=most).collect()} for x in (odd, plain))
        assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(1)
    assert graph.pagerank(nodes.limit(0), odd).count() == 0


def test_payload_types(spark):
    """Content is told by its JSON type."""
    contents = ["[]", '"[{\\"a\\":1}] is json"', '["plain", {"text": "x"}, {"type": "image"}, {"text": "y"}]', "null", "7", '"t"', "{}"]
    payload = '{"messages":[' + ",".join(f'{{"role":"user","content":{c}}}' for c in contents) + ',{"role":"assistant"}]}'
    df = spark.createDataFrame([(1, payload), (2, "{bad"), (3, "{}"), (4, '{"system":"s [{","messages":[]}')], "conv_id int, payload string")
    got = [(r["turn"], r["role"], r["content"]) for r in files.payload_turns(df).orderBy("conv_id", "turn").collect()]
    assert got == [*((i, "user", t) for i, t in enumerate(["", '[{"a":1}] is json', "xy", "", "", "t", ""])), (7, "assistant", "")]
    assert {r["conv_id"]: r["system"] for r in files.payload_system(df).collect()} == {1: "", 2: "", 3: "", 4: "s [{"}


def test_source_tree_with_pattern_characters(spark, tmp_path):
    """Roots and names may hold characters of patterns; folders above the root don't count; ignored files aren't read."""
    root = tmp_path / "build" / "a+b{c}[d]"
    for name in ("m.py", "x[1].py", "s p/é.TS", "node_modules/n.js", "docs/r.md", "none.bin"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"one\r\ntwo\xff\r")
    (root / "node_modules/n.js").chmod(0)
    assert {r["path"]: (r["text"], r["lang"]) for r in files.source_files(spark, str(root)).collect()} == {n: ("one\ntwo�\n", k) for n, k in (("m.py", "python"), ("x[1].py", "python"), ("s p/é.TS", "typescript"))}
    assert [(r["path"], bytes(r["content"])) for r in files.document_files(spark, str(root)).collect()] == [("docs/r.md", b"one\r\ntwo\xff\r")]
    (root / "empty").mkdir()
    assert files.source_files(spark, str(root / "empty")).count() == 0


def test_log_keeps_its_order(spark, tmp_path):
    """Entries of one time stay in the order they were written in."""
    line = '{"decision":"d%d","rationale":"r","files_touched":[],"timestamp":%d}'
    (tmp_path / "log.jsonl").write_text("\n".join(line % (i, i // 3) for i in range(9)))
    log = files.decisions(spark.read.text(str(tmp_path / "log.jsonl")))
    assert [r["decision"] for r in memory.log_tail(log, 5).collect()] == ["d4", "d5", "d6", "d7", "d8"]
    assert memory.log_tail(log, 0).count() == 9


def test_block_ends_equal_a_loop(spark):
    rnd = random.Random(8)
    sources = {f"f{k}.py": "\n".join(rnd.choice(["", "  ", " " * rnd.randint(0, 6) + rnd.choice(["def a():", "class B:", "x = 1", "y"])]) for _ in range(rnd.randint(1, 40))) for k in range(40)}
    got = {(r["file"], r["n"]): r["end_line"] for r in parse.block_ends(parse.lines(spark.createDataFrame(list(sources.items()), "path string, text string"))).collect()}
    for name, source in sources.items():
        rows = source.splitlines()
        for i, line in enumerate(rows):
            if re.match(r"\s*(def|class)\b", line):
                depth = len(line) - len(line.lstrip())
                end = next((j for j in range(i + 1, len(rows)) if rows[j].strip() and len(rows[j]) - len(rows[j].lstrip()) <= depth), len(rows))
                assert got.pop((name, i + 1)) == end
    assert not got


def test_locate_equals_trying_every_stretch():
    import difflib

    rnd = random.Random(3)
    for _ in range(300):
        rows = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 7))]
        text = "".join(r + rnd.choice(["\n", "\r\n"]) for r in rows)
        anchor = "\n".join("".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 3)))
        if anchor in text:
            continue
        lines, want = text.splitlines(keepends=True), [x.strip() for x in anchor.splitlines()]
        tried = []
        for k in range(max(1, len(lines) - len(want) + 1)):
            here = lines[k : k + len(want)]
            tried.append((difflib.SequenceMatcher(None, "\n".join(x.strip() for x in here), "\n".join(want)).ratio(), -k, sum(map(len, lines[:k])), sum(map(len, lines[: k + len(want)]))))
        best = max(tried)
        assert edits.locate(text, anchor) == ((*best[2:], best[0]) if best[0] >= 0.7 else None)


def test_sinks(spark, tmp_path):
    finals = spark.createDataFrame([("n/a.txt", "one"), ("../up.txt", "no")], "path string, new_text string")
    assert edits.write_files(finals, str(tmp_path / "r")) == ["n/a.txt"] and (tmp_path / "r/n/a.txt").read_text() == "one" and not (tmp_path / "up.txt").exists()
    made = spark.createDataFrame([("a.md", b"# A"), ("x.pdf", b"%")], "path string, content binary")
    for _ in range(2):
        assert {r["path"]: r["markdown"] for r in docs.convert_stored(made, str(tmp_path / "cache")).collect()} == {"a.md": "# A", "x.pdf": "<!-- can't be converted: x.pdf -->"}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1
    files.write_config(files.Config(), str(tmp_path / "c/c.toml"))
    assert files.load_config(str(tmp_path / "c/c.toml")) == files.Config()


def test_engine_goes_on_with_its_logs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.py").write_text("def one():\n    return 1\n")
    (tmp_path / "p/b.py").write_text("def two():\n    return 2\n")
    e = Engine(spark, str(tmp_path / "p"), store=str(tmp_path / "store"))
    e.index()
    (tmp_path / "p/a.py").write_text("def three():\n    return 3\n")
    (tmp_path / "p/b.py").write_text("def four():\n    return 4\n")
    assert e.index_file("a.py") and not e.index_file("a.py") and e.index_file("a.py", force=True)
    assert {r["name"] for r in e.symbols.collect()} == {"three", "two"}
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(6)], "conv_id int, turn int, role string, text string")
    for _ in range(2):  # the second time, the decision is already there
        assert e.dispatch("/clearchat", turns=turns)[1] == {"compressed": 2, "kept_verbatim": 4}
    e.record("top", 1000, 1000, 10)
    later = Engine(spark, str(tmp_path / "p"), store=str(tmp_path / "store"))
    assert [(r["decision"], r["timestamp"] > 1e9) for r in later.log.collect()] == [("t0", True)]
    assert later.dispatch("/showstats")[1]["requests"] == 1 and later.requests.first()["cache_hit_rate"] == 0.5
    text = edits.make_block("a.py", "return 3", "return 33")
    assert e.dispatch("/applychanges", text=text, dry_run=True)[1]["written"] == [] and "33" not in (tmp_path / "p/a.py").read_text()
    assert e.dispatch("/applychanges", text=text, write=True)[1]["written"] == ["a.py"] and "return 33" in (tmp_path / "p/a.py").read_text()


def test_parser_and_counter_hooks(spark):
    df = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.go", "func g() {}\n")], "path string, text string")

    def go(found):
        name = found.select(F.col("path").alias("file"), F.lit("g").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("func g()").alias("signature"))
        return name, parse.edges(parse.lines(found))

    symbols, _ = parse.parse(df, {"go": go})
    assert {(r["file"], r["name"]) for r in symbols.collect()} == {("a.py", "f"), ("b.go", "g")} and {r["name"] for r in parse.parse(df)[0].collect()} == {"f"}
    words = lambda c: F.size(F.split(c, " ")).cast("long")
    turns = spark.createDataFrame([(1, i, "user", "a b c") for i in range(4)], "conv_id int, turn int, role string, text string")
    assert budget.newest_fit(turns, 8, counter=words).count() == 2
    t = lambda x: spark.createDataFrame([(1, x)], "conv_id int, text string")
    small = files.Budgets(window=20, generation_reserve=0)
    layers = {"repo_map": t("a b c\nd e\nf g h"), "user": t("x y")}
    blocks = assemble.assemble(layers, small, counter=words)
    assert {r["layer"]: r["tokens"] for r in blocks.collect()}[6] == 2 and blocks.filter("layer = 2").first()["text"].startswith("a b c\n")
    reports = spark.createDataFrame([(1, "over"), (2, None)], "conv_id int, note string")
    assert assemble.notes(layers, small, reports, counter=words).collect()[0]["notes"] == ["repo_map clipped to 4 tokens", "over"]


def test_pagerank_blocks(spark, monkeypatch):
    """Many rounds over several blocks equal the one task's arrays; rounds neither join nor write the edges again."""
    rnd = random.Random(4)
    names = [f"n{i}" for i in range(300)]
    links = sorted({(rnd.choice(names[:200]), rnd.choice([*names, "n0"])) for _ in range(900)} | {(a, "n1") for a in names[:200]})
    nodes, adj = spark.createDataFrame([(x,) for x in names], "node string"), spark.createDataFrame(links, "src string, dst string")
    seeds = spark.createDataFrame([("n3", 2.0), ("n250", 1.0)], "node string, weight double")
    written, keep = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: (written.append((name, df)), keep(df, name))[1])
    one, many = ({r["node"]: r["score"] for r in graph.pagerank(nodes, adj, seeds, rounds=20, one_task_edges=most).collect()} for most in (10**6, 0))
    assert one.keys() == many.keys() and all(abs(one[x] - many[x]) < 1e-12 for x in one)
    rounds = [df for name, df in written if name == "rank"]
    assert 0 < len(rounds) <= 4 and not any("Join" in df._jdf.queryExecution().toString() for df in rounds)


def test_parse_within_rows(spark):
    """Files are parsed without a shuffle, a window or a join; rows of one path don't mix; bodies equal the joined ones."""
    rows = [("a.py", PY), ("a.py", "def f():\n    g()\n"), ("b.js", "export class K {\n"), ("c.py", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    found = parse.symbols(parse.lines(df, bodies=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Join"))
    assert ("f", 1, 2) in {(r["name"], r["start_line"], r["end_line"]) for r in found.collect()}
    once = df.limit(1).unionByName(df.filter("path <> 'a.py'"))
    cols = ["file", "name", "start_line", "body"]
    want = parse.explain(parse.symbols(parse.lines(once)), once).select(cols).collect()
    assert want and sorted(map(tuple, want)) == sorted(map(tuple, parse.symbols(parse.lines(once, bodies=True)).select(cols).collect()))


def test_ranking_broadcasts_no_names(spark):
    """Sizes on disk tell little of how many names there are, so that joins of names are merged."""
    symbols = spark.createDataFrame([("a", "function", "f.py", 1), ("b", "class", "f.py", 3)], "name string, kind string, file string, start_line int")
    edges = spark.createDataFrame([("b", "a", "calls")], "src string, dst string, kind string")
    ranked = graph.rank_symbols(symbols, edges, mentioned=["a"])
    for df in (graph.known_edges(edges, symbols), ranked):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["name"] for r in ranked.orderBy(F.desc("score")).collect()] == ["a", "b"]


def test_findcode_makes_its_text_when_read(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"m{k}.py").write_text(f"def run():\n    return {k}\n")
    e = Engine(spark, str(tmp_path))
    e.index()
    text_, facts = e.dispatch("/findcode run")
    assert facts == {"kind": "symbol", "count": 3} and "data" not in vars(text_)
    assert str(text_) == "\n\n".join(f"## run (function, m{k}.py line 1)\n```\ndef run():\n    return {k}\n```" for k in range(3))


def test_reindex_writes_listings_as_they_are_dealt(spark, monkeypatch):
    """No listing goes through one task; the later one still comes after the first."""
    from pathlib import Path

    from loomspark.plans import surface

    made, keep = [], surface.work_dir
    monkeypatch.setattr(surface, "work_dir", lambda s, name: (made.append(keep(s, name)), made[-1])[1])
    old, new = ([(f"p{i}", f"{tag}{i}") for i in r] for tag, r in (("old", range(40)), ("new", range(20, 60))))
    frames = [spark.createDataFrame(rows, "path string, hash string").repartition(3) for rows in (new, old)]
    monkeypatch.setattr(surface, "_listings", lambda s, sf: frames)
    got = {tuple(r) for r in surface.streaming_reindex(spark, "").select("path", "hash").collect()}
    assert got == set((dict(old) | dict(new)).items())
    assert len(list(Path(made[0].removeprefix("file:")).glob("*.parquet"))) == 6
