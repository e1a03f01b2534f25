"""The reference graph and personalised PageRank."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..scratch import cut, forget
from .budget import prefix_fit

DAMPING, ROUNDS = 0.85, 40
#: Graphs of at most so many nodes and edges are ranked in one task each.
ONE_TASK_EDGES = 2_000_000
#: Of larger ones, a block holds about so many; and so many rounds go into one job.
BLOCK, WRITE_ROUNDS = 4_000_000, 8
_BLOCKS = "k int, kind int, other int, a binary, b binary, c binary"
_SENT = "k int, other int, lost double, sums binary"


def known_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct src, dst of calls between known names."""
    names = names.select("name").distinct().hint("merge")
    calls = edges.filter("kind = 'calls'").select("src", "dst")
    return calls.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def out_degree(adjacency: DataFrame) -> DataFrame:
    return adjacency.groupBy("src").agg(F.count("*").alias("out_degree"))


def seed_weights(symbols: DataFrame, focus_files=(), mentioned=(), recent_files=()) -> DataFrame:
    """name, weight: 3 for a mentioned name, 2 for each of its symbols in a focus file, 1 in a recent file."""
    inside = lambda c, xs: F.col(c).isin(list(xs)).cast("int") if xs else F.lit(0)
    out = symbols.groupBy("name").agg((3 * F.max(inside("name", mentioned)) + F.sum(2 * inside("file", focus_files) + inside("file", recent_files))).cast("double").alias("weight"))
    return out.filter("weight > 0")


def pagerank(nodes: DataFrame, adjacency: DataFrame, seeds: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """node, score. Teleport follows the seeds' shares, else it is uniform; mass of nodes without edges goes where teleport goes.

    Edges count if both their ends are listed. A graph of at most one_task_edges nodes and edges is one task's arrays; a larger
    one is iterated by blocks. An empty graph gives no rows. Joins are merged, not broadcast: a table's size on disk or by
    estimate tells little of how many names it holds.
    """
    end = lambda c: nodes.select(F.col("node").alias(c)).hint("merge")
    nodes = cut(nodes.select("node"), "nodes")
    edges = cut(adjacency.select("src", "dst").join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select("src", "dst"), "edges")
    n = nodes.count()
    teleport = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("t"))
    if seeds is not None:
        known = seeds.join(nodes.hint("merge"), "node", "left_semi")
        total = known.agg(F.sum("weight")).first()[0]
        if total:
            teleport = nodes.join(known.hint("merge"), "node", "left").select("node", (F.coalesce("weight", F.lit(0.0)) / total).alias("t"))
    m = edges.count()
    if n + m <= one_task_edges:
        return _in_one_task(teleport, edges, damping, rounds)
    return _by_blocks(teleport, edges, damping, rounds, n, m)


def _in_one_task(teleport: DataFrame, adjacency: DataFrame, damping: float, rounds: int) -> DataFrame:
    kind = teleport.schema["node"].dataType.simpleString()

    def run(nodes, links):
        import numpy as np
        import pandas as pd

        nodes = nodes.sort_values("node", kind="stable")
        place = pd.Series(np.arange(len(nodes)), index=nodes["node"].to_numpy())
        src, dst, t = place.reindex(links["src"]).to_numpy(int), place.reindex(links["dst"]).to_numpy(int), nodes["t"].to_numpy(float)
        degree = np.bincount(src, minlength=len(nodes))
        rank = np.full(len(nodes), 1.0 / max(1, len(nodes)))
        for _ in range(rounds):
            share = rank / np.maximum(degree, 1)
            rank = (1 - damping) * t + damping * (rank[degree == 0].sum() * t + np.bincount(dst, share[src], len(nodes)))
        return pd.DataFrame({"node": nodes["node"], "score": rank})

    one = lambda df: df.withColumn("g", F.lit(1)).groupBy("g")
    return one(teleport).cogroup(one(adjacency.select("src", "dst"))).applyInPandas(run, f"node {kind}, score double")


def _by_blocks(teleport: DataFrame, edges: DataFrame, damping: float, rounds: int, n: int, m: int) -> DataFrame:
    """Nodes are dealt to blocks by hash. A block keeps its nodes, their edges and where the others' sums belong as arrays on disk, for all
    rounds; what moves in a round is, for each pair of blocks, one sum for each node of the one that the other calls, without keys.
    Rounds are written out every WRITE_ROUNDS.
    """
    spark = teleport.sparkSession
    count = max(spark.sparkContext.defaultParallelism, -(-(n + m) // BLOCK))
    block = F.pmod(F.hash("node"), F.lit(count))
    placed = teleport.withColumn("block", block).withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1)
    placed = cut(placed, "placed")
    place = lambda c, b, at: placed.select(F.col("node").alias(c), F.col("block").alias(b), F.col("at").alias(at)).hint("merge")
    links = edges.join(place("src", "k", "src_at"), "src").join(place("dst", "to", "dst_at"), "dst").select("k", "src_at", "to", "dst_at")
    shares = placed.select(F.col("block").alias("k"), "at", "t").groupBy("k").applyInArrow(_teleport_block, _BLOCKS)
    blocks = cut(links.groupBy("k").applyInArrow(_link_block, _BLOCKS).unionByName(shares), "blocks")
    fixed = blocks.rdd.map(lambda r: (r["k"], (r["kind"], r["other"], bytes(r["a"]), bytes(r["b"]), bytes(r["c"])))).partitionBy(count, _same).persist(StorageLevel.DISK_ONLY)
    spare, sent, written = [placed, blocks], None, None
    try:
        for i in range(rounds + 1):
            step = _round(n, count, damping, first=i == 0, last=i == rounds)
            sent = (fixed if sent is None else fixed.union(sent.partitionBy(count, _same))).mapPartitions(step)
            if i == rounds or i % WRITE_ROUNDS == WRITE_ROUNDS - 1:
                now = cut(spark.createDataFrame(sent.map(lambda x: (x[0], *x[1])), _SENT, verifySchema=False), "rank")
                if written is not None:
                    forget(written)
                sent, written = now.rdd.map(lambda r: (r["k"], (r["other"], r["lost"], bytes(r["sums"])))), now
    finally:
        fixed.unpersist()
    scores = written.select("k", "sums").mapInArrow(_unpacked, "block int, at int, score double")
    out = cut(placed.hint("merge").join(scores, ["block", "at"]).select("node", "score"), "scores")
    forget(*spare, written)
    return out


def _same(k: int) -> int:
    return k


def _teleport_block(table):
    import numpy as np
    import pyarrow as pa

    t = np.zeros(len(table))
    t[table["at"].to_numpy()] = table["t"].to_numpy()
    return pa.table({"k": pa.array([table["k"][0].as_py()], pa.int32()), "kind": pa.array([0], pa.int32()), "other": pa.array([0], pa.int32()), "a": [t.tobytes()], "b": [b""], "c": [b""]})


def _link_block(table):
    """A block's edges: for each its source's place and its slot among the sums that leave the block; for each other block, the places that its sums are for."""
    import numpy as np
    import pyarrow as pa

    k = table["k"][0].as_py()
    ends, slot = np.unique(table["to"].to_numpy().astype(np.int64) << 32 | table["dst_at"].to_numpy(), return_inverse=True)
    to, begin, size = np.unique(ends >> 32, return_index=True, return_counts=True)
    rows = [(k, 1, k, table["src_at"].to_numpy().astype(np.int32).tobytes(), slot.astype(np.int32).tobytes(), np.stack([to, begin, size]).astype(np.int64).tobytes())]
    rows += [(q, 2, k, (ends[b : b + s] & 0xFFFFFFFF).astype(np.int32).tobytes(), b"", b"") for q, b, s in zip(to.tolist(), begin.tolist(), size.tolist(), strict=True)]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    return pa.table({c: pa.array(x, t) for c, x, t in zip(["k", "kind", "other", "a", "b", "c"], zip(*rows, strict=True), kinds, strict=True)})


def _round(n: int, count: int, damping: float, first: bool, last: bool):
    """From a block's arrays and the others' sums its ranks; of those the sums for the others, or in the last round the ranks."""

    def run(rows):
        import numpy as np

        t, links, places, came = None, None, {}, []
        for k, x in rows:
            if len(x) == 3:
                came.append(x)
            elif x[0] == 0:
                own, t = k, np.frombuffer(x[2])
            elif x[0] == 1:
                links = np.frombuffer(x[2], np.int32), np.frombuffer(x[3], np.int32), np.frombuffer(x[4], np.int64).reshape(3, -1)
            else:
                places[x[1]] = np.frombuffer(x[2], np.int32)
        if t is None:
            return
        rank = np.full(len(t), 1.0 / n)
        if not first:
            came.sort(key=lambda x: x[0])  # sums don't hang on the order of arrival
            got = np.zeros(len(t))
            for other, _, sums in came:
                if sums:
                    got[places[other]] += np.frombuffer(sums)
            rank = (1 - damping) * t + damping * (sum(x[1] for x in came if x[1]) * t + got)
        if last:
            yield own, (own, 0.0, rank.tobytes())
            return
        src, slot, (to, begin, size) = links if links else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((3, 0), np.int64))
        degree = np.bincount(src, minlength=len(t))
        sums = np.bincount(slot, (rank / np.maximum(degree, 1))[src], int(size.sum()))
        lost = float(rank[degree == 0].sum())
        each = {q: sums[b : b + s].tobytes() for q, b, s in zip(to.tolist(), begin.tolist(), size.tolist(), strict=True)}
        for q in range(count) if lost else each:
            yield q, (own, lost, each.get(q, b""))

    return run


def _unpacked(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for k, sums in zip(batch["k"].to_pylist(), batch["sums"].to_pylist(), strict=True):
            score = np.frombuffer(sums)
            for a in range(0, len(score), 100_000):
                part = score[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part)], names=["block", "at", "score"])


def representatives(symbols: DataFrame, prefer: str = "definition") -> DataFrame:
    """One symbol for each name, the first by position: a definition before a variable, or the other way with prefer='variable'."""
    last = (F.col("kind") == "variable") if prefer == "definition" else (F.col("kind") != "variable")
    rest = F.struct(*[c for c in symbols.columns if c != "name"])
    return symbols.groupBy("name").agg(F.min_by(rest, F.struct(last, "file", "start_line")).alias("s"), F.min(F.struct("file", "start_line")).alias("first")).select("name", "s.*", "first")


def rank_symbols(symbols: DataFrame, edges: DataFrame, focus_files=(), mentioned=(), recent_files=(), prefer: str = "definition") -> DataFrame:
    """Each name's representative symbol and score; order by score descending, then first."""
    nodes = symbols.select(F.col("name").alias("node")).distinct()
    seeds = seed_weights(symbols, focus_files, mentioned, recent_files).withColumnRenamed("name", "node") if focus_files or mentioned or recent_files else None
    scores = pagerank(nodes, known_edges(edges, symbols), seeds)
    return representatives(symbols, prefer).join(scores.withColumnRenamed("node", "name").hint("merge"), "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


HEADER = "# Code by rank"
#: Fixed value: what a header costs in the budget.
HEADER_COST = 10


def fit_map(ranked: DataFrame, budget: int) -> DataFrame:
    """The ranked symbols that fit a map of `budget` tokens, with `used`. Each costs 3 at least, so a top-k bounds what the running sum sees."""
    order = [F.desc("score"), F.col("first")]
    cost = token_count(F.concat(F.lit("  "), F.col("signature"))) + 2
    top = ranked.orderBy(*order).limit(max(0, budget) // 3 + 1).withColumn("map", F.lit(1))
    return prefix_fit(top, ["map"], order, cost, F.lit(budget), HEADER_COST).drop("map")


def map_sections(fitted: DataFrame) -> DataFrame:
    """file and section (its name over its signatures by line) of fitted symbols."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "signature"))), lambda x: F.concat(F.lit("  "), x["signature"]))
    return fitted.groupBy("file").agg(F.concat_ws("\n", F.col("file"), F.array_join(lines, "\n")).alias("section"), F.count("*").alias("n"))


def render_map(ranked: DataFrame, budget: int) -> str:
    """The map as text: sections in order of files. Only what fits the budget comes to the driver."""
    sections = map_sections(fit_map(ranked, budget)).orderBy("file").collect()
    hidden = ranked.count() - sum(r["n"] for r in sections)
    if not sections and not hidden:
        return "(no symbols)"
    return "\n\n".join([HEADER, *(r["section"] for r in sections), *([f"({hidden} symbols don't fit)"] if hidden else [])])
