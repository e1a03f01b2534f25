"""Links between items that share a key, and connected components, without all pairs of a group or any collect.

Both work on tables in the shared checkpoint folder, so that a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import cut, forget


#: Rows of two numbers that are broadcast at most.
MOST_BROADCAST = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    """A table of cut() for a join: broadcast up to a bound, else as it is, so that adaptive execution can split the other side's hot keys."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is a combining minimum and an equi-join, and
    their number grows with the logarithm of the longest path. Each round is written out, and so are its minima, so that
    the star of a giant component, whose centre is one key, can be split.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges, name)
    state = None
    while True:  # ends, since labels only fall and a round that changes no edge is the last
        # Large-star: larger neighbours of u get u's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), name)
        large = both.filter("b > a").join(_bounded(near), "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = cut(large, name)
        # Small-star: smaller neighbours of u, and u, get the smallest of them.
        far = cut(large.groupBy("b").agg(F.min("a").alias("m")), name)
        small = large.join(_bounded(far), "b")
        out = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        before, edges = edges, cut(out.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
        forget(before, near, large, far)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("node"), F.col("m").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def colliding(keys: DataFrame, name: str) -> DataFrame:
    """The rows of keys (key, id, ...; all different) whose key stands at two different ids, with `pivot`, the key's smallest id; written out.

    The smallest and largest id of a key combine before their shuffle, and the join with them can split a hot key.
    """
    ends = cut(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_most")).filter("pivot <> _most").select("key", "pivot"), name)
    return cut(keys.join(_bounded(ends), "key"), name)


def spanning(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> list[tuple[int, int]]:
    """Of links (a, b) between components (ca, cb), those that join components not joined by earlier ones."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    out = []
    for x, y, cx, cy in zip(a.tolist(), b.tolist(), ca.tolist(), cb.tolist(), strict=True):
        x_root, y_root = find(cx), find(cy)
        if x_root != y_root:
            root[x_root] = y_root
            out.append((x, y))
    return out


def _blockwise(many: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], members: int) -> DataFrame:
    """Links (a, b) between the components of each key: its members are dealt to blocks of bounded size, and every two blocks are compared."""

    def joined(pdf):
        import pandas as pd

        ids, comp = pdf["id"].to_numpy(), pdf["component"].to_numpy()
        out: list[tuple[int, int]] = []
        for lo in range(0, len(ids), 256):
            i, j = np.nonzero(near(ids[lo : lo + 256, None], ids[None, :]) & (comp[lo : lo + 256, None] < comp[None, :]))
            if not len(i):
                continue
            _, one = np.unique(np.stack([comp[lo + i], comp[j]]), axis=1, return_index=True)  # one link for two components
            i, j = i[one] + lo, j[one]
            out += spanning(ids[i], ids[j], comp[i], comp[j])
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    blocks = F.ceil(F.col("size") / members)
    dealt = many.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.select("key", "id", "component", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return dealt.select("key", "id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).groupBy("key", "i", "j").applyInPandas(joined, "a bigint, b bigint").distinct()


def _mixed(labelled: DataFrame) -> DataFrame:
    """Rows (key, id, component) whose key stands in two components, with the key's size."""
    ends = labelled.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("size")).filter("_a <> _b")
    return labelled.join(cut(ends.select("key", "size"), "mixed"), "key").select("key", "id", "component", "size")


def linked(
    shared: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[np.ndarray, np.ndarray], np.ndarray], finer: Callable[[DataFrame], DataFrame], name: str, small: int = 32, members: int = 2000, hot: int = 8000
) -> DataFrame:
    """node, component over all verified links between ids that share a key.

    First each id is compared with its key's smallest (a number of pairs in proportion to the rows), and the links are
    joined up. Then only members of keys that still have several components are compared, which can add every link that
    matters to a component and none that doesn't: up to `small` members by a join of pairs (so at most small / 2 for each
    row), more in blocks of `members`, of which only links that join components are emitted. A key of over `hot` members is
    first split by finer, which maps rows (key, id, component) to finer keys that lose no link.

    verify gets pairs (a, b), distinct, and keeps those that link; near does the same for arrays of ids.
    """
    star = verify(shared.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    first = cut(components(star, name), name)
    labelled = cut(shared.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), name)
    mixed = cut(_mixed(labelled), name)
    few = mixed.filter(F.col("size") <= small)
    left = few.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    right = few.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = verify(left.join(right, "key").filter("a < b AND ca <> cb").select("a", "b").distinct()).select("a", "b")
    split = _mixed(cut(finer(mixed.filter(F.col("size") > hot).select("key", "id", "component")).distinct(), name))
    many = mixed.filter((F.col("size") > small) & (F.col("size") <= hot)).unionByName(split)
    more = cut(pairs.unionByName(_blockwise(many, near, members)), name)
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), name)
