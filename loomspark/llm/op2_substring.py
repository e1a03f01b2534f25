"""Substring dedup by paragraph MinHash banding.

Paragraphs are a text's lines; words are lower-cased (A-Z) runs of non-spaces. Each distinct paragraph of five words or more
gets a MinHash signature of its five-word shingles; bands of equal rows become keys, so many that a pair at the threshold
collides with probability 1 - (1 - s^rows)^bands (0.998 at 0.8). Colliding paragraphs are verified by exact Jaccard similarity
of their shingle sets, links are joined to components, and each component keeps the paragraph that comes first (smallest
identifier, then position). Shorter paragraphs are linked when their words are equal. Copies of min_words words or more are
removed; those of fewer words (headings, greetings, closing formulas) are reported in a column of their own and stay.

A passage can also stand inside longer paragraphs that differ. For these the same words are winnowed (Schleimer et al.,
2003): of every `WINNOW` successive runs of `RUN` words the one with the smallest hash is kept, so that any shared stretch of
RUN + WINNOW - 1 = 47 words shares a kept run. Picks of a shared stretch are at most WINNOW apart, so together they cover it
up to WINNOW - 1 words at each end; runs that stand in several documents are therefore extended by the words around them as
far as another document has the same. A word stays in the first document that has its stretch and is removed from the others.

Copies of a paragraph leave a task once, whatever their number. Paragraphs are first compared with one pivot of each key;
only where a key still has several components are its members compared with each other, in blocks of bounded size whose
rows are members, never pairs. A key of many thousand members is first split by finer bands, which a linked pair shares with
probability 1 - 3e-8. Tables that nothing reads any more are deleted on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components
from .textops import chunks, cut, forget, grams, load, mix, words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
FINE_BANDS, FINE_ROWS = 24, 3
#: Paragraphs that are removed have so many words at least.
MIN_WORDS = 20
RUN, WINNOW = 24, 24
#: Documents whose numbers are broadcast at most.
MOST_NAMES = 500_000
#: Digests remembered by a task so that it sends a paragraph's keys once.
SEEN = 500_000
#: Bytes that go to a Python worker at once, which both sides hold; and bytes of texts that it works on at once, whose arrays take many times as much.
BATCH, CHUNK = 1 << 22, 1 << 19
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_U = np.uint64
_SALTS = (mix(np.arange(1, BANDS * ROWS + FINE_BANDS * FINE_ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def _cut_python(df: DataFrame, name: str) -> DataFrame:
    """cut() of a table that Python workers make, which get BATCH bytes at once; a session's own setting holds."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is not None:
        return cut(df, name)
    conf.set(_BATCH_BYTES, str(BATCH))
    try:
        return cut(df, name)
    finally:
        conf.unset(_BATCH_BYTES)


class _Lines:
    """Paragraphs of a chunk: word bounds, owning document, first word within its document, digest, and five-word shingles."""

    def __init__(self, texts: pa.Array, min_words: int = 1):
        self.words = w = words_of(texts)
        self.h = w.hashes()
        n = len(w.starts)
        breaks = np.zeros(len(w.buf) + 1, np.int64)
        if len(w.buf):
            np.cumsum(w.buf == 10, out=breaks[1:])
        new = np.ones(n, bool)
        if n:
            new[1:] = breaks[w.starts[1:]] != breaks[w.starts[:-1]]
            new[w.first[:-1][w.first[:-1] < n]] = True
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], n)[: len(self.first)]
        owner = w.owner()[self.first] if n else np.zeros(0, np.int64)
        # Paragraph numbers count those with words within their document.
        self.index = np.arange(len(owner)) - np.searchsorted(owner, owner) if n else owner
        keep = self.last - self.first >= min_words
        self.first, self.last, self.owner, self.index = self.first[keep], self.last[keep], owner[keep], self.index[keep]
        edges = np.append(np.flatnonzero(new), n)
        self.shingles, self.at = grams(self.h, edges, SHINGLE)
        a = np.searchsorted(self.at, self.first)
        b = np.searchsorted(self.at, self.last)
        self.spans = a, b
        total = np.zeros(n + 1, _U)
        place = np.arange(n, dtype=_U) - np.repeat(edges[:-1], np.diff(edges)).astype(_U)
        np.cumsum(mix(self.h + place * _U(0xD1B54A32D192ED03)), out=total[1:])
        self.digest = mix(total[self.last] - total[self.first] + (self.last - self.first).astype(_U)).view(np.int64)


def signature_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int = BANDS, rows_each: int = ROWS, salts: np.ndarray = _SALTS) -> np.ndarray:
    """Band keys (int64), one row of `bands` for each span [a, b) of shingles; spans aren't empty.

    A permutation is a multiplication of the shingles' mixed upper halves by an odd number; 32 bits keep it in vector units.
    """
    out = np.empty((len(a), bands), _U)
    half = np.append((shingles >> _U(32)).astype(np.uint32), np.uint32(0))
    last = np.maximum(b - 1, a)
    order = np.argsort(last - a, kind="stable")
    at = 0
    while at < len(order):  # paragraphs of like length side by side, the short ones padded with their last shingle
        n = 512
        while n > 1 and n * int((last - a)[order[min(at + n, len(order)) - 1]] + 1) > 1 << 16:
            n //= 2
        rows = order[at : at + n]
        at += n
        length = int((last - a)[rows[-1]]) + 1
        block = half[np.minimum(a[rows][None, :] + np.arange(length)[:, None], last[rows][None, :])]
        v = np.empty_like(block)
        for band in range(bands):
            key = np.full(len(rows), band + 1, _U)
            for r in range(rows_each):
                np.multiply(block, salts[band * rows_each + r], out=v)
                key = key * _U(0x100000001B3) + v.min(axis=0)
            out[rows, band] = key
    return mix(out).view(np.int64)


def _new_ones(digests: np.ndarray, seen: set[int]) -> np.ndarray:
    """First places of the digests that aren't in `seen`, which gets them; it is emptied when full."""
    _, first = np.unique(digests, return_index=True)
    new = first[np.array([int(d) not in seen for d in digests[first].tolist()], bool)] if len(first) else first
    if len(seen) > SEEN:
        seen.clear()
    seen.update(digests[new].tolist())
    return new


#: What one pass over the texts finds: paragraphs, band keys of paragraphs of five words or more (once for each task and digest; copies: in the chunk where it was first seen), and winnowed runs.
PARAGRAPH, BAND, RUNS = range(3)
_FOUND = [("kind", pa.int8(), "tinyint"), ("doc_id", None, None), ("th", pa.int64(), "bigint"), ("start", pa.int64(), "bigint"), ("par", pa.int64(), "bigint"), ("n", pa.int64(), "bigint"), ("digest", pa.int64(), "bigint"), ("key", pa.int64(), "bigint"), ("id", pa.int64(), "bigint"), ("copies", pa.int32(), "int"), ("h", pa.int64(), "bigint")]


def scanned(docs: DataFrame) -> DataFrame:
    """Rows of all three kinds for rows of _prepared, whose columns are null where a kind has none; written out."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        seen: set[int] = set()
        for b in chunks(batches, CHUNK):
            ids = b.column("doc_id")

            def rows(what, size, /, ids=ids, **cols):
                cols["kind"] = pa.array(np.full(size, what, np.int8))
                return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(size, t or ids.type) for c, t, _ in _FOUND], [c for c, *_ in _FOUND])

            x = _Lines(b.column("text"))
            at = pa.array(x.owner)
            yield rows(PARAGRAPH, len(x.owner), doc_id=ids.take(at), th=b.column("th").take(at), start=pa.array(x.first - x.words.first[x.owner]), par=pa.array(x.index), n=pa.array(x.last - x.first), digest=pa.array(x.digest))
            long = np.flatnonzero(x.last - x.first >= SHINGLE)
            new = long[_new_ones(x.digest[long], seen)]
            if len(new):
                order = np.sort(x.digest)
                copies = np.searchsorted(order, x.digest[new], "right") - np.searchsorted(order, x.digest[new])
                keys = signature_keys(x.shingles, x.spans[0][new], x.spans[1][new])
                yield rows(BAND, keys.size, key=pa.array(keys.ravel()), id=pa.array(np.repeat(x.digest[new], BANDS)), copies=pa.array(np.repeat(copies, BANDS).astype(np.int32)))
            h, own, start = _winnowed(x.words, x.h)
            if len(h):
                own = pa.array(own)
                yield rows(RUNS, len(h), doc_id=ids.take(own), th=b.column("th").take(own), start=pa.array(start), h=pa.array(h.view(np.int64)))

    return _cut_python(docs.mapInArrow(run, ", ".join(f"{c} {t or kind.simpleString()}" for c, _, t in _FOUND)), "scan")


def _shingle_sets(batches):
    """Shingle sets of paragraphs, once for each task and digest."""
    seen: set[int] = set()
    for b in chunks(batches, CHUNK):
        x = _Lines(b.column("text"), SHINGLE)
        new = _new_ones(x.digest, seen)
        first, sizes = x.spans[0][new], (x.spans[1] - x.spans[0])[new]
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(new)), sizes)
        values = x.shingles[np.arange(len(owner)) + np.repeat(first - ends + sizes, sizes)]
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        once = np.ones(len(values), bool)
        once[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        edges = np.searchsorted(owner[once], np.arange(len(new) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x.digest[new]), pa.ListArray.from_arrays(pa.array(edges), pa.array(values[once].view(np.int64)))], ["id", "shingles"])


def _fine_keys(batches):
    """Rows (key, id, component, shingles) under finer band keys."""
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            b = batch.slice(lo, 4096)
            lists = b.column("shingles")
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            fine = signature_keys(lists.flatten().to_numpy().view(_U), np.append(0, ends[:-1]), ends, FINE_BANDS, FINE_ROWS, _SALTS[BANDS * ROWS :])
            keys = mix(fine.view(_U) + mix(b.column("key").to_numpy().view(_U))[:, None]).view(np.int64)
            each = lambda c: pa.array(np.repeat(b.column(c).to_numpy(), FINE_BANDS))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), each("id"), each("component")], ["key", "id", "component"])


def _winnowed(w, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed runs of a chunk: hash, document index, first word within the document."""
    h, at = grams(words, w.first, RUN)
    if not len(h):
        return h, at, at
    own = w.owner()[at]
    starts = np.searchsorted(own, np.arange(len(w.first)))
    pad = np.concatenate([h, np.full(WINNOW - 1, np.iinfo(np.uint64).max, _U)])
    picked = np.zeros(len(h), bool)
    # A window never crosses texts: positions of the last windows shrink to the text's end.
    view = np.lib.stride_tricks.sliding_window_view(pad, WINNOW)
    full = np.flatnonzero(np.arange(len(h)) + WINNOW <= np.repeat(starts[1:], np.diff(starts)))
    for lo in range(0, len(full), 1 << 16):
        part = full[lo : lo + (1 << 16)]
        picked[part + view[part].argmin(axis=1)] = True
    for a, z in zip(starts[:-1], starts[1:], strict=True):
        if 0 < z - a < WINNOW:
            picked[a + int(h[a:z].argmin())] = True
    i = np.flatnonzero(picked)
    return h[i], own[i], at[i] - w.first[own[i]]


def _around(batches):
    """Hashes of up to WINNOW - 1 words before (nearest first) and after each run in column `at`."""
    reach = WINNOW - 1
    for b in chunks(batches, CHUNK):
        w = words_of(b.column("text"))
        h = (w.hashes() >> _U(32)).astype(np.uint32)
        at = b.column("at")
        runs, own = at.flatten(), np.repeat(np.arange(len(b)), pa.compute.list_value_length(at).to_numpy())
        starts = runs.field("start").to_numpy() + w.first[own]
        low, high = np.maximum(w.first[own], starts - reach), np.minimum(w.first[own + 1], starts + RUN + reach)
        before = [h[x:y][::-1].tobytes() for x, y in zip(low.tolist(), starts.tolist(), strict=True)]
        after = [h[x:y].tobytes() for x, y in zip((starts + RUN).tolist(), high.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([runs.field("h"), b.column("d").take(pa.array(own)), runs.field("start"), runs.field("best"), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["h", "d", "start", "best", "before", "after"])


def _steps(t: pa.Table) -> pa.Table:
    """For words around a run (h, side, words) with the first and last document that have them (lo, hi): each number of words that another document shares, and the first document that does (the longest for each such document)."""
    n, reach = len(t), WINNOW - 1
    lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
    raw = t.column("words").to_pylist()
    length = np.array([len(x) // 4 for x in raw])
    words = np.frombuffer(b"".join(x.ljust(4 * reach, b"\0") for x in raw), np.uint32).reshape(n, reach)
    cls = np.unique(mix(t.column("h").to_numpy().view(_U) + t.column("side").to_numpy().astype(_U)), return_inverse=True)[1].astype(_U)
    held, alive = np.full((n, reach + 1), -1, np.int64), np.arange(n)
    for k in range(reach):
        alive = alive[length[alive] > k]
        part = np.unique((cls[alive] << _U(32)) | words[alive, k], return_inverse=True)[1]
        least, most = np.full(len(alive), np.iinfo(np.int64).max), np.full(len(alive), -1)
        np.minimum.at(least, part, lo[alive])
        np.maximum.at(most, part, hi[alive])
        both = least[part] < most[part]
        alive, part = alive[both], part[both]
        if not len(alive):
            break
        cls[alive] = part.astype(_U)
        held[alive, k] = least[part]
    row, k = np.nonzero((held[:, :-1] >= 0) & (held[:, :-1] != held[:, 1:]))
    steps = pa.StructArray.from_arrays([pa.array(k + 1, pa.int64()), pa.array(held[row, k], pa.int64())], ["n", "d"])
    some = np.unique(row)
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, some), len(row)), pa.int32()), steps)
    kept = t.select(["h", "side", "words"]).take(pa.array(some))
    return pa.table([*kept.columns, lists], names=["h", "side", "words", "steps"])


def _extended(texts: DataFrame, hits: DataFrame, together: int = 16_000) -> DataFrame:
    """hits (h, d, start, best) with `left` and `right`: the steps of _steps before and after each run. texts: d, text."""
    at = hits.groupBy("d").agg(F.collect_set(F.struct("h", "start", "best")).alias("at"))
    around = _cut_python(texts.join(at, "d").select("text", "d", "at").mapInArrow(_around, "h bigint, d bigint, start bigint, best bigint, before binary, after binary"), "around")
    sides = [around.select("h", F.lit(i).alias("side"), F.col(c).alias("words"), "d").filter(F.length("words") > 0) for i, c in enumerate(("before", "after"))]
    each = cut(sides[0].unionByName(sides[1]).groupBy("h", "side", "words").agg(F.min("d").alias("lo"), F.max("d").alias("hi")), "sides")
    # Words that share a first word come to one group; others share nothing.
    dealt = each.withColumn("g", F.pmod(F.xxhash64("h", "side", F.expr("substring(words, 1, 4)")), F.lit(max(1, each.count() // together))))
    steps = _cut_python(dealt.groupBy("g").applyInArrow(_steps, "h bigint, side int, words binary, steps array<struct<n:bigint,d:bigint>>"), "steps")
    forget(each)
    side = lambda i, c, name: steps.filter(F.col("side") == i).select("h", F.col("words").alias(c), F.col("steps").alias(name))
    return around.join(side(0, "before", "left"), ["h", "before"], "left").join(side(1, "after", "right"), ["h", "after"], "left").drop("before", "after")


def _stars(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of a key and its pivot."""
    pairs = shared.filter("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct()
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").filter(both >= SIMILARITY * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _member_links(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join different components among members: at most one fewer than there are components."""
    parts, comp = np.unique(comp, return_inverse=True)
    if len(parts) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    n = len(sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    row, flat = np.repeat(np.arange(n), sizes)[order], flat[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) >= 2
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    width = max(1, (1 << 22) // n)
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(often.sum()), width):  # exact counts: products of zeros and ones
        here = (column >= lo) & (column < lo + width)
        x = np.zeros((n, min(width, int(often.sum()) - lo)), np.float32)
        x[row[here], column[here] - lo] = 1
        both += x @ x.T
    links = (both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both) - 1e-6) & (comp[:, None] != comp[None, :])
    root = list(range(len(parts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in np.flatnonzero(links.any(axis=1)).tolist():
        near = np.flatnonzero(links[i])
        for c, k in zip(*np.unique(comp[near], return_index=True), strict=True):
            x, y = find(int(comp[i])), find(int(c))
            if x != y:
                root[x] = y
                out.append((int(ids[i]), int(ids[near[k]])))
    return out


def _joined(pdf):
    """Links of the keys in one group of whole keys, or of one block pair of a large key."""
    import pandas as pd

    pdf = pdf.sort_values(["key", "id"], kind="stable")
    keys, ids, comp, sets = pdf["key"].to_numpy(), pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["shingles"].to_list()
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    out, known = [], set()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        members = ids[a:b].tobytes()
        if members not in known:  # another band of the same members
            known.add(members)
            out += _member_links(ids[a:b], comp[a:b], sets[a:b])
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Rows (key, id, component; written out) whose key stands in two components, with the key's size and smallest member; written out."""
    ends = labelled.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.min("id").alias("least"), F.count("*").alias("size")).filter("_a <> _b")
    return cut(labelled.join(cut(ends.select("key", "least", "size"), "mixed"), "key"), "mixed")


def _rest(mixed: DataFrame, sets: DataFrame, members: int = 1000, hot: int = 8000, shingles: int = 200_000, together: int = 4000) -> DataFrame:
    """Links between components that still share a key. A large key's members are dealt to blocks of bounded size, and every two blocks are compared; a key of over `hot` members is split by finer ones first; small keys go together."""
    large = mixed.filter(F.col("size") > hot).select("key", "id", "component")
    split = _mixed(_cut_python(large.join(sets, "id").mapInArrow(_fine_keys, "key bigint, id bigint, component bigint").distinct(), "fine"))
    sized = cut(mixed.filter(F.col("size") <= hot).unionByName(split).join(sets.select("id", F.size("shingles").alias("n")), "id"), "sized")
    weight = cut(sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / shingles)).alias("blocks")), "blocks")
    groups = max(1, sized.count() // together)
    # Keys with the same smallest member come to one group, which sees that several bands have the same members.
    dealt = sized.join(weight, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("g", F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("least"), F.lit(groups))))
    dealt = dealt.select("key", "id", "component", "g", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "id", "component", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets, "id").groupBy("g", "i", "j").applyInPandas(_joined, "a bigint, b bigint").distinct()


def _colliding(scan: DataFrame) -> DataFrame:
    """key, id, pivot of the keys that stand at two paragraphs; the pivot is the one with most copies, which variants are likeliest to be near."""
    keys = scan.filter(F.col("kind") == BAND).select("key", "id", F.col("copies").alias("n"))
    ends = cut(keys.groupBy("key").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter("_a <> _b").select("key"), "keys")
    rows = cut(keys.join(ends, "key").groupBy("key", "id").agg(F.max("n").alias("n")), "bands")
    forget(ends)
    pivots = cut(rows.groupBy("key").agg(F.max(F.struct("n", "id")).alias("m")).select("key", F.col("m.id").alias("pivot")), "pivots")
    shared = cut(rows.join(pivots, "key").select("key", "id", "pivot"), "bands")
    forget(rows, pivots)
    return shared


def paragraph_classes(docs: DataFrame, scan: DataFrame | None = None, most_wanted: int = 1_000_000, hot: int = 8000) -> DataFrame:
    """Each paragraph of rows of _prepared: doc_id, th, par (its number), start and n (words), class (representative digest). scan: see scanned()."""
    scan = scanned(docs) if scan is None else scan
    units = scan.filter(F.col("kind") == PARAGRAPH).select("doc_id", "th", "par", "start", "n", "digest")
    shared = _colliding(scan)
    wanted = cut(shared.select("id").distinct(), "wanted")
    small = wanted.count() <= most_wanted
    sets = docs.select("text").mapInArrow(_shingle_sets, "id bigint, shingles array<bigint>").join(F.broadcast(wanted) if small else wanted, "id", "left_semi")
    sets = _cut_python(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")
    first = cut(components(_stars(shared, sets), "paragraphs"), "paragraphs")
    labelled = cut(shared.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "labelled")
    mixed = _mixed(labelled)
    forget(shared, wanted, labelled)
    more = _cut_python(_rest(mixed, sets, hot=hot), "links")
    forget(mixed, sets)
    classes = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "paragraphs")
    classes = cut(classes.select(F.col("node").alias("digest"), F.col("component").alias("_c")), "classes")
    return units.join(classes, "digest", "left").select("doc_id", "th", "par", "start", "n", F.coalesce("_c", "digest").alias("class"))


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash, which tells rows of one identifier apart), text."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def paragraph_copies(docs: DataFrame, scan: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs (of rows of _prepared) that repeat: doc_id, th, start and n (words), class, keep_id (document of the kept one), links (others of the class), short (under min_words words), removed."""
    units = cut(paragraph_classes(docs, scan), "units")
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("par"), F.col("th"))
    often = units.groupBy("class").agg(F.count("*").alias("size")).filter("size > 1")
    some = cut(units.join(cut(often, "often"), "class"), "copies")  # the rest isn't ordered
    forget(units)
    best = cut(some.groupBy("class").agg(F.min(place).alias("best")), "best")
    short = F.col("n") < min_words
    return some.join(best, "class").select("doc_id", "th", "start", "n", "class", F.col("best.doc_id").alias("keep_id"), (F.col("size") - 1).alias("links"), short.alias("short"), (~short & (place != F.col("best"))).alias("removed"))


def run_copies(docs: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winnowed runs (of rows of _prepared) that stand in several documents, extended: d, h, all (span s, e that others have too), gone (the part of it that an earlier document has, or null) and keeps (numbers of those documents); and the documents' numbers: d, doc_id, th."""
    runs = scan.filter(F.col("kind") == RUNS).select("h", "doc_id", "th", "start")
    # Written out, so that the join can split a run that many documents have.
    who = F.xxhash64("doc_id", "th")
    many = cut(runs.groupBy("h").agg(F.min(who).alias("a"), F.max(who).alias("b")).filter("a <> b").select("h"), "many")
    hits = cut(runs.join(many, "h"), "hits")
    forget(many)
    # Numbers that rise with identifier and text, made by a distributed sort; equal rows have one.
    ordered = hits.select("doc_id", "th").distinct().orderBy(F.col("doc_id").isNull(), "doc_id", "th")
    names = cut(ordered.withColumn("d", F.monotonically_increasing_id()), "names")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    few = F.broadcast(names) if names.count() <= MOST_NAMES else names
    named = cut(hits.join(few, same(hits, names)).select("h", "d", "start"), "hits")
    forget(hits)
    best = cut(named.groupBy("h").agg(F.min("d").alias("best")), "best")
    # Rows that repeat identifier and text say the same twice, which changes no span.
    found = _extended(docs.join(few, same(docs, names)).select("d", "text"), named.join(best, "h"))
    none = F.array().cast(found.schema["left"].dataType)
    zero = F.lit(0).cast("long")
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.coalesce(c, none), lambda x: x["n"])), zero)
    # The longest stretch that an earlier document has, and that document; it has the run too.
    earlier = lambda c: F.array_max(F.filter(F.coalesce(c, none), lambda x: x["d"] < F.col("d")))
    found = found.select("*", longest("left").alias("l"), longest("right").alias("r"), earlier("left").alias("el"), earlier("right").alias("er"))
    span = lambda l, r: F.struct((F.col("start") - l).alias("s"), (F.col("start") + F.lit(RUN) + r).alias("e"))
    gone = F.when(F.col("d") != F.col("best"), span(F.coalesce("el.n", zero), F.coalesce("er.n", zero)))
    keeps = F.when(F.col("d") != F.col("best"), F.array_distinct(F.array_compact(F.array("best", "el.d", "er.d"))))
    return found.select("d", "h", span(F.col("l"), F.col("r")).alias("all"), gone.alias("gone"), keeps.alias("keeps")), names


def _covered(spans):
    """Words in the union of (s, e) spans."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.sort_array(spans), F.struct(zero.alias("n"), zero.alias("to")), step, lambda a: a["n"])


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_repeated (words in passages that stand elsewhere too), n_removed (words that go), keep_ids (documents whose copies stay instead), links, n_short (words in repeated paragraphs of under min_words words, which stay); one row per input row.

    Null and empty texts have no words and repeat nothing. Whole texts are read, however long; ties go to the smallest
    identifier, then the first place; other columns aren't read. Rows that repeat an identifier and text count as one
    document and each get its result; null identifiers sort last. An empty table gives no rows.
    """
    rows = _prepared(docs)
    scan = scanned(rows)
    pars = paragraph_copies(rows, scan, min_words).withColumn("span", F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")))
    per = pars.groupBy("doc_id", "th").agg(
        F.collect_list(F.when(~F.col("short"), F.col("span"))).alias("all"), F.collect_list(F.when(F.col("removed"), F.col("span"))).alias("gone"), F.collect_list(F.when(F.col("short"), F.col("span"))).alias("short"),
        F.collect_set(F.when(F.col("removed"), F.col("keep_id"))).alias("keep_ids"), F.sum(F.when(F.col("short"), 0).otherwise(F.col("links"))).alias("links"),
    )
    runs, names = run_copies(rows, scan)
    # A document's paragraphs hold all its words; rows that repeat it have as many first ones.
    paragraphs = scan.filter(F.col("kind") == PARAGRAPH).groupBy("doc_id", "th").agg((F.sum("n") / F.count_if(F.col("par") == 0)).cast("long").alias("words"))
    lengths = cut(paragraphs.select(F.col("doc_id").alias("_lid"), F.col("th").alias("_lth"), "words"), "lengths")
    forget(scan)
    lists = cut(runs.groupBy("d").agg(F.collect_list("all").alias("r_all"), F.collect_list("gone").alias("r_gone"), F.array_distinct(F.flatten(F.collect_list("keeps"))).alias("keeps")), "run-spans")
    number = lambda c: names.select(F.col("d").alias(c), F.col("doc_id").alias("k_id"))
    keeps = lists.select("d", F.explode("keeps").alias("k")).join(number("k"), "k").groupBy("d").agg(F.collect_set("k_id").alias("r_ids"))
    by_run = lists.drop("keeps").join(keeps, "d", "left").join(names, "d").select(F.col("doc_id").alias("_rid"), F.col("th").alias("_rth"), "r_all", "r_gone", "r_ids")
    per = per.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "all", "gone", "short", "keep_ids", "links")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("th")).join(lengths, F.col("doc_id").eqNullSafe(F.col("_lid")) & (F.col("th") == F.col("_lth")), "left")
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").join(by_run, F.col("doc_id").eqNullSafe(F.col("_rid")) & (F.col("th") == F.col("_rth")), "left")
    both = lambda a, b: F.concat(F.coalesce(a, F.array().cast(out.schema[a].dataType)), F.coalesce(b, F.array().cast(out.schema[a].dataType)))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.coalesce("words", zero).alias("n_words"), _covered(both("all", "r_all")).alias("n_repeated"), _covered(both("gone", "r_gone")).alias("n_removed"), F.sort_array(F.array_distinct(both("keep_ids", "r_ids"))).alias("keep_ids"),
        F.coalesce("links", zero).alias("links"), _covered(F.coalesce("short", F.array().cast(out.schema["short"].dataType))).alias("n_short"),
    )


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, spans (s, e in words, in order) that substring_dedup removes, for clean_text(); rows of which some words go."""
    rows = _prepared(docs)
    scan = scanned(rows)
    pars = paragraph_copies(rows, scan, min_words).filter("removed").select("doc_id", "th", F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")).alias("span"))
    runs, names = run_copies(rows, scan)
    more = runs.filter("gone IS NOT NULL").join(names, "d").select("doc_id", "th", F.col("gone").alias("span"))
    return pars.unionByName(more).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def clean_text(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans; the space after a removed word goes with it."""
    import re

    gone = {i for s, e in spans for i in range(s, e)}
    parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    lead = re.match(r"[\x20\x09-\x0D]*", text)[0]
    return lead + "".join(p for i, p in enumerate(parts) if i not in gone)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents"))
