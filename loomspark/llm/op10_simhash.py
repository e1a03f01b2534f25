"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is three segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
(23, 12, 7), zeros filled in. decode() names the one codeword within 3 bits. A segment's primary key is its own codeword;
its probe keys are the codewords of all words within 1 bit (1 to 6 of them). If two segments differ in at most 1 bit, the
primary key of one is among the probe keys of the other.

Of 3 or fewer differing bits over three segments, the two segments with fewest have at most 1 each, and either one of them
has none or all three have exactly 1. So fingerprints that link share one of these keys:
- (exact segment i, codeword of segment j), for the six ordered pairs: primary on one side, probes on the other;
- (codewords of all three): primary of the first and probes of the others on one side, the converse on the other.
Ids that share a key are verified by counting differing bits, in blocks where a key has many. Equal fingerprints are one item from the start.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import colliding, linked
from .textops import chunks, cut, load, words_of

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # shift, bits
_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code
_TABLES: list[np.ndarray] = []


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for i in range(22, 10, -1):
        v ^= np.where((v >> i) & 1, _GENERATOR << (i - 11), 0)
    return v


def _tables() -> list[np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error pattern (0 to 3 bits) of each of the 2,048 remainders."""
    if not _TABLES:
        bits = [1 << i for i in range(23)]
        errors = np.array(sorted({a | b | c for a in [0, *bits] for b in [0, *bits] for c in [0, *bits]}), np.int64)
        by = np.zeros(2048, np.int64)
        by[_remainder(errors)] = errors
        _TABLES.extend([_remainder(np.arange(4096)), _remainder(np.arange(2048) << 12), by])
    return _TABLES


def decode(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (v ^ error[low[v & 4095] ^ high[v >> 12]]) >> 11


def _probes(segment: np.ndarray, bits: int) -> np.ndarray:
    """decode() of each word and its `bits` neighbours, sorted; repeats are -1."""
    flips = np.array([0, *(1 << i for i in range(bits))], np.int64)
    keys = np.sort(decode(segment[:, None] ^ flips[None, :]), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    out = -np.sort(-keys, axis=1)
    return out[:, : max(1, int((out >= 0).sum(axis=1).max(initial=1)))]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): indices into prints, and keys (int64), each pair once."""
    seg = [((prints >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    prime = [decode(x) for x in seg]
    probe = [_probes(x, b) for x, (_, b) in zip(seg, SEGMENTS, strict=True)]
    at, keys = [], []

    def add(key: np.ndarray, ok: np.ndarray) -> None:
        i = np.nonzero(ok)
        at.append(i[0])
        keys.append(key[i])

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                head = (np.int64(kind) << 36) | (seg[i] << 12)
                # The primary key of a segment is among its probes, so both sides' keys are the probes.
                add(head[:, None] | np.maximum(probe[j], 0), probe[j] >= 0)
                kind += 1
    head = np.int64(6) << 36
    a, b = probe[1][:, :, None], probe[2][:, None, :]
    add(head | (prime[0][:, None, None] << 24) | (np.maximum(a, 0) << 12) | np.maximum(b, 0), (a >= 0) & (b >= 0))
    # The other side's keys; the one that is also on the first side is left out.
    other = (probe[0] >= 0) & (probe[0] != prime[0][:, None])
    add(head | (np.maximum(probe[0], 0) << 24) | (prime[1] << 12)[:, None] | prime[2][:, None], other)
    return np.concatenate(at), np.concatenate(keys)


_PRIMES = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many stretches of a byte array that has eight bytes more than they need; stretches of one length are hashed together."""
    p1, p2, p3, p4, p5 = _PRIMES
    word = lambda at, kind: np.ndarray((len(data) - 7,), kind, data, 0, (1,))[at].astype(np.uint64)
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    mixed = lambda acc, at: turn(acc + word(at, "<u8") * p2, 31) * p1
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    none, seed = np.uint64(0), np.uint64(seed)
    for lo, hi in itertools.pairwise(edges.tolist()):
        rows = order[lo:hi]
        at, length = starts[rows], int(lengths[rows[0]])
        end, left = at + length, length
        if length >= 32:
            acc = [np.full(len(rows), x, np.uint64) for x in (seed + p1 + p2, seed + p2, seed, seed - p1)]
            while left >= 32:
                acc = [mixed(a, at + 8 * k) for k, a in enumerate(acc)]
                at, left = at + 32, left - 32
            h = turn(acc[0], 1) + turn(acc[1], 7) + turn(acc[2], 12) + turn(acc[3], 18)
            for a in acc:
                h = (h ^ (turn(a * p2, 31) * p1)) * p1 + p4
        else:
            h = np.full(len(rows), seed + p5, np.uint64)
        h = h + np.uint64(length)
        while left >= 8:
            h = turn(h ^ mixed(none, at), 27) * p1 + p4
            at, left = at + 8, left - 8
        if left >= 4:
            h = turn(h ^ (word(at, "<u4") * p1), 23) * p2 + p3
            at, left = at + 4, left - 4
        for k in range(left, 0, -1):
            h = turn(h ^ (data[end - k].astype(np.uint64) * p5), 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """Fingerprints (uint64) of a chunk of texts."""
    w = words_of(texts)
    n = len(w.first) - 1
    # One space between words: shingles then are slices. Documents are apart by a newline.
    lengths = w.ends - w.starts
    to = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
    keep = np.ones(int(to[-1]), bool)
    keep[to[1:] - 1] = False
    norm = np.full(int(to[-1]), 32, np.uint8)
    inside = np.zeros(len(w.buf) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    norm[keep] = w.buf[np.cumsum(inside[:-1]).astype(bool)] if len(w.buf) else norm[keep]
    owner, last = w.owner(), np.repeat(w.first[1:], np.diff(w.first))
    i = np.arange(len(w.starts))
    begin = (i + 3 <= last) | (i == w.first[:-1][owner])  # a text of fewer words is one shingle
    i = i[begin]
    a, b = to[i], to[np.minimum(i + 3, last[i])] - 1
    with np.errstate(over="ignore"):
        h = xxh64(np.append(norm, np.zeros(8, np.uint8)), a, b - a, 42)
    out = np.zeros(n, np.uint64)
    own = owner[i]
    first = np.searchsorted(own, np.arange(n + 1))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for lo in range(0, 64, 8):  # eight bits at a time bound the memory
            ones = np.unpackbits(((h >> np.uint64(lo)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little").astype(np.int32)
            sums = np.add.reduceat(ones, first[some], axis=0)
            set_ = (2 * sums > np.diff(first)[some][:, None]).astype(np.uint64)
            for k in range(8):
                out[some] |= set_[:, k] << np.uint64(lo + k)
    return out


def fingerprint(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (bigint) for each row of docs (doc_id, text), and the columns named in keep."""
    cols = [c for c in keep if c != "doc_id"]

    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints_of(b.column("text")).view(np.int64)), *(b.column(c) for c in cols)], ["doc_id", "fp", *cols])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *cols).mapInArrow(run, ", ".join([f"doc_id {kind}", "fp bigint", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in cols)]))


def print_keys(prints: DataFrame) -> DataFrame:
    """key, id for distinct fingerprints (fp)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                fp = batch.column(0)[lo : lo + 4096].to_numpy(zero_copy_only=False).astype(np.int64)
                at, keys = golay_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at])], ["key", "id"])

    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.select("fp").repartition(parts).mapInArrow(run, "key bigint, id bigint")  # each print becomes about 60 keys


#: Six parts of a fingerprint, as masks.
PARTS = [((1 << b) - 1) << s for s, b in ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer_keys(rows: DataFrame) -> DataFrame:
    """Rows (key, id, component) under 20 finer keys each: 3 or fewer differing bits leave three of six parts equal."""
    masks = [_signed(a | b | c) for a, b, c in itertools.combinations(PARTS, 3)]
    keys = F.array(*[F.xxhash64("key", F.lit(i), F.col("id").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])
    return rows.select(F.explode(keys).alias("key"), "id", "component")


def simhash_components(docs: DataFrame, bits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint, component_id (and columns named in keep); one row per input row.

    Null and empty texts have fingerprint zero and link like any other. component_id is the smallest identifier reachable;
    null identifiers are passed over, and a component without any other has none. Whole texts are read, however long; equal
    fingerprints are one item, and a bit that exactly half the shingles set is 0. Rows that repeat an identifier each get the
    result of their own text. Other columns are read only if named in keep. An empty table gives no rows. bits is at most 3.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the keys find pairs of at most 3 differing bits")
    rows = cut(fingerprint(docs.select("doc_id", "text", *keep), keep), "prints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    near = lambda pairs: pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    close = lambda a, b: np.bitwise_count((a ^ b).view(np.uint64)) <= bits
    parts = linked(colliding(print_keys(distinct), "keys"), near, close, finer_keys, "simhash")
    classes = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = classes.join(ids, "component").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(by_print, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"))
