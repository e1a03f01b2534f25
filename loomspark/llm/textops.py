"""Shared text helpers: vectorised word splitting and hashing over Arrow batches, and native column builders.

A chunk of texts is held as one byte array with word offsets, so that cost per byte is a few numpy passes and no
Python object is made per word.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, forget, work_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64
_P = 0x9E3779B97F4A7C55 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[str, np.ndarray] = {}


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        for key, p in (("up", _P), ("down", _P_INV)):
            x = np.full(size, p, _U)
            x[0] = 1
            _POWERS[key] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """buf: lower-cased (A-Z) bytes of a chunk; starts, ends: of each word; first: index of each document's first word, and the count."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.buf)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum((self.buf.astype(_U) + _U(1)) * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(_U) * _U(0xFF51AFD7ED558CCD))

    def owner(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: pa.Array) -> Words:
    """Splits at [\\x20\\x09-\\x0D]+; null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = (offsets - offsets[0]) if len(texts) else np.zeros(1, np.int64)
    buf = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
    inside = ~_SPACE[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    if len(buf):
        before[offsets[:-1][offsets[:-1] < len(buf)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(batches, size: int = 1 << 21):
    """Record batches cut into slices of about `size` bytes of column 'text', so that a task's memory doesn't follow the batch size."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(np.cumsum(lengths) // size, prepend=0)) + 1 if len(lengths) else []
        for a, b in itertools.pairwise([0, *[int(e) for e in edges if e < len(lengths)], len(lengths)]):
            if b > a:
                yield batch.slice(a, b - a)


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.zeros(n, _U)
    for j in range(k):
        total = total * _U(0x100000001B3) + h[j : j + n]
        total ^= total >> _U(31)
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= last)
    return mix(total[at]), at
