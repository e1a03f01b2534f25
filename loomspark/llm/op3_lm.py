"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne, 2007).

Training counts every token, token after token, and token in a class of texts (the `lang` column of training rows). Each
count c is stored as its level 1 + floor(log2 c): the filter holds the pairs (n-gram, 1) to (n-gram, level). A count is read
back by probing level after level until a probe fails, so it is never too low.

The filter is made where the counts are merged: each bucket of the n-gram hashes has a slice of bits, sized by its own
entries (8 bits each, so that the rate of false hits is about 0.024 at any size). A level stands for the mean of the counts
that have it, so that read counts sum to the true ones.

P(text) = sum over classes k of pi_k * product over tokens of P_k(w | v),
P_k(w | v) = l * c(v w) / (c(v) + f V) + (1 - l) * ((1 - m) * c(k, w) / (N_k + f V) + m * (c(w) + 0.5) / (N + 0.5 * (V + 1))),
where counts but the last come from the filter and f is its rate of false hits: f V is what false hits add to the counts read
for one context, so that each term's expected sum over all words is one. l = LAMBDA c(v) / (c(v) + f V), less where false
hits prevail. Every factor depends on the text and the model alone. Classes are mixed within the text's probability; the
class column of a scored row isn't read. Each lang is a class; beyond max_classes of them, those with fewest rows form one
class of their own together, which bounds the work for a token.

The last term is the exact unigram base. Filter and exact counts are broadcast while they have at most max_bits bits and
max_vocab entries. Beyond either, texts are scored in chunks: the n-grams and tokens of a chunk, each once, are shuffled to
their buckets' slices and the levels and counts come back to the chunk, with the same results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import chunks, cut, load, mix, words_of

_U = np.uint64
END, BEGIN = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
FOLDS, HELD_OUT = 5, 1
UNIGRAM, BIGRAM, CLASS, TOTALS = 0, 1, 2, 3
HASHES = 4
LEVELS = 64
LAMBDA, MU = 0.2, 0.15
FLUSH = 1 << 21
#: Training text for each bucket, about: bounds what one task merges or is asked for.
BUCKET_BYTES = 1 << 26
#: The class of all langs beyond the largest ones.
REST = "\0rest"
SCORES = ["n_tokens", "n_known", "base_score", "score"]


def _salted(kind: int, keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _U(0x9E3779B97F4A7C15 * (kind + 1) & 0xFFFFFFFFFFFFFFFF))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x100000001B3) + (b ^ (b >> _U(31))))


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk (words, then one end per text), the hash before each, and each text's first token."""
    w = words_of(texts)
    tokens = np.insert(w.hashes(), w.first[1:], END)
    first = w.first + np.arange(len(w.first))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1][: len(first) - 1]] = BEGIN
    return tokens, before, first


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _counted(classes: list[str], bits: int):
    """Partial counts of a task: rows (kind, bucket, keys, counts). Unigram keys are whole; of others 40 bits beyond the bucket's are kept."""

    def flush(parts):
        for kind, arrays in parts.items():
            if not arrays:
                continue
            keys, n = np.unique(np.concatenate(arrays), return_counts=True)
            arrays.clear()
            edges = np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1))
            for b in np.flatnonzero(np.diff(edges)):
                k = keys[edges[b] : edges[b + 1]]
                if kind != UNIGRAM:
                    k = np.ascontiguousarray(((k << _U(bits)) >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5])
                yield kind, int(b), k.tobytes(), n[edges[b] : edges[b + 1]].astype(np.uint32).tobytes()

    def run(batches):
        parts = {UNIGRAM: [], BIGRAM: [], CLASS: []}
        size, totals = 0, np.zeros(len(classes), np.int64)
        salts = np.array([hash_class(c) for c in classes], _U)
        place, rest = {c: i for i, c in enumerate(classes)}, len(classes) - 1  # only REST, the last, has langs that aren't named
        for batch in chunks(batches):
            tokens, before, first = token_stream(batch.column("text"))
            kinds = np.array([place.get(c, rest) for c in batch.column("cls").to_pylist()], np.int64)
            parts[UNIGRAM].append(tokens)
            parts[BIGRAM].append(_salted(BIGRAM, _pair(before, tokens)))
            parts[CLASS].append(_salted(CLASS, _pair(np.repeat(salts[kinds], np.diff(first)), tokens)))
            totals += np.bincount(kinds, np.diff(first), len(classes)).astype(np.int64)
            size += len(tokens)
            if size >= FLUSH:
                yield from emit(flush(parts))
                size = 0
        yield from emit(flush(parts))
        yield from emit([(TOTALS, 0, b"", totals.tobytes())])

    def emit(rows):
        for kind, bucket, k, n in rows:
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([k], pa.binary()), pa.array([n], pa.binary())], ["kind", "bucket", "keys", "counts"])

    return run


def hash_class(name: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _positions(rest: np.ndarray, level: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = mix(rest + _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return a, (a >> _U(33)) | _U(1)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1]


def _slice(entries: list[tuple[np.ndarray, np.ndarray]], most_bits: int | None = None, per_entry: float = 8.0) -> bytes:
    """Bits of the filter for (40-bit rests, levels); as many as the entries need unless most_bits is given."""
    n = sum(int(lv.sum()) for _, lv in entries)
    m = int(max(64, n * per_entry))
    m = (m if most_bits is None else min(most_bits, m)) // 8 * 8
    bits = np.zeros(m, bool)
    for rest, lv in entries:
        for level in range(1, int(lv.max(initial=0)) + 1):
            a, step = _positions(rest[lv >= level], level, None)
            for i in range(HASHES):
                bits[((a + _U(i) * step) % _U(m)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _reduced():
    """Merges a bucket: one row with the vocabulary part and the filter's slice."""

    def run(key, pdf):
        import pandas as pd

        entries, vocab, counts, totals, levels = [], np.zeros(0, _U), np.zeros(0, np.int64), b"", np.zeros((2, LEVELS, 2), np.int64)
        for kind, part in pdf.groupby("kind"):
            if kind == TOTALS:
                totals = np.sum([np.frombuffer(x, np.int64) for x in part["counts"]], axis=0).tobytes()
                continue
            n = np.frombuffer(b"".join(part["counts"]), np.uint32).astype(np.int64)
            if kind == UNIGRAM:
                vocab, counts = _merge(np.frombuffer(b"".join(part["keys"]), _U), n)
            else:
                wide = np.zeros((len(n), 8), np.uint8)
                wide[:, :5] = np.frombuffer(b"".join(part["keys"]), np.uint8).reshape(-1, 5)
                rest, n = _merge(wide.view(_U).ravel(), n)
                entries.append((rest, levels_of(n)))
                np.add.at(levels[int(kind) - BIGRAM], entries[-1][1], np.stack([np.ones_like(n), n], axis=1))
        made = _slice(entries)
        ones = int(np.bitwise_count(np.frombuffer(made, np.uint8)).sum(dtype=np.int64))
        return pd.DataFrame({"bucket": [int(key[0])], "keys": [vocab.tobytes()], "counts": [counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64).tobytes()], "n": [len(vocab)], "total": [int(counts.sum())], "bits": [made], "ones": [ones], "size": [len(made)], "totals": [totals], "levels": [levels.tobytes()]})

    return run


@dataclass
class Model:
    """What scoring needs; every field is bounded by max_vocab, max_bits or the number of classes. Without vocab, filter and counts stay in the merged table."""

    bits: int
    filter: np.ndarray
    sizes: np.ndarray
    vocab: np.ndarray | None
    counts: np.ndarray | None
    total: int
    distinct: int
    classes: list[str]
    class_tokens: list[int]
    class_docs: list[int]
    means: np.ndarray | None = None
    rate: float | None = None

    def count(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Counts that the levels of salted keys of one kind (BIGRAM or CLASS) stand for."""
        return self.mean(self.level(keys), kind)

    def mean(self, levels: np.ndarray, kind: int) -> np.ndarray:
        return self.means[kind - BIGRAM][np.minimum(levels, LEVELS - 1)]

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Exact counts of tokens."""
        if not len(self.vocab):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, tokens), len(self.vocab) - 1)
        return np.where(self.vocab[at] == tokens, self.counts[at], 0).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes."""
        starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        bucket = (keys >> _U(64 - self.bits)).astype(np.int64)
        rest, m, base = (keys << _U(self.bits)) >> _U(24), (self.sizes * 8).astype(_U)[bucket], starts[bucket]
        out, alive, level = np.zeros(len(keys), np.int64), np.flatnonzero(m > 0), 0
        while len(alive) and level < LEVELS - 1:
            level += 1
            a, step = _positions(rest[alive], level, None)
            hit = np.arange(len(alive))
            for i in range(HASHES):
                at = alive[hit]
                p = ((a[hit] + _U(i) * step[hit]) % m[at]).astype(np.int64)
                hit = hit[(self.filter[base[at] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1]
            alive = alive[hit]
            out[alive] = level
        return out

    def false_rate(self) -> float:
        return self.rate if self.rate is not None else (int(np.bitwise_count(self.filter).sum(dtype=np.int64)) / max(1, len(self.filter) * 8)) ** HASHES


def mean_counts(levels: np.ndarray) -> np.ndarray:
    """The count each level stands for, from (entries, sum of counts); a level without entries takes its range's middle."""
    middle = np.append(0.0, 1.5 * 2.0 ** np.arange(LEVELS - 1) - 0.5)
    return np.where(levels[..., 0] > 0, levels[..., 1] / np.maximum(1, levels[..., 0]), middle)


def train(docs: DataFrame, max_bits: int = 1 << 29, max_vocab: int = 8_000_000, max_classes: int = 64) -> tuple[Model, DataFrame]:
    """The model of all rows of docs (doc_id, text, and lang if there), and the merged table in the shared folder."""
    spark = docs.sparkSession
    cls = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    typed = docs.select(F.col("text"), cls.alias("cls"))
    top = typed.groupBy("cls").count().orderBy(F.desc("count"), "cls").limit(max_classes + 1).collect()
    known = {r["cls"]: r["count"] for r in top[:max_classes]}
    # As many buckets as keep what one task merges the same at any size.
    size, rows = typed.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count("*")).first()
    if len(top) > max_classes:
        known[REST] = rows - sum(known.values())
    classes = list(known) or [""]
    bits = max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (size // BUCKET_BYTES).bit_length())
    parts = typed.mapInArrow(_counted(classes, bits), "kind int, bucket int, keys binary, counts binary")
    merged = cut(parts.groupBy("bucket").applyInPandas(_reduced(), "bucket int, keys binary, counts binary, n bigint, total bigint, bits binary, ones bigint, size bigint, totals binary, levels binary"), "lm")
    sums = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "total", "ones", "size")]).first()
    slices = [np.zeros(0, np.uint8)] * (1 << bits)
    vocab, counts, totals = [None] * (1 << bits), [None] * (1 << bits), [0] * len(classes)
    small, levels = sums[0] <= max_vocab and sums[3] * 8 <= max_bits, np.zeros((2, LEVELS, 2), np.int64)
    for r in merged.select("bucket", "totals", "levels", *(["bits", "keys", "counts"] if small else [])).toLocalIterator():
        levels += np.frombuffer(r["levels"], np.int64).reshape(levels.shape)
        if r["totals"]:
            totals = np.frombuffer(r["totals"], np.int64).tolist()
        if small:
            slices[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
            vocab[r["bucket"]] = np.frombuffer(r["keys"], _U)
            counts[r["bucket"]] = _counts_of(r["counts"], len(vocab[r["bucket"]]))
    joined = lambda x, kind: np.concatenate([a for a in x if a is not None] or [np.zeros(0, kind)])
    n_docs = [known.get(c, 0) for c in classes]
    sizes = np.array([len(x) for x in slices], np.int64)
    rate = (sums[2] / max(1, sums[3] * 8)) ** HASHES
    return Model(bits, np.concatenate(slices), sizes, joined(vocab, _U) if small else None, joined(counts, np.uint32) if small else None, int(sums[1]), int(sums[0]), classes, totals, n_docs, mean_counts(levels), rate), merged


def _counts_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.int64)


class _Asked:
    """What a chunk of texts reads from the model: exact counts of its distinct tokens, levels of their classes and of its distinct bigrams."""

    def __init__(self, model: Model, texts: pa.Array):
        tokens, before, self.first = token_stream(texts)
        self.distinct, self.back = np.unique(tokens, return_inverse=True)
        salts = np.array([hash_class(c) for c in model.classes], _U)
        self.classes = np.concatenate([_salted(CLASS, _pair(np.full(len(self.distinct), s, _U), self.distinct)) for s in salts])
        self.bigrams, self.at = np.unique(_salted(BIGRAM, _pair(before, tokens)), return_inverse=True)


def _likelihood(model: Model, asked: _Asked, class_levels: np.ndarray, bigram_levels: np.ndarray, c: np.ndarray) -> list[pa.Array]:
    """n_tokens, n_known, base_score and score of a chunk's texts."""
    first, back = asked.first, asked.back
    unseen = model.total + 0.5 * (model.distinct + 1)
    noise = model.false_rate() * model.distinct
    share = np.array(model.class_docs, float) + 1
    prior, size = np.log10(share / share.sum()), np.array(model.class_tokens, float)
    by_class = model.mean(class_levels, CLASS).reshape(len(size), -1)
    context = by_class.sum(axis=0)
    base = (c + 0.5) / unseen
    # c(v): of the token before, over all classes; BEGIN stands before one token of each text.
    c1 = np.empty(len(back))
    c1[1:] = context[back[:-1]]
    c1[first[:-1]] = max(1, sum(model.class_docs))
    reads = np.maximum(c1 + noise, 1.0)
    lam = LAMBDA * c1 / reads
    ratio = np.minimum(1.0, model.mean(bigram_levels, BIGRAM)[asked.at] / reads)
    sums = np.stack([np.add.reduceat(np.log10(lam * ratio + (1 - lam) * ((1 - MU) * np.minimum(1.0, by_class[k][back] / max(1.0, size[k] + noise)) + MU * base[back])), first[:-1]) + prior[k] for k in range(len(size))])
    top = sums.max(axis=0)
    score = np.minimum(0.0, top + np.log10((10.0 ** (sums - top)).sum(axis=0)))
    return [pa.array(np.diff(first), pa.int64()), pa.array(np.add.reduceat((c > 0)[back].astype(np.int64), first[:-1])), pa.array(np.add.reduceat(np.log10(base)[back], first[:-1])), pa.array(score)]


def _scored(shared):
    def run(batches):
        model: Model = shared.value
        for batch in chunks(batches):
            asked = _Asked(model, batch.column("text"))
            cols = _likelihood(model, asked, model.level(asked.classes), model.level(asked.bigrams), model.exact(asked.distinct))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], ["row", *SCORES])

    return run


def score(docs: DataFrame, max_bits: int = 1 << 29, max_vocab: int = 8_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Learns from rows that aren't held out. Null text counts as empty: one end token. Whole texts are read, however long. A
    null identifier hashes as an empty text, a null lang counts as an empty one. Rows that repeat an identifier are each
    scored and each counted, equal texts alike. Columns other than doc_id, text and lang aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(["lang"] if "lang" in docs.columns else []))
    train_docs = kept.filter(~held_out(F.col("doc_id")))
    model, merged = train(train_docs, max_bits, max_vocab)
    shared = spark.sparkContext.broadcast(model)
    row = F.struct(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},held_out:boolean>"
    rows = kept.select(row.alias("row"), "text")
    scores = "n_tokens bigint, n_known bigint, base_score double, score double"
    out = rows.mapInArrow(_scored(shared), f"row {kind}, {scores}") if model.vocab is not None else _shuffled(rows, merged, shared, kind, scores)
    return out.select("row.*", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def _shuffled(rows: DataFrame, merged: DataFrame, shared, kind: str, scores: str) -> DataFrame:
    """Scores of rows (row, text) by a model that isn't broadcast: a chunk's n-grams and tokens go to their buckets, and what they read comes back."""

    def packed(batches):
        import uuid

        for b in chunks(batches):
            whole = pa.array([0, len(b)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(whole, b.column("row")), pa.ListArray.from_arrays(whole, b.column("text"))], ["chunk", "rows", "texts"])

    def texts_of(column, n):
        return column[n].values

    def ask(batches):
        model = shared.value
        for b in batches:
            for n, chunk in enumerate(b.column("chunk")):
                asked = _Asked(model, texts_of(b.column("texts"), n))
                keys = np.sort(np.concatenate([asked.classes, asked.bigrams]))
                rest = np.ascontiguousarray(((keys << _U(model.bits)) >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5])
                buckets = np.arange((1 << model.bits) + 1)
                at, to = (np.searchsorted(x >> _U(64 - model.bits), buckets).tolist() for x in (keys, asked.distinct))
                some = [i for i in range(1 << model.bits) if at[i] < at[i + 1] or to[i] < to[i + 1]]
                cols = [pa.array([chunk.as_py()] * len(some), pa.string()), pa.array(some, pa.int32())]
                cols += [pa.array([x[e[i] : e[i + 1]].tobytes() for i in some], pa.binary()) for x, e in ((rest, at), (asked.distinct, to))]
                yield pa.RecordBatch.from_arrays(cols, ["chunk", "bucket", "ngrams", "tokens"])

    def answer(key, asked, slices):
        model, bucket, cols = shared.value, key[0].as_py(), []
        if not len(slices):  # no training n-gram fell into the bucket
            one = Model(model.bits, np.zeros(0, np.uint8), np.zeros(1 << model.bits, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), 0, 0, [], [], [])
        else:
            r = slices.slice(0, 1).to_pylist()[0]
            sizes = np.zeros(1 << model.bits, np.int64)
            sizes[bucket] = len(r["bits"])
            vocab = np.frombuffer(r["keys"], _U)
            one = Model(model.bits, np.frombuffer(r["bits"], np.uint8), sizes, vocab, _counts_of(r["counts"], len(vocab)), 0, 0, [], [], [])
        for ngrams, tokens in zip(asked.column("ngrams"), asked.column("tokens"), strict=True):
            wide = np.zeros((len(ngrams.as_buffer()) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(ngrams.as_buffer(), np.uint8).reshape(-1, 5)
            keys = (_U(bucket) << _U(64 - model.bits)) | ((wide.view(_U).ravel() << _U(24)) >> _U(model.bits))
            cols.append((one.level(keys).astype(np.uint8).tobytes(), one.exact(np.frombuffer(tokens.as_buffer(), _U)).tobytes()))
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array([c[0] for c in cols], pa.binary()), pa.array([c[1] for c in cols], pa.binary())], names=["chunk", "bucket", "levels", "counts"])

    def read(key, texts, answers):
        model = shared.value
        asked = _Asked(model, texts_of(texts.column("texts"), 0))
        answers = answers.sort_by("bucket")
        levels, counts = (np.frombuffer(b"".join(answers.column(c).to_pylist()), t) for c, t in (("levels", np.uint8), ("counts", np.int64)))
        keys = np.concatenate([asked.classes, asked.bigrams])
        order = np.argsort(keys, kind="stable")
        back = np.empty(len(keys), np.int64)
        back[order] = levels
        n = len(asked.classes)
        return pa.table([texts.column("rows")[0].values, *_likelihood(model, asked, back[:n], back[n:], counts)], names=["row", *SCORES])

    dealt = cut(rows.mapInArrow(packed, f"chunk string, rows array<{kind}>, texts array<string>"), "lm-chunks")
    asked = dealt.select("chunk", "texts").mapInArrow(ask, "chunk string, bucket int, ngrams binary, tokens binary")
    slices = merged.select("bucket", "bits", "keys", "counts")
    answers = asked.groupBy("bucket").cogroup(slices.groupBy("bucket")).applyInArrow(answer, "chunk string, bucket int, levels binary, counts binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(read, f"row {kind}, {scores}")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
