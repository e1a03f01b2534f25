"""SentencePiece encoding and decoding as a weighted finite-state transducer.

compile_model() builds three machines from a .model file:
- the normaliser: identity, one dummy space in front of a non-empty text, spaces to U+2581;
- the piece lattice: an arc for every piece that matches at a position, and an arc of byte pieces for a character that
  is no piece (byte fallback);
- a piece-pair acceptor: for a BPE model the arc from piece a to piece b costs nothing if merging the symbols of a + b
  keeps the boundary between them, and is infinite otherwise. The states are the last pieces. A sequence all of whose
  neighbours pass is exactly what the merges give; for a unigram model all pairs pass and arcs cost the negated scores.
encode() composes a text with them and takes the shortest path in the tropical semiring, left to right, in time linear in
the text. No piece of the supported models holds U+2581 after another character, so the lattice has a single state between
words: each word is composed on its own and its path is remembered in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import chunks, load

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words remembered by each Python worker, and the longest that is.
MEMO, MEMO_CHARS = 600_000, 48
_FAR, _BYTES = float("inf"), 1e6


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Fst:
    """Compiled machines. trie: characters to nodes, a piece's id under the empty string; costs: of the arcs; byte_ids: of the 256 byte pieces."""

    trie: dict
    costs: list[float]
    names: list[str]
    pieces: list[bytes]
    byte_ids: list[int]
    bpe: bool
    dummy: bool
    unknown: int
    units: re.Pattern
    rank: dict[str, float] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)

    def merges(self, text: str) -> list[str]:
        """The symbols that merging the best-ranked neighbours, leftmost first, leaves of a short text."""
        symbols = list(text)
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def passes(self, a: int, b: int) -> bool:
        """The pair acceptor's arc from piece a to piece b."""
        if len(self.pairs) >= 4 * MEMO:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        ok = self.pairs[a << 32 | b] = self.merges(x + y) == [x, y]
        return ok

    def path(self, unit: str) -> bytes:
        """Little-endian 32-bit ids of the shortest path over a normalised unit."""
        n, trie, costs, bpe, pairs = len(unit), self.trie, self.costs, self.bpe, self.pairs
        # For each place: the best cost, the start of the last piece, and that piece's id (-1 where a byte arc ends).
        best = [_FAR] * (n + 1)
        came, last = [-1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            cost = best[i]
            if cost == _FAR:
                continue
            before, node = last[i], trie
            key = before << 32
            for j in range(i, n):
                node = node.get(unit[j])
                if node is None:
                    break
                piece = node.get("")
                if piece is None or cost + costs[piece] >= best[j + 1]:
                    continue
                if bpe and before >= 0:
                    ok = pairs.get(key | piece)
                    if not (self.passes(before, piece) if ok is None else ok):
                        continue
                best[j + 1], came[j + 1], last[j + 1] = cost + costs[piece], i, piece
            if cost + _BYTES < best[i + 1] and "" not in trie.get(unit[i], ()):
                best[i + 1], came[i + 1], last[i + 1] = cost + _BYTES, i, -1
        out: list[int] = []
        j = n
        while j > 0:
            i = came[j]
            if last[j] >= 0:
                out.append(last[j])
            elif self.byte_ids:
                out.extend(self.byte_ids[x] for x in reversed(unit[i:j].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            j = i
        out.reverse()
        return array("I", out).tobytes()

    def normalise(self, text: str) -> str:
        return ((" " if self.dummy else "") + text).replace(" ", SPACE) if text else ""

    def encode(self, text: str, memo: Memo) -> bytes:
        return b"".join([memo[u] for u in self.units.findall(self.normalise(text))])

    def decode(self, ids: bytes) -> str:
        """The text of 32-bit ids: pieces joined, byte pieces as bytes, U+2581 as space, without the dummy space."""
        pieces = self.pieces
        data = b"".join([pieces[x] for x in memoryview(ids).cast("I")]).decode("utf-8", "replace").replace(SPACE, " ")
        return data[1:] if self.dummy and data[:1] == " " else data


class Memo(dict):
    """unit to path; emptied when full, so that a worker's memory is bounded."""

    def __init__(self, fst: Fst):
        super().__init__()
        self.fst = fst

    def __missing__(self, unit: str) -> bytes:
        path = self.fst.path(unit)
        if len(unit) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[unit] = path
        return path


_COMPILED: dict[str, tuple[Fst, Memo]] = {}


def compile_model(path: str) -> tuple[Fst, Memo]:
    """Compiles a model once in each process."""
    if path in _COMPILED:
        return _COMPILED[path]
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in model.pieces):
        raise ValueError("only models with the identity normaliser and no user-defined pieces are supported")
    bpe = model.trainer_spec.model_type == 2
    normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
    byte_ids = [i for i, p in enumerate(model.pieces) if p.type == 6]
    if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
        raise ValueError("a piece holds a space after another character")
    pieces = [p.piece.encode() if p.type != 6 else bytes([int(p.piece[1:-1], 16)]) for p in model.pieces]
    for i, p in enumerate(model.pieces):
        if p.type in (2, 3):
            pieces[i] = b"" if p.type == 3 else " ⁇ ".encode()
    # A newline that is part of no piece ends a unit too: fewer distinct units.
    line = not any("\n" in p for _, p, _ in normal)
    units = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if line else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    names = [p.piece for p in model.pieces]
    fst = Fst({}, [0.0] * len(names), names, pieces, byte_ids, bpe, norm.add_dummy_prefix, model.trainer_spec.unk_id, units, {p: s for _, p, s in normal})
    for i, p, score in normal:
        if not bpe or len(p) == 1 or fst.merges(p) == [p]:  # a piece that merges never make has no arc
            fst.costs[i] = 0.0 if bpe else -score
            node = fst.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
    _COMPILED[path] = (fst, Memo(fst))
    return _COMPILED[path]


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_byte_pieces (by byte fallback), ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, round_trip; with_ids adds ids and decoded.

    Null text counts as empty and has no tokens. round_trip: the decoded text equals the input, U+2581 read as a space.
    Whole texts are encoded, however long; of equally cheap paths the one with the longest last piece wins, as the pair
    acceptor leaves only one. Rows that repeat an identifier each get their result, null identifiers stay null; other columns
    aren't read. An empty table gives no rows.
    """
    path = path or model_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        fst, memo = compile_model(path)
        is_byte = np.zeros(len(fst.pieces) + 1, bool)
        is_byte[fst.byte_ids] = True
        for b in chunks(batches, 1 << 20):
            rows = []
            for text in b.column("text").to_pylist():
                text = text or ""
                ids = fst.encode(text, memo)
                decoded = fst.decode(ids)
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text or decoded == text.replace(SPACE, " "), *((memoryview(ids).cast("I").tolist(), decoded) if with_ids else ())))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), *((pa.list_(pa.int32()), pa.string()) if with_ids else ())]
            names = ["n_tokens", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip", *(("ids", "decoded") if with_ids else ())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_byte_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>, decoded string" * with_ids)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_decode(load(spark, sf_dir, "documents"))
