"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, reported speech, or other. Insult stems and their weights are
learned from a bounded sample of labelled rows: a whole word or a beginning of 3 to 8 letters that stands in many toxic and
hardly any other texts, after several different words (so that copies of one text teach nothing of their usual words). The
other classes are short fixed lists in four languages.

The grammar is a composition of weighted transducers over these symbols, in the tropical semiring with evidence as negative
costs. The lexicon reads a word as its class, an insult or threat at minus its weight, or as any other word at no cost. The
negation machine charges an insult or threat within three words after a negation, the reported-speech machine one after a
verb of saying. The clause machine accepts: clauses without a match; insults among other words; an insult that is all of its
clause, at a charge; and, guessed from the start and granted only if a target stands anywhere in the clause, insults with a
gain, and threats. A clause's evidence is its cheapest path's, never below zero; a text's is the total of its clauses. A
logistic curve fitted on the sample, with the threshold where the sample is split best, turns it into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold, labelled
from .textops import chunks, cut, load

FOLDS, HELD_OUT, LABEL = 3, 1, "toxic"
#: Bound of the sample that is learned from; it bounds what is collected of its stems.
MOST_LABELLED = 8000
#: Letters of a stem, and different words that it must stand after.
SHORTEST, LONGEST, LEAST_CONTEXTS = 3, 8, 5
MEMO = 200_000
THRESHOLD = 0.7
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
LEXICON = {
    THREAT: "kill murder hurt destroy shoot stab umbringen töten erschießen tuer frapper détruire matar golpear destruir".split(),
    TARGET: "you your yours he she they them him her du dich dir ihr euch sie tu toi vous ils elles usted ustedes ellos ellas".split(),
    NEGATION: "not never isn't aren't wasn't don't nicht kein keine niemals pas jamais nunca jamás".split(),
    REPORT: "said says wrote quote quoted called reported sagte schrieb zitiert dit écrit cité dijo escribió citó".split(),
}
#: Weights of the machines' arcs and ends.
THREAT_WEIGHT, TARGET_GAIN, NEGATED, REPORTED, BARE = 2.0, 1.0, 2.5, 2.0, 1.5
NEGATION_REACH = 3
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
_EDGE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Classes(dict):
    """Raw word to (class, weight); a bounded memo."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.fixed = {w: (kind, THREAT_WEIGHT if kind == THREAT else 0.0) for kind, words in LEXICON.items() for w in words}

    def of(self, word: str) -> tuple[int, float] | None:
        found = max([self.stems.get("=" + word, 0.0), *(self.stems.get(word[:n], 0.0) for n in range(SHORTEST, min(LONGEST, len(word)) + 1))])
        return (INSULT, found) if found > 0 else self.fixed.get(word)

    def __missing__(self, raw: str) -> bool:
        """Whether a run of non-spaces holds a word of class insult or threat."""
        hit = any((c := self.of(w)) is not None and c[0] in (INSULT, THREAT) for w in _EDGE.findall(raw))
        if len(raw) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[raw] = hit
        return hit


@dataclass(frozen=True)
class Machine:
    """A weighted transducer over word classes; state 0 is the start. arcs: for each state, class to (class out, cost, next state); ends: states to costs."""

    arcs: list[dict[int, list[tuple[int, float, int]]]]
    ends: dict[int, float]


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that reads what a reads and writes what b makes of a's output; states are the pairs that can be reached."""
    number, todo = {(0, 0): 0}, [(0, 0)]
    arcs: list[dict[int, list[tuple[int, float, int]]]] = []
    ends: dict[int, float] = {}
    for here, (p, q) in enumerate(todo):
        arcs.append({})
        for kind, outs in a.arcs[p].items():
            for mid, cost, p2 in outs:
                for out, more, q2 in b.arcs[q].get(mid, ()):
                    if (p2, q2) not in number:
                        number[p2, q2] = len(todo)
                        todo.append((p2, q2))
                    arcs[here].setdefault(kind, []).append((out, cost + more, number[p2, q2]))
        if p in a.ends and q in b.ends:
            ends[here] = a.ends[p] + b.ends[q]
    return Machine(arcs, ends)


def negation_machine() -> Machine:
    """States: words that a negation still reaches."""
    arcs = []
    for left in range(NEGATION_REACH + 1):
        cost, after = (NEGATED if left else 0.0), max(0, left - 1)
        arcs.append({k: [(k, cost if k in (INSULT, THREAT) else 0.0, after)] for k in (OTHER, INSULT, THREAT, TARGET, REPORT)} | {NEGATION: [(OTHER, 0.0, NEGATION_REACH)]})
    return Machine(arcs, dict.fromkeys(range(NEGATION_REACH + 1), 0.0))


def report_machine() -> Machine:
    """States: whether a verb of saying was read."""
    arcs = [{k: [(k, REPORTED if said and k in (INSULT, THREAT) else 0.0, said)] for k in (OTHER, INSULT, THREAT, TARGET)} | {REPORT: [(OTHER, 0.0, 1)]} for said in (0, 1)]
    return Machine(arcs, {0: 0.0, 1: 0.0})


def clause_machine() -> Machine:
    """The patterns of a clause. A target is another word to the plain ones; the targeted ones (states 4 to 7) end only after a target and a match."""
    start, bare, words, among, free, aimed, match, both = range(8)
    plain = {start: {OTHER: words, TARGET: words, INSULT: bare}, bare: {OTHER: among, TARGET: among, INSULT: bare}, words: {OTHER: words, TARGET: words, INSULT: among}, among: {OTHER: among, TARGET: among, INSULT: among}}
    targeted = {start: (free, aimed, match), free: (free, aimed, match), aimed: (aimed, aimed, both), match: (match, both, match), both: (both, both, both)}
    arcs: list[dict[int, list[tuple[int, float, int]]]] = [{} for _ in range(8)]
    for state, to in plain.items():
        for kind, after in to.items():
            arcs[state].setdefault(kind, []).append((kind, 0.0, after))
    for state, (other, target, hit) in targeted.items():
        for kind, cost, after in ((OTHER, 0.0, other), (TARGET, 0.0, target), (INSULT, -TARGET_GAIN, hit), (THREAT, 0.0, hit)):
            arcs[state].setdefault(kind, []).append((kind, cost, after))
    return Machine(arcs, {start: 0.0, bare: BARE, words: 0.0, among: 0.0, both: 0.0})


GRAMMAR = compose(compose(negation_machine(), report_machine()), clause_machine())


def readings(kind: int, weight: float) -> tuple[tuple[int, float], ...]:
    """The lexicon's arcs for a word: its class, and for an insult or threat also any other word."""
    return ((kind, -weight), (OTHER, 0.0)) if kind in (INSULT, THREAT) else ((kind, 0.0),)


def clause_weight(symbols: list[tuple[int, float]], machine: Machine = GRAMMAR) -> float:
    """Evidence of a clause: minus the cost of the cheapest path of its words through the grammar, the best by state word after word."""
    costs = {0: 0.0}
    others = 0
    for kind, weight in symbols:
        others = others + 1 if kind == OTHER else 0
        if others > NEGATION_REACH + 1:  # any more other words change no state
            continue
        now: dict[int, float] = {}
        for state, cost in costs.items():
            for read, first in readings(kind, weight):
                for _, more, after in machine.arcs[state].get(read, ()):
                    total = cost + first + more
                    if total < now.get(after, np.inf):
                        now[after] = total
        costs = now
    return max(0.0, -min((cost + machine.ends[state] for state, cost in costs.items() if state in machine.ends), default=0.0))


def evidence(text: str, classes: Classes) -> float:
    """Total weight of a whole text's clauses."""
    lower = text.lower()
    if not any(map(classes.__getitem__, lower.split())):
        return 0.0
    total, clause = 0.0, []
    for token in _TOKEN.findall(lower):
        if token[0] in ".!?;:\n":
            if clause:
                total += clause_weight(clause)
                clause = []
        else:
            clause.append(classes.of(token) or (OTHER, 0.0))
    return total + clause_weight(clause)


@dataclass
class Grammar:
    stems: dict[str, float]
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(x) + self.offset, -30, 30)))


def _stems(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def _stems_in(batches):
    for b in chunks(batches):
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            stems = sorted({s for w in set(_EDGE.findall(text.lower())) for s in _stems(w)})
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([label] * len(stems), pa.int32())], ["stem", "label"])


def _contexts(stems: set[str]):
    def run(batches):
        for b in chunks(batches):
            for text in b.column("text").to_pylist():
                words = _EDGE.findall(text.lower())
                pairs = sorted({(s, before) for before, w in zip(["", *words], words, strict=False) for s in _stems(w) if s in stems})
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], ["stem", "before"])

    return run


def learn(sample: DataFrame, least: int = 5, purity: int = 10, contexts: int = LEAST_CONTEXTS) -> Grammar:
    """Stems and the logistic curve, from a bounded sample (text, label).

    A stem stands in `least` toxic texts (fewer if under 50 of the sample are toxic), in `purity` times as many as clean ones,
    and after `contexts` different words: so few of all stems do by chance that the curve leaves a single weak one below the
    threshold.
    """
    sample = cut(sample, "labelled")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    toxic, clean = totals["t"], totals["n"] - totals["t"]
    if not toxic or not clean:
        return Grammar({}, 1.0, float(np.log((toxic + 0.5) / (clean + 0.5))))
    seen = sample.mapInArrow(_stems_in, "stem string, label int").groupBy("stem").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    odds = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    pure = (F.col("t") >= max(2, min(least, toxic // 10))) & (F.col("t") >= purity * F.col("c"))
    weights = {r["stem"]: float(r["weight"]) for r in seen.filter(pure).select("stem", F.log(odds).alias("weight")).collect()}
    after = sample.filter("label = 1").select("text").mapInArrow(_contexts(set(weights)), "stem string, before string").groupBy("stem").agg(F.count_distinct("before").alias("n"))
    stems = {r["stem"]: weights[r["stem"]] for r in after.filter(F.col("n") >= contexts).collect()}

    def weigh(batches):
        classes = Classes(stems)
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([evidence(t, classes) for t in b.column("text").to_pylist()]), b.column("label")], ["x", "label"])

    rows = sample.mapInArrow(weigh, "x double, label int").collect()
    x, y = np.log1p(np.array([r["x"] for r in rows])), np.array([r["label"] for r in rows], float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    a = max(0.0, float(a))
    return Grammar(stems, a, _at_best_cut(a * x + b, y) + float(b))


def _at_best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """What to add to log-odds z so that THRESHOLD is where the sample's F2 (recall counts twice) is greatest, the highest of equals."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    last = np.append(z[1:] < z[:-1], True)  # equal ones fall on one side
    hits = np.cumsum(y)
    f2 = np.where(last, 5 * hits / (np.arange(1, len(z) + 1) + 4 * y.sum()), -1.0)
    best = int(np.argmax(f2))
    cut = z[best] if best + 1 == len(z) else (z[best] + z[best + 1]) / 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, and the input columns named in keep as struct `row`; one row per input row.

    Null text counts as empty and has no evidence. Without labelled rows of both kinds no stem is known and every score is
    the sample's rate (0.5 without any). Whole texts are read, however long. Repeated rows are each scored, equal texts
    alike; of other columns only those named in keep are read. An empty table gives no rows.
    """
    grammar = learn(labelled(docs, labels, LABEL, FOLDS, HELD_OUT, most))

    def run(batches):
        classes = Classes(grammar.stems)
        for b in chunks(batches):
            x = np.array([evidence(t or "", classes) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(grammar.score(x)), *([b.column("row")] if keep else [])], ["doc_id", "held_out", "score", *(["row"] if keep else [])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    source = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text", *row)
    extra = f", row {source.schema['row'].dataType.simpleString()}" if keep else ""
    out = source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double{extra}")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *(["row"] if keep else []))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
