"""Toxicity with a weighted finite-state pattern grammar.

Words become classes (insult, threat, intent, target, negation, report, other)
by a lexicon.  Five small transducers read the classes of a clause: insults,
threats that follow an intent, targets beside an insult, negation in front of
one, and reported speech around one.  Their composition is one product machine
that reads a clause once and gives the set of patterns it matched; the
weights of these patterns and of the clause's insults add up to the clause's
weight.  A text's score is a logistic function of its matched clauses.

Insults come from a fixed seed list and from labelled rows: words, and word
beginnings of 5 to 7 letters, whose frequency in toxic texts exceeds that in
others by three standard errors.  At most ``TRAIN_DOCS`` labelled rows (the
lowest hashes of the key) are used; three quarters of them give the lexicon,
the rest fits the logistic function, so no text judges words it has supplied.
The number of candidate terms is bounded too (``CANDIDATES``).

Scores depend on the text alone.  Scoring is per row, over whole texts.

Defined results: a null or empty text matches nothing and gets the score of
such texts; labels that are null count as missing, of several labels of a key
the highest counts; without labels the seed list and fixed weights are used;
repeated rows score alike; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm import core

TRAIN_DOCS = 20_000
CANDIDATES = 50_000
MIN_SUPPORT = 4
PREFIXES = (5, 6, 7)

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)
N_CLASSES = 7

# --- fixed values: seed words of the classes --------------------------------------
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum clown clowns worthless pathetic disgusting trash loser losers dumb "
            "imbecile jerk bastard scumbag dickhead asshole bitch whore slut retard freak vermin parasite subhuman",
    THREAT: "kill hurt destroy beat stab shoot murder crush strangle burn hang smash punch töten umbringen tuer matar",
    INTENT: "will gonna shall must should going werde werden vais va voy",
    TARGET: "you your yours u he she they him her them these those everyone du dich dir ihr euch tu toi vous te usted ustedes",
    NEGATION: "not no never none nobody isn aren wasn don doesn didn nicht kein keine nie pas jamais aucun nunca nadie",
    REPORT: "said says say wrote writes called calls claimed claims quoted reported told sagte schrieb dit écrit dijo escribió",
}
SEED_WEIGHT = 2.0

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")

# --- transducers ------------------------------------------------------------------

INSULTED, THREATENED, TARGETED, NEGATED, REPORTED = (1 << k for k in range(5))
PATTERNS = (INSULTED, THREATENED, TARGETED, NEGATED, REPORTED)
#: What a pattern adds to its clause's weight, on the scale of the insults' weights.
PATTERN_WEIGHT = {INSULTED: 0.0, THREATENED: 2.0, TARGETED: 0.5, NEGATED: -1.0, REPORTED: -0.5}


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine over word classes; ``arcs[state][class]`` is (next state, patterns put out)."""

    arcs: tuple[tuple[tuple[int, int], ...], ...]

    def __call__(self, classes: list[int]) -> int:
        state, out = 0, 0
        for c in classes:
            state, put = self.arcs[state][c]
            out |= put
        return out


def machine(states: int, step: Callable[[int, int], tuple[int, int]]) -> Transducer:
    return Transducer(tuple(tuple(step(s, c) for c in range(N_CLASSES)) for s in range(states)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both machines side by side on one input: states multiply, outputs unite."""
    n = len(b.arcs)

    def step(state: int, c: int) -> tuple[int, int]:
        (x, p), (y, q) = a.arcs[state // n][c], b.arcs[state % n][c]
        return x * n + y, p | q

    return machine(len(a.arcs) * n, step)


def insults() -> Transducer:
    return machine(1, lambda s, c: (0, INSULTED if c == INSULT else 0))


def threats(reach: int = 4) -> Transducer:
    """A threat verb at most ``reach`` words after an intent."""
    return machine(reach + 1, lambda s, c: (reach, 0) if c == INTENT else (
        max(s - 1, 0), THREATENED if c == THREAT and s else 0))


def targets() -> Transducer:
    """A target and an insult or threat in one clause, in either order: 0 neither, 1 target seen, 2 insult seen."""

    def step(s: int, c: int) -> tuple[int, int]:
        if c == TARGET:
            return (s or 1, TARGETED if s == 2 else 0)
        if c in (INSULT, THREAT):
            return (s or 2, TARGETED if s == 1 else 0)
        return s, 0

    return machine(3, step)


def negations(reach: int = 3) -> Transducer:
    """An insult or threat at most ``reach`` words after a negation."""
    return machine(reach + 1, lambda s, c: (reach, 0) if c == NEGATION else (
        max(s - 1, 0), NEGATED if c in (INSULT, THREAT) and s else 0))


def reports() -> Transducer:
    """An insult or threat after a word of reporting."""
    return machine(2, lambda s, c: (1 if c == REPORT else s, REPORTED if c in (INSULT, THREAT) and s else 0))


GRAMMAR = insults()
for _part in (threats(), targets(), negations(), reports()):
    GRAMMAR = compose(GRAMMAR, _part)


# --- the model --------------------------------------------------------------------

#: Without labels: the intercept, then a weight for each entry of ``Model.features``.
DEFAULT_THETA = (-3.0, 2.0, 0.8, 0.3, 0.3, 0.2, -0.3, -0.2, 0.5)


def terms(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    theta: tuple[float, ...] = DEFAULT_THETA

    def __post_init__(self):
        self.classes = {w: c for c, words in SEEDS.items() if c != INSULT for w in words.split()}
        seeds = {w: SEED_WEIGHT for w in SEEDS[INSULT].split()}
        self.words = seeds | {w: v for w, v in self.weights.items() if not w.endswith("*")}
        self.starts = {w[:-1]: v for w, v in self.weights.items() if w.endswith("*")}
        self.short = {w[:PREFIXES[0]] for w in self.starts}

    def insult(self, word: str) -> float:
        """The weight of a word as an insult; 0 if it is none."""
        found = self.words.get(word, 0.0)
        if word[:PREFIXES[0]] in self.short:
            found = max([found, *(self.starts.get(word[:k], 0.0) for k in PREFIXES if len(word) >= k)])
        return found

    def clauses(self, text: str) -> list[tuple[float, int]]:
        """(weight, patterns) of the clauses that match anything."""
        low = text.lower()
        words = set(WORD.findall(low))
        known = {w: v for w in words if (v := self.insult(w)) > 0}
        if not known and not any(self.classes.get(w) == THREAT for w in words):
            return []
        out = []
        for clause in CLAUSE.split(low):
            found = WORD.findall(clause)
            matched = GRAMMAR([INSULT if w in known else self.classes.get(w, OTHER) for w in found])
            if matched & (INSULTED | THREATENED):
                weight = sum(known.get(w, 0.0) for w in found) + sum(PATTERN_WEIGHT[p] for p in PATTERNS if matched & p)
                if weight > 0:
                    out.append((weight, matched))
        return out

    def features(self, text: str) -> list[float]:
        found = self.clauses(text)
        if not found:
            return [0.0] * (len(DEFAULT_THETA) - 1)
        weights = [w for w, _ in found]
        share = [sum(bool(m & p) for _, m in found) / len(found) for p in PATTERNS]
        return [1.0, min(max(weights), 10.0), float(np.log1p(sum(weights))), float(np.log1p(len(found))),
                share[2], share[3], share[4], share[1]]

    def score(self, text: str) -> float:
        z = self.theta[0] + float(np.dot(self.theta[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_logistic(X: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; the intercept first and not penalised."""
    A = np.column_stack([np.ones(len(X)), X])
    theta = np.zeros(A.shape[1])
    penalty = np.diag([1e-6] + [ridge] * X.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(A @ theta, -30, 30)))
        step = np.linalg.solve((A * (p * (1 - p) + 1e-9)[:, None]).T @ A + penalty, A.T @ (y - p) - penalty @ theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(theta.tolist())


# --- training ---------------------------------------------------------------------


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _count_terms(docs: DataFrame, only: set[str] | None = None) -> DataFrame:
    """(term, n): texts that hold each term; counted per batch before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def each(batch: pa.RecordBatch):
        wanted, counts = shared.value, Counter()
        for text in batch.column(0):
            words = set(WORD.findall((text.as_py() or "").lower()))
            found = {t for w in words for t in terms(w)}
            counts.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return docs.mapInArrow(core.over_batches(each), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(toxic: DataFrame, other: DataFrame, n_toxic: int, n_other: int) -> dict[str, float]:
    """Weights of the terms that mark toxic texts: the log ratio of frequencies less three standard errors."""
    rows = (_count_terms(toxic).filter(F.col("n") >= MIN_SUPPORT).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect())
    hits = {r.term: r.n for r in rows}
    misses = {r.term: r.n for r in _count_terms(other, set(hits)).collect()} if hits else {}
    out = {}
    for term, a in hits.items():
        b = misses.get(term, 0)
        ratio = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1))
        weight = ratio - 3 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if weight > 0.5:
            out[term] = float(weight)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most ``TRAIN_DOCS`` labelled rows that are not held out."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    marked = marked.groupBy(F.col(key).alias("of")).agg(F.max(label).alias("label"))
    marked = marked.withColumn("at", F.xxhash64(F.col("of").cast("string"))).orderBy("at", "of").limit(TRAIN_DOCS)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(marked), F.col("key") == F.col("of")).select("text", "label", (F.pmod("at", F.lit(4)) == 3).alias("judge"))
    counts = {bool(r.label): r.n for r in rows.filter("not judge").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(True) or not counts.get(False):
        return Model()
    learn = rows.filter("not judge")
    found = Model(lexicon(learn.filter("label = 1").select("text"), learn.filter("label <> 1").select("text"),
                          counts[True], counts[False]))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def each(batch: pa.RecordBatch):
        X = [shared.value.features(t.as_py() or "") for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(X, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    kind = rows.schema["label"].dataType.simpleString()
    judged = rows.filter("judge").select("text", "label").mapInArrow(core.over_batches(each), f"x array<double>, y {kind}")
    sample = judged.collect()
    y = np.array([float(r.y == 1) for r in sample])
    if not len(y) or y.min() == y.max():
        return found
    return Model(found.weights, fit_logistic(np.array([r.x for r in sample]), y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score, and the weight of its heaviest clause and the number of matched ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch):
        known = shared.value
        scores, heaviest, matched = [], [], []
        for t in batch.column(1):
            t = t.as_py() or ""
            found = known.clauses(t)
            scores.append(known.score(t) if found else known.score(""))
            heaviest.append(max((w for w, _ in found), default=0.0))
            matched.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array(heaviest, pa.float64()), pa.array(matched, pa.int64())],
            names=["key", "score", "heaviest", "clauses"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        core.over_batches(each), f"key {kind}, score double, heaviest double, clauses long").withColumnRenamed("key", key)
