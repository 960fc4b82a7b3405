"""Secret scans with a linear-chain conditional random field.

Fixed patterns find assigned secrets, access key ids and long hexadecimal
strings.  A linear-chain CRF tags every token as begin, inside or outside of a
secret from the token's shape, the words and delimiters around it and features
of the whole text, and Viterbi decoding gives the most likely tags; its spans
are added where no pattern already found one.

Training is weakly supervised: the tokens of pattern values are the labelled
secrets, and windows around them, around other tokens with digits and around
arbitrary tokens are the examples.  Each labelled secret is also shown with
other keywords, delimiters and random values of other forms, some without any
keyword, so that the field learns shape and context apart from each other.
The secrets come from at most ``SECRET_DOCS`` of the documents that hold one,
looked for in all rows, and the other windows from at most ``SAMPLE_DOCS`` of
all documents (the lowest hashes of the key each); ``SAMPLE_WINDOWS`` windows
(the lowest hashes again) are used, so training is bounded on the driver
whatever the input, and secrets that are rare in it are still learnt.

Decoding covers every token of every whole text.  A token whose outside score
leads by more than any change of its transitions could win back is outside in
the best path whatever its neighbours, so the exact path needs Viterbi only on
the runs between such tokens.

Defined results: a null or empty text has no spans; repeated rows are treated
alike; an empty table gives no rows; without any labelled secret in the table
nothing is added; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm import core
from marrow.llm import spans as sp
from marrow.session import checkpoint_dir

KINDS = ("assign", "access", "hex", "crf")
SAMPLE_DOCS = 10_000
SECRET_DOCS = 2_000
SAMPLE_WINDOWS = 4_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
KEYWORD = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
# runs are maximal, so asking for the length at once finds the same ones
HEX = re.compile("[0-9a-f]{24,}")


def detect(text: str) -> tuple[list[sp.Span], list[tuple[int, int]]]:
    """Pattern spans in order, and the spans of the secret values inside them."""
    out, values = [], []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= 6:
                out.append(("assign", *m.span()))
                values.append(m.span(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m.group()) >= 20:
                out.append(("access", *m.span()))
                values.append(m.span())
    for m in HEX.finditer(text):
        out.append(("hex", *m.span()))
        values.append(m.span())
    return sp.ordered(out, KINDS), values


# --- features --------------------------------------------------------------------

#: Token bytes: letters, digits, ``+ - / _ .`` and everything beyond ASCII.
TOKEN_BYTE = core._set([*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-/_.", *range(128, 256)])
TOKENS = core.Scanner(TOKEN_BYTE)
LOWER_TOKENS = core.Scanner(TOKEN_BYTE, lower=True)
DIGITS, UPPERS = core._set(b"0123456789"), core._set(range(65, 91))
LOWERS, HEXES = core._set([*range(97, 123), *range(128, 256)]), core._set(b"0123456789abcdefABCDEF")
TABLE = 1 << 14
TAGS = 3  # outside, begin, inside
N_FEATURES = 11


def _bucket(x: np.ndarray) -> np.ndarray:
    """Lengths on a logarithmic scale of base sqrt(2), at most 31."""
    return np.minimum(np.log2(np.maximum(x, 1)) * 2, 31).astype(np.int64)


def features(buf: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first, X): tokens of a chunk and their feature ids below ``TABLE``, one row per token."""
    starts, ends, words, first = LOWER_TOKENS(buf, offsets)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros((0, N_FEATURES), np.int64)
    length = ends - starts

    def count(members: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(members[buf], dtype=np.int64)))
        return total[ends] - total[starts]

    digits, uppers, lowers, hexes = count(DIGITS), count(UPPERS), count(LOWERS), count(HEXES)
    other = length - digits - uppers - lowers
    # changes between letters and digits: high in random strings
    is_digit = DIGITS[buf]
    change = np.concatenate(([0], np.cumsum(np.concatenate(([False], is_digit[1:] != is_digit[:-1])), dtype=np.int64)))
    changes = change[ends] - change[starts + 1]
    size = _bucket(length)
    # the sentence's full stop ends a token without being part of its shape
    shape = ((digits > 0) * 1 + (uppers > 0) * 2 + (lowers > 0) * 4 + (other > 1) * 8 + (hexes >= length - 1) * 16)
    ratio = 8 * digits // np.maximum(length, 1)
    doc = core.owners(first)
    same = doc[1:] == doc[:-1]

    def before(v, k):
        out = np.zeros(n, np.uint64)
        out[k:] = np.where(doc[k:] == doc[:-k], v[:-k], np.uint64(0)) if n > k else out[k:]
        return out

    after = np.zeros(n, np.uint64)
    after[:-1] = np.where(same, words[1:], np.uint64(0))
    padded = np.concatenate((buf, np.zeros(4, np.uint8))).astype(np.uint64)
    left = np.zeros(n, np.uint64)
    gap = np.minimum(np.concatenate(([99], starts[1:] - ends[:-1])), 4)
    for k in range(4):  # the last bytes before the token, as far as the token before it
        left = left * np.uint64(257) + np.where((gap > k) & (starts > k), padded[np.maximum(starts - 1 - k, 0)] + 1, 0).astype(np.uint64)
    right = padded[ends] * np.uint64(256) + padded[np.minimum(ends + 1, len(buf))]
    head = np.zeros(n, np.uint64)
    for k in range(4):
        head = head * np.uint64(257) + np.where(length > k, padded[np.minimum(starts + k, len(buf))] + 1, 0).astype(np.uint64)
    # of the whole text: how much of it is digits, and whether it is long
    doc_digits = np.diff(np.concatenate(([0], np.cumsum(is_digit)))[offsets])
    doc_size = np.diff(offsets)
    file = (_bucket(8 * 32 * doc_digits // np.maximum(doc_size, 1)) * 32 + _bucket(doc_size // 64))[doc]
    parts = [shape * 32 + size, shape * 16 + ratio, shape * 64 + np.minimum(changes, 63), before(words, 1),
             before(words, 2), after, left, right, head, file * 64 + shape, np.zeros(n, np.int64)]
    X = np.empty((n, N_FEATURES), np.int64)
    for k, p in enumerate(parts):
        mixed = core.mix64(p.astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        X[:, k] = (mixed % np.uint64(TABLE)).astype(np.int64)
    return starts, ends, first, X


# --- the model -------------------------------------------------------------------


@dataclass
class Crf:
    emit: np.ndarray  # (TABLE, TAGS)
    move: np.ndarray  # (TAGS, TAGS), from the row's tag to the column's

    def scores(self, X: np.ndarray) -> np.ndarray:
        out = np.zeros((len(X), TAGS))
        for k in range(X.shape[1]):
            out += self.emit[X[:, k]]
        return out

    def decode(self, X: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of every token; documents are chains of their own, entered and left outside."""
        E, T = self.scores(X), self.move
        n = len(E)
        tags = np.zeros(n, np.int64)
        gain = max(T[a, b] + T[b, c] - T[a, 0] - T[0, c] for a in range(TAGS) for b in range(TAGS) for c in range(TAGS))
        open_ = np.flatnonzero(E[:, 1:].max(axis=1) + gain > E[:, 0]) if n else np.zeros(0, np.int64)
        if not len(open_):
            return tags
        doc = np.searchsorted(first, open_, "right")
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(open_) > 1) | (np.diff(doc) > 0))))
        for lo, hi in zip(heads, np.append(heads[1:], len(open_))):
            a, b = open_[lo], open_[hi - 1] + 1
            tags[a:b] = viterbi(E[a:b], T)
        return tags


def viterbi(E: np.ndarray, T: np.ndarray) -> np.ndarray:
    """Best path through a chain whose neighbours on both sides are outside; ties go to the lower tag."""
    n = len(E)
    back = np.zeros((n, TAGS), np.int64)
    score = T[0] + E[0]
    for t in range(1, n):
        table = score[:, None] + T
        back[t] = table.argmax(axis=0)
        score = table.max(axis=0) + E[t]
    path = np.zeros(n, np.int64)
    path[-1] = int((score + T[:, 0]).argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def log_likelihood(model: Crf, X: np.ndarray, Y: np.ndarray, mask: np.ndarray):
    """Mean log-likelihood per window, with gradients; X is (windows, places, features), padded where mask is false."""
    w, n = Y.shape
    T = model.move
    E = model.emit[X].sum(axis=2)
    alpha, beta = np.zeros((w, n, TAGS)), np.zeros((w, n, TAGS))

    def lse(v, axis):
        top = v.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis))

    alpha[:, 0] = T[0] + E[:, 0]
    for t in range(1, n):
        new = lse(alpha[:, t - 1, :, None] + T[None], 1) + E[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    beta[:, -1] = T[:, 0]
    for t in range(n - 2, -1, -1):
        new = lse(T[None] + (E[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], new, T[:, 0])
    z = lse(alpha[:, -1] + T[:, 0], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    onehot = np.eye(TAGS)[Y] * mask[..., None]
    g_emit = np.zeros_like(model.emit)
    at = X.reshape(-1)
    for tag in range(TAGS):
        g_emit[:, tag] = np.bincount(at, np.repeat((onehot - node)[..., tag].ravel(), X.shape[2]), minlength=TABLE)
    g_move = np.zeros_like(T)
    gold = (E * onehot).sum()
    for t in range(1, n):
        pair = np.exp(alpha[:, t - 1, :, None] + T[None] + (E[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
        on = mask[:, t]
        g_move -= pair[on].sum(axis=0)
        np.add.at(g_move, (Y[on, t - 1], Y[on, t]), 1)
        gold += T[Y[on, t - 1], Y[on, t]].sum()
    last = mask.sum(axis=1) - 1
    ends = Y[np.arange(w), last]
    g_move[0] += np.bincount(Y[:, 0], minlength=TAGS) - node[:, 0].sum(axis=0)
    g_move[:, 0] += np.bincount(ends, minlength=TAGS) - node[np.arange(w), last].sum(axis=0)
    gold += T[0, Y[:, 0]].sum() + T[ends, 0].sum()
    return (gold - z.sum()) / w, g_emit / w, g_move / w


def fit(X: np.ndarray, Y: np.ndarray, mask: np.ndarray, steps: int = 120, rate: float = 0.5, l2: float = 1e-4) -> Crf:
    """Maximum likelihood by Adagrad over all windows; deterministic."""
    model = Crf(np.zeros((TABLE, TAGS)), np.zeros((TAGS, TAGS)))
    if not len(Y) or not Y.any():
        return model
    s_emit, s_move = np.full_like(model.emit, 1e-8), np.full_like(model.move, 1e-8)
    for _ in range(steps):
        _, g_emit, g_move = log_likelihood(model, X, Y, mask)
        g_emit -= l2 * model.emit
        s_emit += g_emit ** 2
        s_move += g_move ** 2
        model.emit += rate * g_emit / np.sqrt(s_emit)
        model.move += rate * g_move / np.sqrt(s_move)
    return model


# --- training windows and scanning -----------------------------------------------

HALF = 6
WIDTH = 2 * HALF + 1
PER_DOC = 8
VARIANTS = 8
ALNUM = string.ascii_letters + string.digits


def _random_value(rng: random.Random) -> str:
    """A made-up secret of one of several common forms."""
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(rng.choices("0123456789abcdef", k=rng.randint(16, 64)))
    if kind == 1:
        return "".join(rng.choices(ALNUM + "+/", k=rng.randint(20, 64)))
    if kind == 2:
        return "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16))
    if kind == 3:
        return rng.choice(("ghp_", "sk-", "xoxb-", "glpat-")) + "".join(rng.choices(ALNUM, k=rng.randint(20, 40)))
    return "".join(rng.choices(ALNUM + "-_", k=rng.randint(8, 16)))


def _variants(text: str, limit: int) -> list[tuple[str, tuple[int, int]]]:
    """Copies of a text whose first assigned secret has another keyword, delimiter and value; with the value's span."""
    m = next((m for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6), None)
    if m is None:
        return []
    rng, out = random.Random(zlib.crc32(text.encode())), []
    for k in range(limit):
        value, quote = _random_value(rng), rng.choice(('"', "'", ""))
        lead = "" if k % 4 == 3 and len(value) >= 20 else (
            rng.choice(("password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "key", "credential", "auth"))
            + rng.choice((" = ", "=", ": ", ":", " := ", " is ", " ")))
        head = text[:m.start()] + lead + quote
        out.append((head + value + quote + text[m.end():].lstrip("\"'"), (len(head), len(head) + len(value))))
    return out


def _labels(values, starts, ends) -> np.ndarray:
    """Tags of one text's tokens from its secret values; all are code points."""
    tags = np.zeros(len(starts), np.int64)
    done = -1
    for s, e in sorted(values):
        if s < done:
            continue
        done = e
        inside = np.flatnonzero((ends > s) & (starts < e))
        tags[inside] = 2
        tags[inside[:1]] = 1
    return tags


def _examples(column: pa.Array):
    """(feature ids, tags, order, has digit) of the tokens of every text and of its variants; the
    last entry says whether only its secrets are to be shown."""
    for lo, hi, buf, offsets in core.chunks(column):
        texts = [buf[offsets[d]: offsets[d + 1]].tobytes().decode() for d in range(hi - lo)]
        made = [(t, detect(t)[1], False) for t in texts]
        made += [(t, [v], True) for x, values, _ in list(made) if values for t, v in _variants(x, VARIANTS)]
        for t, values, only in made:
            b, o = core.buffers(pa.array([t]))
            starts, ends, _, X = features(b, o)
            if not len(X):
                continue
            lead = np.concatenate(([0], np.cumsum(core.LEAD_BYTE[b], dtype=np.int64)))
            digits = np.concatenate(([0], np.cumsum(DIGITS[b])))
            order = core.mix64(np.arange(len(X)).astype(np.uint64) + X[:, 3].astype(np.uint64))
            yield X, _labels(values, lead[starts], lead[ends]), order, digits[ends] > digits[starts], only


def training_windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(place, x, y) windows of the sampled documents; ``place`` orders them, secrets first, by hash."""
    hashed = docs.select(F.xxhash64(F.col(key).cast("string")).alias("at"), text)

    def labelled(batch: pa.RecordBatch):
        holds = [bool(t) and bool(detect(t)[1]) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0)], names=["at"]).filter(pa.array(holds, pa.bool_()))

    secret = hashed.mapInArrow(core.over_batches(labelled), "at long").distinct().orderBy("at").limit(SECRET_DOCS)
    sample = hashed.select("at").distinct().orderBy("at").limit(SAMPLE_DOCS).union(secret).distinct()

    def each(batch: pa.RecordBatch):
        place, xs, ys = [], [], []
        for X, y, order, has_digit, only in _examples(batch.column(0)):
            n = len(y)
            # secrets first, then tokens with digits, then one arbitrary token
            rank = np.where(y == 1, 0, np.where((y == 0) & has_digit, 1, 2))
            picks = np.lexsort((order, rank))[:PER_DOC]
            picks = picks[rank[picks] == 0] if only else picks[np.cumsum(rank[picks] == 2) <= 1]
            for c in picks.tolist():
                a, b = max(0, c - HALF), min(n, c + HALF + 1)
                # windows with secrets come before all others
                place.append(int(order[c] >> np.uint64(3)) + (0 if y[c] == 1 else 1 << 61))
                xs.append(X[a:b].ravel().tolist())
                ys.append(y[a:b].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int64()), pa.array(xs, pa.list_(pa.int16())), pa.array(ys, pa.list_(pa.int16()))],
            names=["place", "x", "y"])

    chosen = hashed.join(F.broadcast(sample), "at")
    return chosen.select(text).mapInArrow(core.over_batches(each), "place long, x array<smallint>, y array<smallint>")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Crf:
    """A CRF fitted on the bounded sample of windows."""
    half = SAMPLE_WINDOWS // 2
    checkpoint_dir(docs.sparkSession)
    # a bounded table, read twice
    windows = training_windows(docs, key, text).checkpoint().withColumn("with_secret", F.col("place") < (1 << 61))
    lowest = [windows.filter(side).orderBy("place", "x", "y").limit(half)
              for side in (F.col("with_secret"), ~F.col("with_secret"))]
    found = lowest[0].union(lowest[1]).collect()
    X = np.zeros((len(found), WIDTH, N_FEATURES), np.int64)
    Y, mask = np.zeros((len(found), WIDTH), np.int64), np.zeros((len(found), WIDTH), bool)
    for i, r in enumerate(found):
        n = len(r.y)
        X[i, :n] = np.array(r.x).reshape(n, N_FEATURES)
        Y[i, :n], mask[i, :n] = r.y, True
    return fit(X, Y, mask)


def tagged(model: Crf, buf: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per document of a chunk, the code-point spans that the CRF tags as secrets."""
    starts, ends, first, X = features(buf, offsets)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    tags = model.decode(X, first)
    hits = np.flatnonzero(tags)
    if not len(hits):
        return out
    doc = np.searchsorted(first, hits, "right") - 1
    for d in np.unique(doc):
        at = hits[doc == d]
        lead = np.concatenate(([0], np.cumsum(core.LEAD_BYTE[buf[offsets[d]: offsets[d + 1]]], dtype=np.int64)))
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (tags[at[1:]] == 1))))
        for lo, hi in zip(heads, np.append(heads[1:], len(at))):
            b, e = starts[at[lo]] - offsets[d], ends[at[hi - 1]] - offsets[d]
            while e > b + 1 and buf[offsets[d] + e - 1] == 0x2E:  # the sentence's full stop
                e -= 1
            out[d].append((int(lead[b]), int(lead[e])))
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Crf | None = None) -> DataFrame:
    """One row per document: key, pattern spans (``base``), all spans (``found``), counts and digests."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, key, text))

    def each(batch: pa.RecordBatch):
        crf = shared.value
        base, every, counts, digests, written = [], [], {k: [] for k in KINDS[:3]}, [], []
        column = batch.column(1)
        for lo, hi, buf, offsets in core.chunks(column):
            for d, more in enumerate(tagged(crf, buf, offsets)):
                found, _ = detect(column[lo + d].as_py() or "")
                added = [("crf", s, e) for s, e in more if not any(b < e and s < f for _, b, f in found)]
                both = sp.ordered([*found, *added], KINDS)
                base.append(sp.structs(found))
                every.append(sp.structs(both))
                digests.append(sp.digest(found))
                written.append(sp.written(both))
                for k in counts:
                    counts[k].append(sum(s[0] == k for s in found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in counts), pa.array(base, sp.SPANS),
             pa.array(every, sp.SPANS), pa.array(digests, pa.string()), pa.array(written, pa.string())],
            names=["key", *(f"n_{k}" for k in counts), "base", "found", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(core.over_batches(each), (
        f"key {kind}, n_assign long, n_access long, n_hex long, base {sp.SPANS_DDL}, found {sp.SPANS_DDL}, "
        "base_sha256 string, spans string")).withColumnRenamed("key", key)
