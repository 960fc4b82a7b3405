"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Every benchmark item gives its windows of ``n`` consecutive words (an item of
fewer words is one window).  Tasks hold the set of windows and the hashes of
them; they slide over each document's words with a rolling hash, look hits up
by their words (so a hash collision never counts), and mark every word inside
an occurrence.

The set is broadcast only below ``max_set_bytes``, measured by Spark
beforehand.  A larger benchmark is dealt by hash into blocks that each stay
below the bound; the documents are then scanned once per block and the hits
are united, so results are the same and memory keeps its bound.  Documents are
never shuffled and no group of rows is brought together.

Defined results: a null or empty text (or item) has no words, hits nothing and
is not contaminated; repeated documents are judged alike; repeated items count
by their id, and items without an id hit words like others but are not listed; an empty benchmark hits nothing; an empty document table gives no
rows; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm import core
from marrow.session import checkpoint_dir

WORDS = core.Scanner(core.ALNUM_BYTE, lower=True)
#: Bytes of window text and ids that one broadcast set may hold (about a fifth of it in memory per task).
MAX_SET_BYTES = 64 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPAN_DDL = "array<struct<start:bigint,end:bigint>>"


def _words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words of a span, lower-cased (A-Z) and joined by single spaces."""
    base = int(starts[0])
    data = buf[base: int(ends[-1])].tobytes()
    return b" ".join(data[s - base: e - base] for s, e in zip(starts.tolist(), ends.tolist())).lower()


def windows(benchmark: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (words, hash, size, item) windows of the benchmark's items."""

    def each(batch: pa.RecordBatch):
        texts, hashes, sizes, items = [], [], [], []
        ids = batch.column(0).cast(pa.string()).to_pylist()
        for lo, hi, buf, offsets in core.chunks(batch.column(1)):
            starts, ends, h, first = WORDS(buf, offsets)
            for d in range(hi - lo):
                a, b = first[d], first[d + 1]
                if a == b:
                    continue
                m = min(n, b - a)
                for at, value in zip(range(a, b - m + 1), core.window_hashes(core.rolling(h[a:b]), m)):
                    texts.append(_words(buf, starts[at:at + m], ends[at:at + m]))
                    hashes.append(int(value.view(np.int64)))
                    sizes.append(m)
                    items.append(ids[lo + d])
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.binary()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()),
             pa.array(items, pa.string())], names=["words", "hash", "size", "item"])

    return benchmark.select(item, text).mapInArrow(
        core.over_batches(each), "words binary, hash long, size int, item string").distinct()


class WindowSet:
    """What a task holds of one block of windows."""

    def __init__(self, rows):
        self.items: dict[bytes, set[str]] = {}
        by_size: dict[int, set[int]] = {}
        for words, value, size, item in rows:
            self.items.setdefault(bytes(words), set()).add(item)
            by_size.setdefault(size, set()).add(value)
        self.sizes = {}
        for m, values in sorted(by_size.items()):
            sorted_hashes = np.sort(np.array(list(values), np.int64).view(np.uint64))
            bits = np.zeros(1 << 20, bool)
            bits[(sorted_hashes >> np.uint64(44)).astype(np.int64)] = True
            self.sizes[m] = (sorted_hashes, bits)

    def find(self, buf, starts, ends, hashes, first):
        """(begin, end, items) of every occurrence of a window in a chunk, in words."""
        out = []
        if not len(hashes):
            return out
        prefix = core.rolling(hashes)
        stop = np.repeat(first[1:], np.diff(first))
        for m, (known, bits) in self.sizes.items():
            h = core.window_hashes(prefix, m)
            at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            at = at[at + m <= stop[at]]
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            for i in at[known[place] == h[at]].tolist():
                if found := self.items.get(_words(buf, starts[i:i + m], ends[i:i + m])):
                    out.append((i, i + m, found))
        return out


def _fresh(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def _scan(docs: DataFrame, benchmark: DataFrame, text: str, n: int, item: str, item_text: str, max_set_bytes: int,
          carry: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns ``carry`` of the documents with what was found in them; the found columns' names."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    grams = windows(benchmark, n, item, item_text).checkpoint()
    size = grams.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 100)).first()[0] or 0
    blocks = max(1, -(-size // max_set_bytes))
    names = {k: _fresh(docs.columns, k) for k in ("n_words", "spans", "chars", "items")}
    ddl = {"n_words": "bigint", "spans": _SPAN_DDL, "chars": _SPAN_DDL, "items": "array<string>"}
    frame = docs.select(*dict.fromkeys([*carry, text])) if blocks == 1 else docs
    for block in range(blocks):
        part = grams if blocks == 1 else grams.filter(F.pmod("hash", F.lit(blocks)) == block)
        # bounded: at most max_set_bytes in all, or the windows of one hash block of that expected size
        shared = spark.sparkContext.broadcast(WindowSet(part.collect()))
        last = block == blocks - 1
        keep = list(carry) if last else frame.columns[: len(docs.columns)]
        frame = _pass(frame, shared, text, keep, names, ddl, merge=block > 0)
        if not last:
            frame = frame.checkpoint()
    return frame, names


def _pass(frame: DataFrame, shared, text: str, keep: list[str], names, ddl, merge: bool) -> DataFrame:
    cols = frame.columns
    at, kept = cols.index(text), [cols.index(c) for c in keep]
    spans_at, items_at = (cols.index(names["spans"]), cols.index(names["items"])) if merge else (None, None)

    def each(batch: pa.RecordBatch):
        known: WindowSet = shared.value
        n_words, spans, chars, items = [], [], [], []
        old_spans = batch.column(spans_at).to_pylist() if merge else None
        old_items = batch.column(items_at).to_pylist() if merge else None
        for lo, hi, buf, offsets in core.chunks(batch.column(at)):
            starts, ends, h, first = WORDS(buf, offsets)
            n_words += np.diff(first).tolist()
            of: dict[int, tuple[list, set]] = {}
            for b, e, found in known.find(buf, starts, ends, h, first):
                d = int(np.searchsorted(first, b, "right")) - 1
                s, i = of.setdefault(d, ([], set()))
                s.append((b - first[d], e - first[d]))
                i |= found
            for d in range(hi - lo):
                s, i = of.get(d, ([], set()))
                if merge:
                    s = s + [(x["start"], x["end"]) for x in old_spans[lo + d]]
                    i = i | set(old_items[lo + d])
                items.append(sorted(x for x in i if x is not None))
                if not s:
                    spans.append([])
                    chars.append([])
                    continue
                a, b = np.array(s, np.int64).T
                hit = np.concatenate(([0], core.covered(a, b, int(first[d + 1] - first[d])).astype(np.int8), [0]))
                step = np.diff(hit)
                begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(begin, stop)])
                lead = np.concatenate(([0], np.cumsum(core.LEAD_BYTE[buf[offsets[d]: offsets[d + 1]]])))
                chars.append([{"start": int(lead[starts[first[d] + x] - offsets[d]]),
                               "end": int(lead[ends[first[d] + y - 1] - offsets[d]])} for x, y in zip(begin, stop)])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in kept), pa.array(n_words, pa.int64()), pa.array(spans, SPANS),
             pa.array(chars, SPANS), pa.array(items, pa.list_(pa.string()))], names=[*keep, *names.values()])

    schema = ", ".join([*(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep),
                        *(f"`{names[k]}` {ddl[k]}" for k in names)])
    return frame.mapInArrow(core.over_batches(each), schema)


def score(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text",
          item: str = "item_id", item_text: str = "text", max_set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted as strings), the hit spans in
    words and in code points, contaminated."""
    found, names = _scan(docs.select(key, text), benchmark, text, n, item, item_text, max_set_bytes, [key])
    spans = F.col(names["spans"])
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        key, F.col(names["n_words"]).alias("n_words"), n_hit.alias("n_hit"), F.col(names["items"]).alias("items"),
        spans.alias("spans"), F.col(names["chars"]).alias("chars"), (F.size(spans) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 10, text: str = "text",
                  item: str = "item_id", item_text: str = "text", max_set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """The rows of ``docs``, without the contaminated documents (mode ``documents``) or
    with the hit spans cut out of their texts (mode ``spans``)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    found, names = _scan(docs, benchmark, text, n, item, item_text, max_set_bytes, docs.columns)
    if mode == "documents":
        return found.filter(F.size(names["spans"]) == 0).select(*docs.columns)
    chars, body = F.col(names["chars"]), F.col(text)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(chars, lambda s: s["end"]))
    ends = F.concat(F.transform(chars, lambda s: s["start"]), F.array(F.char_length(body).cast("long")))
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(body, b.cast("int") + 1, (e - b).cast("int")))
    cut = F.when(F.size(chars) == 0, body).otherwise(F.array_join(pieces, ""))
    return found.withColumn(text, cut).select(*docs.columns)
