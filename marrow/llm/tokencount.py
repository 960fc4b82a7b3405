"""Token counts by offset-mapped attribution.

Every document is encoded once, whole.  The character spans of its tokens are
joined with the intervals of its sections, and a token that crosses a
boundary is allocated by an explicit rule:

* ``first``: to the section that holds its first character;
* ``most``: to the section that holds most of its characters, the earliest on ties;
* ``share``: to every section it touches, by its share of the token's characters.

Sections come from a table of intervals (or, by default, are the document's
lines, each with its newline).  The interval join is a sorted merge inside the
document's row, so tokens are never shuffled.  Tokens in no section count for
section -1.

Token lengths come from the vocabulary's byte strings; a token inside a
character (byte-level tokens of one code point) spans that whole character.

Defined results: a null or empty text has no tokens and one empty line;
repeated rows are counted each; an empty table gives no rows; overlapping
sections are cut where the next one begins, empty and reversed ones get
nothing; further columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm import core

RULES = ("first", "most", "share")
#: White space runs from this length on go through ``tokenizers`` (the other library's pattern recurses on them).
LONG_RUN = re.compile(rb"[\x09-\x0d\x20]{2000}|(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80){500}")


class OffsetTokenizer:
    """Byte lengths of the tokens of whole texts, in order."""

    def __init__(self, ranks_path: str, whole_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, n in ranks.items():
            self.size[n] = len(token)
        self.whole_path, self.whole = whole_path, None

    def ids(self, text: bytes) -> np.ndarray:
        if not LONG_RUN.search(text):
            return np.array(self.encoding.encode_ordinary(text.decode()), np.int64)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.whole_path)
            self.whole.encode_special_tokens = True
        return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, np.int64)

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Code-point spans of the tokens."""
        stop = np.cumsum(self.size[self.ids(text)])
        lead = np.concatenate(([0], np.cumsum(core.LEAD_BYTE[np.frombuffer(text, np.uint8)], dtype=np.int64)))
        begin = np.concatenate(([0], stop[:-1])).astype(np.int64)
        # a token that starts inside a character starts with it; one that ends inside a character ends with it
        return lead[begin + 1] - 1 if len(stop) else begin[:0], lead[stop]


_TOKENIZERS: dict[tuple, OffsetTokenizer] = {}


def offset_tokenizer(*args: str) -> OffsetTokenizer:
    """One per Python worker and vocabulary."""
    if args not in _TOKENIZERS:
        _TOKENIZERS[args] = OffsetTokenizer(*args)
    return _TOKENIZERS[args]


def line_sections(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code-point intervals of the lines, newlines included; an empty text has one empty line."""
    buf = np.frombuffer(text, np.uint8)
    lead = np.concatenate(([0], np.cumsum(core.LEAD_BYTE[buf], dtype=np.int64)))
    cut = np.flatnonzero(buf == 10) + 1
    return lead[np.concatenate(([0], cut))], lead[np.concatenate((cut, [len(buf)]))]


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Join token spans with disjoint ascending sections: per section the tokens by each rule and
    the tokens that cross its boundaries; the last entry is for no section."""
    s, t = len(starts), len(begin)
    out = {"first": np.zeros(s + 1, np.int64), "most": np.zeros(s + 1, np.int64), "share": np.zeros(s + 1),
           "crossing": np.zeros(s + 1, np.int64)}
    if not t:
        return out
    length = np.maximum(end - begin, 1)
    lo = np.searchsorted(ends, begin, "right")  # the first section that ends behind the token's start
    hi = np.maximum(np.searchsorted(starts, end, "left"), lo)  # sections from here on start behind its end
    count = hi - lo
    token = np.repeat(np.arange(t), count)
    section = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count) + lo[token]
    overlap = np.minimum(end[token], ends[section]) - np.maximum(begin[token], starts[section])
    use = overlap > 0
    token, section, overlap = token[use], section[use], overlap[use]
    holder = np.searchsorted(starts, begin, "right") - 1
    inside = (holder >= 0) & (begin < ends[np.maximum(holder, 0)]) if s else np.zeros(t, bool)
    out["first"] += np.bincount(np.where(inside, holder, s), minlength=s + 1)
    best = np.full(t, s)
    order = np.lexsort((section, -overlap, token))
    head = np.concatenate(([True], token[order][1:] != token[order][:-1])) if len(order) else np.zeros(0, bool)
    best[token[order][head]] = section[order][head]
    out["most"] += np.bincount(best, minlength=s + 1)
    part = overlap / length[token]
    out["share"] += np.bincount(section, part, minlength=s + 1)
    held = np.bincount(token, overlap, minlength=t)
    out["share"][s] += ((length - held) / length).sum()
    crossing = overlap < length[token]
    out["crossing"] += np.bincount(section[crossing], minlength=s + 1)
    return out


def count(docs: DataFrame, ranks: str, whole: str, pattern: str, sections: DataFrame | None = None,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, start, end, n_first, n_most, share, n_crossing, n_doc): one row per document
    and section, ``sections`` being (key, section, start, end) in code points; section -1
    appears only where it holds tokens."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    listed_sections = sections is not None
    if listed_sections:
        # as many as a document has sections
        lists = sections.groupBy(F.col(key).alias("of")).agg(
            F.array_sort(F.collect_list(F.struct("start", "end", "section"))).alias("sections"))
        rows = rows.join(lists, F.col("key").eqNullSafe(F.col("of")), "left").select("key", "text", "sections")

    def each(batch: pa.RecordBatch):
        encode = offset_tokenizer(ranks, whole, pattern)
        given = batch.column(2) if listed_sections else None
        for lo, hi, buf, offsets in core.chunks(batch.column(1)):
            data, at = buf.tobytes(), offsets.tolist()
            parts = {k: [] for k in ("row", "section", "start", "end", "first", "most", "share", "crossing", "n_doc")}
            for d in range(hi - lo):
                body = data[at[d]:at[d + 1]]
                begin, end = encode.spans(body)
                if given is None:
                    starts, ends = line_sections(body)
                    names = np.arange(len(starts))
                else:
                    listed = given[lo + d].as_py() or []
                    starts = np.array([x["start"] for x in listed], np.int64)
                    ends = np.array([x["end"] for x in listed], np.int64)
                    names = np.array([x["section"] for x in listed], np.int64)
                cut = np.maximum(np.minimum(ends, np.append(starts[1:], np.iinfo(np.int64).max)[: len(ends)]), starts)
                # the merge needs ascending ends; empty sections end where they start
                found = attribute(begin, end, starts, cut)
                n = len(names) + (found["share"][-1] > 1e-9 or found["first"][-1] > 0)
                parts["row"].append(np.full(n, lo + d))
                parts["section"].append(np.append(names, -1)[:n])
                parts["start"].append(np.append(starts, 0)[:n])
                parts["end"].append(np.append(ends, 0)[:n])
                for k in ("first", "most", "share", "crossing"):
                    parts[k].append(found[k][:n])
                parts["n_doc"].append(np.full(n, len(begin)))
            a = {k: np.concatenate(v) for k, v in parts.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(a["row"], pa.int64())),
                 *(pa.array(a[k], pa.int64()) for k in ("section", "start", "end", "first", "most")),
                 pa.array(a["share"], pa.float64()), pa.array(a["crossing"], pa.int64()), pa.array(a["n_doc"], pa.int64())],
                names=["key", "section", "start", "end", "n_first", "n_most", "share", "n_crossing", "n_doc"])

    return rows.mapInArrow(core.over_batches(each), (
        f"key {kind}, section long, start long, end long, n_first long, n_most long, share double, "
        "n_crossing long, n_doc long")).withColumnRenamed("key", key)


def totals(counts: DataFrame, by: str = "doc_id", rule: str = "most") -> DataFrame:
    """Tokens by the rule, summed per value of a column."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    column = "share" if rule == "share" else f"n_{rule}"
    return counts.groupBy(by).agg(F.sum(column).alias("tokens"))
