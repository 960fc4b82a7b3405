"""Quality rules by suffix-array repetition.

The words of every text are put into a suffix array (prefix doubling with
Larsson and Sadakane's refinement of tied groups only); the longest common
prefixes of neighbouring suffixes delimit the repeated substrings.  A place's
longest repeat is the larger of its two neighbouring prefixes, and the union
of the spans [place, place + repeat) is exactly the union of all maximal
repeated substrings.  A text is rejected when repeats of at least
``min_repeat`` words cover more than ``max_covered`` of its words, or when one
repeat is longer than ``max_longest`` words.

All texts of a chunk share one array whose first sort key is the document, so
suffixes of different documents never tie.  Everything is per row: no shuffle,
no state between rows, and memory bounded by the longest document.

Defined results: a null or empty text has no words, fails the minimum of words
and is not kept; repeated rows are judged alike; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm import core

WORDS = core.Scanner(~core.SPACE_BYTE)
LINES = core.Scanner(core.LINE_BYTE)
SYMBOL_BYTE = core._set(b"#*$%&|<>")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; percentages and fractions are of a text's words."""

    min_words: int = 20
    window: int = 8
    max_window_percent: int = 30
    min_repeat: int = 4
    max_covered: float = 0.5
    max_longest: int = 200


def suffix_repeats(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longest, lcp, owner_of_pair): per place the length of its longest repeat inside
    its document, and the common prefixes of neighbouring suffixes."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # one array of ranks is kept for each doubling: half the width where places fit
    kind = np.int32 if n < np.iinfo(np.int32).max else np.int64
    doc = core.owners(first)
    end = np.repeat(first[1:], np.diff(first))
    _, word = np.unique(ids, return_inverse=True)
    width = int(word.max()) + 1
    order = np.argsort(doc * width + word, kind="stable")
    key = (doc * width + word)[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    # rank n stands for a place that no other equals: one past every array
    rank = np.empty(n + 1, kind)
    rank[order], rank[n] = group, n
    levels, step = [rank.copy()], 1
    size = np.diff(np.append(np.flatnonzero(head), n))
    tied = np.flatnonzero(np.repeat(size > 1, size))  # places in `order`
    while len(tied):
        at = order[tied]
        after = np.where(at + step < end[at], rank[np.minimum(at + step, n)] + 1, 0)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        old = rank[at]
        order[tied] = at
        head = np.concatenate(([True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])))
        new = tied[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        rank[at] = new
        step *= 2
        levels.append(rank.copy())
        size = np.diff(np.append(np.flatnonzero(head), len(at)))
        tied = tied[np.repeat(size > 1, size)]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(doc[a] == doc[b])
    for k in range(len(levels) - 1, -1, -1):
        same = live[levels[k][a[live]] == levels[k][b[live]]]
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
        # a place at its document's end equals none; the padding keeps it in range
        ended = (a[live] >= n) | (b[live] >= n)
        if ended.any():
            live = live[~ended]
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = lcp
    longest[order[1:]] = np.maximum(longest[order[1:]], lcp)
    return longest, lcp, doc[order[:-1]]


def _tops(lcp: np.ndarray, owner: np.ndarray, least: int, docs: int) -> np.ndarray:
    """Per document the number of repeated substrings of at least ``least`` words that no
    longer repeat extends to the right (plateaus of the LCP array above both sides)."""
    if not len(lcp):
        return np.zeros(docs, np.int64)
    head = np.flatnonzero(np.concatenate(([True], (lcp[1:] != lcp[:-1]) | (owner[1:] != owner[:-1]))))
    value, of = lcp[head], owner[head]
    left = np.concatenate(([0], np.where(of[1:] == of[:-1], value[:-1], 0)))
    right = np.concatenate((np.where(of[1:] == of[:-1], value[1:], 0), [0]))
    top = (value >= least) & (value > left) & (value > right)
    return np.bincount(of[top], minlength=docs)


def measure(column: pa.Array, rules: Rules, spans: bool = False) -> dict[str, list]:
    """Figures of a string column's texts, one entry per row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "covered_words", "longest_repeat", "n_repeats")
    parts: dict[str, list[np.ndarray]] = {k: [] for k in names}
    found: list[list[dict]] = []
    for _, _, buf, offsets in core.chunks(column):
        docs = len(offsets) - 1
        starts, ends, ids, first = WORDS(buf, offsets)
        lead = np.concatenate(([0], np.cumsum(core.LEAD_BYTE[buf], dtype=np.int64)))
        n_words = np.diff(first)
        longest, lcp, owner = suffix_repeats(ids, first)
        here = np.arange(len(ids))
        windows = here[longest >= rules.window]
        in_window = core.covered(windows, windows + rules.window, len(ids))
        places = here[longest >= rules.min_repeat]
        in_repeat = core.covered(places, places + longest[places], len(ids))
        n_repeat_words = core.segment_sums(in_window, first)
        covered = core.segment_sums(in_repeat, first)
        top = np.zeros(docs, np.int64)
        np.maximum.at(top, core.owners(first), longest)
        ls, le, lh, _ = LINES(buf, offsets)
        with_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        of = np.searchsorted(offsets, ls[with_word], "right") - 1
        n_lines = np.bincount(of, minlength=docs)
        n_dup = n_lines - np.bincount(core.distinct_pairs(of, lh[with_word])[0], minlength=docs)
        failed = (n_words < rules.min_words) | (100 * n_repeat_words > rules.max_window_percent * n_words)
        kept = ~failed & (covered <= rules.max_covered * n_words) & (top <= rules.max_longest)
        for k, v in zip(names, (n_words, core.segment_sums(lead[ends] - lead[starts], first),
                                core.segment_sums(SYMBOL_BYTE[buf], offsets), n_dup, n_repeat_words, failed, kept,
                                covered, top, _tops(lcp, owner, rules.min_repeat, docs))):
            parts[k].append(v)
        if spans:
            step = np.diff(np.concatenate(([0], in_repeat.astype(np.int8), [0])))
            cut = np.zeros(len(ids) + 1, bool)
            cut[first] = True
            inside = np.concatenate((in_repeat, [False]))
            begin = np.flatnonzero((step == 1) | (cut & inside))
            stop = np.flatnonzero((step == -1) | (cut & np.concatenate(([False], in_repeat))))
            of = np.searchsorted(first, begin, "right") - 1
            lists: list[list[dict]] = [[] for _ in range(docs)]
            for d, s, e in zip(of, begin, stop):
                lists[d].append({"start": int(lead[starts[s]] - lead[offsets[d]]),
                                 "end": int(lead[ends[e - 1]] - lead[offsets[d]])})
            found += lists
    out = {k: (np.concatenate(v) if v else np.zeros(0, np.int64)) for k, v in parts.items()}
    if spans:
        out["repeat_spans"] = found
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: its figures, its repeated spans (code points) and the verdict ``kept``."""

    def each(batch: pa.RecordBatch):
        m = measure(batch.column(1), rules, spans=True)
        n = len(batch)
        covered = m["covered_words"] / np.maximum(m["n_words"], 1) if n else np.zeros(0)
        longs = {k: pa.array(m[k], pa.int64()) for k in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *longs.values(), pa.array(m["base_failed"], pa.bool_()), pa.array(m["kept"], pa.bool_()),
             pa.array(covered, pa.float64()), pa.array(m["longest_repeat"], pa.int64()),
             pa.array(m["n_repeats"], pa.int64()), pa.array(m["repeat_spans"], SPANS)],
            names=["key", *longs, "base_failed", "kept", "covered", "longest_repeat", "n_repeats", "repeat_spans"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(core.over_batches(each), (
        f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, covered double, longest_repeat long, n_repeats long, "
        "repeat_spans array<struct<start:long,end:long>>"))
    return out.withColumnRenamed("key", key)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns.

    Only texts go to the Python workers and only verdicts come back; the workers, which Spark
    goes on using, give what they took back to the system after each batch."""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        verdict = pa.array(measure(texts, rules)["kept"], pa.bool_())
        core.give_back()
        return verdict

    return docs.filter(kept(F.col(text)))
