"""Subword encoding by longest match.

Words are cut greedily: the longest piece of the vocabulary that begins here,
then the longest one that goes on (written with a prefix, ``##`` by default),
and so on; a word that cannot be cut to its end is one unknown.  A trie of the
vocabulary (checked to be small) is held by the tasks, and an Arrow batch is
cut by its distinct words, so the walk is done once per word and batch; rows
stay in the JVM, only texts go to Python and ids come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries of a vocabulary that tasks may hold (some hundred bytes each)
MAX_PIECES = 1 << 20
#: white space as in ``marrow.functions.text.WS``
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


class Trie:
    """First and following pieces of words; a node is a dict of characters, with its id under ``None``."""

    def __init__(self, pieces, prefix: str = "##"):
        self.first: dict = {}
        self.later: dict = {}
        for piece, idx in pieces:
            goes_on = piece.startswith(prefix) and len(piece) > len(prefix)
            node = self.later if goes_on else self.first
            for c in piece[len(prefix):] if goes_on else piece:
                node = node.setdefault(c, {})
            node[None] = idx

    def cut(self, word: str, unk: int) -> list[int]:
        ids, at, node = [], 0, self.first
        while at < len(word):
            end, idx = at, None
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if None in node:
                    end, idx = i + 1, node[None]
            if idx is None:
                return [unk]
            ids.append(idx)
            at, node = end, self.later
        return ids


def encode_batch(texts: pa.Array, trie: Trie, unk: int, max_len: int, pad: int = 0, first: int | None = None,
                 last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of a batch, each rows x max_len."""
    lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), pattern=_SPACE)
    words = pc.list_flatten(lists)
    real = pc.not_equal(words, "")
    rows = pc.list_parent_indices(lists).filter(real).to_numpy()
    coded = pc.dictionary_encode(words.filter(real))
    word = coded.indices.to_numpy()
    cuts = [trie.cut(w, unk) for w in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, cuts), np.int64, len(cuts))
    begin = np.concatenate(([0], np.cumsum(size)))
    pool = np.fromiter((i for c in cuts for i in c), np.int64, int(begin[-1]))
    n = size[word]  # pieces of every word in turn
    stop = np.cumsum(n)
    piece = pool[np.repeat(begin[:-1][word], n) + np.arange(int(stop[-1]) if len(n) else 0) - np.repeat(stop - n, n)]
    owner = np.repeat(rows, n)
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    lead, room = int(first is not None), max_len - int(first is not None) - int(last is not None)
    kept = place < room
    ids = np.full((len(texts), max_len), pad, np.int64)
    ids[owner[kept], place[kept] + lead] = piece[kept]
    used = np.minimum(count, room) + lead
    if first is not None:
        ids[:, 0] = first
    if last is not None:
        ids[np.arange(len(texts)), used] = last
        used = used + 1
    return ids, (np.arange(max_len) < used[:, None]).astype(np.int64)


def encode_subwords(df: DataFrame, vocab: DataFrame, max_len: int, text: str = "text", unk: str = "<unk>", pad: str = "<pad>",
                    first: str | None = None, last: str | None = None, prefix: str = "##") -> DataFrame:
    """``df`` + (input_ids, attention_mask): the pieces of every text's words, cropped and padded to
    ``max_len``; ``first`` and ``last`` frame them.  A null text has no pieces.

    ``vocab`` is (word, idx), distinct, at most ``MAX_PIECES`` rows (else a ValueError)."""
    rows = vocab.select("word", "idx").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
    ids = {r.word: r.idx for r in rows}
    marks = {m: ids[m] for m in (unk, pad, first, last) if m is not None}
    if max_len <= (first is not None) + (last is not None):
        raise ValueError("max_len leaves no room for pieces")
    shared = df.sparkSession.sparkContext.broadcast([(w, i) for w, i in ids.items() if w not in marks])
    built: dict[str, Trie] = {}

    @F.arrow_udf("struct<input_ids: array<bigint>, attention_mask: array<bigint>>")
    def encoded(texts: pa.Array) -> pa.Array:
        if "trie" not in built:
            built["trie"] = Trie(shared.value, prefix)
        found, mask = encode_batch(texts, built["trie"], marks[unk], max_len, marks[pad], marks.get(first), marks.get(last))
        offsets = pa.array(np.arange(len(texts) + 1) * max_len, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (found, mask)], names=["input_ids", "attention_mask"])

    return df.withColumn("_e", encoded(F.col(text))).select(*df.columns, "_e.input_ids", "_e.attention_mask")
