"""Byte-level BPE of whole texts by tree concatenation, and back.

A text is halved at arbitrary characters until its parts are short, the parts
are encoded by themselves, and joined pairwise up the tree.  Around each join a
window of text is encoded anew; it grows on both sides until the new tokens
agree with those of the left part at its left edge and with those of the right
part at its right edge.  The result is exactly what encoding the whole text
gives, although no part longer than ``LEAF_BYTES`` is ever encoded as a whole
unless the text leaves no edge to agree on.

Why it is exact.  The pattern that cuts a text into pieces looks at most three
characters beyond the end of a piece.  An edge (``_edge``) lies further than
that from the join and from any apostrophe, and either between characters
between which the pattern always cuts (a space after no space, or two different
classes of letters, digits and other signs), or between two of one class, where
it never does.  At the first kind parts and window are cut alike.  At the second
kind the edge lies inside one piece, for which a property of BPE is used: a row
of tokens is the encoding of its bytes if and only if every two neighbours are
the encoding of theirs, because the first merge across a boundary would also
happen in the two tokens at that boundary alone.  If the window begins with the
token that the left part has there, its neighbour to the left is one that this
token had already; likewise at the right edge.  Classes are those of characters
whose category has not changed since Unicode 3.2; others make no edge.

Parts are encoded by ``tiktoken`` with the file's ranks (the same ids as
``tokenizers``, tested), stretches of white space by ``tokenizers`` itself.
Strings of special tokens cut the text first, as there.

Texts beyond ``SPREAD_BYTES`` are cut into blocks that Spark deals out by
document and block, encoded there as subtrees, and joined in one task per
document, which holds the ids of that document (no more than its row did).

Defined results: null and empty texts have no ids and decode to the empty
text; bytes that are no UTF-8 count as U+FFFD; ids that the vocabulary does not
have are skipped in decoding; repeated rows are encoded each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm import core
from marrow.llm.tokencount import LONG_RUN

LEAF_BYTES = 2048
#: first reach of a window to either side of a join, in bytes (over three characters)
REACH_BYTES = 32
SPREAD_BYTES = 1 << 16

_WHITE = {*range(9, 14), 32}
_KINDS: dict[str, str | None] = {chr(c): "S" for c in _WHITE}


def _kind(c: str) -> str | None:
    """L, N, S (white space) or P (all else); None where Unicode versions may differ."""
    if c not in _KINDS:
        old, new = unicodedata.ucd_3_2_0.category(c)[0], unicodedata.category(c)[0]
        _KINDS[c] = None if old != new or old in "CZ" else old if old in "LN" else "P"
    return _KINDS[c]


def _edge(text: bytes, at: int) -> bool:
    """Whether a window may end here, given agreement."""
    if text[at] & 0xC0 == 0x80 or b"'" in text[max(at - 12, 0): at + 12]:
        return False
    x = _kind(text[max(at - 4, 0): at].decode("utf-8", "ignore")[-1:])
    y = _kind(text[at: at + 4].decode("utf-8", "ignore")[:1])
    return x is not None and y is not None and (x == y or x != "S")


def _halfway(text: bytes, lo: int, hi: int) -> int:
    mid = (lo + hi) // 2
    while text[mid] & 0xC0 == 0x80:
        mid -= 1
    return mid


class TreeCodec:
    """Encodes and decodes; one per Python worker."""

    def __init__(self, ranks_path: str, whole_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(whole_path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens must be plain strings")
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.cut = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")")
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole_path, self.whole = whole_path, None
        self.bytes = {n: t for t, n in (ranks | self.special).items()}
        self.size = {n: len(t) for n, t in self.bytes.items()}
        self.joins = self.grown = 0

    def part(self, text: bytes) -> list[int]:
        """The ids of a part encoded as a whole."""
        if not LONG_RUN.search(text):
            return self.quick.encode_ordinary(text.decode())
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.whole_path)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text.decode(), add_special_tokens=False).ids

    def _tree(self, text: bytes, lo: int, hi: int, leaf: int) -> list[int]:
        if hi - lo <= leaf:
            return self.part(text[lo:hi])
        mid = _halfway(text, lo, hi)
        if mid == lo:
            return self.part(text[lo:hi])
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid, leaf), self._tree(text, mid, hi, leaf))

    def _join(self, text: bytes, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of its parts before and from ``mid``."""
        if not left or not right:
            return left + right
        size, reach = self.size, REACH_BYTES
        self.joins += 1
        i, p, j, q = len(left), mid, 0, mid
        while True:
            while i and (mid - p < reach or not _edge(text, p)):
                i -= 1
                p -= size[left[i]]
            while j < len(right) and (q - mid < reach or not _edge(text, q)):
                q += size[right[j]]
                j += 1
            window = self.part(text[p:q])
            if (not i or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            self.grown += 1
            reach *= 2

    def encode(self, text: bytes, leaf: int = LEAF_BYTES) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for k, run in enumerate(self.cut.split(text) if self.special else [text]):
            if k % 2:
                ids.append(self.special[run])
            elif run:
                ids += self._tree(run, 0, len(run), leaf)
        return ids

    def blocks(self, text: bytes, limit: int) -> list[bytes]:
        """Blocks of a text, cut between characters and around special strings."""
        out, lo = [], 0
        while len(text) - lo > limit:
            at = _halfway(text, lo, lo + 2 * limit) if lo + 2 * limit < len(text) else _halfway(text, lo, len(text))
            for s in self.special:  # a cut inside such a string moves to its start, or end if the block begins there
                begin = text.find(s, max(at - len(s) + 1, lo), at + len(s) - 1)
                if 0 <= begin < at:
                    at = begin if begin > lo else begin + len(s)
            out.append(text[lo:at])
            lo = at
        return [*out, text[lo:]]

    def concatenate(self, parts: list[list[int]]) -> list[int]:
        """The ids of a text from those of its blocks, pairwise."""
        while len(parts) > 1:
            parts = [self._concat(*parts[k:k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def _concat(self, left: list[int], right: list[int] | None = None) -> list[int]:
        if not right or not left:
            return left or right or []
        special = set(self.special.values())
        i, j = len(left), 0
        while i and left[i - 1] not in special:
            i -= 1
        while j < len(right) and right[j] not in special:
            j += 1
        a, b = left[i:], right[:j]
        before = self.decode(a)
        text = before + self.decode(b)
        return left[:i] + self._join(text, 0, len(before), len(text), a, b) + right[j:]

    def decode(self, ids: list[int]) -> bytes:
        get = self.bytes.get
        return b"".join([get(n, b"") for n in ids])


_CODECS: dict[tuple, TreeCodec] = {}


def codec(*args: str) -> TreeCodec:
    if args not in _CODECS:
        _CODECS[args] = TreeCodec(*args)
    return _CODECS[args]


def _clean(body: bytes) -> bytes:
    """UTF-8 bytes; what is none becomes U+FFFD."""
    try:
        body.decode()
        return body
    except UnicodeDecodeError:
        return body.decode("utf-8", "replace").encode()


def _lists(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def encode(docs: DataFrame, ranks: str, whole: str, pattern: str, key: str = "doc_id", text: str = "text",
           leaf: int = LEAF_BYTES, spread: int = SPREAD_BYTES) -> DataFrame:
    """(key, ids) of every document."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.octet_length(text).alias("_n"))
    long = F.coalesce(F.col("_n") > spread, F.lit(False))

    def whole_texts(batch: pa.RecordBatch):
        c = codec(ranks, whole, pattern)
        for lo, hi, buf, offsets in core.chunks(batch.column(1)):
            data, at = buf.tobytes(), offsets.tolist()
            ids = [c.encode(_clean(data[a:b]), leaf) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(ids)], names=["key", "ids"])

    def cut(batch: pa.RecordBatch):
        c = codec(ranks, whole, pattern)
        for lo, _, buf, _ in core.chunks(batch.column(1), 1):  # one document at a time
            parts = c.blocks(_clean(buf.tobytes()), spread)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(k).take(pa.array([lo] * len(parts)))) for k in (0, 2)]
                + [pa.array(range(len(parts)), pa.int32()), pa.array([p.decode() for p in parts], pa.string())],
                names=["key", "row", "block", "text"])

    def parts(batch: pa.RecordBatch):
        c = codec(ranks, whole, pattern)
        for lo, hi, buf, offsets in core.chunks(batch.column(3)):
            data, at = buf.tobytes(), offsets.tolist()
            ids = [c.encode(data[a:b], leaf) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), _lists(ids)],
                                             names=["key", "row", "block", "ids"])

    def joined(batch: pa.RecordBatch):
        c = codec(ranks, whole, pattern)
        for i in range(batch.num_rows):
            ids = c.concatenate([p["ids"] for p in batch.column(1)[i].as_py()])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), _lists([ids])], names=["key", "ids"])

    short = rows.where(~long).select("key", "text").mapInArrow(
        core.over_batches(whole_texts), f"key {kind}, ids array<int>")
    # the scan's splits are the same in every run, so is the number of a row
    blocks = rows.where(long).select("key", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        core.over_batches(cut), f"key {kind}, row long, block int, text string")
    done = blocks.repartition("row", "block").mapInArrow(
        core.over_batches(parts), f"key {kind}, row long, block int, ids array<int>")
    # one document's blocks: as much as its row held
    gathered = done.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("parts"))
    long_ids = gathered.select("key", "parts").mapInArrow(core.over_batches(joined), f"key {kind}, ids array<int>")
    return short.unionByName(long_ids).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks: str, whole: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the text of every row of ids; null ids are none."""
    kind = encoded.schema[key].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        c = codec(ranks, whole, pattern)
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [c.decode(x or []).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                             names=["key", "ids", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(
        core.over_batches(each), f"key {kind}, ids array<int>, text string").withColumnRenamed("key", key)
