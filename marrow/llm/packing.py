"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity`` (only longer documents
are cut).  Full pieces are sequences by themselves.  The others are dealt by
hash into blocks of about ``block`` pieces.  A block whose best-fit packing
already meets the lower bound (``lower_bound``) is done; every other block is packed by ``islands`` populations that evolve apart,
as Spark groups: crossover injects whole well-filled bins of one parent into the
other, removes the bins that now hold duplicates, and puts the displaced pieces
back: first by dominance (one or two pieces of a bin give way to one or two
displaced ones that fill it better), the smaller ones so set free by best fit.
An island evolves until the bound is met or ``generations`` steps in a row bring
nothing better.  Between the epochs the elite of every island migrates to the
next one; at the end each block takes its best individual.  Bins that stay badly
filled are dissolved once more and their pieces are packed together with those
of other blocks.

Only lengths are shuffled, never texts or token ids; a group holds at most a
block.  The table of pieces is written to the checkpoint folder once, so the
row ids that deal the blocks are stable when executors are lost.

Defined results: a null or empty text is the end token alone; repeated rows
are packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.llm import core
from marrow.session import checkpoint_dir

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 6
#: Displaced pieces, and pieces of a bin, from which pairs are formed in one step of the dominance search.
PAIRED, PAIRED_IN_BIN = 32, 8
#: Displaced pieces held back for the dominance search of one step, and bins it looks at: the effort of a
#: step, so that steps in large blocks stay cheap.  All other pieces go by best fit.
HELD_BACK, TRIED_BINS = 64, 128
#: Steps in small blocks are cheaper; at most so many times more of them are made.
MORE_STEPS = 32
#: Bins filled less than this are packed once more, across blocks.
GOOD_FILL = 0.97
CACHE_WORDS = 400_000
CACHE_WORD_BYTES = 64


# --- tokens ----------------------------------------------------------------------


#: Placed after a word in place of the end-of-word mark; no UTF-8 text holds this byte.
WORD_END = b"\xff"


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _WordIds(dict):
    """Word to id bytes; absent words are encoded and, unless very long, kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHE_WORD_BYTES:
            self[word] = ids
        return ids


class WordTokenizer:
    """Token ids of texts, as little-endian uint32 bytes, from a byte-level BPE file with word ends
    that drops white space and never joins across it.

    Texts of plain Latin (all below U+0240, without special tokens) are encoded word by word,
    each word once: such words are their own normal form but for lower case, and ``tiktoken``
    merges them with the file's own ranks, several times faster and to the same ids.  All other
    texts go through ``tokenizers`` whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, model = _byte_of_sign(), spec["model"]
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for token, n in model["vocab"].items():
            if token not in special:
                word, end = (token[:-4], WORD_END) if token.endswith("</w>") else (token, b"")
                ranks[bytes(byte[c] for c in word) + end] = n
        # ids must follow the order of the merges for ids to serve as ranks
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.ranked = merged == sorted(merged) and model["end_of_word_suffix"] == "</w>" and merged[0] > 511
        self.special = [t.encode() for t in special]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bpe = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.words = _WordIds(self._word)

    def _word(self, word: bytes) -> bytes:
        ids: list[int] = []
        for part in self.pattern.findall(word.decode().lower()):
            ids += self.bpe._encode_single_piece(part.encode() + WORD_END)
        return array("I", ids).tobytes()

    def _plain(self, text: bytes) -> bool:
        # lead bytes from C9 on stand for U+0240 and above
        return (self.ranked and (text.isascii() or not (np.frombuffer(text, np.uint8) >= 0xC9).any())
                and not any(s in text for s in self.special))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        plain = [self._plain(t) for t in texts]
        rest = iter(self.tokenizer.encode_batch([t.decode() for t, p in zip(texts, plain) if not p],
                                                add_special_tokens=False))
        ids = self.words.__getitem__
        return [b"".join(map(ids, t.split())) if p else np.array(next(rest).ids, "<u4").tobytes()
                for t, p in zip(texts, plain)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32): token pieces of every document, its end token included."""
    end = np.array([end_id], "<u4").tobytes()

    def each(batch: pa.RecordBatch):
        encode = word_tokenizer(tokenizer)
        for lo, hi, buf, offsets in core.chunks(batch.column(1)):
            data, at = buf.tobytes(), offsets.tolist()
            row, piece, start, length, crc = [], [], [], [], []
            for d, ids in enumerate(encode([data[a:b] for a, b in zip(at, at[1:])])):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s:s + 4 * capacity]
                    row.append(lo + d)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        core.over_batches(each), f"key {kind}, piece int, start long, length long, ids_crc32 long")


# --- the grouping genetic algorithm ----------------------------------------------


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs (Martello and Toth's L2): for every threshold, pieces over half a bin
    have one each, and pieces from the threshold on must fit into the room these leave."""
    size = np.sort(lengths.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(size)])
    half = np.searchsorted(size, capacity // 2, "right")
    least = np.concatenate([[0], np.unique(size[:half])])
    small = np.searchsorted(size, least)  # pieces below the threshold
    alone = np.maximum(np.searchsorted(size, capacity - least, "right"), half)  # the rest takes nothing from the threshold on
    room = (alone - half) * capacity - (total[alone] - total[half])
    more = -(-(total[half] - total[small] - room) // capacity)
    return int((len(size) - half + np.maximum(more, 0)).max())


class Packer:
    """Evolves packings of one block: an individual is a list of bins, a bin a tuple of item numbers."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.size = lengths.tolist()
        self.capacity = capacity
        self.rng = np.random.default_rng(seed)
        self.bound = lower_bound(lengths, capacity)

    def load(self, bin_: tuple) -> int:
        return sum(self.size[i] for i in bin_)

    def best_fit(self, bins: list[tuple], items: list[int]) -> list[tuple]:
        """Put items, largest first, each into the bin that it fills best, or a new one."""
        size, cap = self.size, self.capacity
        bins = [list(b) for b in bins]
        free = sorted((cap - sum(size[i] for i in b), k) for k, b in enumerate(bins))
        for i in sorted(items, key=size.__getitem__, reverse=True):
            at = bisect_left(free, (size[i], -1))
            if at < len(free):
                room, k = free.pop(at)
            else:
                room, k = cap, len(bins)
                bins.append([])
            bins[k].append(i)
            if room > size[i]:
                insort(free, (room - size[i], k))
        return [tuple(b) for b in bins]

    def refill(self, bins: list[tuple], loose: list[int]) -> list[tuple]:
        """Put displaced items back: where one or two of them fill a bin better than up to two that it
        holds, they change places; what is left, now smaller, goes by best fit."""
        cap = self.capacity
        loose = [loose[k] for k in self.rng.permutation(len(loose)).tolist()]
        bins, loose = [list(b) for b in self.best_fit(bins, loose[HELD_BACK:])], loose[:HELD_BACK]

        def offers() -> tuple[list[int], list[tuple]]:
            some = self.rng.permutation(len(loose))[:PAIRED].tolist()
            sets = sorted(chain(((i,) for i in loose), combinations([loose[k] for k in some], 2)), key=self.load)
            return [self.load(x) for x in sets], sets

        sums, sets = offers()
        for k in self.rng.permutation(len(bins))[:TRIED_BINS].tolist():
            if not loose:
                break
            held = bins[k]
            room = cap - self.load(held)
            if room <= 0:
                continue
            few = held if len(held) <= PAIRED_IN_BIN else [held[j] for j in self.rng.choice(len(held), PAIRED_IN_BIN, replace=False)]
            gain, out, into = 0, (), ()
            for gone in chain(((),), combinations(few, 1), combinations(few, 2)):
                old = self.load(gone)
                at = bisect_right(sums, old + room) - 1
                if at >= 0 and sums[at] - old > gain:
                    gain, out, into = sums[at] - old, gone, sets[at]
            if gain:
                bins[k] = [i for i in held if i not in out] + list(into)
                loose = [i for i in loose if i not in into] + list(out)
                sums, sets = offers()
        return self.best_fit(bins, loose)

    def fitness(self, bins: list[tuple]) -> float:
        """Falkenauer's measure: the mean squared filling, which rewards full bins over even ones."""
        cap = self.capacity
        return sum((self.load(b) / cap) ** 2 for b in bins) / max(len(bins), 1)

    def start(self) -> list[tuple]:
        """Best fit of a shuffled part first, then the rest, largest first."""
        n = len(self.size)
        if n == 0:
            return []
        loose = self.rng.permutation(n)
        some = loose[: int(n * self.rng.uniform(0, 0.3))].tolist()
        return self.best_fit(self.best_fit([], some), loose[len(some):].tolist())

    def cross(self, into: list[tuple], of: list[tuple]) -> list[tuple]:
        """Inject some of the better-filled half of the bins of one parent into the other, drop the bins that hold an
        injected item, and refill with the pieces these leave."""
        full = sorted(of, key=self.load, reverse=True)[: -(-len(of) // 2)]
        take = self.rng.random(len(full)) < self.rng.uniform(0.2, 0.6)
        chosen = [b for b, t in zip(full, take) if t]
        inside = {i for b in chosen for i in b}
        kept, loose = [], []
        for b in into:
            if inside.isdisjoint(b):
                kept.append(b)
            else:
                loose += [i for i in b if i not in inside]
        return self.refill(kept + chosen, loose)

    def mutate(self, bins: list[tuple]) -> list[tuple]:
        """Empty the worst-filled bins and a few others, and refill with their pieces."""
        n = len(bins)
        loads = np.array([self.load(b) for b in bins])
        out = set(np.argsort(loads)[: max(1, n // 50)].tolist()) | set(self.rng.integers(0, n, max(2, n // 30)).tolist())
        return self.refill([b for k, b in enumerate(bins) if k not in out], [i for k in out for i in bins[k]])

    def evolve(self, elite: list[list[tuple]], generations: int, population: int) -> list[list[tuple]]:
        """The two best individuals; ends when the lower bound is met, or after ``generations`` steps
        in a row without a better best one (more in small blocks, whose steps are as much cheaper)."""
        members = elite[:population]
        if not members:
            members = [self.best_fit([], list(range(len(self.size))))]
        if not self.size:
            return [[], []]
        while len(members) < population and len(members[0]) > self.bound:
            members.append(self.start())
        rank = lambda b: (len(b), -self.fitness(b))
        scored = sorted(((rank(b), k, b) for k, b in enumerate(members)), key=lambda x: x[:2])
        step, idle, generations = 0, 0, generations * min(max(1, BLOCK // len(self.size)), MORE_STEPS)
        while idle < generations and scored[0][0][0] > self.bound:
            a, b = sorted(self.rng.integers(0, len(scored), 2).tolist())
            child = self.cross(scored[a][2], scored[b][2]) if a != b else self.mutate(scored[a][2])
            if self.rng.random() < 0.3:
                child = self.mutate(child)
            best = scored[0][0]
            # a child that equals a member in rank would crowd out others without adding to them
            if (mark := rank(child)) not in {x[0] for x in scored}:
                scored = sorted([*scored, (mark, len(members) + step, child)], key=lambda x: x[:2])[:population]
            idle = idle + 1 if scored[0][0] >= best else 0
            step += 1
        best = [b for _, _, b in scored[:2]]
        return best if len(best) == 2 else best * 2


def _as_bins(of: np.ndarray) -> list[tuple]:
    """Bins from the bin number of every item."""
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [tuple(part.tolist()) for part in np.split(order, cuts)]


def _as_numbers(bins: list[tuple], n: int) -> np.ndarray:
    of = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        of[list(b)] = k
    return of


def pack_lengths(items: DataFrame, blocks: int, capacity: int = CAPACITY, islands: int = ISLANDS,
                 epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS,
                 level: int = 0) -> DataFrame:
    """(rid, length, block, bin): pack (rid, length) rows block by block."""
    schema = "block long, island int, rid long, length long, first int, second int"

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rid", ignore_index=True)
        packer = Packer(group["length"].to_numpy(), capacity, seed=0)
        bins = packer.best_fit([], list(range(len(group))))
        return group.assign(bin=_as_numbers(bins, len(group)), open=len(bins) > packer.bound)

    def evolve(epoch: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            block, island = int(group["block"].iloc[0]), int(group["island"].iloc[0])
            own = group[group["source"] == group["source"].iloc[0]]
            own = own.sort_values("rid", ignore_index=True)
            elite = []
            for _, part in sorted(group.groupby("source"), key=lambda x: (x[0] != island, x[0])):
                part = part.sort_values("rid", ignore_index=True)
                elite += [_as_bins(part[c].to_numpy()) for c in (("first", "second") if epoch else ("first",))]
            packer = Packer(own["length"].to_numpy(), capacity, seed=((level * 64 + epoch) * 64 + island) * 1_000_003 + block)
            best = packer.evolve(elite, generations, population)
            n = len(own)
            return pd.DataFrame({"block": block, "island": island, "rid": own["rid"], "length": own["length"],
                                 "first": _as_numbers(best[0], n), "second": _as_numbers(best[1], n)})

        return run

    rows = items.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(blocks)).alias("block"))
    begun = rows.groupBy("block").applyInPandas(
        begin, "rid long, length long, block long, bin int, open boolean").checkpoint()
    done = begun.filter(~F.col("open")).drop("open")
    # only blocks above their bound are copied to the islands
    rows = begun.filter("open").select(
        "block", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"), "rid", "length",
        F.lit(0).alias("source"), F.col("bin").alias("first"), F.col("bin").alias("second"))
    for epoch in range(epochs):
        rows = rows.groupBy("block", "island").applyInPandas(evolve(epoch), schema)
        if epoch < epochs - 1:  # the elite goes to the next island too
            rows = rows.withColumn("source", F.col("island")).withColumn("island", F.explode(F.array_distinct(F.array(
                F.col("source"), ((F.col("source") + 1) % islands).cast("int")))))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        bins = group.groupby("island")["first"].max()
        chosen = group[group["island"] == bins.idxmin()].sort_values("rid", ignore_index=True)
        return chosen[["rid", "length", "block", "first"]].rename(columns={"first": "bin"})

    evolved = rows.groupBy("block").applyInPandas(best, "rid long, length long, block long, bin int")
    return done.union(evolved)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         block: int = BLOCK, **search) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    checkpoint_dir(docs.sparkSession)
    table = pieces(docs, tokenizer, key, text, capacity).withColumn(
        "rid", F.monotonically_increasing_id()).checkpoint()
    items = table.filter(F.col("length") < capacity).select("rid", "length")
    blocks = max(1, -(-items.count() // block))
    packed = pack_lengths(items, blocks, capacity, **search).checkpoint()
    # bins that stayed badly filled: their pieces once more, together with those of other blocks
    fill = packed.groupBy("block", "bin").agg(F.sum("length").alias("load"))
    loose = fill.filter(F.col("load") < GOOD_FILL * capacity).select("block", "bin")
    again = packed.join(loose, ["block", "bin"]).select("rid", "length")
    more = max(1, -(-again.count() // block))
    final = packed.join(loose, ["block", "bin"], "left_anti").select("rid", "length", "block", "bin").union(
        pack_lengths(again, more, capacity, level=1, **search).withColumn("block", F.col("block") + blocks))
    sequence = (F.col("block") * (1 << 24) + F.col("bin")).cast("long")
    before = Window.partitionBy("block", "bin").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = final.select("rid", sequence.alias("sequence_id"),
                          F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    full = table.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("rid")).withColumn(
        "offset", F.lit(0).cast("long"))
    rows = table.filter(F.col("length") < capacity).join(placed, "rid").select(*full.columns).union(full)
    return rows.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
