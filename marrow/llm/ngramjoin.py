"""N-gram Jaccard self-join with PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

A document's set holds the hashes of its distinct word n-grams.  Sizes are cut
into bands such that two sets of the wanted similarity lie in one band or in
neighbouring ones; for a band's largest size the similarity becomes a bound k
on the number of features in which two sets differ.  The feature domain is
dealt by hash into n1 blocks of n2 partitions.  k differences leave more than
n1 - k / (k2 + 1) blocks with at most k2 touched partitions, so two similar
sets agree on some n2 - k2 partitions of those blocks.  A signature is a band,
a block, one of the subsets of n2 - k2 partitions, and the features in it;
similar sets share at least ``need`` signatures.  With subsets of one partition
(the default) that number is counted from the exact distribution: k features
dealt by hash touch many partitions more than once, so similar sets agree on far
more of them than the worst case says, with a chance of error (``MISS``, 1e-15
for a pair) in the range of a 64-bit hash collision.

Signatures without features would be shared by many short sets; a set emits
them only where its empty places could otherwise cost it that guarantee: with
at most agree - need such places it has ``need`` others, and two sets with
more of them both emit all.

That guarantee also prunes, instance by instance: whoever shares fewer than
``need`` signatures with anyone in an instance cannot be similar to them there,
so nodes and pairs are dropped on counts of signatures before any text is looked
at.  A pair belongs to the instance of its larger set, so two sets of the band
below are no pair there.

Links are found without expanding groups into pairs:

1. equal sets are one node; a signature's members are compared with its first
   member only, and verified links are contracted to components;
2. signatures whose members are by then in one component are done; members of
   different components are compared with each other if they share enough
   signatures.  Two sets with ``need`` common signatures of m have one among the
   m - need + 1 that fewest others have, so only those bring pairs together;
   where that one is held by a large group, its members' n-grams tell them
   apart: in any one order, two similar sets have one in common near the front
   of both, so with the n-grams that fewest members have in front, a member is
   put beside those only that share one of its rarest (prefix and positional
   filter of Xiao, Wang, Lin and Yu, 2008).

Every node left has a sketch, the parities of its n-grams' hashes in 512 bits.
Two sets differ in as many n-grams at least as their sketches in bits, so pairs
whose sketches differ in more than similar sets may are left out exactly.

Every pair of similar sets is thus either verified or already connected, and
verification is exact, on the texts' n-grams.

Defined results: a null text, or one without words, has an empty set and is
linked with nothing; fewer than n words are one n-gram; rows with one key are
each judged by their own text and the smallest key counts; an empty table
gives no rows; further columns are ignored by ``score`` and kept by ``keep_one``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.llm import core
from marrow.llm.components import components
from marrow.session import checkpoint_dir

WORDS = core.Scanner(~core.SPACE_BYTE, lower=True)
#: Blocks that two similar sets agree on at least: this many, and one more for each so many differences.
AGREE, AGREE_STEP = 3, 16
#: Members of a signature up to which those of different components are compared directly.
SMALL_GROUP = 64


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct n-grams of a chunk's documents, ordered by both."""
    _, _, h, first = WORDS(buf, offsets)
    counts = np.diff(first)
    prefix = core.rolling(h)
    doc = core.owners(first)
    whole = core.window_hashes(prefix, n)
    at = np.flatnonzero(np.arange(len(whole)) + n <= np.repeat(first[1:], counts)[: len(whole)])
    owner, value = [doc[at]], [whole[at]]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            owner.append(short)
            value.append(core.window_hashes(prefix, m)[first[short]])
    return core.distinct_pairs(np.concatenate(owner), np.concatenate(value))


def nodes(owner: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, size) of every document's set."""
    size = np.bincount(owner, minlength=docs)
    total = np.zeros(docs, np.uint64)
    np.add.at(total, owner, core.mix64(value ^ np.uint64(0xA0761D6478BD642F)))
    return core.mix64(total + size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64), size


#: Chance that a similar pair shares fewer signatures than ``need``.
MISS = 1e-15
#: Differences up to which their distribution is counted out; beyond, McDiarmid's inequality bounds it.
COUNTED = 2000


@lru_cache(None)
def untouched(balls: int, bins: int) -> int:
    """The number of bins that stay empty with probability 1 - MISS at least, when so many balls fall at random."""
    if balls > COUNTED:
        return max(0, int(bins * (1 - 1 / bins) ** balls - (balls * np.log(1 / MISS) / 2) ** 0.5))
    chance = np.zeros(bins + 1)  # of so many bins touched
    chance[0] = 1.0
    touched = np.arange(bins + 1)
    for _ in range(balls):
        hit_new = chance * (bins - touched) / bins
        chance = chance * touched / bins
        chance[1:] += hit_new[:-1]
    tail = np.cumsum(chance[::-1])[::-1]  # of at least so many touched
    return int(bins - (np.flatnonzero(tail > MISS)[-1] if balls else 0))


@dataclass(frozen=True)
class Instance:
    """Signatures of one band and the one below it."""

    number: int
    low: int
    high: int
    differ: int  # features in which two similar sets differ at most
    blocks: int
    n2: int
    k2: int

    @property
    def single(self) -> bool:
        """Whether every signature is one partition."""
        return self.n2 - self.k2 == 1

    @property
    def agree(self) -> int:
        """Blocks (or, where signatures are single partitions, partitions) that two similar sets agree on at least."""
        worst = self.blocks - self.differ // (self.k2 + 1)
        return max(worst, untouched(self.differ, self.blocks * self.n2)) if self.single else worst

    @property
    def need(self) -> int:
        """Signatures that two similar sets share at least."""
        return self.agree - self.agree // 4 if self.agree > 4 else (self.agree + 1) // 2


@lru_cache(64)
def instances(percent: int, upto: int, n2: int = 2, k2: int = 1) -> tuple[Instance, ...]:
    """The bands for a similarity of ``percent``, up to one above the size ``upto``."""
    out, low = [], 1
    while True:
        high = 100 * low // percent
        differ = 2 * high * (100 - percent) // (100 + percent)
        blocks = differ // (k2 + 1) + AGREE + differ // AGREE_STEP
        out.append(Instance(len(out), low, high, differ, blocks, n2, k2))
        if low > upto:
            return tuple(out)
        low = high + 1


def signatures(owner: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int, n2: int = 2, k2: int = 1
               ) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of a chunk's sets."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_ = instances(percent, int(size.max()), n2, k2)
    band = np.searchsorted(np.array([i.low for i in all_]), size, "right") - 1
    blocks_of = np.array([i.blocks for i in all_])
    spare_of = np.array([i.agree - i.need for i in all_])
    differ_of = np.array([i.differ for i in all_])
    docs_out, sigs_out = [], []
    for step in (0, 1):
        at = np.where(size > 0, band + step, 0)
        # sets that may not differ at all are equal, and equal sets are one node already
        live = (size > 0) & (differ_of[at] > 0)
        blocks = np.where(live, blocks_of[at], 0)
        parts = blocks * n2
        base = np.concatenate(([0], np.cumsum(parts)))
        use = live[owner]
        o, v = owner[use], value[use]
        salt = core.mix64(at.astype(np.uint64) + np.uint64(0x589965CC75374CC3))
        x = core.mix64(v ^ salt[o]) >> np.uint64(32)
        place = base[o] + ((x * parts[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, place, core.mix64(v + np.uint64(0x1D8E4E27C47D124F)))
        count = np.bincount(place, minlength=base[-1])
        total, count = total.reshape(-1, n2), count.reshape(-1, n2)
        doc = np.repeat(np.arange(len(size)), blocks)
        number = np.arange(len(doc)) - np.repeat(base[:-1] // n2, blocks)
        subsets = list(combinations(range(n2), n2 - k2))
        empty = np.stack([count[:, c].sum(axis=1) == 0 for c in subsets], axis=1)
        holes = np.bincount(doc, weights=empty.sum(axis=1) if n2 - k2 == 1 else empty.any(axis=1), minlength=len(size))
        # with so many holes too few of the blocks that must agree may be others: then holes count too
        loose = holes > spare_of[at]
        tag = salt[doc] + core.mix64(number.astype(np.uint64) * np.uint64(64))
        for c, subset in enumerate(subsets):
            keep = ~empty[:, c] | loose[doc]
            sig = core.mix64(total[:, subset].sum(axis=1, dtype=np.uint64) ^ core.mix64(tag + np.uint64(c)))
            # the last bit tells a set's own instance from the one above it
            sig = (sig & ~np.uint64(1)) | (at[doc].astype(np.uint64) & np.uint64(1))
            docs_out.append(doc[keep])
            sigs_out.append(sig[keep])
    return np.concatenate(docs_out), np.concatenate(sigs_out).view(np.int64)


# --- tables ----------------------------------------------------------------------


def members(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, size): every document's set by fingerprint; an empty set has no node."""

    def each(batch: pa.RecordBatch):
        node, sizes = [], []
        for lo, hi, buf, offsets in core.chunks(batch.column(1)):
            fp, size = nodes(*shingles(buf, offsets, n), hi - lo)
            node.append(fp)
            sizes.append(size)
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *node]), mask=size == 0),
             pa.array(size, pa.int64())], names=["key", "node", "size"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(core.over_batches(each), f"key {kind}, node long, size long")


def shared_signatures(docs: DataFrame, n: int, percent: int, text: str = "text", n2: int = 2, k2: int = 1) -> DataFrame:
    """(sig, node), once each, of the signatures that at least two nodes have.

    The one large shuffle: signatures meet in sorted partitions, which are read as a stream
    that holds one row of a signature at a time, however many nodes share it."""

    def emit(batches):
        seen: set[int] = set()  # a task shows every node once, however many copies it reads
        for batch in batches:
            for lo, hi, buf, offsets in core.chunks(batch.column(0)):
                owner, value = shingles(buf, offsets, n)
                fp, size = nodes(owner, value, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for d, node in enumerate(fp.tolist()):
                    if size[d] and node not in seen:
                        seen.add(node)
                        fresh[d] = True
                use = fresh[owner]
                doc, sig = signatures(owner[use], value[use], np.where(fresh, size, 0), percent, n2, k2)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(fp[doc])], names=["sig", "node"])

    def keep_shared(batches):
        head, told = None, False  # the last row so far, and whether it has been given out
        for batch in batches:
            sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            if head is not None:
                sig, node = np.append(head[0], sig), np.append(head[1], node)
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
            sig, node = sig[new], node[new]
            same = np.concatenate(([False], sig[1:] == sig[:-1]))
            shared = same | np.append(same[1:], False)
            last = told if len(sig) == 1 else bool(shared[-1])
            if told:
                shared[0] = False
            head, told = (sig[-1:], node[-1:]), last
            yield pa.RecordBatch.from_arrays([pa.array(sig[shared]), pa.array(node[shared])], names=["sig", "node"])

    schema = "sig long, node long"
    table = docs.select(text).mapInArrow(emit, schema)
    return table.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(keep_shared, schema)


#: Bits of the map that tells which nodes' texts are wanted (4 MB, whatever the input).
MAP_BITS = 1 << 25


def _wanted_map(wanted: DataFrame) -> np.ndarray:
    """A bit map of the low bits of all wanted nodes; made by aggregation, of fixed size."""
    words = wanted.select(F.expr(f"shiftright(node & {MAP_BITS - 1}L, 6)").alias("word"),
                          F.expr("shiftleft(1L, cast(node & 63L AS int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def node_texts(docs: DataFrame, wanted: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(node, text): one text of each wanted node.  The bit map spares most other texts the shuffle."""
    wanted = wanted.select("node").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_wanted_map(wanted))

    def run(batches):
        bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            column = batch.column(0)
            for lo, hi, buf, offsets in core.chunks(column):
                fp, size = nodes(*shingles(buf, offsets, n), hi - lo)
                at = fp & (MAP_BITS - 1)
                maybe = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
                pick = []
                for d in np.flatnonzero((maybe == 1) & (size > 0)).tolist():
                    if (node := int(fp[d])) not in seen:
                        seen.add(node)
                        pick.append(d)
                pick = np.array(pick, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[pick]), column.take(pa.array(lo + pick))], names=["node", "text"])

    found = docs.select(text).mapInArrow(run, "node long, text string")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have 100 * intersection >= percent * union."""

    def each(batch: pa.RecordBatch):
        sides = []
        for c in (2, 3):
            sets: list[np.ndarray] = []
            for lo, hi, buf, offsets in core.chunks(batch.column(c)):
                owner, value = shingles(buf, offsets, n)
                sets += np.split(value, np.searchsorted(owner, np.arange(1, hi - lo)))
            sides.append(sets)
        keep = []
        for x, y in zip(*sides):
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
            pa.array(keep, pa.bool_()))

    both = (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
            .select("a", "b", "text_a", "text_b"))
    return both.mapInArrow(core.over_batches(each), "a long, b long")


#: 64-bit words of a sketch.
SKETCH_WORDS = 8


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """(node, sketch): the parities of a set's n-grams by hash, so that two sets' sketches differ in no
    more bits than the sets in n-grams."""

    def each(batch: pa.RecordBatch):
        for lo, hi, buf, offsets in core.chunks(batch.column(1)):
            owner, value = shingles(buf, offsets, n)
            bit = core.mix64(value ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH_WORDS)
            words = np.zeros((hi - lo, SKETCH_WORDS), np.uint64)
            np.bitwise_xor.at(words, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            sketch = pa.ListArray.from_arrays(
                pa.array(np.arange(0, words.size + 1, SKETCH_WORDS, dtype=np.int32)), pa.array(words.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sketch], names=["node", "sketch"])

    return texts.select("node", "text").mapInArrow(core.over_batches(each), "node long, sketch array<long>")


def _alike(percent: int) -> Column:
    """Whether the sketches xa and xb of sets of the sizes sa and sb differ in no more bits than similar sets may."""
    differ = sum((F.bit_count(F.col("xa")[k].bitwiseXOR(F.col("xb")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col("sa") + F.col("sb"))


#: Buckets of n-grams by hash whose holders are counted (8 MB, whatever the input).
GRAM_BUCKETS = 1 << 20


def _holders(texts: DataFrame, n: int) -> np.ndarray:
    """How many nodes hold the n-grams of each bucket; made by aggregation, of fixed size."""

    def each(batch: pa.RecordBatch):
        for _, _, buf, offsets in core.chunks(batch.column(0)):
            bucket, count = np.unique(shingles(buf, offsets, n)[1] % np.uint64(GRAM_BUCKETS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(count, pa.int64())], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(core.over_batches(each), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GRAM_BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def rare_pairs(texts: DataFrame, some: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different components that share one of their rarest n-grams, where
    similar sets do; ``some`` has (node, size, sketch, label) of the nodes to compare.

    With all n-grams in one order, the first that two similar sets have in common leaves room
    behind it, in both, for the others that they must share.  That holds for any order; the one
    by their buckets' holders puts the rare ones first."""
    texts = texts.join(some.select("node"), "node", "left_semi").select("node", "text").checkpoint()
    holders = texts.sparkSession.sparkContext.broadcast(_holders(texts, n))

    def each(batch: pa.RecordBatch):
        node = batch.column(0).to_numpy()
        for lo, hi, buf, offsets in core.chunks(batch.column(1)):
            owner, value = shingles(buf, offsets, n)
            order = np.lexsort((value, holders.value[value % np.uint64(GRAM_BUCKETS)], owner))
            owner, value = owner[order], value[order]
            size = np.bincount(owner, minlength=hi - lo)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            keep = 100 * (size[owner] - at) >= percent * size[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[lo + owner[keep]]), pa.array(value[keep].view(np.int64)), pa.array(at[keep])], names=["node", "gram", "at"])

    front = texts.mapInArrow(core.over_batches(each), "node long, gram long, at long").join(some, "node").select(
        "gram", "node", "at", "size", "sketch", "label").checkpoint()
    left, right = front.toDF("gram", "a", "ia", "sa", "xa", "la"), front.toDF("other", "b", "ib", "sb", "xb", "lb")
    room = F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib"))
    return left.join(right, (F.col("gram") == F.col("other")) & F.expr("a < b and la <> lb") & _alike(percent)
                     & ((100 + percent) * room >= percent * (F.col("sa") + F.col("sb")))).select("a", "b").distinct()


def needs(sizes: DataFrame, percent: int, n2: int, k2: int) -> DataFrame:
    """(node, size, parity, own, above): the last bit of the signatures of a node's own instance, and the
    signatures that it shares at least with a similar node that is no larger (in its own instance), or
    one of the band above (in that one's)."""

    def each(batch: pa.RecordBatch):
        size = batch.column(1).to_numpy()
        all_ = instances(percent, int(size.max()) if len(size) else 1, n2, k2)
        band = np.searchsorted(np.array([i.low for i in all_]), size, "right") - 1
        # a band whose sets may not differ has no signatures of its own
        need = np.array([i.need if i.differ else 0 for i in all_], np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array((band & 1).astype(np.int32)), pa.array(need[band]), pa.array(need[band + 1])],
            names=["node", "size", "parity", "own", "above"])

    return sizes.mapInArrow(core.over_batches(each), "node long, size long, parity int, own int, above int")


def _prune(groups: DataFrame, sized: DataFrame) -> DataFrame:
    """Rows (sig, node, up, need) without a node's signatures of an instance in which it shares fewer than
    any similar pair does there, and without signatures that no pair is left with.  ``up``: the
    signature is of the instance above the node's own, so another such node is no partner there."""
    rows = groups.select("sig", "node").join(sized.select("node", "parity", "own", "above"), "node").select(
        "sig", "node", (F.col("sig").bitwiseAND(F.lit(1).cast("long")) != F.col("parity")).alias("up"), "own", "above")
    rows = rows.select("sig", "node", "up", F.when(F.col("up"), F.col("above")).otherwise(F.col("own")).alias("need"))
    enough = rows.groupBy("node", "up").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("node", "up")
    rows = rows.join(enough, ["node", "up"], "left_semi")
    shared = rows.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.bool_and("up").alias("none")).filter(
        "x <> y and not none").select("sig")
    return rows.join(shared, "sig", "left_semi").checkpoint()


def _candidates(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that sizes, sketches and shared signatures allow; ``lists`` has a node's size, the
    need of its own instance, its signatures there and in all, which are in proportion to its set, and its sketch."""
    pairs = pairs.distinct().join(lists.toDF("a", "sa", "na", "oa", "la", "xa"), "a").join(
        lists.toDF("b", "sb", "nb", "ob", "lb", "xb"), "b").filter(_alike(percent))
    # the larger one's own instance holds the pair
    more = F.col("sa") > F.col("sb")
    shared = F.when(more, F.size(F.array_intersect("oa", "lb"))).otherwise(F.size(F.array_intersect("ob", "la")))
    return pairs.filter((100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb"))
                        & (shared >= F.greatest(F.when(more, F.col("na")).otherwise(F.col("nb")), F.lit(1)))).select("a", "b")


def _apart(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different components that meet in a signature of the larger one's instance."""
    both = rows.toDF("sig", "a", "ua", "la").join(rows.toDF("sig", "b", "ub", "lb"), "sig")
    return both.filter("a < b and la <> lb and not (ua and ub)").select("a", "b")


def links(docs: DataFrame, rows: DataFrame, n: int, percent: int, text: str = "text", n2: int = 2, k2: int = 1
          ) -> DataFrame:
    """(node, label): the components of all nodes that are linked with another one; ``rows`` has the members."""
    found = shared_signatures(docs, n, percent, text, n2, k2).checkpoint()
    sized = rows.select("node", "size").distinct().join(found.select("node").distinct(), "node")
    sized = needs(sized, percent, n2, k2).checkpoint()
    groups = _prune(_prune(found, sized), sized)
    texts = node_texts(docs, groups, n, text).checkpoint()
    lists = groups.groupBy("node").agg(
        F.collect_list(F.when(~F.col("up"), F.col("sig"))).alias("mine"), F.collect_list("sig").alias("sigs")).join(sized, "node").join(
        sketches(texts, n), "node").select("node", "size", "own", "mine", "sigs", "sketch").checkpoint()

    low = groups.filter(~F.col("up")).groupBy("sig").agg(F.min("node").alias("a"))
    stars = groups.join(low, "sig").filter("node <> a").select("a", F.col("node").alias("b"))
    stars = _candidates(stars, lists, percent).checkpoint()
    first = verify(stars, texts, n, percent).checkpoint()

    label = components(first)
    rows = groups.join(label, "node", "left").select("sig", "node", "up", "need", F.coalesce("label", "node").alias("label"))
    mixed = rows.groupBy("sig").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members"))
    # two members are a pair that has been looked at
    rows = rows.join(mixed.filter("x <> y and members > 2").select("sig", "members"), "sig")
    # two nodes with `need` common signatures have one of them among so many less of their rarest
    places = Window.partitionBy("node", "up")
    rows = rows.withColumn("at", F.row_number().over(places.orderBy("members", "sig"))).withColumn("all", F.count("*").over(places))
    heads = rows.filter(F.col("at") <= F.col("all") - F.greatest("need", F.lit(1)) + 1).filter("all >= need").checkpoint()
    met = heads.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("met")).filter("x <> y")
    heads = heads.join(met.select("sig", "met"), "sig").checkpoint()
    near = _apart(heads.filter(F.col("met") <= SMALL_GROUP).select("sig", "node", "up", "label")).distinct()
    # pairs whose rarest common signature is that of a large group: by a rare n-gram besides
    large = heads.filter(F.col("met") > SMALL_GROUP).groupBy("node").agg(F.max("label").alias("label"))
    far = rare_pairs(texts, large.join(lists.select("node", "size", "sketch"), "node").checkpoint(), n, percent)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = near.union(far).distinct().join(done, ["a", "b"], "left_anti")
    pairs = _candidates(pairs, lists, percent).checkpoint()
    if pairs.isEmpty():
        return label
    return components(first.union(verify(pairs, texts, n, percent)))


def score(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text",
          n2: int = 2, k2: int = 1) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key it is linked with, directly or not)."""
    checkpoint_dir(docs.sparkSession)
    rows = members(docs, n, key, text).checkpoint()
    label = links(docs, rows, n, percent, text, n2, k2).withColumnRenamed("node", "linked")
    found = rows.join(label, F.col("node") == F.col("linked"), "left").select(
        "key", "size", F.coalesce("label", "node").alias("class"))
    least = found.filter(F.col("class").isNotNull()).groupBy(F.col("class").alias("group")).agg(
        F.min("key").alias("least"))
    found = found.join(least, F.col("class") == F.col("group"), "left")
    return found.select(F.col("key").alias(key), F.col("size").alias("n_shingles"),
                        F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of every component one row stays, with its smallest
    key (nulls last), and of that key's texts the one with the smallest hash; documents without
    words stay, all of them.  Rows are told apart by key and text, so neither a null nor a
    repeated key takes other texts along."""
    checkpoint_dir(docs.sparkSession)
    ids = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("rid")).alias("id"), F.col(text).alias("text"))
    rows = members(ids, n, "id").checkpoint()
    label = links(docs, rows, n, percent, text).withColumnRenamed("node", "linked")
    found = rows.join(label, F.col("node") == F.col("linked"), "left").select(
        F.struct(F.col("key.key").isNull().alias("none"), "key.key", "key.rid").alias("id"),
        F.coalesce("label", "node").alias("class"))
    best = found.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("best"))
    judged = found.join(best, "class").groupBy("id.key", "id.rid").agg(
        F.max(F.col("id").eqNullSafe(F.col("best"))).alias("stays"), F.count("*").alias("copies"))
    marked = judged.filter("not stays or copies > 1").checkpoint()
    kept = docs.join(marked, _same(docs, marked, key, text), "left_anti")
    copied = marked.filter("stays")
    if copied.isEmpty():
        return kept
    # rows equal in key and text: the one whose columns have the smallest hash (maps have none)
    order = F.xxhash64(*(c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))
    once = docs.join(copied, _same(docs, copied, key, text), "left_semi").groupBy(
        F.col(key).alias("key_"), F.xxhash64(text).alias("rid_")).agg(F.min_by(F.struct(*docs.columns), order).alias("row_"))
    return kept.union(once.select(*(F.col("row_")[c].alias(c) for c in docs.columns)))


def _same(docs: DataFrame, marked: DataFrame, key: str, text: str) -> Column:
    return docs[key].eqNullSafe(marked["key"]) & (F.xxhash64(docs[text]) == marked["rid"])
