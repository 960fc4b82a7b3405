"""Records of large text files, read in blocks by many tasks.

A quoted CSV field may hold line ends, and a JSON array may be one line, so a
block of such a file can begin anywhere inside a record.  What a block does to
the reader's state composes from left to right: a block flips "inside a string"
or not, and moves the bracket depth by one amount if it begins outside a string
and by another if it begins inside.  So one scan sums every block up
separately, a prefix sum over the table of blocks (one row each) gives every
block the state it begins with, and a second scan cuts all blocks into records
at the same time.  Nothing is shuffled but that table and the records that lie
across the bounds of blocks: at most two fragments per block.

Files are split by Spark (``spark.sql.files.maxPartitionBytes``) at a separator
that every record ends with: a line end for CSV, a closing brace for JSON.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrow.session import checkpoint_dir

LINE, BRACE = "\n", "}"


def _count(x: Column, chars: str) -> Column:
    return (F.length(x) - F.length(F.translate(x, chars, ""))).cast("int")


def _pieces(spark: SparkSession, paths, sep: str, **options) -> DataFrame:
    """(file, block, size, value, quotes, outer, inner): the text between separators, in order within
    a block; ``outer`` and ``inner`` are the levels gone down if it begins outside or inside a string."""
    raw = spark.read.options(lineSep=sep, **options).text(paths)
    at = F.col("_metadata")
    raw = raw.select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), at["file_size"].alias("size"), "value")
    if sep == LINE:
        none = F.lit(0)
        return raw.select("*", _count(F.col("value"), '"').alias("quotes"), none.alias("outer"), none.alias("inner"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    strings = r'"[^"]*("|\z)'

    def levels(x: Column) -> Column:
        bare = F.regexp_replace(x, strings, "")
        return _count(bare, "[{") - _count(bare, "]")

    return raw.select("*", _count(plain, '"').alias("quotes"), levels(plain).alias("outer"),
                      levels(F.regexp_replace(plain, r'\A[^"]*("|\z)', "")).alias("inner"))


class _State:
    """Inside a string or not, and the bracket depth."""

    def __init__(self, inside: int, depth: int, sep: str):
        self.inside, self.depth, self.closes = inside, depth, sep == BRACE

    def run(self, quotes: np.ndarray, outer: np.ndarray, inner: np.ndarray, unended: bool = False):
        """(inside, depth) after every piece of a run; ``unended``: no separator follows the last one."""
        after = (self.inside + np.cumsum(quotes)) & 1
        before = np.concatenate(([self.inside], after[:-1]))
        moved = np.where(before == 0, outer, inner)
        if self.closes:
            closing = after == 0
            if unended:
                closing[-1:] = False
            moved = moved - closing
        depth = self.depth + np.cumsum(moved)
        if len(after):
            self.inside, self.depth = int(after[-1]), int(depth[-1])
        return after, depth


def _runs(batch: pa.RecordBatch):
    """(file, block, from, to) of the runs of one block in a batch."""
    file, block = pc.dictionary_encode(batch.column(0)), batch.column(1).to_numpy()
    code = file.indices.to_numpy()
    cut = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1 if len(code) else []
    bounds = [0, *cut, len(code)] if len(code) else []
    for a, b in zip(bounds, bounds[1:]):
        yield file.dictionary[int(code[a])].as_py(), int(block[a]), a, b


def _ints(batch: pa.RecordBatch, name: str, a: int, b: int) -> np.ndarray:
    return batch.column(name).slice(a, b - a).to_numpy().astype(np.int64)


def block_table(spark: SparkSession, pieces: DataFrame, sep: str) -> DataFrame:
    """(file, block, inside, depth, base, unended, total, first): the state every block begins with, the
    depth between records, whether its last piece lacks its separator (the end of a file), its bytes and
    the file's first line (the header; null for JSON, where it may be a long record).  One row per block,
    checkpointed."""
    width = len(sep)

    def summed(batches):
        now, out = None, []
        for batch in batches:
            for file, block, a, b in _runs(batch):
                if now is None or now[:2] != [file, block]:
                    if now:
                        out.append(now)
                    now = [file, block, batch.column("size")[a].as_py(), [_State(h, 0, sep) for h in (0, 1)], 0, batch.column("first")[a].as_py()]
                q, o, i = (_ints(batch, c, a, b) for c in ("quotes", "outer", "inner"))
                for state in now[3]:
                    state.run(q, o, i)
                now[4] += int(_ints(batch, "bytes", a, b).sum())
        if now:
            out.append(now)
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "block": k, "size": s, "flips": h[0].inside, "outer": h[0].depth, "inner": h[1].depth, "bytes": n, "first": t}
             for f, k, s, h, n, t in out], schema=pa.schema([
                 ("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("flips", pa.int32()), ("outer", pa.int64()),
                 ("inner", pa.int64()), ("bytes", pa.int64()), ("first", pa.string())]))

    told = pieces.select("file", "block", "size", "quotes", "outer", "inner", (F.octet_length("value") + width).cast("long").alias("bytes"),
                         F.when(F.col("block") == 0, F.col("value")).alias("first")).mapInArrow(
        summed, "file string, block long, size long, flips int, outer long, inner long, bytes long, first string")
    whole = Window.partitionBy("file")
    upto = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    table = told.withColumn("inside", (F.coalesce(F.sum("flips").over(upto), zero) % 2).cast("int"))
    table = table.withColumn("moved", F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner")))
    table = table.withColumn("first", F.regexp_replace(F.max("first").over(whole), r"\A\x{feff}", ""))
    opened = F.regexp_extract("first", r"\A\s*(.)", 1) == "["
    checkpoint_dir(spark)
    return table.select(
        "file", "block", "inside", F.coalesce(F.sum("moved").over(upto), zero).cast("long").alias("depth"),
        (opened.cast("int") if sep == BRACE else zero).alias("base"),
        ((F.col("block") == F.max("block").over(whole)) & (F.sum("bytes").over(whole) > F.col("size"))).alias("unended"),
        F.col("bytes").alias("total"), F.col("first") if sep == LINE else F.lit(None).cast("string").alias("first")).checkpoint(eager=True)


WHOLE, TAIL, HEAD = 0, 1, 2
_FRAGMENTS = "file string, block long, place long, kind int, ended boolean, record string, first string"
_FRAGMENT_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()),
                              ("ended", pa.bool_()), ("record", pa.string()), ("first", pa.string())])


def _fragments(pieces: DataFrame, table: DataFrame, sep: str) -> DataFrame:
    """Whole records, and the parts of those that lie across the bounds of blocks."""
    width = len(sep)

    def cut(batches):
        now = None

        def row(kind, ended):
            return {"file": now["file"], "block": now["block"], "place": now["place"], "kind": kind, "ended": ended,
                    "record": "".join(now["open"]), "first": now["first"]}

        def closed():
            return [row(now["kind"], False)] if now and now["open"] else []

        for batch in batches:
            out = []
            for file, block, a, b in _runs(batch):
                if now is None or (now["file"], now["block"]) != (file, block):
                    out += closed()
                    inside, depth, base, left, unended, first = (
                        batch.column(c)[a].as_py() for c in ("inside", "depth", "base", "total", "unended", "first"))
                    # a file begins between records, whatever the depth of its first bracket
                    head = block > 0 and (inside, depth) != (0, base)
                    now = {"file": file, "block": block, "state": _State(inside, depth, sep), "base": base, "first": first, "left": left,
                           "unended": unended, "at": block + (block > 0), "kind": HEAD if head else TAIL, "place": block, "open": []}
                values = batch.column("value").slice(a, b - a)
                sizes = _ints(batch, "bytes", a, b)
                now["left"] -= int(sizes.sum())
                unended = now["unended"] and now["left"] == 0
                inside, depth = now["state"].run(*(_ints(batch, c, a, b) for c in ("quotes", "outer", "inner")), unended)
                places = now["at"] + np.cumsum(sizes) - sizes
                now["at"] += int(sizes.sum())
                ends = np.flatnonzero((inside == 0) & (depth == now["base"])) + 1

                def text(i, j):
                    return sep.join(values.slice(i, j - i).to_pylist()) + ("" if unended and j == b - a else sep)

                start = 0
                if len(ends) and (now["open"] or now["kind"] == HEAD):  # the first end closes what was open
                    start = int(ends[0])
                    if not now["open"]:
                        now["place"] = int(places[0])
                    now["open"].append(text(0, start))
                    out.append(row(HEAD if now["kind"] == HEAD else WHOLE, True))
                    now["open"], now["kind"], ends = [], TAIL, ends[1:]
                if len(ends):
                    bounds = np.concatenate(([start], ends)).astype(np.int32)
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), values), sep).to_pylist()
                    n, start = len(ends), int(bounds[-1])
                    tails = [sep] * (n - 1) + ["" if unended and start == b - a else sep]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENT_SCHEMA)
                        out = []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(places[bounds[:-1]]),
                         pa.array([WHOLE] * n, pa.int32()), pa.array([True] * n),
                         pa.array([r + t for r, t in zip(joined, tails)], pa.string()),
                         pa.array([now["first"]] * n, pa.string())], schema=_FRAGMENT_SCHEMA)
                if start < b - a:
                    if not now["open"]:
                        now["place"] = int(places[start])
                    now["open"].append(text(start, b - a))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENT_SCHEMA)
        if rest := closed():
            yield pa.RecordBatch.from_pylist(rest, schema=_FRAGMENT_SCHEMA)

    lines = pieces.drop("size").select("*", (F.octet_length("value") + width).cast("long").alias("bytes"),
                                       F.monotonically_increasing_id().alias("at"))
    # a block's pieces meet its one row, and stand in order whichever join Spark takes
    lines = lines.join(table, ["file", "block"]).sortWithinPartitions("file", "block", "at")
    return lines.select("file", "block", "value", "quotes", "outer", "inner", "bytes", "inside", "depth", "base", "unended",
                        "total", "first").mapInArrow(cut, _FRAGMENTS)


def records(spark: SparkSession, paths, sep: str, **options) -> tuple[DataFrame, DataFrame]:
    """The records of text files, and their table of blocks.

    (file, place, record, ended, first): ``place`` grows along a file and is unique in it, ``ended`` is
    false for a record that the file's end cuts off, ``first`` is the file's first line (null for JSON).  Files are
    read three times: to sum the blocks up, for the records inside them, and for those across their bounds."""
    pieces = _pieces(spark, paths, sep, **options)
    table = block_table(spark, pieces, sep)
    parts = _fragments(pieces, table, sep)
    inner = parts.where(F.col("kind") == WHOLE).select("file", "place", "record", "ended", "first")
    # at most two fragments per block; one that opens a record begins a group
    along = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    across = parts.where(F.col("kind") != WHOLE).withColumn("of", F.count_if(F.col("kind") == TAIL).over(along))
    across = across.groupBy("file", "of").agg(
        F.min("place").alias("place"), F.max("ended").alias("ended"), F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    across = across.select("file", "place", F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("record"), "ended", "first")
    return inner.unionByName(across), table
