"""Conversation structure repair by a Viterbi search with survivor coalescence.

The rows of a conversation, in order of their turns, are turned into a dialogue
whose role initials read ``(s?(ua)+)?`` by the cheapest edits: Keep 0, Rerole to
user or assistant 1, Delete 2, Insert an empty user or assistant row 5; a
truncated row that stays adds 5, a blank or a repeated one must be deleted.  Of
equally cheap repairs the one whose edit initials come first in ASCII order wins.

Spark finds the faults and sorts: one shuffle by conversation serves the window
that finds repeated rows as well as the order of turns.  A task then reads its
sorted rows as a stream; a conversation may run over any number of Arrow
batches and is never held whole.

The search has four states (nothing yet, ``s``, ``...u``, ``...a``).  Every
state's survivor is a node of a backpointer tree with reference counts.  The
states after an edit follow from the state before it, so the tree is a trie:
paths are told apart by their edits alone.  Three things keep it small:

* a survivor that another one undercuts by more than any ending could win back
  (``BRIDGE``) is dropped, and nodes that no survivor needs are freed;
* once all survivors share an ancestor, the edits up to it are final: they are
  given out (rows written, digest updated) and their nodes freed;
* ties are settled when they arise, by the *complete* unresolved paths below
  the shared ancestor: skew-binary jump pointers find where two of them part in
  logarithmic time.

Two tied paths into one state never are one the beginning of the other (the
longer one would hold inserts that lead back to the state and cost more), so the
order of the paths is that of the whole audits.  Memory is the unresolved
stretch; rows that allow a shift by one forever (no role ever legal) keep it
unresolved to the end of their conversation.

Defined results: null roles and texts count as one space, null turns come
first; rows of one turn stand in order of role and text; a null conversation is
one; rows marked as absent only name their conversation, and one without
other rows has zeros, an empty audit and the digest of the empty string; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: states and what each may emit next
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: the state that Rerole and Insert lead to: an initial s comes from kept rows only
MADE = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: BRIDGE[p][q]: what the cheapest ending from p costs at most beyond that from q.  One row more is
#: an Insert; where q would still keep an s, p deletes it; where q may stop, s needs two Inserts.
BRIDGE = {
    EMPTY: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {EMPTY: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {EMPTY: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {EMPTY: DELETE, SYSTEM: 0, USER: INSERT},
}

BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
SPACE = " \t\n\x0b\x0c\r"


class Node:
    """One edit; the way up to the root is a path of edits."""

    __slots__ = ("parent", "jump", "depth", "op", "row", "kids", "held")

    def __init__(self, parent: Node | None, op: str, row: tuple | None):
        self.parent, self.op, self.row = parent, op, row
        self.kids: dict[str, Node] = {}  # with ``held``, the references to this node
        self.held = 0
        if parent is None:
            self.depth, self.jump = 0, self
            return
        self.depth = parent.depth + 1
        near, far = parent.jump, parent.jump and parent.jump.jump
        even = far is not None and parent.depth - near.depth == near.depth - far.depth
        self.jump = far if even else parent
        parent.kids[op] = self


class Search:
    """The repair of one conversation; ``step`` and ``end`` give the edits that became final, each
    as (op, row, role): the row put in, or None, and the role that stays, or None."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.cost = {EMPTY: 0}
        self.at = {EMPTY: self.root}
        self.root.held = 1
        self.pending = self.peak = 0
        self._insert()
        self._prune()

    def _above(self, node: Node, depth: int) -> Node:
        while node.depth > depth:
            far = node.jump
            node = far if far is not None and far.depth >= depth else node.parent
        return node

    def _before(self, a: Node, x: str, b: Node, y: str) -> bool:
        """Whether the path of a and x comes before that of b and y."""
        if a is b:
            return x < y
        p, q = self._above(a, b.depth), self._above(b, a.depth)
        if p is q:  # one is the beginning of the other, which goes on with inserts
            if a.depth < b.depth:
                return x < self._above(b, a.depth + 1).op
            return self._above(a, b.depth + 1).op < y
        floor = self.root.depth
        while p.parent is not q.parent:
            i, j = p.jump, q.jump
            if i is not None and j is not None and i is not j and i.depth == j.depth >= floor:
                p, q = i, j
            else:
                p, q = p.parent, q.parent
        return p.op < q.op

    def _offer(self, best: dict, state: int, cost: int, node: Node, op: str, row: tuple | None) -> None:
        have = best.get(state)
        if have is None or cost < have[0] or (cost == have[0] and self._before(node, op, have[1], have[2])):
            best[state] = (cost, node, op, row)

    def _take(self, best: dict) -> None:
        """The chosen candidates become the survivors; an empty op leaves a survivor where it is."""
        old = self.at
        self.cost = {q: c for q, (c, *_) in best.items()}
        self.at = {}
        for q, (_, node, op, row) in best.items():
            if op:
                node = Node(node, op, row)
                self.pending += 1
            node.held += 1
            self.at[q] = node
        for node in old.values():
            self._release(node)

    def _release(self, node: Node) -> None:
        node.held -= 1
        while not node.held and not node.kids and node.parent is not None:
            up = node.parent
            del up.kids[node.op]
            node.parent = node.jump = None
            self.pending -= 1
            node = up

    def _insert(self) -> None:
        for target in (USER, ASSISTANT):
            best = {q: (c, self.at[q], "", None) for q, c in self.cost.items()}
            for q, c in self.cost.items():
                if MADE[q] == target:
                    self._offer(best, target, c + INSERT, self.at[q], "I", (ROLES[target], ""))
            self._take(best)

    def _prune(self) -> None:
        for q in list(self.cost):
            if any(c + BRIDGE[p][q] < self.cost[q] for p, c in self.cost.items() if p != q):
                del self.cost[q]
                self._release(self.at.pop(q))
        self.peak = max(self.peak, self.pending)

    def _final(self) -> Iterator[tuple[str, tuple | None]]:
        """Give out what all survivors share."""
        while len(self.root.kids) == 1 and not self.root.held:
            ((_, node),) = self.root.kids.items()
            self.root.kids = {}
            self.root, node.parent, node.jump = node, None, None
            self.pending -= 1
            yield node.op, node.row

    def step(self, role: str, text: str, fault: str) -> Iterator[tuple[str, tuple | None]]:
        best: dict = {}
        more = TRUNCATED if fault == CUT else 0
        for q, c in self.cost.items():
            node = self.at[q]
            self._offer(best, q, c + DELETE, node, "D", None)
            if fault in (BLANK, DUPLICATE):
                continue
            kept = NEXT[q].get(role[:1])
            if kept is not None:
                self._offer(best, kept, c + KEEP + more, node, "K", (role, text))
            self._offer(best, MADE[q], c + REROLE + more, node, "R", (ROLES[MADE[q]], text))
        self._take(best)
        self._insert()
        self._prune()
        return self._final()

    def end(self) -> tuple[int, Iterator[tuple[str, tuple | None]]]:
        """The cost of the best repair and its last edits."""
        best: dict = {}
        for q in (EMPTY, ASSISTANT):
            if q in self.cost:
                self._offer(best, 0, self.cost[q], self.at[q], "", None)
        cost, node, _, _ = best[0]
        self._take({0: (cost, node, "", None)})
        return cost, self._rest(node)

    def _rest(self, last: Node) -> Iterator[tuple[str, tuple | None]]:
        yield from self._final()
        assert self.root is last


def find_faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                present: str | None = None) -> DataFrame:
    """(conv, present, turn, role, text, fault), each conversation in one partition and in order."""
    here = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)

    def shown(c):  # an absent row is like no present one
        return F.when(here, F.coalesce(F.col(c).cast("string"), F.lit(" ")))

    r = rows.select(F.col(conv).alias("conv"), here.alias("present"), F.col(turn).cast("long").alias("turn"),
                    shown(role).alias("role"), shown(text).alias("text")).repartition("conv")
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    # hash partitioning by conversation serves this window too
    seen = F.row_number().over(Window.partitionBy("conv", "present", "role", F.sha2("text", 256)).orderBy("turn"))
    fault = (F.when(body == "", BLANK).when(F.col("_seen") > 1, DUPLICATE)
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(""))
    return r.withColumn("_seen", seen).withColumn("fault", fault).drop("_seen").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "text")


class _Digest:
    """Running counts of one conversation."""

    def __init__(self):
        self.n = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal, self.last, self.low, self.high, self.turns = 0, None, None, None, 0
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.lines = 0

    def row(self, turn: int | None, role: str, fault: str) -> None:
        if fault:
            self.n[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def edits(self, found: Iterator[tuple[str, tuple | None]]) -> None:
        for op, row in found:
            self.audit.append(op)
            if row is not None:
                self.sha.update((("\n" if self.lines else "") + f"{row[0]}:{row[1]}").encode("utf-8", "surrogatepass"))
                self.lines += 1

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _stream(batches) -> Iterator[tuple[str, object, tuple | None]]:
    """('new', conversation, None), ('row', conversation, row) and ('end', conversation, None) of sorted batches."""
    open_, current = False, None
    for batch in batches:
        convs = batch.column(0).to_pylist()
        for conv, row in zip(convs, zip(*(batch.column(i).to_pylist() for i in range(1, 6)))):
            if not open_ or conv != current:
                if open_:
                    yield "end", current, None
                open_, current = True, conv
                yield "new", conv, None
            if row[0]:
                yield "row", conv, row[1:]
    if open_:
        yield "end", current, None


OUT_ROWS = 4096


def _flush(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def audits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, peak): one row per
    conversation; peak is the longest unresolved stretch of the search, in tree nodes."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[conv].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), *((c, pa.int64()) for c in (
        "gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()),
        ("peak", pa.int64())])

    def each(batches):
        out, search, digest = [], None, None
        for what, name, row in _stream(batches):
            if what == "new":
                search, digest = Search(), _Digest()
            elif what == "row":
                digest.row(row[0], row[1], row[3])
                digest.edits(search.step(row[1], row[2], row[3]))
            else:
                cost, rest = search.end()
                digest.edits(rest)
                out.append((name, digest.gaps(), *digest.n.values(), digest.illegal, cost,
                            "".join(digest.audit), digest.sha.hexdigest(), search.peak))
                if len(out) >= OUT_ROWS:
                    yield _flush(out, schema)
                    out = []
        yield _flush(out, schema)

    found = find_faults(rows, conv, turn, role, text, present)
    return found.mapInArrow(each, f"conv {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, "
                            "illegal long, cost long, audit string, repaired_sha256 string, peak long"
                            ).withColumnRenamed("conv", conv)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """(conv, place, role, text): the repaired rows, numbered from 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[conv].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def each(batches):
        out, search, place = [], None, 0
        for what, name, row in _stream(batches):
            if what == "new":
                search, place, found = Search(), 0, ()
            elif what == "row":
                found = search.step(row[1], row[2], row[3])
            else:
                _, found = search.end()
            for _, made in found:
                if made is not None:
                    out.append((name, place, *made))
                    place += 1
            if len(out) >= OUT_ROWS:
                yield _flush(out, schema)
                out = []
        yield _flush(out, schema)

    return find_faults(rows, conv, turn, role, text, present).mapInArrow(
        each, f"conv {kind.simpleString()}, place long, role string, text string").withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of conversations with faults put in by the CRC-32 of
    their key: a test bed for the repair.  Dropped rows stay, as not present."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    r = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("_k"))
    text = (F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return r.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("_k") != 0).alias("present"),
                    F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
                    ).drop("_copy")
