"""Repair of conversation structure by a Viterbi search whose settled edits leave at once.

A conversation is read once, in order, by one task: its digest is a function of all
its turns in order. The task keeps four survivors (the best edits that end before
any turn, after a system, a user or an assistant turn) in a tree of backpointers with
reference counts. As soon as all survivors share an ancestor, the edits up to it are
settled and leave; so memory holds the unresolved turns only, and sorting spills.
Turns for which survivors never meet (every role unknown, say) stay until the end.

Cases: a null or unknown role can be replaced or deleted, never kept, and so can an
empty one; a null text is blank; turns of the same number stand in order of role and
text, null numbers first; a repeated row is a duplicate; rows of a null conv_id are one
conversation; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import table

#: cost of each edit, and of a truncated turn that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: where a turn of this role initial leads: 0 at the start, 1 after system, 2 after user, 3 after assistant
LEADS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

#: the one role that may be made up in a state
MADE = {0: "user", 1: "user", 2: "assistant", 3: "user"}

#: a conversation may end in these: nothing at all, or after an assistant
ENDS = (0, 3)

#: what any way on from the second state costs more, at most, when taken from the first: insert a
#: turn, or delete the system turn that only the start may keep, or end after a system turn
EXCESS = {(0, 1): 0, (0, 2): 2, (0, 3): 0, (1, 0): 4, (1, 2): 2, (1, 3): 4, (2, 0): 5, (2, 1): 2, (2, 3): 2, (3, 0): 3, (3, 1): 0, (3, 2): 2}

LEGAL = ("su", "ua", "au")

#: rows of an output batch, and bytes of text after which one leaves earlier
BATCH, BATCH_BYTES = 4096, 4 << 20


def made(state: int) -> int:
    """The state after a made-up turn."""
    return LEADS[state, MADE[state][0]]


@cache
def ways(state: int, initial: str, gone: bool, cut: bool) -> tuple[tuple[int, int, str], ...]:
    """(end state, cost, edits) for one turn from ``state``: the best edits to each end.

    Up to two insertions stand before the turn; a third would lead back to a state that
    costs less. ``gone``: blank or duplicate, so it must be deleted. ``cut``: truncated.
    """
    best: dict[int, tuple[int, str]] = {}

    def offer(end: int, cost: int, edits: str) -> None:
        best[end] = min(best.get(end, (cost, edits)), (cost, edits))

    for n in range(3):
        lead, spent = "I" * n, n * INSERT
        offer(state, spent + DELETE, lead + "D")
        if not gone:
            if (state, initial) in LEADS:
                offer(LEADS[state, initial], spent + KEEP + cut * TRUNCATED, lead + "K")
            offer(made(state), spent + REROLE + cut * TRUNCATED, lead + "R")
        state = made(state)
    return tuple((end, cost, edits) for end, (cost, edits) in best.items())


class Edit:
    """A node of the backpointer tree; ``refs`` counts its children and the survivors that end in it."""

    __slots__ = ("parent", "kids", "refs", "name", "role", "turn")

    def __init__(self, parent: Edit | None, name: str, role: str | None, turn: tuple | None):
        self.parent, self.name, self.role, self.turn = parent, name, role, turn
        self.kids: list[Edit] = []
        self.refs = 0
        if parent is not None:
            parent.kids.append(self)
            parent.refs += 1

    def release(self) -> None:
        """One survivor less; what nothing refers to any more goes."""
        node: Edit | None = self
        node.refs -= 1
        while node is not None and not node.refs and node.parent is not None:
            up = node.parent
            up.kids.remove(node)
            up.refs -= 1
            node.parent, node = None, up


class Search:
    """The cheapest edits of a conversation, ties to the ASCII-least string of edit initials.

    No survivor's edits are a prefix of another's (all cover the same turns and end with
    one), so the order of complete tied strings is the order of the survivors they go on
    from, then of what they add: ``rank`` keeps the first, and a tie costs no walk.
    """

    def __init__(self) -> None:
        self.root = Edit(None, "", None, None)
        self.root.refs = 1
        #: state: (cost, rank among survivors, last edit)
        self.survivors: dict[int, tuple[int, int, Edit]] = {0: (0, 0, self.root)}

    def _extend(self, node: Edit, state: int, edits: str, turn: tuple | None) -> Edit:
        for name in edits:
            if name == "I":
                node = Edit(node, name, MADE[state], None)
                state = made(state)
            else:
                role = None if name == "D" else turn[1] if name == "K" else MADE[state]
                node = Edit(node, name, role, turn)
        return node

    @staticmethod
    def _hopeless(end: int, chosen: dict[int, tuple[int, int, str, int]]) -> bool:
        """Another survivor can go on as this one might, and always at less cost, or at the
        same cost by the same edits after a smaller string. Without this the survivor that
        deletes everything would never meet the others."""
        mine = chosen[end][:3]
        return any(other[0] + EXCESS[start, end] < mine[0] or (not EXCESS[start, end] and other[:3] < mine)
                   for start, other in chosen.items() if start != end)

    def _move(self, chosen: dict[int, tuple[int, int, str, int]], turn: tuple | None) -> None:
        order = {end: k for k, end in enumerate(sorted(chosen, key=lambda end: chosen[end][1:3]))}
        after = {}
        for end, (cost, _, edits, start) in chosen.items():
            node = self._extend(self.survivors[start][2], start, edits, turn)
            node.refs += 1
            after[end] = cost, order[end], node
        for _, _, node in self.survivors.values():
            node.release()
        self.survivors = after

    def feed(self, turn: tuple, initial: str, gone: bool, cut: bool) -> None:
        """``turn``: whatever is to come out with its edit, the role second."""
        chosen: dict[int, tuple[int, int, str, int]] = {}
        for start, (cost, rank, _) in self.survivors.items():
            for end, more, edits in ways(start, initial, gone, cut):
                new = cost + more, rank, edits, start
                if end not in chosen or new < chosen[end]:
                    chosen[end] = new
        self._move({end: way for end, way in chosen.items() if not self._hopeless(end, chosen)}, turn)

    def end(self) -> None:
        """Only the best survivor of an allowed end stays, with insertions that lead there."""
        best = None
        for start, (cost, rank, _) in self.survivors.items():
            state = start
            for n in range(3):
                if state in ENDS and (best is None or (cost + n * INSERT, rank, "I" * n) < best[:3]):
                    best = cost + n * INSERT, rank, "I" * n, start
                state = made(state)
        self._move({ENDS[-1]: best}, None)

    def settled(self) -> Iterator[Edit]:
        """The edits that all survivors share, each once; they leave the tree."""
        node = self.root
        while node.refs == 1 and node.kids:
            node = node.kids[0]
            node.parent.kids.clear()
            node.parent = None
            yield node
        self.root = node


SAYS = re.compile(r"[^\x20\x09-\x0D]")


def fault(text: str, copy: int) -> str | None:
    """The first fault of a turn that stands as the ``copy``-th of its role and text."""
    if not SAYS.search(text):
        return "blank"
    if copy > 1:
        return "duplicate"
    return None if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "truncated"


class Rows:
    """Output rows gathered into Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= BATCH or self.bytes >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out


def plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a space for a null role or text, and ``dropped`` false."""
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of ``rows`` (the columns of ``plain``), in order within it.

    One row per edit: conv_id, step (from 1), edit (K keep, R new role, D delete, I
    insert), turn, fault (blank, duplicate, truncated or null), old_role, role and text
    (null where deleted, '' where inserted). A conversation without turns (none, or all
    dropped) has one row with a null edit. Rows of a conversation come out together.
    """
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.select("conv_id", "turn", "role", "text", "dropped").repartition("conv_id")
    rows = rows.withColumn("copy", F.row_number().over(same))
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    kind = dict(rows.dtypes)["conv_id"]
    shape = f"conv_id {kind}, step BIGINT, edit STRING, turn BIGINT, fault STRING, old_role STRING, role STRING, text STRING"

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, conv, step, out = None, None, 0, None

        def leave(found: Iterator[Edit]) -> None:
            nonlocal step
            for e in found:
                step += 1
                number, old, text, wrong = e.turn or (None, None, "", None)
                text = None if e.name == "D" else text
                out.add((conv, step, e.name, number, wrong, old, e.role, text), len(text or ""))

        def finish() -> None:
            if search is None:
                return
            search.end()
            leave(search.settled())
            if not step:
                out.add((conv, None, None, None, None, None, None, None))

        for batch in batches:
            if out is None:
                names = ("conv_id", "step", "edit", "turn", "fault", "old_role", "role", "text")
                kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4)
                out = Rows(pa.schema(list(zip(names, kinds, strict=True))))
            for c, turn, role, text, dropped, copy in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if search is None or c != conv:
                    finish()
                    search, conv, step = Search(), c, 0
                if dropped:
                    continue
                wrong = fault(text, copy)
                search.feed((turn, role, text, wrong), role[:1], wrong in ("blank", "duplicate"), wrong == "truncated")
                leave(search.settled())
                if out.full():
                    yield out.take()
        if out is not None:
            finish()
            yield out.take()

    return rows.mapInArrow(edits, shape)


DIGEST = "gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, audit STRING, repaired_sha256 STRING"


class Digest:
    """Counts and digest of one conversation, fed with its edits in order."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.numbers = 0
        self.low = self.high = self.initial = None
        self.audit, self.sha, self.first = io.StringIO(), hashlib.sha256(), True

    def feed(self, edit: str, turn: int | None, wrong: str | None, old: str | None, role: str | None, text: str | None) -> None:
        self.audit.write(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            if wrong:
                self.faults[wrong] += 1
                self.cost += TRUNCATED * (wrong == "truncated" and edit != "D")
            if self.initial is not None:
                self.illegal += self.initial + old[:1] not in LEGAL
            self.initial = old[:1]
            if turn is not None:
                self.numbers += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
        if edit != "D":
            self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return (gaps, *self.faults.values(), self.illegal, self.cost, self.audit.getvalue(), self.sha.hexdigest())


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s edits, which it reads as they leave: no exchange."""
    names = [x.strip().split()[0] for x in DIGEST.split(",")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, out = None, None, None
        for batch in batches:
            if out is None:
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                out = Rows(pa.schema([("conv_id", batch.schema.field("conv_id").type), *zip(names, kinds, strict=True)]))
            for c, step, edit, turn, wrong, old, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != conv or step in (None, 1):
                    if now is not None:
                        out.add((conv, *now.row()), len(now.audit.getvalue()))
                        if out.full():
                            yield out.take()
                    now, conv = Digest(), c
                if edit is not None:
                    now.feed(edit, turn, wrong, old, role, text)
        if now is not None:
            out.add((conv, *now.row()))
            yield out.take()

    return edits.mapInArrow(fold, f"conv_id {dict(edits.dtypes)['conv_id']}, {DIGEST}")


def damaged(rows: DataFrame) -> DataFrame:
    """The given kinds of damage, by crc32 of ``conv_id:turn`` modulo 20; nulls count as a space."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    rows = plain(rows).withColumn("kind", kind)
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("again"),
    ).drop("again")


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, damaged as above, repaired: counts of faults, edits and a digest of the result."""
    return digests(repair(damaged(table(spark, sf, "conversations"))))
