"""Least-cost repair of conversations so that roles read ``(system? (user assistant)+)?``.

Every turn is kept (cost 0), given another role (1) or deleted (2; blank and duplicate turns must
be), an empty turn may be inserted anywhere (5), and a turn that stays but breaks off costs 5.
The audit is the string of the edits' initials of the cheapest repair, the ASCII-least of several.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any length spreads over
tasks, and are cut into blocks of at most ``BLOCK_ROWS`` rows. A node is a place in a block
together with what the output ends with: nothing, ``s``, ``u`` or ``a``.

1. Cost DP: per block a 4 x 4 matrix of the least costs between its ends. Where a conversation has
   several blocks, min-plus products over 1, 2, 4, ... blocks give the cost from every
   block's end to the conversation's end (one join a round, as many rounds as the logarithm of
   the most blocks).
2. Prefix-doubling path ranking inside blocks: an arc is optimal if its cost and that of its target
   make the cost of its node. Nodes are ranked by their least audit of 1, 2, 4, ... letters;
   a node goes on by the optimal arc with the least (letter, rank of its target), and pointers over
   1, 2, 4, ... arcs spell the path. A letter leads from a node to one node only, so the
   least path of a block depends on its first node alone, and blocks compose as maps of four ends,
   doubled in the same way.
3. Edits are applied per block; a conversation's text is the sequence of its blocks.

Defined results: nulls of any column count as one space (a text of one space is blank); null
conversation ids form one conversation; rows of one turn are ordered by role, then by digest
of the text, repeated rows are duplicates of each other; a table without rows gives none.
Other columns of the input are not read. The input is read twice and must give its rows in the
same order both times, as tables in files do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored

BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
NO = 1 << 40  # a cost no repair reaches
LETTERS = "DIKR"  # in ASCII order
_INSERTED = np.array([USER, USER, ASSISTANT, USER])  # by what the output ends with
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_SPACE = " \t\n\x0b\x0c\r"
_FREE, _CUT, _BLANK, _DUPLICATE = range(4)  # faults

TURN = "struct<role:string,text:string,fault:int>"
BLOCKS = (
    f"conv_id long, part int, seq long, turns array<{TURN}>, first_turn long, last_turn long, "
    "n_turns long, first_role string, last_role string, illegal long, whole boolean, costs array<long>"
)
REPAIRED = "position long, edit string, role string, text string"


# ---- inside a block -------------------------------------------------------------------------


class Nodes:
    """The nodes of many blocks: layer ``offsets[b] + b + i`` of four nodes lies before row ``i``."""

    def __init__(self, turns: list[list[tuple[str, str, int]]]) -> None:
        self.rows = np.array([len(t) for t in turns], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.rows + 1)])
        self.last = self.first[1:] - 1
        n = int(self.first[-1])
        initial, fault = np.full(n, -1), np.full(n, _BLANK)
        at = np.delete(np.arange(n), self.last)
        known = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
        flat = [t for block in turns for t in block]
        initial[at] = [known.get(t[0][:1], -1) for t in flat]
        fault[at] = [t[2] for t in flat]
        ends = np.arange(4)
        stays = fault < _BLANK
        extra = np.where(fault == _CUT, TRUNCATED, 0)[:, None]
        follows = np.array([[0, 1, 1, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]], bool)
        follows[SYSTEM, USER] = follows[USER, ASSISTANT] = follows[ASSISTANT, USER] = True
        keeps = stays[:, None] & (initial >= 0)[:, None] & follows[ends[None, :], initial[:, None]]
        # per row arc: its cost and the end it leads to
        self.arcs = {
            "D": (np.full((n, 4), DELETE), np.broadcast_to(ends, (n, 4))),
            "K": (np.where(keeps, extra, NO), np.broadcast_to(np.maximum(initial, 0)[:, None], (n, 4))),
            "R": (np.where(stays[:, None], REROLE + extra, NO), np.broadcast_to(_INSERTED, (n, 4))),
        }

    def costs(self, final: np.ndarray, inserts_last: np.ndarray) -> np.ndarray:
        """Least cost from every node to the block's end, whose four nodes cost ``final[b]``.

        Where ``inserts_last[b]``, turns may be inserted behind the last row too. ``final`` may carry
        a further axis.
        """
        cost = np.full((int(self.first[-1]), *final.shape[1:]), NO, np.int64)
        own = final.copy()
        own[inserts_last] = self._inserted(final[inserts_last])
        cost[self.last] = own
        for t in range(1, int(self.rows.max(initial=0)) + 1):
            at = self.last[self.rows >= t] - t
            after = cost[at + 1]
            best = None
            for price, target in self.arcs.values():
                p, g = price[at], target[at]
                if final.ndim == 3:
                    p, g = p[..., None], g[..., None]
                way = p + np.take_along_axis(after, np.broadcast_to(g, after.shape), 1)
                best = way if best is None else np.minimum(best, way)
            cost[at] = self._inserted(np.minimum(best, NO))
        return cost

    @staticmethod
    def _inserted(cost: np.ndarray) -> np.ndarray:
        """Costs if empty turns may come first: two in a row at most, as a third gains nothing."""
        for _ in range(2):
            cost = np.minimum(cost, INSERT + cost[:, _INSERTED])
        return np.minimum(cost, NO)

    def optimal(self, cost: np.ndarray, inserts_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every node and letter: the target of the arc, and whether it is on a cheapest way."""
        n = len(cost)
        layer = np.arange(n)[:, None]
        ahead = np.append(cost[1:], np.full((1, 4), NO), 0)
        targets, good = np.empty((n, 4, 4), np.int64), np.zeros((n, 4, 4), bool)
        final = np.zeros(n, bool)
        final[self.last] = True
        for k, letter in enumerate(LETTERS):
            if letter == "I":
                price, end, row, values = INSERT, np.broadcast_to(_INSERTED, (n, 4)), layer, cost
                open_ = ~final
                open_[self.last] = inserts_last
            else:
                price, end = self.arcs[letter]
                row, values, open_ = layer + 1, ahead, ~final
            way = price + np.take_along_axis(values, end, 1)
            targets[:, :, k] = row * 4 + end
            good[:, :, k] = (way == cost) & (cost < NO) & open_[:, None]
        good = good.reshape(-1, 4)
        return np.where(good, targets.reshape(-1, 4), 0), good

    def paths(self, targets: np.ndarray, good: np.ndarray) -> Callable:
        """Ranks the nodes by least audits of doubled lengths and doubles the pointers along them."""
        n = len(targets)
        letters = np.where(good, np.arange(1, 5), 9)
        ends = ~good.any(1)
        letter = np.where(ends, 0, letters.min(1))
        here = np.arange(n)
        longest = 3 * (int(self.rows.max(initial=0)) + 1)

        def pointers(order: np.ndarray) -> np.ndarray:
            chosen = np.take_along_axis(targets, order.argmin(1)[:, None], 1)[:, 0]
            return np.where(ends, here, chosen)

        # a letter leads to one node, so the least letter is a sure first choice
        rank, jump, reach = letter, pointers(letters), 1
        while reach < longest:
            _, rank = np.unique(rank * (n + 1) + rank[jump], return_inverse=True)
            jump, reach = jump[jump], reach * 2
        jump, levels = pointers(letters * (n + 1) + np.where(good, rank[targets], 0)), []
        for _ in range(longest.bit_length()):
            levels.append(jump)
            jump = jump[jump]

        def spell(starts: np.ndarray) -> tuple[list[str], np.ndarray]:
            """Audits from the given nodes, and the nodes where they end."""
            path = np.asarray(starts)[:, None]
            for pointer in levels:
                path = np.concatenate([path, pointer[path]], 1)
                if ends[path[:, -1]].all():
                    break
            names = np.array([0, *map(ord, LETTERS)], np.uint8)[letter[path]]
            return [row.tobytes().rstrip(b"\0").decode() for row in names], path[:, -1]

        return spell


CLOSED = np.array([0, 2 * INSERT, INSERT, 0])  # cost of each end where a conversation is over
_OVER = np.array([0, NO, NO, 0])  # the same without inserts


def _block_costs(turns) -> np.ndarray:
    """4 x 4 least costs of each block, without inserts behind its last row."""
    nodes = Nodes(turns)
    units = np.where(np.eye(4, dtype=bool), 0, NO)
    final = np.broadcast_to(units, (len(turns), 4, 4)).astype(np.int64)
    return nodes.costs(final, np.zeros(len(turns), bool))[nodes.first[:-1]]


def _ways(turns, behind: list) -> tuple[Nodes, Callable, np.ndarray]:
    """``behind[b]``: cost of the four ends after block b; None where the conversation is over."""
    nodes = Nodes(turns)
    over = np.array([x is None for x in behind], bool)
    final = np.array([_OVER if x is None else x for x in behind], np.int64).reshape(-1, 4)
    cost = nodes.costs(final, over)
    return nodes, nodes.paths(*nodes.optimal(cost, over)), cost


def edited(turns: list[tuple[str, str, int]], audit: str, end: int) -> list[tuple[str, str, str]]:
    """``(edit, role, text)`` of every edit, from what the output ends with before the block."""
    out, rows = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)[:2]
        if edit == "D":
            out.append((edit, role, text))
            continue
        end = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]] if edit == "K" else int(_INSERTED[end])
        out.append((edit, role if edit == "K" else _NAMES[end], text))
    return out


# ---- rows and blocks ------------------------------------------------------------------------


def _keyed(turns: DataFrame) -> DataFrame:
    """Turns with a digest of role and text and an order that parts identical rows."""
    return turns.select(
        "conv_id", "turn", "role", "text", "copies",
        F.md5(F.concat_ws("\x1f", F.char_length("role"), "role", "text").cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("nr"),
    )


def _repeats(rows: DataFrame) -> DataFrame:
    """The rows that do not come first among those of equal role and text in a conversation."""
    narrow = rows.where("copies > 0").select("conv_id", "digest", "turn", "role", "nr")
    place = F.struct("turn", "nr")  # nulls are least, as in the order of the rows
    first = narrow.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    first = first.where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    same = narrow["conv_id"].eqNullSafe(first["c"]) & (narrow["digest"] == first["d"])
    return narrow.join(first, same).where(~place.eqNullSafe(F.col("first"))).select(*narrow.columns)


class _Cut:
    """Sorted rows of one task -> blocks. The rows of a block belong to one conversation."""

    def __init__(self, part: int) -> None:
        self.part, self.seq = part, 0
        self.pieces, self.earlier = 0, False  # blocks of this conversation; conversations before it
        self.clear(None)

    def clear(self, conv) -> None:
        self.conv, self.rows, self.size = conv, [], 0
        self.begun = conv is not None
        self.turns: list = []
        self.turn_count, self.last = 0, None

    def block(self, ends: bool = False) -> tuple:
        """The rows so far; ``ends`` if the next row of the task belongs to another conversation."""
        roles = [r[0][:1] for r in self.rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out = (
            self.conv[0], self.part, self.seq, self.rows,
            self.turns[0] if self.turns else None, self.last, self.turn_count,
            roles[0] if roles else None, roles[-1] if roles else None, illegal,
            ends and self.earlier and not self.pieces,
        )
        self.seq, self.pieces = self.seq + 1, self.pieces + 1
        return out

    def add(self, conv, turn, role, text, copies, repeat) -> Iterator[tuple]:
        if not self.begun or self.conv[0] != conv:
            if self.begun:
                yield self.block(ends=True)
                self.pieces, self.earlier = 0, True
            self.clear((conv,))
        for copy in range(copies):
            if len(self.rows) >= BLOCK_ROWS or self.size > BLOCK_BYTES:
                yield self.block()
                self.clear((conv,))
            bare = text.rstrip(_SPACE)
            fault = _BLANK if not bare else _DUPLICATE if repeat or copy else _FREE if bare[-1] in ".!?" else _CUT
            self.rows.append((role, text, fault))
            self.size += len(text)
            if turn is not None and (not self.turns or turn != self.last):
                self.turns = self.turns or [turn]
                self.last, self.turn_count = turn, self.turn_count + 1


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))


def _blocks_batch(blocks: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*blocks))
    costs = _block_costs(columns[3]).reshape(len(blocks), 16)
    names = ("role", "text", "fault")
    kinds = [pa.int64(), pa.int32(), pa.int64(), _TURNS, pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
    columns[3] = [[dict(zip(names, r)) for r in rows] for rows in columns[3]]
    fields = [x.split()[0] for x in re.sub(r"<[^>]*>+", "", BLOCKS).split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip([*columns, costs.tolist()], kinds)], fields
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut, ready, rows, size = _Cut(TaskContext.get().partitionId()), [], 0, 0
    marked = None
    for batch in batches:
        for conv, turn, role, text, copies, nr, marker in zip(*(c.to_pylist() for c in batch.columns)):
            if marker:  # the next row is this one, and is a repeat
                marked = nr
                continue
            rows, size = rows + 1, size + len(text or "")
            ready += cut.add(conv, turn, role, text, copies, marked == nr)
            if ready and (rows >= 8 * BLOCK_ROWS or size >= 4 * BLOCK_BYTES):
                yield _blocks_batch(ready)
                ready, rows, size = [], 0, 0
    if cut.begun:
        ready.append(cut.block())
    if ready:
        yield _blocks_batch(ready)


def _blocks(turns: DataFrame) -> DataFrame:
    """Stored blocks in order, numbered through all tasks."""
    rows = _keyed(turns)
    repeats = _repeats(rows)
    columns = ("conv_id", "turn", "role", "text", "copies", "digest", "nr")
    marks = repeats.select(
        "conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), "digest", "nr",
        F.lit(True).alias("marker"),
    )
    rows = rows.select(*columns, F.lit(False).alias("marker")).unionByName(marks)
    # a mark and its row have equal keys: they are in one partition, the mark first
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "nr")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("marker").desc())
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "nr", "marker")
    blocks = stored(rows.mapInArrow(_cut, BLOCKS), "blocks")
    parts = blocks.groupBy("part").agg(F.max("seq").alias("top"))  # one row per task
    before = F.sum(F.col("top") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(parts), "part").withColumn("nr", F.col("before") + F.col("seq"))


# ---- conversations of several blocks --------------------------------------------------------


def _product(a: Column, b: Column) -> Column:
    def entry(i: Column) -> Column:
        row, col = F.floor(i / 4) * 4, i % 4
        ways = [
            F.element_at(a, (row + j + 1).cast("int")) + F.element_at(b, (col + 4 * j + 1).cast("int"))
            for j in range(4)
        ]
        return F.least(*ways, F.lit(NO))

    return F.transform(F.sequence(F.lit(0), F.lit(15)), entry)


def _composed(a: Column, b: Column) -> Column:
    """The ends after ``b`` of those after ``a``."""
    return F.transform(a, lambda end: F.element_at(b, end + 1))


def _doubled(chain: DataFrame, value: str, combine: Callable, ahead: bool, rounds: int) -> DataFrame:
    """``value`` of every block combined with that of all later (earlier) blocks of its
    conversation: after round k it spans 2^k blocks."""
    for k in range(rounds):
        step = F.lit((1 << k) if ahead else -(1 << k))
        other = chain.select((F.col("nr") - step).alias("nr"), F.col("head").alias("other_head"),
                             F.col(value).alias("other"))
        both = chain.join(other.withColumnRenamed("other_head", "head"), ["nr", "head"], "left")
        ends = (F.col(value), F.col("other")) if ahead else (F.col("other"), F.col(value))
        both = both.withColumn(value, F.when(F.col("other").isNull(), F.col(value)).otherwise(combine(*ends)))
        chain = stored(both.drop("other"), "doubled")
    return chain


def _exits(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The end to which each block's least way leads, from each of the four ends before it."""
    turns = _turns(batch)
    nodes, spell, _ = _ways(turns, batch.column("behind").to_pylist())
    starts = (nodes.first[:-1, None] * 4 + np.arange(4)).ravel()
    ends = (spell(starts)[1] % 4).reshape(-1, 4)
    yield pa.RecordBatch.from_arrays(
        [batch.column("nr"), batch.column("head"), pa.array(ends.tolist(), pa.list_(pa.int32()))],
        ["nr", "head", "exits"],
    )


def _turns(batch: pa.RecordBatch) -> list[list[tuple]]:
    return [[(t["role"], t["text"], t["fault"]) for t in block] for block in batch.column("turns").to_pylist()]


def _batched(work):
    """Slices of a batch with a bounded number of rows inside their blocks."""

    def run(batches):
        for batch in batches:
            sizes = np.cumsum([len(x) + 1 for x in batch.column("turns")])
            at = 0
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                stop = max(int(np.searchsorted(sizes, base + 8 * BLOCK_ROWS, "right")), at + 1)
                yield from work(batch.slice(at, stop - at))
                at = stop

    return run


def _apart(blocks: DataFrame) -> DataFrame:
    """Blocks that are whole conversations: nothing is behind or before them."""
    return blocks.where("whole").select(
        "*", F.col("nr").alias("head"), F.lit(None).cast("array<long>").alias("behind"), F.lit(START).alias("entry")
    )


def _chained(blocks: DataFrame) -> DataFrame:
    """The other blocks, with the cost of the ends behind them and the end before them.

    They belong to long conversations and to those at the borders of tasks.
    """
    edges = blocks.where("NOT whole")
    spans = edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("nr").alias("head"))
    spans = spans.withColumnRenamed("conv_id", "c")
    rounds = (int(spans.agg(F.max("n")).first()[0] or 1) - 1).bit_length()
    several = stored(edges.join(spans, edges["conv_id"].eqNullSafe(spans["c"])).drop("c"), "several")
    chain = _doubled(several.select("nr", "head", "costs"), "costs", _product, True, rounds)
    closed = F.array(*(F.lit(int(x)) for x in CLOSED))
    total = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.least(*(
            F.element_at("costs", (i * 4 + j + 1).cast("int")) + F.element_at(closed, F.lit(j + 1))
            for j in range(4)
        )),
    )
    behind = chain.select((F.col("nr") - 1).alias("nr"), "head", total.alias("behind"))
    several = stored(several.join(behind, ["nr", "head"], "left"), "behind")
    exits = several.select("nr", "head", "turns", "behind").mapInArrow(
        _batched(_exits), "nr long, head long, exits array<int>"
    )
    exits = _doubled(stored(exits, "exits"), "exits", _composed, False, rounds)
    entry = exits.select((F.col("nr") + 1).alias("nr"), "head", F.element_at("exits", START + 1).alias("entry"))
    several = several.join(entry, ["nr", "head"], "left")
    return several.withColumn("entry", F.coalesce("entry", F.lit(START)))


# ---- results --------------------------------------------------------------------------------

_REPAIR = (
    "conv_id long, nr long, head long, first_turn long, last_turn long, n_turns long, first_role string, "
    "last_role string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, "
    "edits array<struct<edit:string,role:string,text:string>>"
)
_EDITS = pa.list_(pa.struct([(c, pa.string()) for c in ("edit", "role", "text")]))


def _repair(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    turns = _turns(batch)
    nodes, spell, cost = _ways(turns, batch.column("behind").to_pylist())
    entry = np.array(batch.column("entry").to_pylist(), np.int64)
    audits, _ = spell(nodes.first[:-1] * 4 + entry)
    costs = cost[nodes.first[:-1], entry]
    faults = [np.bincount([t[2] for t in block], minlength=4) for block in turns]
    edits = [
        [dict(zip(("edit", "role", "text"), e)) for e in edited(*x)] for x in zip(turns, audits, entry.tolist())
    ]
    kept = batch.select(["conv_id", "nr", "head", "first_turn", "last_turn", "n_turns", "first_role",
                         "last_role", "illegal"])
    counts = [pa.array([int(f[k]) for f in faults], pa.int64()) for k in (_BLANK, _DUPLICATE, _CUT)]
    yield pa.RecordBatch.from_arrays(
        [*kept.columns, *counts, pa.array(costs, pa.int64()), pa.array(audits), pa.array(edits, _EDITS)],
        [*kept.schema.names, "blank", "duplicate", "truncated", "cost", "audit", "edits"],
    )


def _as_turns(conversations: DataFrame) -> DataFrame:
    """Nulls of role and text as one space, one copy of each row."""
    space = F.lit(" ")
    return conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), space).alias("role"),
        F.coalesce(conversations["text"].cast("string"), space).alias("text"),
        F.lit(1).alias("copies"),
    )


def _repaired(blocks: DataFrame) -> DataFrame:
    columns = ("conv_id", "nr", "head", "turns", "first_turn", "last_turn", "n_turns", "first_role", "last_role",
               "illegal", "behind", "entry")
    return blocks.select(*columns).mapInArrow(_batched(_repair), _REPAIR)


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id, block, position, edit, role, text``: every edit of every conversation; what is
    not deleted is the repaired conversation, by block and position."""
    prepared(conversations.sparkSession)
    blocks = _blocks(_as_turns(conversations))
    edits = _repaired(_apart(blocks)).unionByName(_repaired(_chained(blocks)))
    return edits.select(
        "conv_id", F.col("nr").alias("block"), F.posexplode("edits").alias("position", "e")
    ).select("conv_id", "block", "position", "e.edit", "e.role", "e.text")


def _damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the contract. Dropped rows stay with zero copies, so that their
    conversation is known."""
    space = F.lit(" ")
    rows = _as_turns(conversations)
    code = F.crc32(
        F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")
    ) % 20
    rows = rows.withColumn("code", code)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 0, None).when(F.col("code") == 1, "")
        .when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )


_JOINED = "conv_id long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of conversations -> audit and digest, read as a stream."""
    def row() -> pa.RecordBatch:
        values = ([conv[0]], ["".join(audit)], [digest.hexdigest()])
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.string(), pa.string()))],
            ["conv_id", "audit", "repaired_sha256"],
        )

    conv = None
    for batch in batches:
        for c, piece, body in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "body"))):
            if conv is None or conv[0] != c:
                if conv is not None:
                    yield row()
                conv, audit, digest, begun = (c,), [], hashlib.sha256(), False
            audit.append(piece)
            if body is not None:
                digest.update((("\n" if begun else "") + body).encode())
                begun = True
    if conv is not None:
        yield row()


def report(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation after the damage of the contract.

    A digest is a chain over the whole text, so the blocks of a long conversation (not its rows)
    meet in one task, which reads them as a stream; conversations of one block do not move.
    """
    stays = F.filter("edits", lambda e: e["edit"] != "D")
    lines = F.transform(stays, lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    body = F.when(F.size(stays) > 0, F.array_join(lines, "\n"))
    sums = ("blank", "duplicate", "truncated", "illegal", "n_turns")
    prepared(conversations.sparkSession)
    blocks = _blocks(_damaged(conversations))
    short = _repaired(_apart(blocks)).withColumn("repaired_sha256", F.sha2(F.coalesce(body, F.lit("")), 256))
    long = stored(_repaired(_chained(blocks)).withColumn("body", body).drop("edits"), "long")
    # what lies across the border of two blocks: rows of an equal turn, pairs of roles
    filled = long.select(
        "nr", "head", "first_turn", "last_turn", "first_role", "last_role"
    )
    counted = long.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in sums),
        F.min("first_turn").alias("first_turn"),
        F.max("last_turn").alias("last_turn"),
        F.min(F.struct("nr", "cost"))["cost"].alias("cost"),
        F.first("head").alias("head"),
    )
    border = _borders(filled)
    counted = counted.join(border, "head", "left")
    counted = counted.withColumn("illegal", F.col("illegal") + F.coalesce("bad", F.lit(0)))
    counted = counted.withColumn("n_turns", F.col("n_turns") - F.coalesce("same", F.lit(0))).drop("bad", "same", "head")
    pieces = long.select("conv_id", "nr", "audit", "body").repartition("conv_id").sortWithinPartitions("conv_id", "nr")
    joined = pieces.mapInArrow(_joined, _JOINED).withColumnRenamed("conv_id", "c")
    counted = counted.join(joined, counted["conv_id"].eqNullSafe(joined["c"])).drop("c")

    rows = short.select(*counted.columns).unionByName(counted)
    gaps = F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")
    return rows.select(
        "conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", "repaired_sha256",
    )


def _borders(blocks: DataFrame) -> DataFrame:
    """Per conversation: borders of blocks inside one turn, and illegal role pairs across borders.

    A block of dropped rows only has neither; it is skipped, so neighbours are found by order.
    """
    full = blocks.where(F.col("first_role").isNotNull())
    order = Window.partitionBy("head").orderBy("nr")
    pair = F.concat(F.lag("last_role").over(order), F.col("first_role"))
    turn = F.lag("last_turn").over(order) == F.col("first_turn")
    full = full.select("head", pair.alias("pair"), turn.alias("turn"))
    return full.groupBy("head").agg(
        F.count_if(~F.col("pair").isin("su", "ua", "au")).alias("bad"), F.count_if("turn").alias("same")
    )
