"""Repair of conversations: cheapest edits that make the roles follow the grammar ``(s?(ua)+)?``.

The turns of a conversation are aligned to the grammar's strings by Wagner-Fischer tables: rows are turns, columns are the numbers of
roles still to be given. The strings of one ending share their tails, so one table holds every feasible length, each as one entry of its
first row. Ukkonen bands keep the cells that a bound from both sides allows under the cost of an alignment known before (the
incumbent); the lengths of the least cost are traced back, and of their audits the ASCII-least is taken.

A conversation may hold any share of all turns. Turns are sorted by ranges of (conversation, turn), so that it is spread over tasks, and
cut into blocks of bounded length, each aligned for every role that may stand before it and at its end. Two streams over a
conversation's blocks join them: backwards the costs to the end (four numbers), forwards the role that stands before.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuetime.llm.common import SPACE, WORD, stored
from issuetime.llm.tokens import blocks as bounded

BLOCK = 256
#: Costs of the edits, and of a truncated turn that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States by what was given last: 0 nothing, 1 system, 2 user, 3 assistant. Inserts that end a conversation in each, and where a role leads.
ENDS = ("", "II", "I", "")
EXPECTED = ("user", "user", "assistant", "user")
_AFTER = {"s": 1, "u": 2, "a": 3}
_GOOD, _FORCED, _CUT = 0, 1, 2


class Alignment(NamedTuple):
    """The least cost between two states, and the ASCII-least of its audits."""

    cost: int
    audit: str


def _emitted(last: int, left: int) -> str:
    """The role given when ``left`` are still to come, the final one being that of the state ``last``."""
    return "au"[(left + last) % 2]


class Table:
    """Costs of aligning the turns from each one on to the ``r`` last roles of the strings that end in state ``last``."""

    def __init__(self, turns: tuple[tuple[str, int], ...], last: int) -> None:
        self.turns, self.last, n = turns, last, len(turns)
        free, cut = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            free[i] = free[i + 1] + (turns[i][1] != _FORCED)
            cut[i] = cut[i + 1] + (turns[i][1] == _CUT)
        least = DELETE * (n - free[0]) + TRUNCATED * cut[0]
        shortest = max(1, free[0])
        slack = max(self._incumbent(free[0], r) for r in (shortest, shortest + 1)) - least  # one begins with each role
        self.rows: list[tuple[int, list]] = [(0, [])] * n + [(0, [0])]
        spared = DELETE - TRUNCATED  # what it costs more to delete a truncated turn than to keep it
        for i in range(n - 1, -1, -1):
            fewer = slack // spared if slack <= cut[i] * spared else cut[i] + (slack - cut[i] * spared) // DELETE
            low, high = max(0, free[i] - fewer), free[i] + slack // INSERT
            role, fault = turns[i]
            below, costs = self.rows[i + 1], []
            for r in range(low, high + 1):
                best = DELETE + self._of(below, r)
                if r:
                    if fault != _FORCED:
                        best = min(best, TRUNCATED * (fault == _CUT) + REROLE * (role != _emitted(last, r)) + self._of(below, r - 1))
                    if costs:
                        best = min(best, INSERT + costs[-1])
                costs.append(best)
            self.rows[i] = low, costs

    def _incumbent(self, free: int, length: int) -> int:
        """Cost of giving turn by turn a string of ``length`` roles, its first inserted if they are more than the turns to keep."""
        cost, left = INSERT * (length - free), free
        for role, fault in self.turns:
            if fault == _FORCED:
                cost += DELETE
            else:
                cost += TRUNCATED * (fault == _CUT) + REROLE * (role != _emitted(self.last, left))
                left -= 1
        return cost

    @staticmethod
    def _of(row: tuple[int, list], r: int) -> float:
        low, costs = row
        return costs[r - low] if 0 <= r - low < len(costs) else float("inf")

    def lengths(self, i: int, first: str) -> list[tuple[float, int]]:
        """Costs of the feasible lengths from turn ``i`` on whose first role is ``first``."""
        low, costs = self.rows[i]
        return [(c, r) for r, c in enumerate(costs, low) if r and _emitted(self.last, r) == first]

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least edits of the cell's cost: at each cell the first possible of D, I, K, R."""
        out = []
        while i < len(self.turns):
            cost, below = self._of(self.rows[i], r), self.rows[i + 1]
            role, fault = self.turns[i]
            if DELETE + self._of(below, r) == cost:
                out.append("D")
                i += 1
            elif r and INSERT + self._of(self.rows[i], r - 1) == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if role == _emitted(self.last, r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def _cheapest(table: Table, first: str, more: list[Alignment] = ()) -> Alignment:
    """The cheapest whole alignment that begins with the role ``first``, or one of ``more``; equal costs by audit."""
    found = table.lengths(0, first)
    least = min([c for c, _ in found] + [a.cost for a in more])
    return min([Alignment(int(c), table.audit(0, r)) for c, r in found if c == least] + [a for a in more if a.cost == least])


def _after_system(turns, table: Table | None) -> list[Alignment]:
    """The cheapest alignments that keep a system turn first, the turns before it deleted; no inserts can stand before it."""
    found = []
    for i, (role, fault) in enumerate(turns):
        if role == "s" and fault != _FORCED:
            here = DELETE * i + TRUNCATED * (fault == _CUT)
            rest = [(DELETE * (len(turns) - i - 1), None)] if table is None else table.lengths(i + 1, "u")
            found += [(here + c, i, r) for c, r in rest]
    least = min((c for c, _, _ in found), default=0)
    return [Alignment(int(c), "D" * i + "K" + ("D" * (len(turns) - i - 1) if r is None else table.audit(i + 1, r))) for c, i, r in found if c == least]


@lru_cache(maxsize=4096)
def align(turns: tuple[tuple[str, int], ...]) -> dict[tuple[int, int], Alignment]:
    """The cheapest alignment of a block of turns, each (initial of the role, fault), for each pair of states before and after it.

    Inserts stand before a turn of the block; those after a conversation's last turn are ``ENDS``.
    """
    gone = Alignment(DELETE * len(turns), "D" * len(turns))
    user, assistant = Table(turns, 2), Table(turns, 3)
    out = {(0, 0): gone, (1, 1): gone}
    if alone := _after_system(turns, None):
        out[0, 1] = min(alone)
    for q, table in ((2, user), (3, assistant)):
        out[0, q] = _cheapest(table, "u", _after_system(turns, table))
        out[1, q] = _cheapest(table, "u")
        out[2, q] = _cheapest(table, "a", [gone] if q == 2 else [])
        out[3, q] = _cheapest(table, "u", [gone] if q == 3 else [])
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with a twentieth of the turns each dropped, emptied, left without sentence ends, repeated or given to
    the user, by the crc32 of ``conv_id:turn``. Nulls in role and text become one space, in that key likewise; null ids and turns stay."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    rows = what.where("what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1))))
    return rows.drop("col")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, id, fault (blank, duplicate, truncated or null) of numbered rows.

    The first of equal turns is found by partial minima, and marked by its number, so that no copies meet in a task."""
    blank, ended = ~F.col("text").rlike(WORD), F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    narrow = rows.select("conv_id", "turn", "role", "id", _digest().alias("digest"), blank.alias("blank"), ended.alias("ended"))
    first = narrow.where("not blank").groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "id")).getField("id").alias("id"))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    return narrow.join(first.select("id", F.lit(True).alias("seen")), "id", "left").select("conv_id", "turn", "role", "digest", "id", fault.alias("fault"))


def _aligned_blocks(faults: DataFrame, block: int) -> DataFrame:
    """conv_id, part, seq (a block's place), ids, cost and audit by 4 * state before + state after (null where none)."""

    def aligned(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, conv, ids, turns = TaskContext.get().partitionId(), 0, None, [], []
        kinds = {"blank": _FORCED, "duplicate": _FORCED, "truncated": _CUT}

        def done():
            nonlocal seq
            found = align(tuple(turns))
            cells = [found.get((p, q)) for p in range(4) for q in range(4)]
            out.append((conv, part, seq, ids, [c and c.cost for c in cells], [c and c.audit for c in cells]))
            seq += 1

        def table():
            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "part", "seq", "ids", "costs", "audits"])

        out, types = [], None
        for batch in batches:
            types = types or (batch.column(0).type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            for c, id_, role, fault in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ids and (c != conv or len(ids) == block):
                    done()
                    ids, turns = [], []
                conv = c
                ids.append(id_)
                turns.append((role[:1], kinds.get(fault, _GOOD)))
            yield table()
            out = []
        if ids:
            done()
            yield table()

    n = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest", "id"]  # nulls first
    kind = dict(faults.dtypes)["conv_id"]
    rows = faults.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "id", "role", "fault")
    return rows.mapInArrow(aligned, f"conv_id {kind}, part int, seq bigint, ids array<bigint>, costs array<bigint>, audits array<string>")


def _edits(found: DataFrame) -> DataFrame:
    """conv_id, part, seq, i, id, edits of every turn: for each state before its block the turn's edits, comma-joined, given the rest of the conversation."""

    def backwards(batches):
        import re

        import pyarrow as pa

        conv, ahead = object(), []
        for batch in batches:
            out = []
            for c, part, seq, ids, costs, audits in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if c != conv:
                    conv, ahead = c, [INSERT * len(x) if x is not None else None for x in ENDS]
                best = [min(((costs[4 * p + q] + ahead[q], audits[4 * p + q]) for q in range(4) if costs[4 * p + q] is not None), default=None) for p in range(4)]
                ahead = [b[0] for b in best]
                pieces = [re.findall("I*[DKR]", b[1]) for b in best]
                out += [(c, part, seq, i, x, ",".join(p[i] for p in pieces)) for i, x in enumerate(ids)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (batch.column(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["conv_id", "part", "seq", "i", "id", "edits"])

    kind, at = dict(found.dtypes)["conv_id"], ["conv_id", F.desc("part"), F.desc("seq")]
    return found.repartition("conv_id").sortWithinPartitions(*at).mapInArrow(backwards, f"conv_id {kind}, part int, seq bigint, i int, id bigint, edits string")


def _clean(turns: DataFrame) -> tuple[DataFrame, str]:
    """The four columns without nulls in role and text, and the type of conv_id: string or bigint."""
    kind = "string" if dict(turns.dtypes)["conv_id"] == "string" else "bigint"
    return turns.select(F.col("conv_id").cast(kind), F.col("turn").cast("bigint"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))), kind


def _ordered(turns: DataFrame, block: int) -> DataFrame:
    """The turns in order, conversation by conversation within each partition, with their faults and edits; deleted ones without text."""
    rows = stored(turns.select("conv_id", "turn", "role", "text").withColumn("id", F.monotonically_increasing_id()), "turns")
    faults = stored(_faults(rows), "faults")
    edits = _edits(stored(_aligned_blocks(faults, block), "blocks")).select("conv_id", "part", "seq", "i", "id", "edits")
    kept = faults.select("id", "fault", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"))
    text = rows.select("id", "turn", "role", "text").join(edits.join(kept, "id").hint("shuffle_hash"), "id")
    text = text.select("conv_id", "part", "seq", "i", "turn", "role", F.when(~F.col("gone"), F.col("text")).alias("text"), "fault", "edits")
    return text.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "i")


_ORDERED = ("conv_id", "i", "turn", "role", "fault", "edits", "text")


def _walked(batches):
    """Each turn in order: whether its conversation begins, the turn's values, the edits it takes, and (edit, role, text) of each of them;
    after a conversation's last turn its final inserts, with None for the turn."""

    def ends(state):
        return [("I", EXPECTED[(state, 2)[k]], "") for k in range(len(ENDS[state]))]

    conv, state, before, begun = None, 0, 0, False
    for values in bounded(batches, _ORDERED):
        for c, i, turn, role, fault, edits, text in zip(*values, strict=True):
            new = not begun or c != conv
            if new:
                if begun:
                    yield False, conv, None, ends(state)
                conv, state, begun = c, 0, True
            if i == 0:
                before = state  # all turns of a block take the edits of the state before it
            out = []
            for e in edits.split(",")[before]:
                given = role if e in "KD" else EXPECTED[state]
                out.append((e, given, text if e in "KR" else None if e == "D" else ""))
                if e != "D":
                    state = _AFTER[given[:1]]
            yield new, conv, (turn, role, fault), out
    if begun:
        yield False, conv, None, ends(state)


def repaired_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), turn (null if inserted), edit (K, R or I), role, text.

    Columns read: conv_id, turn, role, text (others may have any names). Turns are ordered by turn, nulls first, then role, then the text's
    SHA-256; a null conv_id is a conversation of its own; null roles and texts count as one space. Blank turns and later copies of a
    turn's role and text are left out. A conversation that is left without turns gives no rows, nor does an empty table.
    """

    def emitted(batches):
        import pyarrow as pa

        def table():
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "position", "turn", "edit", "role", "text"])

        at, size, out = 0, 0, []
        for new, conv, values, edits in _walked(batches):
            at = 0 if new else at
            for e, role, text in edits:
                if e != "D":
                    out.append((conv, at, values[0] if values and e != "I" else None, e, role, text))
                    at, size = at + 1, size + len(text)
            if size > 1_000_000 or len(out) > 5_000:
                yield table()
                size, out = 0, []
        yield table()

    clean, kind = _clean(turns)
    return _ordered(clean, block).select(*_ORDERED).mapInArrow(emitted, f"conv_id {kind}, position bigint, turn bigint, edit string, role string, text string")


def repair_audits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows as in ``repaired_turns``; a conversation's turns pass one task as a stream, as the digest of its joined texts must, with nothing kept
    of them but the audit, which is one value of at least a character a turn.
    """

    def summed(batches):
        import pyarrow as pa

        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

        def table():
            columns = list(zip(*out, strict=True)) or [()] * 9
            types = (pa.string() if kind == "string" else pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *names, "audit", "repaired_sha256"])

        out, sums, audit = [], {}, []
        for new, conv, values, edits in _walked(batches):
            if new:
                sums, audit, sha, began, last = dict.fromkeys(names, 0), [], hashlib.sha256(), False, None
                low = high = None
            if values:
                turn, role, fault = values
                if fault:
                    sums[fault] += 1
                if last is not None and last + role[:1] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                last = role[:1]
                if turn is not None:
                    if low is None:
                        low = high = turn
                    sums["gaps"] += max(0, turn - high - 1)
                    high = turn
            for e, role, text in edits:
                audit.append(e)
                sums["cost"] += {"I": INSERT, "D": DELETE, "R": REROLE, "K": 0}[e]
                if e != "D":
                    sums["cost"] += TRUNCATED * (e in "KR" and values[2] == "truncated")
                    sha.update(("\n" * began + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    began = True
            if not values:
                out.append((conv, *(min(x, (1 << 63) - 1) for x in sums.values()), "".join(audit), sha.hexdigest()))
                if len(out) == 5_000:
                    yield table()
                    out = []
            elif len(audit) > 10_000:
                audit = ["".join(audit)]
        yield table()

    clean, kind = _clean(turns)
    schema = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _ordered(clean, block).select(*_ORDERED).mapInArrow(summed, schema)


def damaged_and_repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``repair_audits`` of the ``damaged`` table, for every conversation of ``turns``: those left without turns have zeros, an empty audit and the
    digest of an empty string."""
    found = repair_audits(damaged(turns), block).withColumnRenamed("conv_id", "found_id")
    all_ = turns.select("conv_id").distinct()
    zero = {c: F.lit(0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return all_.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select("conv_id", *(F.coalesce(c, z).alias(c) for c, z in zero.items()))
