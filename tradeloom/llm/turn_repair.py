"""Repair of the turn structure of conversations: the cheapest edits that give an optional system turn and then pairs of
a user's and an assistant's turn (or nothing at all).

A conversation is its rows by turn (nulls first; ties by role, then by a digest of the text; equal rows are rows of
their own). The first fault of a row counts: `blank` (only white space), `duplicate` (role and text of an earlier row),
`truncated` (the last visible character ends no sentence). Edits: K keep, R set the role to user or assistant, D delete
(the only edit of blank and duplicate rows), I insert an empty turn; kept or rerolled truncated rows cost `TRUNCATED`
more. Roles count by their first letter, as it is written.

The decision is one minimum of integers. A weight has the cost in its high digits; the low digits, one byte each, are
the letters of the edits so far from the left, with zeros behind them, so that the smaller integer is the cheaper way
and among equal costs the way whose letters come first. Nodes are (row, state of the roles so far). At a node no way's
letters are the beginning of another's of the same cost, for the rest would be inserts that lead back to the state and
cost more; so the least weight at a node stays least whatever follows, and long conversations are decided in blocks of
`BLOCK` rows.

Only keys, first letters and faults are shuffled for the decision; texts are shuffled once, to be rewritten in the order
of the edits. Both pass as streams: of a conversation a task holds its letters and one block, never its texts. A
conversation is still read by one task, for its edits and its transcript follow one another.

Null roles and texts are one space (a blank row); null ids are one conversation of their own; empty tables give no rows;
columns other than the four are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 256
VISIBLE = "[^\\x20\\x09-\\x0D]"
FAULTS = ("", "blank", "duplicate", "truncated")
#: States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's. Letter -> state -> state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)


def of_role(state: int) -> str:
    """The letter of the turn that may be added after a state, by an insert or a new role."""
    return "a" if state == 2 else "u"


@lru_cache(100_000)
def block_ways(rows: str, start: int, last: bool) -> dict[int, tuple[int, bytes]]:
    """End state -> (cost, letters) of the best way through a block. A row is two characters: the first letter of its
    role, and `x` (to delete), `t` (truncated) or `-`. Inserts come before rows; after them only where `last`."""
    n = len(rows) // 2
    width = 3 * n + 2
    unit = 1 << 8 * width
    best = {start: (0, 0)}  # state -> weight, letters so far

    def add(out: dict[int, tuple[int, int]], state: int, weight: int, letters: int, letter: str, cost: int) -> None:
        weight += cost * unit + (ord(letter) << 8 * (width - 1 - letters))
        if state not in out or weight < out[state][0]:
            out[state] = (weight, letters + 1)

    def inserted(ways: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """At most two inserts in a row: a third would lead back to the state after the first."""
        out, layer = dict(ways), ways
        for _ in range(2):
            after: dict[int, tuple[int, int]] = {}
            for state, (weight, letters) in layer.items():
                add(after, STEPS[of_role(state)][state], weight, letters, "I", INSERT)
            for state, way in after.items():
                if state not in out or way[0] < out[state][0]:
                    out[state] = way
            layer = after
        return out

    for i in range(0, 2 * n, 2):
        role, kind = rows[i], rows[i + 1]
        extra = TRUNCATED if kind == "t" else 0
        out: dict[int, tuple[int, int]] = {}
        for state, (weight, letters) in inserted(best).items():
            add(out, state, weight, letters, "D", DELETE)
            if kind != "x":
                if state in STEPS.get(role, ()):
                    add(out, STEPS[role][state], weight, letters, "K", KEEP + extra)
                add(out, STEPS[of_role(state)][state], weight, letters, "R", REROLE + extra)
        best = out
    if last:
        best = inserted(best)
    return {state: (weight >> 8 * width, (weight & (unit - 1)).to_bytes(width, "big").rstrip(b"\0")) for state, (weight, _) in best.items()}


class Ways:
    """The best way to each state through the rows given so far."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, bytes]] = {0: (0, b"")}

    def block(self, rows: str, last: bool = False) -> None:
        out: dict[int, tuple[int, bytes]] = {}
        for start, (cost, letters) in self.best.items():
            for end, (more, rest) in block_ways(rows, start, last).items():
                way = (cost + more, letters + rest)
                if end not in out or way < out[end]:
                    out[end] = way
        self.best = out

    def result(self) -> tuple[int, bytes]:
        return min(way for state, way in self.best.items() if state in ENDS)


def clean(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest)"""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.md5(text).alias("digest"))


def order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def with_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, fault: index into FAULTS), all rows of a conversation in one partition."""
    text = F.col("text")
    seen = F.expr("row_number() OVER (PARTITION BY conv_id, role, digest ORDER BY turn ASC NULLS FIRST) > 1")
    own = F.when(~text.rlike(VISIBLE), 1).when(text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), 0).otherwise(3)
    keys = clean(turns).select("conv_id", "turn", "role", "digest", own.alias("own")).repartition("conv_id")
    return keys.select("conv_id", "turn", "role", "digest", F.when(F.col("own") == 1, 1).when(seen, 2).otherwise(F.col("own")).alias("fault"))


def conversations_of(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[tuple[object, bool, list[tuple]]]:
    """Rows sorted by their first column -> (its value, whether it is new, some of its rows without it)."""
    now, began = None, False
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            columns = [c.to_pylist() for c in batch.slice(at, most).columns]
            ids, i = columns[0], 0
            while i < len(ids):
                j = i + 1
                while j < len(ids) and ids[j] == ids[i]:
                    j += 1
                new = not began or ids[i] != now
                now, began = ids[i], True
                yield now, new, list(zip(*[c[i:j] for c in columns[1:]]))
                i = j


def decisions(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation with rows."""
    rows = with_faults(turns)
    id_type = rows.schema["conv_id"].dataType
    tiny = rows.sortWithinPartitions(*order()).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        state: dict = {}

        def finish() -> None:
            state["ways"].block("".join(state["rows"]), True)
            cost, letters = state["ways"].result()
            gaps = state["hi"] - state["lo"] + 1 - state["turns"] if state["turns"] else 0
            kept.append((state["id"], gaps, *state["faults"][1:], state["illegal"], cost, letters.decode()))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), fields)], schema=fields)
            kept.clear()
            return out

        fields = None
        for conv, new, part in conversations_of(watched(batches, types := [])):
            fields = fields or pa.schema([("conv_id", types[0]), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
            if new:
                if state:
                    finish()
                if len(kept) >= 4096:
                    yield flush()
                state = {"id": conv, "ways": Ways(), "rows": [], "lo": None, "hi": None, "turns": 0, "faults": [0, 0, 0, 0], "illegal": 0, "before": None}
            for turn, initial, fault in part:
                if turn is not None and turn != state["hi"]:  # sorted: another turn than the last
                    state["lo"], state["hi"], state["turns"] = turn if state["lo"] is None else state["lo"], turn, state["turns"] + 1
                state["faults"][fault] += 1
                state["illegal"] += state["before"] is not None and state["before"] + initial not in ("su", "ua", "au")
                state["before"] = initial
                state["rows"].append((initial if initial in STEPS else "-") + ("x" if fault in (1, 2) else "t" if fault == 3 else "-"))
                if len(state["rows"]) == BLOCK:
                    state["ways"].block("".join(state["rows"]))
                    state["rows"] = []
        if state:
            finish()
        if kept:
            yield flush()

    return tiny.mapInArrow(run, f"conv_id {id_type.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def watched(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[pa.RecordBatch]:
    """The batches as they are; the type of their first column goes to `types`."""
    for batch in batches:
        types[:] = [batch.schema.field(0).type]
        yield batch


def repaired(turns: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv_id, nth, edit, role, text): the turns of each repaired conversation in order, within one partition.

    Each conversation's edits are sorted before its rows, which are then rewritten as they pass.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    none = F.lit(None)
    edits = decided.select("conv_id", F.lit(0).alias("kind"), none.cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    rows = clean(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    both = edits.unionByName(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order()[1:]).select("conv_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []
        for conv, _, part in conversations_of(watched(batches, types), 512):
            out: list[tuple] = []
            for kind, role, text in part:
                if kind == 0:
                    audit, at, nth, state = text, 0, 0, 0
                while at < len(audit):
                    letter = audit[at]
                    if letter != "I" and kind == 0:
                        break
                    at += 1
                    to = role[:1] if letter == "K" else of_role(state)
                    if letter != "D":
                        state, nth = STEPS[to][state], nth + 1
                        out.append((conv, nth, letter, role if letter == "K" else ROLES[to], "" if letter == "I" else text))
                    if letter != "I":
                        while at < len(audit) and audit[at] == "I":  # the inserts up to the next row
                            to, at, nth = of_role(state), at + 1, nth + 1
                            state = STEPS[to][state]
                            out.append((conv, nth, "I", ROLES[to], ""))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [types[0], pa.int64(), pa.string(), pa.string(), pa.string()])], ["conv_id", "nth", "edit", "role", "text"])

    return both.mapInArrow(run, f"conv_id {id_type}, nth bigint, edit string, role string, text string")


def digests(fixed: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text`, newline-joined, of conversations with turns left: a running hash over
    the order that `repaired` leaves."""
    id_type = fixed.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []
        now, hashed, out = None, None, []
        for conv, new, part in conversations_of(watched(batches, types), 512):
            if new:
                if hashed:
                    out.append((now, hashed.hexdigest()))
                now, hashed, between = conv, hashlib.sha256(), b""
            for role, text in part:
                hashed.update(between + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
                between = b"\n"
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [types[0], pa.string()])], ["conv_id", "repaired_sha256"])
                out = []
        if hashed:
            out.append((now, hashed.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [types[0], pa.string()])], ["conv_id", "repaired_sha256"])

    return fixed.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of `conv_id:turn`: 0 drops, 1 empties the text, 2 takes its sentence ends, 3 repeats
    the row, 4 makes the user speak. Nulls are one space, but a null turn stays one."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), harm.alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11(turns: DataFrame, save) -> DataFrame:
    """Each conversation, damaged and repaired; `save` writes the decisions, which are read twice."""
    harmed = damaged(turns)
    decided = save(decisions(harmed))
    hashes = digests(repaired(harmed, decided)).withColumnRenamed("conv_id", "hash_id")
    every = turns.select(F.col("conv_id").alias("every_id")).distinct()
    out = every.join(decided, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("every_id").eqNullSafe(F.col("hash_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("every_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
