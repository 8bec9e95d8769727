"""Conversation structure repair: cheapest edits to an alternating conversation, by Hirschberg's division.

A repaired conversation is empty, or an optional system turn and then user and assistant turns
in alternation. Four states follow it: nothing yet, after the system turn, after a user
turn, after an assistant turn. Every stretch of rows is four by four costs and, for each
state it starts in, the order of the cheapest audits by the state they end in. Audits up to a row end with
that row's own edit, so none of them begins another: their order is the order of any audits that go on from them.

Hirschberg's division finds the states: costs forward from one end and backward from the other meet
in the middle, the cheapest crossing whose audit is least is kept, and both halves go on alone. The same
division works on the rows of a piece and on the pieces of a conversation, so a conversation of any length is
cut into bounded pieces, and only one summary a piece meets the others.
"""

from __future__ import annotations

import hashlib
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.ranges import splitters
from fleetlens.operators.skew import salted_join
from fleetlens.sources.scratch import stored

#: Rows of a piece at most.
PIECE = 1 << 16
#: Characters of role and text that lead the order within a turn.
LEADING = 24
DELETE, INSERT, REROLE, UNTRUNCATED = 2, 5, 1, 5
KEPT_FINE, KEPT_CUT, FORCED = range(3)
#: Conversations of up to so many rows are remembered, and so many of them in a task.
SHORT, REMEMBERED = 32, 1 << 15

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the only turn that may be inserted, or stand for a row, in each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\x0b\x0c\r"
#: By initial (s, u, a) and state: the state after a kept row.
KEEP = {(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}
#: Turns to insert at the end, by the last state.
TAIL = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}

#: Costs by end state, and the place of each end state's audit among the four.
Vector = tuple[tuple[float, ...], tuple[int, ...]]
Summary = tuple[Vector, ...]


def _moves(code: int) -> list[dict[int, tuple[int, str]]]:
    """By start and end state: the cheapest edits around one row, ties to the least audit."""
    initial, kind = divmod(code, 3)
    table = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, inserted = start, 0
        while inserted < 3:
            options = [(state, DELETE, "D")]
            if kind != FORCED:
                fault = UNTRUNCATED if kind == KEPT_CUT else 0
                options.append((NEXT[state], REROLE + fault, "R"))
                if (initial, state) in KEEP:
                    options.append((KEEP[initial, state], fault, "K"))
            for end, cost, edit in options:
                found = (cost + INSERT * inserted, "I" * inserted + edit)
                best[end] = min(best.get(end, found), found)
            state, inserted = NEXT[state], inserted + 1
        table.append(best)
    return table


MOVES = [_moves(code) for code in range(12)]


def _ranked(found: list[tuple]) -> tuple[Vector, float]:
    """Costs and places from (cost, order key) by end state, and what was taken off the costs: the least."""
    order = sorted(range(4), key=lambda e: found[e][1:])
    low = min(f[0] for f in found)
    ranks = [0] * 4
    for place, e in enumerate(order):
        ranks[e] = place
    return (tuple(f[0] - low if low < inf else inf for f in found), tuple(ranks)), low


def _row_summary(code: int) -> Summary:
    out = []
    for start in range(4):
        found = [(*MOVES[code][start].get(e, (inf, "~")), e) for e in range(4)]
        order = sorted(range(4), key=lambda e: found[e][1:])
        out.append((tuple(f[0] for f in found), tuple(order.index(e) for e in range(4))))
    return tuple(out)


ROWS: list[Summary] = [_row_summary(code) for code in range(12)]
#: Where a stretch begins in each state.
AT: list[Vector] = [(tuple(0 if e == s else inf for e in range(4)), tuple(0 if e == s else e + 1 for e in range(4))) for s in range(4)]


def forward(vector: Vector, part: Summary) -> tuple[Vector, float]:
    """Costs and order after ``part``, and the least cost, which is taken off."""
    costs, ranks = vector
    return _ranked([min((costs[p] + part[p][0][e], ranks[p], part[p][1][e]) for p in range(4)) for e in range(4)])


def backward(costs: tuple[float, ...], part: Summary) -> tuple[float, ...]:
    """Costs to go from before ``part``, the least taken off."""
    found = [min(part[p][0][e] + costs[e] for e in range(4)) for p in range(4)]
    low = min(found)
    return tuple(f - low for f in found) if low < inf else tuple(found)


def crossings(parts, start: int, end: int, ahead=forward, back=backward) -> list[int]:
    """The state before each part and after the last, on the cheapest way whose audit is least.

    Linear space: halves wait on a stack, and only the states found are kept.
    """
    states = [start] * len(parts) + [end]
    waiting = [(0, len(parts), start, end)]
    while waiting:
        low, high, s, t = waiting.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector = AT[s]
        for at in range(low, middle):
            vector = ahead(vector, parts[at])[0]
        costs = AT[t][0]
        for at in range(high - 1, middle - 1, -1):
            costs = back(costs, parts[at])
        cross = min(range(4), key=lambda x: (vector[0][x] + costs[x], vector[1][x]))
        states[middle] = cross
        waiting += [(low, middle, s, cross), (middle, high, cross, t)]
    return states


def last_state(vector: Vector) -> int:
    """The state in which a conversation is best ended, turns inserted after it included."""
    return min(range(4), key=lambda e: (vector[0][e] + INSERT * len(TAIL[e]), vector[1][e]))


class Solver:
    """Summaries and edits of pieces, given by the codes of their rows.

    There are few vectors and few short conversations, so steps and results are remembered.
    """

    def __init__(self):
        self._ahead, self._back, self._summaries, self._states = {}, {}, {}, {}

    def ahead(self, vector: Vector, code: int) -> tuple[Vector, float]:
        found = self._ahead.get((vector, code))
        if found is None:
            found = self._ahead[vector, code] = forward(vector, ROWS[code])
        return found

    def back(self, costs: tuple[float, ...], code: int) -> tuple[float, ...]:
        found = self._back.get((costs, code))
        if found is None:
            found = self._back[costs, code] = backward(costs, ROWS[code])
        return found

    def _remembered(self, store: dict, key, codes, make):
        found = store.get(key)
        if found is None:
            found = make()
            if len(codes) <= SHORT and len(store) < REMEMBERED:
                store[key] = found
        return found

    def summary(self, codes: tuple[int, ...]) -> Summary:
        """Costs and orders of a whole piece, from each state."""

        def make():
            out = []
            for start in range(4):
                vector, total = AT[start], 0
                for code in codes:
                    vector, low = self.ahead(vector, code)
                    total += low
                out.append((tuple(c + total for c in vector[0]), vector[1]))
            return tuple(out)

        return self._remembered(self._summaries, codes, codes, make)

    def edits(self, codes: tuple[int, ...], extra, start: int, end: int) -> tuple[str, int, list[tuple[int, str | None]]]:
        """The audit of a piece, its cost, and what is left: (row or -1 for an insertion, new role or None).

        ``extra``: copies of each row that must be deleted after it. In the least audit insertions
        go after deletions, so none stands among such copies.
        """
        states = self._remembered(self._states, (codes, start, end), codes, lambda: crossings(codes, start, end, self.ahead, self.back))
        audit, cost, left = [], 0, []
        for at, code in enumerate(codes):
            price, part = MOVES[code][states[at]][states[at + 1]]
            state = states[at]
            for edit in part:
                if edit in "IR":
                    state = NEXT[state]
                    left.append((at if edit == "R" else -1, ROLE_OF[state]))
                elif edit == "K":
                    left.append((at, None))
            copies = int(extra[at])
            audit.append(part + "D" * copies)
            cost += price + DELETE * copies
        return "".join(audit), cost, left


# ---------------------------------------------------------------- rows


def _key(conv_id: Column) -> Column:
    """Text that names a conversation; null is a conversation like any other."""
    return F.when(conv_id.isNull(), "n").otherwise(F.concat(F.lit("v"), conv_id.cast("string")))


def _rows(conversations: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return conversations.select(
        _key(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
    )


def _units(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, faults, and ``code`` for the automaton."""
    plain = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1)
    units = rows.groupBy("conv", "turn", "digest").agg(
        F.count("*").alias("copies"),
        F.any_value(F.left("role", F.lit(LEADING))).alias("role_lead"),
        F.any_value(F.left("text", F.lit(LEADING))).alias("text_lead"),
        F.any_value(initial.when(F.startswith("role", F.lit("a")), 2).otherwise(3)).alias("initial"),
        F.any_value(plain == "").alias("blank"),
        F.any_value(~F.right(plain, F.lit(1)).isin(*".!?")).alias("cut"),
    )
    units = units.withColumn("has_turn", F.col("turn").isNotNull()).withColumn("at_turn", F.coalesce("turn", F.lit(0)))
    when = F.struct("has_turn", "at_turn")
    firsts = units.groupBy("conv", "digest").agg(F.min(when).alias("first_at"))
    seen = salted_join(units, firsts, ["conv", "digest"], ["at_turn"])
    repeated = F.col("first_at") != when
    kind = F.when(F.col("blank") | repeated, FORCED).when(F.col("cut"), KEPT_CUT).otherwise(KEPT_FINE)
    own = F.when(repeated, F.col("copies")).otherwise(F.col("copies") - 1)
    return seen.select(
        "conv", "turn", "has_turn", "at_turn", "role_lead", "text_lead", "digest", "copies",
        (F.col("initial") * 3 + kind).cast("int").alias("code"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(own).alias("duplicate"),
        F.when(~F.col("blank") & ~repeated & F.col("cut"), 1).otherwise(0).alias("truncated"),
    )


_ORDER = ["conv", "has_turn", "at_turn", "role_lead", "text_lead", "digest"]
_KEYS = "conv string, has_turn boolean, at_turn bigint, role_lead string, text_lead string, digest string"


def _pieces(units: DataFrame) -> DataFrame:
    """``conv, range, piece, units``: the rows of a conversation in order, in pieces of bounded size."""
    cuts = splitters(units, {c: F.col(c) for c in _ORDER}, _KEYS, F.lit(1))
    placed = units.withColumn("range", cuts.range_of(F.struct(*_ORDER)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*_ORDER))
    unit = F.struct("place", "code", (F.col("copies") - 1).alias("extra"), "turn", "digest")
    return (
        placed.withColumn("place", place)
        .withColumn("piece", F.floor((F.col("place") - 1) / PIECE))
        .groupBy("range", "conv", "piece")
        .agg(F.array_sort(F.collect_list(unit)).alias("units"))
    )


def _summaries(pieces: DataFrame) -> DataFrame:
    def run(batches):
        solver = Solver()
        for batch in batches:
            rows = {c: [] for c in ("costs", "ranks", "first", "last", "illegal")}
            for units in batch.column("parts").to_pylist():
                codes, extra = tuple(u["code"] for u in units), [u["extra"] for u in units]
                whole = solver.summary(codes)
                rows["costs"].append([-1 if c == inf else int(c) for v in whole for c in v[0]])
                rows["ranks"].append([r for v in whole for r in v[1]])
                initials = [c // 3 for c in codes]
                pairs = zip(initials, initials[1:], strict=False)
                rows["illegal"].append(sum(extra) + sum((a, b) not in LEGAL for a, b in pairs))
                rows["first"].append(initials[0])
                rows["last"].append(initials[-1])
            out = [pa.array(rows["costs"], pa.list_(pa.int32())), pa.array(rows["ranks"], pa.list_(pa.int32()))]
            out += [pa.array(rows[c], pa.int64()) for c in ("first", "last", "illegal")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "range", "piece")), *out], ["conv", "range", "piece", *rows])

    parts = F.transform("units", lambda u: F.struct(u["code"].alias("code"), u["extra"].alias("extra"))).alias("parts")
    schema = "conv string, range int, piece long, costs array<int>, ranks array<int>, first long, last long, illegal long"
    return pieces.select("conv", "range", "piece", parts).mapInArrow(run, schema)


#: Initials of neighbours that are legal: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _states(summaries: DataFrame) -> DataFrame:
    """``conv, range, piece, start, end, tail, illegal`` from the summaries of each conversation.

    Conversations stream through sorted partitions: a task holds one conversation's summaries, one for
    ``PIECE`` of its rows.
    """
    names = ["conv", "range", "piece", "start", "end", "tail", "illegal"]

    def solve(rows: list[dict]) -> list[tuple]:
        parts = []
        for r in rows:
            costs, ranks = [inf if c < 0 else c for c in r["costs"]], r["ranks"]
            parts.append(tuple((tuple(costs[4 * s : 4 * s + 4]), tuple(ranks[4 * s : 4 * s + 4])) for s in range(4)))
        vector = AT[START]
        for part in parts:
            vector, _ = forward(vector, part)
        end = last_state(vector)
        states = crossings(parts, START, end) if len(parts) > 1 else [START, end]
        out = []
        for i, r in enumerate(rows):
            meets = i > 0 and (rows[i - 1]["last"], r["first"]) not in LEGAL
            tail = TAIL[end] if i == len(rows) - 1 else ""
            out.append((r["conv"], r["range"], r["piece"], states[i], states[i + 1], tail, r["illegal"] + meets))
        return out

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    out += solve(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in solve(held)], schema)

    schema = pa.schema(
        [("conv", pa.string()), ("range", pa.int32()), ("piece", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.string()), ("illegal", pa.int64())]
    )
    ordered = summaries.repartition("conv").sortWithinPartitions("conv", "range", "piece")
    return ordered.mapInArrow(run, "conv string, range int, piece long, start int, end int, tail string, illegal long")


_LEFT = "array<struct<at:int,turn:bigint,digest:string,role:string>>"


def _decisions(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """The edits of each piece: ``audit``, ``cost`` and the turns that are left or inserted."""
    left_type = pa.list_(pa.struct([("at", pa.int32()), ("turn", pa.int64()), ("digest", pa.string()), ("role", pa.string())]))

    def run(batches):
        solver = Solver()
        for batch in batches:
            audits, costs, lefts = [], [], []
            for row in batch.select(["units", "start", "end", "tail"]).to_pylist():
                units = row["units"]
                codes = tuple(u["code"] for u in units)
                audit, cost, left = solver.edits(codes, [u["extra"] for u in units], row["start"], row["end"])
                state = row["end"]
                for _ in row["tail"]:
                    state = NEXT[state]
                    left = [*left, (-1, ROLE_OF[state])]
                audits.append(audit + row["tail"])
                costs.append(cost + INSERT * len(row["tail"]))
                lefts.append(
                    [
                        {"at": n, "turn": None if at < 0 else units[at]["turn"], "digest": None if at < 0 else units[at]["digest"], "role": role}
                        for n, (at, role) in enumerate(left)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "range", "piece", "illegal")), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(lefts, left_type)],
                ["conv", "range", "piece", "illegal", "audit", "cost", "left"],
            )

    joined = pieces.join(states, ["conv", "range", "piece"])
    return joined.mapInArrow(run, f"conv string, range int, piece long, illegal long, audit string, cost long, left {_LEFT}")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a conversation, the repaired turns).

    ``conversations`` has ``conv_id, turn, role, text``; other columns are not read. A null role or text is one
    space, a null turn stands before all others, and a null conv_id is one conversation. Rows of one turn stand by the first
    24 characters of the role, those of the text, and the SHA-256 of ``<bytes of role>:<role><text>``. Repeated rows are
    duplicates. An empty table gives two empty ones.

    The first: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. A row's first fault counts: blank, seen
    earlier in the conversation, or ending in none of ``.!?``. Edits cost: keep 0, new role user or
    assistant 1, delete 2 (a must for blank and repeated rows), insert an empty turn 5; a truncated row that stays 5.
    ``audit`` has the edits' initials, the least of the cheapest.

    The second: ``conv_id, role, text`` and ``range, piece, at``, by which a conversation's turns are ordered.
    """
    rows = _rows(conversations)
    units = stored(_units(rows), "repair_units")
    pieces = stored(_pieces(units), "repair_pieces")
    decided = stored(_decisions(pieces, _states(_summaries(pieces))), "repair_decided")
    faults = units.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    audits = F.transform(F.array_sort(F.collect_list(F.struct("range", "piece", "audit"))), lambda p: p["audit"])
    edited = decided.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(audits, "").alias("audit"))
    kind = conversations.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id")
    by_conversation = faults.join(edited, "conv").select(
        conv_id, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    left = decided.select("conv", "range", "piece", F.explode("left").alias("x")).select(
        "conv", "range", "piece", "x.at", F.col("x.role").alias("new_role"), F.col("x.turn").isNotNull().alias("has_turn"),
        F.coalesce("x.turn", F.lit(0)).alias("at_turn"), "x.digest",
    )
    texts = rows.groupBy("conv", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("at_turn"), "digest").agg(
        F.any_value("role").alias("role"), F.any_value("text").alias("text")
    )
    own = left.filter("digest is not null").join(texts, ["conv", "has_turn", "at_turn", "digest"])
    own = own.select(conv_id, "range", "piece", "at", F.coalesce("new_role", "role").alias("role"), "text")
    added = left.filter("digest is null").select(conv_id, "range", "piece", "at", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return by_conversation, own.union(added)


def digests(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: SHA-256 of each conversation's ``role:text``, joined by newlines.

    Such a digest is read in order: turns stream through sorted partitions, one hash state in memory.
    """

    def run(batches):
        now, state = None, None
        for batch in batches:
            names, found = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != now:
                    if now is not None:
                        names.append(now)
                        found.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found)], ["conv", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    ordered = turns.select(_key(F.col("conv_id")).alias("conv"), "range", "piece", "at", "role", "text")
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "range", "piece", "at")
    return ordered.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def with_faults(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by crc32(``conv_id:turn``) modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 sets its role to user. Nulls are one
    space, in the checksum too, but conv_id and turn stay null.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    damaged = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)).alias("copies"),
    )
    return damaged.select("conv_id", "turn", "role", "text", F.explode("copies")).drop("col")


def repaired_digests(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: ``repair(damaged)``'s columns and ``repaired_sha256``.

    A conversation without a row in ``damaged`` has zeros, an empty audit and an empty text's digest.
    """
    found, turns = repair(damaged)
    found = found.withColumn("conv", _key(F.col("conv_id"))).drop("conv_id")
    every = conversations.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "conv", "left").join(digests(turns), "conv", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
