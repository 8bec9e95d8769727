"""Conversation repair beside a search over whole audits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import conversations
from fleetlens.llm.conversations import AT, START, TAIL, Solver, crossings, forward, last_state

SHAPE = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def apply(audit, rows):
    """(cost, repaired rows) of an audit, or None where it is not allowed. ``rows``: (role, text, fault)."""
    cost, at, out = 0, 0, []
    wanted = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for edit in audit:
        last = out[-1][0][:1] if out else ""
        if edit == "I":
            out.append((wanted.get(last, "user"), ""))
            cost += 5
            continue
        role, text, fault = rows[at]
        at += 1
        if edit == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 5 * (fault == "truncated") + (edit == "R")
        out.append((wanted.get(last, "user") if edit == "R" else role, text))
    if at != len(rows) or not SHAPE.fullmatch("".join(r[:1] or "?" for r, _ in out)):
        return None
    return cost, out


def all_audits(n, inserts):
    if n == 0 and inserts == 0:
        yield ""
    if n:
        for rest in all_audits(n - 1, inserts):
            yield from (edit + rest for edit in "DKR")
    if inserts:
        for rest in all_audits(n, inserts - 1):
            yield "I" + rest


def exhaustive(rows):
    found = []
    for k in range(3):
        for audit in all_audits(len(rows), k):
            done = apply(audit, rows)
            if done:
                found.append((done[0], audit))
    return min(found)


def by_strings(rows):
    """The same by whole strings, one for each state."""
    best = {"": (0, "")}

    def closed(best):
        for _ in range(3):
            for state, (c, a) in list(best.items()):
                to = "a" if state == "u" else "u"
                best[to] = min(best.get(to, (c + 5, a + "I")), (c + 5, a + "I"))
        return best

    for role, _, fault in rows:
        new = {}
        for state, (c, a) in closed(best).items():
            options = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                options.append(("a" if state == "u" else "u", 1 + extra, "R"))
                if role[:1] == "s" and state == "" or role[:1] == "u" and state != "u" or role[:1] == "a" and state == "u":
                    options.append((role[:1], extra, "K"))
            for to, price, edit in options:
                new[to] = min(new.get(to, (c + price, a + edit)), (c + price, a + edit))
        best = new
    return min(v for k, v in closed(best).items() if k in ("", "a"))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        plain = text.rstrip(WHITE)
        fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def codes_of(rows):
    kinds = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
    return tuple(3 * ("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3) + kinds[f] for r, _, f in rows)


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", ""]), "", rng.choice(["", "", "truncated", "blank"])) for _ in range(n)]


def solved(rows, piece):
    """The library's way over pieces of ``piece`` rows."""
    solver, codes = Solver(), codes_of(rows)
    pieces = [codes[i : i + piece] for i in range(0, len(codes), piece)]
    parts = [solver.summary(p) for p in pieces]
    vector = AT[START]
    for part in parts:
        vector, _ = forward(vector, part)
    end = last_state(vector)
    states = crossings(parts, START, end) if parts else [START]
    audit, cost = "", 0
    for i, p in enumerate(pieces):
        a, c, _ = solver.edits(p, [0] * len(p), states[i], states[i + 1])
        audit, cost = audit + a, cost + c
    return cost + 5 * len(TAIL[end]), audit + TAIL[end]


def test_least_audits_of_short_conversations():
    rng = random.Random(2)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(5))
        assert solved(rows, 3) == exhaustive(rows) == by_strings(rows)


@pytest.mark.parametrize("piece", [1, 4, 1000])
def test_least_audits_of_long_conversations(piece):
    rng = random.Random(piece)
    for n in (7, 50, 333):
        for _ in range(15):
            rows = random_rows(rng, n)
            assert solved(rows, piece) == by_strings(rows)


def expected(rows):
    """All columns for one conversation's (turn, role, text), nulls included."""
    def place(r):
        role, text = r[1], r[2]
        name = f"{len(role.encode())}:{role}{text}".encode()
        return (r[0] is not None, r[0] or 0, role[:24], text[:24], hashlib.sha256(name).hexdigest())

    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=place)
    marked = faults([(r, x) for _, r, x in rows])
    cost, audit = by_strings(marked)
    turns = {t for t, _, _ in rows if t is not None}
    left = apply(audit, marked)[1]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, digest)


def test_tables(spark, monkeypatch):
    """Nulls everywhere, repeated rows and turns, ties, a third of all rows in one conversation, small pieces."""
    monkeypatch.setattr(conversations, "PIECE", 7)
    rng = random.Random(9)
    texts = ["Yes.", "Why?", "so", "", " \n", None, "é. ", "long " * 3000 + "end.", "x.\u0085"]
    roles = ["user", "assistant", "system", "", None, "tool", "usher"]
    rows = [(None if c == 0 else c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(40) for _ in range(rng.randrange(1, 9))]
    rows += [(99, n // 2, rng.choice(roles[:3]), f"{rng.randrange(400)}" + rng.choice([".", ""])) for n in range(700)]
    rows += [(98, None, "user", "the same.")] * 150
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(rows, schema).withColumn("units", F.lit(1)).withColumn("range", F.lit("r")).repartition(5)
    got = conversations.repaired_digests(table, table.drop("units")).collect()
    by_conv = {}
    for c, *row in rows:
        by_conv.setdefault(c, []).append(row)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: expected(v) for c, v in by_conv.items()}
    assert len(got) == len(by_conv)


def test_seeded_faults_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "A b! c.") for c in range(60) for t in range(2)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    left = {}
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        left.setdefault(c, []).extend([row] * {0: 0, 3: 2}.get(fault, 1))
    got = conversations.repaired_digests(table, conversations.with_faults(table)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: expected(v) for c, v in left.items()}


def test_an_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired_digests(table, conversations.with_faults(table)).collect() == []
    lost = spark.createDataFrame([(3, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversations.repaired_digests(lost, table).collect()] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "a."), (1, 3, "user", "cut"), (1, 4, "user", "bye.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found, turns = conversations.repair(table)
    assert found.first()["audit"] == "KDKDR"
    left = [(r["role"], r["text"]) for r in turns.orderBy("range", "piece", "at").collect()]
    assert left == [("system", "s."), ("user", "a."), ("assistant", "bye.")]
