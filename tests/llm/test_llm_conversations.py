import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lotwise.llm.catalog import op13_repair
from lotwise.llm.conversations import ASSISTANT, START, align, between, cheapest, joined, repair, target, whole

GRAMMAR = re.compile("(s?(ua)+)?")


def plain_best(rows):
    """Cheapest edits by trying all scripts of a short conversation (rows: two characters each), breadth first."""
    n = len(rows) // 2
    best = None
    steps = [(0, "", "", 0)]  # row, audit, initials, cost
    limit = 3 * n
    while steps:
        more = []
        for i, audit, made, cost in steps:
            if cost > limit:
                continue
            if i == n and GRAMMAR.fullmatch(made) and (best is None or (cost, audit) < best):
                best, limit = (cost, audit), cost
            # Nothing that breaks the grammar can be mended by what follows.
            for x in "ua":
                if re.fullmatch("s?(ua)*u?", made + x):
                    more.append((i, audit + "I", made + x, cost + 2))
            if i < n:
                initial, wrong = rows[2 * i], rows[2 * i + 1]
                more.append((i + 1, audit + "D", made, cost + 3))
                if wrong not in "bd":
                    late = wrong == "t"
                    for x in "sua":
                        if re.fullmatch("s?(ua)*u?", made + x) and (x == initial or x != "s"):
                            kept = x == initial
                            more.append((i + 1, audit + ("K" if kept else "R"), made + x, cost + late + (0 if kept else 2)))
        steps = more
    return best


def test_all_short_conversations():
    kinds = [a + b for a, b in itertools.product("suax", "kt")] + ["ub", "ad"]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert whole("".join(rows)) == plain_best("".join(rows)), rows


def test_random_conversations():
    rng = random.Random(5)
    for _ in range(60):
        rows = "".join(rng.choice("suaaux") + rng.choice("kkktbd") for _ in range(rng.randrange(4, 8)))
        assert whole(rows) == plain_best(rows), rows


def test_blocks_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(40):
        rows = "".join(rng.choice("suauax") + rng.choice("kkktbd") for _ in range(24))
        costs = between(rows[:14])
        for part in (rows[14:30], rows[30:]):
            costs = joined(costs, between(part))
        assert min(x for x in (costs[START][START], costs[START][ASSISTANT]) if x) == whole(rows)


def test_band_and_targets():
    assert align("ukak", "ua", 0) == (0, "KK") and align("akuk", "ua", 1) is None
    assert [target(START, ASSISTANT, k) for k in range(6)] == [None, None, "ua", "sua", "uaua", "suaua"]
    assert cheapest("", START, (START,)) == (0, "")


def plain_repair(rows):
    """``(conv, turn, role, text)`` after damage to the result without its id."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = []
    for i, (_, role, text) in enumerate(rows):
        body = text.rstrip(" \t\n\v\f\r")
        seen = any((role, text) == r[1:] for r in rows[:i])
        faults.append("b" if not body else "d" if seen else "k" if body[-1] in ".!?" else "t")
    code = "".join((r[1][:1] if r[1][:1] in set("sua") else "x") + f for r, f in zip(rows, faults))
    cost, audit = whole(code)
    size, lines, at = len(audit) - audit.count("D"), [], iter(rows)
    wanted = "s" * (size % 2) + "ua" * (size // 2)
    names, place = {"u": "user", "a": "assistant"}, 0
    for edit in audit:
        row = None if edit == "I" else next(at)
        if edit == "D":
            continue
        lines.append(f"{row[1]}:{row[2]}" if edit == "K" else f"{names[wanted[place]]}:{row[2] if row else ''}")
        place += 1
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(c) for c in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_results(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return sorted(repr((c, *plain_repair(g))) for c, g in groups.items())


SCHEMA = "conv_id long, turn long, role string, text string"


def some_rows():
    rng = random.Random(8)
    texts = ["", " \n", "Yes.", "No", "Yes.", "How? ", "ñandú!", None]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(7, None, "user", "Yes."), (None, 3, "user", "Hi."), (None, 3, "assistant", "Ho."), (None, None, None, None), (8, None, None, None)]
    return rows + rows[:20]


@pytest.mark.parametrize("block,fan", [(64, 32), (3, 2)])
def test_any_rows(spark, block, fan):
    """With a small block nearly all conversations take the way of the long ones."""
    rows = some_rows()
    frame = spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", c string").repartition(3)
    assert sorted(repr(tuple(r)) for r in repair(frame, block=block, fan=fan).collect()) == plain_results(rows)


def test_a_long_conversation(spark):
    rng = random.Random(9)
    roles = itertools.cycle(["user", "assistant"])
    rows = [(1, t, next(roles) if rng.random() > 0.1 else "user", f"line {rng.randrange(900)}" + rng.choice(["", ".", ".", "."])) for t in range(1500)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    got = {r.conv_id: r for r in repair(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got[2].audit == "KK"
    r, n = got[1], 1500
    assert len(r.audit) - r.audit.count("I") == n
    # The audit is held to the rows it edits: its cost, and what it keeps.
    seen, faults = set(), []
    for _, _, role, text in rows[:n]:
        faults.append("d" if (role, text) in seen else "k" if text[-1] == "." else "t")
        seen.add((role, text))
    assert (r.duplicate, r.truncated) == (faults.count("d"), faults.count("t"))
    size, cost, lines, at, place = len(r.audit) - r.audit.count("D"), 0, [], 0, 0
    for edit in r.audit:
        wanted = ["user", "assistant"][(place - size % 2) % 2]
        if edit == "I":
            cost, place = cost + 2, place + 1
            lines.append(f"{wanted}:")
            continue
        _, _, role, text = rows[at]
        cost += {"K": 0, "R": 2, "D": 3}[edit] + (edit != "D" and faults[at] == "t")
        if edit != "D":
            assert faults[at] != "d" and (edit == "R" or role == wanted)
            lines.append(f"{wanted}:{text}")
            place += 1
        at += 1
    assert cost == r.cost and hashlib.sha256("\n".join(lines).encode()).hexdigest() == r.repaired_sha256
    states = {0: 0, 2: 10**9, 3: 10**9}  # least cost by state: start, after user, after assistant
    for (_, _, role, _), wrong in zip(rows[:n], faults):
        states[3] = min(states[3], states[2] + 2, states[0] + 4)
        states[2] = min(states[2], states[0] + 2, states[3] + 2)
        late = 10**9 if wrong == "d" else wrong == "t"
        states = {
            0: states[0] + 3,
            2: min(states[2] + 3, min(states[0], states[3]) + late + (0 if role == "user" else 2)),
            3: min(states[3] + 3, states[2] + late + (0 if role == "assistant" else 2)),
        }
    assert r.cost == min(states[0], states[3], states[2] + 2)


def test_query(spark, sf):
    rows = []
    every = set()
    for conv, turn, role, text in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        every.add(conv)
        how = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        rows += [(conv, turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    got = {r.conv_id: r for r in op13_repair(spark, sf).collect()}
    assert set(got) == every
    left = {r[0] for r in rows}
    assert sorted(repr(tuple(got[c])) for c in left) == plain_results(rows)
    for c in every - left:
        assert tuple(got[c]) == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_absent_and_no_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA)
    assert tuple(repair(frame, times=F.lit(0)).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair(frame.limit(0)).collect() == []
