"""Repair the structure of conversations: the cheapest edits that give alternating turns.

The role initials of a repaired conversation read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn. Rows are kept, get another role, or go; empty turns may be put anywhere. For each length the
grammar allows there is one target string; the rows are aligned to it as by Wagner and Fischer. The cheapest
cost so far bounds both the lengths that are tried and, as Ukkonen's band, the cells of each table: a cell
counts only if the deletions or insertions that lead to it and from it do not cost more. Among equal costs the
audits, the initials of the edits read back from the table, decide: the least in ASCII.

A task streams the conversations of its partition in order and holds one at a time, at most ``block`` rows. A longer
conversation is cut into blocks of so many rows. Each block is aligned to the targets from every state of the
grammar to every other (start, after system, after user, after assistant), which gives a table of costs and audits;
tables are joined along the conversation, ``fan`` at a time. The texts of its result are hashed in a second,
streaming pass. Its audit is one value, as the result asks for, so it must fit into memory.

Faults: a row without any but white-space characters is blank; one whose role and text stood before is a
duplicate; one that does not end in a full stop, exclamation or question mark is truncated. The first that
holds counts. Blank rows and duplicates must go.

Defined cases: a missing role or text is one space; missing turns stand first, equal turns in the order of role and
text; a missing conversation id is a conversation; a role without a known initial (an empty one too) can only get
another role or go; a conversation whose rows are all absent has zeros and empty texts; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lotwise.functions.joins import lookup_join
from lotwise.llm.ranks import positions
from lotwise.session import via_table

BLOCK = 64
FAN = 32
BLANKS = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, UNENDED = 3, 2, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)


def fault(text: str, seen: bool) -> str:
    """``b``lank, ``d``uplicate, ``t``runcated or ``k``: none."""
    body = text.rstrip(BLANKS)
    if not body:
        return "b"
    if seen:
        return "d"
    return "k" if body[-1] in ".!?" else "t"


def target(entry: int, leave: int, length: int) -> str | None:
    """The one string of ``length`` initials that leads from state ``entry`` to ``leave``, if there is one."""
    if leave in (START, SYSTEM):
        if entry == leave:
            return "" if length == 0 else None
        return "s" if (entry, leave, length) == (START, SYSTEM, 1) else None
    # The turns before ``leave`` alternate; the first must follow ``entry``.
    turns = "".join("ua"[(leave - USER - length + 1 + i) % 2] for i in range(length))
    if entry in (USER, ASSISTANT):
        return turns if (turns[0] == "ua"[entry == USER] if turns else entry == leave) else None
    if not turns:
        return None
    if turns[0] == "u":
        return turns
    # One too many for turns alone: after the start a system turn takes the first place.
    return "s" + turns[1:] if entry == START and length > 1 else None


def align(rows: str, wanted: str, limit: int) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits that turn ``rows`` into ``wanted``, ``None`` if above ``limit``.

    ``rows`` has two characters a row: its initial and its fault.
    """
    n, m = len(rows) // 2, len(wanted)
    apart = m - n
    spare = limit - (INSERT * apart if apart > 0 else -DELETE * apart)
    if spare < 0:
        return None
    # The band: every further step off the straight way costs a deletion and an insertion.
    low, high = min(0, apart) - spare // (DELETE + INSERT), max(0, apart) + spare // (DELETE + INSERT)
    far = limit + 1
    costs: list[dict[int, int]] = [{} for _ in range(n + 1)]

    def change(i: int, j: int) -> int:
        initial, wrong = rows[2 * i], rows[2 * i + 1]
        if wrong in "bd":
            return far
        late = UNENDED if wrong == "t" else 0
        return late if initial == wanted[j] else far if wanted[j] == "s" else REROLE + late

    for i in range(n, -1, -1):
        here, below = costs[i], costs[i + 1] if i < n else {}
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = 0 if i == n and j == m else far
            if i < n:
                best = min(best, below.get(j, far) + DELETE)
                if j < m:
                    best = min(best, below.get(j + 1, far) + change(i, j))
            if j < m and wanted[j] != "s":
                best = min(best, here.get(j + 1, far) + INSERT)
            here[j] = best
    if costs[0].get(0, far) > limit:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:  # the least edit that stays on a cheapest way
        left = costs[i][j]
        if i < n and costs[i + 1].get(j, far) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and wanted[j] != "s" and costs[i].get(j + 1, far) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[2 * i] == wanted[j] else "R")
            i, j = i + 1, j + 1
    return costs[0][0], "".join(audit)


def cheapest(rows: str, entry: int, leaves: tuple[int, ...]) -> tuple[int, str] | None:
    """The least ``(cost, audit)`` over all lengths that lead from ``entry`` to one of ``leaves``."""
    n, best = len(rows) // 2, None
    limit = DELETE * n + INSERT * 3  # all rows go; three turns lead from any state to any that can be reached
    for apart in sorted(range(-n, limit // INSERT + 1), key=lambda d: INSERT * d if d > 0 else -DELETE * d):
        if (INSERT * apart if apart > 0 else -DELETE * apart) > limit:
            break
        for leave in leaves:
            wanted = target(entry, leave, n + apart)
            found = None if wanted is None else align(rows, wanted, limit)
            if found and (best is None or found < best):
                best, limit = found, found[0]
    return best


@lru_cache(1 << 16)
def whole(rows: str) -> tuple[int, str]:
    return cheapest(rows, START, (START, ASSISTANT))


@lru_cache(1 << 12)
def between(rows: str) -> list[list[tuple[int, str] | None]]:
    """``[entry][leave]``: the cheapest edits of a block from each state to each."""
    return [[cheapest(rows, entry, (leave,)) for leave in range(4)] for entry in range(4)]


def joined(first: list, then: list) -> list:
    """The table of two neighbouring blocks. Equal costs of the same rows never have one audit begin another."""
    return [
        [
            min(
                ((a[0] + b[0], a[1] + b[1]) for a, b in zip(first[e], (row[x] for row in then)) if a and b),
                default=None,
            )
            for x in range(4)
        ]
        for e in range(4)
    ]


class Writer:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        self.place += 1
        return ROLES["ua"[(self.place - 1 - self.system) % 2]]

    def inserted(self) -> Iterator[str]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield f"{self._role()}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place += 1
            yield f"{role}:{text}"
        elif edit == "R":
            yield f"{self._role()}:{text}"


class _Hash:
    """SHA-256 of lines joined by line feeds."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, lines: Iterator[str]) -> None:
        for line in lines:
            self.sha.update((line if self.empty else "\n" + line).encode())
            self.empty = False


def _code(role: str, wrong: str) -> str:
    return (role[:1] if role[:1] in ("s", "u", "a") else "x") + wrong


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


_COUNTS = ("blank", "duplicate", "truncated")
_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _short(rows: list[tuple]) -> tuple:
    """The result of one conversation from its ``(turn, role, text)`` in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = whole("".join(_code(role, wrong) for (_, role, _), wrong in zip(rows, faults)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    writer, sha = Writer(audit), _Hash()
    for _, role, text in rows:
        sha.add(writer.row(role, text))
    sha.add(writer.inserted())
    counts = [faults.count(c) for c in "bdt"]
    return gaps, *counts, _illegal([r[:1] for _, r, _ in rows]), cost, audit, sha.sha.hexdigest()


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """``(key of the group, is its first row, other values)`` of rows that stand group by group."""
    last: object = object()
    for batch in batches:
        for key, *values in zip(*(batch.column(c).to_pylist() for c in names)):
            yield key, key != last, values
            last = key


def _streamed(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    rows: list[tuple] = []
    name = None

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    started = False
    for _, new, (conv, live, turn, role, text) in _groups(batches, ["c", "conv", "live", "turn", "role", "text"]):
        if new and started:
            out.append((name, *_short(rows)))
            rows = []
            if len(out) >= 4096:
                yield packed()
                out = []
        started, name = True, conv
        if live:
            rows.append((turn, role, text))
    if started:
        out.append((name, *_short(rows)))
    yield packed()


def _summary(table: pa.Table, block: int) -> pa.Table:
    rows = table.sort_by("pos").to_pylist()
    faults = [fault(r["text"], r["seen"]) for r in rows]
    initials = [r["role"][:1] for r in rows]
    costs = between("".join(_code(r["role"], f) for r, f in zip(rows, faults)))
    counts = {name: [faults.count(c)] for name, c in zip(_COUNTS, "bdt")}
    return _table(rows[0]["c"], rows[0]["pos"] // block, counts, _illegal(initials), initials[0], initials[-1], costs)


def _table(c: str, block: int, counts: dict, illegal: int, first: str, last: str, costs: list) -> pa.Table:
    flat = [x for row in costs for x in row]
    return pa.table(
        {
            "c": [c],
            "block": [block],
            **counts,
            "illegal": [illegal],
            "first": [first],
            "last": [last],
            "costs": pa.array([[x and x[0] for x in flat]], pa.list_(pa.int64())),
            "audits": pa.array([[x and x[1] for x in flat]], pa.list_(pa.string())),
        }
    )


_BLOCKS = (
    "c string, block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " first string, last string, costs array<bigint>, audits array<string>"
)


def _merged(table: pa.Table, fan: int) -> pa.Table:
    rows = table.sort_by("block").to_pylist()
    tables = []
    for r in rows:
        cells = [None if cost is None else (cost, audit) for cost, audit in zip(r["costs"], r["audits"])]
        tables.append([cells[4 * e : 4 * e + 4] for e in range(4)])
    costs = tables[0]
    for t in tables[1:]:
        costs = joined(costs, t)
    counts = {name: [sum(r[name] for r in rows)] for name in _COUNTS}
    illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
    return _table(rows[0]["c"], rows[0]["block"] // fan, counts, illegal, rows[0]["first"], rows[-1]["last"], costs)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every conversation, whose first row brings its audit."""
    name, writer, sha, out = None, Writer(""), _Hash(), []
    for key, new, (audit, role, text) in _groups(batches, ["c", "audit", "role", "text"]):
        if new:
            if name is not None:
                sha.add(writer.inserted())
                out.append((name, sha.sha.hexdigest()))
            name, writer, sha = key, Writer(audit), _Hash()
        sha.add(writer.row(role, text))
    if name is not None:
        sha.add(writer.inserted())
        out.append((name, sha.sha.hexdigest()))
    yield pa.RecordBatch.from_pydict(
        {"c": pa.array([x[0] for x in out], pa.string()), "repaired_sha256": pa.array([x[1] for x in out], pa.string())}
    )


def _long(rows: DataFrame, block: int, fan: int) -> DataFrame:
    """The results of conversations that are longer than a block (``c`` and the columns of the result)."""
    placed = via_table(
        positions(rows.withColumn("sha", F.sha2("text", 256)), "c", ["turn", "role", "text"]).drop("total"), "placed"
    )
    first = placed.groupBy("c", "role", "sha").agg(F.min("pos").alias("first"))
    placed = via_table(
        lookup_join(placed, first, ["c", "role", "sha"], "inner", spread_by=F.xxhash64("pos"))
        .withColumn("seen", F.expr("pos > first"))
        .drop("first", "sha"),
        "placed",
    )
    blocks = placed.select("c", "pos", "role", "text", "seen").groupBy("c", F.expr(f"pos div {block}"))
    merged = via_table(blocks.applyInArrow(lambda t: _summary(t, block), _BLOCKS), "blocks")
    while merged.agg(F.max("block")).first()[0]:
        near = merged.groupBy("c", F.expr(f"block div {fan}"))
        merged = via_table(near.applyInArrow(lambda t: _merged(t, fan), _BLOCKS), "blocks")
    # From the start (the first four cells) to the start or to after an assistant.
    ends = [F.struct(F.col("costs")[x].alias("cost"), F.col("audits")[x].alias("audit")) for x in (START, ASSISTANT)]
    best = F.array_min(F.filter(F.array(*ends), lambda e: e["cost"].isNotNull()))
    merged = via_table(merged.withColumn("best", best).select("c", *_COUNTS, "illegal", "best.*"), "best")
    gaps = placed.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    audits = merged.select("c", F.lit(0).cast("long").alias("pos"), "audit")
    ready = placed.select("c", "pos", "role", "text").join(audits, ["c", "pos"], "left")
    digests = ready.repartition("c").sortWithinPartitions("c", "pos").mapInArrow(_hashed, "c string, repaired_sha256 string")
    return merged.join(gaps, "c").join(digests, "c")


def repair(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    times: Column | None = None,
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """A row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    A row stands ``times`` times (once if not given); one that stands zero times only names its conversation.
    """
    conv = F.col(f"`{conv_id}`")
    space = F.lit(" ")
    base = rows.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("c"),
        conv.alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
        F.coalesce(F.lit(1) if times is None else times.cast("int"), F.lit(1)).alias("times"),
    )
    sizes = base.groupBy("c").agg(F.sum("times").alias("size")).where(f"size > {block}")
    sizes = via_table(sizes, "long")
    schema = base.schema["conv"].dataType.simpleString()
    copies = F.explode(F.array_repeat(F.expr("times > 0"), F.greatest("times", F.lit(1)))).alias("live")
    base = base.select("c", "conv", "turn", "role", "text", copies)
    numbers = [(n, pa.int64()) for n in ("gaps", *_COUNTS, "illegal", "cost")]
    kind = pa.schema([("conv_id", to_arrow_type(base.schema["conv"].dataType)), *numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    some = sizes.count() > 0
    marked = lookup_join(base, sizes, ["c"], spread_by=F.xxhash64("turn", "text")) if some else base
    short = marked.where("size IS NULL").drop("size") if some else marked
    done = (
        short.repartition("c")
        .sortWithinPartitions("c", "turn", "role", "text")
        .mapInArrow(lambda batches: _streamed(kind, batches), f"conv_id {schema}, {_RESULT}")
    )
    if not some:
        return done
    marked = via_table(marked.where("size IS NOT NULL"), "long")
    names = marked.groupBy("c").agg(F.first("conv").alias("conv_id"))
    more = _long(marked.where("live").drop("size", "live", "conv"), block, fan).join(names, "c").select(*done.columns)
    return done.unionByName(more)

