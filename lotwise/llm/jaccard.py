"""Classes of texts whose sets of word n-grams are similar: an exact Jaccard self-join behind prefix filters.

A document is the set of its distinct ``shingle``-word runs, as 64-bit hashes; fewer words are one shingle.
Two sets with ``percent`` % in common share an entry among the first ``n - ceil(percent * n / 100) + 1`` of each,
in any fixed order. Entries stand in the order of the number of documents that have them, rare ones first, so
most prefixes consist of entries that no other document has, and such a document is settled.

The numbers are exact and cost two narrow shuffles: a slice of documents sends its entries, 32 bits each, to the
part of the hash space they belong to; a part counts them and answers with those that stand elsewhere too. Parts
hold ``PART_BYTES`` of text at any size of the corpus. The slice then knows the first entries of its documents
and their positions, and shared prefix entries are compared in rounds:

* In a leader round the members of an entry meet its leader, the set with the fewest rarer entries (among
  copies with edits of their own that is the least edited one), so a round has a row per member, not per
  pair. Pairs that fail the length, positional or suffix filter go; the others are verified, each once.
* Sets around the same middle of verified links are one class. An entry whose members are all in one is settled.
* When little is left, or a round has not halved the pairs between classes, every remaining pair of an entry whose sets are in different
  classes meets in an equality join on the entry and two length classes, behind the filters and not yet
  verified. An entry with very many members is cut into blocks that meet two by two.

So pairs inside a class are never all formed, and no pair that could connect two classes is left out.
The suffix filter compares the parities of sizes in ``WIDTH`` hash ranges: no two sets differ in fewer entries than
in parities. Verification fetches both sets, bounds the overlap by their sizes in sixteen hash ranges and counts it
only where that bound suffices.

Defined cases: a missing or wordless text has no shingles and links with nothing, its class is its own id; a
missing ``doc_id`` has a class but never names it; repeated rows are all kept; no rows give no rows; other
columns are ignored. Sets that cannot have a different partner (fewer than ``percent / (100 - percent)``
entries) only link with equal ones. Equality of shingles and of sets is that of 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.components import components
from lotwise.llm.substrings import bitmap
from lotwise.llm.text import FIRST, LOWER, SECOND, THIRD, Words, mixed, rolling, slices
from lotwise.session import via_table

PART_BYTES = 8 << 20
FILTER_BITS = 26
LEADER_ROUNDS = 4
BLOCK = 512
WIDTH = 512
_LOWER = np.frombuffer(LOWER, np.uint8)
_DOCUMENT, _SLICE, _ENTRIES = range(3)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct hashes)`` of every row; no words give an empty set."""
    for first, data, offsets in slices(column):
        words = Words(_LOWER[data], offsets)
        hashes = words.hashes()
        rolled = rolling(hashes, shingle)
        for d, (low, high) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
            if high - low >= shingle:
                own = np.sort(rolled[low : high - shingle + 1])
                yield first + d, own[np.append(True, own[1:] != own[:-1])]
            else:
                # Too short for a shingle: one entry, named by all words and their number.
                one = np.array([high - low], np.uint64)
                for h in hashes[low:high]:
                    one = mixed(one * np.uint64(THIRD) + h)
                yield first + d, one[: high - low]


def _set_id(own: np.ndarray) -> int:
    total = mixed(own ^ np.uint64(SECOND)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own) * FIRST % (1 << 64))
    return int(mixed(total).view(np.int64)[0])


def _rows(kind: int, schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """A batch of one kind of rows; columns that are not given are missing."""
    columns["kind"] = pa.array(np.full(size, kind, np.int32))
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema
    )


def _sent(docs: DataFrame, text: Column, doc_id: Column, shingle: int, percent: int, parts: int) -> DataFrame:
    """Rows of three kinds: every document with the id and size of its set; every slice of documents with the ids
    and sizes of its different sets; and for every slice and part the entries that belong there, with their number
    per set."""
    kept = docs.select(doc_id.alias("doc_id"), text.cast("string").alias("t"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schema = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("kind", pa.int32()), ("doc_id", batch.schema.field("doc_id").type), *_SENT])
            ids, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, sets in _sliced(batch.column("t"), shingle):
                own: dict[int, np.ndarray] = {}
                for row, entries in enumerate(sets, first):
                    n = sizes[row] = len(entries)
                    ids[row] = _set_id(entries)
                    if n * (100 - percent) >= percent:
                        own[ids[row]] = entries
                if not own:
                    continue
                number += 1
                lengths = np.array([len(x) for x in own.values()], np.int64)
                names = np.array(list(own), np.int64)
                yield _rows(
                    _SLICE, schema, 1, slice=pa.array([number]), part=pa.array([number % parts]),
                    sets=pa.array([names.tobytes()]), entries=pa.array([lengths.tobytes()]),
                )
                entries, of = np.concatenate(list(own.values())), np.repeat(np.arange(len(own)), lengths)
                part = ((entries >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                low, of = entries[order].astype(np.uint32), of[order].astype(np.uint32)
                used, begins = np.unique(part[order], return_index=True)
                ends = [*begins[1:].tolist(), len(part)]
                cut = list(zip(begins.tolist(), ends))
                yield _rows(
                    _ENTRIES, schema, len(used), slice=pa.array(np.full(len(used), number)), part=pa.array(used),
                    sets=pa.array([np.bincount(of[a:b], minlength=len(own)).astype(np.uint32).tobytes() for a, b in cut]),
                    entries=pa.array([low[a:b].tobytes() for a, b in cut]),
                )
            if batch.num_rows:
                yield _rows(
                    _DOCUMENT, schema, batch.num_rows, doc_id=batch.column("doc_id"), id=pa.array(ids), n=pa.array(sizes),
                    part=pa.array(np.arange(batch.num_rows) % parts),
                )

    return kept.mapInArrow(emit, f"kind int, doc_id {kept.schema['doc_id'].dataType.simpleString()}, {_SENT_DDL}")


_SENT = [
    ("id", pa.int64()), ("n", pa.int64()), ("slice", pa.int64()), ("part", pa.int64()),
    ("sets", pa.binary()), ("entries", pa.binary()), ("counts", pa.binary()),
]
_SENT_DDL = "id bigint, n bigint, slice bigint, part bigint, sets binary, entries binary, counts binary"


def _sliced(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sets)`` of consecutive rows with a bounded number of entries."""
    first, sets, size = 0, [], 0
    for row, own in shingle_sets(column, shingle):
        sets.append(own)
        size += len(own)
        if size > 1 << 19:
            yield first, sets
            first, sets, size = row + 1, [], 0
    if sets:
        yield first, sets


def _counted(sent: DataFrame, parts: int) -> DataFrame:
    """The same rows, with the entries cut down to those that several sets or slices have, and their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            schema = batch.schema
            kind = np.asarray(batch.column("kind"))
            rest = batch.filter(pa.array(kind != _ENTRIES))
            if rest.num_rows:
                yield rest
            found = batch.filter(pa.array(kind == _ENTRIES))
            for number, part, sets, entries in zip(*(found.column(c).to_pylist() for c in ("slice", "part", "sets", "entries"))):
                held.setdefault(part, []).append((number, np.frombuffer(sets, np.uint32), np.frombuffer(entries, np.uint32)))
        for part, messages in held.items():
            every, numbers = np.unique(np.concatenate([m[2] for m in messages]), return_counts=True)
            numbers = np.minimum(numbers, (1 << 32) - 1).astype(np.uint32)
            out = []
            for number, sizes, entries in messages:
                times = numbers[np.searchsorted(every, entries)]
                at = np.flatnonzero(times > 1)
                if len(at):
                    of = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
                    out.append((number, of[at].tobytes(), entries[at].tobytes(), times[at].tobytes()))
            if out:
                columns = [pa.array(c) for c in zip(*out)]
                yield _rows(
                    _ENTRIES, schema, len(out), slice=columns[0], part=pa.array(np.full(len(out), part)),
                    sets=columns[1], entries=columns[2], counts=columns[3],
                )

    return sent.repartition(parts, "part").mapInArrow(count, sent.schema)


def _prefixes(counted: DataFrame, percent: int) -> DataFrame:
    """``token, pos, id, n``: the prefix entries that stand in other documents too."""

    def first(table: pa.Table) -> pa.Table:
        ids = sizes = np.empty(0, np.int64)
        of, token, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for kind, part, sets, entries, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "sets", "entries", "counts"))):
            if kind == _SLICE:
                ids, sizes = np.frombuffer(sets, np.int64), np.frombuffer(entries, np.int64)
            else:
                of.append(np.frombuffer(sets, np.uint32).astype(np.int64))
                token.append(np.frombuffer(entries, np.uint32).astype(np.int64) | (part << 32))
                times.append(np.frombuffer(counts, np.uint32).astype(np.int64))
        of, token, times = map(np.concatenate, (of, token, times))
        order = np.lexsort((token, times, of))
        of, token = of[order], token[order]
        shared = np.bincount(of, minlength=len(sizes))
        # Entries of no other document come first; they take places but can meet nobody.
        pos = np.arange(len(of)) - (np.cumsum(shared) - shared)[of] + (sizes - shared)[of]
        prefix = sizes - -(-percent * sizes // 100) + 1
        at = np.flatnonzero(pos < prefix[of])
        return pa.table({"token": token[at], "pos": pos[at], "id": ids[of[at]], "n": sizes[of[at]]})

    return counted.groupBy("slice").applyInArrow(first, "token bigint, pos bigint, id bigint, n bigint")


def _needed(percent: int) -> Column:
    """The least overlap of two sets of ``n`` and ``m`` entries that are similar enough."""
    return F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")


def _possible(percent: int) -> Column:
    """Length filter, positional filter at a shared entry (``pos`` of ``n``, ``at`` of ``m``), and suffix filter: the
    sets differ in at least as many entries as their ``WIDTH`` parities (``s0 ..``, ``t0 ..``) do."""
    length = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    place = F.expr("least(pos, at) + 1 + least(n - pos - 1, m - at - 1)") >= _needed(percent)
    apart = F.expr(" + ".join(f"bit_count(s{k} ^ t{k})" for k in range(WIDTH // 64)))
    return length & place & (apart <= F.expr("n + m") - 2 * _needed(percent))


def _parities(own: np.ndarray) -> np.ndarray:
    """For each of ``WIDTH`` hash ranges whether it holds an odd number of entries, as 64-bit words."""
    slots = (own >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=WIDTH).astype(np.uint8) & 1, bitorder="little").view(np.int64)


_BITS = [f"s{k}" for k in range(WIDTH // 64)]
_OTHER_BITS = [f"t{k}" for k in range(WIDTH // 64)]


def _wanted_sets(docs: DataFrame, text: Column, shingle: int, ids: DataFrame) -> DataFrame:
    """``id, own, s0 ..``: sorted hashes and parities of the sets named in ``ids`` (a column ``id``), a row per set."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "id", FILTER_BITS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies in one task come out once
        for batch in batches:
            names, sets, bits = [], [], [np.empty((0, len(_BITS)), np.int64)]
            for _, own in shingle_sets(batch.column("t"), shingle):
                name = _set_id(own)
                if name not in done and known.value.has(np.array([name]).view(np.uint64))[0]:
                    done.add(name)
                    names.append(name)
                    sets.append(own.tobytes())
                    bits.append(_parities(own)[None])
            columns = dict(zip(_BITS, map(pa.array, np.concatenate(bits).T.copy())))
            yield pa.RecordBatch.from_pydict({"id": pa.array(names, pa.int64()), "own": pa.array(sets, pa.binary()), **columns})

    schema = "id bigint, own binary, " + ", ".join(f"{c} bigint" for c in _BITS)
    found = docs.select(text.cast("string").alias("t")).mapInArrow(emit, schema)
    return found.join(ids.select("id"), "id", "left_semi").dropDuplicates(["id"])


def suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """At least the overlap of two sorted sets: the smaller size in each of sixteen ranges of hashes."""
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    sizes = [np.diff(np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]])) for x in (a, b)]
    return int(np.minimum(*sizes).sum())


def _linked(percent: int):
    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            need = -(-percent * (len(a) + len(b)) // (100 + percent))
            enough = min(len(a), len(b)) >= need and suffix_bound(a, b) >= need
            out.append(enough and len(np.intersect1d(a, b, assume_unique=True)) >= need)
        return pa.array(out, pa.bool_())

    return similar


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of distinct pairs."""
    first, then = (sets.select(F.col("id").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    return pairs.join(first, "a").join(then, "b").select("a", "b", _linked(percent)("own_a", "own_b").alias("linked"))


def _leaders(members: DataFrame) -> DataFrame:
    """``token, lead, at, m, lead_root, t0 ..``: the member of each entry with the fewest rarer entries."""
    best = members.groupBy("token").agg(F.min(F.struct("pos", "n", "id", "root", *_BITS)).alias("best"))
    names = dict(zip(["id", "pos", "n", "root", *_BITS], ["lead", "at", "m", "lead_root", *_OTHER_BITS]))
    return best.select("token", *[F.col(f"best.{c}").alias(name) for c, name in names.items()])


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _crossing(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """All pairs of an entry whose sets are in different classes, behind the filters: an equality join by entry,
    length class (a set also visits the class below its own) and, in large entries, pairs of blocks."""
    # Sets that are similar enough differ by one length class at most.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.lit(0)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.join(sizes.select("token", "size"), "token")
    rows = rows.withColumn("step", step).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("token", "id", "n", "pos", "root", *_BITS, F.col("step").alias("meet"), F.col("own").alias("x"), every.alias("y"))
    right = rows.select(
        "token", "step", F.col("id").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"),
        F.col("root").alias("other_root"), *[F.col(a).alias(b) for a, b in zip(_BITS, _OTHER_BITS)], every.alias("x"), F.col("own").alias("y"),
    )
    right = right.withColumn("meet", F.explode(F.array("step", F.col("step") - 1))).drop("step")
    return (
        left.join(right, ["token", "meet", "x", "y"])
        .where(F.expr("root <> other_root AND (n < m OR (n = m AND id < other))") & _possible(percent))
        .select(*_pair("id", "other"))
        .distinct()
    )


def _near_classes(links: DataFrame) -> DataFrame:
    """``id, root``: sets with one root are connected; it need not be all of a class. Each set goes to the
    neighbour with most links (itself counts), then that one's choice: two steps that end in the middle of a crowd."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(nodes.withColumn("b", F.col("a")))
    both = via_table(both.distinct(), "both")
    degree = both.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    best = both.join(degree, "b").groupBy("a").agg(F.max(F.struct("degree", "b"))["b"].alias("first"))
    best = via_table(best, "first")
    then = best.select(F.col("a").alias("first"), F.col("first").alias("root"))
    return best.join(then, "first").select(F.col("a").alias("id"), "root")


def jaccard_links(
    docs: DataFrame, entries: DataFrame, text: Column, shingle: int, percent: int, rounds: int = LEADER_ROUNDS
) -> DataFrame:
    """Verified links ``a, b`` between the ids of different sets that connect every class (``entries``: their prefixes)."""
    spark = docs.sparkSession
    met = entries.groupBy("token").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("token")
    members = via_table(entries.join(met, "token").distinct(), "members")
    full = via_table(_wanted_sets(docs, text, shingle, members.select("id").distinct()), "full")
    members = via_table(members.join(full.drop("own"), "id"), "members")
    tried = spark.createDataFrame([], "a bigint, b bigint, linked boolean")
    classes, led, before = None, None, None
    for turn in range(rounds + 1):
        if classes is None:
            rooted = members.withColumn("root", F.col("id"))
        else:
            rooted = via_table(members.join(classes, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        # What is left: the entries whose members are in several classes.
        by_class = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
        sizes = by_class.groupBy("token").agg(F.sum("k").alias("size"), F.sum(F.expr("k * k")).alias("inside"))
        sizes = via_table(sizes.where("inside < size * size"), "open")
        pairs, rows = sizes.agg(F.sum(F.expr("(size * size - inside) div 2")), F.sum("size")).first()
        if not pairs:
            break
        left = rooted.join(sizes.select("token"), "token")
        last = turn == rounds or pairs <= 2 * rows or (before is not None and 2 * pairs > before)
        before = pairs
        if last:
            found = _crossing(left, sizes, percent)
        else:
            free = left
            if led is not None:
                # Classes that have led an entry do not lead it again.
                done = led.join(classes.withColumnRenamed("id", "lead"), "lead", "left")
                free = left.join(done.select("token", F.coalesce("root", "lead").alias("root")).distinct(), ["token", "root"], "left_anti")
            now = via_table(_leaders(free), "leaders")
            led = now.select("token", "lead") if led is None else led.unionByName(now.select("token", "lead"))
            found = left.join(now, "token").where(F.expr("root <> lead_root") & _possible(percent)).select(*_pair("id", "lead")).distinct()
        found = found.join(tried, ["a", "b"], "left_anti") if turn else found
        tried = via_table(tried.unionByName(_verified(found, full, percent)), "verified")
        if last:
            break
        classes = via_table(_near_classes(tried.where("linked").select("a", "b")), "near")
    return tried.where("linked").select("a", "b")


def jaccard_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, percent: int = 90
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document, the smallest id reachable by links.

    Two documents link when ``100 * |both| >= percent * |either|`` for their sets of shingles.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    body = F.col(f"`{text}`")
    parts = 1 + (docs.agg(F.sum(F.octet_length(body.cast("string")))).first()[0] or 0) // PART_BYTES
    counted = via_table(_counted(_sent(docs, body, F.col(f"`{doc_id}`"), shingle, percent, parts), parts), "counted")
    entries = via_table(_prefixes(counted.where(f"kind <> {_DOCUMENT}"), percent), "entries")
    prints = counted.where(f"kind = {_DOCUMENT}").select("doc_id", "id", "n")
    found = components(jaccard_links(docs, entries, body, shingle, percent))
    least = prints.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    rooted = via_table(
        least.join(found, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root")), "roots"
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id")).join(rooted, "root").select("id", "component_id")
    alone = prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (
        prints.where("n > 0").join(names, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    )
