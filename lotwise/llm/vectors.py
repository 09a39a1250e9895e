"""Exact top-k search by integer inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it. Sorted by that key and cut into blocks,
each block is an annulus around its pivot, kept as one packed row. For a query ``q`` at distance ``d`` from
the pivot, a vector ``x`` of an annulus ``[low, high]`` is by the triangle inequality at least
``gap = max(0, d - high, low - d)`` away, so

    <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2  <=  (|q|^2 + max |x|^2 - gap^2) / 2

and also ``<q, x> <= <q, p> + |q| * high``. The search opens for each query the annuli with the best bounds
first; the k-th best score there is a threshold, and annuli whose bound lies below it are never opened. The
others are scored in full, so the result is exact whatever the data; only the amount of work depends on
how well they cluster.

The number of pivots and of rows per block grows with the square root and the cube root of the rows. Equal
vectors are indexed for their ``k + 1`` smallest ids only, which are all that can be among the best ``k`` of
any query besides itself.

Defined cases: rows without an id, without a vector, or with a missing or non-finite component take no
part; shorter vectors count as filled up with zeros; of rows that share an id the smallest vector counts;
with fewer than ``k`` candidates all are returned; ties go to the smaller id. Blocks whose products could pass
2^53 are scored with whole numbers of any size; a component or a score beyond a long counts as the largest (or
smallest) long.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import via_table

MAX_PIVOTS = 4096
QUERIES_PER_BLOCK = 512
ANNULI_PER_CHUNK = 1 << 15
EXACT = float(1 << 53)


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """``id, v``: one whole-number vector per usable id, ``floor(scale * component)``."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).where(~bad)
    return (
        usable.select(
            F.col(f"`{vec_id}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v")
        )
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _nearest(shared, width: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                distance = _distances(_matrix(part.column("v"), width), pivots)
                near = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near, pa.int32()), pa.array(distance[np.arange(len(near)), near]), part.column("id"), part.column("v")],
                    names=["pivot", "d", "id", "v"],
                )

    return assign


_PACKED = "block string, pivot int, low double, high double, norm double, ids array<bigint>, data binary"


def _pack(width: int, size: int):
    """Consecutive rows of one pivot become a block; rows come sorted by pivot and distance."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, d, ids, rows = -1, [], [], []

        def block() -> pa.RecordBatch:
            x = np.stack(rows)
            return pa.RecordBatch.from_pydict(
                {
                    "block": [f"{pivot}:{d[0]!r}:{ids[0]}"],
                    "pivot": pa.array([pivot], pa.int32()),
                    "low": [d[0]],
                    "high": [d[-1]],
                    "norm": [float((x * x).sum(axis=1).max())],
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "data": [x.tobytes()],
                }
            )

        for batch in batches:
            x = _matrix(batch.column("v"), width)
            for p, a, i, row in zip(batch.column("pivot").to_pylist(), batch.column("d").to_pylist(), batch.column("id").to_pylist(), x):
                if rows and (p != pivot or len(rows) >= size):
                    yield block()
                    d, ids, rows = [], [], []
                pivot = p
                d.append(a)
                ids.append(i)
                rows.append(row)
        if rows:
            yield block()

    return emit


def _bounds(q: np.ndarray, to_pivot: np.ndarray, pivots: np.ndarray, annuli: dict[str, np.ndarray]) -> np.ndarray:
    """For each query and annulus a score that no vector of the annulus exceeds (rounding included)."""
    p = annuli["pivot"]
    d, low, high, norm = to_pivot[:, p], annuli["low"], annuli["high"], annuli["norm"]
    square = (q * q).sum(axis=1)[:, None]
    slack = 1e-6 * (1 + d + high)
    gap = np.maximum(0, np.maximum(d - high, low - d) - slack)
    near = (square + norm - gap * gap) / 2
    ball = (q @ pivots.T)[:, p] + np.sqrt(square) * (high + slack)
    bound = np.minimum(np.minimum(near, ball), np.sqrt(square * norm))
    return bound + 1e-9 * np.abs(bound) + 1e-3


def _plan(shared, width: int, first: int | None):
    """Pairs of a query and an annulus to open, from rows that hold a block of queries and a chunk of annuli.
    With ``first``, the annuli with the best bounds; without, all whose bound reaches the threshold ``t``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                queries, listed = batch.column("queries")[i].values, batch.column("annuli")[i].values
                annuli = {c: np.asarray(listed.field(c)) for c in ("pivot", "low", "high", "norm")}
                names, ids, t = listed.field("block"), np.asarray(queries.field("id")), np.asarray(queries.field("t"))
                q = _matrix(queries.field("v"), width)
                d = _distances(q, pivots)
                step = max(1, (1 << 21) // max(1, len(names)))
                for a in range(0, len(ids), step):
                    part = slice(a, a + step)
                    bound = _bounds(q[part], d[part], pivots, annuli)
                    if first is None:
                        row, at = np.nonzero(bound >= t[part][:, None])
                    else:
                        at = np.argsort(-bound, axis=1, kind="stable")[:, :first]
                        row, at = np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part][row]), names.take(pa.array(at))], names=["query", "block"]
                    )

    return emit


def _large_scores(own, q, floor, ids, x, k: int) -> Iterator[pa.RecordBatch]:
    """The same with Python's integers; scores beyond a long count as the largest or smallest one."""
    rows = [[int(v) for v in row] for row in x]
    out: list[tuple[int, int, int]] = []
    for query, t, values in zip(own.tolist(), floor.tolist(), q):
        whole = [int(v) for v in values]
        scores = (
            (max(min(sum(a * b for a, b in zip(whole, row)), (1 << 63) - 1), -(1 << 63)), -i)
            for i, row in zip(ids.tolist(), rows)
            if i != query
        )
        # A threshold is a score rounded to a double: what rounds to it may reach it.
        out += [(query, -i, score) for score, i in heapq.nlargest(k, scores) if float(score) >= t]
    names = ["query_id", "vec_id", "score"]
    columns = zip(*out) if out else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _score(width: int, k: int):
    """The best ``k`` of each block for the queries that open it (ties: smaller id), above their thresholds."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.asarray(batch.column("ids")[i].values)
                x = np.frombuffer(batch.column("data")[i].as_py(), np.float64).reshape(-1, width)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                queries = batch.column("queries")[i].values
                own = np.asarray(queries.field("query"))
                floor = np.asarray(queries.field("t"))
                q = _matrix(queries.field("v"), width)
                # Where doubles do not hold the products, whole numbers of any size do.
                large = not np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1).max()) < EXACT
                for a in range(0, len(own), QUERIES_PER_BLOCK):
                    part = slice(a, a + QUERIES_PER_BLOCK)
                    if large:
                        yield from _large_scores(own[part], q[part], floor[part], ids, x, k)
                        continue
                    scores = q[part] @ x.T
                    scores[own[part][:, None] == ids[None]] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(scores, best, axis=1)
                    keep = (value >= floor[part][:, None]) & np.isfinite(value)
                    row, place = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[part][row]), pa.array(ids[best[row, place]]), pa.array(value[row, place].astype(np.int64))],
                        names=["query_id", "vec_id", "score"],
                    )

    return emit


def _opened(plan: DataFrame, queries: DataFrame, blocks: DataFrame, width: int, k: int, chunk: int) -> DataFrame:
    """Scores of all planned pairs. The queries of a block are dealt into chunks, so none is unbounded."""
    asked = (
        plan.join(queries, plan["query"] == queries["id"])
        .select("block", F.struct("query", "t", "v").alias("query"), F.pmod(F.xxhash64("query"), F.lit(chunk)).alias("part"))
        .groupBy("block", "part")
        .agg(F.collect_list("query").alias("queries"))
    )
    return asked.join(blocks.select("block", "ids", "data"), "block").select("queries", "ids", "data").mapInArrow(
        _score(width, k), "query_id bigint, vec_id bigint, score bigint"
    )


def best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    max_pivots: int = MAX_PIVOTS,
    open_first: int = 4,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every row that ``is_query`` (an
    expression over ``id``) selects, among all rows but itself.

    Pivots are a random sample of at most ``max_pivots`` distinct vectors; they steer the search only.
    """
    spark = rows.sparkSession
    vectors = via_table(whole_vectors(rows, vec_id, vector, scale), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not width:
        everything = vectors.where(is_query).select(F.col("id").alias("query_id"))
        few = vectors.orderBy("id").limit(k + 1).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
        pairs = everything.join(few, F.col("query_id") != F.col("vec_id"))
        return best(pairs, k).select("query_id", "rank", "vec_id", "score")
    # Only the smallest ids of equal vectors can be among the best; the rank is limited before the shuffle.
    equal = Window.partitionBy("v").orderBy("id")
    distinct = vectors.withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1).select("id", "v")
    wanted = min(max_pivots, math.isqrt(n - 1) + 1)
    chosen = distinct.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    pivots = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        pivots[i, : len(r["v"])] = r["v"]
    shared = spark.sparkContext.broadcast(pivots)
    keyed = distinct.mapInArrow(_nearest(shared, width), "pivot int, d double, id bigint, v array<bigint>")
    size = max(256, round(n ** (1 / 3)) * 8)
    parts = max(1, n // (16 * size))
    blocks = via_table(
        keyed.repartitionByRange(parts, "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id").mapInArrow(_pack(width, size), _PACKED),
        "annuli",
    )
    # The annuli's bounds in chunks of bounded size; each chunk meets each query (the stated query set).
    chunks = max(1, -(-blocks.count() // ANNULI_PER_CHUNK))
    listed = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk")).agg(
        F.collect_list(F.struct("block", "pivot", "low", "high", "norm")).alias("annuli")
    )
    queries = via_table(vectors.where(is_query), "queries")
    asked = queries.withColumn("t", F.lit(float("-inf")))
    total = queries.count()
    packs = max(1, -(-total // QUERIES_PER_BLOCK))

    def planned(frame: DataFrame, first: int | None) -> DataFrame:
        packed = frame.groupBy(F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack")).agg(
            F.collect_list(F.struct("id", "v", "t")).alias("queries")
        )
        met = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(listed, "chunk")
        return met.select("queries", "annuli").mapInArrow(_plan(shared, width, first), "query bigint, block string")

    chunk = max(1, -(-total // (4 * QUERIES_PER_BLOCK)))
    lead = via_table(planned(asked, open_first), "lead")
    early = via_table(_opened(lead, asked, blocks, width, k, chunk), "early")
    floor = best(early, k).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c"))
    floored = via_table(
        queries.join(floor, F.col("id") == F.col("query_id"), "left").select(
            "id", "v", F.when(F.col("c") >= k, F.col("s").cast("double")).otherwise(F.lit(float("-inf"))).alias("t")
        ),
        "thresholds",
    )
    rest = planned(floored, None).join(lead.select("query", "block"), ["query", "block"], "left_anti")
    late = _opened(rest, floored, blocks, width, k, chunk)
    found = early.unionByName(late)
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
