"""Exact nearest neighbours as a pruned block join.

Reference rows are spread over *cells* (nearest of some pivot rows, as many as the cube root of the
rows) and each cell over hash *blocks* of about ``BLOCK`` rows, so a hot cell becomes many equal blocks
and no record outgrows one block. Query rows get the same treatment. Cell radii and the triangle inequality say
which cells can hold one of the k nearest of a query cell; only those cells meet, in an equi-join
on the cell. A block pair is one matrix product in numpy and yields at most k candidates per query
row, never all pairs; the final top-k keeps k rows per query before the shuffle.

Up to ``BOX_COLUMNS`` columns the cells are the leaves of a tree of cuts, about ``BLOCK`` reference rows each, with
measured boxes. A query row first meets its own leaf; the distance to its k-th there says which other leaves it has to
meet, so the work follows the rows. Of equal reference rows only the k with the smallest keys can be an answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.scalar import col, hash_number
from lotwise.operators.boosting import matrix
from lotwise.operators.persist import WithTable
from lotwise.schema import ID
from lotwise.session import via_table

LEAST_PIVOTS = 16
BLOCK = 512
BLOCKS_PER_TASK = 16
BOX_COLUMNS = 8  # with more, boxes prune little
MOST_LEAVES = 1 << 15  # their boxes travel with the tasks
PER_LEAF = 8  # sampled rows that place the cuts; they steer only


def nearest_neighbors(
    queries: DataFrame, references: DataFrame, k: int, key: str = ID, vector: str = "features", payload: Sequence[str] = ()
) -> DataFrame:
    """``query_key, neighbor_key, distance, rank`` (and the neighbours' ``payload`` columns).

    Ties are broken by the neighbour's key. ``vector`` may be an ML vector or an array. Keys are whole
    numbers; without query rows the result is empty.
    """
    spark = queries.sparkSession
    q = _as_arrays(queries, key, vector, ())
    r = via_table(_as_arrays(references, key, vector, payload), "knn_refs")
    width = r.select(F.size("x")).first()
    if width is not None and 0 < width[0] <= BOX_COLUMNS:
        return _in_boxes(q, r, k, payload)
    # The pivots travel with the tasks; their pairs, two thirds of a power of the rows, with the driver.
    count = max(LEAST_PIVOTS, round(r.count() ** (1 / 3)))
    pivot_rows = r.orderBy(hash_number(F.col("key"), 7), "key").limit(count).select("x").collect()
    pivots = np.array([p["x"] for p in pivot_rows], dtype=float)
    if not len(pivots):
        raise ValueError("no reference rows")
    cell = _cell_udf(pivots)
    q = via_table(q.withColumn("at", cell("x")).select("key", "x", "at.*"), "knn_q")
    r = via_table(r.withColumn("at", cell("x")).select("key", "x", *[col(c) for c in payload], "at.*"), "knn_r")
    # One row per cell on either side.
    q_cells = {c["cell"]: c for c in q.groupBy("cell").agg(F.max("d").alias("radius"), F.count("d").alias("n")).collect()}
    r_cells = {c["cell"]: c for c in r.groupBy("cell").agg(F.max("d").alias("radius"), F.count("d").alias("n")).collect()}
    columns = ["query_key long, neighbor_key long, distance double", *[f"`{c}` double" for c in payload]]
    if not q_cells:
        return spark.createDataFrame([], ", ".join(columns)).withColumn("rank", F.lit(1)).select(
            "query_key", "neighbor_key", "distance", "rank", *[col(c) for c in payload]
        )
    # A reference cell of many blocks is met under as many salts as it has tasks' worth of blocks.
    salts = {b: math.ceil(_block_count(c["n"]) / BLOCKS_PER_TASK) for b, c in r_cells.items()}
    meet = _cell_pairs(pivots, q_cells, r_cells, k)
    pairs = spark.createDataFrame(
        [(a, b, bound, salts[b]) for a, b, bound in meet], "cell int, ref_cell int, bound double, salts int"
    )
    salts_of = F.create_map(*[F.lit(int(v)) for pair in salts.items() for v in pair])
    # The search is heavy for its bytes, so the number of tasks is stated, not left to their size.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q_blocks = (
        _blocks(q, q_cells, ())
        .join(F.broadcast(pairs), "cell")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("cell", "block", "salts")
        .repartition(tasks, "ref_cell", "salt")
    )
    r_blocks = _blocks(r, r_cells, payload).select(
        F.col("cell").alias("ref_cell"),
        F.pmod("block", F.try_element_at(salts_of, F.col("cell"))).cast("int").alias("salt"),
        *[col(c).alias(f"r_{c}") for c in ("key", "x", *payload)],
    )
    r_blocks = r_blocks.repartition(tasks, "ref_cell", "salt")
    hits = (
        q_blocks.join(r_blocks, ["ref_cell", "salt"])
        .drop("ref_cell", "salt")
        .mapInPandas(
            _block_search(k, list(payload)),
            ", ".join(columns),
        )
    )
    order = Window.partitionBy("query_key").orderBy("distance", "neighbor_key")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_key", "neighbor_key", "distance", "rank", *[col(c) for c in payload])


def _in_boxes(q: DataFrame, r: DataFrame, k: int, payload: Sequence[str]) -> DataFrame:
    """The same answer for few columns: own leaf first, then the leaves within the k-th distance found there."""
    spark = q.sparkSession
    whole = ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    copies = Window.partitionBy("x").orderBy("key", *[col(c) for c in payload])
    r = r.where(whole).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k).drop("copy")
    r = via_table(r, "knn_distinct")
    count = r.count()
    if not count:
        raise ValueError("no reference rows")
    leaves = min(MOST_LEAVES, max(1, count // max(BLOCK, 4 * k)))
    sampled = F.pmod(F.xxhash64("key", "x"), F.lit(max(1, count // (leaves * PER_LEAF)))) == 0
    leaf = _leaf_udf(*_cuts(matrix(r.where(sampled).select("x").toArrow().column("x").combine_chunks()), leaves))
    r = via_table(r.withColumn("cell", leaf("x")), "knn_r")
    q = via_table(q.where(whole).select("key", "x", leaf("x").alias("cell")), "knn_q")
    p = r.select(F.size("x")).first()[0]
    ends = [f(F.col("x")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(p)]
    boxes = r.groupBy("cell").agg(F.count("x").alias("n"), *ends).orderBy("cell").toPandas()  # a row per leaf
    blocks = via_table(_packed(r, ["cell"], payload), "knn_leaves")

    hit = f"query_key long, neighbor_key long, distance double{''.join(f', `{c}` double' for c in payload)}"
    schema = f"key long, x array<double>, bound double, visits array<int>, near array<struct<{hit}>>"
    home = via_table(_met(q, blocks, (), payload).mapInArrow(_home_search(k, list(payload), boxes, p), schema), "knn_home")
    away = home.select("key", "x", "bound", F.explode("visits").alias("cell"))
    more = _met(away, blocks, ["bound"], payload).mapInArrow(_away_search(k, list(payload)), hit)
    hits = home.select(F.inline("near")).unionByName(more)
    order = Window.partitionBy("query_key").orderBy("distance", "neighbor_key")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_key", "neighbor_key", "distance", "rank", *[col(c) for c in payload])


def _met(rows: DataFrame, blocks: DataFrame, more: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Blocks of query rows next to the reference block of their cell; the blocks of a crowded cell are dealt by salts."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    sizes = via_table(rows.groupBy("cell").agg(parts.alias("parts")), "knn_sizes")  # a row per leaf
    sizes = F.broadcast(sizes.select("cell", "parts", F.ceil(F.col("parts") / BLOCKS_PER_TASK).cast("int").alias("salts")))
    dealt = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = _packed(dealt.withColumn("salt", F.pmod("block", "salts")), ["cell", "salt", "block"], more)
    dealt = dealt.drop("block").repartition(tasks, "cell", "salt")
    refs = blocks.select("cell", *[col(c).alias(f"r_{c}") for c in ("key", "x", *payload)])
    refs = refs.join(sizes, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return dealt.join(refs.drop("parts", "salts").repartition(tasks, "cell", "salt"), ["cell", "salt"]).drop("salt")


def _cuts(x: np.ndarray, leaves: int) -> tuple[np.ndarray, ...]:
    """Column (-1: a leaf), cut, left and right node, and leaf number of every node of the tree."""
    column, cut, left, right, number = [-1], [0.0], [0], [0], [0]
    todo, found = [(0, x)], 0
    while todo:
        node, rows = todo.pop()
        wide = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if len(rows) * leaves <= len(x) or not wide.max() > 0:
            number[node], found = found, found + 1
            continue
        at = int(wide.argmax())
        v = rows[:, at]
        middle = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        if middle == v.max():
            middle = v[v < middle].max()
        column[node], cut[node], left[node], right[node] = at, middle, len(column), len(column) + 1
        for values, value in ((column, -1), (cut, 0.0), (left, 0), (right, 0), (number, 0)):
            values += [value, value]
        todo += [(left[node], rows[v <= middle]), (right[node], rows[v > middle])]
    return tuple(np.array(values) for values in (column, cut, left, right, number))


def _leaf_udf(column: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, number: np.ndarray):
    @F.arrow_udf("int")
    def leaf(features: pa.Array) -> pa.Array:
        x = matrix(features)
        at = np.zeros(len(x), dtype=np.int64)
        inner = np.nonzero(column[at] >= 0)[0]
        while len(inner):
            node = at[inner]
            at[inner] = np.where(x[inner, column[node]] > cut[node], right[node], left[node])
            inner = inner[column[at[inner]] >= 0]
        return pa.array(number[at], pa.int32())

    return leaf


def _nearest(qx: np.ndarray, rx: np.ndarray, k: int, bound: np.ndarray | float = math.inf) -> tuple[np.ndarray, ...]:
    """Query and reference place and distance of the k nearest within the bound, by query, distance and place."""
    d = _distances(qx, rx)
    worst = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), math.inf)
    q_at, r_at = np.nonzero(d <= np.minimum(worst, bound)[:, None])
    near = d[q_at, r_at]
    order = np.lexsort((r_at, near, q_at))
    q_at, r_at, near = q_at[order], r_at[order], near[order]
    keep = np.arange(len(q_at)) - np.searchsorted(q_at, q_at) < k
    return q_at[keep], r_at[keep], near[keep]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """The cells of each joined row as arrays, and the vectors of its two blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, cells in zip(batch.schema.names, batch.columns):
                own = cells[i]
                flat = own.values.to_numpy(zero_copy_only=False) if isinstance(own, pa.ListScalar) else own.as_py()
                row[name] = flat
            yield row, row["x"].reshape(len(row["key"]), -1), row["r_x"].reshape(len(row["r_key"]), -1)


def _hits(row: dict, q_at: np.ndarray, r_at: np.ndarray, near: np.ndarray, payload: list[str]) -> dict[str, pa.Array]:
    out = {"query_key": pa.array(row["key"][q_at]), "neighbor_key": pa.array(row["r_key"][r_at]), "distance": pa.array(near)}
    return out | {c: pa.array(row[f"r_{c}"][r_at].astype(float), from_pandas=True) for c in payload}


def _home_search(k: int, payload: list[str], boxes: pd.DataFrame, p: int):
    """The nearest rows of the own leaf, the bound they give and the other leaves within it."""
    cells, sizes = boxes["cell"].to_numpy(), boxes["n"].to_numpy()
    low, high = (boxes[[f"{n}{i}" for i in range(p)]].to_numpy() for n in ("low", "high"))

    def gaps(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of the boxes ``a`` to ``b`` to those of leaves."""
        apart = np.maximum(np.maximum(low[at] - b[:, None], a[:, None] - high[at]), 0.0)
        return np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, qx, rx in _blocks_of(batches):
            q_at, r_at, near = _nearest(qx, rx, k)
            counts = np.bincount(q_at, minlength=len(qx))
            ends = np.cumsum(counts)
            a, b = qx.min(axis=0), qx.max(axis=0)
            bound = np.full(len(qx), math.inf)
            if len(rx) >= k:
                bound = near[ends - 1]
            else:  # a leaf of few rows: the farthest corners of as many leaves as hold k rows
                far = np.linalg.norm(np.maximum(np.abs(high - a), np.abs(b - low)), axis=1)
                by = np.argsort(far)
                enough = np.searchsorted(np.cumsum(sizes[by]), k)
                if enough < len(by):
                    bound[:] = far[by[enough]]
            bound = bound * (1 + 1e-9)  # room for rounding
            others = np.nonzero((gaps(a[None], b[None], np.arange(len(cells)))[0] <= bound.max()) & (cells != row["cell"]))[0]
            met, places = [], []
            width = max(1, 2_000_000 // max(1, len(others) * p))
            for i in range(0, len(qx), width):
                at, place = np.nonzero(gaps(qx[i : i + width], qx[i : i + width], others) <= bound[i : i + width, None])
                met.append(at + i)
                places.append(cells[others[place]])
            visits = np.bincount(np.concatenate(met), minlength=len(qx))
            hits = _hits(row, q_at, r_at, near, payload)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(row["key"]),
                    "x": pa.ListArray.from_arrays(pa.array(np.arange(len(qx) + 1) * p, pa.int32()), pa.array(qx.ravel())),
                    "bound": pa.array(bound),
                    "visits": _lists(visits, pa.array(np.concatenate(places), pa.int32())),
                    "near": _lists(counts, pa.StructArray.from_arrays(list(hits.values()), list(hits))),
                }
            )

    return search


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _away_search(k: int, payload: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, qx, rx in _blocks_of(batches):
            yield pa.RecordBatch.from_pydict(_hits(row, *_nearest(qx, rx, k, row["bound"]), payload))

    return search


def _as_arrays(df: DataFrame, key: str, vector: str, payload: Sequence[str]) -> DataFrame:
    kind = df.schema[vector].dataType
    x = vector_to_array(vector) if isinstance(kind, VectorUDT) else col(vector).cast("array<double>")
    return df.select(col(key).cast("long").alias("key"), x.alias("x"), *[col(c).cast("double").alias(c) for c in payload])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise distances, computed by difference in slices: exact zeros for equal rows."""
    out = np.empty((len(a), len(b)))
    width = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), width):
        diff = a[i : i + width, None, :] - b[None, :, :]
        out[i : i + width] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _cell_udf(pivots: np.ndarray):
    @F.pandas_udf("cell int, d double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "d": pd.Series([], dtype=float)})
        d = _distances(np.stack(x.to_list()), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "d": d[np.arange(len(d)), cell]})

    return nearest


def _cell_pairs(pivots: np.ndarray, q_cells: dict, r_cells: dict, k: int) -> list[tuple[int, int, float]]:
    """Cell pairs that can hold a neighbour (lower bound of the pair <= upper bound of the k-th), and
    that upper bound."""
    gap = _distances(pivots, pivots)
    out = []
    for a, qc in q_cells.items():
        reach = sorted((gap[a, b] + qc["radius"] + rc["radius"], rc["n"]) for b, rc in r_cells.items())
        seen, bound = 0, math.inf
        for far, n in reach:
            seen += n
            if seen >= k:
                bound = far
                break
        bound *= 1 + 1e-9  # room for rounding
        for b, rc in r_cells.items():
            if gap[a, b] - qc["radius"] - rc["radius"] <= bound:
                out.append((int(a), int(b), float(bound)))
    return out


def _block_count(n: int) -> int:
    return max(1, math.ceil(n / BLOCK))


def _blocks(rows: DataFrame, cells: dict, more: Sequence[str]) -> DataFrame:
    """Rows of a cell in hash blocks of about BLOCK rows, packed into arrays."""
    counts = F.create_map(*[F.lit(v) for c, s in cells.items() for v in (int(c), _block_count(s["n"]))])
    block = F.pmod(F.xxhash64("key"), F.try_element_at(counts, F.col("cell")))
    return _packed(rows.withColumn("block", block), ["cell", "block"], more)


def _packed(rows: DataFrame, by: Sequence[str], more: Sequence[str]) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("key", "x", *[col(c) for c in more])))
    return (
        rows.groupBy(*by)
        .agg(packed.alias("rows"))
        .select(*by, F.col("rows.key").alias("key"), F.flatten("rows.x").alias("x"), *[F.col("rows")[c].alias(c) for c in more])
    )


def _block_search(k: int, payload: list[str]):
    """Nearest rows of a reference block for each row of a query block, as flat numpy work.

    Rows of a block come in key order, so a stable sort by distance breaks ties by key.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                q_keys, r_keys = np.asarray(row.key), np.asarray(row.r_key)
                qx = np.asarray(row.x).reshape(len(q_keys), -1)
                rx = np.asarray(row.r_x).reshape(len(r_keys), -1)
                d = _distances(qx, rx)
                at = np.argsort(d, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(d, at, axis=1)
                keep = near <= row.bound
                at, q_at = at[keep], np.repeat(np.arange(len(q_keys)), keep.sum(axis=1))
                out = {"query_key": q_keys[q_at], "neighbor_key": r_keys[at], "distance": near[keep]}
                for c in payload:
                    out[c] = np.asarray(getattr(row, f"r_{c}"))[at]
                yield pd.DataFrame(out)

    return search


def weighted_mean(neighbors: DataFrame, label: str, weights: str = "distance") -> DataFrame:
    """``query_key, prediction``: neighbours at distance 0 decide alone, others weigh ``1 / d``."""
    if weights == "uniform":
        return neighbors.groupBy("query_key").agg(F.avg(label).alias("prediction"))
    y, d = F.col(label), F.col("distance")
    near = F.avg(F.when(d == 0, y))
    far = F.try_divide(F.sum(F.when(d > 0, y / F.nullif(d, F.lit(0.0)))), F.sum(F.when(d > 0, 1 / F.nullif(d, F.lit(0.0)))))
    return neighbors.groupBy("query_key").agg(F.coalesce(near, far).alias("prediction"))


ROW = "_knn_row"


def _tie_key(df: DataFrame, key: str, vector: str) -> Column:
    """The order of equally near rows: their key if it is a number, else a hash of key or features."""
    by_features = F.xxhash64(vector_to_array(vector))
    if key not in df.columns:
        return by_features.alias(ROW)
    own = col(key).cast("long") if isinstance(df.schema[key].dataType, T.NumericType) else F.xxhash64(col(key))
    return F.when(col(key).isNotNull(), own).otherwise(by_features).alias(ROW)


class _KnnParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "distance or uniform", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "row key", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(k=10, weights="distance", keyCol=ID, featuresCol="features", labelCol="label", predictionCol="prediction")


class KnnRegressor(Estimator, _KnnParams):
    @keyword_only
    def __init__(self, *, k=10, weights="distance", keyCol=ID):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "KnnRegressionModel":
        rows = df.select(
            _tie_key(df, self.getOrDefault(self.keyCol), self.getFeaturesCol()), col(self.getFeaturesCol()), col(self.getLabelCol())
        )
        return self._copyValues(KnnRegressionModel(via_table(rows, "knn_train")))


class KnnRegressionModel(Model, _KnnParams, WithTable):
    """Keeps the training rows as a table in the shared folder.

    Rows to predict may have any keys or none: each gets a number of its own for the search.
    """

    def __init__(self, rows: DataFrame | None = None):
        super().__init__()
        self.table = rows

    def copy(self, extra=None):
        return self._copyValues(KnnRegressionModel(self.table), extra)

    def _transform(self, df: DataFrame) -> DataFrame:
        label = self.getLabelCol()
        # Stored, so that the numbers are the same on both sides of the join.
        rows = via_table(df.withColumn(ROW, F.monotonically_increasing_id()), "knn_rows")
        near = nearest_neighbors(rows, self.table, self.getOrDefault(self.k), ROW, self.getFeaturesCol(), [label])
        predicted = weighted_mean(near, label, self.getOrDefault(self.weights))
        predicted = predicted.select(F.col("query_key").alias(ROW), F.col("prediction").alias(self.getPredictionCol()))
        return rows.join(predicted, ROW, "left").drop(ROW)
