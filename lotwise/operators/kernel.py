"""An epsilon-insensitive kernel machine on random Fourier columns, fitted by distributed Newton steps.

``cos(w x + b)`` columns with normal ``w`` approximate a radial kernel. On them the machine is linear: it minimises
``|v|^2 / 2 + C * sum(max(|e| - epsilon, 0))`` over all rows. The corner of the loss is rounded off by a parabola of
width ``delta``, which shrinks in stages. A pass over the rows sums objective, gradient and Hessian at the weights that
a whole step leads to, and the objective at shorter steps; where the whole one does not lower it enough, the best of
those is taken and looked at in a pass of its own. A task sends one set of sums, cut into blocks of Hessian rows that are added up side by side; the driver solves a system
as large as the columns. The Fourier columns are made inside a pass and never stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.operators.boosting import matrix
from lotwise.session import via_table

BLOCK_BYTES = 256 << 10  # of rows of the Hessian that travel together
STAGES = (1.0, 0.3, 0.1, 0.03, 0.01)  # widths of the rounded corner, as shares of the label's deviation
STEPS = (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.06, 0.03, 0.01, 0.003, 0.001, 0.0)
TURNS = 25


def waves(x: np.ndarray, seed: int, size: int, gamma: float) -> np.ndarray:
    """The Fourier columns of rows; their directions follow from the seed."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, math.sqrt(2 * gamma), (x.shape[1], size))
    b = rng.uniform(0, 2 * math.pi, size)
    return math.sqrt(2 / size) * np.cos(x @ w + b)


def added(rows: DataFrame, tasks: int, sums: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The arrays that ``sums`` makes of a task's batches, added up over the tasks by their number."""
    schema = "part int, own binary"

    def packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"part": pa.array(list(total), pa.int32()), "own": pa.array([np.ascontiguousarray(x, np.float64).tobytes() for x in total.values()], pa.binary())}
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(sums(batches))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("own").to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(own)
        yield packed(total)

    found = rows.mapInArrow(emit, schema).repartition(tasks, "part").mapInArrow(merge, schema).toArrow().to_pylist()
    return {r["part"]: np.frombuffer(r["own"]) for r in found}


def loss(e: np.ndarray, epsilon: float, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rounded loss of errors, its slope and its curvature."""
    over = np.abs(e) - epsilon
    bent, straight = (over > 0) & (over < delta), over >= delta
    value = np.where(straight, over - delta / 2, np.where(bent, over * over / (2 * delta), 0.0))
    slope = np.sign(e) * np.where(straight, 1.0, np.where(bent, over / delta, 0.0))
    return value, slope, bent / delta


class _Shape(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "Fourier columns", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", seed=42, size=256)


class KernelModel(Model, _Shape, DefaultParamsReadable, DefaultParamsWritable):
    """Weights on the Fourier columns and an intercept."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "one per Fourier column, then the intercept", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        seed, size, gamma = (self.getOrDefault(p) for p in (self.seed, self.size, self.gamma))
        weights = np.array(self.getOrDefault(self.weights))

        @F.arrow_udf("double")
        def predicted(features: pa.Array) -> pa.Array:
            x = matrix(features)
            return pa.array(waves(x, seed, size, gamma) @ weights[:-1] + weights[-1] if len(x) else [], pa.float64())

        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))


class KernelRegressor(Estimator, _Shape, DefaultParamsReadable, DefaultParamsWritable):
    C = Param(Params._dummy(), "C", "weight of the errors", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to it cost nothing", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, C=10.0, epsilon=0.01, size=256, seed=42):
        super().__init__()
        self._setDefault(C=10.0, epsilon=0.01)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> KernelModel:
        x, y = vector_to_array(self.getFeaturesCol()), col(self.getLabelCol()).cast("double")
        cells = [F.aggregate(x, F.lit(0.0), step) for step in (lambda a, v: a + v, lambda a, v: a + v * v)]
        known = df.where(y.isNotNull())
        # Width rule: 1 / (columns * variance of all cells), from sums in one pass.
        n, p, s, ss, mean, spread = known.agg(
            F.count(y), F.max(F.size(x)), F.sum(cells[0]), F.sum(cells[1]), F.avg(y), F.stddev_pop(y)
        ).first()
        if not n:
            raise ValueError("no rows with a label to learn from")
        gamma = 1.0 / (p * max(ss / (n * p) - (s / (n * p)) ** 2, 1e-12))
        rows = via_table(known.select(x.alias("x"), (y - mean).alias("y")), "kernel").persist()
        weights = self._newton(rows, gamma, max(spread, 1e-9))
        rows.unpersist()
        weights[-1] += mean
        model = KernelModel()._set(gamma=gamma, weights=weights.tolist())
        return self._copyValues(model)

    def _newton(self, rows: DataFrame, gamma: float, spread: float) -> np.ndarray:
        cost, epsilon, size, seed = (self.getOrDefault(q) for q in (self.C, self.epsilon, self.size, self.seed))
        tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        block = max(1, BLOCK_BYTES // (8 * (size + 1)))
        blocks = -(-(size + 1) // block)

        def batches_of(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                x = matrix(batch.column("x"))
                if len(x):
                    yield np.column_stack([waves(x, seed, size, gamma), np.ones(len(x))]), np.asarray(batch.column("y"))

        flat = np.append(np.ones(size), 0.0)  # the intercept is free

        def bend(v: np.ndarray, delta: float, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The objective at each of ``STEPS`` (the first ends at ``v``), gradient and Hessian at ``v``."""

            def sums(batches) -> dict[int, np.ndarray]:
                totals, g, h = np.zeros(len(STEPS)), np.zeros(size + 1), np.zeros((size + 1, size + 1))
                for z, y in batches_of(batches):
                    e, along = y - z @ v, z @ step
                    value, slope, curve = loss(e, epsilon, delta)
                    totals[0] += value.sum()
                    totals[1:] += [loss(e + (1 - t) * along, epsilon, delta)[0].sum() for t in STEPS[1:]]
                    g -= slope @ z
                    own = z[curve > 0]
                    h += own.T @ own / delta
                return {-1: np.append(g, totals), **{k: h[k * block : (k + 1) * block] for k in range(blocks)}}

            found = added(rows, min(tasks, blocks), sums)
            h = np.concatenate([found[k].reshape(-1, size + 1) for k in range(blocks)])
            ends = [(v - (1 - t) * step)[:-1] for t in STEPS]
            objective = np.array([0.5 * float(w @ w) for w in ends]) + cost * found[-1][size + 1 :]
            return objective, cost * found[-1][: size + 1] + flat * v, cost * h + np.diag(flat)

        v, still = np.zeros(size + 1), np.zeros(size + 1)
        for share in STAGES:
            delta = share * spread
            now, g, h = bend(v, delta, still)
            # What a whole step would still gain; the wide corners only lead to the narrow one.
            enough = (1e-8 if share == STAGES[-1] else 1e-3) * max(float(now[0]), cost)
            for _ in range(TURNS):
                d = -np.linalg.lstsq(h + 1e-9 * np.trace(h) / len(h) * np.eye(len(h)), g, rcond=None)[0]
                if -g @ d <= enough:
                    break
                found = bend(v + d, delta, d)
                if found[0][0] > now[0] + 1e-3 * (g @ d):
                    t = STEPS[int(np.argmin(found[0]))]
                    if t == 0.0:
                        break
                    d = t * d
                    found = bend(v + d, delta, still)
                v, (now, g, h) = v + d, found
        return v
