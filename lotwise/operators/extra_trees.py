"""Extremely randomised trees: every node draws one threshold per feature and keeps the best.

All trees of a group grow at once, level by level, with two passes over the rows: the first finds the smallest
and largest value per (tree, node, feature), between which the threshold is drawn by a hash of seed, tree, node
and feature; the second sums count and label of the rows up to it. Both send a row per node from each task. The
sums of a node meet in one task, which chooses its split. Thresholds go to the tasks in portions of
``PORTION_BYTES``, so their size does not follow the number of trees or leaves, nor that of the data.

Labels are rounded to whole multiples of a step so small that sums are exact: a model does not depend on how
rows are dealt to tasks. A missing value is larger than every threshold and takes no part in the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.operators.boosting import Tree, TreeSumModel, matrix, tree_sum
from lotwise.session import via_table

PORTION_BYTES = 32 << 20
PRIME = 2147483647  # fixed value: 2^31 - 1, so products stay inside 64 bits


def drawn(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that SQL can repeat: multiplications modulo a prime, with shifted bits between them."""
    h = np.int64(seed % PRIME)
    for part in (tree, node, feature):
        h = (h + part + 1) % PRIME * 48271 % PRIME
        h = (h ^ (h >> 13)) * 69621 % PRIME
        h = h ^ (h >> 11)
    h = h * 48271 % PRIME
    return (h ^ (h >> 15)) * 69621 % PRIME / PRIME


class _Level:
    """The open nodes of a group of trees: ``(tree, heap number of the node, its place in the tree)``."""

    def __init__(self, trees: list[Tree], nodes: list[tuple[int, int, int]]):
        self.trees, self.nodes = trees, nodes
        self.of_tree: dict[int, np.ndarray] = {}
        for slot, (tree, _, place) in enumerate(nodes):
            self.of_tree.setdefault(tree, np.full(len(trees[tree].feature), -1))[place] = slot

    def grouped(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per tree ``(rows in the order of their nodes, slots, first row of each slot)``."""
        for tree, slots in self.of_tree.items():
            slot = slots[self.trees[tree].place(x)]
            order = np.argsort(slot, kind="stable")
            order = order[np.searchsorted(slot[order], 0) :]
            if len(order):
                used, first = np.unique(slot[order], return_index=True)
                yield order, used, first


_PACKED = "slot int, a binary, b binary"


def _merged(parts: DataFrame, tasks: int, add, done, schema: str) -> DataFrame:
    """Adds the packed rows of a slot from all tasks; ``done`` turns the sums of a task's slots into a batch."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for slot, a, b in zip(*(batch.column(c).to_pylist() for c in ("slot", "a", "b"))):
                own = np.frombuffer(a), np.frombuffer(b)
                total[slot] = add(total[slot], own) if slot in total else own
        if total:
            yield done(total)

    return parts.repartition(tasks, "slot").mapInArrow(merge, schema)


def _packed(slots: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"slot": pa.array(slots.astype(np.int32)), "a": pa.array([x.tobytes() for x in a]), "b": pa.array([x.tobytes() for x in b])}
    )


def _kept(slots: int, width: int, start: float) -> tuple[np.ndarray, np.ndarray]:
    return np.full((slots, width), start), np.full((slots, width), -start)


class ExtraTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """The mean of trees with drawn thresholds; fits to a :class:`TreeSumModel`."""

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth", TypeConverters.toInt)
    leastSplit = Param(Params._dummy(), "leastSplit", "rows a node needs to split", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, trees=100, maxDepth=12, leastSplit=2, seed=42):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", trees=100, maxDepth=12, leastSplit=2, seed=42
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TreeSumModel:
        y = col(self.getLabelCol()).cast("double")
        cells = vector_to_array(self.getFeaturesCol())
        rows = via_table(df.where(y.isNotNull()).select(cells.alias("x"), y.alias("y")), "extra").persist()
        n, low, high, size = rows.agg(F.count("y"), F.min("y"), F.max("y"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows with a label to learn from")
        step = 2.0 ** np.ceil(np.log2(max(high - low, 1e-300) * 2 * n / 2**53))
        count, total = self.getOrDefault(self.trees), []
        # A group is as many trees as fit into a portion when they are about to end.
        width = max(1, PORTION_BYTES // (16 * size * min(n, 2 ** min(self.getOrDefault(self.maxDepth), 40))))
        for first in range(0, count, width):
            total += self._group(rows, range(first, min(first + width, count)), size, float(low), step)
        rows.unpersist()
        return self._copyValues(tree_sum(df.sparkSession, total, 0.0, 1.0 / count))

    def _group(self, rows: DataFrame, numbers: range, size: int, low: float, step: float) -> list[Tree]:
        trees = [Tree() for _ in numbers]
        open_ = [(t, 1, tree.add(0.0, 0.0)) for t, tree in enumerate(trees)]
        for depth in range(max(1, self.getOrDefault(self.maxDepth))):
            below = []
            share = max(1, PORTION_BYTES // (16 * size))
            for first in range(0, len(open_), share):
                below += self._split(rows, trees, open_[first : first + share], numbers.start, size, low, step, depth)
            if not below:
                break
            open_ = below
        return trees

    def _split(self, rows, trees, nodes, start: int, size: int, low: float, step: float, depth: int) -> list[tuple[int, int, int]]:
        """Splits the nodes that can be split and returns their children."""
        level, spark = _Level(trees, nodes), rows.sparkSession
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(nodes)))
        seed, least = self.getOrDefault(self.seed), self.getOrDefault(self.leastSplit)
        names = np.array([(start + t, heap) for t, heap, _ in nodes], np.int64)

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lows, highs = _kept(len(nodes), size, np.inf)
            for batch in batches:
                x = matrix(batch.column("x"))
                for order, used, first in level.grouped(x):
                    lows[used] = np.fmin(lows[used], np.fmin.reduceat(x[order], first, axis=0))
                    highs[used] = np.fmax(highs[used], np.fmax.reduceat(x[order], first, axis=0))
            used = np.flatnonzero((lows <= highs).any(axis=1))
            yield _packed(used, lows[used], highs[used])

        def draw(total: dict) -> pa.RecordBatch:
            slots = np.array(list(total))
            lows, highs = (np.stack([total[s][k] for s in slots]) for k in (0, 1))
            u = drawn(seed, names[slots, 0][:, None], names[slots, 1][:, None], np.arange(size)[None, :])
            # NaN: the feature has one value in the node, nothing to draw.
            return _packed(slots, np.where(lows < highs, lows + u * (highs - lows), np.nan), np.empty((len(slots), 0)))

        def extremes(a, b):
            return np.fmin(a[0], b[0]), np.fmax(a[1], b[1])

        limits = np.full((len(nodes), size), np.nan)
        for row in _merged(rows.select("x").mapInArrow(bounds, _PACKED), tasks, extremes, draw, _PACKED).toArrow().to_pylist():
            limits[row["slot"]] = np.frombuffer(row["a"])
        sent = spark.sparkContext.broadcast(limits)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Count and label of the rows up to each threshold; the last column has all rows of the node.
            counts, labels = np.zeros((len(nodes), size + 1)), np.zeros((len(nodes), size + 1))
            for batch in batches:
                x, y = matrix(batch.column("x")), np.rint((np.asarray(batch.column("y")) - low) / step)
                for order, used, first in level.grouped(x):
                    of = np.repeat(used, np.diff(np.append(first, len(order))))
                    under = np.ones((len(order), size + 1))
                    under[:, :size] = x[order] <= sent.value[of]
                    counts[used] += np.add.reduceat(under, first, axis=0)
                    labels[used] += np.add.reduceat(under * y[order][:, None], first, axis=0)
            used = np.flatnonzero(counts[:, -1] > 0)
            yield _packed(used, counts[used], labels[used])

        def choose(total: dict) -> pa.RecordBatch:
            slots = np.array(list(total))
            counts, labels = (np.stack([total[s][k] for s in slots]) for k in (0, 1))
            n, s = counts[:, -1:], labels[:, -1:] * step
            nl, sl = counts[:, :-1], labels[:, :-1] * step
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n
            gain = np.where((nl > 0) & (nl < n), gain, -np.inf)
            best, at = np.argmax(gain, axis=1), np.arange(len(slots))
            out = {"slot": slots, "feature": best, "gain": gain[at, best], "nl": nl[at, best], "sl": sl[at, best], "n": n[:, 0], "s": s[:, 0]}
            return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

        plus = lambda a, b: (a[0] + b[0], a[1] + b[1])
        schema = "slot bigint, feature bigint, gain double, nl double, sl double, n double, s double"
        found = _merged(rows.mapInArrow(sums, _PACKED), tasks, plus, choose, schema).toArrow().to_pylist()
        below = []
        for r in sorted(found, key=lambda r: r["slot"]):
            number, heap, place = nodes[r["slot"]]
            tree = trees[number]
            if depth == 0:
                tree.value[place], tree.cover[place] = low + r["s"] / r["n"], r["n"]
            # A gain of rounding size is none: all labels of the node are equal.
            if depth >= self.getOrDefault(self.maxDepth) or r["n"] < least or not r["gain"] > 1e-12 * max(1.0, r["s"] ** 2 / r["n"]):
                continue
            sides = [(r["nl"], r["sl"]), (r["n"] - r["nl"], r["s"] - r["sl"])]
            low_at, high_at = (tree.add(low + s / n, n) for n, s in sides)
            tree.split(place, r["feature"], -1, float(limits[r["slot"], r["feature"]]), low_at, high_at)
            below += [(number, 2 * heap, low_at), (number, 2 * heap + 1, high_at)]
        return below
