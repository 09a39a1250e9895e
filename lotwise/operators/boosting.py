"""Second-order boosting of regression trees, grown from grouped sums of gradients.

Features are cut once at (approximate) quantiles, and a row becomes the numbers of its bins. Each pass over
the rows adds gradient and count per (node, feature, bin) inside a task, and sends one row per feature; the
sums of a feature meet in one task, which scans them for the best split of every node. The driver sees a row
per node and feature, never data. Three ways to grow share these passes:

* ``level``: every node splits while its gain exceeds the threshold and its depth allows;
* ``leaf``: the leaf with the largest gain splits first, up to a number of leaves. The gain of a node does not
  depend on the others, so a pass evaluates all nodes that the queue may reach next, and the queue is replayed;
* ``oblivious``: all leaves of a level share one split, so a row's leaf is the number its answers spell in bits.

The score of a set of rows is ``T(G)^2 / (H + reg_lambda)`` with ``T`` shrinking ``G`` by ``reg_alpha``; a split
gains the scores of its sides less that of the whole, and a leaf adds ``-T(G) / (H + reg_lambda)`` times the
learning rate. The loss is squared, so a gradient is the residual and ``H`` counts rows.

Gradients are rounded to whole multiples of a step so small that their sums are exact: a model does not
depend on how rows are dealt to tasks. Rows and columns of a tree are drawn by hashes and a seeded generator.
A missing value is larger than every cut.

Several models grow together (:func:`fit_together`), on all rows or on those outside a fold: each asks for the splits
of its nodes, and a pass answers all of them. A row is stored once, by the numbers of its bins among the cuts of all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.operators.persist import WithTable
from lotwise.session import via_table

REBASE = 10  # trees between two writings of the rows with their present prediction
ACCURACY = 10_000
PORTION_BYTES = 1 << 20
PASS_BYTES = 64 << 20  # sums that a task keeps for the models of a pass
SKETCHES = 128  # that a pass for the cuts keeps
FEW = 32  # values of a feature that are counted, not sketched
MANY_ROWS = 256
_SPLITS = "model bigint, node bigint, feature bigint, cut bigint, gain double, left_g double, left_h double, g double, h double"
_SUMS = "model int, feature int, sums binary"
_COUNTED = pa.schema([("feature", pa.int32()), ("value", pa.float64()), ("n", pa.list_(pa.int64()))])
NODES = "tree int, node int, feature int, threshold double, low int, high int, value double, cover double"


@dataclass
class Tree:
    """Nodes as columns; a leaf has feature -1. ``low`` is where values up to the threshold go."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("feature", -1), ("cut", -1), ("threshold", 0.0), ("low", -1), ("high", -1), ("value", value), ("cover", cover)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, threshold: float, low: int, high: int) -> None:
        self.feature[node], self.cut[node], self.threshold[node] = feature, cut, threshold
        self.low[node], self.high[node] = low, high

    def place(self, values: np.ndarray, by: str = "threshold") -> np.ndarray:
        """The node each row ends in; ``by="cut"`` for rows of bins. Missing values go high."""
        feature, limit = np.array(self.feature), np.array(getattr(self, by))
        low, high = np.array(self.low), np.array(self.high)
        node = np.zeros(len(values), np.int64)
        # While many rows share a node they are divided together, the others go on one by one.
        shared, alone = [(0, np.arange(len(values)))], False
        while shared:
            at, rows = shared.pop()
            node[rows] = at
            if feature[at] >= 0 and len(rows) >= MANY_ROWS:
                goes_low = values[:, feature[at]].take(rows) <= limit[at]
                shared += [(low[at], rows[goes_low]), (high[at], rows[~goes_low])]
            else:
                alone |= feature[at] >= 0 and len(rows) > 0
        while alone and len(open_ := np.flatnonzero(feature[node] >= 0)):
            at = node[open_]
            goes_low = values[open_, feature[at]] <= limit[at]
            node[open_] = np.where(goes_low, low[at], high[at])
        return node

    def predict(self, values: np.ndarray, by: str = "threshold") -> np.ndarray:
        return np.array(self.value)[self.place(values, by)]


def matrix(column: pd.Series | pa.Array) -> np.ndarray:
    """Feature lists of a batch as a table."""
    if isinstance(column, pa.Array):
        flat = np.asarray(column.flatten(), np.float64)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return np.stack(column.to_list()) if len(column) else np.empty((0, 0))


class TreeSumParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    base = Param(Params._dummy(), "base", "prediction before the first tree", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "factor of every leaf", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", base=0.0, scale=1.0)


class TreeSumModel(Model, TreeSumParams, WithTable):
    """``base + scale * (sum of leaves)``. The nodes are a table (:data:`NODES`) that is saved with the model;
    its size is that of the model, not of the data."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table, self._trees = table, None

    def copy(self, extra=None):
        made = TreeSumModel(self.table)
        made._trees = self._trees
        return self._copyValues(made, extra)

    @property
    def trees(self) -> list[Tree]:
        if self._trees is None:
            self._trees = trees_of(self.table.toPandas())
        return self._trees

    def _transform(self, df: DataFrame) -> DataFrame:
        trees = df.sparkSession.sparkContext.broadcast(self.trees)
        base, scale = self.getOrDefault(self.base), self.getOrDefault(self.scale)

        @F.arrow_udf("double")
        def predicted(features: pa.Array) -> pa.Array:
            x = matrix(features)
            total = np.zeros(len(x))
            for tree in trees.value:
                total += tree.predict(x)
            return pa.array(base + scale * total)

        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))


def nodes_table(spark, trees: list[Tree]) -> DataFrame:
    columns = ["feature", "threshold", "low", "high", "value", "cover"]
    parts = [pd.DataFrame({"tree": k, "node": range(len(t.feature)), **{c: getattr(t, c) for c in columns}}) for k, t in enumerate(trees)]
    rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["tree", "node", *columns])
    return spark.createDataFrame(rows, NODES)


def trees_of(rows: pd.DataFrame) -> list[Tree]:
    out = []
    for _, part in rows.sort_values(["tree", "node"]).groupby("tree"):
        columns = {c: part[c].tolist() for c in ("feature", "threshold", "low", "high", "value", "cover")}
        out.append(Tree(cut=[-1] * len(part), **columns))
    return out


def tree_sum(spark, trees: list[Tree], base: float, scale: float) -> TreeSumModel:
    model = TreeSumModel(nodes_table(spark, trees))
    model._trees = trees
    return model._set(base=base, scale=scale)


def cut_points(rows: DataFrame, features: str, size: int, bins: int) -> list[np.ndarray]:
    """For each feature the distinct quantiles that cut it into at most ``bins`` parts; the largest value is none."""
    [cuts] = cuts_of_parts(rows.withColumn("_part", F.lit(0)), features, size, {None: [bins]}).values()
    return cuts


def _within(held: int | None, c):
    """``c`` in the rows to learn from: all, or those outside of the part ``held``."""
    return c if held is None else F.when(F.col("_part") != held, c)


def cuts_of_parts(
    rows: DataFrame, features: str, size: int, wanted: dict[int | None, list[int]]
) -> dict[tuple[int | None, int], list[np.ndarray]]:
    """:func:`cut_points` by ``(held part, bins)``. Counts of bins share the sketches of their rows."""
    cells = rows.select("_part", vector_to_array(features).alias("x"))
    every = sorted({b for bins in wanted.values() for b in bins})
    out = {(h, b): [np.empty(0)] * size for h, bins in wanted.items() for b in bins}
    few = _few_valued(cells, size, list(wanted))
    for (held, b), cuts in out.items():
        for j, (values, counts) in few.items():
            ends = np.cumsum(counts[held])
            if len(ends) and ends[-1]:
                ranks = [math.ceil(k / b * int(ends[-1])) for k in range(1, b)]
                found = np.unique(values[np.searchsorted(ends, ranks)])
                cuts[j] = found[found < values[counts[held] > 0][-1]]
    many = [j for j in range(size) if j not in few]
    width = max(1, SKETCHES // len(wanted))
    for block in (many[start : start + width] for start in range(0, len(many), width)):
        x = F.col("x")
        numbers = cells.select("_part", *[F.when(~F.isnan(x[j]), x[j]).alias(f"x{j}") for j in block])
        one = []
        for i, (held, bins) in enumerate(wanted.items()):
            probs = F.array(*[F.lit(k / b) for b in every if b in bins for k in range(1, b)])
            for j in block:
                value = _within(held, F.col(f"x{j}"))
                one += [F.percentile_approx(value, probs, ACCURACY).alias(f"q{i}_{j}"), F.max(value).alias(f"m{i}_{j}")]
        row = numbers.agg(*one).first()
        for i, (held, bins) in enumerate(wanted.items()):
            for j in block:
                quantiles, at = np.array(row[f"q{i}_{j}"] or [], np.float64), 0
                for b in (b for b in every if b in bins):
                    cuts = np.unique(quantiles[at : at + b - 1])
                    at += b - 1
                    out[held, b][j] = cuts[cuts < row[f"m{i}_{j}"]] if len(cuts) else cuts
    return out


def _few_valued(cells: DataFrame, size: int, held: list[int | None]) -> dict[int, tuple[np.ndarray, dict[int | None, np.ndarray]]]:
    """The features of at most :data:`FEW` values (codes, zeros and ones): these in order, and how many rows to learn
    from have each, by held part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {j: np.empty(0) for j in range(size)}
        counts = {j: np.zeros((len(held), 0), np.int64) for j in range(size)}
        for batch in batches:
            x, part = matrix(batch.column("x")), batch.column("_part").to_numpy(zero_copy_only=False).astype(np.float64)
            outside = [~np.isnan(part) & (part != h) if h is not None else None for h in held]
            for j in list(known):
                v = x[:, j]
                at = np.searchsorted(known[j], v)
                missing = np.isnan(v)
                if len(known[j]) == 0 or not (missing | (known[j][np.minimum(at, len(known[j]) - 1)] == v)).all():
                    values = np.union1d(known[j], v[~missing])
                    if len(values) > FEW:
                        del known[j], counts[j]
                        continue
                    wider = np.zeros((len(held), len(values)), np.int64)
                    wider[:, np.searchsorted(values, known[j])] = counts[j]
                    known[j], counts[j], at = values, wider, np.searchsorted(values, v)
                n = len(known[j])
                for i, own in enumerate(outside):
                    counts[j][i] += np.bincount(at if own is None else at[own], minlength=n + 1)[:n]  # missing: after the last
        for j in range(size):
            if j not in known:
                yield pa.RecordBatch.from_pydict({"feature": [j], "value": pa.array([None], pa.float64()), "n": [[]]}, _COUNTED)
            elif len(known[j]):
                yield pa.RecordBatch.from_pydict({"feature": [j] * len(known[j]), "value": known[j], "n": counts[j].T.tolist()}, _COUNTED)

    counted = cells.mapInArrow(count, "feature int, value double, n array<bigint>").groupBy("feature", "value")
    counted = counted.agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(len(held))]).alias("n"))
    few = (F.count_if(F.col("value").isNull()) == 0) & (F.count("value") <= FEW)
    found = counted.groupBy("feature").agg(F.when(few, F.sort_array(F.collect_list(F.struct("value", "n")))).alias("values"))
    out = {}
    for row in found.where("values IS NOT NULL").collect():  # at most FEW values a feature
        n = np.array([v["n"] for v in row["values"]], np.int64)
        out[row["feature"]] = np.array([v["value"] for v in row["values"]]), {h: n[:, i] for i, h in enumerate(held)}
    return out


@dataclass
class Rules:
    """What a split must meet and what it is worth."""

    reg_lambda: float
    reg_alpha: float
    gamma: float
    least_rows: float
    num_leaves: int
    max_depth: int | None

    def shrunk(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.reg_alpha, 0.0)

    def score(self, g, h):
        t = self.shrunk(g)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h + self.reg_lambda > 0, t * t / (h + self.reg_lambda), 0.0)

    def weight(self, g: float, h: float) -> float:
        return float(-self.shrunk(g) / (h + self.reg_lambda)) if h + self.reg_lambda > 0 else 0.0


def _scanned(feature: int, sums: np.ndarray, rules: Rules, step: float, together: bool) -> pd.DataFrame:
    """The best split of every node by one feature, from sums of shape (nodes, bins, 2).

    ``together``: the one split that is best for all nodes in sum.
    """
    total = sums.sum(axis=1)
    left = np.cumsum(sums, axis=1)[:, :-1]
    g, h = total[:, None, 0] * step, total[:, None, 1]
    lg, lh = left[:, :, 0] * step, left[:, :, 1]
    gain = rules.score(lg, lh) + rules.score(g - lg, h - lh) - rules.score(g, h)
    nodes = np.arange(len(sums))
    if together:
        best = np.full(len(sums), int(np.argmax(gain.sum(axis=0))) if gain.shape[1] else -1)
    else:
        gain = np.where((lh >= rules.least_rows) & (h - lh >= rules.least_rows), gain, -np.inf)
        best = np.argmax(gain, axis=1) if gain.shape[1] else np.full(len(sums), -1)
    if not gain.shape[1]:
        return pd.DataFrame({"node": nodes, "feature": feature, "cut": -1, "gain": -np.inf, "left_g": 0.0, "left_h": 0.0, "g": g[:, 0], "h": h[:, 0]})
    return pd.DataFrame(
        {
            "node": nodes,
            "feature": feature,
            "cut": best,
            "gain": gain[:, best[0]].sum() if together else gain[nodes, best],
            "left_g": lg[nodes, best],
            "left_h": lh[nodes, best],
            "g": g[:, 0],
            "h": h[:, 0],
        }
    )


@dataclass
class Ask:
    """The best split of ``nodes`` of a tree over ``columns``; ``together``: one split for all nodes."""

    tree: Tree
    nodes: list[int]
    columns: np.ndarray
    subsample: float
    together: bool


Steps = Generator[Ask, pd.DataFrame, Tree]


class Grower:
    """A model while it grows. It yields what it asks and gets a row per node (by its place in ``nodes``)."""

    def __init__(self, rules: Rules, rate: float, seed: int, held: int | None, cuts: list[np.ndarray], n: int, base: float, span: float):
        self.rules, self.rate, self.seed, self.held, self.cuts, self.base = rules, rate, seed, held, cuts, base
        # Residuals stay within a few times the span of the label, so that sums of their multiples of ``step`` are exact.
        self.step = 2.0 ** np.ceil(np.log2(max(span, 1e-300) * 8 * n / 2**53))
        self.trees: list[Tree] = []

    def grow(self, how: str, rounds: int, width: int, subsample: float) -> Generator[Ask, pd.DataFrame, None]:
        for k in range(rounds):
            columns = np.sort(np.random.default_rng([self.seed, k]).choice(len(self.cuts), width, replace=False))
            ways = {"level": self._by_level, "leaf": self._by_leaf, "oblivious": self._oblivious}
            self.trees.append((yield from ways[how](columns, subsample)))

    def _divide(self, tree: Tree, node: int, s) -> tuple[int, int]:
        weight = self.rules.weight
        low = tree.add(weight(s.left_g, s.left_h), s.left_h)
        high = tree.add(weight(s.g - s.left_g, s.h - s.left_h), s.h - s.left_h)
        tree.split(node, int(s.feature), int(s.cut), float(self.cuts[int(s.feature)][int(s.cut)]), low, high)
        return low, high

    def _by_level(self, columns: np.ndarray, subsample: float) -> Steps:
        tree, rules = Tree(), self.rules
        level, depth = [tree.add(0.0, 0.0)], 0
        while level and (rules.max_depth is None or depth < rules.max_depth):
            below = []
            found = yield Ask(tree, level, columns, subsample, False)
            for node, s in zip(level, found.itertuples()):
                if depth == 0:
                    tree.value[node], tree.cover[node] = rules.weight(s.g, s.h), s.h
                if s.gain > max(rules.gamma, 1e-6):
                    below += self._divide(tree, node, s)
            level, depth = below, depth + 1
        return tree

    def _by_leaf(self, columns: np.ndarray, subsample: float) -> Steps:
        """Nodes are evaluated ahead of the queue, the children of the largest gains first, until it can be replayed
        to its end; what it never takes is cut off."""
        rules, full = self.rules, Tree()
        known: dict[int, tuple] = {}
        depths, ahead = {full.add(0.0, 0.0): 0}, {0: np.inf}  # not evaluated yet: the gain above them
        while True:
            taken, waiting = self._queue(full, known, depths)
            if not waiting:
                break
            nodes = waiting + sorted(set(ahead) - set(waiting), key=lambda n: (-ahead[n], n))
            nodes = nodes[: max(len(waiting), 2 * rules.num_leaves)]
            found = yield Ask(full, nodes, columns, subsample, False)
            for node, s in zip(nodes, found.itertuples()):
                if node == 0:
                    full.value[0], full.cover[0] = rules.weight(s.g, s.h), s.h
                known[node] = s
                ahead.pop(node, None)
                if s.gain > max(rules.gamma, 0.0):
                    for child in self._divide(full, node, s):
                        depths[child] = depths[node] + 1
                        if rules.max_depth is None or depths[child] < rules.max_depth:
                            ahead[child] = s.gain
        return _pruned(full, taken)

    def _queue(self, full: Tree, known: dict, depths: dict[int, int]) -> tuple[set[int], list[int]]:
        """The nodes that split, as far as is known, and those to evaluate before the next choice."""
        rules, taken, leaves = self.rules, set(), [0]
        queue: list[tuple[float, int]] = []
        while True:
            waiting = []
            for node in leaves:
                if rules.max_depth is not None and depths[node] >= rules.max_depth:
                    continue
                if node not in known:
                    waiting.append(node)  # it could come before all others
                elif full.feature[node] >= 0:
                    heapq.heappush(queue, (-known[node].gain, node))
            if len(taken) + 1 >= rules.num_leaves:
                return taken, []
            if waiting or not queue:
                return taken, waiting
            _, node = heapq.heappop(queue)
            taken.add(node)
            leaves = [full.low[node], full.high[node]]

    def _oblivious(self, columns: np.ndarray, subsample: float) -> Steps:
        tree, rules = Tree(), self.rules
        level = [tree.add(0.0, 0.0)]
        for depth in range(rules.max_depth):
            found = yield Ask(tree, level, columns, subsample, True)
            if depth == 0:
                tree.value[0], tree.cover[0] = rules.weight(found.g[0], found.h[0]), found.h[0]
            if not found.gain[0] > 1e-12:
                break
            level = [child for node, s in zip(level, found.itertuples()) for child in self._divide(tree, node, s)]
        return tree


class Passes:
    """The binned rows of all growers and the passes over them."""

    def __init__(self, rows: DataFrame, features: str, y, growers: list[Grower], tasks: int):
        self.growers, self.tasks = growers, tasks
        self.based = [0] * len(growers)
        size = len(growers[0].cuts)
        # The cuts of all growers; their own bins follow from these.
        self.cuts = [np.unique(np.concatenate([g.cuts[j] for g in growers])) for j in range(size)]
        widest = max(map(len, self.cuts), default=0)
        self.kind = np.uint8 if widest < 256 else np.uint16 if widest < 65536 else np.uint32
        self.rows = via_table(self._binned(rows.where(y.isNotNull()), features, y), "binned").persist()

    def _binned(self, rows: DataFrame, features: str, y) -> DataFrame:
        cuts, kind = self.cuts, self.kind

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("x"))
                out = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1).astype(kind)
                names = ["key", "y", "part"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), _cells(out)], [*names, "bins"])

        cells = vector_to_array(features)
        # A row is known by its content, so that a task that runs again draws the same rows.
        made = rows.select(F.xxhash64(cells, y).alias("key"), y.alias("y"), F.coalesce("_part", F.lit(-1)).alias("part"), cells.alias("x"))
        return made.mapInArrow(emit, "key bigint, y double, part int, bins binary")

    def _places(self, g: Grower) -> list[np.ndarray]:
        """For each cut of a grower its number among those of all."""
        return [np.searchsorted(all_, own) for all_, own in zip(self.cuts, g.cuts)]

    def _shared(self, g: Grower, tree: Tree) -> Tree:
        """``tree`` for rows of shared bins."""
        places = self._places(g)
        cut = [int(places[j][c]) if j >= 0 else -1 for j, c in zip(tree.feature, tree.cut)]
        return Tree(tree.feature, cut, tree.threshold, tree.low, tree.high, tree.value, tree.cover)

    def _now(self, of: Sequence[int]):
        """A function from a batch, its bins, rows and a model of ``of`` to their present predictions."""
        growers, based, many = self.growers, self.based, len(self.growers)
        grown = {m: (growers[m].base, growers[m].rate, [self._shared(growers[m], t) for t in growers[m].trees[based[m] :]]) for m in of}

        def now(batch: pa.RecordBatch, bins: np.ndarray, own, m: int) -> np.ndarray:
            base, rate, trees = grown[m]
            out = _matrix(batch.column("now"), many, np.float64)[own, m] if "now" in batch.schema.names else np.full(len(bins), base)
            for tree in trees:
                out = out + rate * tree.predict(bins, "cut")
            return out

        return now

    def rebase(self) -> None:
        """Writes the present predictions, so that passes do not walk all trees."""
        if max(len(g.trees) - b for g, b in zip(self.growers, self.based)) < REBASE:
            return
        many, size, kind = range(len(self.growers)), len(self.cuts), self.kind
        now = self._now(many)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _matrix(batch.column("bins"), size, kind)
                present = np.stack([now(batch, bins, slice(None), m) for m in many], axis=1)
                names = ["key", "y", "part", "bins"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), _cells(present)], [*names, "now"])

        old = self.rows
        self.rows = via_table(old.mapInArrow(emit, "key bigint, y double, part int, bins binary, now binary"), "boosted").persist()
        self.based = [len(g.trees) for g in self.growers]
        old.unpersist()

    def run(self, steps: dict[int, Generator[Ask, pd.DataFrame, None]]) -> None:
        """Answers the growers until none asks any more."""
        asks = {m: ask for m, own in steps.items() if (ask := next(own, None)) is not None}
        while asks:
            self.rebase()
            portion, held = {}, 0
            for m, ask in asks.items():
                held += 16 * len(ask.nodes) * sum(len(self.growers[m].cuts[j]) + 1 for j in ask.columns)
                if portion and held > PASS_BYTES:
                    break
                portion[m] = ask
            for m, found in self._best_splits(portion).items():
                del asks[m]
                try:
                    asks[m] = steps[m].send(found)
                except StopIteration:
                    pass
        self.rows.unpersist()

    def _best_splits(self, asks: dict[int, Ask]) -> dict[int, pd.DataFrame]:
        growers, size, kind, now = self.growers, len(self.cuts), self.kind, self._now(list(asks))
        models = []
        for m, ask in asks.items():
            g = growers[m]
            places = np.full(len(ask.tree.feature), -1)
            places[ask.nodes] = np.arange(len(ask.nodes))
            # From the shared bins to the own ones: cuts below a shared one. None where they are the same.
            own = [None if len(a) == len(c) else np.searchsorted(c, np.append(a, np.inf)) for a, c in zip(self.cuts, g.cuts)]
            widths = {int(j): len(g.cuts[j]) + 1 for j in ask.columns}
            limit = np.uint64(min(int(ask.subsample * 2**32), 2**32))
            models.append((m, self._shared(g, ask.tree), places, own, widths, limit, len(ask.nodes), len(g.trees), g.held, g.seed, g.step))
        rules = {m: (growers[m].rules, growers[m].step, asks[m].together, len(asks[m].nodes)) for m in asks}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(m, j): np.zeros((nodes, k, 2)) for m, _, _, _, widths, _, nodes, *_ in models for j, k in widths.items()}
            for batch in batches:
                key, y, part = (np.asarray(batch.column(c)) for c in ("key", "y", "part"))
                all_bins = _matrix(batch.column("bins"), size, kind)
                for m, tree, places, own, widths, limit, nodes, number, held, seed, step in models:
                    used = np.ones(len(y), bool) if held is None else (part != held) & (part >= 0)
                    if limit < 2**32:
                        used &= _drawn(key, number, seed) < limit
                    used = np.flatnonzero(used)
                    bins = all_bins[used]
                    at = places[tree.place(bins, "cut")]
                    open_ = at >= 0
                    g = np.rint((now(batch, bins, used, m) - y[used]) / step)
                    if not open_.all():
                        at, g, bins = at[open_], g[open_], bins[open_]
                    for j, k in widths.items():
                        cell = at * k + (bins[:, j] if own[j] is None else own[j][bins[:, j]])
                        sums[m, j][:, :, 0] += np.bincount(cell, g, nodes * k).reshape(-1, k)
                        sums[m, j][:, :, 1] += np.bincount(cell, minlength=nodes * k).reshape(-1, k)
            yield _packed(sums)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for m, j, part in zip(*(batch.column(c).to_pylist() for c in ("model", "feature", "sums"))):
                    part = np.frombuffer(part).reshape(rules[m][3], -1, 2)
                    total[m, j] = total[m, j] + part if (m, j) in total else part
            for (m, j), own in total.items():
                found = _scanned(j, own, *rules[m][:3])
                found.insert(0, "model", m)
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)

        # As many tasks add up as there are portions of sums: few for the first nodes.
        size_of_sums = sum(16 * nodes * sum(widths.values()) for _, _, _, _, widths, _, nodes, *_ in models)
        tasks = min(self.tasks, sum(len(a.columns) for a in asks.values()), 1 + size_of_sums // PORTION_BYTES)
        parts = self.rows.mapInArrow(count, _SUMS).repartition(tasks, "model", "feature")
        splits = parts.mapInArrow(scan, _SPLITS).toPandas()
        return {m: _best(splits[splits["model"] == m], ask.together) for m, ask in asks.items()}


    def held_out(self, names: Sequence[str]) -> DataFrame:
        """The label and, under ``names``, what the models of a part predict for its rows, which they were not shown."""
        size, kind = len(self.cuts), self.kind
        of = [m for m, g in enumerate(self.growers) if g.held is not None]
        by_part = {p: [m for m in of if self.growers[m].held == p] for p in {self.growers[m].held for m in of}}
        now = self._now(of)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, bins = np.asarray(batch.column("part")), _matrix(batch.column("bins"), size, kind)
                for p, models in by_part.items():
                    own = np.flatnonzero(part == p)
                    found = [now(batch, bins[own], own, m) for m in models]
                    yield pa.RecordBatch.from_arrays([batch.column("y").take(pa.array(own)), *map(pa.array, found)], ["y", *names])

        return self.rows.mapInArrow(emit, ", ".join(f"{n} double" for n in ["y", *names]))


def _best(found: pd.DataFrame, together: bool) -> pd.DataFrame:
    """A row per node: the best split over all columns."""
    order = found.sort_values(["gain", "feature", "cut"], ascending=[False, True, True], kind="stable")
    if together:
        return found[found["feature"] == order["feature"].iloc[0]].sort_values("node").reset_index(drop=True)
    return order.drop_duplicates("node").sort_values("node").reset_index(drop=True)


def _cells(table: np.ndarray) -> pa.Array:
    """The rows of a table as binary values."""
    table = np.ascontiguousarray(table)
    fixed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(table.shape[1] * table.itemsize), len(table), [None, pa.py_buffer(table.tobytes())]
    )
    return fixed.cast(pa.binary())


def _matrix(packed: pa.Array, size: int, kind) -> np.ndarray:
    """The table of :func:`_cells`."""
    if not len(packed):
        return np.empty((0, size), kind)
    offsets = np.int64 if pa.types.is_large_binary(packed.type) else np.int32
    start = int(np.frombuffer(packed.buffers()[1], offsets)[packed.offset])
    return np.frombuffer(packed.buffers()[2], kind, len(packed) * size, start).reshape(-1, size)


def _drawn(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """32 bits of a row for a tree."""
    x = key.view(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def _packed(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "model": pa.array([m for m, _ in sums], pa.int32()),
            "feature": pa.array([j for _, j in sums], pa.int32()),
            "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary()),
        }
    )


def _pruned(full: Tree, taken: set[int]) -> Tree:
    """The part of a tree whose inner nodes are ``taken``, numbered from its root."""
    out, names = Tree(), {}
    order = [0]
    for node in order:  # grows while it runs
        names[node] = out.add(full.value[node], full.cover[node])
        if node in taken:
            order += [full.low[node], full.high[node]]
    for node in taken:
        out.split(names[node], full.feature[node], full.cut[node], full.threshold[node], names[full.low[node]], names[full.high[node]])
    return out


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Boosting by one of three ways to grow: ``level``, ``leaf``, ``oblivious``."""

    how = Param(Params._dummy(), "how", "level, leaf or oblivious", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth; negative: unlimited", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "factor of every leaf", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows of a tree", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of columns of a tree", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "penalty of squared leaves", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "penalty of absolute leaves", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "gain that a split must exceed", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "rows on each side of a split", TypeConverters.toFloat)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree grown by leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "parts of a feature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, how="level", rounds=100, maxDepth=6, learningRate=0.3, subsample=1.0, colsample=1.0, regLambda=1.0,
        regAlpha=0.0, gamma=0.0, leastRows=1.0, numLeaves=31, maxBins=256, seed=42,
    ):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", how="level", rounds=100, maxDepth=6, learningRate=0.3,
            subsample=1.0, colsample=1.0, regLambda=1.0, regAlpha=0.0, gamma=0.0, leastRows=1.0, numLeaves=31, maxBins=256, seed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TreeSumModel:
        [model], _ = fit_together([(self, None)], df)
        return model

    def rules(self) -> Rules:
        get = lambda name: self.getOrDefault(getattr(self, name))
        if get("how") == "oblivious" and get("maxDepth") < 0:
            raise ValueError("an oblivious tree needs a depth")
        depth = None if get("maxDepth") < 0 else get("maxDepth")
        return Rules(get("regLambda"), get("regAlpha"), get("gamma"), get("leastRows"), get("numLeaves"), depth)


def fit_together(
    wanted: Sequence[tuple[BoostedTrees, int | None]], df: DataFrame, part=None
) -> tuple[list[TreeSumModel], Passes]:
    """A model per ``(estimator, held part)``: it learns from the rows whose number ``part`` is another, without a held
    part from all. The estimators read the same columns; each model is the one it would be alone."""
    first_of = wanted[0][0]
    features, label = first_of.getFeaturesCol(), first_of.getLabelCol()
    if any((e.getFeaturesCol(), e.getLabelCol()) != (features, label) for e, _ in wanted):
        raise ValueError("models that grow together read the same columns")
    rules = [e.rules() for e, _ in wanted]
    first = df.select(F.size(vector_to_array(features))).first()
    if first is None:
        raise ValueError("no rows to learn from")
    size, y = first[0], col(label).cast("double")
    rows = df.withColumn("_part", F.lit(0) if part is None else part.cast("int"))
    bins: dict[int | None, list[int]] = {}
    for e, held in wanted:
        bins.setdefault(held, []).append(e.getOrDefault(e.maxBins))
    cuts = cuts_of_parts(rows, features, size, bins)
    sums = [f(_within(held, y)).alias(f"{f.__name__}{i}") for i, held in enumerate(bins) for f in (F.count, F.avg, F.min, F.max)]
    labels = rows.agg(*sums).first()
    of_part = {held: [labels[f"{f}{i}"] for f in ("count", "avg", "min", "max")] for i, held in enumerate(bins)}
    if not all(n for n, *_ in of_part.values()):
        raise ValueError("no rows with a label to learn from")
    growers, steps = [], {}
    for m, (e, held) in enumerate(wanted):
        get = lambda name: e.getOrDefault(getattr(e, name))  # noqa: B023, E731
        n, base, low, high = of_part[held]
        growers.append(Grower(rules[m], get("learningRate"), get("seed"), held, cuts[held, get("maxBins")], n, base, high - low))
        width = max(1, round(get("colsample") * size))
        steps[m] = growers[m].grow(get("how"), get("rounds"), width, get("subsample"))
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    passes = Passes(rows, features, y, growers, tasks)
    passes.run(steps)
    models = [e._copyValues(tree_sum(df.sparkSession, g.trees, g.base, g.rate)) for (e, _), g in zip(wanted, growers)]
    return models, passes
