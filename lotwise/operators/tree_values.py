"""Exact Shapley values of tree models against background rows, a batch of rows at a time.

A leaf is reached if every feature on its path lies in an interval. With some features from the row and the others
from a background row, that takes all features where only the row fits (``a`` of them) from the row and all where
only the background row fits (``b``) from that. The Shapley values of such a game are ``(a-1)! b! / (a+b)!`` times
the leaf for the former and ``-a! (b-1)! / (a+b)!`` for the latter, so values are sums over leaves, without walks
over subsets or permutations. Rows that fit the same features of a path share them, as do background rows.

Contributions and the mean prediction of the background add up to the prediction of the row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressionModel,
    LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.boosting import Tree, TreeSumModel, matrix


@dataclass
class TreeSum:
    """``base`` plus the trees, each times its weight."""

    base: float
    weighted: list[tuple[float, Tree]]


_NODE = re.compile(r"^\s*(If|Else) \(feature (\d+) (<=|>|in|not in) ([^)]+)\)|^\s*Predict: (\S+)")


def parsed(text: str) -> list[Tree]:
    """The trees of a model of Spark, from its own description (numbers stand there in full).

    Columns of zeros and ones may be split by sets, which are halves; other sets have no interval.
    """
    out: list[Tree] = []
    turned: list[tuple[Tree, int]] = []
    waiting: list[tuple[Tree, int]] = []  # nodes whose other side is still to come

    def attach(tree: Tree, value: float) -> int:
        node = tree.add(value, 0.0)
        if waiting and node:
            _, parent = waiting[-1]
            if tree.low[parent] < 0:
                tree.low[parent] = node
            else:
                tree.high[parent] = node
                waiting.pop()
        return node

    for line in text.splitlines():
        found = _NODE.match(line)
        if not found:
            continue
        if not waiting and found[1] != "Else":
            out.append(Tree())
        tree = out[-1]
        if found[1] == "If":
            node = attach(tree, 0.0)
            tree.feature[node] = int(found[2])
            if found[3] == "in":
                if found[4] not in ("{0.0}", "{1.0}"):
                    raise ValueError(f"a split by the set {found[4]}")
                tree.threshold[node] = 0.5
                if found[4] == "{1.0}":
                    turned.append((tree, node))
            else:
                tree.threshold[node] = float(found[4])
            waiting.append((tree, node))
        elif found[5] is not None:
            attach(tree, float(found[5]))
    for tree, node in turned:
        tree.low[node], tree.high[node] = tree.high[node], tree.low[node]
    return out


_SETS = re.compile(r" in \{(?!0\.0\}|1\.0\})")


def tree_sum_of(model: Transformer) -> TreeSum | None:
    """The model as weighted trees; ``None`` if it is none. Means and linear combinations of trees are trees too."""
    if isinstance(model, TreeSumModel):
        return TreeSum(model.getOrDefault(model.base), [(model.getOrDefault(model.scale), t) for t in model.trees])
    if _SETS.search(getattr(model, "toDebugString", "").replace(" not in {", "")):
        return None  # splits by sets of codes
    if isinstance(model, DecisionTreeRegressionModel):
        return TreeSum(0.0, [(1.0, t) for t in parsed(model.toDebugString)])
    if isinstance(model, RandomForestRegressionModel):
        return TreeSum(0.0, [(1.0 / model.getNumTrees, t) for t in parsed(model.toDebugString)])
    if isinstance(model, GBTRegressionModel):
        return TreeSum(0.0, list(zip(model.treeWeights, parsed(model.toDebugString))))
    if isinstance(model, PipelineModel) and len(model.stages) > 1:
        *parts, last = model.stages
        if isinstance(last, LinearRegressionModel) and isinstance(parts[-1], VectorAssembler):
            parts.pop()
            weights, base = list(last.coefficients), last.intercept
        elif isinstance(last, SQLTransformer):
            weights, base = [1.0 / len(parts)] * len(parts), 0.0
        else:
            return None
        sums = [tree_sum_of(p) for p in parts]
        if any(s is None for s in sums):
            return None
        base += sum(w * s.base for w, s in zip(weights, sums))
        return TreeSum(base, [(w * v, t) for w, s in zip(weights, sums) for v, t in s.weighted])
    return None


def leaves(tree: Tree) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """``(value, features, above, up to)`` per leaf: the interval of each feature on its path."""
    out, open_ = [], [(0, {})]
    while open_:
        node, box = open_.pop()
        feature = tree.feature[node]
        if feature < 0:
            names = sorted(box)
            out.append((tree.value[node], np.array(names, np.int64), *(np.array([box[f][k] for f in names]) for k in (0, 1))))
            continue
        low, high = box.get(feature, (-math.inf, math.inf))
        cut = tree.threshold[node]
        open_.append((tree.low[node], {**box, feature: (low, min(high, cut))}))
        open_.append((tree.high[node], {**box, feature: (max(low, cut), high)}))
    return out


def _weights(size: int) -> np.ndarray:
    """``[a, b]``: (a-1)! b! / (a+b)!, the share of one of ``a`` features."""
    out = np.zeros((size + 1, size + 1))
    for a in range(1, size + 1):
        for b in range(size + 1):
            out[a, b] = math.exp(math.lgamma(a) + math.lgamma(b + 1) - math.lgamma(a + b + 1))
    return out


def shapley(weighted: list[tuple[float, Tree]], x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Contributions of every feature for every row of ``x``, against the mean over ``background``."""
    # Missing values go to the high side everywhere.
    x, background = (np.where(np.isnan(v), np.inf, v) for v in (x, background))
    out = np.zeros(x.shape)
    for scale, tree in weighted:
        for value, features, above, up_to in leaves(tree):
            size = len(features)
            if not size or value == 0:
                continue
            fits, fit = ((v[:, features] > above) & (v[:, features] <= up_to) for v in (x, background))
            own, of = np.unique(fits, axis=0, return_inverse=True)
            other, times = np.unique(fit, axis=0, return_counts=True)
            from_row, from_other = own[:, None, :] & ~other, ~own[:, None, :] & other
            reached = (own[:, None, :] | other).all(axis=2)
            a, b = from_row.sum(axis=2), from_other.sum(axis=2)
            table = _weights(size)
            share = times * reached / len(background)
            part = np.einsum("uz,uzk->uk", share * table[a, b], from_row) - np.einsum("uz,uzk->uk", share * table[b, a], from_other)
            np.add.at(out, (slice(None), features), scale * value * part[of.reshape(-1)])
    return out


def tree_cells(model: TreeSum, sample: DataFrame, names: list[str], features: str = "features") -> tuple[Column, float]:
    """The cells (``feature, x, contribution``) of a row as an expression over it, and the base value.

    ``sample`` are the background rows: few, they go to every task.
    """
    rows = sample.select(vector_to_array(features).alias("x")).toArrow().column("x").combine_chunks()
    background = matrix(rows)
    base = model.base + float(np.mean(sum(w * t.predict(background) for w, t in model.weighted)) if model.weighted else 0.0)
    sent = sample.sparkSession.sparkContext.broadcast((model.weighted, background))

    @F.arrow_udf("array<double>")
    def contributions(x: pa.Array) -> pa.Array:
        weighted, others = sent.value
        table = matrix(x)
        if not len(table):
            return pa.array([], pa.list_(pa.float64()))
        found = shapley(weighted, table, others)
        offsets = pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))

    x = vector_to_array(features)
    labels = F.array(*[F.lit(str(n)) for n in names])
    cells = F.zip_with(x, contributions(x), lambda v, c: F.struct(v.alias("x"), c.alias("contribution")))
    return F.transform(cells, lambda c, i: F.struct(labels[i].alias("feature"), c["x"].alias("x"), c["contribution"].alias("contribution"))), base
