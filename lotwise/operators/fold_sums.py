"""Linear models on any part of the rows from one pass: the sums they need add up.

A pass gives, for every fold and training-size step, the products of all columns with each other and with the
label. The training sums of a fold are those of all folds less its own, those of a smaller training set stop at its
step. From a matrix as large as the columns squared follow the fit for every penalty and its errors on any part,
without the rows. Products are taken around one row's values, so that they keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col, hash_bucket
from lotwise.operators.boosting import matrix
from lotwise.operators.splits import fold_of

# What a task and the driver may hold of products; beyond, models are fitted one by one.
MAX_BYTES = 256 << 20
SIZE_STEPS = 10_000  # fixed value: parts of the key hash that training shares are counted in


def fits(columns: int, cells: int) -> bool:
    return (columns + 2) ** 2 * 8 * cells <= MAX_BYTES


class FoldSums:
    """``sums[fold, step]``: products of ``(1, columns, label)`` with each other."""

    def __init__(self, sums: np.ndarray, edges: Sequence[int]):
        self.sums, self.edges = sums, list(edges)

    @classmethod
    def of(
        cls, rows: DataFrame, folds: int, features: str, label: str, key: str, seed: int, shares: Sequence[float] = (1.0,)
    ) -> "FoldSums":
        """One pass. A row counts for a share if its second hash lies below it; the last step is the rest."""
        edges = sorted({int(s * SIZE_STEPS) for s in shares if s < 1})
        cells = vector_to_array(features)
        y = col(label).cast("double")
        first = rows.where(y.isNotNull()).select(cells.alias("x"), y.alias("y")).first()
        if first is None:
            raise ValueError("no rows with a label to learn from")
        shift = np.array([*first["x"], first["y"]])
        step = F.lit(0)
        for edge in edges:
            step = step + F.when(hash_bucket(col(key), SIZE_STEPS, seed + 1) >= edge, 1).otherwise(0)
        parts, width = folds * (len(edges) + 1), len(shift) + 1
        part = fold_of(rows, folds, key, seed) * (len(edges) + 1) + step

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                z = np.column_stack([matrix(batch.column("x")), np.asarray(batch.column("y"))]) - shift
                z = np.column_stack([np.ones(len(z)), z])
                of = np.asarray(batch.column("part"))
                for p in np.unique(of):
                    own = z[of == p]
                    total[p] = total.get(p, 0) + own.T @ own
            yield _packed(total)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for p, own in zip(batch.column("part").to_pylist(), batch.column("products").to_pylist()):
                    total[p] = total.get(p, 0) + np.frombuffer(own)
            yield _packed(total)

        schema = "part int, products binary"
        keyed = rows.where(y.isNotNull()).select(cells.alias("x"), y.alias("y"), F.coalesce(part, F.lit(0)).cast("int").alias("part"))
        summed = keyed.mapInArrow(products, schema).repartition(parts, "part").mapInArrow(merge, schema)
        sums = np.zeros((parts, width, width))
        for row in summed.toArrow().to_pylist():
            sums[row["part"]] += np.frombuffer(row["products"]).reshape(width, width)
        return cls(sums.reshape(folds, len(edges) + 1, width, width), edges)

    def training(self, fold: int, share: float = 1.0) -> np.ndarray:
        steps = len(self.edges) + 1 if share >= 1 else self.edges.index(int(share * SIZE_STEPS)) + 1
        others = np.arange(len(self.sums)) != fold
        return self.sums[others, :steps].sum(axis=(0, 1))

    def held(self, fold: int) -> np.ndarray:
        return self.sums[fold].sum(axis=0)


def _packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(list(total), pa.int32()), "products": pa.array([np.ascontiguousarray(x).tobytes() for x in total.values()], pa.binary())}
    )


def _centred(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means, and products around the means."""
    n = sums[0, 0]
    means = sums[0, 1:] / n
    return n, means, sums[1:, 1:] - n * np.outer(means, means)


def solve(sums: np.ndarray, l1: float, l2: float, tol: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """``(intercept, weights)`` that minimise ``sum(e^2) / 2n + l1 |w| + l2 / 2 w'w``, in the shifted columns."""
    n, means, around = _centred(sums)
    g, c = around[:-1, :-1] / n, around[:-1, -1] / n
    if l1 == 0:
        w = np.linalg.lstsq(g + l2 * np.eye(len(c)), c, rcond=None)[0]
    else:
        w, diagonal = np.zeros(len(c)), np.diag(g) + l2
        slope = c.copy()  # c - g w
        live = np.flatnonzero(diagonal > 1e-14)
        for turn in range(rounds):
            moved = 0.0
            # Every other time all columns, else those in use.
            for j in live if turn % 10 == 0 else live[w[live] != 0]:
                r = slope[j] + g[j, j] * w[j]
                new = np.sign(r) * max(abs(r) - l1, 0.0) / diagonal[j]
                if new != w[j]:
                    slope -= g[:, j] * (new - w[j])
                    moved = max(moved, abs(new - w[j]) * diagonal[j] ** 0.5)
                    w[j] = new
            if moved < tol and turn % 10 == 0:
                break
    return np.concatenate([[means[-1] - means[:-1] @ w], w])


def rmse(sums: np.ndarray, model: np.ndarray) -> float:
    """Root of the mean squared error of a fit over the rows of ``sums``."""
    v = np.append(-model, 1.0)  # y - intercept - x'w
    return float(np.sqrt(max(v @ sums @ v, 0.0) / sums[0, 0])) if sums[0, 0] else float("nan")
