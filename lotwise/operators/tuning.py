"""Cross-validation, random search and the two error curves.

Folds are a hash of the row key, models run on one encoded table. Linear models are scored for all settings, folds
and training shares from one pass (``fold_sums``). For others the loops below run over model settings and folds,
never over rows; jobs of different folds overlap through a small thread pool.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col, hash_bucket
from lotwise.operators import fold_sums
from lotwise.operators.fold_sums import FoldSums
from lotwise.operators.models import DEEPEST, PenalizedLinear, build_model
from lotwise.operators.splits import FOLD_SEED, LOG_TARGET, fold_of
from lotwise.schema import ID

# ---------------------------------------------------------------- fixed values
GRIDS: dict[str, dict[str, list]] = {
    "ridge": {"alpha": [0.01, 0.1, 1.0, 5.0, 10.0, 20.0, 50.0, 100.0]},
    "lasso": {"alpha": [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1]},
    "elasticnet": {"alpha": [0.0001, 0.001, 0.01, 0.1], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
    "random_forest": {
        "n_estimators": [100, 200, 300, 400],
        "max_depth": [6, 8, 10, 12, 16, None],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
    },
    "extra_trees": {
        "n_estimators": [100, 200, 300, 400],
        "max_depth": [6, 8, 10, 12, 16, None],
        "min_samples_split": [2, 5, 10],
    },
    "gradient_boosting": {
        "n_estimators": [100, 200, 300],
        "max_depth": [2, 3, 4, 5],
        "learning_rate": [0.01, 0.03, 0.05, 0.1],
        "subsample": [0.7, 0.8, 0.9, 1.0],
    },
    "xgboost": {
        "n_estimators": [200, 300, 400, 600],
        "max_depth": [3, 4, 5, 6, 8],
        "learning_rate": [0.01, 0.03, 0.05, 0.1],
        "subsample": [0.6, 0.8, 1.0],
        "colsample": [0.6, 0.8, 1.0],
    },
    "lightgbm": {
        "n_estimators": [200, 300, 400, 600],
        "max_depth": [3, 4, 6, 8, None],
        "learning_rate": [0.01, 0.03, 0.05, 0.1],
        "subsample": [0.6, 0.8, 1.0],
    },
    "svr": {"C": [0.1, 1.0, 10.0, 50.0, 100.0], "epsilon": [0.001, 0.01, 0.05, 0.1]},
    "knn": {"n_neighbors": [3, 5, 10, 15, 20], "weights": ["uniform", "distance"]},
}
# Ranges of the boosting search: (kind, low, high).
BOOSTING_RANGES = {
    "n_estimators": ("int", 150, 700),
    "max_depth": ("int", 3, 9),
    "learning_rate": ("log", 0.01, 0.2),
    "subsample": ("float", 0.6, 1.0),
    "colsample": ("float", 0.6, 1.0),
    "reg_alpha": ("log", 1e-4, 10.0),
    "reg_lambda": ("log", 1e-4, 10.0),
}
LEARNING_SHARES = [0.1, 0.28, 0.46, 0.64, 0.82, 1.0]
# ------------------------------------------------------------ end fixed values

SCORES = "fold int, train_rmse double, rmse double"


def _rmse(model, rows: DataFrame, label: str) -> float:
    error = col(label) - F.col("prediction")
    return model.transform(rows).agg(F.sqrt(F.avg(error * error))).first()[0]


def linear_scores(
    estimators: Sequence[Estimator],
    rows: DataFrame,
    folds: int,
    label: str = LOG_TARGET,
    key: str = ID,
    seed: int = FOLD_SEED,
    shares: Sequence[float] = (1.0,),
) -> dict[tuple[int, float], list[tuple[int, float, float]]] | None:
    """``{(estimator, share): [(fold, train rmse, validation rmse)]}`` of linear models from one pass over the rows.

    ``None`` where they are not all linear on the same columns, or there are too many columns for that.
    """
    if not all(isinstance(e, PenalizedLinear) for e in estimators) or len({e.getFeaturesCol() for e in estimators}) != 1:
        return None
    features = estimators[0].getFeaturesCol()
    first = rows.select(F.size(vector_to_array(features))).first()
    if first is None or not fold_sums.fits(first[0], folds * (len(set(shares)) + 1)):
        return None
    sums = FoldSums.of(rows, folds, features, label, key, seed, shares)
    out: dict[tuple[int, float], list[tuple[int, float, float]]] = {}
    for share in shares:
        for f in range(folds):
            train, held = sums.training(f, share), sums.held(f)
            for i, e in enumerate(estimators):
                fit = fold_sums.solve(train, *e.penalties(train[0, 0]))
                out.setdefault((i, share), []).append((f, fold_sums.rmse(train, fit), fold_sums.rmse(held, fit)))
    return out


def fold_scores(
    estimator: Estimator | Callable[[], Estimator],
    rows: DataFrame,
    folds: int,
    label: str = LOG_TARGET,
    key: str = ID,
    seed: int = FOLD_SEED,
    with_train: bool = False,
    share: float | None = None,
    threads: int = 4,
) -> list[tuple[int, float | None, float]]:
    """``(fold, train rmse, validation rmse)`` per fold, on the log target.

    ``share`` trains on the part of the other folds whose key hash lies below it.
    """
    linear = None if callable(estimator) else linear_scores([estimator], rows, folds, label, key, seed, (share or 1.0,))
    if linear is not None:
        return [(f, tr if with_train else None, va) for f, tr, va in linear[0, share or 1.0]]
    fold = fold_of(rows, folds, key, seed)

    def one(f: int):
        made = estimator() if callable(estimator) else estimator.copy()
        train = rows.where(fold != f)
        if share is not None and share < 1:
            train = train.where(hash_bucket(col(key), 10_000, seed + 1) < int(share * 10_000))
        model = made.fit(train)
        return f, (_rmse(model, train, label) if with_train else None), _rmse(model, rows.where(fold == f), label)

    with ThreadPool(min(threads, folds)) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(one), range(folds))


def shared_fold_scores(
    models: Mapping[str, Estimator], rows: DataFrame, folds: int, label: str = LOG_TARGET, key: str = ID, seed: int = FOLD_SEED
) -> dict[str, list[tuple[int, float | None, float]]]:
    """:func:`fold_scores` of the linear ones among ``models`` by name: one pass over the rows, however many they are.

    Empty where they cannot share it.
    """
    names = [n for n, e in models.items() if isinstance(e, PenalizedLinear)]
    found = linear_scores([models[n] for n in names], rows, folds, label, key, seed) if names else None
    return {n: [(f, None, va) for f, _, va in found[i, 1.0]] for i, n in enumerate(names)} if found else {}


def cross_val_scores(estimator, rows: DataFrame, folds: int, **options) -> DataFrame:
    """``fold, rmse``."""
    scores = fold_scores(estimator, rows, folds, **options)
    return rows.sparkSession.createDataFrame([(f, float(v)) for f, _, v in scores], "fold int, rmse double")


def mean_std(values: Sequence[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


# Settings without a counterpart here: they would repeat the same fit under another name.
VOID = {"random_forest": ["min_samples_split"]}


def effective(name: str, point: dict) -> dict:
    """What a point means here: no void settings, and an unlimited depth is the deepest there is (trees that
    are grown leaf by leaf need none)."""
    known = {k: v for k, v in point.items() if k not in VOID.get(name, ())}
    if name != "lightgbm" and "max_depth" in known and known["max_depth"] is None:
        known["max_depth"] = DEEPEST
    return known


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def distinct_points(name: str, points: Sequence[dict]) -> list[dict]:
    """The effective points in order, each once."""
    seen = {tuple(p.items()): p for p in (effective(name, p) for p in points)}
    return list(seen.values())


def _search(name: str, points: list[dict], rows: DataFrame, folds: int, seed: int) -> DataFrame:
    out = []
    linear = linear_scores([build_model(name, seed, **p) for p in points], rows, folds) if points else None
    for i, point in enumerate(points):
        scores = linear[i, 1.0] if linear else fold_scores(lambda: build_model(name, seed, **point), rows, folds)
        mean, std = mean_std([s[2] for s in scores])
        out.append((i, {k: str(v) for k, v in point.items()}, VOID.get(name, []), mean, std))
    trials = rows.sparkSession.createDataFrame(
        out, "trial int, params map<string,string>, void array<string>, cv_rmse_mean double, cv_rmse_std double"
    )
    best = min(out, key=lambda t: (t[3], t[0]))[0]
    return trials.withColumn("is_best", F.col("trial") == best)


def random_search(
    name: str,
    rows: DataFrame,
    n_iter: int = 30,
    folds: int = 3,
    seed: int = 42,
    grid: dict[str, list] | None = None,
) -> DataFrame:
    """``trial, params, void, cv_rmse_mean, cv_rmse_std, is_best`` of a seeded draw from the grid.

    Points that mean the same fit are one point; ``void`` names the settings that change nothing.
    """
    if grid is None:
        if name not in GRIDS:
            raise ValueError(f"No grid is defined for '{name}'.")
        grid = GRIDS[name]
    points = distinct_points(name, grid_points(grid))
    drawn = random.Random(seed).sample(points, min(n_iter, len(points)))
    return _search(name, drawn, rows, folds, seed)


def draw(ranges: dict[str, tuple], rng: random.Random) -> dict:
    """One point of the ranges: whole numbers, uniform or log-uniform values."""
    point: dict = {}
    for name, (kind, low, high) in ranges.items():
        if kind == "int":
            point[name] = rng.randint(low, high)
        elif kind == "log":
            point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            point[name] = rng.uniform(low, high)
    return point


def range_search(
    name: str,
    rows: DataFrame,
    ranges: dict[str, tuple] | None = None,
    n_trials: int = 50,
    folds: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Like :func:`random_search`, over ranges instead of lists (by default those of the boosting models)."""
    return _search(name, distinct_points(name, drawn_points(ranges or BOOSTING_RANGES, n_trials, seed)), rows, folds, seed)


def drawn_points(ranges: dict[str, tuple], n_trials: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    return [draw(ranges, rng) for _ in range(n_trials)]


def learning_curve(
    make: Callable[[], Estimator], rows: DataFrame, folds: int = 3, shares: Sequence[float] = LEARNING_SHARES
) -> DataFrame:
    """``share, train_rmse, validation_rmse`` (means over the folds)."""
    out = []
    linear = linear_scores([make()], rows, folds, shares=shares)
    for share in shares:
        scores = linear[0, share] if linear else fold_scores(make, rows, folds, with_train=True, share=share)
        out.append((share, mean_std([s[1] for s in scores])[0], mean_std([s[2] for s in scores])[0]))
    return rows.sparkSession.createDataFrame(out, "share double, train_rmse double, validation_rmse double")


def validation_curve(
    name: str, param: str, values: Sequence, rows: DataFrame, folds: int = 3, seed: int = 42
) -> DataFrame:
    """``value, train_rmse, validation_rmse`` (means over the folds)."""
    out = []
    linear = linear_scores([build_model(name, seed, **{param: v}) for v in values], rows, folds) if values else None
    for i, value in enumerate(values):
        made = lambda: build_model(name, seed, **{param: value})  # noqa: B023, E731
        scores = linear[i, 1.0] if linear else fold_scores(made, rows, folds, with_train=True)
        out.append((float(value), mean_std([s[1] for s in scores])[0], mean_std([s[2] for s in scores])[0]))
    return rows.sparkSession.createDataFrame(out, "value double, train_rmse double, validation_rmse double")
