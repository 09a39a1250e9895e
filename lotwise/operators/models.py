"""The model zoo: names to Spark ML estimators on ``features`` -> ``log_target``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col, hash_bucket
from lotwise.operators.boosting import BoostedTrees, fit_together
from lotwise.operators.encoding import FEATURES
from lotwise.operators.extra_trees import ExtraTrees
from lotwise.operators.kernel import KernelRegressor
from lotwise.operators.knn import KnnRegressor
from lotwise.operators.splits import LOG_TARGET
from lotwise.schema import ID
from lotwise.session import via_table

# The normal-equation solver keeps one (features x features) matrix; Spark allows it up to here.
NORMAL_SOLVER_LIMIT = 4096


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LOG_TARGET, predictionCol="prediction")

    def _columns(self) -> dict[str, str]:
        return {"featuresCol": self.getFeaturesCol(), "labelCol": self.getLabelCol(), "predictionCol": self.getPredictionCol()}


class PenalizedLinear(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Linear regression whose penalties are stated per unit of the label.

    Minimises ``sum(e^2) / 2n + alpha * l1Ratio * |w| + alpha * (1 - l1Ratio) / 2 * w'w``; with
    ``summed=True`` (ridge) the penalty is ``alpha * w'w`` against ``sum(e^2)``. Spark scales the
    squared penalty by the label's deviation, so it is multiplied back. Fits to a plain
    ``LinearRegressionModel``.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "share of the absolute penalty", TypeConverters.toFloat)
    summed = Param(Params._dummy(), "summed", "penalty against the sum, not the mean, of squares", TypeConverters.toBoolean)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, alpha=1.0, l1Ratio=0.0, summed=False, maxIter=1000):
        super().__init__()
        self._setDefault(alpha=1.0, l1Ratio=0.0, summed=False, maxIter=1000)
        self._set(**self._input_kwargs)

    def penalties(self, n: float) -> tuple[float, float]:
        """The absolute and the squared penalty per row."""
        alpha = self.getOrDefault(self.alpha) / (n if self.getOrDefault(self.summed) else 1)
        ratio = self.getOrDefault(self.l1Ratio)
        return alpha * ratio, alpha * (1 - ratio)

    def _fit(self, df: DataFrame) -> LinearRegressionModel:
        label = col(self.getLabelCol())
        # A dense vector's length is not in the schema of a parquet table: read one row. The sums read the label only.
        first = df.select(F.size(vector_to_array(self.getFeaturesCol()))).first()
        if first is None:
            raise ValueError("no rows to learn from")
        n, pop, samp = df.agg(F.count(label), F.stddev_pop(label), F.stddev_samp(label)).first()
        p = first[0]
        normal = p <= NORMAL_SOLVER_LIMIT
        l1, l2 = self.penalties(n)
        l2 *= pop if normal else samp
        penalty = l1 + l2
        return LinearRegression(
            **self._columns(),
            regParam=penalty,
            elasticNetParam=l1 / penalty if penalty else 0.0,
            standardization=False,
            solver="normal" if normal else "l-bfgs",
            maxIter=self.getOrDefault(self.maxIter),
            tol=1e-9,
        ).fit(df)


def _renamed(estimator: Estimator, prediction: str, features: str, label: str) -> Estimator:
    copy = estimator.copy()
    return copy._set(predictionCol=prediction, featuresCol=features, labelCol=label)


class Stacking(Estimator, _Columns):
    """Base models' out-of-fold predictions feed a ridge; fits to a plain ``PipelineModel``."""

    def __init__(self, bases: list[Estimator], folds: int = 3, alpha: float = 1.0, key: str = ID):
        super().__init__()
        self.bases, self.folds, self.alpha, self.key = bases, folds, alpha, key

    def copy(self, extra=None):
        out = Stacking([b.copy() for b in self.bases], self.folds, self.alpha, self.key)
        return self._copyValues(out, extra)

    def _fit(self, df: DataFrame) -> PipelineModel:
        names = [f"base_{i}" for i in range(len(self.bases))]
        bases = [_renamed(b, n, self.getFeaturesCol(), self.getLabelCol()) for b, n in zip(self.bases, names)]
        fold = hash_bucket(col(self.key), self.folds, 977)
        keep = [col(self.key), col(self.getFeaturesCol()), col(self.getLabelCol())]
        rows = df.select(*keep, fold.alias("_fold"))
        learn = self._boosted if all(isinstance(b, BoostedTrees) for b in bases) else self._fitted
        fitted, parts = learn(bases, rows, names)
        join = VectorAssembler(inputCols=names, outputCol="base_predictions")
        top = PenalizedLinear(alpha=self.alpha, summed=True)._set(
            featuresCol="base_predictions", labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol()
        )
        top_model = top.fit(via_table(join.transform(parts), "stack"))
        return PipelineModel([*fitted, join, top_model])

    def _fitted(self, bases: list[Estimator], rows: DataFrame, names: list[str]) -> tuple[list[Transformer], DataFrame]:
        """The bases learned from all rows, and the label with the predictions of those that were not shown the row."""
        parts = None
        for f in range(self.folds):
            held = rows.where(F.col("_fold") == f)
            for b in bases:
                held = b.fit(rows.where(F.col("_fold") != f)).transform(held)
            held = held.select(self.getLabelCol(), *names)
            parts = held if parts is None else parts.unionByName(held)
        return [b.fit(rows) for b in bases], parts

    def _boosted(self, bases: list[Estimator], rows: DataFrame, names: list[str]) -> tuple[list[Transformer], DataFrame]:
        """:meth:`_fitted` for boosted trees, which grow together."""
        wanted = [(b, f) for f in [*range(self.folds), None] for b in bases]
        models, passes = fit_together(wanted, rows, F.col("_fold"))
        return models[-len(bases) :], passes.held_out(names).withColumnRenamed("y", self.getLabelCol())


def _fit_all(bases: list[Estimator], rows: DataFrame) -> list[Transformer]:
    """Boosted trees among the bases grow together."""
    boosted = [i for i, b in enumerate(bases) if isinstance(b, BoostedTrees)]
    grown = dict(zip(boosted, fit_together([(bases[i], None) for i in boosted], rows)[0])) if boosted else {}
    return [grown[i] if i in grown else b.fit(rows) for i, b in enumerate(bases)]


class Voting(Estimator, _Columns):
    """Mean of the base models; fits to a plain ``PipelineModel``."""

    def __init__(self, bases: list[Estimator]):
        super().__init__()
        self.bases = bases

    def copy(self, extra=None):
        return self._copyValues(Voting([b.copy() for b in self.bases]), extra)

    def _fit(self, df: DataFrame) -> PipelineModel:
        names = [f"base_{i}" for i in range(len(self.bases))]
        bases = [_renamed(b, n, self.getFeaturesCol(), self.getLabelCol()) for b, n in zip(self.bases, names)]
        mean = f"({' + '.join(names)}) / {len(names)}"
        vote = SQLTransformer(statement=f"SELECT *, {mean} AS {self.getPredictionCol()} FROM __THIS__")
        return PipelineModel([*_fit_all(bases, df), vote])


# ---------------------------------------------------------------- fixed values
# Settings of the zoo. Penalties, bins and leaf sizes of the three boosting presets are their libraries' defaults.
SETTINGS: dict[str, dict] = {
    "linear_regression": {},
    "ridge": {"alpha": 10.0},
    "lasso": {"alpha": 0.001, "max_iter": 10000},
    "elasticnet": {"alpha": 0.001, "l1_ratio": 0.5, "max_iter": 10000},
    "decision_tree": {"max_depth": 8},
    "random_forest": {"n_estimators": 200, "max_depth": 12},
    "extra_trees": {"n_estimators": 200, "max_depth": 12},
    "gradient_boosting": {"n_estimators": 200, "max_depth": 3, "learning_rate": 0.05},
    "svr": {"C": 10.0, "epsilon": 0.01},
    "knn": {"n_neighbors": 10, "weights": "distance"},
    "xgboost": {
        "n_estimators": 400, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "colsample": 0.8,
        "reg_lambda": 1.0, "reg_alpha": 0.0, "gamma": 0.0, "max_bins": 256,
    },
    "lightgbm": {
        "n_estimators": 400, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample": 0.8,
        "reg_lambda": 0.0, "reg_alpha": 0.0, "num_leaves": 31, "min_child_samples": 20, "max_bins": 255,
    },
    "catboost": {"n_estimators": 400, "max_depth": 6, "learning_rate": 0.05, "reg_lambda": 3.0, "max_bins": 254},
}
ENSEMBLE_PREFERENCE = ["xgboost", "lightgbm", "catboost", "random_forest", "extra_trees", "gradient_boosting"]
# ------------------------------------------------------------ end fixed values


DEEPEST = 30  # the deepest tree that Spark grows


def _depth(s: dict) -> int:
    depth = s["max_depth"]
    if depth is None or not 0 <= depth <= DEEPEST:
        raise ValueError(f"max_depth is {depth}; trees have a depth of 0 to {DEEPEST}, none is unlimited")
    return depth


def _linear(s: dict, seed: int) -> Estimator:
    return PenalizedLinear(alpha=0.0)


def _ridge(s: dict, seed: int) -> Estimator:
    return PenalizedLinear(alpha=float(s["alpha"]), summed=True)


def _elastic(s: dict, seed: int) -> Estimator:
    return PenalizedLinear(alpha=float(s["alpha"]), l1Ratio=float(s.get("l1_ratio", 1.0)), maxIter=int(s["max_iter"]))


def _tree(s: dict, seed: int) -> Estimator:
    return DecisionTreeRegressor(maxDepth=_depth(s), seed=seed)


def _forest(s: dict, seed: int) -> Estimator:
    return RandomForestRegressor(
        numTrees=s["n_estimators"],
        maxDepth=_depth(s),
        minInstancesPerNode=s.get("min_samples_leaf", 1),
        featureSubsetStrategy="all",
        seed=seed,
    )


def _extra(s: dict, seed: int) -> Estimator:
    return ExtraTrees(trees=s["n_estimators"], maxDepth=_depth(s), leastSplit=s.get("min_samples_split", 2), seed=seed)


def _boost(s: dict, seed: int) -> Estimator:
    return GBTRegressor(
        maxIter=s["n_estimators"],
        maxDepth=_depth(s),
        stepSize=s["learning_rate"],
        subsamplingRate=s.get("subsample", 1.0),
        featureSubsetStrategy=str(s.get("colsample", "all")),
        seed=seed,
    )


def _second_order(how: str):
    def build(s: dict, seed: int) -> Estimator:
        # Only trees grown leaf by leaf end by themselves without a depth.
        free = how == "leaf" and s["max_depth"] is None
        return BoostedTrees(
            how=how,
            rounds=s["n_estimators"],
            maxDepth=-1 if free else _depth(s),
            learningRate=s["learning_rate"],
            subsample=s.get("subsample", 1.0),
            colsample=s.get("colsample", 1.0),
            regLambda=s["reg_lambda"],
            regAlpha=s.get("reg_alpha", 0.0),
            gamma=s.get("gamma", 0.0),
            leastRows=float(s.get("min_child_samples", 1)),
            numLeaves=s.get("num_leaves", 31),
            maxBins=s["max_bins"],
            seed=seed,
        )

    return build


def _svr(s: dict, seed: int) -> Estimator:
    return KernelRegressor(C=float(s["C"]), epsilon=float(s["epsilon"]), seed=seed)


def _knn(s: dict, seed: int) -> Estimator:
    return KnnRegressor(k=int(s["n_neighbors"]), weights=s["weights"])


BUILDERS: dict[str, Callable[[dict, int], Estimator]] = {
    "linear_regression": _linear,
    "ridge": _ridge,
    "lasso": _elastic,
    "elasticnet": _elastic,
    "decision_tree": _tree,
    "random_forest": _forest,
    "extra_trees": _extra,
    "gradient_boosting": _boost,
    "svr": _svr,
    "knn": _knn,
    "xgboost": _second_order("level"),
    "lightgbm": _second_order("leaf"),
    "catboost": _second_order("oblivious"),
}


def _no_such(name: str) -> ValueError:
    return ValueError(f"{name!r} is not in the zoo, which has {', '.join(model_names())}")


def build_model(name: str, seed: int = 42, **changes) -> Estimator:
    """A base model by name, with single settings changed (``n_estimators=50``)."""
    if name not in BUILDERS:
        raise _no_such(name)
    estimator = BUILDERS[name]({**SETTINGS[name], **changes}, seed)
    return estimator._set(featuresCol=FEATURES, labelCol=LOG_TARGET)


def get_base_models(seed: int = 42, changes: dict[str, dict] | None = None) -> dict[str, Estimator]:
    return {n: build_model(n, seed, **(changes or {}).get(n, {})) for n in BUILDERS}


def get_ensemble_models(seed: int = 42, changes: dict[str, dict] | None = None) -> dict[str, Estimator]:
    """Stacking and voting over the first three of the preference list."""

    def bases() -> list[Estimator]:
        return [build_model(n, seed, **(changes or {}).get(n, {})) for n in ENSEMBLE_PREFERENCE[:3]]

    return {"stacking": Stacking(bases()), "voting": Voting(bases())}


def get_all_models(seed: int = 42, changes: dict[str, dict] | None = None) -> dict[str, Estimator]:
    return {**get_base_models(seed, changes), **get_ensemble_models(seed, changes)}


def model_names() -> list[str]:
    return [*BUILDERS, "stacking", "voting"]


def get_model(name: str, seed: int = 42) -> Estimator:
    if name in BUILDERS:
        return build_model(name, seed)
    ensembles = get_ensemble_models(seed)
    if name not in ensembles:
        raise _no_such(name)
    return ensembles[name]


