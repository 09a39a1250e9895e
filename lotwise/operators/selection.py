"""Ways to rank features, and where they agree."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.quantiles import exact_quantiles
from lotwise.functions.scalar import col
from lotwise.operators.boosting import matrix
from lotwise.operators.cleaning import to_long
from lotwise.operators.encoding import FEATURES, build_full_preprocessor, encode, encoded_names
from lotwise.operators.gram import target_correlations
from lotwise.operators.splits import LOG_TARGET, to_log_target
from lotwise.operators.tree_values import TreeSum, tree_sum_of
from lotwise.schema import ID, TARGET, numeric_columns
from lotwise.session import via_table


def correlation_ranking(df: DataFrame, target: str = TARGET, skip: Sequence[str] = ()) -> DataFrame:
    """``feature, score``: |correlation with the target|, one pass for all columns."""
    columns = numeric_columns(df.schema, (target, *skip))
    found = target_correlations(df, columns, target)
    return found.select("feature", F.abs("correlation").alias("score")).orderBy(F.desc_nulls_last("score"), "feature")


def mutual_information_ranking(
    df: DataFrame, target: str = TARGET, bins: int = 10, skip: Sequence[str] = (ID,)
) -> DataFrame:
    """``feature, score``: mutual information of quantile-binned columns, missing cells as 0.

    The joint counts have at most ``bins * bins`` cells per column, so everything after the first
    (partially aggregated) count is small.
    """
    columns = numeric_columns(df.schema, (target, *skip))
    rows = df.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*columns, target]])
    edges = exact_quantiles(rows, [*columns, target], [i / bins for i in range(1, bins)])

    def bin_of(c: str):
        at = F.lit(0)
        for edge in sorted(set(edges[c])):
            at = at + (col(c) > F.lit(edge)).cast("int")
        return at

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bx")) for c in columns])
    joint = (
        rows.select(F.inline(cells), bin_of(target).alias("by"))
        .groupBy("feature", "bx", "by")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    by_x = F.sum("n").over(Window.partitionBy("feature", "bx"))
    by_y = F.sum("n").over(Window.partitionBy("feature", "by"))
    all_n = F.sum("n").over(Window.partitionBy("feature"))
    n = F.col("n")
    return (
        joint.select("feature", "n", by_x.alias("nx"), by_y.alias("ny"), all_n.alias("nn"))
        .groupBy("feature")
        .agg(F.sum(n / F.col("nn") * F.ln(n * F.col("nn") / (F.col("nx") * F.col("ny")))).alias("score"))
        .orderBy(F.desc("score"), "feature")
    )


def variance_filter(df: DataFrame, threshold: float = 0.0, skip: Sequence[str] = (ID, TARGET)) -> DataFrame:
    """``feature, variance`` of the numeric columns above the threshold, missing cells as 0."""
    columns = numeric_columns(df.schema, tuple(skip))
    row = df.agg(*[F.var_pop(F.coalesce(col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])
    return to_long(row, "feature", "variance").where(F.col("variance") > threshold)


def _encoded(df: DataFrame, target: str, key: str) -> tuple[DataFrame, list[str]]:
    encoder = build_full_preprocessor(df)
    rows = encode(encoder, to_log_target(df, target), [key, LOG_TARGET])
    return via_table(rows, "encoded"), encoded_names(encoder)


def _forest(trees: int, depth: int, seed: int) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=LOG_TARGET,
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        featureSubsetStrategy="all",
    )


def _named_scores(spark, names: Sequence[str], scores: Sequence[float]) -> DataFrame:
    rows = [(n, float(s)) for n, s in zip(names, scores)]
    return spark.createDataFrame(rows, "feature string, score double").orderBy(F.desc("score"), "feature")


def tree_importance(
    df: DataFrame,
    target: str = TARGET,
    trees: int = 200,
    depth: int = 12,
    seed: int = 42,
    key: str = ID,
    encoded: tuple[DataFrame, list[str]] | None = None,
) -> DataFrame:
    """``feature, score``: impurity importance of a forest on the log target."""
    rows, names = encoded or _encoded(df, target, key)
    model = _forest(trees, depth, seed).fit(rows)
    return _named_scores(df.sparkSession, names, model.featureImportances.toArray())


def permuted_pairs(rows: DataFrame, repeats: int, key: str, seed: int, per_bucket: int = 4096) -> DataFrame:
    """Each row with the feature vector of another row, once per repeat.

    Rows fall into hash buckets of about ``per_bucket`` rows; inside a bucket, in hash order, each
    row takes its successor's vector and the last takes the first's. That is a permutation of the
    whole table without a global sort, and the buckets are even whatever the data.
    """
    n = rows.count()
    buckets = max(1, math.ceil(n / per_bucket))
    many = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.xxhash64(col(key), F.col("repeat"), F.lit(seed))
    many = many.withColumn("bucket", F.pmod(F.xxhash64(F.col("repeat"), col(key), F.lit(seed + 1)), F.lit(buckets)))
    ring = Window.partitionBy("repeat", "bucket").orderBy(order, col(key))
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return many.withColumn("other", F.coalesce(F.lead(FEATURES).over(ring), F.first(FEATURES).over(whole))).drop("bucket")


def _probed(pairs: DataFrame, model, columns: int) -> DataFrame:
    """``repeat, slot, r2`` with the slot's column from the other row, each such row put to the model."""
    # Slot -1 is the row as it is: the base score comes from the same job.
    slots = F.explode(F.sequence(F.lit(-1), F.lit(columns - 1))).alias("slot")
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("slot"), F.col("z")[i]).otherwise(v))
    probes = pairs.select(LOG_TARGET, "repeat", "x", "z", slots).select(
        LOG_TARGET, "repeat", "slot", array_to_vector(swapped).alias(FEATURES)
    )
    error = F.col(LOG_TARGET) - F.col("prediction")
    return (
        model.transform(probes)
        .groupBy("repeat", "slot")
        .agg((1 - F.try_divide(F.avg(error * error), F.var_pop(LOG_TARGET))).alias("r2"))
    )


def _swapped(pairs: DataFrame, trees: TreeSum, columns: int, spread: float | None) -> DataFrame:
    """The same for a sum of trees and a label of variance ``spread``: a batch is priced once, then a swap prices only the trees that read the column and
    the rows it changes. A task sends one row per repeat and slot."""
    readers = {s: [(w, t) for w, t in trees.weighted if s in t.feature] for s in range(columns)}

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, z = matrix(batch.column("x")), matrix(batch.column("z"))
            y, repeat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "repeat"))
            price = trees.base + sum(w * t.predict(x) for w, t in trees.weighted) if len(y) else y
            for r in np.unique(repeat):
                own = np.nonzero(repeat == r)[0]
                off = y[own] - price[own]
                whole = np.array([len(own), (off**2).sum()])
                for slot in range(-1, columns):
                    sums = whole.copy()
                    at = np.nonzero(x[own, slot] != z[own, slot])[0] if readers.get(slot) else []
                    if len(at):
                        was = x[own[at]]
                        now = was.copy()
                        now[:, slot] = z[own[at], slot]
                        moved = off[at] - sum(w * (t.predict(now) - t.predict(was)) for w, t in readers[slot])
                        sums[1] += (moved**2).sum() - (off[at] ** 2).sum()
                    total[r, slot] = total.get((r, slot), 0) + sums
        keys, sums = list(total), np.array(list(total.values())).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict(
            {
                "repeat": pa.array([int(r) for r, _ in keys], pa.int32()),
                "slot": pa.array([s for _, s in keys], pa.int32()),
                "n": pa.array(sums[:, 0]),
                "squares": pa.array(sums[:, 1]),
            }
        )

    known = pairs.where(F.col(LOG_TARGET).isNotNull()).select(F.col(LOG_TARGET).alias("y"), "repeat", "x", "z")
    found = known.mapInArrow(errors, "repeat int, slot int, n double, squares double").groupBy("repeat", "slot")
    error = F.sum("squares") / F.sum("n")
    return found.agg((1 - F.try_divide(error, F.lit(spread))).alias("r2"))


def permutation_importance(
    df: DataFrame,
    target: str = TARGET,
    repeats: int = 5,
    trees: int = 150,
    depth: int = 10,
    seed: int = 42,
    key: str = ID,
    encoded: tuple[DataFrame, list[str]] | None = None,
) -> DataFrame:
    """``feature, score``: mean loss of R² when one column is shuffled."""
    rows, names = encoded or _encoded(df, target, key)
    model = _forest(trees, depth, seed).fit(rows)
    x, other = vector_to_array(FEATURES), vector_to_array("other")
    pairs = permuted_pairs(rows, repeats, key, seed).select(
        LOG_TARGET, "repeat", x.alias("x"), other.alias("z")
    )
    trees = tree_sum_of(model)
    if trees is None:
        scores = _probed(pairs, model, len(names))
    else:
        scores = _swapped(pairs, trees, len(names), rows.agg(F.var_pop(LOG_TARGET)).first()[0])
    # repeats x (features + 1) rows from here on.
    base = F.max(F.when(F.col("slot") == -1, F.col("r2"))).over(Window.partitionBy("repeat"))
    names_of = F.array(*[F.lit(n) for n in names])
    return (
        scores.withColumn("drop", base - F.col("r2"))
        .where(F.col("slot") >= 0)
        .groupBy("slot")
        .agg(F.avg("drop").alias("score"))
        .select(names_of[F.col("slot")].alias("feature"), "score")
        .orderBy(F.desc("score"), "feature")
    )


def recursive_elimination(
    df: DataFrame,
    keep: int = 20,
    step: float = 0.1,
    target: str = TARGET,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
    key: str = ID,
) -> DataFrame:
    """``feature, importance`` of the survivors: refit, drop the weakest share, until ``keep`` are left."""
    rows, names = _encoded(df, target, key)
    left = list(range(len(names)))
    share = max(1, int(step * len(names)))
    while True:
        sliced = VectorSlicer(inputCol=FEATURES, outputCol="kept", indices=left).transform(rows)
        model = _forest(trees, depth, seed).setFeaturesCol("kept").fit(sliced)
        weight = dict(zip(left, model.featureImportances.toArray()))
        surplus = len(left) - keep
        if surplus <= 0:
            break
        weakest = sorted(left, key=lambda i: (weight[i], -i))[: min(share, surplus)]
        left = [i for i in left if i not in weakest]
    return df.sparkSession.createDataFrame(
        [(names[i], float(weight[i])) for i in left], "feature string, importance double"
    )


def agreement(rankings: dict[str, DataFrame], top_k: int = 15) -> DataFrame:
    """``feature``, one flag per ranking, ``agreement_count``: union of the top lists."""
    tops = None
    for method, ranking in rankings.items():
        # A top-k report: each ranking has one row per feature.
        top = ranking.orderBy(F.desc_nulls_last("score"), "feature").limit(top_k)
        top = top.select("feature", F.lit(method).alias("method"))
        tops = top if tops is None else tops.unionByName(top)
    flags = [F.bool_or(F.col("method") == m).alias(m) for m in rankings]
    count = sum((F.col(m).cast("int") for m in list(rankings)[1:]), F.col(list(rankings)[0]).cast("int"))
    return (
        tops.groupBy("feature").agg(*flags).withColumn("agreement_count", count).orderBy(F.desc("agreement_count"), "feature")
    )


def compare_selection_methods(
    df: DataFrame,
    target: str = TARGET,
    top_k: int = 15,
    seed: int = 42,
    importance: dict | None = None,
    permutation: dict | None = None,
) -> DataFrame:
    """The four rankings side by side; both forests share one encoding. The last two arguments change the
    settings of the forests."""
    data = _encoded(df, target, ID)
    return agreement(
        {
            "correlation": correlation_ranking(df, target, (ID,)),
            "mutual_information": mutual_information_ranking(df, target),
            "tree_importance": tree_importance(df, target, seed=seed, encoded=data, **(importance or {})),
            "permutation_importance": permutation_importance(
                df, target, **{"repeats": 3, "seed": seed, "encoded": data, **(permutation or {})}
            ),
        },
        top_k,
    )
