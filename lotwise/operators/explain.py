"""Why a price: additive contributions per row and feature, and the tables behind their charts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.scalar import col, hash_number
from lotwise.operators.encoding import FEATURES
from lotwise.operators.profile import sample_rows
from lotwise.operators.tree_values import tree_cells, tree_sum_of
from lotwise.schema import ID
from lotwise.session import cut_lineage, via_table

BACKGROUND_ROWS = 100
EXPLAINED_ROWS = 300
ROW = "_explained_row"


def background(rows: DataFrame, n: int = BACKGROUND_ROWS, key: str = ID) -> DataFrame:
    """The seeded reference rows."""
    return sample_rows(rows, n, key)


def linear_cells(rows: DataFrame, weights: dict[str, float], means: dict[str, float], key: str = ID) -> DataFrame:
    """``key, cells``: ``feature, x, contribution`` with ``w * (x - mean)``, all in the row."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                col(f).cast("double").alias("x"),
                (F.lit(float(w)) * (col(f) - F.lit(float(means[f])))).alias("contribution"),
            )
            for f, w in weights.items()
        ]
    )
    return rows.select(col(key), cells.alias("cells"))


def linear_contributions(
    rows: DataFrame, weights: dict[str, float], means: dict[str, float], key: str = ID
) -> DataFrame:
    """The same as one row per feature: ``key, feature, x, contribution``."""
    return long_form(linear_cells(rows, weights, means, key), key)


def long_form(cells: DataFrame, key: str = ID) -> DataFrame:
    return cells.select(col(key), F.inline("cells"))


def background_means(sample: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = sample.agg(*[F.avg(col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return {f: row[f"m{i}"] for i, f in enumerate(features)}


def vector_cells(model, sample: DataFrame, names: Sequence[str]) -> Column:
    """The cells of a fitted linear model on ``features``, as an expression over the row."""
    mean = sample.select(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"].toArray()
    w = F.array(*[F.lit(float(v)) for v in model.coefficients.toArray()])
    m = F.array(*[F.lit(float(v)) for v in mean])
    n = F.array(*[F.lit(str(v)) for v in names])
    return F.transform(
        vector_to_array(FEATURES),
        lambda x, i: F.struct(n[i].alias("feature"), x.alias("x"), (w[i] * (x - m[i])).alias("contribution")),
    )


def vector_contributions(rows: DataFrame, model, sample: DataFrame, names: Sequence[str], key: str = ID) -> DataFrame:
    """``key, feature, x, contribution`` of a fitted linear model."""
    return long_form(rows.select(col(key), vector_cells(model, sample, names).alias("cells")), key)


def linear_base_value(model, sample: DataFrame) -> float:
    return model.transform(sample).agg(F.avg("prediction")).first()[0]


def sampled_contributions(
    rows: DataFrame,
    model: Transformer,
    sample: DataFrame,
    names: Sequence[str],
    permutations: int = 20,
    key: str = ID,
    seed: int = 42,
    background_rows: int = BACKGROUND_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Shapley values of any model by sampled permutations; ``key`` must name a row.

    Each (row, permutation) takes one of ``background_rows`` background rows, walks from it to the row one
    feature at a time, and credits each change of the prediction to the feature that moved. Returns
    ``key, feature, contribution`` and ``key, base_value``; contributions plus base give the prediction
    exactly. A walk knows for each feature the step at which it moves, so a step costs one pass over them.
    """
    p = len(names)
    ranked = sample_rows(sample, background_rows, key).select(vector_to_array(FEATURES).alias("z"))
    reference = cut_lineage(ranked.select(F.expr("row_number() over (order by z) - 1").alias("slot"), "z"))
    size = reference.count()
    walks = rows.select(col(key), vector_to_array(FEATURES).alias("x")).select(
        col(key), "x", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("walk")
    )
    walks = walks.withColumn(
        "slot", F.pmod(hash_number(F.concat_ws("/", col(key), F.col("walk")), seed), F.lit(size)).cast("int")
    ).join(F.broadcast(reference), "slot")  # background_rows rows
    # The order of the features is a sort of their hashes; ``moves`` is its inverse, the step of each.
    tickets = F.transform(
        F.sequence(F.lit(0), F.lit(p - 1)),
        lambda i: F.struct(F.xxhash64(i, col(key), F.col("walk"), F.lit(seed)).alias("h"), i.alias("i")),
    )
    order = F.transform(F.array_sort(tickets), lambda t: t["i"])
    moves = F.transform(
        F.array_sort(F.transform("order", lambda i, at: F.struct(i.alias("i"), at.alias("at")))), lambda t: t["at"]
    )
    walks = walks.withColumn("order", order).withColumn("moves", moves)
    steps = walks.select("*", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("step"))
    mixed = F.transform("x", lambda v, i: F.when(F.col("moves")[i] < F.col("step"), v).otherwise(F.col("z")[i]))
    # The prediction at a step counts for the feature that moved there and against the next one.
    probes = steps.select(
        col(key),
        "step",
        F.when(F.col("step") > 0, F.try_element_at("order", F.col("step"))).alias("moved"),
        F.try_element_at("order", F.col("step") + 1).alias("next"),
        array_to_vector(mixed).alias(FEATURES),
    )
    priced = model.transform(probes)
    gain = F.struct(F.col("moved").alias("at"), F.col("prediction").alias("v"))
    loss = F.struct(F.col("next").alias("at"), (-F.col("prediction")).alias("v"))
    start = F.struct(F.lit(-1).alias("at"), F.col("prediction").alias("v"))
    credit = F.when(F.col("step") == 0, F.array(start, loss)).when(F.col("step") == p, F.array(gain)).otherwise(F.array(gain, loss))
    totals = cut_lineage(
        priced.select(col(key), F.inline(credit)).groupBy(col(key), "at").agg((F.sum("v") / permutations).alias("v"))
    )
    labels = F.array(*[F.lit(str(v)) for v in names])
    phi = totals.where(F.col("at") >= 0).select(col(key), labels[F.col("at")].alias("feature"), F.col("v").alias("contribution"))
    return phi, totals.where(F.col("at") == -1).select(col(key), F.col("v").alias("base_value"))


def row_cells(model: Transformer, sample: DataFrame, names: Sequence[str]) -> tuple[Column, float] | None:
    """Exact cells as an expression over the row, and the base value: for linear models and sums of trees."""
    if getattr(model, "coefficients", None) is not None:
        return vector_cells(model, sample, names), linear_base_value(model, sample)
    trees = tree_sum_of(model)
    return None if trees is None else tree_cells(trees, sample, list(names))


@dataclass
class Explainer:
    """What explains the prices of a winner: its model stages, background rows and slot names."""

    model: Transformer
    sample: DataFrame
    names: Sequence[str]
    permutations: int = 20

    def explain(self, priced: DataFrame, wanted: Column) -> DataFrame:
        """``priced`` (it has ``features``) with ``explanation``: ``base_value`` and the contributions to the
        prediction, largest first; missing where not wanted."""
        asked = F.coalesce(wanted, F.lit(False))
        found = row_cells(self.model, self.sample, self.names)
        if found is not None:
            base = F.lit(found[1])
            cells = F.transform(found[0], lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("value")))
            entry = F.struct(base.alias("base_value"), F.array_sort(cells, _largest_first).alias("contributions"))
            return priced.withColumn("explanation", F.when(asked, entry))
        # Rows may share a key: each gets a number of its own, stored so that it stays.
        rows = via_table(priced.withColumn(ROW, F.monotonically_increasing_id()).withColumn("_asked", asked), "priced")
        phi, base = sampled_contributions(
            rows.where("_asked"), self.model, self.sample.withColumn(ROW, F.hash(vector_to_array(FEATURES))), self.names,
            self.permutations, ROW,
        )
        pair = F.struct("feature", F.col("contribution").alias("value"))
        listed = phi.groupBy(ROW).agg(F.array_sort(F.collect_list(pair), _largest_first).alias("contributions"))
        found = listed.join(base, ROW).select(ROW, F.struct("base_value", "contributions").alias("explanation"))
        return rows.join(found, ROW, "left").drop(ROW, "_asked")


# ----------------------------------------------------------------- chart tables
def _largest_first(a: Column, b: Column) -> Column:
    left, right = F.abs(a["value"]), F.abs(b["value"])
    return (
        F.when(left > right, -1)
        .when(left < right, 1)
        .when(a["feature"] < b["feature"], -1)
        .when(a["feature"] > b["feature"], 1)
        .otherwise(0)
    )


def explanations(cells: DataFrame, base: Column, key: str = ID, top: int | None = None) -> DataFrame:
    """``key, base_value, contributions``: an array, largest first. Everything stays in its row."""
    pairs = F.transform("cells", lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("value")))
    listed = F.array_sort(pairs, _largest_first)
    if top is not None:
        listed = F.slice(listed, 1, top)
    return cells.select(col(key), base.alias("base_value"), listed.alias("contributions"))


def global_summary(contributions: DataFrame) -> DataFrame:
    """``feature, importance``: mean size of the contribution, largest first."""
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def dependence(contributions: DataFrame, feature: str, key: str = ID) -> DataFrame:
    return contributions.where(F.col("feature") == feature).select(col(key), "x", "contribution")


def widest_feature(contributions: DataFrame) -> str:
    """The feature with the largest variance."""
    spread = contributions.groupBy("feature").agg(F.var_samp("x").alias("v"))
    return spread.orderBy(F.desc_nulls_last("v"), "feature").first()["feature"]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _totals(values: pa.Array, base: pa.Array) -> pa.Array:
    """The running totals of every list, each from its own base."""
    lengths = np.asarray(values.value_lengths().fill_null(0))
    flat = np.asarray(values.flatten(), np.float64)
    ends = np.cumsum(lengths)
    out = np.concatenate([[0.0], *(b + np.cumsum(flat[e - n : e]) for b, n, e in zip(np.asarray(base), lengths, ends))])[1:]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(out))


def _running(ordered: Column, base: Column) -> Column:
    """Entries ``feature, value`` with their position and the total up to them."""
    totals = _totals(F.transform(ordered, lambda e: e["value"]), base)
    listed = F.zip_with(ordered, totals, lambda e, t: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), t.alias("total")))
    return F.transform(
        listed,
        lambda e, i: F.struct(
            (i + 1).alias("position"), e["feature"].alias("feature"), e["value"].alias("contribution"), e["total"].alias("running_total")
        ),
    )


def _base(base: float | Column) -> Column:
    return base if isinstance(base, Column) else F.lit(float(base))


def waterfall(cells: DataFrame, base: float | Column, key: str = ID) -> DataFrame:
    """Contributions, largest first, with a running total: one row per feature, no shuffle.

    ``base`` is one number, or a column where each row has its own.
    """
    listed = cells.withColumn("_base", _base(base))
    pairs = F.transform("cells", lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("value")))
    listed = listed.select(col(key), F.array_sort(pairs, _largest_first).alias("listed"), "_base")
    return listed.select(col(key), F.inline(_running(F.col("listed"), F.col("_base"))))


def decision_paths(cells: DataFrame, base: float | Column, key: str = ID) -> DataFrame:
    """Running totals from the base, features in the order of their global importance (least first)."""
    ranks = global_summary(long_form(cells, key)).orderBy("importance", F.desc("feature"))
    place = F.create_map(*[F.lit(v) for i, r in enumerate(ranks.collect()) for v in (r["feature"], i)])  # one row per feature
    placed = F.transform(
        "cells",
        lambda c: F.struct(place[c["feature"]].alias("at"), c["feature"].alias("feature"), c["contribution"].alias("value")),
    )
    listed = cells.select(col(key), F.array_sort(placed).alias("listed"), _base(base).alias("_base"))
    return listed.select(col(key), F.inline(_running(F.col("listed"), F.col("_base")))).drop("contribution")
