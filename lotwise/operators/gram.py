"""Correlation matrices from per-task cross products.

p columns give p*p pairs; as SQL aggregates that is thousands of buffers updated row by row. Here
each task multiplies Arrow batches (``X' X`` with missing cells masked) and emits one row per pair,
so the shuffle carries p*p rows per task whatever the table size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col, pearson


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, correlation`` for all ordered pairs, over the rows where both are present."""
    columns = list(columns)
    p = len(columns)
    # Shifted by rough means, the sums keep their digits.
    means = df.agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([means[i] if means[i] is not None else 0.0 for i in range(p)])
    left, right = np.triu_indices(p)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - shift
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sq = x * x
            total += np.stack([seen.T @ seen, x.T @ seen, seen.T @ x, sq.T @ seen, seen.T @ sq, x.T @ x])
        sums = {f"s{k}": total[k][left, right] for k in range(6)}
        yield pd.DataFrame({"i": left, "j": right, **sums})

    schema = "i int, j int, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double"
    parts = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInPandas(
        products, schema
    )
    summed = parts.groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{k}") for k in range(6))
    spread = F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0)) * F.greatest(n * syy - sy * sy, F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in columns])
    pairs = summed.select("i", "j", F.try_divide(n * sxy - sx * sy, spread).alias("correlation"))
    both = F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j")),
    )
    return (
        pairs.select("correlation", F.explode(F.array_distinct(both)).alias("at"))
        .select(
            names[F.col("at.i")].alias("a"), names[F.col("at.j")].alias("b"), "correlation"
        )
    )


def target_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``feature, correlation`` of every column with the target; NULL for a constant or empty one.

    The cells of a row become rows and share one short aggregate: an aggregate per column, side by side, took 15
    times as long. A task sends on one row per column.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("at"), col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    pairs = df.select(F.inline(cells), col(target).cast("double").alias("y"))
    found = pairs.groupBy("at").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    by_place = found.agg(F.map_from_entries(F.collect_list(F.struct("at", "r"))).alias("by_place"))  # one row
    named = [
        F.struct(F.lit(c).alias("feature"), F.try_element_at("by_place", F.lit(i)).alias("correlation"))
        for i, c in enumerate(columns)
    ]
    return by_place.select(F.inline(F.array(*named)))
