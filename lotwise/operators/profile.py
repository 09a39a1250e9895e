"""Profile and chart tables. Statistics of one shape share one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.quantiles import exact_quantiles, grouped_quantiles
from lotwise.functions.scalar import col, hash_number
from lotwise.operators.cleaning import iqr_bounds, missing_counts, outlier_counts, value_counts
from lotwise.operators.gram import correlation_matrix, target_correlations
from lotwise.schema import ID, TARGET, numeric_columns
from lotwise.session import via_table


def table_profile(df: DataFrame) -> DataFrame:
    """``metric, value``: rows, columns by type, copies.

    A 128-bit digest of each row is counted; whole rows are compared only where a digest repeats.
    """
    kinds = [f.dataType for f in df.schema]
    ints = sum(isinstance(k, T.IntegralType) for k in kinds)
    floats = sum(isinstance(k, (T.DoubleType, T.FloatType, T.DecimalType)) for k in kinds)
    texts = sum(isinstance(k, T.StringType) for k in kinds)
    own = [col(c) for c in df.columns]
    digest = F.struct(F.xxhash64(*own), F.xxhash64(F.lit("second"), *own)).alias("\u0000digest")
    counted = via_table(df.groupBy(digest).agg(F.count(F.lit(1)).alias("\u0000n")), "digests")
    total = counted.agg(F.sum("\u0000n").alias("rows"))
    repeated = df.select("*", digest).join(counted.where(col("\u0000n") > 1).select(col("\u0000digest")), "\u0000digest", "left_semi")
    groups = repeated.groupBy(*own).agg(F.count(F.lit(1)).alias("\u0000n"))
    sizes = total.crossJoin(groups.agg(F.sum(col("\u0000n") - 1).alias("copies")))  # one row by one row
    cells = [
        ("rows", F.coalesce("rows", F.lit(0))),
        ("columns", F.lit(len(kinds))),
        ("integer_columns", F.lit(ints)),
        ("float_columns", F.lit(floats)),
        ("string_columns", F.lit(texts)),
        ("duplicate_rows", F.coalesce("copies", F.lit(0))),
    ]
    return sizes.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("long").alias("value")) for n, c in cells]))
    )


def missing_profile(df: DataFrame) -> DataFrame:
    return missing_counts(df).select(
        "column", "missing", (100 * F.col("missing") / F.col("rows")).alias("percent")
    )


def target_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """mean, median, sample std, min, max, bias-corrected skewness."""
    y = col(target).cast("double")
    median = exact_quantiles(df, [target], [0.5])[target][0]
    n = F.count(y).cast("double")
    unbias = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return df.agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.lit(median).alias("median"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        (F.skewness(y) * unbias).alias("skewness"),
    )


def outlier_profile(df: DataFrame, k: float = 1.5, skip: Sequence[str] = (ID,)) -> DataFrame:
    columns = numeric_columns(df.schema, tuple(skip))
    return outlier_counts(df, iqr_bounds(df, columns, k))


def histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """``column, bin, low, high, count`` with equal widths; the last bin includes the maximum.

    One aggregate for all ranges, one ``(column, bin)`` count for all columns.
    """
    ends = df.agg(
        *[F.min(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    cells = []
    for i, c in enumerate(columns):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if low is None:
            continue
        if low == high:  # a constant column gets a bin of width 1 around its value
            low, high = low - 0.5, high + 0.5
        step = (high - low) / bins
        at = F.least(F.floor((col(c) - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("int")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(col(c).isNotNull(), at).alias("bin"),
                F.lit(low).alias("from"),
                F.lit(step).alias("step"),
            )
        )
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, count bigint")
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin", "from", "step")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "column",
            "bin",
            (F.col("from") + F.col("bin") * F.col("step")).alias("low"),
            (F.col("from") + (F.col("bin") + 1) * F.col("step")).alias("high"),
            "count",
        )
    )


def group_shapes(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Equal-width counts of ``value`` per group over the common range (violin data)."""
    ends = df.agg(F.min(col(value)).cast("double").alias("a"), F.max(col(value)).cast("double").alias("b")).first()
    if ends["a"] is None:
        return df.where("false").select(col(group).alias("category"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("count"))
    step = (ends["b"] - ends["a"]) / bins or 1.0
    at = F.least(F.floor((col(value) - F.lit(ends["a"])) / F.lit(step)), F.lit(bins - 1)).cast("int")
    return (
        df.where(col(value).isNotNull())
        .groupBy(col(group).alias("category"), at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def box_stats(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """``column, q1, median, q3, whisker_low, whisker_high, outliers``: two passes for all columns."""
    quantiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, cells = [], []
    for i, c in enumerate(columns):
        q1, q2, q3 = quantiles[c]
        if q1 is None:
            continue
        low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        inside = col(c).between(low, high)
        aggs += [
            F.min(F.when(inside, col(c))).cast("double").alias(f"lo{i}"),
            F.max(F.when(inside, col(c))).cast("double").alias(f"hi{i}"),
            F.count_if(~inside).alias(f"out{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(float(q1)).alias("q1"),
                F.lit(float(q2)).alias("median"),
                F.lit(float(q3)).alias("q3"),
                F.col(f"lo{i}").alias("whisker_low"),
                F.col(f"hi{i}").alias("whisker_high"),
                F.col(f"out{i}").alias("outliers"),
            )
        )
    if not cells:
        names = ("q1", "median", "q3", "whisker_low", "whisker_high")
        kind = f"column string, {', '.join(f'{n} double' for n in names)}, outliers bigint"
        return df.sparkSession.createDataFrame([], kind)
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def group_box(df: DataFrame, group: str, value: str = TARGET) -> DataFrame:
    """Five numbers and the row count per category, highest median first."""
    five = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    boxes = grouped_quantiles(df, [group], value, five)
    sizes = df.groupBy(col(group)).agg(F.count(col(value)).alias("count"))
    return (
        boxes.join(sizes, boxes[group].eqNullSafe(sizes[group]))
        .select(boxes[group].alias("category"), *five, "count")
        .orderBy(F.desc("median"), "category")
    )


def group_median(df: DataFrame, group: str, value: str = TARGET, descending: bool = True) -> DataFrame:
    medians = grouped_quantiles(df, [group], value, {"median": 0.5})
    return medians.orderBy(F.desc("median"), col(group)) if descending else medians.orderBy(col(group))


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, count``, most frequent first; missing cells are not counted."""
    return value_counts(df, columns).where(F.col("value").isNotNull()).orderBy("column", F.desc("count"), "value")


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column: counted on the (column, value) groups, not on the rows."""
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.count("value").alias("distinct_values"))
    )


def missing_map(df: DataFrame, buckets: int = 20, key: str = ID) -> DataFrame:
    """Missing cells per (row bucket, column): the heat map at a fixed size."""
    bucket = F.pmod(hash_number(col(key)), F.lit(buckets)).cast("int").alias("bucket")
    columns = [c for c in df.columns if c != key]
    counted = df.groupBy(bucket).agg(*[F.count_if(col(c).isNull()).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("missing")) for c in columns])
    return counted.select("bucket", F.inline(cells)).where(F.col("missing") > 0)


def missing_cells(df: DataFrame, key: str = ID) -> DataFrame:
    """The flag of every cell, one row per house."""
    return df.select(col(key), *[col(c).isNull().cast("int").alias(c) for c in df.columns if c != key])


def top_correlated(df: DataFrame, target: str = TARGET, n: int = 16, skip: Sequence[str] = ()) -> DataFrame:
    """The ``n`` columns closest to the target (itself included) against each other."""
    columns = numeric_columns(df.schema, tuple(skip))
    found = target_correlations(df, columns, target).collect()  # one row per column
    strength = {r["feature"]: abs(r["correlation"]) for r in found if r["correlation"] is not None}
    top = sorted(strength, key=lambda c: (-round(strength[c], 12), c))[:n]
    return correlation_matrix(df, top)


def scatter(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """``column, x, y`` pairs of whole columns against the target: a projection, no shuffle."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("x")) for c in columns if c != target]
    )
    return df.select(F.inline(cells), col(target).cast("double").alias("y"))


def sample_rows(df: DataFrame, n: int, key: str = ID, seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows (the rows with the smallest key hashes): a top-k per task."""
    return df.orderBy(hash_number(col(key), seed), col(key)).limit(n)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column."""
    quantiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, cells = [], []
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"a{i}"),
            F.max(x).alias(f"b{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"s{i}").alias("std"),
                F.col(f"a{i}").alias("min"),
                *[F.lit(q).cast("double").alias(n) for q, n in zip(quantiles[c], ("p25", "p50", "p75"))],
                F.col(f"b{i}").alias("max"),
            )
        )
    if not cells:
        names = ("q1", "median", "q3", "whisker_low", "whisker_high")
        kind = f"column string, {', '.join(f'{n} double' for n in names)}, outliers bigint"
        return df.sparkSession.createDataFrame([], kind)
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


