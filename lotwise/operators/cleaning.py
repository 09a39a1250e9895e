"""Cleaning as an ML stage pair: :class:`HouseCleaner` learns the fills, :class:`HouseCleanerModel`
applies them.

Learning needs two jobs whatever the number of columns: one aggregate pass for all medians and one
``(column, value)`` count for all modes. Applying is a plain projection, except for the two options
that look at the whole frame (duplicate removal and outlier bounds).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.quantiles import exact_quantiles
from lotwise.functions.scalar import col, no_nan, quoted, strip
from lotwise.schema import (
    ABSENT_IS_NONE,
    ABSENT_IS_ZERO,
    CODE_COLUMNS,
    ID,
    NEVER_CAPPED,
    TARGET,
    YEAR_COLUMNS,
    numeric_columns,
    other_columns,
)
from lotwise.session import via_table

UNKNOWN = "Unknown"


# ------------------------------------------------------------------ single steps
def strip_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})


def standardize(df: DataFrame) -> DataFrame:
    """Trimmed names and strings; NaN becomes NULL."""
    df = strip_names(df)
    new = {}
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            new[f.name] = strip(col(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            new[f.name] = no_nan(col(f.name))
    return df.withColumns(new) if new else df


def fix_types(df: DataFrame) -> DataFrame:
    """Numeric codes become strings; year columns become numbers, unreadable text becomes NULL."""
    new = {}
    for f in df.schema:
        if f.name in CODE_COLUMNS and not isinstance(f.dataType, T.StringType):
            new[f.name] = col(f.name).cast("string")
        elif f.name in YEAR_COLUMNS and not isinstance(f.dataType, T.NumericType):
            new[f.name] = col(f.name).try_cast("double")
    return df.withColumns(new) if new else df


def drop_copies(df: DataFrame, key: str = ID) -> DataFrame:
    """Rows that agree on everything but ``key`` collapse to the one with the smallest ``key``.

    A ``groupBy`` instead of a ranked window: copies collapse before the shuffle, so a row that
    makes up a third of the table costs one record per task, and no group is ever sorted.
    """
    if key not in df.columns:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != key]
    return df.groupBy(*[quoted(c) for c in rest]).agg(F.min(col(key)).alias(key)).select(*[quoted(c) for c in df.columns])


def fill_absent(df: DataFrame) -> DataFrame:
    """Missing codes that mean "no such part" become ``None``, such numbers become 0."""
    kinds = {f.name: f.dataType for f in df.schema}
    fills: dict = {c: "None" for c in ABSENT_IS_NONE if isinstance(kinds.get(c), T.StringType)}
    fills.update({c: 0 for c in ABSENT_IS_ZERO if isinstance(kinds.get(c), T.NumericType)})
    return df.fillna(fills) if fills else df


def fill_learned(
    df: DataFrame, medians: dict[str, float | None], modes: dict[str, str], key: str = ID
) -> DataFrame:
    """Learned fills, then 0 / ``Unknown`` for whatever was never learned.

    An integer column whose median has a fraction becomes double; the row key keeps its type.
    """
    fills: dict = {}
    wider = {}
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType):
            value = medians.get(f.name) or 0
            whole = isinstance(f.dataType, T.IntegralType)
            if whole and f.name != key and not float(value).is_integer():
                wider[f.name] = col(f.name).cast("double")
            fills[quoted(f.name)] = int(value) if whole and f.name not in wider else float(value)
        elif isinstance(f.dataType, T.StringType):
            fills[quoted(f.name)] = modes.get(f.name, UNKNOWN)
    df = df.withColumns(wider) if wider else df
    return df.fillna(fills) if fills else df


# ---------------------------------------------------------------- learned values
def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, count`` of all columns in one pass (partially aggregated)."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.explode(cells).alias("cell"))
        .groupBy("cell.column", "cell.value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def mode_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, mode``: most frequent value, ties to the smallest; ``Unknown`` if all are missing."""
    counts = value_counts(df, columns)
    best = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("count"), F.col("value"))))
    return counts.groupBy("column").agg(F.coalesce(best, F.lit(UNKNOWN)).alias("mode"))


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    if not columns:
        return {}
    found = {r["column"]: r["mode"] for r in mode_table(df, columns).collect()}  # one row per column
    return {c: found.get(c, UNKNOWN) for c in columns}


# ---------------------------------------------------------------------- outliers
def capped_columns(df: DataFrame, target: str = TARGET) -> list[str]:
    return numeric_columns(df.schema, (ID, target, *NEVER_CAPPED))


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float) -> dict[str, tuple[float, float]]:
    """``[q1 - k iqr, q3 + k iqr]`` per column; columns without spread are left out."""
    bounds = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None and q3 - q1 != 0:
            bounds[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return bounds


def apply_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    new = {}
    for name, (low, high) in bounds.items():
        c = col(name).cast("double")
        new[name] = F.when(c < low, float(low)).when(c > high, float(high)).otherwise(c)
    return df.withColumns(new) if new else df


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``column, outliers`` for the columns that have any: one aggregate for all columns."""
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, outliers long")
    counted = df.agg(
        *[F.count_if((col(c) < lo) | (col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()]
    )
    return to_long(counted, "column", "outliers").where(F.col("outliers") > 0)


def to_long(one_row: DataFrame, name: str, value: str) -> DataFrame:
    """Columns of a one-row aggregate as rows."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), col(c).alias(value)) for c in one_row.columns])
    return one_row.select(F.inline(cells))


def missing_counts(df: DataFrame) -> DataFrame:
    """``column, missing, rows`` for the columns with missing cells."""
    counted = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("\u0000rows"))
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).alias("missing")) for c in df.columns]
    )
    return (
        counted.select(F.inline(cells), col("\u0000rows").alias("rows"))
        .where(F.col("missing") > 0)
        .select("column", "missing", "rows")
    )


def cleaning_report(raw: DataFrame, model: "HouseCleanerModel") -> DataFrame:
    """What cleaning does to ``raw`` as rows ``stage, metric, column, value``."""
    filled = via_table(model.fill(raw), "filled")
    bounds = model.bounds_for(filled) if model.getOrDefault(model.capOutliers) else {}
    return _report(raw, model, filled, bounds)


def _report(raw: DataFrame, model: "HouseCleanerModel", filled: DataFrame, bounds: dict) -> DataFrame:
    cleaned = apply_bounds(filled, bounds)
    before = raw.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(len(raw.columns)).alias("columns"), "rows")
    after = cleaned.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(len(cleaned.columns)).alias("columns"), "rows")

    def shape(frame: DataFrame, stage: str) -> DataFrame:
        cells = F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("column"), col(m).cast("double").alias("value"))
                for m in ("rows", "columns")
            ]
        )
        return frame.select(F.lit(stage).alias("stage"), F.inline(cells))

    def named(frame: DataFrame, stage: str, metric: str, value: str) -> DataFrame:
        return frame.select(
            F.lit(stage).alias("stage"),
            F.lit(metric).alias("metric"),
            F.col("column"),
            F.col(value).cast("double").alias("value"),
        )

    parts = [
        shape(before, "before"),
        shape(after, "after"),
        named(missing_counts(standardize(raw)), "before", "missing", "missing"),
        named(missing_counts(cleaned), "after", "missing", "missing"),
    ]
    if model.getOrDefault(model.dedupe):
        removed = before.crossJoin(after.select(F.col("rows").alias("kept"))).select(  # one row by one row
            F.lit(None).cast("string").alias("column"), (F.col("rows") - F.col("kept")).alias("removed")
        )
        parts.append(named(removed, "clean", "duplicates_removed", "removed"))
    if model.getOrDefault(model.capOutliers):
        parts.append(named(outlier_counts(filled, bounds), "clean", "outliers_capped", "outliers"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------- stage pair
class _CleanerParams(Params):
    targetCol = Param(Params._dummy(), "targetCol", "column that is never filled from data or capped", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row key, ignored when copies are compared", TypeConverters.toString)
    iqrMultiplier = Param(Params._dummy(), "iqrMultiplier", "width of the outlier bounds", TypeConverters.toFloat)
    dedupe = Param(Params._dummy(), "dedupe", "remove copies", TypeConverters.toBoolean)
    capOutliers = Param(Params._dummy(), "capOutliers", "clip outliers to the bounds", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(targetCol=TARGET, idCol=ID, iqrMultiplier=3.0, dedupe=True, capOutliers=True)


class HouseCleaner(Estimator, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a median per numeric column and a mode per other column."""

    @keyword_only
    def __init__(self, *, targetCol=TARGET, idCol=ID, iqrMultiplier=3.0, dedupe=True, capOutliers=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "HouseCleanerModel":
        rows = fix_types(standardize(df))
        target = self.getOrDefault(self.targetCol)
        medians = column_medians(rows, numeric_columns(rows.schema, (target,)))
        modes = column_modes(rows, other_columns(rows.schema))
        model = HouseCleanerModel()
        self._copyValues(model)
        return model._set(medians=json.dumps(medians), modes=json.dumps(modes))


class HouseCleanerModel(Model, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fixed order: trim, drop copies, types, absent fills, learned fills, caps."""

    medians = Param(Params._dummy(), "medians", "learned medians (JSON)", TypeConverters.toString)
    modes = Param(Params._dummy(), "modes", "learned modes (JSON)", TypeConverters.toString)
    frozenBounds = Param(Params._dummy(), "frozenBounds", "outlier bounds to use instead of the frame's own (JSON)", TypeConverters.toString)

    def learned(self) -> tuple[dict, dict]:
        if not self.isSet(self.medians):
            raise RuntimeError("The cleaner has learned nothing yet: call fit() first.")
        return json.loads(self.getOrDefault(self.medians)), json.loads(self.getOrDefault(self.modes))

    def fill(self, df: DataFrame) -> DataFrame:
        """Everything up to (not including) the outlier bounds."""
        medians, modes = self.learned()
        out = standardize(df)
        if self.getOrDefault(self.dedupe):
            out = drop_copies(out, self.getOrDefault(self.idCol))
        return fill_learned(fill_absent(fix_types(out)), medians, modes, self.getOrDefault(self.idCol))

    def bounds_for(self, filled: DataFrame) -> dict[str, tuple[float, float]]:
        if self.isSet(self.frozenBounds):
            return {c: tuple(b) for c, b in json.loads(self.getOrDefault(self.frozenBounds)).items()}
        columns = capped_columns(filled, self.getOrDefault(self.targetCol))
        return iqr_bounds(filled, columns, self.getOrDefault(self.iqrMultiplier))

    def cap(self, filled: DataFrame) -> DataFrame:
        return apply_bounds(filled, self.bounds_for(filled)) if self.getOrDefault(self.capOutliers) else filled

    def _transform(self, df: DataFrame) -> DataFrame:
        filled = self.fill(df)
        if self.getOrDefault(self.dedupe) and self.getOrDefault(self.capOutliers) and not self.isSet(self.frozenBounds):
            # The bounds take two more passes: write the rows once instead of shuffling them again.
            filled = via_table(filled, "filled")
        return self.cap(filled)

    def for_scoring(self) -> "HouseCleanerModel":
        """The same fills for single requests: equal rows are all kept, nothing is capped."""
        return self.copy({self.dedupe: False, self.capOutliers: False})


def clean_dataset(df: DataFrame, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """Fit and transform in one call: the cleaned frame and its report."""
    model = HouseCleaner(targetCol=target).fit(df)
    filled = via_table(model.fill(df), "filled")
    bounds = model.bounds_for(filled)
    return apply_bounds(filled, bounds), _report(df, model, filled, bounds)
