"""Requests: rules, quarantine, prices with an interval. The same code runs in batch and stream."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.scalar import col, no_nan
from lotwise.operators.explain import Explainer
from lotwise.operators.splits import from_log
from lotwise.schema import (
    CORRUPT,
    GIVEN,
    REQUEST_ALIASES,
    REQUEST_DEFAULTS,
    REQUEST_RANGES,
    REQUEST_REQUIRED,
    request_schema,
)
from lotwise.session import via_table

INTERVAL_WIDTH = 1.5
FAULTS = "_faults"


def apply_aliases(df: DataFrame) -> DataFrame:
    """Both spellings of a field are accepted; where both are present the own name wins."""
    out = df
    for alias, name in REQUEST_ALIASES.items():
        if alias in out.columns and name in out.columns:
            out = out.withColumn(name, F.coalesce(col(name), col(alias))).drop(alias)
        elif alias in out.columns:
            out = out.withColumnRenamed(alias, name)
    return out


def _converted(df: DataFrame, field: T.StructField) -> tuple[Column, Column]:
    """A field in its type, and why its cell cannot be read (NULL if it can)."""
    ok = F.lit(None).cast("string")
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType), ok
    cell, kind = col(field.name), df.schema[field.name].dataType
    if isinstance(field.dataType, T.StringType):
        return cell.cast("string"), ok
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return cell.cast(field.dataType), ok  # every value fits
    if isinstance(kind, T.LongType) and isinstance(field.dataType, T.IntegralType):
        whole = cell.try_cast(field.dataType)
        return whole, F.when(cell.isNotNull() & whole.isNull(), F.lit("out of range"))
    if isinstance(kind, T.IntegralType):
        return cell.cast(field.dataType), ok
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        cell = no_nan(cell)  # a missing number, not a wrong one
        if not isinstance(field.dataType, T.IntegralType):
            return cell.cast(field.dataType), ok
    number = no_nan(cell.try_cast("double"))
    wrong = F.when(cell.isNotNull() & number.isNull(), F.lit("not a number"))
    if not isinstance(field.dataType, T.IntegralType):
        return number, wrong
    whole = F.when(number == F.floor(number), number).try_cast(field.dataType)
    return whole, F.coalesce(
        wrong,
        F.when(number != F.floor(number), F.lit("not a whole number")),
        F.when(number.isNotNull() & whole.isNull(), F.lit("out of range")),
    )


def to_request(df: DataFrame) -> DataFrame:
    """Other columns first, then the 48 request fields in their types; absent ones are NULL.

    A cell that cannot be read becomes NULL; the array ``_faults`` says why, a place per field. (An array is one
    column to the code generator, which gives up beyond a hundred.)
    """
    out = apply_aliases(df)
    fields = request_schema()
    rest = [col(c) for c in out.columns if c not in fields.names]
    cells = {f.name: _converted(out, f) for f in fields}
    return out.select(
        *rest,
        *[cell.alias(name) for name, (cell, _) in cells.items()],
        F.array(*[fault for _, fault in cells.values()]).alias(FAULTS),
    )


def _fault(name: str) -> Column:
    return col(FAULTS)[request_schema().names.index(name)]


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults of absent fields. Where the request names its fields (``_given``), an explicit null stays."""
    names = {name: [name, *(a for a, n in REQUEST_ALIASES.items() if n == name)] for name in REQUEST_DEFAULTS}
    if GIVEN not in df.columns:
        return df.fillna({c: v for c, v in REQUEST_DEFAULTS.items() if c in df.columns})
    filled = {}
    for name, value in REQUEST_DEFAULTS.items():
        if name in df.columns:
            absent = ~F.coalesce(F.arrays_overlap(GIVEN, F.array(*map(F.lit, names[name]))), F.lit(False))
            filled[name] = F.when(col(name).isNull() & absent, F.lit(value)).otherwise(col(name))
    return df.withColumns(filled)


def rule_errors() -> Column:
    """Names of the broken rules, in field order: unreadable, missing, out of range, remodelled before built."""
    checks = []
    fields = request_schema().names
    for name in fields:
        fault = _fault(name)
        checks.append(F.when(fault.isNotNull(), F.concat(F.lit(f"{name}: "), fault)))
        if name in REQUEST_REQUIRED:
            checks.append(F.when(col(name).isNull() & fault.isNull(), F.lit(f"{name}: missing")))
        if name in REQUEST_RANGES:
            low, high = REQUEST_RANGES[name]
            bad = F.lit(False)
            if low is not None:
                bad = bad | (col(name) < low)
            if high is not None:
                bad = bad | (col(name) > high)
            checks.append(F.when(bad, F.lit(f"{name}: out of range")))
        if name == "YearRemodAdd":
            checks.append(F.when(col("YearRemodAdd") < col("YearBuilt"), F.lit("YearRemodAdd: before YearBuilt")))
    return F.array_compact(F.array(*checks))


def validated(df: DataFrame) -> DataFrame:
    """Requests with defaults filled and an ``errors`` array. A body that could not be read
    (``corrupt``) has that one error."""
    typed = to_request(df)
    # A default never stands in for a cell that was given but cannot be read.
    unread = {c: _fault(c) for c in REQUEST_DEFAULTS}
    filled = fill_defaults(typed)
    filled = filled.withColumns({c: F.when(fault.isNull(), col(c)) for c, fault in unread.items()})
    errors = rule_errors()
    if CORRUPT in df.columns:
        errors = F.when(col(CORRUPT).isNotNull(), F.array(F.lit("body: not readable"))).otherwise(errors)
    return filled.withColumn("errors", errors).drop(FAULTS)


def split_valid(checked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the quarantine: ``key, errors`` and what the request came with of its
    ``row_index``, its ``file`` and its unreadable text (``corrupt``).

    Hand in a stored or cached table: both parts read it, so the rules run once, and the optimizer
    does not carry some 45 rules through every later filter and join.
    """
    source = [c for c in ("row_index", "file", CORRUPT) if c in checked.columns and c != key]
    good = checked.where(F.size("errors") == 0).drop("errors", "file", CORRUPT, GIVEN)
    bad = checked.where(F.size("errors") > 0).select(col(key), "errors", *source)
    return good, bad


def with_interval(df: DataFrame, price: str, rmse: Column | float) -> DataFrame:
    """Price, low and high rounded to cents; low is never negative."""
    rmse = rmse if isinstance(rmse, Column) else F.lit(float(rmse))
    p = col(price)
    return df.withColumns(
        {
            "predicted_price": F.round(p, 2),
            "confidence_interval_low": F.round(F.greatest(p - INTERVAL_WIDTH * rmse, F.lit(0.0)), 2),
            "confidence_interval_high": F.round(p + INTERVAL_WIDTH * rmse, 2),
        }
    )


def score(
    requests: DataFrame, pipeline: Transformer, model_name: str, rmse: float, key: str, explainer: Explainer | None = None
) -> DataFrame:
    """``key, predicted_price, confidence_interval_low, confidence_interval_high, model_name``.

    ``pipeline`` is everything fitted: cleaner (scoring mode), derived columns, encoder, model. With an
    ``explainer`` also ``explanation``, for the requests whose ``explain`` is true.
    """
    priced = pipeline.transform(requests).withColumn("_price", from_log(F.col("prediction")))
    more = []
    if explainer is not None:
        wanted = F.col("explain") if "explain" in requests.columns else F.lit(False)
        priced, more = explainer.explain(priced, wanted), ["explanation"]
    return with_interval(priced, "_price", rmse).select(
        col(key),
        "predicted_price",
        "confidence_interval_low",
        "confidence_interval_high",
        F.lit(model_name).alias("model_name"),
        *more,
    )


def score_requests(
    requests: DataFrame, pipeline: Transformer, model_name: str, rmse: float, key: str, explainer: Explainer | None = None
) -> tuple[DataFrame, DataFrame]:
    """Check, then score: prices of the valid requests and the quarantine of the others."""
    good, bad = split_valid(via_table(validated(requests), "checked"), key)
    return score(good, pipeline, model_name, rmse, key, explainer), bad


def best_rmse(board: DataFrame, name: str) -> float:
    """Test error of a model on the leaderboard; 0 if it is not there."""
    row = board.where(F.col("name") == name).select("rmse").first()
    return float(row["rmse"]) if row else 0.0


def gauge(df: DataFrame) -> DataFrame:
    """Where the price lies between low and high, 0 to 1."""
    low, high = F.col("confidence_interval_low"), F.col("confidence_interval_high")
    place = (F.col("predicted_price") - low) / F.greatest(high - low, F.lit(1.0))
    return df.withColumn("position", F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)))


