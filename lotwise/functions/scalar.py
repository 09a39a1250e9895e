"""Column expressions. All of them are built-in functions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.schema import QUALITY_POINTS, SIZE_CLASSES

WHITESPACE = " \t\n\r\f\v"


def quoted(name: str) -> str:
    """The exact name of a top-level column, as text (names may hold dots or blanks)."""
    return name if name.replace("_", "").isalnum() else "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def no_nan(c: Column) -> Column:
    """NaN counts as a value in Spark's aggregates, so it becomes NULL on entry."""
    return F.when(~F.isnan(c), c)


def safe_ratio(a: Column, b: Column, default: Column | float = 0.0) -> Column:
    """``a / b``; ``default`` where either is missing or ``b`` is zero."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), default)


def clip_low(c: Column, low: float = 0) -> Column:
    """``max(c, low)`` that keeps NULL (``greatest`` alone would turn NULL into the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip_high(c: Column, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def quality_points(c: Column) -> Column:
    """Ordinal quality code to points; unknown codes count as 0."""
    points = F.create_map(*[F.lit(v) for pair in QUALITY_POINTS.items() for v in pair])
    return F.coalesce(F.try_element_at(points, c), F.lit(0))


def size_class(c: Column) -> Column:
    """Right-closed size bins."""
    out = None
    for high, label in SIZE_CLASSES:
        if high is None:
            out = out.when(c.isNotNull(), F.lit(label))
        elif out is None:
            out = F.when(c <= high, F.lit(label))
        else:
            out = out.when(c <= high, F.lit(label))
    return out


def hash_number(key: Column, seed: int = 42) -> Column:
    """32 uniform bits from a row key: the same in every engine, whatever the partitioning."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_bucket(key: Column, buckets: int, seed: int = 42) -> Column:
    return F.pmod(hash_number(key, seed), F.lit(buckets)).cast("int")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; NULL for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    x = F.when(both, x.cast("double"))
    y = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
