"""Lookup joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.scalar import col
from lotwise.session import cut_lineage

MAX_BROADCAST_BYTES = 32 << 20
PARTS = 1000


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of the rows in memory, about: fixed widths plus the measured length of the texts."""
    texts = [F.sum(F.octet_length(col(f.name).cast("string"))) for f in df.schema if not isinstance(f.dataType, T.NumericType)]
    row = df.agg(F.count(F.lit(1)), *texts).first()
    return row[0] * (16 + 16 * len(df.columns)) + sum(x or 0 for x in row[1:])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that have one: the same when a lost task runs again, unlike a random number."""
    return F.xxhash64(F.lit(7), *[col(f.name) for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())])


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = MAX_BROADCAST_BYTES,
    spread_by: Column | None = None,
) -> DataFrame:
    """Join ``rows`` with an aggregated ``lookup`` (unique on ``on``).

    The lookup is cut to a checkpoint and measured. Up to ``max_bytes`` it is broadcast, and the big
    side never moves. Beyond, both sides shuffle by key, and a key with more than a ``PARTS``-th of the
    rows is dealt into as many parts as it has such shares; its lookup row is repeated for each. At most
    ``PARTS`` keys are that hot, so the table of them is always small. The part of a row follows from its
    content (``spread_by``, a hash; of all columns if not given), so a task that runs again deals the same.
    """
    lookup = cut_lineage(lookup)
    if size_in_bytes(lookup) <= max_bytes:
        return rows.join(F.broadcast(lookup), list(on), how)
    counts = cut_lineage(rows.groupBy(*[col(c) for c in on]).agg(F.count(F.lit(1)).alias("_n")))
    share = max(1, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // PARTS))
    hot = F.broadcast(
        counts.where(F.col("_n") > share).select(*[col(c) for c in on], F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salt = row_hash(rows) if spread_by is None else spread_by
    spread = rows.join(hot, list(on), "left").withColumn("_part", F.pmod(salt, parts).cast("int"))
    repeated = lookup.join(hot, list(on), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop("_parts").join(repeated.drop("_parts"), [*on, "_part"], how).drop("_part")
