"""The position of every row in its group, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.joins import lookup_join
from lotwise.session import via_table

ROWS_PER_RANGE = 4096


def positions(rows: DataFrame, group: str, order: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows`` plus ``pos`` (from 0) and ``total`` (rows of the group), stored in the shared folder.

    Rows are sorted by ranges of ``group, *order``; a range counts its groups, and prefix sums of these counts
    (a row per range and group) place the ranges. ``group`` must not be missing; rows that are equal in all
    of ``order`` stand next to each other in any order.
    """
    parts = 1 + rows.count() // rows_per_range
    number = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    ranged = via_table(ranged.withColumn("_row", number), "ranged").withColumn("_range", F.shiftright("_row", 33))
    counts = via_table(
        ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")), "ranges"
    )
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(
        group,
        "_range",
        (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(group)).alias("total"),
    )
    found = lookup_join(ranged, placed, [group, "_range"], "inner", spread_by=F.xxhash64("_row"))
    return found.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")
