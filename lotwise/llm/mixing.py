"""Mix sources to target weights.

Every document gets a hash-random key. Within each source the documents stand in key order, prefix sums
of their sizes are taken in two levels (key ranges, then the rows of one range), and the mix is cut at
each source's exact budget; a budget above the source's size repeats whole epochs first.

Defined cases: a missing size counts 0; a missing source is a source of its own, the last one; rows that
share a key (repeated rows) share the words at the cut in proportion to their size; a source without
words has target 0; no rows give no rows. A column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.shelter import sheltered
from lotwise.llm.text import keep_columns
from lotwise.session import via_table

HEX_DIGITS = 10
ROWS_PER_RANGE = 4096


def mix_key(columns: Sequence[Column], seed: int) -> Column:
    """128 random bits of a row as hexadecimal text: the same in every run and engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def source_targets(sources: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """``_s, _size`` (one row per source) plus ``_target``.

    Targets are ``min(rate * weight, max_epochs * size)`` with the one rate at which they add up to the
    budget: what repeated resharing of the excess ends at. A source is at its limit exactly if the
    targets at its own limiting rate do not exceed the budget.
    """
    everything = Window.partitionBy()
    up_to = Window.orderBy("_r", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    ranked = (
        sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_s").asc_nulls_last())))
        .withColumn("_w", weight)
        .withColumn("_cap", F.lit(float(max_epochs)) * F.col("_size"))
        .withColumn("_r", F.col("_cap") / F.col("_w"))
    )
    at_limit = F.sum("_cap").over(up_to) + F.col("_r") * (F.sum("_w").over(everything) - F.sum("_w").over(up_to))
    total = F.lit(float(budget)) * F.sum("_size").over(everything)
    full = ranked.withColumn("_total", total).withColumn("_full", at_limit <= F.col("_total"))
    rate = (F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(F.col("_full"), F.lit(None)).otherwise(F.col("_w"))
    ).over(everything)
    return full.withColumn("_rate", rate).select(
        "_s",
        "_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_rate") * F.col("_w"), F.col("_cap"))).alias("_target"),
    )


@sheltered
def mix_sources(
    docs: DataFrame,
    size: Column,
    key: Sequence[str],
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    out: str = "mix",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``size, source_size, target, taken`` (words, repeats counted).

    The documents themselves never move: only ``(source, key, size)`` is stored, the range sums shuffle,
    and one cut per source is joined back.
    """
    size = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    of = mix_key([F.col(f"`{k}`") for k in key], seed)
    narrow = via_table(
        docs.select(F.col(f"`{source}`").cast("string").alias("_s"), of.alias("_key"), size.alias("_n")), "mix"
    )
    bits = max(6, (narrow.count() // ROWS_PER_RANGE).bit_length())
    leading = F.conv(F.substring("_key", 1, HEX_DIGITS), 16, 10).cast("long")
    ranged = narrow.withColumn("_range", F.shiftright(leading, 4 * HEX_DIGITS - min(bits, 4 * HEX_DIGITS)))
    sums = via_table(ranged.groupBy("_s", "_range").agg(F.sum("_n").alias("_words")), "ranges")
    targets = source_targets(sums.groupBy("_s").agg(F.sum("_words").alias("_size")), weights, budget, max_epochs)
    whole = F.floor("_target").cast("long")
    targets = via_table(
        targets.withColumn("_epochs", F.coalesce(F.expr("floor(_target) div nullif(_size, 0)"), F.lit(0)).cast("long"))
        .withColumn("_rest", whole - F.col("_epochs") * F.col("_size")),
        "targets",
    )
    before = F.sum("_words").over(
        Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("_words")
    here = F.col("_rest").between(F.col("_base"), F.col("_base") + F.col("_words") - 1)
    cut_range = (
        sums.withColumn("_base", before)
        .join(targets.select(F.col("_s").alias("_ts"), "_rest"), F.col("_s").eqNullSafe(F.col("_ts")))
        .where(here)
        .select("_ts", F.col("_range").alias("_tr"), "_base", "_rest")
    )
    rows = (
        ranged.join(cut_range, F.col("_s").eqNullSafe(F.col("_ts")) & (F.col("_range") == F.col("_tr")))
        .groupBy("_ts", "_key", "_base", "_rest")
        .agg(F.sum("_n").alias("_words"))
        .withColumn(
            "_start",
            F.col("_base")
            - F.col("_words")
            + F.sum("_words").over(
                Window.partitionBy("_ts").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )
    cut = rows.where(F.col("_rest").between(F.col("_start"), F.col("_start") + F.col("_words") - 1)).select(
        F.col("_ts").alias("_cs"), F.col("_key").alias("_cut"), ((F.col("_rest") - F.col("_start")) / F.col("_words")).alias("_share")
    )
    plan = via_table(
        targets.join(cut, F.col("_s").eqNullSafe(F.col("_cs")), "left").select(
            F.col("_s").alias("_mix_s"), "_size", "_target", "_epochs", "_cut", "_share"
        ),
        "cuts",
    )
    own = F.col("_mix_size")
    more = (
        F.when(F.col("_cut").isNull() | (F.col("_mix_key") > F.col("_cut")), F.lit(0))
        .when(F.col("_mix_key") < F.col("_cut"), own)
        .otherwise(F.floor(F.col("_share") * own))
    )
    kept = keep_columns(docs, out)
    return (
        docs.select(*kept, size.alias("_mix_size"), of.alias("_mix_key"))
        .join(plan, F.col(f"`{source}`").cast("string").eqNullSafe(F.col("_mix_s")), "left")
        .select(
            *kept,
            F.struct(
                own.alias("size"),
                F.col("_size").alias("source_size"),
                F.col("_target").alias("target"),
                (F.col("_epochs") * own + more).cast("long").alias("taken"),
            ).alias(out),
        )
    )
