"""Exact quantiles by counting, with one plan for every size.

A quantile asks for the values at one or two ranks. Each search keeps a bracket that holds the value. A
pass counts the rows of the bracket in at most ``BINS`` bins, with the smallest and largest value of each,
and the bin that holds the rank becomes the next bracket. It is settled when the bracket is a single value
or the rank is its first or last row. Bins are cut in equal widths; where such a pass hardly divides the
rows (values over many magnitudes) the next one cuts by magnitude. The largest value of a bracket always
gets a bin of its own, so every pass shrinks the bracket and the search ends by itself.

What a task holds is a counter per search and bin. Counters are combined before they move, so a hot value,
a hot group and a column of distinct values cost the same.

For whole tables a mergeable sketch spares most passes: the first one places each rank between two values
(with about one row in a hundred between them), and the second counts the rows below and each value in between.
What decides is that count: a rank that the sketch has misplaced is searched as above. Where the rows in between
are still many, one more pass counts them in bins first, so there are three passes at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.joins import lookup_join, row_hash
from lotwise.functions.scalar import col
from lotwise.session import cut_lineage, via_table

BINS = 256
LAST_ROWS = 2048
SKETCH = 4096  # size of a sketch; its ranks are right to a fifth of a percent in practice
MARGIN = 0.004  # share of the rows on either side of a rank in which its value is looked for
SKETCH_GROUPS = 16  # tasks are merged in so many groups first
MANY = 1 << 22  # rows in between from which on they are counted in bins first
FINE_BINS = 4096
_LARGEST = 1.7976931348623157e308
_MAGNITUDES = 1100.0  # above the largest binary exponent of a double


def _number(value: Column) -> Column:
    """As a double; NaN counts as missing, and negative zero is zero."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


def _magnitude(v: Column) -> Column:
    """A monotone scale on which equal steps are equal ratios."""
    size = F.log2(F.greatest(F.abs(v), F.lit(5e-324))) + _MAGNITUDES
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * size)


def bin_of(v: Column, low: Column, high: Column, by_magnitude: Column | bool) -> Column:
    """The bin of a value inside ``[low, high]``: never falls as the value grows, and only the largest
    value is in the last one."""

    def equal(a: Column, b: Column, c: Column) -> Column:
        # Halves, so that the widest bracket does not overflow.
        return F.floor(F.try_divide(a / 2 - b / 2, c / 2 - b / 2) * (BINS - 1))

    a, b, c = (F.least(F.greatest(x, F.lit(-_LARGEST)), F.lit(_LARGEST)) for x in (v, low, high))
    plain, magnitude = equal(a, b, c), equal(_magnitude(a), _magnitude(b), _magnitude(c))
    if isinstance(by_magnitude, Column):
        place = F.when(by_magnitude, magnitude).otherwise(plain)
    else:
        place = magnitude if by_magnitude else plain
    inside = F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(BINS - 2))
    return F.when(v >= high, F.lit(BINS - 1)).otherwise(inside).cast("int")


def ranks(n: int, p: float) -> tuple[int, int, float]:
    """The two ranks around a quantile with linear interpolation, and the weight of the second."""
    h = (n - 1) * p
    low = math.floor(h)
    return low, min(math.ceil(h), n - 1), h - low


def _is_scan(df: DataFrame) -> bool:
    """Whether reading ``df`` again costs no more than reading a stored copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(word in plan for word in ("Join", "Aggregate", "Window", "Generate", "Sort", "Distinct", "Python", "Arrow", "Pandas"))


def _sketched(rows: DataFrame, count: int, probs: Sequence[float]) -> dict:
    """``n, a, b`` (number, smallest, largest) of every column and ``q``: around each of ``probs`` the values between
    which the sketch places it (absent for a column without values)."""
    columns = range(count)
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))).agg(
        *[f(f"c{i}").alias(f"{k}{i}") for i in columns for k, f in (("n", F.count), ("a", F.min), ("b", F.max))],
        *[F.expr(f"kll_sketch_agg_double(c{i}, {SKETCH})").alias(f"k{i}") for i in columns],
    )
    whole = parts.agg(
        *[f(f"{k}{i}").alias(f"{k}{i}") for i in columns for k, f in (("n", F.sum), ("a", F.min), ("b", F.max))],
        *[F.expr(f"kll_merge_agg_double(k{i}, {SKETCH})").alias(f"k{i}") for i in columns],
    )

    row = whole.first()  # some 50 KB a column, whatever the rows
    found = {name: row[name] for i in columns for name in (f"n{i}", f"a{i}", f"b{i}")}
    asked = []
    for i in columns:
        n = row[f"n{i}"]
        if n:
            wide = MARGIN + 2 / n
            ends = ", ".join(f"{min(max(q, 0.0), 1.0)!r}D" for p in probs for q in (p - wide, p + wide))
            asked.append(F.expr(f"kll_sketch_get_quantile_double(k{i}, array({ends}))").alias(f"q{i}"))
    if asked:
        sketches = {f"k{i}": bytes(row[f"k{i}"]) for i in columns}
        local = rows.sparkSession.createDataFrame([tuple(sketches.values())], ", ".join(f"{k} binary" for k in sketches))
        found |= local.select(*asked).first().asDict()
    return found


def _cells(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(f"c{i}").to_numpy(zero_copy_only=False).astype(np.float64)  # missing: NaN


def _narrowed(rows: DataFrame, searches: list[tuple[int, float, float]], wanted: list[set[int]]) -> list[tuple[int, float, float, set[int]]]:
    """The bins, cut in equal widths, that hold the wanted ranks of wide searches."""

    def edges(low: float, high: float) -> np.ndarray:
        return low + (high / FINE_BINS - low / FINE_BINS) * np.arange(1, FINE_BINS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(searches), FINE_BINS + 1), np.int64)
        for batch in batches:
            for s, (i, low, high) in enumerate(searches):
                v = _cells(batch, i)
                total[s, 0] += np.count_nonzero(v < low)
                v = v[(v >= low) & (v <= high)]
                total[s, 1:] += np.bincount(np.searchsorted(edges(low, high), v, "right"), minlength=FINE_BINS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"s": pa.array(at[0]), "bin": pa.array(at[1]), "n": pa.array(total[at])})

    found = rows.mapInArrow(count, "s bigint, bin bigint, n bigint").groupBy("s", "bin").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for s, (i, low, high) in enumerate(searches):
        own = found[found["s"] == s].sort_values("bin")
        ends, bins = np.cumsum(own["n"].to_numpy()), own["bin"].to_numpy()
        cuts = np.concatenate([[low], edges(low, high), [high]])
        for rank in wanted[s]:
            k = int(np.searchsorted(ends, rank, "right"))
            if k < len(bins) and bins[k] > 0:
                at = int(bins[k]) - 1
                top = high if at == FINE_BINS - 1 else float(np.nextafter(cuts[at + 1], -np.inf))
                out.append((i, float(cuts[at]), top, {rank}))
            else:
                out.append((i, low, high, {rank}))
    return out


def _values_at(rows: DataFrame, searches: list[tuple[int, float, float]], wanted: list[set[int]]) -> dict[tuple[int, int], float]:
    """``{(search, rank): value}`` of the ranks that lie inside their search."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(searches), np.int64)
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in searches]

        def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
            values, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return values, np.bincount(of, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)

        for batch in batches:
            for s, (i, low, high) in enumerate(searches):
                v = _cells(batch, i)
                below[s] += np.count_nonzero(v < low)
                held[s].append(np.unique(v[(v >= low) & (v <= high)], return_counts=True))
                if len(held[s]) > 64:
                    held[s] = [joined(held[s])]
        yield pa.RecordBatch.from_pydict({"s": pa.array(np.arange(len(searches))), "v": pa.nulls(len(searches), pa.float64()), "n": pa.array(below)})
        for s, parts in enumerate(held):
            if parts:
                values, n = joined(parts)
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.full(len(values), s)), "v": pa.array(values, pa.float64()), "n": pa.array(n)})

    counted = rows.mapInArrow(count, "s bigint, v double, n bigint").groupBy("s", "v").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy("s").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = rows.sparkSession.createDataFrame([(s, r) for s, ranks_ in enumerate(wanted) for r in ranks_], "s bigint, rank bigint")
    placed = counted.withColumn("end", F.sum("n").over(up_to)).where("v IS NOT NULL")
    hits = placed.join(F.broadcast(asked), "s").where("rank >= end - n AND rank < end")  # a row per search and rank
    return {(r["s"], r["rank"]): r["v"] for r in hits.select("s", "rank", "v").collect()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """``{column: [quantile, ...]}`` with linear interpolation, missing cells skipped.

    All columns share each pass over the data. The driver holds a bracket per column and rank. What is no plain scan
    is stored once, cut to these columns.
    """
    if not columns:
        return {}
    value = {c: _number(col(c)) for c in columns}
    rows = df.select(*[value[c].alias(f"c{i}") for i, c in enumerate(columns)])
    if not _is_scan(df):
        rows = via_table(rows, "quantiles")
        df, value = rows, {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    first = _sketched(rows, len(columns), probs)
    sizes = {c: first[f"n{i}"] or 0 for i, c in enumerate(columns)}
    settled: dict[tuple[str, int], float] = {}
    narrow: dict[tuple[int, float, float], set[int]] = {}
    for i, c in enumerate(columns):
        ends = first.get(f"q{i}", [])
        for p, low, high in zip(probs, ends[0::2], ends[1::2]):
            narrow.setdefault((i, low, high), set()).update(ranks(sizes[c], p)[:2])
    searches, wanted = list(narrow), list(narrow.values())
    wide = [s for s, (i, _, _) in enumerate(searches) if sizes[columns[i]] * 2 * MARGIN > MANY]
    if wide:
        finer = _narrowed(rows, [searches[s] for s in wide], [wanted[s] for s in wide])
        kept = [s for s in range(len(searches)) if s not in set(wide)]
        searches, wanted = [searches[s] for s in kept] + [x[:3] for x in finer], [wanted[s] for s in kept] + [x[3] for x in finer]
    if searches:
        for (s, rank), v in _values_at(rows, searches, wanted).items():
            settled[columns[searches[s][0]], rank] = v
    # (column, low, high, by magnitude) -> {rank: rows below the bracket}, and the rows inside.
    open_: dict[tuple[str, float, float, bool], dict[int, int]] = {}
    inside: dict[tuple[str, float, float, bool], int] = {}

    def place(c: str, rank: int, below: int, n: int, low: float, high: float, by_magnitude: bool) -> None:
        if low == high or rank == below:
            settled[c, rank] = low
        elif rank == below + n - 1:
            settled[c, rank] = high
        else:
            open_.setdefault((c, low, high, by_magnitude), {})[rank] = below
            inside[c, low, high, by_magnitude] = n

    for i, c in enumerate(columns):
        for rank in {r for p in probs if sizes[c] for r in ranks(sizes[c], p)[:2]}:
            if (c, rank) not in settled:
                place(c, rank, 0, sizes[c], first[f"a{i}"], first[f"b{i}"], False)
    while open_:
        searches, wanted = list(open_), list(open_.values())
        open_ = {}
        if max(inside[x] for x in searches) <= LAST_ROWS:
            # Every bracket is down to a few rows: count their values, and each rank is settled.
            values = [F.when(value[c].between(a, b), F.struct(F.lit(s).alias("s"), value[c].alias("v"))) for s, (c, a, b, _) in enumerate(searches)]
            found = df.select(F.inline(F.filter(F.array(*values), lambda x: x.isNotNull()))).groupBy("s", "v").agg(F.count(F.lit(1)).alias("n"))
            ends = dict.fromkeys(range(len(searches)), 0)
            for r in sorted(found.collect(), key=lambda r: (r["s"], r["v"])):  # at most LAST_ROWS per search
                start, ends[r["s"]] = ends[r["s"]], ends[r["s"]] + r["n"]
                for rank, below in wanted[r["s"]].items():
                    if below + start <= rank < below + ends[r["s"]]:
                        settled[searches[r["s"]][0], rank] = r["v"]
            break
        cells = [
            F.when(
                value[c].between(low, high),
                F.struct(F.lit(s).alias("s"), bin_of(value[c], F.lit(low), F.lit(high), m).alias("bin"), value[c].alias("v")),
            )
            for s, (c, low, high, m) in enumerate(searches)
        ]
        counted = (
            df.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
            .groupBy("s", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()  # at most BINS rows per search
        )
        bins: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["s"], r["bin"])):
            bins.setdefault(r["s"], []).append(r)
        for s, (c, _, _, by_magnitude) in enumerate(searches):
            total = sum(r["n"] for r in bins[s])
            for rank, below in wanted[s].items():
                for r in bins[s]:
                    if rank < below + r["n"]:
                        turned = by_magnitude != (4 * r["n"] > total)
                        place(c, rank, below, r["n"], r["low"], r["high"], turned)
                        break
                    below += r["n"]

    def quantile(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        low, high, part = ranks(sizes[c], p)
        a, b = settled[c, low], settled[c, high]
        return a if a == b else a + (b - a) * part

    return {c: [quantile(c, p) for p in probs] for c in columns}


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """One row per group with one exact quantile column per entry of ``probs``.

    The searches are a table with a row per group and rank; each pass joins it to the rows (broadcast
    only below a bound in bytes, else salted by the measured size of hot groups) and counts bins.
    """
    value = col(value) if isinstance(value, str) else value
    # As a struct, a missing group is a key like any other.
    # The hash of the whole row is read only where a hot group must be dealt into parts.
    rows = df.select(F.struct(*[col(b) for b in by]).alias("key"), _number(value).alias("v"), row_hash(df).alias("_row"))
    groups = via_table(
        rows.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "groups"
    )
    names = list(probs)
    levels = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs.values())])
    asked = (
        groups.where("n > 0")
        .select("*", F.inline(levels))
        .withColumn("h", (F.col("n") - 1) * F.col("p"))
        .select("key", "slot", "h", "n", "low", "high")
    )
    found = (
        asked.select("*", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))).alias("rank"))
        .select("key", "rank", F.lit(0).cast("long").alias("below"), "n", "low", "high", F.lit(False).alias("m"))
        .distinct()
    )
    last = F.col("below") + F.col("n") - 1
    known = (
        F.when((F.col("low") == F.col("high")) | (F.col("rank") == F.col("below")), F.col("low"))
        .when(F.col("rank") == last, F.col("high"))
    )
    present = rows.where(F.col("v").isNotNull())
    results = []
    while True:
        state = cut_lineage(found.withColumn("value", known))
        results.append(state.where(F.col("value").isNotNull()).select("key", "rank", "value"))
        todo = state.where(F.col("value").isNull()).drop("value")
        if todo.isEmpty():
            break
        search = F.struct("low", "high", "m")
        brackets = todo.groupBy("key").agg(F.collect_set(search).alias("brackets"))  # at most two per level
        met = (
            lookup_join(present, brackets, ["key"], "inner", spread_by=F.col("_row"))
            .select("key", "v", F.explode("brackets").alias("s"))
            .where(F.col("v").between(F.col("s.low"), F.col("s.high")))
        )
        up_to = Window.partitionBy("key", "s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = (
            met.groupBy("key", "s", bin_of(F.col("v"), F.col("s.low"), F.col("s.high"), F.col("s.m")).alias("bin"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
            .withColumn("end", F.sum("c").over(up_to))
        )
        inside = (F.col("rank") < F.col("below") + F.col("end")) & (F.col("rank") >= F.col("below") + F.col("end") - F.col("c"))
        found = (
            todo.withColumn("s", search)
            .drop("low", "high", "m")
            .join(bins, ["key", "s"])
            .where(inside)
            .select(
                "key",
                "rank",
                (F.col("below") + F.col("end") - F.col("c")).alias("below"),
                F.col("c").alias("n"),
                F.col("a").alias("low"),
                F.col("b").alias("high"),
                (F.col("s.m") != (4 * F.col("c") > F.col("n"))).alias("m"),
            )
        )
    values = results[0]
    for more in results[1:]:
        values = values.unionByName(more)
    pairs = asked.select("key", "slot", "h").join(
        values.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")), "key"
    )
    a, b = F.element_at("at", F.floor("h")), F.element_at("at", F.ceil("h"))
    picked = (
        pairs.select("key", "slot", F.when(a == b, a).otherwise(a + (b - a) * (F.col("h") - F.floor("h"))).alias("q"))
        .groupBy("key")
        .agg(*[F.max(F.when(F.col("slot") == i, F.col("q"))).alias(f"q{i}") for i in range(len(names))])
    )
    # Groups without a value have no quantile but stay in the result.
    return groups.select("key").join(picked, "key", "left").select("key.*", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
