"""Delete runs of lines that already stood earlier, found by winnowing over line hashes.

A line counts by its text without surrounding separators; blank lines take no part and stay. In every
window of ``run`` consecutive lines the smallest line hash (the last one on ties) is a fingerprint, so two
equal runs of at least ``run`` lines always share one at the same place. Fingerprints are joined by
equality; those that occur twice are extended both ways to every window of ``run`` lines that holds them,
and the hash of the whole window (96 bits) decides: all but its first occurrence (by document id, then
text hash, then place) are deleted. Overlapping windows merge to the whole repeated run.

With ``words`` a run is measured by its content as well: windows of fewer lines count too if they hold that
many words. With ``common_words`` so do single lines of that many words that stand in at least ``often``
rows. Both take the same way: a fingerprint or the line itself, then the hash of the window.

The fingerprints that occur twice travel as a bitmap of fixed size, which only spares work. Repeats inside
a batch of documents are settled there, so a run that very many documents share is one row per batch.

Defined cases: a missing text has no lines and stays missing; a missing ``doc_id`` comes last; a document
with fewer lines than ``run`` loses none unless ``words`` or ``common_words`` is given; rows with equal id and text are one document and lose the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.joins import lookup_join
from lotwise.llm.shelter import sheltered
from lotwise.llm.substrings import LAST, bitmap
from lotwise.llm.text import SECOND, SEPARATORS, keep_columns, mixed, rolling, text_hash
from lotwise.session import via_table

RUN = 3
WORDS = 50
COMMON_WORDS = 5
OFTEN = 100
FILTER_BITS = 26
KEPT = "struct<n_lines:bigint,spans:array<struct<start:int,end:int>>,kept:string>"


class Lines:
    """The hashes of the lines that count, document after document."""

    def __init__(self, texts: list[bytes | None], run: int, words: int = 0, common_words: int = 0):
        found = [[y for x in (t or b"").split(b"\n") if (y := x.strip(SEPARATORS))] for t in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        flat = [y for x in found for y in x]
        self.run, self.least, self.common = run, words, common_words
        # The separators are the white space of bytes.split.
        sizes_in_words = (len(x.split()) for x in flat) if words or common_words else repeat(0)
        self.words = np.fromiter(sizes_in_words, np.int64, len(flat))
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
        self.other = np.fromiter(map(xxhash.xxh64_intdigest, flat, repeat(1)), np.uint64, len(flat))

    def windows(self, size: int) -> np.ndarray:
        """First lines of the windows of ``size`` lines that lie in one document."""
        starts = np.arange(max(0, len(self.hashes) - size + 1))
        return starts[self.doc[starts] == self.doc[starts + size - 1]]

    def minima(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Place of the smallest line hash of each window."""
        if not len(starts):
            return starts
        around = starts[:, None] + np.arange(size)[::-1]
        return starts + size - 1 - np.argmin(self.hashes[around], axis=1)

    def short(self) -> Iterator[tuple[int, np.ndarray]]:
        """Windows of fewer lines than ``run`` that hold enough words, by size."""
        total = np.concatenate([[0], np.cumsum(self.words)])
        for size in range(1, self.run if self.least else 1):
            starts = self.windows(size)
            yield size, starts[total[starts + size] - total[starts] >= self.least]

    def fingerprints(self) -> np.ndarray:
        """Places of the minima of the windows of ``run`` lines, each once."""
        return np.unique(self.minima(self.windows(self.run), self.run))

    def places(self) -> np.ndarray:
        """Places of the minima of all windows, each once."""
        return np.unique(np.concatenate([self.fingerprints(), *[self.minima(at, size) for size, at in self.short()]]))

    def lines(self) -> np.ndarray:
        """Places of the lines that count if they are common: those that are no window by themselves."""
        if not self.common:
            return np.empty(0, np.int64)
        own = self.words >= self.common
        if self.run == 1:
            own[:] = False
        elif self.least:
            own &= self.words < self.least
        return np.flatnonzero(own)

    def once(self) -> np.ndarray:
        """The hashes of ``lines()``, each once for a document."""
        at = self.lines()
        at = at[np.lexsort((self.hashes[at], self.doc[at]))]
        h, doc = self.hashes[at], self.doc[at]
        return h[np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))] if len(at) else h

    def around(self, places: np.ndarray) -> np.ndarray:
        """All windows that hold one of the places."""
        starts = self.windows(self.run)
        marked = np.zeros(len(self.hashes) + 1, np.int64)
        marked[places + 1] = 1
        total = np.cumsum(marked)
        return starts[total[starts + self.run] > total[starts]]


def _batches(column: pa.Array, *options: int) -> Iterator[tuple[int, Lines]]:
    for i in range(0, len(column), 512):
        yield i, Lines(column.slice(i, 512).cast(pa.large_binary()).to_pylist(), *options)


def _prints(*options: int):
    """Line hashes: how often each is a fingerprint, and in how many rows it is a line that may be common."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lines = [], []
            for _, part in _batches(batch.column("t"), *options):
                own.append(part.hashes[part.places()])
                lines.append(part.once())
            if own:
                n_own = sum(map(len, own))
                h, at = np.unique(np.concatenate(own + lines), return_inverse=True)
                n, rows = (np.bincount(x, minlength=len(h)) for x in (at[:n_own], at[n_own:]))
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n), "rows": pa.array(rows)})

    return emit


def _candidates(live, common, *options: int):
    """Windows around live fingerprints, and lines that may be common: the first of each hash in the batch
    goes on with its hash, the others are known to repeat."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, key = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("o", "k"))
            one, two, rows, starts, lengths, lines = [], [], [], [], [], []
            for first, part in _batches(batch.column("t"), *options):
                places = part.fingerprints()
                found = [(part.run, part.around(places[live.value.has(part.hashes[places])]) if len(places) else places, False)]
                for size, at in part.short():
                    found.append((size, at[live.value.has(part.hashes[part.minima(at, size)])], False))
                if common is not None:
                    at = part.lines()
                    found.append((1, at[common.value.has(part.hashes[at])], True))
                for size, at, is_line in found:
                    if len(at):
                        one.append(rolling(part.hashes, size)[at])
                        two.append((rolling(mixed(part.other), size, SECOND)[at] >> np.uint64(32)).astype(np.uint32))
                        rows.append(first + part.doc[at])
                        starts.append(at - part.bounds[part.doc[at]])
                        lengths.append(np.full(len(at), size))
                        lines.append(np.ma.masked_array(part.hashes[at].view(np.int64), not is_line))
            if not one:
                continue
            h, g, row, start, length = map(np.concatenate, (one, two, rows, starts, lengths))
            line = np.ma.concatenate(lines)
            order = np.lexsort((start, key[row], rank[row], g, h))
            sh, sg = h[order], g[order]
            new = np.append(True, (sh[1:] != sh[:-1]) | (sg[1:] != sg[:-1]))
            # A repeated row of the same document stands at the same place as the first.
            head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            same = (rank[row[order]] == rank[row[head]]) & (key[row[order]] == key[row[head]]) & (start[order] == start[head])
            settled = np.empty(len(h), bool)
            settled[order] = ~same
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array(h.view(np.int64), mask=settled),
                    "g": pa.array(g.view(np.int32), mask=settled),
                    "o": pa.array(rank[row]),
                    "k": pa.array(key[row]),
                    "start": pa.array(start.astype(np.int32)),
                    "size": pa.array(length.astype(np.int32)),
                    "line": pa.array(line.data, mask=np.ma.getmaskarray(line)),
                }
            )

    return emit


def repeated_lines(
    docs: DataFrame,
    text: Column,
    doc_id: Column,
    run: int,
    filter_bits: int,
    words: int = 0,
    common_words: int = 0,
    often: int = OFTEN,
) -> DataFrame:
    """``o, k, windows``: the first line and the size of the windows that stood earlier, by document."""
    context, options = docs.sparkSession.sparkContext, (run, words, common_words)
    body = text.cast("string")
    source = docs.select(body.alias("t"), F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("o"), text_hash(body).alias("k"))
    counted = (
        source.select("t").mapInArrow(_prints(*options), "h bigint, n bigint, rows bigint")
        .groupBy("h").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    )
    frequent, common = F.col("rows") >= often, None
    if common_words:
        counted = via_table(counted.where((F.col("n") > 1) | frequent), "prints")
        common = context.broadcast(bitmap(counted.where(frequent), "h", filter_bits))
    live = context.broadcast(bitmap(counted.where("n > 1"), "h", filter_bits))
    schema = "h bigint, g int, o bigint, k bigint, start int, size int, line bigint"
    found = via_table(source.mapInArrow(_candidates(live, common, *options), schema), "windows")
    live.unpersist()
    if common is not None:
        common.unpersist()
        exact = lookup_join(
            found.where("line IS NOT NULL"), counted.where(frequent).select(F.col("h").alias("line")), ["line"], "left_semi"
        )
        found = found.where("line IS NULL").unionByName(exact)
    place = F.struct("o", "k", "start")
    late = (
        found.where("h IS NOT NULL")
        .withColumn("first", F.min(place).over(Window.partitionBy("h", "g")))
        .where(place > F.col("first"))
    )
    settled = found.where("h IS NULL")
    return (
        late.select("o", "k", "start", "size").unionByName(settled.select("o", "k", "start", "size")).groupBy("o", "k")
        .agg(F.collect_set(F.struct("start", "size")).alias("windows"))
    )


def cut_lines(text: bytes, starts: np.ndarray, run: int | np.ndarray) -> tuple[int, list[tuple[int, int]], bytes]:
    """Number of lines that count, spans of removed ones (of all lines, end exclusive), and the rest."""
    lines = text.split(b"\n")
    counted = np.flatnonzero([bool(x.strip(SEPARATORS)) for x in lines])
    if not len(starts):
        return len(counted), [], text
    gone = np.zeros(len(lines), bool)
    edge = np.zeros(len(counted) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    gone[counted[np.cumsum(edge)[:-1] > 0]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = b"\n".join(x for x, g in zip(lines, gone) if not g)
    return len(counted), list(zip(edges[0::2].tolist(), edges[1::2].tolist())), kept


@sheltered
def remove_repeated_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    run: int = RUN,
    filter_bits: int = FILTER_BITS,
    out: str = "lines",
    words: int = 0,
    common_words: int = 0,
    often: int = OFTEN,
) -> DataFrame:
    """``docs`` with a struct ``out``: ``n_lines``, removed ``spans`` of line numbers, and the ``kept`` text.

    Without ``words`` and ``common_words`` only windows of ``run`` lines count."""
    if run < 1 or often < 1:
        raise ValueError("run and often must be at least 1")
    body, number = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    late = repeated_lines(docs, body, number, run, filter_bits, words, common_words, often).select(
        F.col("o").alias("_run_o"),
        F.col("k").alias("_run_k"),
        F.col("windows")["start"].alias("_run_starts"),
        F.col("windows")["size"].alias("_run_sizes"),
    )
    kept = keep_columns(docs, out)

    @F.arrow_udf(KEPT)
    def cut(texts: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        counts, removed, left = [], [], []
        for i in range(0, len(texts), 256):
            for j, t in enumerate(texts.slice(i, 256).cast(pa.large_binary()).to_pylist()):
                own = (starts[i + j], sizes[i + j])
                late, size = (np.asarray(x.values if x.is_valid and t is not None else [], np.int64) for x in own)
                n, spans, rest = cut_lines(t or b"", late, size)
                counts.append(n)
                removed.append([{"start": a, "end": b} for a, b in spans])
                left.append(None if t is None else rest)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(removed, span), pa.array(left, pa.binary()).cast(pa.string())],
            names=["n_lines", "spans", "kept"],
        )

    joined = docs.select(
        *kept, F.coalesce(number.cast("long"), F.lit(LAST)).alias("_run_a"), text_hash(body).alias("_run_b")
    ).join(late, (F.col("_run_a") == F.col("_run_o")) & (F.col("_run_b") == F.col("_run_k")), "left")
    return joined.select(*kept, cut.asNondeterministic()(body, F.col("_run_starts"), F.col("_run_sizes")).alias(out))


def removed_lines(lines: Column) -> Column:
    return F.aggregate(lines["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@sheltered
def deduplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``."""
    name = "_lines"
    cut = remove_repeated_lines(docs, text, doc_id, out=name, **options)
    return cut.select(*[F.col(name)["kept"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
