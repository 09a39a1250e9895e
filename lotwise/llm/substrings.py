"""Remove word sequences that already stand in an earlier document, found by fixed-block anchors.

Every document is indexed by its non-overlapping blocks of ``(window + 1) // 2`` words: any window holds a
whole block of the document it stands in. Every document is probed with the rolling block-sized window, so
a window shared by two documents always meets a block of the earlier one. Blocks and probes are joined by
equality of their hash; a hash is live if some probe comes from a later document than some block. Hits are
extended both ways to every window that holds them, and the hash of the whole window (96 bits) decides:
where its smallest document is smaller than its own, the window repeats. Overlapping windows merge to
maximal runs.

Two bitmaps of ``2 ** filter_bits`` bits, the only things that are broadcast, spare work and decide
nothing: one lets probes pass that meet some block, the other marks the live hashes. When they fill up,
more rows are shuffled and the result stays the same. Rows that a batch of documents can settle by
itself (a passage repeated inside the batch) are settled there, so a passage that very many documents
share is one row per batch, not one per document.

Defined cases: a missing text has no words; a missing ``doc_id`` is larger than any other; documents with
equal ids never remove each other's words; a window repeated inside one document stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.shelter import sheltered
from lotwise.llm.text import SECOND, Words, keep_columns, mixed, rolling, slices, text_hash

LAST = (1 << 63) - 1
PAGE = 1 << 15
FILTER_BITS = 28

REMOVED = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,kept:string>"


class Bitmap:
    """A set of hashes with false positives, of fixed size: two bits per hash."""

    def __init__(self, bits: int, pages: list[tuple[int, bytes]]):
        self.shift = np.uint64(64 - bits)
        self.cells = np.zeros(1 << (bits - 3), np.uint8)
        for page, cells in pages:
            at = page * (PAGE // 8)
            self.cells[at : at + PAGE // 8] = np.frombuffer(cells, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self._bit(hashes >> self.shift)
        first = np.flatnonzero(out)
        turned = (hashes[first] << np.uint64(32)) | (hashes[first] >> np.uint64(32))
        out[first] = self._bit(turned >> self.shift)
        return out

    def _bit(self, slot: np.ndarray) -> np.ndarray:
        return (self.cells[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(hashes: DataFrame, column: str, bits: int) -> Bitmap:
    """Collects at most ``2 ** bits`` bits, whatever the number of rows."""
    turned = f"(shiftleft(`{column}`, 32) | shiftrightunsigned(`{column}`, 32))"
    slots = F.explode(F.array(*[F.expr(f"shiftrightunsigned({h}, {64 - bits}) + 1") for h in (f"`{column}`", turned)]))
    slot = F.col("slot")
    pages = (
        hashes.select(slots.alias("slot"))
        .select(F.bitmap_bucket_number(slot).alias("page"), F.bitmap_bit_position(slot).alias("at"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("at").alias("cells"))
        .collect()
    )
    return Bitmap(bits, [(r["page"] - 1, bytes(r["cells"])) for r in pages])


class Part:
    """Consecutive documents as word hashes; windows are named by their first word."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, block: int):
        words = Words(data, offsets)
        self.first, self.block, self.bounds = first, block, words.bounds
        self.hashes = words.hashes()
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        self.rolled = rolling(self.hashes, block)

    def inside(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self.doc[starts] == self.doc[starts + length - 1]

    def aligned(self) -> np.ndarray:
        """The first words of the fixed blocks."""
        starts = np.arange(len(self.rolled))
        fixed = starts[(starts - self.bounds[self.doc[: len(starts)]]) % self.block == 0]
        return fixed[self.inside(fixed, self.block)]

    def hits(self, known: Bitmap) -> np.ndarray:
        starts = np.flatnonzero(known.has(self.rolled))
        return starts[self.inside(starts, self.block)]

    def around(self, hits: np.ndarray, window: int) -> np.ndarray:
        """All windows of the same document that hold a hit."""
        doc = self.doc[hits]
        low = np.maximum(hits + self.block - window, self.bounds[doc])
        high = np.minimum(hits, self.bounds[doc + 1] - window)
        fits = low <= high
        n = len(self.hashes) + 1
        steps = np.bincount(low[fits], minlength=n) - np.bincount(high[fits] + 1, minlength=n)
        return np.flatnonzero(np.cumsum(steps) > 0)


def _parts(column: pa.Array, block: int) -> Iterator[Part]:
    for first, data, offsets in slices(column):
        yield Part(first, data, offsets, block)


def _ranks(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(block: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [p.rolled[p.aligned()] for p in _parts(batch.column("t"), block)]
            if own:
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.unique(np.concatenate(own)).view(np.int64))})

    return emit


def _probes(block: int, blocks):
    """One row per hash and batch: its smallest document as a block, its largest as a probe."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, hashes, low, high = _ranks(batch.column("o")), [], [], []
            for part in _parts(batch.column("t"), block):
                fixed = part.aligned()
                is_block = np.zeros(len(part.rolled), bool)
                is_block[fixed] = True
                at = np.union1d(part.hits(blocks.value), fixed)
                hashes.append(part.rolled[at])
                of = rank[part.first + part.doc[at]]
                high.append(of)
                low.append(np.where(is_block[at], of, LAST))
            if not hashes or not sum(map(len, hashes)):
                continue
            h, a, b = np.concatenate(hashes), np.concatenate(low), np.concatenate(high)
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array(h[new].view(np.int64)),
                    "block": pa.array(np.minimum.reduceat(a[order], new)),
                    "probe": pa.array(np.maximum.reduceat(b[order], new)),
                }
            )

    return emit


def _windows(block: int, window: int, live):
    """Windows around live hits. Of equal windows in a batch only those of the smallest document stay open;
    the others are known to repeat and come out as runs, spread by document and without a second hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, key = _ranks(batch.column("o")), _ranks(batch.column("k"))
            one, two, rows, starts = [], [], [], []
            for part in _parts(batch.column("t"), block):
                at = part.around(part.hits(live.value), window)
                if len(at):
                    one.append(rolling(part.hashes, window)[at])
                    other = mixed(part.hashes ^ np.uint64(SECOND))
                    two.append((rolling(other, window, SECOND)[at] >> np.uint64(32)).astype(np.uint32))
                    rows.append(part.first + part.doc[at])
                    starts.append(at - part.bounds[part.doc[at]])
            if not one:
                continue
            h, g, row, start = map(np.concatenate, (one, two, rows, starts))
            o = rank[row]
            order = np.lexsort((o, g, h))
            sh, sg = h[order], g[order]
            new = np.append(True, (sh[1:] != sh[:-1]) | (sg[1:] != sg[:-1]))
            least = o[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            repeats = np.empty(len(o), bool)
            repeats[order] = o[order] > least
            open_ = np.flatnonzero(~repeats)
            done = np.flatnonzero(repeats)
            follows = (row[done][1:] == row[done][:-1]) & (start[done][1:] == start[done][:-1] + 1)
            heads = done[np.append(True, ~follows)] if len(done) else done
            tails = done[np.append(~follows, True)] if len(done) else done
            at, end = np.concatenate([open_, heads]), np.concatenate([open_, tails])
            settled = np.append(np.zeros(len(open_), bool), np.ones(len(heads), bool))
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array(np.where(settled, key[row[at]], h[at].view(np.int64))),
                    "g": pa.array(g[at].view(np.int32), mask=settled),
                    "o": pa.array(o[at]),
                    "k": pa.array(key[row[at]]),
                    "start": pa.array(start[at].astype(np.int32)),
                    "end": pa.array((start[end] + window).astype(np.int32)),
                }
            )

    return emit


def repeated_runs(
    docs: DataFrame, text: Column, doc_id: Column, window: int = 50, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``o, k, spans``: word spans that repeat, by document (``o``: its id, ``k``: the hash of its text)."""
    context, block = docs.sparkSession.sparkContext, (window + 1) // 2
    body = text.cast("string")
    source = docs.select(body.alias("t"), F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("o"), text_hash(body).alias("k"))
    blocks = context.broadcast(bitmap(source.select("t").mapInArrow(_blocks(block), "h bigint"), "h", filter_bits))
    joined = (
        source.select("t", "o")
        .mapInArrow(_probes(block, blocks), "h bigint, block bigint, probe bigint")
        .groupBy("h")
        .agg(F.min("block").alias("block"), F.max("probe").alias("probe"))
        .where("block < probe")
    )
    live = context.broadcast(bitmap(joined, "h", filter_bits))
    blocks.unpersist()
    return (
        source.mapInArrow(_windows(block, window, live), "h bigint, g int, o bigint, k bigint, start int, end int")
        .withColumn("least", F.min("o").over(Window.partitionBy("h", "g")))
        .where("g IS NULL OR o > least")
        .groupBy("o", "k")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )


@sheltered
def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    window: int = 50,
    filter_bits: int = FILTER_BITS,
    out: str = "unique",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, removed word ``spans`` (merged, end exclusive), and the
    ``kept`` words joined by one space."""
    if window < 2:
        raise ValueError("window must be at least 2")
    body, number = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    runs = repeated_runs(docs, body, number, window, filter_bits).select(
        F.col("o").alias("_run_o"), F.col("k").alias("_run_k"), F.col("spans").alias("_run_spans")
    )
    kept = keep_columns(docs, out)

    @F.arrow_udf(REMOVED)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, removed, left = [], [], []
        for i in range(0, len(texts), 256):
            part = texts.slice(i, 256).fill_null("").cast(pa.large_binary()).to_pylist()
            for j, t in enumerate(part):
                words, gone = t.split(), []
                counts.append(len(words))
                if spans[i + j].is_valid:
                    pieces = spans[i + j].values
                    a, b = (np.asarray(pieces.field(n)) for n in ("start", "end"))
                    depth = np.bincount(a, minlength=len(words) + 1) - np.bincount(b, minlength=len(words) + 1)
                    over = np.concatenate([[0], (np.cumsum(depth)[:-1] > 0).astype(np.int8), [0]])
                    edges = np.flatnonzero(np.diff(over))
                    gone = list(zip(edges[0::2].tolist(), edges[1::2].tolist()))
                    for start, end in reversed(gone):
                        del words[start:end]
                removed.append([{"start": a, "end": b} for a, b in gone])
                left.append(b" ".join(words))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(removed, span), pa.array(left, pa.binary()).cast(pa.string())],
            names=["n_words", "spans", "kept"],
        )

    joined = docs.select(
        *kept, F.coalesce(number.cast("long"), F.lit(LAST)).alias("_run_a"), text_hash(body).alias("_run_b")
    ).join(runs, (F.col("_run_a") == F.col("_run_o")) & (F.col("_run_b") == F.col("_run_k")), "left")
    return joined.select(*kept, cut.asNondeterministic()(body, F.col("_run_spans")).alias(out))


def removed_words(unique: Column) -> Column:
    """Number of words inside the removed spans."""
    return F.aggregate(unique["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
