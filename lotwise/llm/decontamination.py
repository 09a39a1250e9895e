"""Find benchmark passages in documents with a prefix-filtered join.

Every item is cut into windows of ``window`` consecutive words (a shorter item is one window). The words
of a window are ordered by rarity, counted over all documents. A window of ``L`` words that occurs with at
least ``ceil(threshold * L)`` words in place must show one of its ``L - ceil(threshold * L) + 1`` rarest
words: only these prefix words are joined with the documents. The offset of the prefix word gives the only
start that is possible (positional bound), the window must fit in the document (length bound), and the
words are compared one by one. With ``threshold`` 1 the prefix is a single word and matches are exact.

The items are read in portions of ``portion_bytes`` of text, so what is broadcast has a fixed bound; each
further portion is one more pass inside the same stage over the documents.

Defined cases: a missing text has no words; items without an id or without words take no part; an id
that stands in several rows is one item; documents may repeat; without items nothing is hit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shelter import sheltered
from lotwise.llm.text import keep_columns

# Words are maximal runs of ASCII letters, digits and any character beyond ASCII; A-Z are lower-cased.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
PORTION_BYTES = 16 << 20
_STEP = 256

FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class ItemIndex:
    """The windows of one portion of items and the prefix words that lead to them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, threshold: float):
        self.windows: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = item_words(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                self.windows.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.threshold = threshold
        self.vocabulary = {w for words in self.windows for w in words}
        self.prefix: dict[bytes, list[tuple[int, list[bytes], int, list[str]]]] = {}

    def order(self, frequency: dict[bytes, int]) -> None:
        for words, items in self.windows.items():
            need = math.ceil(self.threshold * len(words))
            rare = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i], i))
            for offset in rare[: len(words) - need + 1]:
                entry = (offset, list(words), need, sorted(items))
                self.prefix.setdefault(words[offset], []).append(entry)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The covered spans, merged, and the items with an occurring window."""
        prefix, spans, found = self.prefix, set(), set()
        for i in [i for i, w in enumerate(words) if w in prefix]:
            for offset, window, need, items in prefix[words[i]]:
                start = i - offset
                end = start + len(window)
                if start < 0 or end > len(words):
                    continue
                there = words[start:end]
                if there == window or need < len(window) and sum(map(bytes.__eq__, there, window)) >= need:
                    spans.add((start, end))
                    found.update(items)
        return merged(spans), found


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans without overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    for i in range(0, len(column), _STEP):
        yield column.slice(i, _STEP).fill_null("").cast(pa.large_binary()).to_pylist()


def item_index(
    docs: DataFrame, items: list[tuple[str, bytes]], text: Column, window: int, threshold: float
) -> ItemIndex:
    """The index of one portion, its words ordered by their document frequency in all of ``docs``."""
    index = ItemIndex(items, window, threshold)
    words = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        known = words.value
        for batch in batches:
            for texts in _texts(batch.column(0)):
                for t in texts:
                    total.update(known.intersection(item_words(t)))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())}
        )

    counted = docs.select(text.cast("string").alias("t")).mapInArrow(count, "word binary, n bigint")
    # At most one row per word of the portion.
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    words.unpersist()
    index.order({bytes(r["word"]): r["n"] for r in rows})
    return index


@sheltered
def find_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    threshold: float = 1.0,
    portion_bytes: int = PORTION_BYTES,
    out: str = "found",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, covered word ``spans`` (end exclusive), found ``items``."""
    if not 0 < threshold <= 1 or window < 1:
        raise ValueError("threshold must be in (0, 1], window at least 1")
    spark = docs.sparkSession
    body = F.col(f"`{text}`")
    wanted = items.select(
        F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")
    ).where("i IS NOT NULL AND t IS NOT NULL")
    size = wanted.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    portions = max(1, math.ceil(size / portion_bytes))
    kept = keep_columns(docs, out)
    state = F.lit(None).cast(FOUND)
    frame = docs.select(*kept, state.alias(out))
    for k in range(portions):
        # One portion holds about portion_bytes of text, whatever the number of items.
        rows = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(portions)) == k).collect()
        index = item_index(docs, [(r["i"], r["t"].encode()) for r in rows], body, window, threshold)
        shared = spark.sparkContext.broadcast(index)

        @F.arrow_udf(FOUND)
        def find(texts: pa.Array, before: pa.Array) -> pa.Array:
            out, last = [], before.to_pylist()
            for part in _texts(texts):
                for t in part:
                    words = item_words(t)
                    spans, found = shared.value.find(words)
                    earlier = last[len(out)]
                    if earlier is not None:
                        spans = merged([*spans, *((s["start"], s["end"]) for s in earlier["spans"])])
                        found = found.union(earlier["items"])
                    out.append(
                        {
                            "n_words": len(words),
                            "spans": [{"start": a, "end": b} for a, b in spans],
                            "items": sorted(found),
                        }
                    )
            return pa.array(
                out,
                pa.struct(
                    [
                        ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ("items", pa.list_(pa.string())),
                    ]
                ),
            )

        frame = frame.select(*kept, find.asNondeterministic()(body.cast("string"), F.col(f"`{out}`")).alias(out))
    return frame


def hit_words(found: Column) -> Column:
    """Number of words inside the spans."""
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@sheltered
def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs."""
    name = "_found"
    found = find_items(docs, items, out=name, **options)
    return found.where(F.size(F.col(name)["items"]) == 0).drop(name)
