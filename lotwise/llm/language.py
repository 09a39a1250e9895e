"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts with the counts of the bytes that follow. A byte
costs ``-log2 n(s) / (n + d)`` bits in its longest context that knows it, where ``n`` counts all that
followed the context and ``d`` the different bytes; each longer context that does not know it first costs
an escape, ``-log2 (d + pruned) / (n + d)``. Bytes known nowhere cost 8 bits. The statistics stay frozen, so
the code length of a text is a sum over its bytes; the language with the shortest code wins and the
score is its posterior probability with equal priors.

Training counts the ``order + 1`` byte strings of all training texts; the counts of shorter ones are sums
of these. A node is kept if its count is at least ``share`` of its language's bytes, so a level of a
language has at most ``1 / share`` nodes, and with at most ``max_languages`` languages (the most frequent
ones) the broadcast model has a fixed bound.

Defined cases: a text that is missing or has no letter is ``und`` with score 0, as is every text when
nothing could be learned; texts without a language or without letters teach nothing; a language named
``und`` is not learned; ties go to the language that comes first by name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shelter import sheltered
from lotwise.llm.text import keep_columns, slices
from lotwise.session import via_table

ORDER = 4
SHARE = 1e-5
MAX_LANGUAGES = 100
UNKNOWN = "und"
_PAD = 10
_MAX_ORDER = 6  # a string and its language fit in 63 bits


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the string of it and the ``order`` bytes before (line feeds before a text's start),
    and the document of each byte."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.full(len(data) + order * len(sizes), _PAD, np.uint8)
    at = np.arange(len(data)) + order * (doc + 1)
    padded[at] = data
    out = np.zeros(len(data), np.int64)
    for back in range(order, -1, -1):
        out <<= 8
        out |= padded[at - back]
    return out, doc


@dataclass
class LanguageModel:
    """Costs in bits, a row per string or context and a column per language; index 0 of the lists is unused."""

    languages: list[str] = field(default_factory=list)
    order: int = ORDER
    keys: list[np.ndarray] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    def lookup(self, level: int, strings: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each string of ``level`` bytes after the bytes before it."""
        if level == 0:
            return np.full((len(strings), len(self.languages)), 8.0, np.float32)
        out, missing = _rows(self.keys[level], self.costs[level], strings)
        if len(missing):
            out[missing] = self._escaped(level, strings[missing])
        return out

    def _escaped(self, level: int, strings: np.ndarray) -> np.ndarray:
        shorter = self.lookup(level - 1, strings & ((1 << 8 * (level - 1)) - 1))
        escape, missing = _rows(self.contexts[level], self.escapes[level], strings >> 8)
        escape[missing] = 0
        return shorter + escape

    def add_level(self, level: int, nodes: list[tuple[int, int, int, int, list[tuple[int, int]]]]) -> None:
        """``nodes``: ``(language, context, n, d, [(byte, count), ...])`` of the contexts of ``level - 1`` bytes."""
        width = len(self.languages)
        self.contexts.append(np.unique(np.array([x[1] for x in nodes], np.int64)))
        escape = np.zeros((len(self.contexts[level]), width), np.float32)
        rows = np.searchsorted(self.contexts[level], [x[1] for x in nodes])
        strings, owners, costs = [], [], []
        for row, (language, context, n, d, children) in zip(rows, nodes):
            left = d + n - sum(c for _, c in children)
            escape[row, language] = math.log2((n + d) / left)
            for byte, count in children:
                strings.append(context << 8 | byte)
                owners.append(language)
                costs.append(math.log2((n + d) / count))
        self.escapes.append(escape)
        keys = np.unique(np.array(strings, np.int64))
        table = self._escaped(level, keys)
        table[np.searchsorted(keys, strings), owners] = costs
        self.keys.append(keys)
        self.costs.append(table)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        strings, _ = grams(data, offsets, self.order)
        costs = self.lookup(self.order + 1, strings)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(costs, offsets[full], axis=0, dtype=np.float64)
        return out


def _rows(keys: np.ndarray, table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the wanted keys, and which are not there (their rows are arbitrary)."""
    if not len(keys):
        return np.zeros((len(wanted), table.shape[1]), np.float32), np.arange(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return table[at], np.flatnonzero(keys[at] != wanted)


def _counts(order: int, names: list[str]):
    index = {name: i for i, name in enumerate(names)}
    shift = 8 * (order + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
            for first, data, offsets in slices(batch.column("t")):
                strings, doc = grams(data, offsets, order)
                own, n = np.unique(strings | languages[first + doc] << shift, return_counts=True)
                keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, n])).astype(np.int64) if len(at) else sums
            yield pa.RecordBatch.from_pydict(
                {
                    "l": pa.array((keys >> shift).astype(np.int32)),
                    "g": pa.array(keys & ((1 << shift) - 1)),
                    "n": pa.array(sums),
                }
            )

    return count


def fit_languages(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    share: float = SHARE,
    max_languages: int = MAX_LANGUAGES,
) -> LanguageModel:
    """Learns from all documents with a language and a letter."""
    if not 0 <= order <= _MAX_ORDER:
        raise ValueError(f"order must be between 0 and {_MAX_ORDER}")
    body = F.lower(F.col(f"`{text}`").cast("string"))
    usable = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), body.alias("t")).where(
        (F.col("lang") != UNKNOWN) & F.col("t").rlike(r"\p{L}")
    )
    frequent = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    names = sorted(r["lang"] for r in frequent.collect())
    model = LanguageModel(names, order, [None], [None], [None], [None])
    if not names:
        return model
    longest = via_table(
        usable.where(F.col("lang").isin(names))
        .mapInArrow(_counts(order, names), "l int, g bigint, n bigint")
        .groupBy("l", "g")
        .agg(F.sum("n").alias("n")),
        "strings",
    )
    levels = F.array(
        *[F.struct(F.lit(k).alias("level"), F.lit((1 << 8 * k) - 1).cast("long").alias("mask")) for k in range(1, order + 2)]
    )
    strings = (
        longest.select("l", "g", "n", F.inline(levels))
        .groupBy("l", "level", F.col("g").bitwiseAND(F.col("mask")).alias("g"))
        .agg(F.sum("n").alias("n"))
    )
    total = longest.groupBy("l").agg(F.sum("n").alias("total"))
    kept = F.col("n") >= F.ceil(F.lit(share) * F.col("total"))
    child = F.struct(F.col("g").bitwiseAND(F.lit(255)).cast("int").alias("byte"), F.col("n").alias("count"))
    nodes = (
        strings.join(F.broadcast(total), "l")  # one row per language
        .groupBy("l", "level", F.shiftright("g", 8).alias("context"))
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("d"),
            F.array_sort(F.collect_list(F.when(kept, child))).alias("children"),  # at most 256
        )
        .where(F.size("children") > 0)
        .orderBy("level", "l", "context")
        .collect()
    )
    for level in range(1, order + 2):
        model.add_level(
            level,
            [
                (r["l"], r["context"], r["n"], r["d"], [(c["byte"], c["count"]) for c in r["children"]])
                for r in nodes
                if r["level"] == level
            ],
        )
    return model


@sheltered
def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: ``lang``, ``score`` (0 to 1) and ``bits`` (the shortest code length)."""
    kind = "struct<lang:string,score:double,bits:double>"
    body = F.col(f"`{text}`").cast("string")
    kept = keep_columns(docs, out)
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    if not model.languages:
        return docs.select(*kept, nothing.cast(kind).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        own = shared.value
        bits = np.zeros((len(texts), len(own.languages)))
        step = max(1 << 16, (1 << 23) // len(own.languages))
        for first, data, offsets in slices(texts, step):
            bits[first : first + len(offsets) - 1] = own.code_lengths(data, offsets)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        score = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
        names = pa.DictionaryArray.from_arrays(pa.array(best, pa.int32()), pa.array(own.languages)).cast(pa.string())
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(least)], names=["lang", "score", "bits"])

    has_letter = F.coalesce(body.rlike(r"\p{L}"), F.lit(False))
    named = docs.select(*kept, predict.asNondeterministic()(F.lower(body)).alias(out), has_letter.alias("_letter"))
    return named.select(*kept, F.when(F.col("_letter"), F.col(f"`{out}`")).otherwise(nothing.cast(kind)).alias(out))
