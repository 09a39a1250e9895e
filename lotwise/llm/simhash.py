"""Near copies by 64-bit fingerprints of word shingles, linked through deletion-variant signatures.

Fingerprints that differ in at most ``d`` bits, cut into ``d // 2 + 1`` segments, agree in one of them up
to a single bit. So each distinct fingerprint is indexed under every segment as it is and with each one
bit blanked, and equal signatures are joined. A signature shared by two fingerprints is one pair, whose
distance is counted. One that is shared by more never becomes pairs: its members are verified by
equality too, since two fingerprints differ in at most two bits exactly if some 64-bit value is at most
one bit from both. Each member is placed at its 65 such values; a value has at most 65 members.

Defined cases: a text without words has fingerprint zero and links like any other; a shorter text than a
shingle is one shingle; a missing ``doc_id`` has a fingerprint and a class but never names it; repeated
rows are all kept by :func:`simhash_classes`; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.components import components
from lotwise.llm.shelter import sheltered
from lotwise.llm.text import LOWER, text_hash
from lotwise.session import via_table

SEED = 42
SPREAD = 20_000
_STEP = 1 << 14


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set where it is set in over half of the shingle hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for first in range(0, total, _STEP):
        part = words[first : min(first + _STEP, total) + shingle - 1]
        runs = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(part) - shingle + 1)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), np.uint64)
        for i in range(0, len(texts), 256):
            part = texts.slice(i, 256).fill_null("").cast(pa.large_binary()).to_pylist()
            out[i : i + len(part)] = [fingerprint(t, shingle) for t in part]
        return pa.array(out.view(np.int64))

    return of.asNondeterministic()(text.cast("string"))


def _signatures(fps: DataFrame, max_bits: int) -> DataFrame:
    """``sig, bit, fp``: one row per segment and blanked bit (none: bit is missing)."""
    cuts = max(2, max_bits // 2 + 1)
    edges = [64 * i // cuts for i in range(cuts + 1)]
    shapes = []
    for low, high in zip(edges, edges[1:]):
        full = (1 << (high - low)) - 1
        shapes += [(low, full, None), *((low, full & ~(1 << i), low + i) for i in range(high - low))]
    wanted = F.array(
        *[
            F.struct(
                F.lit(code).cast("long").alias("code"),
                F.lit(low).alias("low"),
                F.lit(mask).cast("long").alias("mask"),
                F.lit(bit).cast("int").alias("at"),
            )
            for code, (low, mask, bit) in enumerate(shapes)
        ]
    )
    # A row becomes one per shape: spread the rows first, so that no task holds many.
    spread = fps.repartition(1 + fps.count() // SPREAD, "fp")
    return spread.select("fp", F.inline(wanted)).select(
        (F.shiftleft("code", 32) + F.expr("shiftrightunsigned(fp, low)").bitwiseAND(F.col("mask"))).alias("sig"),
        F.expr("shiftright(fp, at) & 1").alias("bit"),
        "fp",
    )


def fingerprint_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``fp``, unique) whose components are those of all
    pairs at most ``max_bits`` apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    signatures = _signatures(fps, max_bits)
    shared = via_table(
        signatures.groupBy("sig")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("fp").alias("a"),
            F.max("fp").alias("b"),
            F.min("bit").alias("low"),
            F.max("bit").alias("high"),
        )
        # A blanked bit in which all agree adds nothing to the segment as it is.
        .where("n > 1 AND (low IS NULL OR low <> high)")
        .drop("low", "high"),
        "signatures",
    )
    pairs = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    crowded = signatures.join(shared.where("n > 2").select("sig"), "sig", "left_semi").select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    placed = crowded.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    met = placed.groupBy("at").agg(F.collect_list("fp").alias("members"))  # at most 65 of them
    if max_bits == 2:
        centre = F.array_min("members")
    else:
        centre = F.when(F.array_contains("members", F.col("at")), F.col("at"))
    stars = met.where(F.size("members") > 1).select(centre.alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def fingerprint_classes(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fp, root``: for each distinct fingerprint the smallest one that links lead to."""
    found = components(fingerprint_links(fps, max_bits))
    return fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document, 16 hexadecimal digits, smallest id reachable."""
    prints = via_table(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(F.col(f"`{text}`"), shingle).alias("fp")),
        "fingerprints",
    )
    distinct = via_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = via_table(fingerprint_classes(distinct.select("fp"), max_bits), "classes")
    names = (
        distinct.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id")).join(classes, "root").drop("root")
    )
    return prints.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@sheltered
def drop_near_copies(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 3,
    max_bits: int = 2,
    order: Sequence[str] = (),
) -> DataFrame:
    """One document of each class stays: the smallest id (missing ids last), then the smallest text hash.

    Rows with the same id and text are one document; the smallest values of its other columns stay, taken
    together in the order of ``order``, then of the table (columns that have no order: any).
    """
    identity = F.struct(
        F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), text_hash(F.col(f"`{text}`")).alias("hash")
    )
    prints = via_table(
        docs.select(identity.alias("who"), fingerprints(F.col(f"`{text}`"), shingle).alias("fp")), "fingerprints"
    )
    distinct = via_table(prints.groupBy("fp").agg(F.min("who").alias("who")), "distinct")
    kept = (
        distinct.join(fingerprint_classes(distinct.select("fp"), max_bits), "fp")
        .groupBy("root")
        .agg(F.min("who").alias("who"))
        .select(F.xxhash64("who").alias("_k1"), F.col("who.hash").alias("_k2"))
    )
    names = docs.columns
    rest = [c for c in order] + [c for c in names if c not in order and c not in (text, doc_id)]
    sortable = [c for c in rest if not docs.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(identity).alias("_k1"), text_hash(F.col(f"`{text}`")).alias("_k2"))
    one = keyed.join(kept, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(
        F.first(f"`{text}`").alias("_text"),
        F.first(f"`{doc_id}`").alias("_id"),
        *([F.min(F.struct(*[F.col(f"`{c}`") for c in sortable])).alias("_rest")] if sortable else []),
        *[F.first(f"`{c}`").alias(f"_any_{c}") for c in rest if c not in sortable],
    )

    def value(c: str) -> Column:
        if c == text:
            return F.col("_text")
        if c == doc_id:
            return F.col("_id")
        return F.col("_rest")[c] if c in sortable else F.col(f"`_any_{c}`")

    return one.select(*[value(c).alias(c) for c in names])
