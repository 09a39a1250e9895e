"""Personal data: pattern matches, and terms that give a protected value away.

E-mail addresses, network addresses, payment cards and telephone numbers are found by pattern. Each
distinct value of these is a protected entity. The words around its mentions are candidate terms, and the
corpus says how much a term ``t`` reveals of an entity ``e``:

    disclosure = log(p(e | t) / p(e)) / log(1 / p(e))

the share of the entity's information that the term carries: 1 if the term occurs only with the entity,
0 if it tells nothing. Counted are different surroundings of the entity and different texts with the term, so
copies of a text count once on both sides. From ``support`` surroundings on ``p(e | t)`` is the plain share,
below it is the lower 95 % confidence bound of the share (Wilson), so an entity mentioned once or twice has
terms too where the corpus is large enough to tell. The size of the corpus
is that of all its rows: copies make an entity look rarer, which only raises a disclosure below 1. A term whose disclosure
reaches ``generalise`` is replaced by its class wherever it occurs, from ``remove`` on it is taken out.
The spans of the patterns always stay.

Nothing is capped: entity-term pairs are grouped rows (a mention has at most ``2 * reach`` of them), term
frequencies are counted only for words that a bitmap of fixed size lets through, and the occurrences of
disclosing terms are joined by the exact term.

Defined cases: a missing text is empty; rows with equal id and text are one document; a text without
matches can still hold disclosing terms; without entities there are no terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shelter import sheltered
from lotwise.llm.substrings import LAST, Bitmap, bitmap
from lotwise.llm.text import keep_columns, text_hash
from lotwise.session import via_table

KINDS = ("email", "ip", "card", "phone", "term")
FILTER_BITS = 24
Z = 1.645  # one-sided 95 %
SPANS = "array<struct<kind:string,start:int,end:int>>"
CLEANED = f"struct<base:{SPANS},terms:array<struct<term:string,start:int,end:int,disclosure:double>>,text:string>"

# Equal to the stated patterns, in a form without repeated scans: an address is found from its "@" on, and
# a number only where a run of digits begins. Matches are checked afterwards and not tried again.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\w+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def matches(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` by kind, then start; the value is the entity behind the spelling."""
    out = []
    if "@" in text:
        out += [("email", a, b, text[a:b].lower()) for a, b in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end(), ".".join(parts)))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 8 <= len(digits) <= 15:
                out.append(("phone", m.start(), m.end(), digits))
    return out


def _free(tokens: list[re.Match], spans: list[tuple[int, int]]) -> list[re.Match]:
    """Tokens that touch none of the sorted spans."""
    if not spans:
        return tokens
    starts, ends = np.array(spans).T
    reach = np.maximum.accumulate(ends)
    at = np.searchsorted(starts, [m.end() for m in tokens]) - 1
    return [m for m, i in zip(tokens, at.tolist()) if i < 0 or reach[i] <= m.start()]


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode())


def surroundings(text: str, reach: int) -> Iterator[tuple[str, int, list[str]]]:
    """``(entity, hash of the surroundings, different terms)`` of every match."""
    found = matches(text)
    if not found:
        return
    tokens = _free(list(_TOKEN.finditer(text)), sorted((a, b) for _, a, b, _ in found))
    starts = [m.start() for m in tokens]
    for kind, start, _, value in found:
        at = int(np.searchsorted(starts, start)) if starts else 0
        near = [m.group().lower() for m in tokens[max(0, at - reach) : at + reach]]
        terms = sorted({t for t in near if len(t) > 2 and not t.isdigit()})
        yield f"{kind}:{value}", term_hash(" ".join(near)), terms


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _texts(column: pa.Array) -> Iterator[str]:
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).fill_null("").to_pylist()


def _pairs(reach: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(e, c, t) for text in _texts(batch.column(0)) for e, c, ts in surroundings(text, reach) for t in ts}
            entity, place, term = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "entity": pa.array(entity, pa.string()),
                    "place": pa.array([_signed(c) for c in place], pa.int64()),
                    "term": pa.array(term, pa.string()),
                }
            )

    return emit


def _known(tokens: list[str], filter_: Bitmap) -> np.ndarray:
    """Which tokens the bitmap lets through."""
    return filter_.has(np.fromiter(map(term_hash, tokens), np.uint64, len(tokens)))


def _frequencies(shared, copied):
    """Texts with a term, summed; those of a text that may have copies elsewhere are rows with its hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, int | None], int] = {}
            hashes = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64)
            again, done = copied.value.has(hashes.view(np.uint64)).tolist(), set()
            for text, k, repeats in zip(_texts(batch.column("t")), hashes.tolist(), again):
                if repeats and k in done:
                    continue
                done.add(k)
                tokens = list(set(_TOKEN.findall(text.lower())))
                for i in np.flatnonzero(_known(tokens, shared.value)).tolist():
                    key = tokens[i], k if repeats else None
                    total[key] = total.get(key, 0) + 1
            term, k = zip(*total) if total else ((), ())
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array(term, pa.string()),
                    "k": pa.array(k, pa.int64()),
                    "n": pa.array(list(total.values()), pa.int64()),
                }
            )

    return emit


def _occurrences(shared):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(_texts(batch.column("t"))):
                tokens = list(_TOKEN.finditer(text))
                words = [m.group().lower() for m in tokens]
                known = np.flatnonzero(_known(words, shared.value)).tolist()
                if known:
                    spans = sorted((a, b) for _, a, b, _ in matches(text))
                    rows += [(i, m.group().lower(), m.start(), m.end()) for m in _free([tokens[j] for j in known], spans)]
            at, term, start, end = zip(*rows) if rows else ((), (), (), ())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "o": batch.column("o").take(take),
                    "k": batch.column("k").take(take),
                    "term": pa.array(term, pa.string()),
                    "start": pa.array(start, pa.int32()),
                    "end": pa.array(end, pa.int32()),
                }
            )

    return emit


def likely(both: Column, n: Column, support: int) -> Column:
    """``both / n``, or its lower confidence bound where ``both`` is below ``support``."""
    p, z2 = both / n, Z * Z
    bound = (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(both >= support, p).otherwise(bound)


def disclosures(
    docs: DataFrame, text: Column, reach: int = 10, support: int = 3, threshold: float = 0.8
) -> DataFrame:
    """``term, disclosure`` of the terms that reach the threshold for some entity."""
    context = docs.sparkSession.sparkContext
    body = docs.select(text.cast("string").alias("t"), text_hash(text.cast("string")).alias("k"))
    pairs = via_table(
        body.select("t").mapInArrow(_pairs(reach), "entity string, place bigint, term string").distinct(), "surroundings"
    )
    counted = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    candidates = via_table(counted, "candidates")
    if candidates.isEmpty():
        return candidates.select("term", F.lit(0.0).alias("disclosure"))
    hashed = candidates.select("term").distinct().select(_term_hash_column(F.col("term")).alias("h"))
    shared = context.broadcast(bitmap(hashed, "h", FILTER_BITS))
    copies = body.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = context.broadcast(bitmap(copies, "k", FILTER_BITS))
    frequency = (
        body.mapInArrow(_frequencies(shared, copied), "term string, k bigint, n bigint")
        .groupBy("term", "k")
        .agg(F.sum("n").alias("n"))
        .groupBy("term")
        .agg(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(1)).alias("n"))
    )
    entities = pairs.groupBy("entity").agg(F.count_distinct("place").alias("mentions"))
    size = docs.count()
    information = F.log(F.lit(float(max(size, 2))) / F.col("mentions"))
    # Surroundings can outnumber documents when an entity is mentioned often in one.
    given = likely(F.col("both"), F.greatest("n", "both"), support)
    scored = (
        candidates.join(entities, "entity")
        .join(frequency, "term")
        .where(information > 0)
        .groupBy("term")
        .agg(F.max(1 + F.log(given) / information).alias("disclosure"))
    )
    return via_table(scored.where(F.col("disclosure") >= threshold), "disclosures")


def _term_hash_column(term: Column) -> Column:
    @F.arrow_udf("bigint")
    def of(terms: pa.Array) -> pa.Array:
        return pa.array([_signed(term_hash(t)) for t in terms.to_pylist()], pa.int64())

    return of(term)


def term_spans(docs: DataFrame, text: Column, doc_id: Column, terms: DataFrame) -> DataFrame:
    """``o, k, terms``: where disclosing terms occur, by document."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(bitmap(terms.select(_term_hash_column(F.col("term")).alias("h")), "h", FILTER_BITS))
    body = text.cast("string")
    source = docs.select(body.alias("t"), F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("o"), text_hash(body).alias("k"))
    return (
        source.mapInArrow(_occurrences(shared), "o bigint, k bigint, term string, start int, end int")
        .distinct()
        .join(terms, "term")
        .groupBy("o", "k")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", "disclosure"))).alias("terms"))
    )


def general(term: str) -> str:
    """The class that stands for a term."""
    return "[NUMBER]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[WORD]"


@sheltered
def protect(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    reach: int = 10,
    support: int = 3,
    generalise: float = 0.8,
    remove: float = 0.95,
    out: str = "private",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``base`` spans (kind, start, end), ``terms`` with their disclosure, and
    the ``text`` in which base spans are replaced by their kind and terms generalised or removed."""
    if not 0 < generalise <= remove:
        raise ValueError("generalise must be positive and not above remove")
    body, number = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    terms = disclosures(docs, body, reach, support, generalise)
    kept = keep_columns(docs, out)
    kind = "array<struct<start:int,end:int,term:string,disclosure:double>>"
    if terms.isEmpty():
        frame = docs.select(*kept, F.lit(None).cast(kind).alias("_terms"))
    else:
        found = term_spans(docs, body, number, terms).select(
            F.col("o").alias("_t_o"), F.col("k").alias("_t_k"), F.col("terms").alias("_terms")
        )
        frame = docs.select(
            *kept, F.coalesce(number.cast("long"), F.lit(LAST)).alias("_own_o"), text_hash(body).alias("_own_k")
        ).join(found, (F.col("_own_o") == F.col("_t_o")) & (F.col("_own_k") == F.col("_t_k")), "left")

    @F.arrow_udf(CLEANED)
    def clean(texts: pa.Array, given: pa.Array) -> pa.Array:
        base, listed, left = [], [], []
        for i, t in enumerate(_texts(texts)):
            found = matches(t)
            more = given[i].as_py() or []
            base.append([{"kind": n, "start": a, "end": b} for n, a, b, _ in found])
            listed.append([{"term": x["term"], "start": x["start"], "end": x["end"], "disclosure": x["disclosure"]} for x in more])
            if not texts[i].is_valid:
                left.append(None)
                continue
            if not found and not more:
                left.append(t)
                continue
            changes = [(a, b, f"[{n.upper()}]") for n, a, b, _ in found]
            changes += [
                (x["start"], x["end"], "" if x["disclosure"] >= remove else general(t[x["start"] : x["end"]])) for x in more
            ]
            pieces, at = [], 0
            for a, b, new in sorted(changes):
                if a >= at:
                    pieces += [t[at:a], new]
                at = max(at, b)
            left.append("".join([*pieces, t[at:]]))
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        term = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())])
        return pa.StructArray.from_arrays(
            [pa.array(base, pa.list_(span)), pa.array(listed, pa.list_(term)), pa.array(left, pa.string())],
            names=["base", "terms", "text"],
        )

    return frame.select(*kept, clean.asNondeterministic()(body, F.col("_terms")).alias(out))


def span_text(spans: Column, kind: Column | None = None) -> Column:
    """``kind:start:end``, comma-joined in the order of the spans."""
    return F.concat_ws(
        ",",
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"].cast("string"), s["end"].cast("string")),
        ),
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
