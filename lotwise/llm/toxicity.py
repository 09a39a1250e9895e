"""Toxic passages as maximal scoring segments over token log-odds.

Training counts in how many toxic and clean training documents each token stands. Its log-odds use a
Dirichlet prior in proportion to the token's overall frequency. A token scores the lower end of its
log-odds, ``z`` standard errors down; those that still score more than ``gap`` form the lexicon. Longer words
also count under their first ``stem`` letters, so an unseen compound of a known stem still scores.

Lexicon tokens add their log-odds, every token costs ``gap``, and a linear-time scan keeps all maximal
segments. Passages come from the scan over every occurrence; the evidence of a document comes from the same
scan with each token scoring only where it stands first, since training counts documents, not repeats. Under the clean background a segment of score ``s`` in ``n`` tokens turns
up ``K n exp(-lambda s)`` times (extreme-value statistics): lambda solves the background equation, ``K`` is
the maximum-likelihood value over the clean training documents. Segments expected less than ``evalue``
times are passages. The evidence of a document is ``log(1 + x)`` for the sum ``x`` of ``-log P`` over its
segments, and a logistic curve over it gives the score.

What is broadcast is bounded by ``max_terms`` lexicon entries.

Defined cases: a missing or empty text has evidence 0 like any text without a passage; with one class or
none to learn from, every score is the share of toxic training documents (0 without any); a document
labelled twice is toxic if one label says so; labels other than 0 and 1 are ignored; repeated rows of the
training documents count each time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shelter import sheltered
from lotwise.llm.text import keep_columns
from lotwise.session import via_table

MAX_TERMS = 50_000
MAX_BROADCAST_LABELS = 2_000_000
BINS, BIN = 1000, 0.01
_TOKEN = re.compile(r"\w+")

JUDGED = (
    "struct<score:double,evidence:double,"
    "passages:array<struct<start:int,end:int,score:double,expected:double>>>"
)


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    stem: int = 5
    gap: float = 0.2
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    evalue: float = 0.05
    intercept: float = -math.inf
    slope: float = 0.0

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]], list[tuple[int, float]]]:
        """Number of tokens, place and log-odds of all that score, and those of them that stand there first."""
        word, part, n = self.words.get, self.stems.get, self.stem
        tokens = _TOKEN.findall(text.lower())
        found = [(i, s) for i, w in enumerate(tokens) if (s := word(w) or part(w[:n]))]
        seen = {tokens[i]: i for i, _ in reversed(found)}
        return len(tokens), found, [hit for hit in found if seen[tokens[hit[0]]] == hit[0]]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]], list[tuple[int, int, float]]]:
        """Number of tokens, the segments over all of them, and those over first occurrences only."""
        n, found, first = self.hits(text)
        everywhere = self.segments(found)
        return n, everywhere, everywhere if len(first) == len(found) else self.segments(first)

    def segments(self, hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments ``(first token, end, score)`` in one pass of linear time.

        Open candidates hold the total before and after them, their tokens, and the number of the last
        candidate that starts lower. A new scoring token joins back to the last candidate that starts lower
        and is not yet passed; where none starts lower, no later token can join any of them: they are done.
        """
        done: list[tuple[float, float, int, int, int]] = []
        stack: list[tuple[float, float, int, int, int]] = []
        total, at = 0.0, 0
        for place, odds in hits:
            before = total - self.gap * (place - at)
            total, at = before + odds - self.gap, place + 1
            if odds <= self.gap:
                continue
            first, below = place, len(stack) - 1
            while True:
                while below >= 0 and stack[below][0] >= before:
                    below = stack[below][4]
                if below < 0:
                    done += stack
                    stack = [(before, total, first, at, -1)]
                    break
                if stack[below][1] >= total:
                    stack.append((before, total, first, at, below))
                    break
                before, first, last = stack[below][0], stack[below][2], stack[below][4]
                del stack[below:]
                below = last
        return [(s[2], s[3], s[1] - s[0]) for s in done + stack]

    def expected(self, score: float, tokens: int) -> float:
        return self.scale * tokens * math.exp(-self.rate * score)

    def evidence(self, tokens: int, segments: list[tuple[int, int, float]]) -> float:
        """``log(1 + x)`` of the sum ``x`` of ``-log P(a segment this good by chance)`` over all segments."""
        return math.log1p(sum(-math.log(-math.expm1(-max(self.expected(s[2], tokens), 1e-300))) for s in segments))

    def score(self, evidence: float) -> float:
        x = self.intercept + self.slope * evidence
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _token_counts(stem: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            labels = batch.column("y").to_pylist()
            for i in range(0, len(labels), 256):
                for t, y in zip(batch.column("t").slice(i, 256).to_pylist(), labels[i : i + 256]):
                    tokens = set(_TOKEN.findall((t or "").lower()))
                    seen[y].update(tokens)
                    seen[y].update({"\n" + w[:stem] for w in tokens if len(w) > stem})
            tokens = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict(
                {
                    "token": pa.array(tokens, pa.string()),
                    "bad": pa.array([seen[1][w] for w in tokens], pa.int64()),
                    "good": pa.array([seen[0][w] for w in tokens], pa.int64()),
                }
            )

    return count


def _lambda(scores: np.ndarray, shares: np.ndarray, gap: float) -> float:
    """The positive root of the background equation ``E exp(lambda * score) = 1``."""
    rest = 1 - shares.sum()

    def excess(x: float) -> float:
        return float((shares * np.exp(x * (scores - gap))).sum() + rest * math.exp(-x * gap) - 1)

    low, high = 0.0, 0.05
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 1.5
    if not excess(0.5 * high if low == 0.0 else low) < 0:
        low = 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """``t, y`` of the documents that have a label. The labels are broadcast only up to a bound."""
    marks = via_table(
        labels.where(F.col(f"`{label}`").isin(0, 1))
        .groupBy(F.col(f"`{doc_id}`").alias("_id"))
        .agg(F.max(F.col(f"`{label}`").cast("int")).alias("y")),
        "labels",
    )
    if marks.count() <= MAX_BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").cast("string").alias("t")).join(
        marks, F.col("_doc") == F.col("_id")
    ).select("t", "y")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    prior: float = 0.1,
    z: float = 2.33,
    gap: float = 0.2,
    stem: int = 5,
    evalue: float = 0.05,
    max_terms: int = MAX_TERMS,
) -> ToxicityModel:
    """Learns from all documents of ``docs`` that have a label."""
    marked = labelled(docs, labels, doc_id, text, label)
    size = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return ToxicityModel(intercept=math.inf if bad else -math.inf)
    counts = via_table(
        marked.mapInArrow(_token_counts(stem), "token string, bad bigint, good bigint")
        .groupBy("token")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")),
        "tokens",
    )
    # Whole words and stems are two vocabularies, each with totals of its own.
    is_stem = F.startswith("token", F.lit("\n"))
    totals = counts.groupBy(is_stem.alias("stem")).agg(F.sum("bad").alias("nb"), F.sum("good").alias("ng"))
    share = F.lit(prior) * (F.col("bad") + F.col("good"))
    mass = F.lit(prior) * (F.col("nb") + F.col("ng"))
    b, g = F.col("bad") + share, F.col("good") + share
    odds = F.log(b / (F.col("nb") + mass - b)) - F.log(g / (F.col("ng") + mass - g))
    terms = (
        counts.join(F.broadcast(totals), is_stem == F.col("stem"))  # two rows
        .select("token", "stem", (odds - F.lit(z) * F.sqrt(1 / b + 1 / g)).alias("low"), (g / (F.col("ng") + mass)).alias("share"))
        .where(F.col("low") > gap)
        .orderBy(F.col("low").desc(), "token")
        .limit(max_terms)
        .collect()
    )
    model = ToxicityModel(stem=stem, gap=gap, evalue=evalue)
    model.words = {r["token"]: r["low"] for r in terms if not r["stem"]}
    model.stems = {r["token"][1:]: r["low"] for r in terms if r["stem"]}
    known = [r for r in terms if not r["stem"]] or terms
    if known:
        scores, shares = (np.array([r[c] for r in known]) for c in ("low", "share"))
        model.rate = _lambda(scores, shares, gap)
    return _calibrated(model, marked, bad, good)


def _calibrated(model: ToxicityModel, marked: DataFrame, bad: int, good: int) -> ToxicityModel:
    """Sets ``K`` from the clean documents and the logistic curve from bounded histograms."""
    shared = marked.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            tokens, best, rest = [], [], []
            for i in range(0, batch.num_rows, 256):
                for t in batch.column("t").slice(i, 256).to_pylist():
                    n, everywhere, first = own.scan(t or "")
                    tokens.append(n)
                    best.append(max((s[2] for s in everywhere), default=0.0))
                    rest.append([s[2] for s in first])
            yield pa.RecordBatch.from_pydict(
                {
                    "y": batch.column("y").cast(pa.int32()),
                    "n": pa.array(tokens, pa.int64()),
                    "best": pa.array(best, pa.float64()),
                    "found": pa.array(rest, pa.list_(pa.float64())),
                }
            )

    scanned = via_table(marked.mapInArrow(scan, "y int, n bigint, best double, found array<double>"), "scanned")
    weight = scanned.where("y = 0").agg(F.sum(F.col("n") * F.exp(F.lit(-model.rate) * F.col("best")))).first()[0]
    model.scale = good / weight if weight else 1.0
    surprise = F.aggregate(
        "found",
        F.lit(0.0),
        lambda a, s: a
        - F.log(-F.expm1(-F.greatest(F.lit(model.scale) * F.col("n") * F.exp(F.lit(-model.rate) * s), F.lit(1e-300)))),
    )
    # At most BINS + 1 rows, whatever the number of documents.
    bins = (
        scanned.select("y", F.least(F.floor(F.log1p(surprise) / BIN), F.lit(BINS)).alias("bin"))
        .groupBy("bin")
        .agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    x = np.array([(r["bin"] + 0.5 * (r["bin"] > 0)) * BIN for r in bins])
    y, n = (np.array([r[c] for r in bins], float) for c in ("bad", "n"))
    beta = np.array([math.log((bad + 0.5) / (good + 0.5)), 0.0])
    design, ridge = np.stack([np.ones_like(x), x], 1), np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (y - n * p) - ridge @ beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    model.intercept, model.slope = float(beta[0]), max(0.0, float(beta[1]))
    return model


@sheltered
def judge_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out``: ``score`` (0 to 1), ``evidence``, and the significant ``passages``
    (characters, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep_columns(docs, out)

    def spans(t: str, found: list[tuple[int, int, float]], n: int) -> list[dict]:
        own = shared.value
        lowered = t.lower()
        # Lower-casing can change the length of a few letters; then tokens are found in the text itself.
        places = [m.span() for m in _TOKEN.finditer(lowered if len(lowered) == len(t) else t)]
        return [
            {"start": places[a][0], "end": places[min(b, len(places)) - 1][1], "score": s, "expected": e}
            for a, b, s in found
            if (e := own.expected(s, n)) < own.evalue and a < len(places)
        ]

    @F.arrow_udf(JUDGED)
    def judge(texts: pa.Array) -> pa.Array:
        own, scores, evidence, passages = shared.value, [], [], []
        for i in range(0, len(texts), 256):
            for t in texts.slice(i, 256).to_pylist():
                n, found, first = own.scan(t or "")
                x = own.evidence(n, first)
                evidence.append(x)
                scores.append(own.score(x))
                passages.append(spans(t, found, n) if found else [])
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(evidence, pa.float64()), pa.array(passages, pa.list_(span))],
            names=["score", "evidence", "passages"],
        )

    return docs.select(*kept, judge.asNondeterministic()(F.col(f"`{text}`").cast("string")).alias(out))


@sheltered
def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    name = "_toxicity"
    judged = judge_toxicity(docs, model, text, name)
    return judged.where(F.col(name)["score"] < threshold).drop(name)
