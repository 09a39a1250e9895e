"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole, by a byte-level vocabulary. The byte lengths of its tokens add up
to the text, so every token has an exact span of characters (a token that is part of a character stands
for that character). The sorted token spans are joined with the section spans, and a token that crosses a
boundary goes by an explicit rule:

* ``first``: to the section of its first character;
* ``last``: to the section of its last character;
* ``largest``: to the section that holds most of its characters, on ties the first such section;
* ``share``: to each section in proportion to its characters of the token.

Defined cases: a missing text has no tokens and no sections; a section that is empty, missing or beyond
the text counts 0; tokens outside all sections are counted as outside; where sections overlap, each counts
its tokens (``largest`` excepted, which picks one). White space of any length is encoded as the pattern cuts it, though
the pattern itself cannot be matched against runs of about a million characters: long runs are cut out beforehand.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shelter import sheltered
from lotwise.llm.text import keep_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The white space of that pattern, in runs that are cut out beforehand.
LONG_BLANK = re.compile("[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
RULES = ("first", "last", "largest", "share")
SECTION = "array<struct<name:string,start:int,end:int>>"
COUNTED = (
    "struct<n_tokens:bigint,n_outside:double,n_crossing:bigint,"
    "sections:array<struct<name:string,start:int,end:int,tokens:double>>>"
)


@lru_cache(maxsize=4)
def _encoder(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the byte length of each token, built once per worker."""
    pairs = [line.split() for line in ranks.splitlines() if line]
    tokens = {base64.b64decode(a): int(b) for a, b in pairs}
    sizes = np.zeros(max(tokens.values()) + 1, np.int64)
    for token, i in tokens.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=tokens, special_tokens={}), sizes


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Parts that are encoded one by one, and whether a part is a single piece of the pattern: of a run of white space
    all but the character before a following text, which may belong to that."""
    at = 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def encoded(text: str, encoder: tiktoken.Encoding) -> list[int]:
    """The tokens of a text. The pattern of :data:`PATTERN` overflows its stack on very long white space."""
    if encoder._pat_str != PATTERN or not LONG_BLANK.search(text):
        return encoder.encode_ordinary(text)
    out: list[int] = []
    for part, whole in _pieces(text):
        out += encoder._encode_single_piece(part.encode()) if whole else encoder.encode_ordinary(part)
    return out


def token_spans(text: str, encoder: tiktoken.Encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token."""
    ids = np.asarray(encoded(text, encoder), np.int64)
    ends = np.cumsum(sizes[ids])
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return ends - sizes[ids], ends - 1
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[ends - sizes[ids]], character[ends - 1]


def attributed(
    first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, float, int]:
    """Tokens per section, tokens outside all sections, and tokens that cross a section's boundary."""
    counts = np.zeros(len(starts))
    if not len(first):
        return counts, 0.0, 0
    edges = np.unique(np.concatenate([starts, ends])) if len(starts) else np.empty(0, np.int64)
    crossing = np.searchsorted(edges, last, side="right") > np.searchsorted(edges, first, side="right")
    length = int(last[-1]) + 1
    covered = np.zeros(length + 1, np.int64)
    valid = starts < ends
    np.add.at(covered, starts[valid], 1)
    np.add.at(covered, ends[valid], -1)
    inside = np.cumsum(covered)[:-1] > 0
    if rule in ("first", "last"):
        at = first if rule == "first" else last
        counts[valid] = np.searchsorted(at, ends[valid]) - np.searchsorted(at, starts[valid])
        return counts, float((~inside[at]).sum()), int(crossing.sum())
    if rule == "share":
        sizes = last - first + 1
        steps = np.zeros(length + 1)
        np.add.at(steps, first, 1 / sizes)
        np.add.at(steps, last + 1, -1 / sizes)
        weights = np.cumsum(steps)[:-1]
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        counts[valid] = sums[ends[valid]] - sums[starts[valid]]
        return counts, float(weights[~inside].sum()), int(crossing.sum())
    whole = ~crossing
    own = first[whole]
    order = np.flatnonzero(valid)
    order = order[np.lexsort((order, starts[order]))]
    # Tokens of one section: the first section in order that holds them.
    outside = 0.0
    owner = np.full(length, -1)
    for s in order[::-1]:
        owner[starts[s] : ends[s]] = s
    held = owner[own]
    counts += np.bincount(held[held >= 0], minlength=len(counts))
    outside += float((held < 0).sum())
    for a, b in zip(first[crossing].tolist(), last[crossing].tolist()):
        meets = order[(starts[order] <= b) & (ends[order] > a)]
        overlap = np.minimum(ends[meets], b + 1) - np.maximum(starts[meets], a)
        if len(meets):
            counts[meets[np.argmax(overlap)]] += 1
        else:
            outside += 1
    return counts, outside, int(crossing.sum())


def join_fields(fields: Sequence[str], separator: str = "\n") -> tuple[Column, Column]:
    """The text of several fields in a row, and one section per field (a separator is outside)."""
    parts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    sections, at = [], F.lit(0)
    for name, part in zip(fields, parts):
        end = at + F.length(part)
        sections.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(separator)
    return F.concat_ws(separator, *parts), F.array(*sections)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One section per line, its line feed included: together they are the text."""
    sizes = np.array([len(x) for x in text.split("\n")], np.int64) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ends[-1] -= 1
    return starts, ends


@sheltered
def attribute_tokens(
    docs: DataFrame,
    text: Column,
    sections: Column | None = None,
    rule: str = "first",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    out: str = "tokens",
) -> DataFrame:
    """``docs`` with a struct ``out``: token counts of the text and of each section.

    ``sections`` holds ``name, start, end`` (characters, end exclusive); without it every line is one.
    The vocabulary is read on the driver and broadcast (its size is that of the file).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    given = F.lit(None).cast(SECTION) if sections is None else sections.cast(SECTION)
    by_line = sections is None
    kept = keep_columns(docs, out)

    def count(t: str | None, spans: pa.Scalar, encoder: tiktoken.Encoding, sizes: np.ndarray) -> tuple:
        first, last = token_spans(t or "", encoder, sizes)
        names: list[str | None] = []
        if t is None:
            starts = ends = np.empty(0, np.int64)
        elif by_line:
            starts, ends = line_sections(t)
            names = [str(i) for i in range(len(starts))]
        else:
            rows = [x for x in spans.as_py() or [] if x is not None]
            names = [x["name"] for x in rows]
            starts, ends = (np.array([x[n] or 0 for x in rows], np.int64) for n in ("start", "end"))
            starts, ends = np.clip(starts, 0, len(t)), np.clip(ends, 0, len(t))
        tokens, outside, crossing = attributed(first, last, starts, ends, rule)
        return len(first), outside, crossing, names, starts, ends, tokens

    @F.arrow_udf(COUNTED)
    def attribute(texts: pa.Array, spans: pa.Array) -> pa.Array:
        encoder, sizes = _encoder(shared.value, pattern)
        rows = []
        for i in range(0, len(texts), 256):
            for j, t in enumerate(texts.slice(i, 256).to_pylist()):
                rows.append(count(t, spans[i + j], encoder, sizes))
        offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)

        def flat(k: int, kind: type) -> np.ndarray:
            return np.concatenate([np.asarray(r[k], kind) for r in rows]) if rows else np.empty(0, kind)

        items = pa.StructArray.from_arrays(
            [
                pa.array([n for r in rows for n in r[3]], pa.string()),
                pa.array(flat(4, np.int32)),
                pa.array(flat(5, np.int32)),
                pa.array(flat(6, np.float64)),
            ],
            names=["name", "start", "end", "tokens"],
        )
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), items),
            ],
            names=["n_tokens", "n_outside", "n_crossing", "sections"],
        )

    return docs.select(*kept, attribute.asNondeterministic()(text.cast("string"), given).alias(out))
