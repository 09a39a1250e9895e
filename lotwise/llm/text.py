"""Words, lines and their hashes, computed over whole Arrow columns.

A *word* is a maximal run of characters other than space and U+0009..U+000D. The helpers work on the
UTF-8 bytes of many documents at once; a separator is one byte, so bytes and characters agree on words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separators, and odd multipliers of the polynomial hashes.
SEPARATORS = b" \t\n\v\f\r"
FIRST, SECOND, THIRD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SEPARATOR = np.isin(np.arange(256), list(SEPARATORS))
_BLOCK = 1 << 20
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def word_count(text: Column) -> Column:
    """Number of words; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def training_part(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents that may be learnt from; a missing id is never one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != 0, F.lit(False))


def keep_columns(docs: DataFrame, out: str) -> list[Column]:
    """All columns but ``out``, which a result replaces."""
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]


def slices(column: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows, cut so that the bytes stay bounded.

    A missing text counts as empty. Only a document that is larger by itself exceeds the bound.
    """
    binary = column.fill_null("").cast(pa.large_binary())
    if len(binary) == 0:
        return
    sizes = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = binary.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < len(binary):
        last = int(np.searchsorted(sizes, sizes[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(binary))
        yield first, data[sizes[first] : sizes[last]], sizes[first : last + 1] - sizes[first]
        first = last


def powers(multiplier: int, n: int, inverse: bool = False) -> np.ndarray:
    """``multiplier ** i`` modulo 2^64 (or of its inverse), kept between calls."""
    have = _POWERS.get((multiplier, inverse))
    if have is None or len(have) < n:
        base = pow(multiplier, -1, 1 << 64) if inverse else multiplier
        steps = np.full(max(n, _BLOCK), base, np.uint64)
        steps[0] = 1
        have = _POWERS[multiplier, inverse] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of consecutive documents: byte spans, and the first word of each document.

    ``bounds[d] .. bounds[d + 1]`` are the words of document ``d``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        word = np.append(~_IS_SEPARATOR[data], False)
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        cut = offsets[offsets < len(data)]
        before[cut] = False
        begins = word & before
        np.logical_xor(begins, word, out=begins)
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[cut[cut > 0] - 1] = False
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        first = 0
        while first < len(out):
            origin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, origin + _BLOCK, side="right")))
            starts, ends = self.starts[first:last] - origin, self.ends[first:last] - origin
            size = int(ends[-1])
            terms = np.zeros(size + 1, np.uint64)
            terms[:size] = self.data[origin : origin + size]
            terms[:size] += np.uint64(1)
            terms[:size] *= powers(THIRD, size)
            edges = np.empty(2 * len(starts), np.int64)
            edges[0::2], edges[1::2] = starts, ends
            total = np.add.reduceat(terms, edges)[0::2] * powers(THIRD, size, inverse=True)[starts]
            out[first:last] = mixed(total + (ends - starts).astype(np.uint64) * np.uint64(FIRST))
            first = last
        return out


def rolling(hashes: np.ndarray, length: int, multiplier: int = FIRST) -> np.ndarray:
    """The hash of every ``length`` consecutive entries, by prefix sums of a polynomial modulo 2^64.

    Windows that cross two documents are in it too; the caller leaves them out.
    """
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    out = np.empty(n - length + 1, np.uint64)
    step = max(_BLOCK - length, length)
    for first in range(0, len(out), step):
        part = hashes[first : first + step + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(multiplier, len(part), inverse=True), out=sums[1:])
        count = len(part) - length + 1
        out[first : first + count] = (sums[length:] - sums[:-length]) * powers(multiplier, len(part))[length - 1 :]
    return mixed(out)
