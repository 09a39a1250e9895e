import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.llm.lines import cut_lines, deduplicate_lines, remove_repeated_lines
from lotwise.llm.substrings import Bitmap, bitmap, remove_repeats
from lotwise.llm.text import Words, rolling, slices

LAST = (1 << 63) - 1


def removed(rows, window):
    """Words in windows that also start in a document with a smaller id, by the definition."""
    words = [(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode().split()) for r in rows]
    least = {}
    for o, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, o), o)
    out = []
    for o, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < o:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def both(frame, window, **options):
    rows = remove_repeats(frame, window=window, **options).collect()
    got = [(r.unique.n_words, sum(s.end - s.start for s in r.unique.spans), r.unique.kept) for r in rows]
    assert got == removed(rows, window)
    return got


def test_words_of_a_batch():
    texts = ["a  bb\tccc", "", None, "dé f", " x ", "tail", "\n", "end"]
    for most in (1, 4, 1 << 20):
        found = []
        for first, data, offsets in slices(pa.array(texts), most):
            w = Words(data, offsets)
            assert len(w.hashes()) == len(w.starts) == len(w.ends) == w.bounds[-1]
            for d in range(len(offsets) - 1):
                own = range(w.bounds[d], w.bounds[d + 1])
                found.append([bytes(data[w.starts[i] : w.ends[i]]) for i in own])
        assert found == [(t or "").encode().split() for t in texts]


def test_rolling_hash_is_by_content():
    x = np.arange(4000, dtype=np.uint64) % np.uint64(7)
    r = rolling(x, 50)
    assert len(r) == 3951 and len(set(r.tolist())) == 7 and (r[:-7] == r[7:]).all()


def test_bitmap(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    b = bitmap(hashes, "h", 20)
    own = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    assert isinstance(b, Bitmap) and b.has(own).all()
    other = np.random.default_rng(0).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert b.has(other).mean() < 0.02


def test_repeated_passages(hard):
    got = both(hard, 50)
    assert any(g[1] for g in got)
    assert remove_repeats(hard, out="score").columns.count("score") == 1


def test_small_windows_and_full_filters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    for window, bits in ((2, 15), (7, 28), (50, 15)):
        assert any(g[1] for g in both(docs, window, filter_bits=bits))


def test_repeats_of_nothing(none):
    assert remove_repeats(none).count() == 0
    assert remove_repeated_lines(none).count() == 0


def cut(rows, run):
    """Lines in runs that stood earlier, by the definition."""
    def key(r):
        return (LAST if r.doc_id is None else r.doc_id, r.h)

    lines = {}
    for r in rows:
        own = [(n, y) for n, x in enumerate((r.text or "").encode().split(b"\n")) if (y := x.strip(b" \t\n\v\f\r"))]
        lines[key(r)] = (r.text, own)
    first = {}
    for k in sorted(lines):
        own = [y for _, y in lines[k][1]]
        for i in range(len(own) - run + 1):
            first.setdefault(tuple(own[i : i + run]), (k, i))
    out = {}
    for k, (text, own) in lines.items():
        gone = set()
        for i in range(len(own) - run + 1):
            if first[tuple(y for _, y in own[i : i + run])] != (k, i):
                gone.update(n for n, _ in own[i : i + run])
        kept = None if text is None else b"\n".join(x for n, x in enumerate(text.encode().split(b"\n")) if n not in gone).decode()
        out[k] = (len(own), len(gone), kept)
    return [out[key(r)] for r in rows]


def same_lines(frame, run, **options):
    frame = frame.withColumn("h", F.xxhash64("text"))
    rows = remove_repeated_lines(frame, run=run, **options).collect()
    got = [(r.lines.n_lines, sum(s.end - s.start for s in r.lines.spans), r.lines.kept) for r in rows]
    assert got == cut(rows, run)
    return got


def test_repeated_lines(hard, spark, sf):
    assert any(g[1] for g in same_lines(hard, 3))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for run, bits in ((1, 26), (2, 15), (3, 26)):
        assert any(g[1] for g in same_lines(docs, run, filter_bits=bits))


def cut_content(rows, run, words, common_words, often):
    """Lines in windows that stood earlier, where short windows need words and single lines may be common."""
    def key(r):
        return (LAST if r.doc_id is None else r.doc_id, r.h)

    def own(text):
        lines = enumerate((text or "").encode().split(b"\n"))
        return [(n, y) for n, x in lines if (y := x.strip(b" \t\n\v\f\r"))]

    rows_with = Counter(y for r in rows for y in {y for _, y in own(r.text)})
    lines = {key(r): (r.text, own(r.text)) for r in rows}

    def windows(k):
        found = lines[k][1]
        for size in range(1, run + 1):
            for i in range(len(found) - size + 1):
                body = tuple(y for _, y in found[i : i + size])
                n = sum(len(y.split()) for y in body)
                if size == run or n >= words or (size == 1 and n >= common_words and rows_with[body[0]] >= often):
                    yield i, body

    first, out = {}, {}
    for k in sorted(lines):
        for i, body in windows(k):
            first.setdefault(body, (k, i))
    for k, (text, found) in lines.items():
        gone = {n for i, body in windows(k) if first[body] != (k, i) for n, _ in found[i : i + len(body)]}
        kept = None if text is None else b"\n".join(x for n, x in enumerate(text.encode().split(b"\n")) if n not in gone).decode()
        out[k] = (len(found), len(gone), kept)
    return [out[key(r)] for r in rows]


def same_content(frame, run, words, common_words, often, **options):
    frame = frame.withColumn("h", F.xxhash64("text"))
    rows = remove_repeated_lines(frame, run=run, words=words, common_words=common_words, often=often, **options).collect()
    got = [(r.lines.n_lines, sum(s.end - s.start for s in r.lines.spans), r.lines.kept) for r in rows]
    assert got == cut_content(rows, run, words, common_words, often)
    return sum(g[1] for g in got)


def test_runs_by_content(hard, spark, sf):
    assert same_content(hard, 3, 50, 2, 2) > sum(g[1] for g in same_lines(hard, 3))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for run, words, common_words, often, bits in ((3, 50, 5, 5, 26), (3, 20, 3, 4, 15), (2, 30, 4, 6, 26), (1, 50, 5, 2, 26)):
        assert same_content(docs, run, words, common_words, often, filter_bits=bits)


def test_long_line_and_boilerplate_are_found(spark):
    passage, notice = " ".join(f"p{i}" for i in range(60)), "all rights reserved by the owners"
    rows = [(i, f"head {i}\n{notice}\nown {i}") for i in range(100)] + [(200, passage), (201, passage), (202, f"x\n{passage}\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert not sum(len(r.lines.spans) for r in remove_repeated_lines(docs).collect())
    cut = remove_repeated_lines(docs, words=50, common_words=5, often=100).collect()
    kept = {r.doc_id: r.lines.kept for r in cut}
    assert sum(notice in t for t in kept.values()) == 1 and notice in kept[0]
    assert (kept[200], kept[201], kept[202]) == (passage, "", "x\ny")


def test_line_stage_keeps_columns(hard):
    out = deduplicate_lines(hard)
    assert out.columns == hard.columns and out.count() == hard.count()
    assert out.where("doc_id = 90").first().text is None


def test_cut_lines_keeps_other_lines_as_they_are():
    n, spans, rest = cut_lines(b" a \n\nb\r\nc\n d", np.array([1]), 2)
    assert (n, spans, rest) == (4, [(2, 4)], b" a \n\n d")


def test_hash_is_of_the_kept_words(hard):
    r = remove_repeats(hard).where("doc_id = 3").first()
    assert hashlib.sha256(r.unique.kept.encode()).hexdigest() == hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()
