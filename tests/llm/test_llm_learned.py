import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotwise.llm.language import UNKNOWN, fit_languages, grams, identify
from lotwise.llm.text import training_part
from lotwise.llm.toxicity import ToxicityModel, drop_toxic, fit_toxicity, judge_toxicity


def plain_cost(trees, context, byte, share, total):
    """Bits of a byte: the longest context that keeps it, an escape for each longer one that does not."""
    bits, order = 0.0, len(context)
    for k in range(order, -1, -1):
        children = trees[k].get(context[order - k :])
        if not children:
            continue
        need = math.ceil(share * total)
        kept = {b: n for b, n in children.items() if n >= need}
        if not kept:
            continue
        n, d = sum(children.values()), len(children)
        if byte in kept:
            return bits + math.log2((n + d) / kept[byte])
        bits += math.log2((n + d) / (d + n - sum(kept.values())))
    return bits + 8


@pytest.mark.parametrize("order,share", [(0, 1e-9), (2, 1e-9), (3, 0.01)])
def test_code_lengths_by_the_definition(spark, order, share):
    train = [("aa", "banana band anna b"), ("aa", "nab a ban"), ("bb", "zürich übel zz top"), ("bb", "9 übel"), ("und", "x y"), (None, "q r")]
    model = fit_languages(spark.createDataFrame(train, "lang string, text string"), order=order, share=share)
    assert model.languages == ["aa", "bb"]
    for text in ("banana", "übel zoo", "x", "a\nzü"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.code_lengths(data, np.array([0, 0, len(data)]))
        assert not got[0].any()
        for i, lang in enumerate(model.languages):
            trees, total = [defaultdict(Counter) for _ in range(order + 1)], 0
            for of, t in train:
                if of == lang:
                    raw = b"\n" * order + t.encode()
                    total += len(t.encode())
                    for j in range(order, len(raw)):
                        for k in range(order + 1):
                            trees[k][raw[j - k : j]][raw[j]] += 1
            raw = b"\n" * order + text.encode()
            want = sum(plain_cost(trees, raw[j - order : j], raw[j], share, total) for j in range(order, len(raw)))
            assert math.isclose(got[1][i], want, rel_tol=1e-5)


def test_grams_start_anew_in_each_text():
    data = np.frombuffer(b"abcxy", np.uint8)
    got, doc = grams(data, np.array([0, 3, 3, 5]), 2)
    assert [int(g).to_bytes(3) for g in got] == [b"\n\na", b"\nab", b"abc", b"\n\nx", b"\nxy"]
    assert doc.tolist() == [0, 0, 0, 2, 2]


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = training_part(F.col("doc_id"))
    out = identify(docs.where(~learn), fit_languages(docs.where(learn))).collect()
    assert sum(r.lang == r.language.lang for r in out) >= 0.95 * len(out) > 0
    assert all(0 <= r.language.score <= 1 for r in out)


def test_language_of_hard_rows(hard, none):
    model = fit_languages(hard)
    rows = identify(hard, model, out="score").collect()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.score.lang, r.score.score) == (UNKNOWN, 0.0)
        else:
            assert r.score.lang in ("de", "en") and 0.5 <= r.score.score <= 1
    assert {r.language.lang for r in identify(hard, fit_languages(none)).collect()} == {UNKNOWN}
    assert identify(none, model).count() == 0


def plain_segments(values):
    """All maximal scoring segments by recursion on the best one."""
    def go(low, high):
        best = max(((round(sum(values[a:b]), 9), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        return go(low, best[2]) + [(best[2], best[3], best[0])] + go(best[3], high)

    return go(0, len(values))


def test_segments_are_maximal():
    rng = np.random.default_rng(1)
    model = ToxicityModel(gap=0.37)
    for _ in range(300):
        n = int(rng.integers(0, 16))
        odds = {i: float(np.round(rng.uniform(0.4, 3), 3)) for i in range(n) if rng.random() < 0.4}
        values = [odds.get(i, 0.0) - 0.37 for i in range(n)]
        got = [(a, b, round(s, 6)) for a, b, s in model.segments(sorted(odds.items()))]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain_segments(values)]


def test_segments_of_a_long_falling_text_and_ties():
    """Every token starts lower than all before, so each closes the last; equal starts do not join."""
    model = ToxicityModel(gap=0.25)
    hits = [(i, 0.5) for i in range(0, 3_000_000, 10)]
    assert model.segments(hits) == [(i, i + 1, 0.25) for i, _ in hits]
    # The totals return to the same level: neither joining nor splitting gains, the parts stay apart.
    assert model.segments([(0, 0.5), (2, 0.5), (4, 0.75)]) == [(0, 1, 0.25), (2, 3, 0.25), (4, 5, 0.5)]
    assert model.segments([(0, 1.0), (1, 1.0)]) == [(0, 2, 1.5)]


def test_passages_of_repeated_words(spark):
    """A word scores again in a later passage; only the document's evidence counts it once."""
    model = ToxicityModel(words={"bad": 3.0, "vile": 3.0}, rate=3.0, scale=0.01, intercept=-2, slope=1)
    far = " ok" * 200
    docs = spark.createDataFrame([(1, f"bad vile{far} vile bad"), (2, f"bad vile{far} fine fine")], "doc_id long, text string")
    twice, once = (r.toxicity for r in judge_toxicity(docs, model).orderBy("doc_id").collect())
    assert [(p.start, p.end) for p in once.passages] == [(0, 8)]
    assert [(p.start, p.end) for p in twice.passages] == [(0, 8), (609, 617)]
    assert twice.evidence == once.evidence and twice.score == once.score


def toxic_corpus(spark, n=400):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{j}" for j in rng.integers(0, 300, 60)]
        bad = i % 8 == 0
        if bad:
            for j in rng.integers(0, 60, 4):
                words[j] = str(rng.choice(["grumble", "snarlish", "Snarlest", "hatewort"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_held_out_and_passages(spark):
    docs, labels = toxic_corpus(spark)
    learn = training_part(F.col("doc_id"))
    model = fit_toxicity(docs.where(learn), labels)
    rows = judge_toxicity(docs, model).collect()
    for r in rows:
        assert (r.toxicity.score >= 0.5) == (r.doc_id % 8 == 0), r
    some = next(r for r in rows if r.doc_id % 8 == 0)
    for p in some.toxicity.passages:
        inside = some.text[p.start : p.end].lower().split()
        assert inside[0][0] != "w" and inside[-1][0] != "w" and p.expected < model.evalue
    assert {r.doc_id for r in drop_toxic(docs, model).collect()} == {i for i in range(400) if i % 8}
    # The stem of a known word speaks for an unknown one.
    new = spark.createDataFrame([(1, "w1 snarlology w2 grumble"), (2, "w1 w2")], "doc_id long, text string")
    assert [r.toxicity.score >= 0.5 for r in judge_toxicity(new, model).orderBy("doc_id").collect()] == [True, False]


def test_toxicity_of_hard_rows(spark, hard, none):
    docs, labels = toxic_corpus(spark, 80)
    model = fit_toxicity(docs, labels)
    rows = judge_toxicity(hard, model, out="score").collect()
    assert all(0 <= r.score.score < 0.5 and not r.score.passages for r in rows)
    assert judge_toxicity(none, model).count() == 0
    for y, want in ((0, 0.0), (1, 1.0)):
        one = fit_toxicity(docs, labels.where(F.col("toxic") == y))
        assert {r.toxicity.score for r in judge_toxicity(hard, one).collect()} == {want}
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    assert {r.toxicity.score for r in judge_toxicity(hard, fit_toxicity(docs, odd)).collect()} == {0.0}


def test_a_split_by_id_only(spark):
    import zlib

    ids = spark.createDataFrame([(i,) for i in [*range(300), None]], "doc_id long")
    got = {r.doc_id: r.t for r in ids.withColumn("t", training_part(F.col("doc_id"))).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)} | {None: False}


def test_evidence_grows_with_segments():
    model = ToxicityModel(words={"bad": 3.0}, rate=1.5, scale=0.1, intercept=-2, slope=1)
    found = [model.evidence(100, [(0, 1, s)]) for s in (0.5, 2.0, 4.0)]
    assert found == sorted(found) and model.evidence(100, []) == 0
    assert all(a < b for a, b in itertools.pairwise(map(model.score, found)))
    assert pa.array([model.score(1e9)])[0].as_py() == 1.0
