import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm_simhash import classes

from lotwise.llm import jaccard
from lotwise.llm.jaccard import jaccard_classes, suffix_bound


def plain_set(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))


def plain_classes(rows, percent=90, shingle=3):
    """``doc_id, n_shingles, component_id`` by comparing all pairs."""
    sets = {plain_set(t, shingle) for _, t in rows} - {frozenset()}
    roots = classes(range(len(sets)), lambda a, b: 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])) if (own := list(sets)) else {}
    root = {s: roots[i] for i, s in enumerate(own)}
    least = {}
    for doc, text in rows:
        if doc is not None and (s := plain_set(text, shingle)):
            least[root[s]] = min(least.get(root[s], doc), doc)
    return sorted(
        repr((doc, len(s := plain_set(text, shingle)), least.get(root[s]) if s else doc)) for doc, text in rows
    )


def found(frame, **options):
    return sorted(repr(tuple(r)) for r in jaccard_classes(frame, **options).collect())


def edited(rng, words, edits):
    out = list(words)
    for i in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_documents(spark, sf, hard, none):
    for frame in (spark.read.parquet(f"{sf}/documents.parquet"), hard):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        assert found(frame) == plain_classes(rows)
    assert found(none) == []
    assert jaccard_classes(none).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("percent,shingle", [(90, 3), (80, 5), (55, 2), (100, 3)])
def test_thresholds(spark, percent, shingle):
    """Chains of edited copies around the threshold, of several lengths."""
    rng = random.Random(percent)
    texts = []
    for size in (8, 14, 40, 160):
        for _ in range(6):
            words = [f"w{rng.randrange(4000)}" for _ in range(size)]
            texts += [edited(rng, words, rng.randrange(0, 1 + size // 12)) for _ in range(8)]
    texts += [t + " x" for t in texts[::5]] + texts[::7]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(frame, percent=percent, shingle=shingle) == plain_classes(rows, percent, shingle)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_crowds(spark, monkeypatch, rounds):
    """A crowd of copies with edits, another close by, and texts put together from shared passages."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    rng = random.Random(rounds)
    base = [f"w{i}" for i in range(120)]
    near = base[:108] + [f"v{i}" for i in range(12)]
    texts = [edited(rng, base, rng.randrange(4)) for _ in range(60)] + [edited(rng, near, rng.randrange(4)) for _ in range(40)]
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(6)]
    texts += [" ".join(p) for p in itertools.combinations(passages, 3)] * 2
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links = jaccard.jaccard_links

    def with_rounds(*args):
        return links(*args, rounds=rounds)

    monkeypatch.setattr(jaccard, "jaccard_links", with_rounds)
    assert found(frame) == plain_classes(rows)


def test_pairs_of_a_crowd_follow_its_members(spark, monkeypatch):
    """Copies of one text are verified against a leader, not against each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))] + [(i, edited(rng, base, 2)) for i in range(1, 300)]
    seen = []
    verified = jaccard._verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_classes(frame).agg(F.max("component_id"), F.count("*")).first() == (0, 300)
    assert sum(seen) < 4 * len(rows)


def test_any_columns(spark):
    frame = spark.createDataFrame([("b", "one two three", 1), ("a", "ONE two  three", 2), (None, None, 3)], "`my id` string, body string, n int")
    got = {tuple(r) for r in jaccard_classes(frame, text="body", doc_id="my id").collect()}
    assert got == {("b", 1, "a"), ("a", 1, "a"), (None, 0, None)}


def test_suffix_bound_never_below_the_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)) for n in rng.integers(1, 80, 2))
        b = np.unique(np.concatenate([b, a[::2]]))
        assert suffix_bound(a, b) >= len(np.intersect1d(a, b))
        odd = [jaccard._parities(x) for x in (a, b)]
        assert sum(int(x).bit_count() for x in (odd[0] ^ odd[1]).view(np.uint64)) <= len(np.setxor1d(a, b))
