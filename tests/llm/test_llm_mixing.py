import math
from collections import defaultdict

from pyspark.sql import functions as F

from lotwise.llm.mixing import mix_sources
from lotwise.llm.text import word_count


def targets(sizes, weights=(3, 1, 2), budget=1.5, epochs=2.0):
    """Reshares the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] >= epochs * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = epochs * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def mixed(docs, **options):
    return mix_sources(docs, word_count(F.col("text")), ["doc_id", "text"], **options)


def check(rows, **options):
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    for r in rows:
        n = len((r.text or "").encode().split())
        assert r.mix.size == n
        sizes[r.source] += n
        taken[r.source] += r.mix.taken
        assert 0 <= r.mix.taken <= 2 * n
    want = targets(sizes, **options)
    for r in rows:
        assert r.mix.source_size == sizes[r.source]
        assert math.isclose(r.mix.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4, s
    return want


def test_hard_rows(hard):
    out = mixed(hard)
    assert out.columns == [*hard.columns, "mix"]
    check(out.collect())


def test_documents_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (sorted((r.doc_id, r.mix.taken) for r in mixed(docs.repartition(n)).collect()) for n in (2, 7))
    assert one == two
    check(mixed(docs).collect())
    other = sorted((r.doc_id, r.mix.taken) for r in mixed(docs, seed=8).collect())
    assert other != one


def test_one_source_and_no_words(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(40)] + [(99, "", None)], "doc_id long, text string, source string")
    rows = mixed(docs).collect()
    check(rows)
    assert sum(r.mix.taken for r in rows) == 180
    assert [r.mix.target for r in rows if r.source is None] == [0.0]


def test_hot_repeated_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "s")] * 300 + [(i, "z " * 9, "t") for i in range(9)], "doc_id long, text string, source string")
    rows = mixed(docs, budget=0.7).collect()
    assert {r.mix.taken for r in rows if r.source == "s"} <= set(range(0, 11))
    got = sum(r.mix.taken for r in rows if r.source == "s")
    assert abs(got - next(r.mix.target for r in rows if r.source == "s")) <= 300


def test_clash_and_empty(none, hard):
    assert mixed(none).count() == 0
    assert mixed(hard, out="size").columns.count("size") == 1
