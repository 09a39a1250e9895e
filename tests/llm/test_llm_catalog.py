import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_mixing import check
from test_llm_repeats import cut_content
from test_llm_search import plain_items, plain_matches
from test_llm_simhash import classes, plain_fingerprint

import __spark_entry__
import corpus_pipeline
from lotwise.llm.catalog import QUERIES, SQL
from lotwise.llm.lines import COMMON_WORDS, OFTEN, WORDS
from lotwise.session import via_table


def test_every_operator_has_a_query():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES}
    assert numbers == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r) for r in frame.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_private_digest(spark, sf):
    own = texts(spark, sf)
    rows = QUERIES["op4_private"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(own)
    for r in rows:
        found = plain_matches(own[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in found]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term:")] == listed
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in found)


@pytest.mark.parametrize("name,least", [("op1_language", 0.95), ("op7_toxicity", 0.9)])
def test_learned_digest(spark, sf, name, least):
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(texts(spark, sf)) and all(0 <= r.score <= 1 for r in rows)
    if name == "op1_language":
        truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        right = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    else:
        truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        right = [truth[r.doc_id] == r.predicted for r in rows if r.held_out and r.doc_id in truth]
        assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert len(right) > 10 and sum(right) >= least * len(right)


def test_token_digest(spark, sf):
    own = texts(spark, sf)
    for r in QUERIES["op10_token_counts"](spark, sf).collect():
        assert r.n_lines == own[r.doc_id].count("\n") + 1 == len(r.line_tokens)
        assert r.n_tokens == sum(r.line_tokens)


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against brute force over what the one before kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    stages = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{sf}/documents.parquet")

    def do(name, docs):
        return via_table(stages[name](spark, docs, sf), name)

    calm = do("toxicity", start)
    judged = {r.doc_id: r.predicted for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    assert sorted(r.doc_id for r in calm.collect()) == sorted(i for i, bad in judged.items() if not bad)

    lines = do("line_dedup", calm)
    rows = calm.withColumn("h", F.xxhash64("text")).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in lines.collect()} == {
        (r.doc_id, k, len(k)) for r, (_, _, k) in zip(rows, cut_content(rows, 3, WORDS, COMMON_WORDS, OFTEN))
    }

    single = do("near_dedup", lines)
    prints = {r.doc_id: plain_fingerprint(r.text) for r in lines.collect()}
    roots = classes(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in sorted(prints.items()):
        least.setdefault(roots[f], i)
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())

    clean = do("decontamination", single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = single.collect()
    kept = [r.doc_id for r, (_, _, found) in zip(rows, plain_items_fast(rows, items)) if not found]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(kept)
    for stage in (calm, lines, single, clean):
        assert stage.columns == start.columns

    mixed = do("mixing", clean)
    assert mixed.columns == [*start.columns, "size", "source_size", "target", "taken"]
    taken = {r.doc_id: r for r in mixed.collect()}
    every = clean.join(mixed.select("doc_id", F.struct("size", "source_size", "target", "taken").alias("mix")), "doc_id", "left").collect()
    assert all(r.mix is None or r.mix.taken > 0 for r in every) and taken
    sums = {}
    for r in every:
        if r.mix is not None:
            sums.setdefault((r.source, r.mix.target), []).append(r.mix.taken)
    assert all(abs(sum(v) - target) <= 4 for (_, target), v in sums.items())
    assert sorted(taken) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())


def plain_items_fast(rows, items):
    """The windows of all items as word tuples."""
    from test_llm_search import item_words

    windows = {}
    for item, text in items:
        own = item_words(text)
        size = min(10, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item))
    out = []
    for r in rows:
        words, found = item_words(r.text), set()
        for size in {len(w) for w in windows}:
            for j in range(len(words) - size + 1):
                found |= windows.get(tuple(words[j : j + size]), set())
        out.append((len(words), 0, found))
    return out


def test_fast_items_are_the_items(spark, hard):
    items = [(1, "the of ÑANDÚ éTÉ b1"), (2, "p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16")]
    rows = hard.where("length(text) < 4000").collect()
    assert [sorted(f) for _, _, f in plain_items_fast(rows, items)] == [f for _, _, f in plain_items(rows, items, 10)]


def test_stages_over_hard_and_empty_tables(spark, sf, hard, none):
    for docs in (hard.select("doc_id", "text", "lang", "source", "n_chars", "score"), none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "mixing" or out.columns == docs.columns
            docs = via_table(out, name)
        assert docs.count() <= hard.count()


def test_mix_check_is_strict(spark, sf):
    from lotwise.llm.mixing import mix_sources
    from lotwise.llm.text import word_count

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(mix_sources(docs, word_count(F.col("text")), ["doc_id"]).collect())


CLASHING = ("_found", "_lines", "_toxicity", "_k1", "_k2", "_mix", "_mix_key", "_letter", "_run_a", "_terms", "_own_o", "_own_k", "_text", "_id", "_rest")


def test_clashing_names(spark, sf, hard):
    """Every stage and operator keeps a caller's columns, whatever they are called."""
    from lotwise.llm.decontamination import find_items
    from lotwise.llm.language import fit_languages, identify
    from lotwise.llm.mixing import mix_sources
    from lotwise.llm.private import protect
    from lotwise.llm.substrings import remove_repeats
    from lotwise.llm.tokens import attribute_tokens

    plain = hard.select("doc_id", "text", "lang", "source", "n_chars").where("length(text) < 3000")
    docs = plain.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    want = tuple(range(len(CLASHING)))
    here, there = docs, plain
    for name, stage in corpus_pipeline.STAGES:
        here, there = via_table(stage(spark, here, sf), name), via_table(stage(spark, there, sf), name)
        assert set(CLASHING) <= set(here.columns) and here.select(*CLASHING).distinct().collect() in ([want], [])
        assert sorted(map(repr, here.select(*there.columns).collect())) == sorted(map(repr, there.collect()))
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    model = fit_languages(plain.where("lang IS NOT NULL"))
    body = docs.withColumnRenamed("text", "_body")
    for made in (
        lambda d, t: identify(d, model, text=t),
        lambda d, t: protect(d, text=t),
        lambda d, t: remove_repeats(d, text=t),
        lambda d, t: find_items(d, benchmark, text=t),
        lambda d, t: attribute_tokens(d, F.col(t)),
        lambda d, t: mix_sources(d, F.length(t), ["doc_id", t]),
    ):
        out, alone = made(body, "_body"), made(plain, "text")
        result = [c for c in alone.columns if c not in plain.columns]
        assert set(body.columns) < set(out.columns) and out.select(*CLASHING).distinct().collect() == [want]
        if result != ["mix"]:  # the keys of a mix are the texts, whatever their column is called
            pairs = [[repr(tuple(r)) for r in d.select(t, *result).collect()] for d, t in ((out, "_body"), (alone, "text"))]
            assert sorted(pairs[0]) == sorted(pairs[1])
