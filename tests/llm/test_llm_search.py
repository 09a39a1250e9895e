import bisect
import math
import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotwise.llm.decontamination import drop_contaminated, find_items, hit_words
from lotwise.llm.private import disclosures, luhn, matches, protect
from lotwise.llm.tokens import RULES, attribute_tokens, attributed, join_fields
from lotwise.llm.vectors import top_inner_products

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_items(rows, items, window, threshold=1.0):
    out = []
    for r in rows:
        words, hit, found = item_words(r.text), set(), set()
        for item, text in items:
            own = item_words(text)
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if own and item is not None else 0):
                for j in range(len(words) - size + 1):
                    same = sum(a == b for a, b in zip(words[j : j + size], own[i : i + size]))
                    if same >= math.ceil(threshold * size):
                        hit.update(range(j, j + size))
                        found.add(str(item))
        out.append((len(words), len(hit), sorted(found)))
    return out


ITEMS = [(1, "the of ÑANDÚ éTÉ b1"), (2, "p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16"), (2, "übér 42"), (30, "THE"), (None, "x"),
         (4, None), (5, " !! "), (6, "ends own-words"), (7, "not in there at all")]


@pytest.mark.parametrize("window,threshold,portion", [(10, 1.0, 1 << 24), (3, 1.0, 60), (4, 0.75, 1 << 24), (10, 0.5, 60)])
def test_items(spark, hard, window, threshold, portion):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = hard.where("length(text) < 4000 OR text IS NULL")
    found = find_items(docs, items, window=window, threshold=threshold, portion_bytes=portion)
    rows = found.withColumn("n", hit_words(F.col("found"))).collect()
    got = [(r.found.n_words, r.n, list(r.found["items"])) for r in rows]
    assert got == plain_items(rows, ITEMS, window, threshold)
    assert found.columns == [c for c in docs.columns if c != "found"] + ["found"]


def test_no_items_no_documents(spark, hard, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_items(none, items).count() == 0
    assert drop_contaminated(hard, items.where("false")).count() == hard.count()
    clean = drop_contaminated(hard, items)
    assert clean.columns == hard.columns and 0 < clean.count() < hard.count()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_matches(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", CARD, 16, 19), ("phone", PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_patterns():
    rng = random.Random(0)
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    for _ in range(20000):
        text = "".join(rng.choice("aZ9é .-+@()%_123..@@") for _ in range(rng.randrange(45)))
        assert [m[:3] for m in matches(text)] == plain_matches(text), text
    numbers = "4111 1111-1111 1111 x 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 +49 (30) 123456 a@b.c@d.ef 0000010.1.1.1"
    assert [m[:3] for m in matches(numbers)] == plain_matches(numbers)
    assert matches("9" * 200_000 + "." + "a" * 200_000) == []  # linear, not quadratic


def revealing(spark):
    """A rare word that stands only around one address, and a frequent one that also does."""
    rng = random.Random(3)

    def words(n):
        return " ".join(f"w{rng.randrange(200)}" for _ in range(n))

    rows = [(i, f"{words(30)} Zorblax and common {words(3)} anna@site.org {words(5)}") for i in range(6)]
    rows += [(10 + i, f"{words(30)} common {words(10)}") for i in range(200)]
    rows += [(300, f"{words(4)} zorblax {words(4)}"), (301, "bob@site.org Once"), (302, "bob@site.org Once"), (303, None), (None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    docs = revealing(spark)
    found = {r.term: r.disclosure for r in disclosures(docs, F.col("text")).collect()}
    assert set(found) == {"zorblax", "and"}  # "and" stands nowhere else either; copies of bob's text count once
    size, both, there = docs.count(), 6, {"zorblax": 7, "and": 6}
    for term, n in there.items():
        assert math.isclose(found[term], 1 + math.log(both / n) / math.log(size / 6))
    out = {r.doc_id: r for r in protect(docs, remove=0.98).collect()}
    assert [t.term for t in out[300].private.terms] == ["zorblax"] and "[WORD]" in out[300].private.text
    assert "[EMAIL]" in out[0].private.text and "[NAME]" in out[0].private.text and "and" not in out[0].private.text.split()
    assert out[303].private.text is None and not out[303].private.base
    assert all(not out[10 + i].private.terms for i in range(200))
    assert out[301].private.text == "[EMAIL] Once"


def test_copies_of_a_disclosing_text(spark):
    rng = random.Random(5)

    def words(n):
        return " ".join(f"w{rng.randrange(200)}" for _ in range(n))

    own = [f"{words(30)} zorblax {words(3)} anna@site.org {words(5)}" for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(own)] + [(10 + i, own[0]) for i in range(300)] + [(1000 + i, words(40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.term: r.disclosure for r in disclosures(docs, F.col("text")).collect()}
    assert found == {"zorblax": 1.0}
    assert all("zorblax" not in r.private.text for r in protect(docs).collect())


def test_entities_mentioned_once(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(30))) for i in range(3000)]
    rows += [(5000, f"{rows[0][1]} zorblax anna@site.org w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.term: r.disclosure for r in disclosures(docs, F.col("text")).collect()}
    assert set(found) == {"zorblax"}
    assert math.isclose(found["zorblax"], 1 + math.log(1 / (1 + 1.645**2)) / math.log(3001))


def test_private_of_hard_rows(hard, none):
    rows = protect(hard, out="score").collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.score.base] == plain_matches(r.text or "")
        assert r.score.text == r.text or r.score.base or r.score.terms
    assert protect(none).count() == 0


def plain_top(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        usable[i] = min(usable.get(i, whole), whole)
    out = []
    for q in usable:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def top(spark, rows, k=5, every=50, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = top_inner_products(frame, F.col("id") % every == 0, k, **options)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def test_top_of_clusters_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + 0.1 * rng.normal(size=16))]) for i in range(2500)]
    rows += [(5000 + i, rows[3][1]) for i in range(900)]  # one vector very often
    assert top(spark, rows) == plain_top(rows, 5, 50)
    assert top(spark, rows, k=2, every=100, max_pivots=3, open_first=1) == plain_top(rows, 2, 100)


def test_top_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [9.0, 9.0]),
            (5, []), (6, [3.0]), (7, [0.0, 0.0]), (8, [1.0, 2.0]), (8, [0.5, 2.0]), (0, [1.0, 2.0]), (-50, [0.001, -0.001, 4.0])]
    assert top(spark, rows) == plain_top(rows, 5, 50)
    assert top(spark, rows[:1]) == [] and top(spark, []) == [] and top(spark, [(None, None)]) == []
    assert top(spark, [(0, []), (1, []), (2, [])]) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    # One large vector no longer ends the search: a score beyond a long counts as the largest.
    assert top(spark, [(0, [3e38]), (1, [1e30])]) == [(0, 1, 1, (1 << 63) - 1)]


def test_tokens_of_documents(spark, sf):
    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    rows = attribute_tokens(spark.read.parquet(f"{sf}/documents.parquet"), F.col("text")).collect()
    for r in rows:
        starts, at = [], 0
        for line in r.text.split("\n"):
            starts.append(at)
            at += len(line) + 1
        encoding = tokenizer.encode(r.text, add_special_tokens=False)
        want = [0] * len(starts)
        for a, _ in encoding.offsets:
            want[bisect.bisect_right(starts, a) - 1] += 1
        assert (r.tokens.n_tokens, [int(s.tokens) for s in r.tokens.sections], r.tokens.n_outside) == (len(encoding.ids), want, 0)


def plain_attributed(first, last, starts, ends, rule):
    counts, outside = [0.0] * len(starts), 0.0
    order = sorted(range(len(starts)), key=lambda s: (starts[s], s))
    for a, b in zip(first, last):
        chars = range(a, b + 1)
        holds = {s: [c for c in chars if starts[s] <= c < ends[s]] for s in order}
        if rule in ("first", "last"):
            at = a if rule == "first" else b
            own = [s for s in order if at in holds[s]]
            for s in own:
                counts[s] += 1
            outside += not own
        elif rule == "share":
            for s in order:
                counts[s] += len(holds[s]) / len(chars)
            outside += sum(not any(c in holds[s] for s in order) for c in chars) / len(chars)
        else:
            own = max(order, key=lambda s: len(holds[s]), default=None)
            if own is not None and holds[own]:
                counts[own] += 1
            else:
                outside += 1
    return counts, outside


@pytest.mark.parametrize("rule", RULES)
def test_rules(rule):
    rng = random.Random(1)
    for _ in range(400):
        first, last, at = [], [], 0
        for _ in range(rng.randrange(8)):
            n = rng.randrange(1, 5)
            first.append(at)
            last.append(at + n - 1)
            at += n - (rng.random() < 0.2)  # tokens may share a character
        cuts = sorted(rng.randrange(at + 1) for _ in range(rng.randrange(0, 7))) if at else []
        spans = list(zip(cuts[0::2], cuts[1::2])) if rng.random() < 0.5 else list(zip(cuts, cuts[1:]))
        starts, ends = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        got = attributed(np.array(first, np.int64), np.array(last, np.int64), starts, ends, rule)
        want = plain_attributed(first, last, starts.tolist(), ends.tolist(), rule)
        assert np.allclose(got[0], want[0]) and math.isclose(got[1], want[1], abs_tol=1e-9)


def test_fields_and_hard_rows(hard, none):
    text, sections = join_fields(["source", "lang", "text"])
    for rule in RULES:
        for r in attribute_tokens(hard, text, sections, rule).collect():
            assert [s.name for s in r.tokens.sections] == ["source", "lang", "text"]
            total = sum(s.tokens for s in r.tokens.sections) + r.tokens.n_outside
            assert math.isclose(total, r.tokens.n_tokens, abs_tol=1e-6)
    missing = attribute_tokens(hard, F.col("text"), out="score").where("text IS NULL").first().score
    assert (missing.n_tokens, missing.sections) == (0, [])
    assert attribute_tokens(none, F.col("text")).count() == 0
    with pytest.raises(ValueError):
        attribute_tokens(hard, F.col("text"), rule="any")


def test_every_token_has_its_bytes():
    import lotwise.llm.tokens as t
    from pathlib import Path

    encoder, sizes = t._encoder(Path(t.VOCABULARY).read_bytes(), t.PATTERN)
    assert isinstance(encoder, tiktoken.Encoding)
    for text in ("", "añb 日本語 🙂🙂 <|endoftext|>", "a" * 3000):
        first, last = t.token_spans(text, encoder, sizes)
        assert (first <= last).all() and (not text or (first[0], last[-1]) == (0, len(text) - 1))
        assert (first[1:] <= last[:-1] + 1).all()


def test_long_white_space(spark):
    """Runs that the pattern cannot be matched against, and shorter ones where both ways can be compared."""
    import lotwise.llm.tokens as t

    ranks = open(t.VOCABULARY, "rb").read()
    encoder, _ = t._encoder(ranks, t.PATTERN)
    for blank in (" ", "\n", " \n", "\u00a0"):
        for text in (f"one{blank * 12000}two", blank * 12000, f"{blank * 12000}x", f"a {blank * 12000} b{blank * 15000}"):
            assert t.encoded(text, encoder) == encoder.encode_ordinary(text)
    text = "one" + " " * 1_500_000 + "two" + "\n" * 1_200_000
    rows = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    counted = {r["doc_id"]: r["tokens"] for r in t.attribute_tokens(rows, F.col("text")).collect()}
    ids = t.encoded(text, encoder)
    assert counted[1]["n_tokens"] == len(ids) and encoder.decode(ids) == text and counted[2]["n_tokens"] == len(encoder.encode_ordinary("short"))


def test_large_components(spark):
    """Products beyond 2^53 and beyond a long: exact where a long holds them."""
    values = {0: [4e5, 3.0], 1: [4e5, 5.0], 2: [1e9, -1.0], 3: [-1e9, 2.0], 4: [1e300, 0.0], 5: [0.25, 0.5]}
    rows = spark.createDataFrame(list(values.items()), "vec_id long, embedding array<double>")
    top = (1 << 63) - 1
    whole = {i: [max(min(math.floor(256 * x), top), -top - 1) for x in v] for i, v in values.items()}
    want = []
    for q in values:
        scores = {i: max(min(sum(a * b for a, b in zip(whole[q], whole[i])), top), -top - 1) for i in values if i != q}
        order = sorted(scores, key=lambda i: (-scores[i], i))[:3]
        want += [(q, rank, i, scores[i]) for rank, i in enumerate(order, 1)]
    got = [tuple(r) for r in top_inner_products(rows, F.lit(True), 3).orderBy("query_id", "rank").collect()]
    assert got == want
