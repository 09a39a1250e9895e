import itertools
import random

import pytest
import xxhash

from lotwise.llm.components import components
from lotwise.llm.simhash import drop_near_copies, fingerprint, fingerprint_classes, simhash_classes


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if linked(a, b):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents(spark, sf, hard):
    for frame in (spark.read.parquet(f"{sf}/documents.parquet"), hard):
        rows = frame.select("doc_id", "text").collect()
        prints = {(r.doc_id, r.text): plain_fingerprint(r.text) for r in rows}
        roots = classes(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for (doc, _), f in prints.items():
            if doc is not None:
                least[roots[f]] = min(least.get(roots[f], doc), doc)
        got = sorted(map(repr, simhash_classes(frame).collect()))
        want = [(r.doc_id, f"{prints[r.doc_id, r.text]:016x}", least.get(roots[prints[r.doc_id, r.text]])) for r in rows]
        assert got == sorted(f"Row(doc_id={a!r}, fingerprint={b!r}, component_id={c!r})" for a, b, c in want)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_crowded_signatures(spark, bits):
    rng = random.Random(bits)
    found = {0, (1 << 64) - 1}
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        at = centre
        for _ in range(250):
            at ^= 1 << rng.randrange(64)
            found.add(at)
            found.add(centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    want = classes(sorted(found), lambda a, b: (a ^ b).bit_count() <= bits)
    got = fingerprint_classes(spark.createDataFrame([(signed(x),) for x in found], "fp long"), bits).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.fp)
    expected = {}
    for x, root in want.items():
        expected.setdefault(root, set()).add(signed(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert all(root == min(g) for root, g in groups.items())


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 400).selectExpr("id as a", "id - 1 as b").unionByName(spark.createDataFrame([(7, 7), (900, 901)], "a long, b long"))
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {i: 0 for i in range(400)} | {900: 900, 901: 900}
    assert components(links.where("a < 0")).count() == 0


def test_one_document_stays(hard, none, spark):
    out = drop_near_copies(hard).collect()
    assert list(out[0].asDict()) == hard.columns
    prints = [plain_fingerprint(r.text) for r in hard.collect()]
    roots = classes(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(out) == len(set(roots.values()))
    assert len({roots[plain_fingerprint(r.text)] for r in out}) == len(out)
    assert drop_near_copies(none).count() == 0
    same = spark.createDataFrame([(1, "a b c d", "z"), (1, "a b c d", "y"), (0, "a b c d", "q")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in drop_near_copies(same).collect()] == [(0, "a b c d", "q")]
    assert [tuple(r) for r in drop_near_copies(same.where("doc_id = 1")).collect()] == [(1, "a b c d", "y")]


def test_long_text():
    text = ("Word " * 3 + "other words " * 40000).strip()
    assert fingerprint(text.encode()) == plain_fingerprint(text)
