import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lotwise.llm.catalog import op12_merkle
from lotwise.llm.merkle import manifest, version_root

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """The top node, and per leaf its siblings level by level."""
    above = [[] for _ in nodes]
    level, at = list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % arity
            above[i].append((level[first:p], level[p + 1 : first + arity]))
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0] if level else None, above


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows, arity=8):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r, plain_leaf([r[f] for f in FIELDS])))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        built[name] = plain_tree([h for _, h in trees[name]], arity)
    root, tops = plain_tree([built[n][0] for n in names], arity)
    out = []
    for name, top in zip(names, tops):
        for (r, leaf), path in zip(trees[name], built[name][1]):
            changed = leaf
            if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] is not None:
                changed = plain_leaf([r[f] for f in FIELDS[:-1]] + [lowered(r["text"])])
            folded, proof = changed, ""
            for left, right in path + top:
                folded = sha("".join(left) + folded + "".join(right))
                proof += "".join(left + right)
            out.append(repr((r["doc_id"], leaf, built[name][0], root, sha(proof), folded, folded == root)))
    return sorted(out)


def found(frame, **options):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(frame, FIELDS, [*[F.col(f) for f in FIELDS[:-1]], low], where, **options)


@pytest.mark.parametrize("arity,levels", [(8, 3), (2, 1), (3, 2)])
def test_documents(spark, sf, hard, arity, levels):
    for frame in (spark.read.parquet(f"{sf}/documents.parquet"), hard):
        rows = [r.asDict() for r in frame.select(*FIELDS).collect()]
        got = sorted(repr(tuple(r)) for r in found(frame, arity=arity, levels=levels).collect())
        assert got == plain_manifest(rows, arity)


def test_query(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    got = op12_merkle(spark, sf).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_manifest(rows)
    changed = [r.doc_id for r in got if not r.verified]
    own = {r["doc_id"]: r["text"] for r in rows}
    assert changed and all(zlib.crc32(str(i).encode()) % 3 == 0 and own[i] != lowered(own[i]) for i in changed)


def test_small(spark, none):
    """No rows, one row, many trees, ranges of few rows."""
    assert found(none).collect() == []
    one = spark.createDataFrame([(1, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [repr(tuple(r)) for r in found(one).collect()] == plain_manifest([r.asDict() for r in one.collect()])
    many = spark.createDataFrame([(i, "T", f"l{i % 70}" if i % 71 else None, "s", None) for i in range(300)], one.schema)
    got = sorted(repr(tuple(r)) for r in found(many).collect())
    assert got == plain_manifest([r.asDict() for r in many.collect()])


def test_proofs_lead_to_the_root(spark, sf):
    rows = found(spark.read.parquet(f"{sf}/documents.parquet").limit(50), proofs=True).collect()
    assert all(sha(r.proof) == r.proof_sha256 and len(r.proof) % 64 == 0 for r in rows)
    assert version_root("x", ["a", "b", "", "c"]) == sha(sha("axb") + "c")
