"""The registered corpus queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.conversations import repair
from lotwise.llm.decontamination import find_items, hit_words
from lotwise.llm.jaccard import jaccard_classes
from lotwise.llm.language import fit_languages, identify
from lotwise.llm.lines import COMMON_WORDS, OFTEN, WORDS, remove_repeated_lines, removed_lines
from lotwise.llm.merkle import manifest
from lotwise.llm.mixing import mix_sources
from lotwise.llm.private import count_kind, protect, span_text
from lotwise.llm.simhash import simhash_classes
from lotwise.llm.substrings import remove_repeats, removed_words
from lotwise.llm.text import training_part, word_count
from lotwise.llm.tokens import attribute_tokens
from lotwise.llm.toxicity import fit_toxicity, judge_toxicity
from lotwise.llm.vectors import top_inner_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
        2.0::DOUBLE * source_size AS cap FROM r),
q AS (SELECT *, cap / w AS lim, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM w),
f AS (SELECT *, sum(cap) OVER u + lim * (sum(w) OVER () - sum(w) OVER u) <= total AS is_full FROM q
      WINDOW u AS (ORDER BY lim, rank ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
        / sum(CASE WHEN is_full THEN NULL ELSE w END) OVER () AS rate FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(rate * w, cap) END AS target FROM g),
b AS (SELECT *, coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) AS epochs FROM t),
p AS (SELECT source, key, sum(size)::BIGINT AS words,
        (sum(sum(size)) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - sum(size))::BIGINT AS start
      FROM k GROUP BY source, key)
SELECT k.doc_id, k.size, b.source_size, b.target,
  (epochs * size + CASE WHEN floor(target)::BIGINT - epochs * source_size >= start + words THEN size
     WHEN floor(target)::BIGINT - epochs * source_size <= start THEN 0
     ELSE floor(((floor(target)::BIGINT - epochs * source_size - start)::DOUBLE / words::DOUBLE) * size) END)::BIGINT AS taken
FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source AND k.key = p.key JOIN b ON k.source IS NOT DISTINCT FROM b.source
"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n"))
    mixed = mix_sources(docs, F.col("n"), key=["doc_id", "n"])
    return mixed.select("doc_id", "mix.*")


ITEM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({ITEM_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, list_slice(w, i, i + l - 1) AS win
       FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT l FROM bl),
dw AS (SELECT doc_id, l, i, list_slice(w, i, i + l - 1) AS win
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hits AS (SELECT dw.doc_id, dw.i, dw.l, iw.item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.win = iw.win),
n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items,
         sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


@query("op6_decontaminate", DECONTAMINATE_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    f = F.col("found")
    return found.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        hit_words(f).alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f["items"]), 256).alias("items_sha256"),
        (F.size(f["items"]) > 0).alias("contaminated"),
    )


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, hash(list_slice(w, i, i + 49)) AS a, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS b
        FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY a, b) AS first FROM win) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*)::BIGINT AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op8_remove_repeats", REPEATS_SQL)
def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    u = F.col("unique")
    return unique.select(
        "doc_id", u["n_words"].alias("n_words"), removed_words(u).alias("n_removed"), F.sha2(u["kept"], 256).alias("kept_sha256")
    )


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, line, p, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
      FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE body <> ''),
w AS (SELECT a.doc_id, a.i, row_number() OVER (PARTITION BY a.body, b.body, z.body ORDER BY a.doc_id, a.i) AS nth
      FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN c z ON z.doc_id = a.doc_id AND z.i = a.i + 2),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM w WHERE nth > 1),
dead AS (SELECT c.doc_id, c.p FROM c JOIN gone USING (doc_id, i)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t FROM l ANTI JOIN dead USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*)::BIGINT AS n_removed FROM dead GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_lines FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed,
  CASE WHEN d.ls IS NULL THEN NULL ELSE sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op9_repeated_lines", LINES_SQL)
def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = F.col("lines")
    return cut.select(
        "doc_id", c["n_lines"].alias("n_lines"), removed_lines(c).alias("n_removed"), F.sha2(c["kept"], 256).alias("kept_sha256")
    )


LINES_CONTENT_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, line, p, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
      FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS n
      FROM l WHERE body <> ''),
often AS (SELECT body FROM c GROUP BY body HAVING count(DISTINCT doc_id) >= 100),
r AS (SELECT doc_id, i, 1 AS size, [body] AS k FROM c WHERE n >= 50 OR (n >= 5 AND body IN (SELECT body FROM often))
      UNION ALL SELECT a.doc_id, a.i, 2, [a.body, b.body]
      FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i = a.i + 1 WHERE a.n + b.n >= 50
      UNION ALL SELECT a.doc_id, a.i, 3, [a.body, b.body, z.body]
      FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN c z ON z.doc_id = a.doc_id AND z.i = a.i + 2),
w AS (SELECT doc_id, i, size, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM w WHERE nth > 1),
dead AS (SELECT c.doc_id, c.p FROM c JOIN gone USING (doc_id, i)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t FROM l ANTI JOIN dead USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*)::BIGINT AS n_removed FROM dead GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_lines FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed,
  CASE WHEN d.ls IS NULL THEN NULL ELSE sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op9_repeated_content", LINES_CONTENT_SQL)
def op9_repeated_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op9_repeated_lines``, and runs of one or two lines with enough words, and common lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeated_lines(docs, words=WORDS, common_words=COMMON_WORDS, often=OFTEN)
    c = F.col("lines")
    return cut.select(
        "doc_id", c["n_lines"].alias("n_lines"), removed_lines(c).alias("n_removed"), F.sha2(c["kept"], 256).alias("kept_sha256")
    )


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = training_part(F.col("doc_id"))
    model = fit_toxicity(docs.where(learn), table(spark, sf_dir, "labels"))
    judged = judge_toxicity(docs, model)
    score = F.col("toxicity")["score"]
    return judged.select(
        "doc_id",
        (~learn).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size(F.col("toxicity")["passages"]).cast("long").alias("n_passages"),
    )


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = training_part(F.col("doc_id"))
    model = fit_languages(docs.where(learn))
    found = identify(docs.select("doc_id", "text"), model)
    of = F.col("language")
    return found.select(
        "doc_id", (~learn).alias("held_out"), of["lang"].alias("lang_pred"), of["score"].alias("score"), of["bits"].alias("bits")
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token that crosses a line end goes to the line it starts in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = attribute_tokens(docs, F.col("text"))
    t = F.col("tokens")
    return counted.select(
        "doc_id",
        t["n_tokens"].alias("n_tokens"),
        t["n_crossing"].alias("n_crossing"),
        F.size(t["sections"]).cast("long").alias("n_lines"),
        F.transform(t["sections"], lambda s: s["tokens"].cast("long")).alias("line_tokens"),
    )


@query("op4_private")
def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, terms = F.col("private")["base"], F.col("private")["terms"]
    listed = span_text(base)
    return found.select(
        "doc_id",
        *[count_kind(base, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(listed, 256).alias("base_sha256"),
        F.concat_ws(",", *[F.when(x != "", x) for x in (listed, span_text(terms, F.lit("term")))]).alias("spans"),
    )


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op3_top_inner_products", TOP_SQL)
def op3_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


JACCARD_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))) END AS x FROM d),
e AS MATERIALIZED (SELECT r, len(x) AS n, md5(array_to_string(unnest(x), ' ')) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.g = b.g AND a.r < b.r AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
      GROUP BY a.r, b.r HAVING 190 * count(*) >= 90 * (any_value(a.n) + any_value(b.n))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT r, r FROM s),
c AS (WITH RECURSIVE t(r, root) AS (SELECT r, r FROM s UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.r) SELECT r, root FROM t)
SELECT s.doc_id, len(s.x)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN c ON c.r = s.r JOIN s o ON o.r = c.root GROUP BY s.r, s.doc_id, s.x
"""


@query("op11_jaccard", JACCARD_SQL)
def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Unsigned CRC-32 of ASCII text: the table of 256 remainders, then a step per character.
CRC_TABLE = """(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    step = f"lambda c, b: xor(c >> 8, {{t}}[xor(c & 255, b) + 1])".format(t="crc.t")
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _merkle_sql(levels: int, top_levels: int) -> str:
    """Levels are unrolled: enough for ``8 ** levels`` rows of a language and ``8 ** top_levels`` languages."""

    def lower(text: str) -> str:
        return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    def climb(name: str, first: str, key: str, count: int) -> list[str]:
        steps = [f"{name}0 AS ({first})"]
        for k in range(count):
            run = f"PARTITION BY {key}, p // 8 ORDER BY p ROWS BETWEEN"
            steps += [
                f"{name}{k}s AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,"
                f" CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {name}{k})",
                f"{name}{k + 1} AS (SELECT {key}, p // 8 AS p, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) > 1"
                f" THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {key}, p // 8)",
            ]
        return steps

    def fold(name: str, key: str, count: int, first: str) -> list[str]:
        steps = [f"{name}f0 AS ({first})"]
        for k in range(count):
            steps.append(
                f"{name}f{k + 1} AS (SELECT f.* EXCLUDE (p, proof, folded), f.p // 8 AS p, proof || coalesce(l || r, '') AS proof,"
                f" CASE WHEN l IS NULL THEN folded ELSE sha256(l || folded || r) END AS folded"
                f" FROM {name}f{k} f JOIN {name}{k}s s ON s.p = f.p AND s.{key} IS NOT DISTINCT FROM f.{key})"
            )
        return steps

    steps = [
        f"crc AS {CRC_TABLE}",
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 3 = 0"
        f" THEN {leaf(lower('text'))} ELSE {leaf('text')} END AS tampered FROM documents, crc)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        *climb("a", "SELECT lang, p, n, leaf AS h FROM o", "lang", levels),
        f"u AS (SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM a{levels})",
        *climb("b", "SELECT one, p, n, h FROM u", "one", top_levels),
        *fold("a", "lang", levels, "SELECT doc_id, lang, leaf, p, '' AS proof, tampered AS folded FROM o"),
        *fold("b", "one", top_levels, f"SELECT f.* EXCLUDE (p), u.one, u.p, u.h AS subroot FROM af{levels} f JOIN u ON u.lang IS NOT DISTINCT FROM f.lang"),
    ]
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM bf{top_levels}, b{top_levels}"""
    )


MERKLE_SQL = _merkle_sql(levels=6, top_levels=2)


@query("op12_merkle", MERKLE_SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in three documents (by a checksum of the id) makes a version with its capitals lowered."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, fields, [*[F.col(f) for f in fields[:-1]], lowered], tampered)


def _edits_sql(table: str) -> str:
    """Costs and audits by state (start, system, user, assistant), with insertions before the next row."""
    add = lambda s, n: f"{{'c': {s}.c + {2 * n}, 'a': {s}.a || '{'I' * n}'}}"
    return (
        f"SELECT * REPLACE (least(s2, {add('s0', 1)}, {add('s1', 1)}, {add('s3', 1)}) AS s2,"
        f" least(s3, {add('s2', 1)}, {add('s0', 2)}, {add('s1', 2)}) AS s3) FROM {table}"
    )


def _repair_sql() -> str:
    def edit(state: str, cost: str, initial: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {initial}}}"

    def match(state: str, initial: str) -> str:
        kept = f"CASE WHEN initial = '{initial}' THEN 0 ELSE 2 END + late + stop"
        return edit(state, kept, f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END")

    none = "{'c': 1000000000::BIGINT, 'a': ''}"
    same = "t.conv_id IS NOT DISTINCT FROM r.conv_id"
    return f"""
WITH RECURSIVE crc AS {CRC_TABLE},
h AS (SELECT conv_id, turn, role, text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
      FROM conversations, crc),
x AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE WHEN h = 1 THEN ''
        WHEN h = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
        unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body, role[1] AS initial FROM x),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM i),
r AS (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late,
        CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END AS stop FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        (count(*) FILTER (fault = 'blank'))::BIGINT AS blank, (count(*) FILTER (fault = 'duplicate'))::BIGINT AS duplicate,
        (count(*) FILTER (fault = 'truncated'))::BIGINT AS truncated,
        (count(*) FILTER (two NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal, count(*) AS size FROM r GROUP BY conv_id),
t(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {none}, {none}, {none} FROM n
  UNION ALL SELECT t.conv_id, r.i, {edit('s0', '3', "'D'")},
    least({edit('s1', '3', "'D'")}, {edit('s0', "CASE WHEN initial = 's' THEN late + stop ELSE 1000000 END", "'K'")}),
    least({edit('s2', '3', "'D'")}, {match('s0', 'u')}, {match('s1', 'u')}, {match('s3', 'u')}),
    least({edit('s3', '3', "'D'")}, {match('s2', 'a')})
  FROM ({_edits_sql('t')}) t JOIN r ON {same} AND r.i = t.i + 1),
b AS (SELECT t.conv_id, least(s0, s3) AS best FROM ({_edits_sql('t')}) t JOIN n r ON {same} AND r.size = t.i),
o AS (SELECT conv_id, unnest(string_split(best.a, '')) AS op, unnest(range(len(best.a))) AS k FROM b),
p AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS place,
        count(*) FILTER (op <> 'D') OVER (PARTITION BY conv_id) % 2 AS sys FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
q AS (SELECT t.conv_id, sha256(string_agg(CASE op WHEN 'K' THEN role || ':' || text
        WHEN 'R' THEN CASE (place - 1 - sys) % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END || text
        WHEN 'I' THEN CASE (place - 1 - sys) % 2 WHEN 0 THEN 'user:' ELSE 'assistant:' END END, chr(10) ORDER BY k)) AS sha
      FROM p t LEFT JOIN r ON {same} AND r.i = t.i AND op <> 'I' GROUP BY t.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_repair", _repair_sql())
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages one row in four by a checksum of its key, then repairs every conversation."""
    rows = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("damage", F.crc32(key.cast("binary")) % 20)
    how, text = F.col("damage"), F.coalesce("text", F.lit(" "))
    damaged = rows.select(
        "conv_id",
        "turn",
        F.when(how == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("times"),
    )
    return repair(damaged, times=F.col("times"))
