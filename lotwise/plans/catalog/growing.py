"""Trees grown by this library, next to SQL that grows the same ones.

The SQL repeats each pass: sums per (node, feature, cut), the choice of a split, the rows' next nodes. Rows of the
test part travel along and are counted nowhere.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lotwise.operators import explain, models, profile
from lotwise.operators.splits import LOG_TARGET, SPLIT_SEED, to_log_target, train_test_split
from lotwise.plans.catalog.registry import bucket, query, r, with_listing
from lotwise.sources.listing import listing

FEATURES = ("GrLivArea", "OverallQual", "LotArea", "TotalBsmtSF")
BINS = 16
ROWS = f""", r0 AS (SELECT Id, ln(1 + SalePrice) AS y, {bucket('Id', 100, SPLIT_SEED)} < 20 AS test,
  {', '.join(f'{f}::DOUBLE AS f{j}' for j, f in enumerate(FEATURES))} FROM listing)"""
LAST = "SELECT Id, round(now, 5) AS prediction FROM t{rounds} WHERE test"


def cuts_sql(features: int) -> str:
    probs = ", ".join(f"{k / BINS}::DOUBLE" for k in range(1, BINS))
    one = (
        f"SELECT {j} AS j, unnest(quantile_disc(f{j}, [{probs}])) AS v, max(f{j}) AS top FROM r0 WHERE NOT test" for j in range(features)
    )
    return ", cuts AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(one) + ") WHERE v < top)"


def cell(j: str, features: int = len(FEATURES)) -> str:
    return f"CASE {j} " + " ".join(f"WHEN {k} THEN f{k}" for k in range(features)) + " END"


def boosted_sql(
    how: str, rounds: int, steps: int, rate: float, reg_lambda: float, reg_alpha: float, gamma: float, least: int,
    rows: str = ROWS, features: int = len(FEATURES), last: str = LAST,
) -> str:
    """``steps`` are levels, or splits where one leaf splits at a time."""
    own = cell("j", features)

    def score(g: str, h: str) -> str:
        return f"(pow(greatest(abs({g}) - {reg_alpha}::DOUBLE, 0), 2) / nullif({h} + {reg_lambda}::DOUBLE, 0))"

    parts = [", t0 AS (SELECT *, (SELECT avg(y) FROM r0 WHERE NOT test) AS now FROM r0)"]
    for k in range(rounds):
        parts.append(f", n{k}_0 AS (SELECT *, now - y AS g, 1 AS node FROM t{k})")
        for s in range(steps):
            name = f"{k}_{s}"
            gain = f"coalesce({score('gl', 'hl')}, 0) + coalesce({score('g - gl', 'h - hl')}, 0) - coalesce({score('g', 'h')}, 0)"
            parts.append(
                f""", c{name} AS (SELECT *, {gain} AS gain FROM (SELECT node, j, v, sum(g) AS g, count(*) AS h,
                  coalesce(sum(g) FILTER ({own} <= v), 0) AS gl, count(*) FILTER ({own} <= v) AS hl
                  FROM n{name} n, cuts WHERE NOT test GROUP BY node, j, v))"""
            )
            if how == "oblivious":
                pick = f"""SELECT n.node, j, v FROM (SELECT DISTINCT node FROM n{name}) n,
                  (SELECT j, v FROM c{name} GROUP BY j, v ORDER BY round(sum(gain), 9) DESC, j, v LIMIT 1)"""
            else:
                over = "" if how == "leaf" else "PARTITION BY node"
                pick = f"""SELECT node, j, v FROM (SELECT *, row_number() OVER ({over} ORDER BY round(gain, 9) DESC, node, j, v) AS place
                  FROM c{name} WHERE hl >= {least} AND h - hl >= {least} AND gain > {max(gamma, 1e-6)}) WHERE place = 1"""
            parts.append(
                f""", b{name} AS ({pick}), n{k}_{s + 1} AS (SELECT n.* REPLACE (CASE WHEN b.node IS NULL THEN n.node
                  WHEN {cell('b.j', features)} <= b.v THEN 2 * n.node ELSE 2 * n.node + 1 END AS node) FROM n{name} n LEFT JOIN b{name} b ON b.node = n.node)"""
            )
        parts.append(
            f""", w{k} AS (SELECT node, -sign(sum(g)) * greatest(abs(sum(g)) - {reg_alpha}::DOUBLE, 0) / (count(*) + {reg_lambda}::DOUBLE) AS w
              FROM n{k}_{steps} WHERE NOT test GROUP BY node),
              t{k + 1} AS (SELECT n.* EXCLUDE (node, g) REPLACE (now + {rate}::DOUBLE * coalesce(w, 0) AS now)
              FROM n{k}_{steps} n LEFT JOIN w{k} w ON w.node = n.node)"""
        )
    return with_listing(last.format(rounds=rounds), rows, cuts_sql(features), *parts)


def feature_rows(spark, sf, features=FEATURES):
    x = F.array(*[F.col(c).cast("double") for c in features])
    return to_log_target(listing(spark, sf)).select("Id", LOG_TARGET, array_to_vector(x).alias("features"))


def predicted(spark, sf, name: str, **settings):
    train, test = train_test_split(feature_rows(spark, sf))
    model = models.build_model(name, **settings).fit(train)
    return model.transform(test).select("Id", r("prediction", 5).alias("prediction"))


WHOLE = {"subsample": 1.0, "colsample": 1.0, "max_bins": BINS}


@query("boosted_by_level", boosted_sql("level", 2, 2, 0.3, 2.0, 0.5, 0.01, 1))
def boosted_by_level(spark, sf):
    """Second-order boosting with both penalties and a gain threshold."""
    return predicted(
        spark, sf, "xgboost", n_estimators=2, max_depth=2, learning_rate=0.3, reg_lambda=2.0, reg_alpha=0.5, gamma=0.01, **WHOLE
    )


@query("boosted_by_leaf", boosted_sql("leaf", 2, 3, 0.3, 0.0, 0.0, 0.0, 20))
def boosted_by_leaf(spark, sf):
    """Each tree takes the three best splits, wherever they are."""
    return predicted(spark, sf, "lightgbm", n_estimators=2, max_depth=None, num_leaves=4, learning_rate=0.3, **WHOLE)


@query("boosted_oblivious", boosted_sql("oblivious", 2, 2, 0.3, 3.0, 0.0, 0.0, 0))
def boosted_oblivious(spark, sf):
    """All nodes of a level share a split."""
    return predicted(spark, sf, "catboost", n_estimators=2, max_depth=2, learning_rate=0.3, max_bins=BINS)


def drawn_sql(seed: int, trees: int, depth: int) -> str:
    """Thresholds between a node's bounds by the same hash; the best of the drawn splits."""

    def hashed(source: str) -> str:
        steps = []
        for part in ("tree", "node", "j"):
            steps += [f"(h + {part} + 1) % 2147483647 * 48271 % 2147483647", "xor(h, h >> 13) * 69621 % 2147483647", "xor(h, h >> 11)"]
        for step in (*steps, "h * 48271 % 2147483647", "xor(h, h >> 15) * 69621 % 2147483647"):
            source = f"(SELECT * REPLACE ({step} AS h) FROM {source})"
        return source

    parts = [f", n0 AS (SELECT r0.*, tree, 1::BIGINT AS node FROM r0, range({trees}) t(tree))"]
    for s in range(depth):
        bounds = f"""SELECT {seed % 2147483647}::BIGINT AS h, tree, node, j, min({cell('j')}) AS low, max({cell('j')}) AS high
          FROM n{s}, range({len(FEATURES)}) f(j) WHERE NOT test GROUP BY tree, node, j"""
        parts.append(
            f""", d{s} AS (SELECT tree, node, j, low + h / 2147483647::DOUBLE * (high - low) AS v FROM {hashed(f'({bounds})')} WHERE low < high),
            c{s} AS (SELECT *, coalesce(gl * gl / nullif(hl, 0) + pow(g - gl, 2) / nullif(h - hl, 0) - g * g / h, 0) AS gain FROM (
              SELECT tree, node, j, v, sum(y) AS g, count(*) AS h, sum(y) FILTER ({cell('j')} <= v) AS gl, count(*) FILTER ({cell('j')} <= v) AS hl
              FROM n{s} JOIN d{s} USING (tree, node) WHERE NOT test GROUP BY tree, node, j, v)),
            b{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY round(gain, 9) DESC, j) AS place
              FROM c{s} WHERE hl > 0 AND hl < h AND gain > 1e-9) WHERE place = 1),
            n{s + 1} AS (SELECT n.* REPLACE (CASE WHEN b.node IS NULL THEN n.node WHEN {cell('b.j')} <= b.v THEN 2 * n.node ELSE 2 * n.node + 1 END AS node)
              FROM n{s} n LEFT JOIN b{s} b ON b.tree = n.tree AND b.node = n.node)"""
        )
    return with_listing(
        f"""SELECT Id, round(avg(w), 5) AS prediction FROM n{depth} n JOIN (SELECT tree, node, avg(y) AS w FROM n{depth} WHERE NOT test
        GROUP BY tree, node) w ON w.tree = n.tree AND w.node = n.node WHERE test GROUP BY Id""",
        ROWS,
        *parts,
    )


@query("extra_trees_drawn", drawn_sql(42, 3, 3))
def extra_trees_drawn(spark, sf):
    """Three trees of depth 3 whose thresholds SQL draws again."""
    return predicted(spark, sf, "extra_trees", n_estimators=3, max_depth=3)


# Shapley values by their definition: with two features, the mean over the background of what a feature adds alone and
# to the other. Every mixture of an explained and a background row goes down the tree that SQL has grown.
MIXED = f""", pts AS (SELECT Id, ln(1 + SalePrice) AS y, {bucket('Id', 100, SPLIT_SEED)} < 20 AS test, {bucket('Id', 4294967296, 42)} AS place,
  GrLivArea::DOUBLE AS f0, OverallQual::DOUBLE AS f1 FROM listing),
shown AS (SELECT * FROM pts WHERE test ORDER BY place, Id LIMIT 300), ground AS (SELECT * FROM pts WHERE NOT test ORDER BY place, Id LIMIT 100),
r0 AS (SELECT Id, y, test, 0 AS mask, f0, f1 FROM pts WHERE NOT test UNION ALL
  SELECT x.Id, NULL, true, mask, CASE WHEN mask % 2 = 1 THEN x.f0 ELSE z.f0 END, CASE WHEN mask >= 2 THEN x.f1 ELSE z.f1 END
  FROM shown x, ground z, range(4) m(mask))"""
SHARES = """SELECT Id, feature, x, round(c, 5) AS contribution FROM (
  SELECT v.Id, unnest(['GrLivArea', 'OverallQual']) AS feature, unnest([f0, f1]) AS x,
    unnest([(a3 - a2 + a1 - a0) / 2, (a3 - a1 + a2 - a0) / 2]) AS c
  FROM (SELECT Id, avg(now) FILTER (mask = 0) AS a0, avg(now) FILTER (mask = 1) AS a1, avg(now) FILTER (mask = 2) AS a2,
    avg(now) FILTER (mask = 3) AS a3 FROM t{rounds} WHERE test GROUP BY Id) v JOIN shown ON shown.Id = v.Id)"""


@query("tree_values", boosted_sql("level", 2, 2, 0.5, 1.0, 0.0, 0.0, 1, MIXED, 2, SHARES))
def tree_values(spark, sf):
    """Exact contributions of a sum of trees, next to the definition."""
    names = ["GrLivArea", "OverallQual"]
    train, test = train_test_split(feature_rows(spark, sf, names))
    model = models.build_model("xgboost", n_estimators=2, max_depth=2, learning_rate=0.5, **WHOLE).fit(train)
    cells, _ = explain.row_cells(model, explain.background(train), names)
    rows = profile.sample_rows(test, explain.EXPLAINED_ROWS).select("Id", cells.alias("cells"))
    return explain.long_form(rows).withColumn("contribution", r("contribution", 5))
