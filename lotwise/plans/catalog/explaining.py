"""Explanation queries: a linear model with stated weights, so that SQL can repeat it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators import explain, models, profile
from lotwise.operators.scoring import score
from lotwise.operators.splits import FOLD_SEED, SPLIT_SEED, train_test_split
from lotwise.operators.tuning import GRIDS, LEARNING_SHARES
from lotwise.plans import reports
from lotwise.plans.catalog.comparing import OLS, POINTS, RIDGE, SXX, SXY, encoded, one_column
from lotwise.plans.catalog.registry import bucket, query, r, with_listing
from lotwise.plans.training import Prepared
from lotwise.session import work_path
from lotwise.sources.listing import listing

WEIGHTS = {"GrLivArea": 0.0003, "OverallQual": 0.07, "YearBuilt": 0.001, "TotalBsmtSF": -0.0002, "Fireplaces": 0.011}
BASE = 12.0


def cells(spark, sf):
    rows = listing(spark, sf).select("Id", *WEIGHTS)
    means = explain.background_means(explain.background(rows), list(WEIGHTS))
    return explain.linear_cells(rows, WEIGHTS, means)


def contributions(spark, sf):
    return explain.long_form(cells(spark, sf))


BG = f""", bg AS (SELECT * FROM listing ORDER BY {bucket('Id', 4294967296, 42)}, Id LIMIT 100),
phi AS ({' UNION ALL '.join(f"SELECT Id, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, {w}::DOUBLE * ({f} - (SELECT avg({f}) FROM bg)) AS c FROM listing" for f, w in WEIGHTS.items())})"""


@query("background_sample", with_listing("SELECT Id FROM bg", BG))
def background_sample(spark, sf):
    return explain.background(listing(spark, sf)).select("Id")


@query("linear_contrib", with_listing("SELECT Id, feature, x, round(c, 6) AS contribution FROM phi", BG))
def linear_contrib(spark, sf):
    return contributions(spark, sf).withColumn("contribution", r("contribution"))


@query(
    "contrib_rank",
    with_listing(
        """SELECT Id, 12.0::DOUBLE AS base_value, string_agg(feature, '>' ORDER BY abs(c) DESC, feature) AS features,
        round(max(abs(c)), 6) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY abs(c) DESC, feature) AS rn FROM phi)
        WHERE rn <= 3 GROUP BY Id""",
        BG,
    ),
)
def contrib_rank(spark, sf):
    top = explain.explanations(cells(spark, sf), F.lit(BASE), top=3)
    return top.select(
        "Id",
        "base_value",
        F.array_join(F.transform("contributions", lambda c: c["feature"]), ">").alias("features"),
        r(F.abs(F.col("contributions")[0]["value"])).alias("largest"),
    )


@query(
    "global_summary",
    with_listing("SELECT feature, round(avg(abs(c)), 6) AS importance FROM phi GROUP BY feature", BG),
)
def global_summary(spark, sf):
    return explain.global_summary(contributions(spark, sf)).select("feature", r("importance").alias("importance"))


@query(
    "dependence",
    with_listing(
        """SELECT Id, x, round(c, 6) AS contribution FROM phi WHERE feature =
        (SELECT feature FROM phi GROUP BY feature ORDER BY var_samp(x) DESC LIMIT 1)""",
        BG,
    ),
)
def dependence(spark, sf):
    phi = contributions(spark, sf)
    return explain.dependence(phi, explain.widest_feature(phi)).withColumn("contribution", r("contribution"))


@query(
    "waterfall_running",
    with_listing(
        """SELECT Id, row_number() OVER w AS position, feature, round(c, 6) AS contribution, round(12.0 + sum(c) OVER w, 6) AS running_total
        FROM phi WINDOW w AS (PARTITION BY Id ORDER BY abs(c) DESC, feature ROWS UNBOUNDED PRECEDING)""",
        BG,
    ),
)
def waterfall_running(spark, sf):
    out = explain.waterfall(cells(spark, sf), BASE)
    return out.select(
        "Id", F.col("position").cast("long").alias("position"), "feature",
        r("contribution").alias("contribution"), r("running_total").alias("running_total"),
    )


@query(
    "decision_paths",
    with_listing(
        """SELECT Id, position, feature, round(12.0 + sum(c) OVER (PARTITION BY Id ORDER BY position ROWS UNBOUNDED PRECEDING), 6)
        AS running_total FROM phi JOIN (SELECT feature, row_number() OVER (ORDER BY avg(abs(c)), feature DESC) AS position
        FROM phi GROUP BY feature) USING (feature)""",
        BG,
    ),
)
def decision_paths(spark, sf):
    out = explain.decision_paths(cells(spark, sf), BASE)
    return out.select("Id", F.col("position").cast("long").alias("position"), "feature", r("running_total").alias("running_total"))


@query("explain_fitted_linear")
def explain_fitted_linear(spark, sf):
    """Contributions of a fitted ridge; with the base they add up to the prediction (see tests)."""
    train, test = encoded(spark, sf)
    model = models.build_model("ridge").fit(train)
    names = [str(i) for i in range(len(model.coefficients))]
    sample = explain.background(train)
    own = test.select("Id", explain.vector_cells(model, sample, names).alias("cells"))
    return explain.explanations(own, F.lit(explain.linear_base_value(model, sample)), top=12)


@query("explain_sampled")
def explain_sampled(spark, sf):
    """Sampled Shapley values of a tree for the sample of explained rows."""
    train, test = encoded(spark, sf)
    model = models.build_model("decision_tree").fit(train)
    rows = profile.sample_rows(test, explain.EXPLAINED_ROWS)
    size = model.numFeatures
    phi, _ = explain.sampled_contributions(rows, model, train, [str(i) for i in range(size)])
    return explain.global_summary(phi)


@query(
    "score_explained",
    with_listing(
        """SELECT Id, round(greatest(exp(a + w * x) - 1, 0), 2) AS predicted_price, CASE WHEN Id % 2 = 0 THEN round(a + w * m, 5) END AS base_value,
        CASE WHEN Id % 2 = 0 THEN 'area' END AS features, CASE WHEN Id % 2 = 0 THEN round(w * (x - m), 5) END AS contribution
        FROM pts, line, mean""",
        POINTS,
        f", line AS (SELECT {OLS} AS w, avg(y) - ({OLS}) * avg(x) AS a FROM pts)",
        f""", mean AS (SELECT avg(x) AS m FROM (SELECT x FROM pts ORDER BY {bucket('Id', 4294967296, 42)}, Id LIMIT 100))""",
    ),
)
def score_explained(spark, sf):
    """Prices with the explanation of the requests that asked for one."""
    rows = one_column(spark, sf)
    model = models.build_model("linear_regression").fit(rows)
    explainer = explain.Explainer(model, explain.background(rows), ["area"])
    asked = rows.withColumn("explain", F.col("Id") % 2 == 0)
    out = score(asked, PipelineModel([model]), "line", 40000.0, "Id", explainer)
    listed = F.col("explanation")["contributions"]
    return out.select(
        "Id",
        "predicted_price",
        r(F.col("explanation")["base_value"], 5).alias("base_value"),
        F.array_join(F.transform(listed, lambda c: c["feature"]), ">").alias("features"),
        r(listed[0]["value"], 5).alias("contribution"),
    )


def _written(spark, tables: dict, checks: dict[str, list]) -> DataFrame:
    """The tables as they are read back: ``name, rows`` and two sums of values of each (``a``, ``b``)."""
    path = work_path(spark, "report")
    reports.write_report(tables, path)
    out = None
    for n in tables:
        a, b = (F.round(F.sum(x) if x is not None else F.lit(0.0), 3).cast("double") for x in checks[n])
        own = spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), a.alias("a"), b.alias("b"))
        out = own if out is None else out.unionByName(own)
    return out


def one_column_data(spark, sf) -> Prepared:
    train, test = train_test_split(one_column(spark, sf))
    return Prepared(train, test, ["area"], ["area"], PipelineModel([]))


TEST_SHARE = f"{bucket('Id', 100, SPLIT_SEED)} < 20"
TRAIN = f", tr AS (SELECT * FROM pts WHERE NOT {TEST_SHARE})"
PARTS = f""", folded AS (SELECT *, {bucket('Id', 3, FOLD_SEED)} AS fold, {bucket('Id', 10000, FOLD_SEED + 1)} AS u FROM tr)"""
ERROR = "(y - m - w * x) * (y - m - w * x)"
CURVES = f""", steps AS (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in LEARNING_SHARES)}]) AS share, 10.0::DOUBLE AS alpha, 'learning_curve' AS name
  UNION ALL SELECT 1.0, unnest([{', '.join(f'{a}::DOUBLE' for a in GRIDS['ridge']['alpha'])}]), 'validation_curve'),
fits AS (SELECT name, share, alpha, f, {SXY} * count(*) / ({SXX} * count(*) + alpha) AS w,
  avg(y) - {SXY} * count(*) / ({SXX} * count(*) + alpha) * avg(x) AS m
  FROM folded, range(3) t(f), steps WHERE fold <> f AND u < floor(share * 10000) GROUP BY name, share, alpha, f),
curves AS (SELECT name, share, alpha, avg(tr) AS tr, avg(va) AS va FROM (SELECT name, share, alpha, f,
  sqrt(avg({ERROR}) FILTER (WHERE fold <> f AND u < floor(share * 10000))) AS tr, sqrt(avg({ERROR}) FILTER (WHERE fold = f)) AS va
  FROM folded, fits GROUP BY name, share, alpha, f) GROUP BY name, share, alpha)"""
PRICED = f""", line AS (SELECT {RIDGE} AS w, avg(y) - ({RIDGE}) * avg(x) AS m FROM tr),
priced AS (SELECT Id, SalePrice AS v, greatest(exp(m + w * x) - 1, 0) AS p FROM pts, line WHERE {TEST_SHARE}),
spread AS (SELECT min(v - p) AS low, (max(v - p) - min(v - p)) / 40 AS step FROM priced)"""


@query(
    "evaluation_report",
    with_listing(
        """SELECT name, rows, round(a, 3) AS a, round(b, 3) AS b FROM (
        SELECT 'residuals' AS name, count(*) AS rows, sum(p) / 1e6 AS a, sum(abs(v - p)) / 1e6 AS b FROM priced
        UNION ALL SELECT 'residual_histogram', count(*), sum(n), sum(n * bin) FROM (
          SELECT least(floor((v - p - low) / step), 39) AS bin, count(*) AS n FROM priced, spread GROUP BY 1)
        UNION ALL SELECT 'error_limits', 1, least(min(v), min(p)) / 1e6, greatest(max(v), max(p)) / 1e6 FROM priced
        UNION ALL SELECT name, count(*), sum(tr), sum(va) FROM curves GROUP BY name
        UNION ALL SELECT 'leaderboard', 1, 1.0, 0.0)""",
        POINTS,
        TRAIN,
        PARTS,
        CURVES,
        PRICED,
    ),
)
def evaluation_report(spark, sf):
    """The evaluation tables of a winner, written and read back."""
    data = one_column_data(spark, sf)
    board = spark.createDataFrame([("ridge", 1.0)], "name string, rmse double")
    tables = reports.evaluation_tables(data, models.build_model("ridge").fit(data.train), "ridge", board)
    c, million = F.col, 1e6
    return _written(
        spark,
        tables,
        {
            "leaderboard": [c("rmse"), None],
            "residuals": [c("predicted") / million, F.abs("residual") / million],
            "residual_histogram": [c("count"), c("count") * c("bin")],
            "error_limits": [c("low") / million, c("high") / million],
            "learning_curve": [c("train_rmse"), c("validation_rmse")],
            "validation_curve": [c("train_rmse"), c("validation_rmse")],
        },
    )


# The explained rows, and the background whose mean is the base.
EXPLAINED = f""", shown AS (SELECT * FROM pts WHERE {TEST_SHARE} ORDER BY {bucket('Id', 4294967296, 42)}, Id LIMIT 300),
ground AS (SELECT * FROM tr ORDER BY {bucket('Id', 4294967296, 42)}, Id LIMIT 100)"""
CHARTS = """SELECT name, rows, round(a, 3) AS a, round(b, 3) AS b FROM (SELECT count(*) AS n, sum(p) AS p, sum(p - base) AS c,
  sum(abs(p - base)) AS z, sum(x) AS x FROM phi), LATERAL (SELECT unnest(['global_summary', 'waterfall', 'dependence', 'decision']) AS name,
  unnest([1, n, n, n]) AS rows, unnest([z / n, c, x, p]) AS a, unnest([0, p, c, n]) AS b)"""


def _charts(spark, sf, model: str, **settings):
    data = one_column_data(spark, sf)
    fitted = models.build_model(model, **settings).fit(data.train)
    c = F.col
    return _written(
        spark,
        reports.explanation_tables(data, fitted),
        {
            "global_summary": [c("importance"), None],
            "waterfall": [c("contribution"), c("running_total")],
            "dependence": [c("x"), c("contribution")],
            "decision": [c("running_total"), c("position")],
        },
    )


@query(
    "explanation_report",
    with_listing(
        CHARTS,
        POINTS,
        TRAIN,
        EXPLAINED,
        f", line AS (SELECT {OLS} AS w, avg(y) - ({OLS}) * avg(x) AS m FROM tr)",
        ", phi AS (SELECT x, m + w * x AS p, (SELECT avg(m + w * x) FROM ground, line) AS base FROM shown, line)",
    ),
)
def explanation_report(spark, sf):
    """The explanation tables of a linear winner, written and read back. With one feature its contribution is what
    the prediction differs from the base by, and every path ends at the prediction."""
    return _charts(spark, sf, "linear_regression")


# A tree with one split at the quantile of sixteen that divides the labels best.
STUMP = f""", cuts AS (SELECT DISTINCT v FROM (SELECT unnest(quantile_disc(x, [{', '.join(f'{k / 16}::DOUBLE' for k in range(1, 16))}])) AS v,
  max(x) AS top FROM tr) WHERE v < top),
stump AS (SELECT v, a, b FROM (SELECT v, avg(y) FILTER (x <= v) AS a, avg(y) FILTER (x > v) AS b, count(*) FILTER (x <= v) AS na,
  count(*) FILTER (x > v) AS nb FROM tr, cuts GROUP BY v) ORDER BY round(na * a * a + nb * b * b, 6) DESC, v LIMIT 1),
phi AS (SELECT x, CASE WHEN x <= v THEN a ELSE b END AS p, (SELECT avg(CASE WHEN x <= v THEN a ELSE b END) FROM ground, stump) AS base
  FROM shown, stump)"""


@query("explanation_report_tree", with_listing(CHARTS, POINTS, TRAIN, EXPLAINED, STUMP))
def explanation_report_tree(spark, sf):
    """The same of a tree: one split, so that SQL can find it."""
    return _charts(
        spark, sf, "xgboost", n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0, max_bins=16, subsample=1.0, colsample=1.0
    )


@query(
    "explanation_report_deep_tree",
    with_listing(
        f"""SELECT unnest(['waterfall', 'decision']) AS name, least(300, count(*) FILTER (WHERE {TEST_SHARE})) AS rows,
        0.0::DOUBLE AS gap FROM listing"""
    ),
)
def explanation_report_deep_tree(spark, sf):
    """How far the paths of a deep tree end from its predictions (nothing but rounding)."""
    train, test = encoded(spark, sf)
    model = models.build_model("decision_tree").fit(train)
    slots = [str(i) for i in range(model.numFeatures)]
    tables = reports.explanation_tables(Prepared(train, test, slots, slots, PipelineModel([])), model)
    ends = model.transform(test).select("Id", "prediction")
    out = None
    for name in ("waterfall", "decision"):
        last = tables[name].groupBy("Id").agg(F.max_by("running_total", "position").alias("end")).join(ends, "Id")
        own = last.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), r(F.max(F.abs(F.col("end") - F.col("prediction")))).alias("gap"))
        out = own if out is None else out.unionByName(own)
    return out
