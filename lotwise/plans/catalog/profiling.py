"""Profile and chart-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.operators import profile
from lotwise.operators.gram import correlation_matrix
from lotwise.plans.catalog.registry import bucket, query, r, with_clean, with_derived, with_listing
from lotwise.plans.reports import eda_tables
from lotwise.sources.listing import listing, table

KEYS = "SalePrice GrLivArea TotalBsmtSF 1stFlrSF LotArea LotFrontage GarageArea OverallQual YearBuilt".split()
GROUPS = "Neighborhood MSZoning ExterQual KitchenQual GarageType".split()


def each(template: str, columns) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query(
    "table_profile",
    with_listing(
        """SELECT 'rows' AS metric, count(*) AS value FROM copies UNION ALL SELECT 'columns', 37
        UNION ALL SELECT 'integer_columns', 23 UNION ALL SELECT 'float_columns', 5 UNION ALL SELECT 'string_columns', 9
        UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM copies) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies))""",
        """, copies AS (SELECT * FROM listing UNION ALL SELECT * FROM listing WHERE Id % 50 = 0)""",
    ),
)
def table_profile(spark, sf):
    rows = listing(spark, sf)
    return profile.table_profile(rows.unionByName(rows.where(F.col("Id") % 50 == 0)))


SUMMARY_SQL = """count({y}) AS n, round(avg({y}), 4) AS mean, round(median({y}), 4) AS median,
round(stddev_samp({y}), 4) AS std, round(min({y}), 4) AS min, round(max({y}), 4) AS max, round(skewness({y}), 4) AS skewness"""


def _summary(df, target):
    out = profile.target_summary(df, target)
    return out.select("n", *[r(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "skewness")])


@query("target_summary", with_listing("SELECT " + SUMMARY_SQL.format(y="SalePrice") + " FROM listing"))
def target_summary(spark, sf):
    return _summary(listing(spark, sf), "SalePrice")


@query("events_value_summary", "SELECT " + SUMMARY_SQL.format(y="value") + " FROM events")
def events_value_summary(spark, sf):
    return _summary(table(spark, sf, "events"), "value")


NUMBERS = "LotFrontage LotArea OverallQual GrLivArea GarageArea TotalBsmtSF PoolArea SalePrice".split()


@query(
    "outlier_profile",
    with_listing(
        """SELECT "column", outliers FROM ("""
        + each(
            """SELECT '{c}' AS "column", count(*) FILTER (WHERE v < q1 - 0.7 * (q3 - q1) OR v > q3 + 0.7 * (q3 - q1)) AS outliers
            FROM (SELECT CAST("{c}" AS DOUBLE) AS v FROM listing), (SELECT quantile_cont(CAST("{c}" AS DOUBLE), 0.25) AS q1,
            quantile_cont(CAST("{c}" AS DOUBLE), 0.75) AS q3 FROM listing) WHERE q1 <> q3""",
            NUMBERS,
        )
        + ") WHERE outliers > 0"
    ),
)
def outlier_profile(spark, sf):
    return profile.outlier_profile(listing(spark, sf).select("Id", *NUMBERS), k=0.7)


def hist_sql(c: str, bins: int, source: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(bin AS INT) AS bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high,
      count(*) AS count FROM (SELECT least(floor((v - lo) / w), {bins - 1}) AS bin, lo, w FROM
        (SELECT CAST("{c}" AS DOUBLE) AS v FROM {source} WHERE "{c}" IS NOT NULL),
        (SELECT CAST(min("{c}") AS DOUBLE) AS lo, (CAST(max("{c}") AS DOUBLE) - CAST(min("{c}") AS DOUBLE)) / {bins} AS w FROM {source}))
      GROUP BY bin, lo, w"""


def _hist(df):
    return df.select("column", "bin", r("low", 4).alias("low"), r("high", 4).alias("high"), "count")


@query("hist_equal_width", with_listing(" UNION ALL ".join(hist_sql(c, 30, "listing") for c in KEYS)))
def hist_equal_width(spark, sf):
    return _hist(profile.histograms(listing(spark, sf), KEYS, 30))


@query("hist_log_target", with_listing(hist_sql("logged", 30, "(SELECT ln(1 + SalePrice) AS logged FROM listing)")))
def hist_log_target(spark, sf):
    logged = listing(spark, sf).select(F.log1p("SalePrice").alias("logged"))
    return _hist(profile.histograms(logged, ["logged"], 30))


LINES = "l_quantity l_extendedprice l_discount".split()


@query("hist_lines", " UNION ALL ".join(hist_sql(c, 40, "lineitem") for c in ("l_extendedprice", "l_tax")))
def hist_lines(spark, sf):
    return _hist(profile.histograms(table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], 40))


def box_sql(columns, source):
    return each(
        f"""SELECT '{{c}}' AS "column", round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
        round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
        round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
        count(*) FILTER (WHERE NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT CAST("{{c}}" AS DOUBLE) AS v FROM {source}), (SELECT quantile_cont(CAST("{{c}}" AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST("{{c}}" AS DOUBLE), 0.5) AS q2, quantile_cont(CAST("{{c}}" AS DOUBLE), 0.75) AS q3 FROM {source})""",
        columns,
    )


def _box(df):
    return df.select(
        "column", *[r(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers"
    )


@query("box_stats", with_listing(box_sql(KEYS, "listing")))
def box_stats(spark, sf):
    return _box(profile.box_stats(listing(spark, sf).select(*[col(c) for c in KEYS]), KEYS))


@query("box_lines", box_sql(LINES, "lineitem"))
def box_lines(spark, sf):
    return _box(profile.box_stats(table(spark, sf, "lineitem").select(*LINES), LINES))


@query(
    "missing_map",
    with_listing(
        """SELECT bucket, "column", missing FROM ("""
        + each(
            f"""SELECT CAST({bucket('Id', 20, 42)} AS INT) AS bucket, '{{c}}' AS "column",
            count(*) FILTER (WHERE "{{c}}" IS NULL) AS missing FROM listing GROUP BY 1""",
            "LotFrontage MasVnrArea BsmtQual GarageCars GarageArea GarageType GarageYrBlt GarageQual Fence".split(),
        )
        + ") WHERE missing > 0"
    ),
)
def missing_map(spark, sf):
    return profile.missing_map(listing(spark, sf))


@query(
    "missing_cells",
    with_listing(
        """SELECT Id, CAST(LotFrontage IS NULL AS INT) AS LotFrontage, CAST(Fence IS NULL AS INT) AS Fence,
        CAST(GarageCars IS NULL AS INT) AS GarageCars FROM listing"""
    ),
)
def missing_cells(spark, sf):
    return profile.missing_cells(listing(spark, sf).select("Id", "LotFrontage", "Fence", "GarageCars"))


MATRIX = "LotFrontage LotArea OverallQual YearBuilt GrLivArea GarageArea MasVnrArea SalePrice".split()


@query(
    "corr_matrix",
    with_listing(
        " UNION ALL ".join(
            f"""SELECT '{a}' AS a, '{b}' AS b, round(corr("{a}", "{b}"), 6) AS correlation FROM listing"""
            for a in MATRIX
            for b in MATRIX
        )
    ),
)
def corr_matrix(spark, sf):
    return correlation_matrix(listing(spark, sf), MATRIX).select("a", "b", r("correlation").alias("correlation"))


@query(
    "corr_top",
    with_listing(
        """SELECT a, b, correlation FROM m WHERE a IN (SELECT a FROM m WHERE b = 'SalePrice' ORDER BY abs(correlation) DESC LIMIT 4)
        AND b IN (SELECT a FROM m WHERE b = 'SalePrice' ORDER BY abs(correlation) DESC LIMIT 4)""",
        # One aggregate for the whole matrix, kept for its three readers.
        ", m AS MATERIALIZED (SELECT unnest(['"
        + "', '".join(a for a in MATRIX for _ in MATRIX)
        + "']) AS a, unnest(['"
        + "', '".join(b for _ in MATRIX for b in MATRIX)
        + "']) AS b, unnest(["
        + ", ".join(f'round(corr("{a}", "{b}"), 6)' for a in MATRIX for b in MATRIX)
        + "]) AS correlation FROM listing)",
    ),
)
def corr_top(spark, sf):
    rows = listing(spark, sf).select(*MATRIX)
    return profile.top_correlated(rows, n=4).select("a", "b", r("correlation").alias("correlation"))


@query(
    "scatter_pairs",
    with_listing(
        each(
            """SELECT '{c}' AS "column", CAST("{c}" AS DOUBLE) AS x, round(SalePrice, 4) AS y FROM listing""",
            ["GrLivArea", "TotalBsmtSF", "YearBuilt", "OverallQual"],
        )
    ),
)
def scatter_pairs(spark, sf):
    pairs = profile.scatter(listing(spark, sf), ["GrLivArea", "TotalBsmtSF", "YearBuilt", "OverallQual"])
    return pairs.select("column", "x", r("y", 4).alias("y"))


@query(
    "scatter_sample",
    with_listing(
        f"""SELECT Id, GrLivArea, round(SalePrice, 4) AS SalePrice, OverallQual, TotalBsmtSF, Neighborhood, YearBuilt FROM listing
        ORDER BY {bucket('Id', 4294967296, 42)}, Id LIMIT 800"""
    ),
)
def scatter_sample(spark, sf):
    rows = listing(spark, sf).select(
        "Id", "GrLivArea", r("SalePrice", 4).alias("SalePrice"), "OverallQual", "TotalBsmtSF", "Neighborhood", "YearBuilt"
    )
    return profile.sample_rows(rows, 800)


@query(
    "pair_sample",
    f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY {bucket('o_orderkey', 4294967296, 42)}, o_orderkey LIMIT 500""",
)
def pair_sample(spark, sf):
    return profile.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 500, key="o_orderkey")


def group_box_sql(group: str, source: str, value: str = "SalePrice") -> str:
    q = ", ".join(
        f"round(quantile_cont({value}, {p}), 4) AS {n}"
        for n, p in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))
    )
    return f'SELECT CAST("{group}" AS VARCHAR) AS category, {q}, count({value}) AS count FROM {source} GROUP BY "{group}"'


def _group_box(df):
    return df.select(
        F.col("category").cast("string").alias("category"),
        *[r(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high")],
        "count",
    )


@query("group_box_neighborhood", with_listing(group_box_sql("Neighborhood", "listing")))
def group_box_neighborhood(spark, sf):
    return _group_box(profile.group_box(listing(spark, sf), "Neighborhood"))


@query("group_box_garage", with_listing(group_box_sql("GarageCars", "listing")))
def group_box_garage(spark, sf):
    """One group here is missing and one holds nearly all rows."""
    return _group_box(profile.group_box(listing(spark, sf), "GarageCars"))


@query("group_box_lines", group_box_sql("l_returnflag", "lineitem", "l_extendedprice"))
def group_box_lines(spark, sf):
    return _group_box(profile.group_box(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


@query(
    "value_counts",
    with_clean(each("""SELECT '{c}' AS "column", "{c}" AS value, count(*) AS count FROM clean GROUP BY 2""", GROUPS)),
)
def value_counts(spark, sf):
    from lotwise.operators.cleaning import fill_absent, standardize

    return profile.category_counts(fill_absent(standardize(listing(spark, sf).select(*GROUPS))), GROUPS)


@query(
    "cardinalities",
    with_listing(each("""SELECT '{c}' AS "column", count(DISTINCT "{c}") AS distinct_values FROM listing""", [*GROUPS, "YearBuilt"])),
)
def cardinalities(spark, sf):
    return profile.cardinalities(listing(spark, sf), [*GROUPS, "YearBuilt"])


@query(
    "group_shapes",
    with_listing(
        """SELECT OverallQual AS category, CAST(least(floor((SalePrice - lo) / w), 29) AS INT) AS bin, count(*) AS count FROM listing,
        (SELECT min(SalePrice) AS lo, (max(SalePrice) - min(SalePrice)) / 30 AS w FROM listing) GROUP BY 1, 2"""
    ),
)
def group_shapes(spark, sf):
    return profile.group_shapes(listing(spark, sf), "OverallQual", "SalePrice", 30)


@query(
    "median_trend",
    with_listing("""SELECT YearBuilt, round(median(SalePrice), 4) AS median FROM listing GROUP BY YearBuilt ORDER BY YearBuilt"""),
)
def median_trend(spark, sf):
    trend = profile.group_median(listing(spark, sf), "YearBuilt", descending=False)
    return trend.select("YearBuilt", r("median", 4).alias("median"))


@query(
    "market_view",
    with_listing("""SELECT Neighborhood, round(median(SalePrice), 4) AS median FROM listing GROUP BY 1 ORDER BY median DESC, 1"""),
)
def market_view(spark, sf):
    view = profile.group_median(listing(spark, sf), "Neighborhood")
    return view.select("Neighborhood", r("median", 4).alias("median"))


@query(
    "cleaned_market_view",
    with_derived(
        """SELECT Neighborhood, PropertySizeCategory, round(avg(NeighborhoodQualityScore), 6) AS quality,
        round(avg(GarageRatio), 6) AS garage_ratio, round(median(SalePrice), 4) AS median, count(*) AS houses FROM derived
        GROUP BY Neighborhood, PropertySizeCategory"""
    ),
)
def cleaned_market_view(spark, sf):
    """The flagship: raw table, learned fills, derived columns, frame statistics, grouped medians."""
    from lotwise.functions.quantiles import grouped_quantiles
    from lotwise.operators.features import engineer_features
    from lotwise.plans.catalog.deriving import cleaned
    from lotwise.session import via_table

    needed = """Id Neighborhood OverallQual GrLivArea TotalBsmtSF GarageArea LotArea 1stFlrSF 2ndFlrSF OpenPorchSF WoodDeckSF
    LotFrontage SalePrice""".split()
    derived = engineer_features(cleaned(spark, sf, *needed)).select(
        "Neighborhood", "PropertySizeCategory", "NeighborhoodQualityScore", "GarageRatio", "SalePrice"
    )
    derived = via_table(derived, "market")
    keys = ["Neighborhood", "PropertySizeCategory"]
    medians = grouped_quantiles(derived, keys, "SalePrice", {"median": 0.5})
    means = derived.groupBy(*keys).agg(
        F.avg("NeighborhoodQualityScore").alias("quality"),
        F.avg("GarageRatio").alias("garage_ratio"),
        F.count(F.lit(1)).alias("houses"),
    )
    return means.join(medians, keys).select(
        *keys, r("quality").alias("quality"), r("garage_ratio").alias("garage_ratio"), r("median", 4).alias("median"), "houses"
    )


@query(
    "describe",
    with_listing(
        each(
            """SELECT '{c}' AS "column", count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
            round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50,
            round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max FROM (SELECT CAST("{c}" AS DOUBLE) AS v FROM listing)""",
            KEYS,
        )
    ),
)
def describe(spark, sf):
    out = profile.describe(listing(spark, sf).select(*[col(c) for c in KEYS]), KEYS)
    return out.select("column", "count", *[r(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("eda_report")
def eda_report(spark, sf):
    """Every exploration table of the cleaned, derived rows: names and row counts."""
    from lotwise.operators.features import engineer_features
    from lotwise.plans.catalog.deriving import cleaned
    from lotwise.session import via_table

    rows = via_table(engineer_features(cleaned(spark, sf)), "engineered")
    out = None
    for name, t in eda_tables(rows).items():
        one = t.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "duplicate_profile",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS copies
    FROM lineitem""",
)
def duplicate_profile(spark, sf):
    out = profile.table_profile(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))
    return out.agg(
        F.max(F.when(F.col("metric") == "rows", F.col("value"))).alias("rows"),
        F.max(F.when(F.col("metric") == "duplicate_rows", F.col("value"))).alias("copies"),
    )


