import math

from pyspark.sql import functions as F

from lotwise.functions.scalar import col, pearson
from lotwise.operators import metrics, profile
from lotwise.operators.gram import correlation_matrix, target_correlations
from lotwise.schema import numeric_columns


def test_histogram_counts_every_row(houses):
    out = profile.histograms(houses, ["SalePrice", "LotFrontage"], 30)
    sums = {r["column"]: r["n"] for r in out.groupBy("column").agg(F.sum("count").alias("n")).collect()}
    assert sums == {"SalePrice": houses.count(), "LotFrontage": houses.where("LotFrontage is not null").count()}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["correlation"] for r in correlation_matrix(df, ["a", "b"]).collect()}
    assert math.isclose(got[("a", "a")], 1.0) and got[("a", "b")] is None and len(got) == 4
    assert profile.histograms(df, ["b"], 4).first()["count"] == 3


def test_target_correlations_share_one_aggregate(spark, houses):
    columns = numeric_columns(houses.schema)
    found = target_correlations(houses, columns, "SalePrice")
    want = houses.agg(*[pearson(col(c), col("SalePrice")).alias(c) for c in columns]).first()
    got = {r["feature"]: r["correlation"] for r in found.collect()}
    assert list(got) == columns
    for c in columns:
        assert (got[c] is None) == (want[c] is None) and (got[c] is None or math.isclose(got[c], want[c], abs_tol=1e-12))
    # The aggregate is as long for one column as for all of them.
    plans = [target_correlations(houses, cs, "SalePrice")._jdf.queryExecution().optimizedPlan().toString() for cs in (columns[:1], columns)]
    assert plans[0].count("covar_pop(") == plans[1].count("covar_pop(") == 1


def test_target_correlations_without_values(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 2.0), (2.0, 5.0, None, 4.0), (None, 5.0, 1.0, 7.0)], "a double, b double, c double, y double")
    got = {r["feature"]: r["correlation"] for r in target_correlations(df, ["a", "b", "c"], "y").collect()}
    assert math.isclose(got["a"], 1.0) and got["b"] is None and got["c"] is None
    empty = target_correlations(df.where("false"), ["a", "b"], "y").collect()
    assert [(r["feature"], r["correlation"]) for r in empty] == [("a", None), ("b", None)]


def test_profile_of_copies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    got = {r["metric"]: r["value"] for r in profile.table_profile(df).collect()}
    assert got["rows"] == 3 and got["duplicate_rows"] == 1


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p", 5).first()
    assert row["mape"] == 50.0 and row["adjusted_r2"] == row["r2"] == 0.0


def test_missing_groups_keep_their_box(houses):
    boxes = profile.group_box(houses, "GarageCars").collect()
    assert sum(r["count"] for r in boxes) == houses.count()
    medians = [r["median"] for r in boxes]
    assert medians == sorted(medians, reverse=True)
