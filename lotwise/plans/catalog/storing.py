"""Readers and writers, each as a round trip over the whole table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lotwise.operators import metrics, models
from lotwise.plans.catalog.comparing import GUESS_SQL, MEASURES, _rounded, encoded, guesses
from lotwise.plans.catalog.registry import query, r, with_listing
from lotwise.plans.catalog.scoring import formula
from lotwise.plans.training import run_training
from lotwise.session import work_path
from lotwise.sources import files
from lotwise.sources.listing import listing, stored_listing

COLUMNS = "Id LotFrontage LotArea GarageCars GarageYrBlt Fence BsmtQual KitchenQual SalePrice".split()


@query(
    "csv_scan",
    with_listing(
        """SELECT Id::INT AS Id, CASE WHEN Id % 4 <> 0 THEN round(LotFrontage, 4) END AS LotFrontage, LotArea::INT AS LotArea,
        GarageCars::INT AS GarageCars, GarageYrBlt, CASE WHEN Id % 3 <> 0 THEN Fence END AS Fence, BsmtQual, KitchenQual,
        round(SalePrice, 4) AS SalePrice FROM listing"""
    ),
)
def csv_scan(spark, sf):
    """Missing cells are written as several tokens; all must come back as missing."""
    path = work_path(spark, "houses") + ".csv"
    rows = listing(spark, sf).select(*COLUMNS)
    text = rows.select(
        F.col("Id"),
        F.when(F.col("Id") % 4 == 0, "nan").otherwise(F.col("LotFrontage").cast("string")).alias("LotFrontage"),
        "LotArea",
        F.coalesce(F.col("GarageCars").cast("double").cast("string"), F.lit("NA")).alias("GarageCars"),
        F.coalesce(F.col("GarageYrBlt").cast("string"), F.lit("NULL")).alias("GarageYrBlt"),
        F.when(F.col("Id") % 3 == 0, "None").otherwise(F.coalesce("Fence", F.lit("N/A"))).alias("Fence"),
        "BsmtQual",
        "KitchenQual",
        "SalePrice",
    )
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = files.read_house_csv(spark, path)
    return back.withColumn("LotFrontage", r("LotFrontage", 4)).withColumn("SalePrice", r("SalePrice", 4))


@query(
    "resolve_source",
    with_listing("SELECT count(*) AS n, round(sum(SalePrice), 2) AS total FROM listing"),
)
def resolve_source(spark, sf):
    """Of three candidates only the last exists; the second call reads the cache."""
    real, cache = work_path(spark, "mirror"), work_path(spark, "cache")
    files.write_table(listing(spark, sf), real)
    missing = [work_path(spark, "nothing"), work_path(spark, "nothing") + ".csv", real]
    files.resolve_source(spark, cache, missing)
    again = files.resolve_source(spark, cache, [])
    return again.agg(F.count(F.lit(1)).alias("n"), r(F.sum("SalePrice"), 2).alias("total"))


@query("csv_sink", with_listing("SELECT Id::INT AS Id, round(SalePrice, 4) AS SalePrice FROM listing"))
def csv_sink(spark, sf):
    path = work_path(spark, "sink") + ".csv"
    files.write_table(listing(spark, sf).select("Id", "SalePrice"), path, "csv")
    return files.read_house_csv(spark, path).select("Id", r("SalePrice", 4).alias("SalePrice"))


@query(
    "leaderboard_round_trip",
    with_listing(
        f"SELECT name, mae, rmse, r2, mape, row_number() OVER (ORDER BY rmse) AS position FROM (SELECT name, {MEASURES} FROM g GROUP BY name)",
        GUESS_SQL,
    ),
)
def leaderboard_round_trip(spark, sf):
    path = work_path(spark, "leaderboard")
    board = _rounded(metrics.regression_metrics(guesses(spark, sf), "SalePrice", "predicted", 12, ["name"]), "name")
    files.save_leaderboard(metrics.ranked(board), path)
    back = files.read_leaderboard(spark, path)
    return back.select("name", "mae", "rmse", "r2", "mape", F.col("position").cast("long").alias("position"))


@query(
    "model_round_trip",
    with_listing("SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference FROM listing"),
)
def model_round_trip(spark, sf):
    """Saved and loaded, the pipeline (fills, lookup table, model) gives the same predictions."""
    path = work_path(spark, "pipeline")
    houses = stored_listing(spark, sf)
    before = formula(houses)
    before.write().overwrite().save(path)
    after = PipelineModel.load(path)
    rows = houses.drop("SalePrice")
    a = before.transform(rows).select("Id", F.col("prediction").alias("a"))
    b = after.transform(rows).select("Id", F.col("prediction").alias("b"))
    joined = a.join(b, "Id")
    return joined.agg(F.count(F.lit(1)).alias("n"), r(F.max(F.abs(F.col("a") - F.col("b")))).alias("largest_difference"))


@query("run_log")
def run_log(spark, sf):
    path = work_path(spark, "runs")
    train, test = encoded(spark, sf)
    for name in ("ridge", "lasso"):
        model = models.build_model(name).fit(train)
        priced = model.transform(test).select("SalePrice", F.expm1("prediction").alias("p"))
        row = metrics.regression_metrics(priced, "SalePrice", "p", 7).first().asDict()
        params = {p.name: v for p, v in model.extractParamMap().items()}
        files.log_runs(spark, [(name, params, row)], path)
    return files.read_runs(spark, path).select("model", F.size("params").alias("params"), F.col("metrics")["rmse"].alias("rmse"))


@query("saved_winner_scores")
def saved_winner_scores(spark, sf):
    """Train, save, load in a new pipeline and score the whole table with the saved error."""
    from lotwise.operators.scoring import best_rmse, score
    from lotwise.plans.training import load_scorer

    path = work_path(spark, "winner")
    houses = stored_listing(spark, sf)
    best, _ = run_training(houses, path, {"ridge": models.build_model("ridge")}, folds=2)
    pipeline, board = load_scorer(spark, path)
    return score(houses.drop("SalePrice"), pipeline, best, best_rmse(board, best), "Id")
