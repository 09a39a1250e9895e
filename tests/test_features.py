import pytest
from pyspark.sql import functions as F

from lotwise.functions.joins import lookup_join
from lotwise.operators import features as f


def test_ages_are_not_negative(engineered):
    assert engineered.where("HouseAge < 0 or RemodAge < 0 or GarageAge < 0").count() == 0


def test_total_bathrooms(spark):
    df = spark.createDataFrame([(2, 1, 1, 0)], "FullBath int, HalfBath int, BsmtFullBath int, BsmtHalfBath int")
    assert f.room_features(df).first()["TotalBathrooms"] == 3.5


def test_quality_index_range(engineered):
    low, high = engineered.agg(F.min("ConstructionQualityIndex"), F.max("ConstructionQualityIndex")).first()
    assert 0 <= low <= high <= 5


def test_size_class_is_known(engineered):
    assert engineered.where("PropertySizeCategory is null").count() == 0


@pytest.mark.parametrize("area,label", [(900, "Compact"), (901, "Small"), (1400, "Small"), (2000, "Medium"), (2801, "Estate")])
def test_size_class_is_right_closed(spark, area, label):
    df = spark.createDataFrame([(area,)], "GrLivArea int")
    assert f.luxury_features(df, None).first()["PropertySizeCategory"] == label


def test_group_mean_comes_back_to_rows(spark):
    df = spark.createDataFrame([("A", 4), ("A", 6), ("B", 8)], "Neighborhood string, OverallQual int")
    out = [r["NeighborhoodQualityScore"] for r in f.add_features(df).orderBy("OverallQual").collect()]
    assert out == [5.0, 5.0, 8.0]


def test_more_columns_out_than_in(engineered, cleaned):
    assert len(engineered.columns) == len(cleaned.columns) + 19


def test_missing_and_zero_inputs(spark):
    df = spark.createDataFrame(
        [(0, 100.0, None), (50, None, 0)], "LotArea int, GarageArea double, GarageYrBlt int"
    ).withColumn("YrSold", F.lit(2008))
    rows = f.age_features(f.area_features(df)).collect()
    assert [r["GarageRatio"] for r in rows] == [0.0, 0.0]
    assert [r["GarageAge"] for r in rows] == [0.0, 2008.0]
    assert f.age_features(df, absent_garage_age=0).collect()[1]["GarageAge"] == 0.0


def test_fitted_statistics_and_unseen_group(spark, tmp_path):
    train = spark.createDataFrame(
        [("A", 4, 10, 0, 5, 5), ("A", 6, 20, 0, 5, 5)],
        "Neighborhood string, OverallQual int, OpenPorchSF int, WoodDeckSF int, `1stFlrSF` int, `2ndFlrSF` int",
    )
    model = f.FeatureBuilder().fit(train)
    model.save(str(tmp_path / "builder"))
    model = f.FeatureBuilderModel.load(str(tmp_path / "builder"))
    one = train.limit(1).withColumn("Neighborhood", F.lit("new")).withColumn("OpenPorchSF", F.lit(16))
    row = model.transform(one).first()
    assert row["NeighborhoodQualityScore"] == row["OverallQual"] and row["LuxuryScore"] == 1


def test_lookup_join_beyond_the_broadcast_bound(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    a = lookup_join(rows, lookup, ["k"]).orderBy("id").collect()
    b = lookup_join(rows, lookup, ["k"], max_bytes=0).orderBy("id").collect()
    assert a == b and len(a) == 1000


def test_rows_to_learn_from_are_joined_once(spark, sf):
    """Fills, encoders and models read the rows some ten times: those are scans of a table, not joins."""
    from lotwise.plans.catalog.deriving import cleaned as filled
    from lotwise.sources.listing import listing

    rows = filled(spark, sf, "Id", "LotFrontage", "GarageArea")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert rows.columns == ["Id", "LotFrontage", "GarageArea"] and rows.count() == listing(spark, sf).count()
