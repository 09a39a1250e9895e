import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import cleaning as c


def test_no_missing_cells_after_cleaning(cleaned, houses):
    assert c.missing_counts(cleaned).count() == 0
    assert cleaned.count() == houses.dropDuplicates([x for x in houses.columns if x != "Id"]).count()


def test_absent_part_becomes_none(spark):
    df = spark.createDataFrame(
        [(200000.0, "Gd", 1, 300), (210000.0, "TA", 2, 400), (190000.0, None, 0, 0)],
        "SalePrice double, BsmtQual string, GarageCars int, GarageArea int",
    )
    out = c.HouseCleaner().fit(df).transform(df).where("SalePrice = 190000").first()
    assert out["BsmtQual"] == "None"


def test_outlier_is_capped(spark):
    rng = np.random.default_rng(0)
    values = [float(v) for v in rng.normal(1000, 50, 200)] + [50000.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "Id long, LotArea double")
    out = c.HouseCleaner(iqrMultiplier=1.5).fit(df).transform(df)
    assert out.count() == 201 and out.agg(F.max("LotArea")).first()[0] < 50000


def test_text_is_trimmed(spark):
    df = spark.createDataFrame([("  RL  ",), ("\tRM\n",)], "MSZoning string")
    assert {r[0] for r in c.standardize(df).collect()} == {"RL", "RM"}


def test_transform_needs_fit(spark):
    with pytest.raises(RuntimeError):
        c.HouseCleanerModel().transform(spark.createDataFrame([(1,)], "LotArea int"))


def test_missing_text_gets_learned_mode(spark):
    fit = spark.createDataFrame([("RL",), ("RM",), ("RM",)], "MSZoning string")
    out = c.HouseCleaner().fit(fit).transform(spark.createDataFrame([(None,)], "MSZoning string"))
    assert out.first()[0] == "RM"


def test_mode_ties_and_all_missing(spark):
    df = spark.createDataFrame([("b", None), ("a", None)], "x string, y string")
    assert c.column_modes(df, ["x", "y"]) == {"x": "a", "y": "Unknown"}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "LotFrontage double")
    out = c.HouseCleaner(dedupe=False, capOutliers=False).fit(df).transform(df)
    assert sorted(r[0] for r in out.collect()) == [1.0, 2.0, 3.0]


def test_copies_collapse_to_smallest_id_even_when_hot(spark):
    df = spark.range(3000).select(
        F.col("id").alias("Id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("y"),
    )
    out = c.drop_copies(df)
    assert out.where("y = 'hot'").collect() == [(0, None, "hot")]
    assert out.count() == 1 + 35


def test_report_counts_removed_copies(houses):
    raw = houses.unionByName(houses.where("Id % 50 = 0").withColumn("Id", F.col("Id") + 10**12))
    report = c.cleaning_report(raw, c.HouseCleaner().fit(raw))
    removed = report.where("metric = 'duplicates_removed'").first()["value"]
    assert removed == houses.where("Id % 50 = 0").count()
    assert report.where("stage = 'after' and metric = 'missing'").count() == 0


def test_scoring_mode_keeps_equal_rows(houses):
    model = c.HouseCleaner().fit(houses).for_scoring()
    three = houses.limit(1).drop("SalePrice")
    three = three.unionByName(three).unionByName(three)
    assert model.transform(three).count() == 3


def test_saved_cleaner_is_the_same(houses, tmp_path):
    model = c.HouseCleaner().fit(houses)
    model.save(str(tmp_path / "cleaner"))
    assert c.HouseCleanerModel.load(str(tmp_path / "cleaner")).learned() == model.learned()
