"""The driver tables in house shape: one row per order (columns as in ``schema.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import via_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One house per order: attributes from the order, its customer, nation and line items.

    Line items are aggregated on the join key before the join. A query that uses no column of
    them never reads them: the aggregate is unique on the key, so Catalyst drops the outer join.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_totalprice").alias("tp"),
        F.col("o_orderpriority").alias("pr"),
        F.col("o_orderstatus").alias("st"),
        F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"),
        F.pmod(F.col("o_custkey") * 13, F.lit(90)).alias("age"),
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), "c_nationkey"
    )
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nb"))
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    )
    b = orders.join(people, "c").join(places, "c_nationkey").join(lines, "k", "left")

    k, c, y, age, n_lines = F.col("k"), F.col("c"), F.col("y"), F.col("age"), F.col("n_lines")
    no_lines = n_lines.isNull()
    first_floor = 334 + (c * 37) % 1800
    second_floor = F.when(k % 9 < 4, F.lit(0)).otherwise((k * 53) % 1400)
    garage = F.col("qty") * 5
    quality = 1 + (c * 7) % 10
    priority = F.col("pr")
    return b.select(
        k.alias("Id"),
        (20 + 10 * (c % 10)).alias("MSSubClass"),
        F.col("seg").alias("MSZoning"),
        F.col("nb").alias("Neighborhood"),
        F.when(k % 6 != 0, 21 + F.abs("bal") / 100).alias("LotFrontage"),
        F.when(k % 97 == 0, F.lit(0)).otherwise(F.floor(F.col("tp") / 20).cast("int")).alias("LotArea"),
        quality.alias("OverallQual"),
        (1 + k % 9).alias("OverallCond"),
        (y - age).alias("YearBuilt"),
        (y - age + F.least(k % 40, age)).alias("YearRemodAdd"),
        F.when(k % 11 != 0, (k % 300).cast("double")).alias("MasVnrArea"),
        F.when(priority == "1-URGENT", "Ex")
        .when(priority == "2-HIGH", "Gd")
        .when(priority == "3-MEDIUM", "TA")
        .when(priority == "4-NOT SPECIFIED", "Fa")
        .otherwise("Po")
        .alias("ExterQual"),
        F.when(k % 4 == 0, " TA ").when(k % 4 == 1, "Gd").when(k % 4 == 2, "Ex").otherwise("Fa").alias("KitchenQual"),
        F.when(k % 41 != 0, F.when(c % 3 == 0, "Gd").otherwise("TA")).alias("BsmtQual"),
        F.when(F.col("st") == "F", "Gd").when(F.col("st") == "O", "TA").otherwise("Ex").alias("HeatingQC"),
        ((c * 29) % 2000).alias("TotalBsmtSF"),
        first_floor.alias("1stFlrSF"),
        second_floor.alias("2ndFlrSF"),
        (first_floor + second_floor + k % 60).alias("GrLivArea"),
        (c % 2).alias("BsmtFullBath"),
        (1 + k % 3).alias("FullBath"),
        (k % 2).alias("HalfBath"),
        (k % 6).alias("BedroomAbvGr"),
        (3 + k % 10).alias("TotRmsAbvGrd"),
        (k % 4).alias("Fireplaces"),
        F.when(~no_lines, F.least(n_lines, F.lit(4))).alias("GarageCars"),
        garage.alias("GarageArea"),
        F.when(~no_lines, F.when(k % 3 == 0, "Detchd").otherwise("Attchd")).alias("GarageType"),
        F.when(~no_lines, (y - age).cast("double")).alias("GarageYrBlt"),
        F.when(~no_lines, F.lit("TA")).alias("GarageQual"),
        ((k * 17) % 300).alias("WoodDeckSF"),
        ((c * 11) % 200).alias("OpenPorchSF"),
        F.when(k % 200 == 0, 400).otherwise(0).alias("PoolArea"),
        F.when(k % 5 == 0, "MnPrv").alias("Fence"),
        F.col("m").alias("MoSold"),
        y.alias("YrSold"),
        (
            20000
            + 55 * (first_floor + second_floor)
            + 12000 * quality
            + 30 * F.coalesce(garage, F.lit(0.0))
            - 210 * age
            + 0.02 * F.col("tp")
        ).alias("SalePrice"),
    )


def stored_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing as a table of its own, for plans that read it several times: one join, then scans.

    The local test tables are one file of one row group each, so one task would do all the work;
    there the rows are spread. On a cluster the many files of a table already spread them.
    """
    rows = listing(spark, sf_dir)
    if spark.sparkContext.master.startswith("local"):
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return via_table(rows, "listing")


def listing_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing plus copies of every 50th house under new ids (for duplicate removal)."""
    rows = listing(spark, sf_dir)
    copies = rows.where(F.col("Id") % 50 == 0).withColumn("Id", F.col("Id") + 1_000_000_000_000)
    return rows.unionByName(copies)
