"""Requests, prices, the stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from lotwise.operators import scoring as ops
from lotwise.operators.cleaning import HouseCleaner
from lotwise.operators.features import FeatureBuilder
from lotwise.operators.splits import align
from lotwise.plans.catalog.registry import query, r, with_listing
from lotwise.schema import REQUEST_RANGES, REQUEST_REQUIRED, request_schema
from lotwise.session import via_table, work_path
from lotwise.sources.files import parse_batches, parse_requests
from lotwise.sources.listing import listing, stored_listing
from lotwise.streaming.scoring import read_request_stream, score_stream


def requests(spark, sf, rows=None):
    """The listing as clients would send it: alias names, no target, a style for most houses."""
    return (
        (listing(spark, sf) if rows is None else rows)
        .drop("SalePrice")
        .withColumnRenamed("1stFlrSF", "FirstFlrSF")
        .withColumnRenamed("2ndFlrSF", "SecondFlrSF")
        .withColumn("HouseStyle", F.when(F.col("Id") % 23 != 0, F.lit("2Story")))
    )


def _rules_sql(faults: dict[str, str] | None = None) -> str:
    """``faults``: SQL that says why a cell of a field cannot be read, NULL if it can."""
    checks, faults = [], faults or {}
    for name in request_schema().names:
        known = name not in ("Street", "LotShape", "LandContour", "Utilities", "BldgType", "RoofStyle", "Exterior1st")
        fault = faults.get(name, "NULL")
        if name in faults:
            checks.append(f"CASE WHEN ({fault}) IS NOT NULL THEN '{name}: ' || ({fault}) END")
        if name in REQUEST_REQUIRED:
            checks.append(f"""CASE WHEN "{name}" IS NULL AND ({fault}) IS NULL THEN '{name}: missing' END""")
        if name in REQUEST_RANGES and known:
            low, high = REQUEST_RANGES[name]
            bad = " OR ".join([f'"{name}" < {low}'] * (low is not None) + [f'"{name}" > {high}'] * (high is not None))
            checks.append(f"""CASE WHEN {bad} THEN '{name}: out of range' END""")
        if name == "YearRemodAdd":
            checks.append("""CASE WHEN YearRemodAdd < YearBuilt THEN 'YearRemodAdd: before YearBuilt' END""")
    return f"list_filter([{', '.join(checks)}], lambda e: e IS NOT NULL)"


REQUEST_CTE = f""", req AS (SELECT *, CASE WHEN Id % 23 <> 0 THEN '2Story' END AS HouseStyle FROM listing),
checked AS (SELECT *, {_rules_sql()} AS errors FROM req)
"""


@query(
    "validate_requests",
    with_listing("SELECT Id, array_to_string(errors, '|') AS errors, len(errors) = 0 AS valid FROM checked", REQUEST_CTE),
)
def validate_requests(spark, sf):
    checked = ops.validated(requests(spark, sf))
    return checked.select("Id", F.array_join("errors", "|").alias("errors"), (F.size("errors") == 0).alias("valid"))


BROKEN = {
    "OverallQual": "CASE Id % 31 WHEN 0 THEN 'not a number' WHEN 1 THEN 'not a whole number' END",
    "LotArea": "CASE WHEN Id % 37 = 0 THEN 'out of range' END",
}
BROKEN_CTE = f""", req AS (SELECT * REPLACE (CASE WHEN Id % 31 > 1 THEN OverallQual END AS OverallQual,
    CASE WHEN Id % 37 > 0 THEN LotArea END AS LotArea), CASE WHEN Id % 23 <> 0 THEN '2Story' END AS HouseStyle FROM listing),
checked AS (SELECT *, {_rules_sql(BROKEN)} AS errors FROM req)
"""


def with_broken_cells(rows):
    """A word, a fraction and a number beyond the type in columns of whole numbers."""
    quality = F.when(F.col("Id") % 31 == 0, "abc").when(F.col("Id") % 31 == 1, "7.9").otherwise(F.col("OverallQual").cast("string"))
    area = F.when(F.col("Id") % 37 == 0, "3000000000").otherwise(F.col("LotArea").cast("string"))
    return rows.withColumns({"OverallQual": quality, "LotArea": area})


@query(
    "broken_cells",
    with_listing("SELECT Id, array_to_string(errors, '|') AS errors, len(errors) = 0 AS valid FROM checked", BROKEN_CTE),
)
def broken_cells(spark, sf):
    """Every request is either valid or in the quarantine, whatever its cells hold."""
    good, bad = ops.split_valid(via_table(ops.validated(with_broken_cells(requests(spark, sf))), "checked"), "Id")
    good = good.select("Id", F.lit("").alias("errors"), F.lit(True).alias("valid"))
    return good.unionByName(bad.select("Id", F.array_join("errors", "|").alias("errors"), F.lit(False).alias("valid")))


@query(
    "broken_json_requests",
    with_listing(
        """SELECT Id, Id % 7 = 0 OR Id % 11 = 0 AS unread, CASE WHEN Id % 7 = 0 OR Id % 11 = 0 THEN NULL WHEN Id % 5 = 0 THEN NULL
           ELSE 'TA' END AS BsmtQual, CASE WHEN Id % 7 = 0 OR Id % 11 = 0 THEN NULL ELSE CAST(OverallQual AS INT) END AS OverallQual,
           CASE WHEN Id % 7 = 0 OR Id % 11 = 0 THEN '' WHEN Id % 5 = 0 THEN 'GrLivArea: not a number' ELSE '' END AS about_area
           FROM listing"""
    ),
)
def broken_json_requests(spark, sf):
    """Broken text, a property that is no object, a list in place of a number, an explicit null for a default."""
    number = F.col("OverallQual").cast("string")
    whole = F.concat(F.lit('{"property": {"OverallQual": '), number, F.lit("}}"))
    odd = F.concat(F.lit('{"property": {"GrLivArea": [1, 2], "BsmtQual": null, "OverallQual": '), number, F.lit("}}"))
    body = (
        F.when(F.col("Id") % 7 == 0, F.lit('{"property": {"OverallQual": 7'))
        .when(F.col("Id") % 11 == 0, F.lit('{"property": 17}'))
        .when(F.col("Id") % 5 == 0, odd)
        .otherwise(whole)
    )
    checked = ops.validated(parse_requests(listing(spark, sf).select("Id", body.alias("value"))))
    unread = F.col("corrupt").isNotNull()
    return checked.select(
        "Id",
        unread.alias("unread"),
        F.when(~unread, F.col("BsmtQual")).alias("BsmtQual"),
        "OverallQual",
        F.array_join(F.filter("errors", lambda e: F.startswith(e, F.lit("GrLivArea: not"))), "|").alias("about_area"),
    )


@query(
    "quarantine",
    with_listing("SELECT unnest(errors) AS error, count(*) AS requests FROM checked WHERE len(errors) > 0 GROUP BY 1", REQUEST_CTE),
)
def quarantine(spark, sf):
    _, bad = ops.split_valid(via_table(ops.validated(requests(spark, sf)), "checked"), "Id")
    return bad.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "request_defaults",
    with_listing(
        """SELECT Id, 'Pave' AS Street, '1Fam' AS BldgType, coalesce(GarageType, 'None') AS GarageType,
        CAST(coalesce(GarageCars, 0) AS INT) AS GarageCars, coalesce(BsmtQual, 'TA') AS BsmtQual,
        CAST("1stFlrSF" AS DOUBLE) AS "1stFlrSF" FROM listing"""
    ),
)
def request_defaults(spark, sf):
    filled = ops.fill_defaults(ops.to_request(requests(spark, sf)))
    return filled.select("Id", "Street", "BldgType", "GarageType", "GarageCars", "BsmtQual", "`1stFlrSF`")


def formula(rows) -> PipelineModel:
    """A stand-in model that SQL can repeat: fills and derived columns are the real stages."""
    cleaner = HouseCleaner().fit(rows).for_scoring()
    builder = FeatureBuilder().fit(cleaner.transform(rows))
    line = SQLTransformer(
        statement="SELECT *, 10.5D + 0.0002D * TotalSF + 0.05D * OverallQual + 0.01D * LuxuryScore AS prediction FROM __THIS__"
    )
    return PipelineModel([cleaner, builder, line])


PRICED_CTE = """, priced AS (SELECT Id, greatest(exp(10.5::DOUBLE + 0.0002::DOUBLE * ("1stFlrSF" + "2ndFlrSF" + TotalBsmtSF)
   + 0.05::DOUBLE * OverallQual + 0.01::DOUBLE * (CASE WHEN PoolArea > 0 THEN 2 ELSE 0 END + least(Fireplaces, 2)
   + CASE WHEN coalesce(GarageCars, 0) >= 3 THEN 2 ELSE 0 END
   + CASE WHEN OpenPorchSF + WoodDeckSF > (SELECT median(OpenPorchSF + WoodDeckSF) FROM listing) THEN 1 ELSE 0 END)) - 1, 0) AS p
   FROM checked WHERE len(errors) = 0)"""
PRICES = """round(p, 2) AS predicted_price, round(greatest(p - 1.5 * 40000.0, 0), 2) AS confidence_interval_low,
round(p + 1.5 * 40000.0, 2) AS confidence_interval_high"""


@query("score_batch", with_listing(f"SELECT Id, {PRICES}, 'formula' AS model_name FROM priced", REQUEST_CTE, PRICED_CTE))
def score_batch(spark, sf):
    rows = stored_listing(spark, sf)
    return ops.score_requests(requests(spark, sf, rows), formula(rows), "formula", 40000.0, "Id")[0]


@query(
    "score_gauge",
    with_listing(
        f"""SELECT Id, round(least(greatest((predicted_price - confidence_interval_low)
          / greatest(confidence_interval_high - confidence_interval_low, 1), 0), 1), 4) AS position FROM (SELECT Id, {PRICES} FROM priced)""",
        REQUEST_CTE,
        PRICED_CTE,
    ),
)
def score_gauge(spark, sf):
    return ops.gauge(score_batch(spark, sf)).select("Id", r("position", 4).alias("position"))


@query(
    "request_row",
    with_listing(
        """SELECT Id, "1stFlrSF" + "2ndFlrSF" + TotalBsmtSF AS TotalSF, coalesce(BsmtQual, 'None') AS BsmtQual, 0 AS NotThere,
        round(coalesce(LotFrontage, (SELECT median(LotFrontage) FROM listing)), 6) AS LotFrontage FROM listing"""
    ),
)
def request_row(spark, sf):
    """Clean (nothing capped, equal rows kept), derive, align."""
    rows = stored_listing(spark, sf)
    out = PipelineModel(formula(rows).stages[:2]).transform(rows.drop("SalePrice"))
    out = align(out, ["Id", "TotalSF", "BsmtQual", "NotThere", "LotFrontage"])
    return out.withColumn("LotFrontage", r("LotFrontage"))


@query(
    "parse_requests",
    with_listing(
        """SELECT Id, CAST("1stFlrSF" AS DOUBLE) AS "1stFlrSF", CAST(OverallQual AS INT) AS OverallQual, Id % 2 = 0 AS explain FROM listing"""
    ),
)
def parse_json_requests(spark, sf):
    body = F.to_json(
        F.struct(
            F.struct(F.col("1stFlrSF").alias("FirstFlrSF"), "OverallQual").alias("property"),
            F.when(F.col("Id") % 2 == 0, True).alias("explain"),
        )
    )
    parsed = parse_requests(listing(spark, sf).select("Id", body.alias("value")))
    return ops.to_request(parsed).select("Id", "`1stFlrSF`", "OverallQual", "explain")


@query(
    "batch_failed_rows",
    with_listing(
        """SELECT batch, row_index, OverallQual, OverallQual > 7 AS failed FROM (
           SELECT Id // 10 AS batch, CAST(row_number() OVER (PARTITION BY Id // 10 ORDER BY Id) - 1 AS INT) AS row_index,
           CAST(OverallQual + 3 AS INT) AS OverallQual, OverallQual AS q FROM listing) t(batch, row_index, OverallQual, q)
        """.replace("OverallQual > 7 AS failed", "q > 7 AS failed")
    ),
)
def batch_failed_rows(spark, sf):
    """Batches of properties: bad rows are named by their position, good rows keep theirs."""
    one = F.struct("Id", F.struct((F.col("OverallQual") + 3).alias("OverallQual")).alias("p"))
    batches = (
        listing(spark, sf)
        .groupBy(F.floor(F.col("Id") / 10).alias("batch"))
        .agg(F.array_sort(F.collect_list(one)).alias("rows"))
        .select("batch", F.to_json(F.struct(F.transform("rows", lambda x: x["p"]).alias("properties"))).alias("value"))
    )
    checked = ops.validated(parse_batches(batches))
    failed = F.exists("errors", lambda e: e == "OverallQual: out of range")
    return checked.select("batch", "row_index", "OverallQual", failed.alias("failed"))


@query(
    "batch_broken_bodies",
    with_listing(
        """SELECT batch, CASE WHEN batch % 5 > 0 THEN row_index END AS row_index, unread FROM (
           SELECT Id // 10 AS batch, CAST(row_number() OVER (PARTITION BY Id // 10 ORDER BY Id) - 1 + (Id // 10 % 5 = 1)::INT AS INT) AS row_index,
           Id // 10 % 5 = 0 AS unread FROM listing) t WHERE batch % 5 > 0 OR row_index = 0
           UNION ALL SELECT DISTINCT Id // 10, 0, true FROM listing WHERE Id // 10 % 5 = 1"""
    ),
)
def batch_broken_bodies(spark, sf):
    """Some batches are cut off, some begin with an entry that is no property: nothing else is lost."""
    one = F.struct("Id", F.struct("OverallQual").alias("p"))
    body = F.to_json(F.struct(F.transform("rows", lambda x: x["p"]).alias("properties")))
    batches = (
        listing(spark, sf)
        .groupBy(F.floor(F.col("Id") / 10).alias("batch"))
        .agg(F.array_sort(F.collect_list(one)).alias("rows"))
        .select(
            "batch",
            F.when(F.col("batch") % 5 == 0, F.substring(body, 1, 30))
            .when(F.col("batch") % 5 == 1, F.replace(body, F.lit("["), F.lit("[17,")))
            .otherwise(body)
            .alias("value"),
        )
    )
    checked = ops.validated(parse_batches(batches))
    return checked.select("batch", "row_index", F.array_contains("errors", "body: not readable").alias("unread"))


@query(
    "score_stream",
    with_listing(f"SELECT Id, {PRICES}, 'formula' AS model_name FROM priced", REQUEST_CTE, PRICED_CTE),
)
def score_as_stream(spark, sf):
    """JSON request files through the stream; prices must equal those of the batch."""
    arriving, out = work_path(spark, "requests"), work_path(spark, "scored")
    rows = stored_listing(spark, sf)
    files = max(3, spark.sparkContext.defaultParallelism)
    requests(spark, sf, rows).repartition(files).write.json(arriving)
    stream = score_stream(
        read_request_stream(spark, arriving, files_per_trigger=-(-files * 2 // 3)),  # two batches
        formula(rows),
        "formula",
        40000.0,
        out,
        work_path(spark, "quarantine"),
        work_path(spark, "stream-checkpoint"),
        once=True,
    )
    stream.awaitTermination()
    return spark.read.parquet(out).drop("batch")
