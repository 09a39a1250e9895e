"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.operators import cleaning as ops
from lotwise.operators import profile
from lotwise.plans.catalog.registry import query, r, with_clean, with_listing
from lotwise.session import via_table
from lotwise.sources.listing import listing, listing_with_copies, stored_listing, table

NUMBERS = """Id LotFrontage LotArea OverallQual OverallCond YearBuilt YearRemodAdd MasVnrArea TotalBsmtSF 1stFlrSF
2ndFlrSF GrLivArea BsmtFullBath FullBath HalfBath BedroomAbvGr TotRmsAbvGrd Fireplaces GarageCars GarageArea
GarageYrBlt WoodDeckSF OpenPorchSF PoolArea MoSold YrSold""".split()
CODES = """MSSubClass MSZoning Neighborhood ExterQual KitchenQual BsmtQual HeatingQC GarageType GarageQual Fence""".split()
CAPPED = [c for c in NUMBERS if c not in ("Id", "YearBuilt", "YearRemodAdd", "GarageYrBlt", "MoSold", "YrSold")]


def stacked(template: str, columns, joiner: str = " UNION ALL ") -> str:
    return joiner.join(template.format(c=c) for c in columns)


@query(
    "clean_medians",
    with_listing(stacked("""SELECT '{c}' AS "column", round(median(CAST("{c}" AS DOUBLE)), 6) AS median FROM listing""", NUMBERS)),
)
def clean_medians(spark, sf):
    rows = listing(spark, sf).select(*[col(c) for c in NUMBERS])
    medians = ops.column_medians(ops.standardize(rows), NUMBERS)
    return spark.createDataFrame([(c, m) for c, m in medians.items()], "column string, median double").select(
        "column", r("median").alias("median")
    )


@query(
    "clean_modes",
    with_listing(
        """SELECT "column", v AS mode FROM (SELECT "column", v, row_number() OVER (PARTITION BY "column"
        ORDER BY n DESC, v) AS rn FROM cells WHERE v IS NOT NULL) WHERE rn = 1""",
        ", cells AS ("
        + stacked(
            """SELECT '{c}' AS "column", trim(CAST("{c}" AS VARCHAR)) AS v, count(*) AS n FROM listing GROUP BY 2""", CODES
        )
        + ")",
    ),
)
def clean_modes(spark, sf):
    rows = ops.fix_types(ops.standardize(listing(spark, sf).select(*CODES)))
    return ops.mode_table(rows, CODES)


@query(
    "strip_text",
    with_listing("""SELECT Id, trim(KitchenQual) AS KitchenQual, trim(MSZoning) AS MSZoning FROM listing"""),
)
def strip_text(spark, sf):
    padded = listing(spark, sf).select(
        "Id", F.concat(F.lit("\t"), "KitchenQual", F.lit("\n")).alias("  KitchenQual "), F.col("MSZoning").alias("MSZoning ")
    )
    return ops.standardize(padded)


@query(
    "fix_types",
    with_listing(
        """SELECT Id, CAST(MSSubClass AS VARCHAR) AS MSSubClass,
        CASE WHEN Id % 7 = 0 THEN NULL ELSE CAST(YearBuilt AS DOUBLE) END AS YearBuilt FROM listing"""
    ),
)
def fix_types(spark, sf):
    text_year = F.when(F.col("Id") % 7 == 0, "unknown").otherwise(F.col("YearBuilt").cast("string"))
    return ops.fix_types(listing(spark, sf).select("Id", "MSSubClass", text_year.alias("YearBuilt")))


@query(
    "dedupe_keep_first",
    with_listing(
        """SELECT min(Id) AS Id, MSZoning, LotArea, GrLivArea, round(SalePrice, 4) AS SalePrice
        FROM (SELECT * FROM listing UNION ALL SELECT * REPLACE (Id + 1000000000000 AS Id) FROM listing WHERE Id % 50 = 0)
        GROUP BY MSSubClass, MSZoning, Neighborhood, LotFrontage, LotArea, OverallQual, OverallCond, YearBuilt,
          YearRemodAdd, MasVnrArea, ExterQual, KitchenQual, BsmtQual, HeatingQC, TotalBsmtSF, "1stFlrSF", "2ndFlrSF",
          GrLivArea, BsmtFullBath, FullBath, HalfBath, BedroomAbvGr, TotRmsAbvGrd, Fireplaces, GarageCars, GarageArea,
          GarageType, GarageYrBlt, GarageQual, WoodDeckSF, OpenPorchSF, PoolArea, Fence, MoSold, YrSold, SalePrice"""
    ),
)
def dedupe_keep_first(spark, sf):
    kept = ops.drop_copies(listing_with_copies(spark, sf))
    return kept.select("Id", "MSZoning", "LotArea", "GrLivArea", r("SalePrice", 4).alias("SalePrice"))


@query(
    "dedupe_line_numbers",
    """SELECT min(l_suppkey * 1000000 + l_partkey) AS part_key, l_orderkey, l_linenumber FROM lineitem
    GROUP BY l_orderkey, l_linenumber""",
)
def dedupe_line_numbers(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("part_key"), "l_orderkey", "l_linenumber"
    )
    return ops.drop_copies(rows, "part_key")


FILLED_COLUMNS = """Id, MasVnrArea, BsmtQual, GarageCars, GarageArea, GarageType, GarageYrBlt, GarageQual, Fence"""


@query("fill_absent", with_clean(f"SELECT {FILLED_COLUMNS} FROM clean"))
def fill_absent(spark, sf):
    return ops.fill_absent(listing(spark, sf).select(*FILLED_COLUMNS.split(", ")))


@query(
    "fill_learned",
    with_listing(
        """SELECT Id, round(coalesce(LotFrontage, (SELECT median(LotFrontage) FROM holes)), 6) AS LotFrontage,
        coalesce(MSZoning, (SELECT MSZoning FROM holes WHERE MSZoning IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS MSZoning,
        coalesce(MSSubClass, (SELECT MSSubClass FROM holes WHERE MSSubClass IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS MSSubClass,
        coalesce(new_number, 0) AS new_number, coalesce(new_text, 'Unknown') AS new_text FROM holes""",
        """, holes AS (SELECT Id, LotFrontage, CASE WHEN Id % 13 <> 0 THEN MSZoning END AS MSZoning,
        CASE WHEN Id % 17 <> 0 THEN CAST(MSSubClass AS VARCHAR) END AS MSSubClass,
        CASE WHEN Id % 2 = 0 THEN CAST(LotArea AS INT) END AS new_number,
        CASE WHEN Id % 3 = 0 THEN ExterQual END AS new_text FROM listing)""",
    ),
)
def fill_learned(spark, sf):
    """Two columns with holes are learned; two others were never seen when the fills were learned."""
    rows = listing(spark, sf).select(
        "Id",
        "LotFrontage",
        F.when(F.col("Id") % 13 != 0, F.col("MSZoning")).alias("MSZoning"),
        F.when(F.col("Id") % 17 != 0, F.col("MSSubClass")).alias("MSSubClass"),
        F.when(F.col("Id") % 2 == 0, F.col("LotArea").cast("int")).alias("new_number"),
        F.when(F.col("Id") % 3 == 0, F.col("ExterQual")).alias("new_text"),
    )
    model = ops.HouseCleaner(dedupe=False, capOutliers=False).fit(rows.drop("new_number", "new_text"))
    return model.transform(rows).withColumn("LotFrontage", r("LotFrontage"))


QUARTILES = stacked(
    """SELECT '{c}' AS "column", quantile_cont(CAST("{c}" AS DOUBLE), 0.25) AS q1,
    quantile_cont(CAST("{c}" AS DOUBLE), 0.75) AS q3 FROM clean""",
    CAPPED,
)


def filled_numbers(spark, sf, extra=()):
    rows = listing(spark, sf).select("Id", *[col(c) for c in CAPPED], *extra)
    return ops.HouseCleaner(dedupe=False, capOutliers=False).fit(rows).transform(rows)


@query(
    "iqr_bounds",
    with_clean(
        """SELECT "column", round(q1 - 3 * (q3 - q1), 6) AS low, round(q3 + 3 * (q3 - q1), 6) AS high FROM quartiles
        WHERE q3 <> q1""",
        f", quartiles AS ({QUARTILES})",
    ),
)
def iqr_bounds(spark, sf):
    filled = filled_numbers(spark, sf)
    bounds = ops.iqr_bounds(filled, ops.capped_columns(filled), 3.0)
    rows = [(c, *b) for c, b in bounds.items()]
    return spark.createDataFrame(rows, "column string, low double, high double").select(
        "column", r("low").alias("low"), r("high").alias("high")
    )


def _counts_sql(k: float) -> str:
    return with_clean(
        """SELECT "column", outliers FROM ("""
        + stacked(
            """SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" < q1 - %s * (q3 - q1) OR "{c}" > q3 + %s * (q3 - q1)) AS outliers
            FROM clean, (SELECT * FROM quartiles WHERE "column" = '{c}' AND q1 <> q3)""" % (k, k),
            CAPPED,
        )
        + ") WHERE outliers > 0",
        f", quartiles AS ({QUARTILES})",
    )


@query("iqr_counts", _counts_sql(1.0))
def iqr_counts(spark, sf):
    filled = filled_numbers(spark, sf)
    return ops.outlier_counts(filled, ops.iqr_bounds(filled, ops.capped_columns(filled), 1.0))


@query(
    "iqr_cap",
    with_clean(
        """SELECT Id, """
        + ", ".join(
            f"""round(least(greatest(CAST("{c}" AS DOUBLE), (SELECT q1 - 0.5 * (q3 - q1) FROM quartiles WHERE "column" = '{c}')),
            (SELECT q3 + 0.5 * (q3 - q1) FROM quartiles WHERE "column" = '{c}')), 6) AS "{c}" """
            for c in ("LotFrontage", "LotArea", "GrLivArea", "GarageArea")
        )
        + " FROM clean",
        f", quartiles AS ({QUARTILES})",
    ),
)
def iqr_cap(spark, sf):
    filled = filled_numbers(spark, sf)
    columns = ["LotFrontage", "LotArea", "GrLivArea", "GarageArea"]
    capped = ops.apply_bounds(filled, ops.iqr_bounds(filled, columns, 0.5))
    return capped.select("Id", *[r(c).alias(c) for c in columns])


@query(
    "clean_report",
    with_clean(
        """SELECT 'before' AS stage, 'rows' AS metric, NULL::VARCHAR AS "column", count(*)::DOUBLE AS value FROM copies
        UNION ALL SELECT 'before', 'columns', NULL, 37
        UNION ALL SELECT 'after', 'rows', NULL, count(*) FROM listing
        UNION ALL SELECT 'after', 'columns', NULL, 37
        UNION ALL SELECT 'clean', 'duplicates_removed', NULL, (SELECT count(*) FROM copies) - (SELECT count(*) FROM listing)
        UNION ALL SELECT * FROM ("""
        + stacked(
            """SELECT 'before' AS s, 'missing' AS m, '{c}' AS c, count(*) FILTER (WHERE "{c}" IS NULL) AS n FROM copies""",
            "LotFrontage MasVnrArea BsmtQual GarageCars GarageArea GarageType GarageYrBlt GarageQual Fence".split(),
        )
        + """) WHERE n > 0 UNION ALL SELECT 'clean', 'outliers_capped', "column", outliers FROM ("""
        + stacked(
            """SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" < q1 - 3 * (q3 - q1) OR "{c}" > q3 + 3 * (q3 - q1)) AS outliers
            FROM clean, (SELECT * FROM quartiles WHERE "column" = '{c}' AND q1 <> q3)""",
            CAPPED,
        )
        + ") WHERE outliers > 0",
        """, copies AS (SELECT * FROM listing UNION ALL SELECT * REPLACE (Id + 1000000000000 AS Id) FROM listing
        WHERE Id % 50 = 0)""",
        f", quartiles AS ({QUARTILES})",
    ),
)
def clean_report(spark, sf):
    """Note: the SQL fills from the rows without copies; no fill differs (see the tests)."""
    raw = via_table(listing_with_copies(spark, sf), "copies")
    return ops.cleaning_report(raw, ops.HouseCleaner().fit(raw))


@query(
    "missing_profile",
    with_listing(
        """SELECT "column", missing, round(100.0::DOUBLE * missing / n, 6) AS percent FROM ("""
        + stacked(
            """SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" IS NULL) AS missing, count(*) AS n FROM listing""",
            [*NUMBERS, *CODES, "SalePrice"],
        )
        + ") WHERE missing > 0"
    ),
)
def missing_profile(spark, sf):
    return profile.missing_profile(listing(spark, sf)).select("column", "missing", r("percent").alias("percent"))


@query(
    "clean_dataset",
    with_clean(
        """SELECT Id, MSSubClass, KitchenQual, Fence, round(LotFrontage, 6) AS LotFrontage,
        round(least(CAST(GarageArea AS DOUBLE), (SELECT quantile_cont(CAST(GarageArea AS DOUBLE), 0.75) * 4
          - 3 * quantile_cont(CAST(GarageArea AS DOUBLE), 0.25) FROM clean)), 6) AS GarageArea,
        round(LotArea::DOUBLE, 6) AS LotArea, round(SalePrice, 4) AS SalePrice FROM clean""",
    ),
)
def clean_dataset(spark, sf):
    rows = stored_listing(spark, sf)
    cleaned = ops.HouseCleaner().fit(rows).transform(rows)
    return cleaned.select(
        "Id", "MSSubClass", "KitchenQual", "Fence", r("LotFrontage").alias("LotFrontage"),
        r("GarageArea").alias("GarageArea"), r("LotArea").alias("LotArea"), r("SalePrice", 4).alias("SalePrice"),
    )

