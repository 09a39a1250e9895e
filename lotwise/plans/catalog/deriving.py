"""Derived columns, encoding, ranking of features, splits."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.operators import encoding, features, selection, splits
from lotwise.operators.cleaning import HouseCleaner
from lotwise.plans.catalog.registry import bucket, query, r, with_clean, with_derived, with_listing
from lotwise.session import via_table
from lotwise.sources.listing import listing, stored_listing, table


def cleaned(spark, sf, *columns):
    """Filled rows (nothing capped, no copies in the table); ``columns`` keeps the table narrow. Learning the fills
    and whatever is fitted on them reads the rows many times, so they are joined once. The parts of the join stay as they
    are: means add up in the same order, and draws by a hash of the scaled cells stay the same."""
    rows = via_table(listing(spark, sf).select(*[col(c) for c in columns]), "listing") if columns else stored_listing(spark, sf)
    return HouseCleaner(dedupe=False, capOutliers=False).fit(rows).transform(rows)


def picked(df, ints=(), doubles=(), texts=(), key=True):
    return df.select(
        *(["Id"] if key else []),
        *[col(c).cast("long").alias(c) for c in ints],
        *[r(col(c)).alias(c) for c in doubles],
        *[col(c) for c in texts],
    )


def picked_sql(ints=(), doubles=(), texts=(), source="derived"):
    parts = ["Id"]
    parts += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints]
    parts += [f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in doubles]
    parts += [f'"{c}"' for c in texts]
    return f"SELECT {', '.join(parts)} FROM {source}"


AGES = dict(ints=["HouseAge", "RemodAge", "IsRemodeled", "IsNewHouse"], doubles=["GarageAge"])


@query("age_features", with_derived(picked_sql(**AGES)))
def age_features(spark, sf):
    rows = cleaned(spark, sf, "Id", "YearBuilt", "YearRemodAdd", "GarageYrBlt", "YrSold")
    return picked(features.age_features(rows), **AGES)


@query(
    "age_features_no_sale_year",
    with_clean(
        """SELECT Id, greatest(2012 - YearBuilt, 0) AS HouseAge,
        CASE WHEN GarageYrBlt = 0 THEN 0 ELSE greatest(2012 - GarageYrBlt, 0) END AS GarageAge FROM clean"""
    ),
)
def age_features_no_sale_year(spark, sf):
    rows = cleaned(spark, sf, "Id", "YearBuilt", "GarageYrBlt")
    out = features.age_features(rows, current_year=2012, absent_garage_age=0)
    return out.select("Id", "HouseAge", "GarageAge")


AREAS = dict(ints=["TotalPorchSF", "TotalSF"], doubles=["GarageRatio", "BasementRatio", "LivingAreaRatio"])
AREA_INPUTS = "Id GarageArea LotArea TotalBsmtSF 1stFlrSF 2ndFlrSF GrLivArea OpenPorchSF WoodDeckSF".split()


@query("area_features", with_derived(picked_sql(**AREAS)))
def area_features(spark, sf):
    return picked(features.area_features(cleaned(spark, sf, *AREA_INPUTS)), **AREAS)


ROOMS = dict(doubles=["TotalBathrooms", "TotalRooms", "RoomsPerBedroom"])


@query("room_features", with_derived(picked_sql(**ROOMS)))
def room_features(spark, sf):
    rows = cleaned(spark, sf, *"Id FullBath HalfBath BsmtFullBath TotRmsAbvGrd BedroomAbvGr".split())
    return picked(features.room_features(rows), **ROOMS)


QUALITIES = dict(doubles=["ConstructionQualityIndex", "OverallQualCondScore"])


@query("quality_features", with_derived(picked_sql(**QUALITIES)))
def quality_features(spark, sf):
    rows = cleaned(spark, sf, *"Id ExterQual KitchenQual HeatingQC BsmtQual GarageQual OverallQual OverallCond".split())
    return picked(features.quality_features(rows), **QUALITIES)


LUXURY = dict(ints=["LuxuryScore"], texts=["PropertySizeCategory"])


@query("luxury_and_size", with_derived(picked_sql(**LUXURY)))
def luxury_and_size(spark, sf):
    rows = cleaned(spark, sf, *"Id PoolArea Fireplaces GarageCars OpenPorchSF WoodDeckSF 1stFlrSF 2ndFlrSF GrLivArea".split())
    median = features.porch_median(rows)
    return picked(features.luxury_features(features.area_features(rows), median), **LUXURY)


@query(
    "group_mean_back",
    with_clean(
        """SELECT Id, Neighborhood, round(avg(OverallQual) OVER (PARTITION BY Neighborhood), 6) AS NeighborhoodQualityScore
        FROM clean"""
    ),
)
def group_mean_back(spark, sf):
    from lotwise.functions.joins import lookup_join

    rows = listing(spark, sf).select("Id", "Neighborhood", "OverallQual")
    out = lookup_join(rows, features.neighborhood_quality(rows), ["Neighborhood"])
    return out.select("Id", "Neighborhood", r("NeighborhoodQualityScore").alias("NeighborhoodQualityScore"))


@query("value_index", with_derived(picked_sql(doubles=["PropertyValueIndex"])))
def value_index(spark, sf):
    rows = listing(spark, sf).select("Id", "OverallQual", "GrLivArea", "TotalBsmtSF")
    return picked(features.value_features(rows), doubles=["PropertyValueIndex"])


ALL = dict(
    ints=["HouseAge", "RemodAge", "IsRemodeled", "IsNewHouse", "TotalPorchSF", "TotalSF", "LuxuryScore"],
    doubles="""GarageAge GarageRatio BasementRatio LivingAreaRatio TotalBathrooms TotalRooms RoomsPerBedroom
    ConstructionQualityIndex OverallQualCondScore NeighborhoodQualityScore PropertyValueIndex LotFrontage SalePrice""".split(),
    texts=["PropertySizeCategory"],
)


@query("engineer_features", with_derived(picked_sql(**ALL)))
def engineer_features(spark, sf):
    return picked(features.engineer_features(cleaned(spark, sf)), **ALL)


TEST_ROWS = f"{bucket('Id', 100, splits.SPLIT_SEED)} < 20"


@query(
    "engineer_fitted",
    with_clean(
        f"""SELECT Id, CASE WHEN OpenPorchSF + WoodDeckSF > (SELECT median(OpenPorchSF + WoodDeckSF) FROM clean WHERE NOT {TEST_ROWS})
          THEN 1 ELSE 0 END + CASE WHEN PoolArea > 0 THEN 2 ELSE 0 END + least(Fireplaces, 2)
          + CASE WHEN GarageCars >= 3 THEN 2 ELSE 0 END AS LuxuryScore,
        round(coalesce((SELECT avg(OverallQual) FROM clean t WHERE t.Neighborhood = s.Neighborhood
          AND NOT {bucket('t.Id', 100, splits.SPLIT_SEED)} < 20 AND t.Neighborhood <> 'NATION_7'), s.OverallQual), 6)
          AS NeighborhoodQualityScore
        FROM clean s WHERE {TEST_ROWS}"""
    ),
)
def engineer_fitted(spark, sf):
    """Statistics of train frozen for test; one neighborhood is unknown to train's lookup."""
    rows = cleaned(spark, sf)
    train, test = splits.train_test_split(rows)
    model = features.FeatureBuilder().fit(train)
    model.table = model.table.where(F.col("Neighborhood") != "NATION_7")
    return picked(model.transform(test), ints=["LuxuryScore"], doubles=["NeighborhoodQualityScore"])


# ---------------------------------------------------------------------- encoding
SCALED = "LotFrontage LotArea GrLivArea GarageArea OverallQual".split()


@query(
    "scale_standard",
    with_clean(
        "SELECT Id, "
        + ", ".join(
            f"""round(("{c}" - (SELECT avg("{c}") FROM clean)) / (SELECT stddev_pop("{c}") FROM clean), 6) AS "{c}" """
            for c in SCALED
        )
        + ", 0.0::DOUBLE AS constant FROM clean"
    ),
)
def scale_standard(spark, sf):
    rows = cleaned(spark, sf, "Id", *SCALED).withColumn("constant", F.lit(7.0))
    out = encoding.standardize_columns(rows, [*SCALED, "constant"])
    return out.select("Id", *[r(c).alias(c) for c in SCALED], "constant")


@query(
    "onehot_long",
    with_clean(
        f"""SELECT Id, 'Neighborhood_' || Neighborhood AS feature FROM clean WHERE {TEST_ROWS} AND Neighborhood IN
          (SELECT Neighborhood FROM clean WHERE NOT {TEST_ROWS} AND Neighborhood <> 'NATION_7')
        UNION ALL SELECT Id, 'MSZoning_' || MSZoning FROM clean WHERE {TEST_ROWS}"""
    ),
)
def onehot_long(spark, sf):
    train, test = splits.train_test_split(listing(spark, sf).select("Id", "Neighborhood", "MSZoning"))
    train = train.where(F.col("Neighborhood") != "NATION_7")
    return encoding.onehot_long(test, ["Neighborhood", "MSZoning"], train)


@query(
    "encoder_slots",
    with_clean(
        """SELECT 'MSZoning_' || MSZoning AS feature, round(count(*)::DOUBLE, 4) AS total FROM clean GROUP BY MSZoning
        UNION ALL SELECT 'KitchenQual_' || KitchenQual, round(count(*)::DOUBLE, 4) FROM clean GROUP BY KitchenQual
        UNION ALL SELECT 'LotArea', 0 UNION ALL SELECT 'GrLivArea', 0"""
    ),
)
def encoder_slots(spark, sf):
    """Sum of every slot of the encoded vector: category counts, and 0 for scaled columns."""
    rows = cleaned(spark, sf, "Id", "LotArea", "GrLivArea", "MSZoning", "KitchenQual")
    encoder = encoding.build_full_preprocessor(rows)
    names = encoding.encoded_names(encoder)
    total = encoding.encode(encoder, rows, ["Id"]).select(Summarizer.sum(F.col("features")).alias("s"))
    labels = F.array(*[F.lit(n) for n in names])
    from pyspark.ml.functions import vector_to_array

    return total.select(F.posexplode(vector_to_array("s")).alias("at", "v")).select(
        labels[F.col("at")].alias("feature"), (r("v", 4) + F.lit(0.0)).alias("total")
    )


@query(
    "encoder_passthrough",
    with_clean("""SELECT 'LotArea' AS feature, round(sum(LotArea)::DOUBLE, 4) AS total FROM clean"""),
)
def encoder_passthrough(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = listing(spark, sf).select("Id", "LotArea")
    encoder = encoding.build_full_preprocessor(rows, scaling="none")
    out = encoding.encode(encoder, rows, ["Id"])
    return out.agg(F.sum(vector_to_array("features")[0]).alias("v")).select(
        F.lit("LotArea").alias("feature"), r("v", 4).alias("total")
    )


@query(
    "align_columns",
    with_listing("""SELECT GrLivArea, 0 AS NotThere, LotFrontage, Id FROM listing"""),
)
def align_columns(spark, sf):
    return splits.align(listing(spark, sf), ["GrLivArea", "NotThere", "LotFrontage", "Id"])


# ------------------------------------------------------------- feature selection
RANKED = """LotFrontage LotArea OverallQual OverallCond YearBuilt GrLivArea TotalBsmtSF GarageArea GarageCars
Fireplaces 1stFlrSF 2ndFlrSF""".split()


def _ranked_rows(spark, sf):
    return listing(spark, sf).select("Id", *[col(c) for c in RANKED], "SalePrice")


CORR_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(abs(corr("{c}", SalePrice)), 6) AS score FROM listing""" for c in RANKED
)


@query("corr_rank", with_listing(CORR_SQL))
def corr_rank(spark, sf):
    ranking = selection.correlation_ranking(_ranked_rows(spark, sf), skip=("Id",))
    return ranking.select("feature", r("score").alias("score"))


def _mi_sql(columns, source="listing") -> str:
    def binned(c, name):
        edges = ", ".join(
            f"quantile_cont(coalesce(CAST(\"{c}\" AS DOUBLE), 0), {i / 10}) AS e{i}" for i in range(1, 10)
        )
        return f"(SELECT list_distinct([e1, e2, e3, e4, e5, e6, e7, e8, e9]) AS {name} FROM (SELECT {edges} FROM {source}))"

    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS feature, sum(n / nn * ln(n * nn / (nx * ny))) AS score FROM (
            SELECT n, sum(n) OVER (PARTITION BY bx) AS nx, sum(n) OVER (PARTITION BY by_) AS ny, sum(n) OVER () AS nn FROM (
              SELECT len(list_filter(ex, lambda e: coalesce(CAST("{c}" AS DOUBLE), 0) > e)) AS bx,
                     len(list_filter(ey, lambda e: SalePrice > e)) AS by_, CAST(count(*) AS DOUBLE) AS n
              FROM {source}, {binned(c, 'ex')}, {binned('SalePrice', 'ey')} GROUP BY 1, 2))"""
        )
    return " UNION ALL ".join(parts)


@query("mi_binned", with_listing(f"SELECT feature, round(score, 6) AS score FROM ({_mi_sql(RANKED)})"))
def mi_binned(spark, sf):
    return selection.mutual_information_ranking(_ranked_rows(spark, sf)).select("feature", r("score").alias("score"))


@query(
    "variance_filter",
    with_listing(
        "SELECT feature, round(variance, 4) AS variance FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, var_pop(CAST(coalesce("{c}", 0) AS DOUBLE)) AS variance FROM listing"""
            for c in ("OverallQual", "FullBath", "LotFrontage", "Fireplaces", "GarageCars")
        )
        + ") WHERE variance > 0.7"
    ),
)
def variance_filter(spark, sf):
    rows = listing(spark, sf).select("OverallQual", "FullBath", "LotFrontage", "Fireplaces", "GarageCars")
    kept = selection.variance_filter(rows.withColumn("constant", F.lit(3)), 0.7)
    return kept.select("feature", r("variance", 4).alias("variance"))


@query(
    "selection_agreement",
    with_listing(
        """SELECT feature, bool_or(m = 'correlation') AS correlation, bool_or(m = 'mutual_information') AS mutual_information,
        count(*) AS agreement_count FROM (SELECT feature, 'correlation' AS m FROM (SELECT * FROM c ORDER BY score DESC, feature LIMIT 5)
        UNION ALL SELECT feature, 'mutual_information' FROM (SELECT * FROM i ORDER BY score DESC, feature LIMIT 5)) GROUP BY feature""",
        f", c AS ({CORR_SQL}), i AS ({_mi_sql(RANKED)})",
    ),
)
def selection_agreement(spark, sf):
    rows = _ranked_rows(spark, sf)
    out = selection.agreement(
        {
            "correlation": selection.correlation_ranking(rows, skip=("Id",)),
            "mutual_information": selection.mutual_information_ranking(rows),
        },
        top_k=5,
    )
    return out.withColumn("agreement_count", F.col("agreement_count").cast("long"))


def _tree_rows(spark, sf):
    return cleaned(spark, sf, *"Id OverallQual GrLivArea LotArea GarageArea YearBuilt MSZoning ExterQual SalePrice".split())


@query("tree_importance")
def tree_importance(spark, sf):
    return selection.tree_importance(_tree_rows(spark, sf), trees=20, depth=8)


@query("permutation_importance")
def permutation_importance(spark, sf):
    return selection.permutation_importance(_tree_rows(spark, sf), trees=10, depth=6)


@query("recursive_elimination")
def recursive_elimination(spark, sf):
    return selection.recursive_elimination(_tree_rows(spark, sf), keep=5, step=0.2, trees=10, depth=6)


@query("selection_four_methods")
def selection_four_methods(spark, sf):
    return selection.compare_selection_methods(
        _tree_rows(spark, sf), importance={"trees": 10, "depth": 6}, permutation={"trees": 10, "depth": 6}
    )


# ------------------------------------------------------------------------ splits
@query(
    "hash_split",
    f"""SELECT o_orderkey AS Id, {bucket('o_orderkey', 100, splits.SPLIT_SEED)} < 20 AS is_test,
    CAST({bucket('o_orderkey', 5, splits.FOLD_SEED)} AS INT) AS fold FROM orders""",
)
def hash_split(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("Id"))
    return splits.with_fold(splits.with_split(rows), 5)


@query(
    "log_target",
    """SELECT event_id, round(ln(1 + value), 6) AS logged, round(greatest(exp(ln(1 + value)) - 1, 0), 4) AS back FROM events""",
)
def log_target(spark, sf):
    rows = splits.to_log_target(table(spark, sf, "events").select("event_id", "value"), "value")
    return rows.select(
        "event_id", r(splits.LOG_TARGET).alias("logged"), r(splits.from_log(F.col(splits.LOG_TARGET)), 4).alias("back")
    )


@query(
    "prepare_train_test",
    with_listing(
        f"""SELECT part, count(*) AS n, round(avg(LotFrontage), 4) AS LotFrontage, round(sum(GarageArea), 2) AS GarageArea,
        round(avg(place), 4) AS NeighborhoodQualityScore, CAST(sum(porch_point) AS BIGINT) AS porch_points FROM (
          SELECT part, LotFrontage, place, CASE WHEN porch > median(porch) OVER (PARTITION BY part) THEN 1 ELSE 0 END AS porch_point,
            CASE WHEN part = 'train' THEN least(GarageArea, hi) ELSE GarageArea END AS GarageArea FROM (
              SELECT CASE WHEN {TEST_ROWS} THEN 'test' ELSE 'train' END AS part,
                coalesce(LotFrontage, (SELECT median(LotFrontage) FROM listing WHERE NOT {TEST_ROWS})) AS LotFrontage,
                CAST(coalesce(GarageArea, 0) AS DOUBLE) AS GarageArea,
                (SELECT 4 * quantile_cont(CAST(coalesce(GarageArea, 0) AS DOUBLE), 0.75) - 3 * quantile_cont(CAST(coalesce(GarageArea, 0) AS DOUBLE), 0.25)
                   FROM listing WHERE NOT {TEST_ROWS}) AS hi,
                avg(OverallQual) OVER (PARTITION BY {TEST_ROWS}, Neighborhood) AS place,
                OpenPorchSF + WoodDeckSF AS porch FROM listing))
        GROUP BY part"""
    ),
)
def prepare_train_test(spark, sf):
    train, test, _, _ = splits.prepare_train_test(stored_listing(spark, sf))

    def summary(df, part):
        porch_point = (
            F.col("LuxuryScore")
            - F.when(F.col("PoolArea") > 0, 2).otherwise(0)
            - F.least("Fireplaces", F.lit(2))
            - F.when(F.col("GarageCars") >= 3, 2).otherwise(0)
        )
        return df.agg(
            F.lit(part).alias("part"),
            F.count(F.lit(1)).alias("n"),
            r(F.avg("LotFrontage"), 4).alias("LotFrontage"),
            r(F.sum("GarageArea"), 2).alias("GarageArea"),
            r(F.avg("NeighborhoodQualityScore"), 4).alias("NeighborhoodQualityScore"),
            F.sum(porch_point).cast("long").alias("porch_points"),
        )

    return summary(train, "train").unionByName(summary(test, "test"))


