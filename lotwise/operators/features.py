"""The 19 derived columns.

All but one are scalar expressions of the row and go into projections that Catalyst collapses into
one. Two use a statistic of the frame: the median porch (a literal) and the mean quality of the
neighborhood (a lookup). Both can be taken from the frame itself or from a fitted model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.joins import lookup_join
from lotwise.functions.quantiles import exact_quantiles
from lotwise.functions.scalar import clip_high, clip_low, col, quality_points, quoted, safe_ratio, size_class
from lotwise.operators.persist import WithTable
from lotwise.schema import QUALITY_COLUMNS
from lotwise.session import cut_lineage

# ---------------------------------------------------------------- fixed values
DERIVED = """
HouseAge RemodAge GarageAge IsRemodeled IsNewHouse GarageRatio BasementRatio LivingAreaRatio TotalPorchSF
TotalSF TotalBathrooms TotalRooms RoomsPerBedroom ConstructionQualityIndex OverallQualCondScore
LuxuryScore PropertySizeCategory NeighborhoodQualityScore PropertyValueIndex
""".split()
DEFAULT_YEAR = 2010
NEW_HOUSE_YEARS = 5
BASEMENT_RATIO_CAP = 3
# ------------------------------------------------------------ end fixed values


def _flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def _known(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def _or_zero(df: DataFrame, name: str) -> Column:
    return col(name) if name in df.columns else F.lit(0)


def _add(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.withColumns(new) if new else df


def age_features(df: DataFrame, current_year: int | None = None, absent_garage_age: int | None = None) -> DataFrame:
    sold = col("YrSold") if "YrSold" in df.columns else F.lit(current_year or DEFAULT_YEAR)
    new: dict[str, Column] = {}
    if "YearBuilt" in df.columns:
        new["HouseAge"] = clip_low(sold - col("YearBuilt"))
    if "YearRemodAdd" in df.columns:
        new["RemodAge"] = clip_low(sold - col("YearRemodAdd"))
    if "GarageYrBlt" in df.columns:
        new["GarageAge"] = F.coalesce(clip_low(sold - col("GarageYrBlt")), F.lit(0.0))
        if absent_garage_age is not None:
            new["GarageAge"] = F.when(col("GarageYrBlt") == 0, F.lit(float(absent_garage_age))).otherwise(new["GarageAge"])
    if "HouseAge" in new:
        new["IsRemodeled"] = _flag(new.get("RemodAge", new["HouseAge"]) < new["HouseAge"])
        new["IsNewHouse"] = _flag(new["HouseAge"] <= NEW_HOUSE_YEARS)
    return _add(df, new)


def area_features(df: DataFrame) -> DataFrame:
    new: dict[str, Column] = {}
    if _known(df, "GarageArea", "LotArea"):
        new["GarageRatio"] = safe_ratio(col("GarageArea"), col("LotArea"))
    if _known(df, "TotalBsmtSF", "1stFlrSF"):
        new["BasementRatio"] = clip_high(safe_ratio(col("TotalBsmtSF"), col("1stFlrSF")), float(BASEMENT_RATIO_CAP))
    if _known(df, "GrLivArea", "LotArea"):
        new["LivingAreaRatio"] = safe_ratio(col("GrLivArea"), col("LotArea"))
    if _known(df, "1stFlrSF", "2ndFlrSF"):
        new["TotalPorchSF"] = _or_zero(df, "OpenPorchSF") + _or_zero(df, "WoodDeckSF")
    if _known(df, "1stFlrSF", "2ndFlrSF", "TotalBsmtSF"):
        new["TotalSF"] = col("1stFlrSF") + col("2ndFlrSF") + col("TotalBsmtSF")
    return _add(df, new)


def room_features(df: DataFrame) -> DataFrame:
    baths = (
        _or_zero(df, "FullBath")
        + 0.5 * _or_zero(df, "HalfBath")
        + _or_zero(df, "BsmtFullBath")
        + 0.5 * _or_zero(df, "BsmtHalfBath")
    ).cast("double")
    new = {"TotalBathrooms": baths}
    if _known(df, "TotRmsAbvGrd", "BedroomAbvGr"):
        rooms = col("TotRmsAbvGrd")
        new["TotalRooms"] = rooms + baths
        new["RoomsPerBedroom"] = safe_ratio(rooms, col("BedroomAbvGr"), rooms.cast("double"))
    return _add(df, new)


def quality_features(df: DataFrame) -> DataFrame:
    new: dict[str, Column] = {}
    graded = [c for c in QUALITY_COLUMNS if c in df.columns]
    if graded:
        total = sum((quality_points(col(c)) for c in graded[1:]), quality_points(col(graded[0])))
        new["ConstructionQualityIndex"] = total / F.lit(float(len(graded)))
    if _known(df, "OverallQual", "OverallCond"):
        new["OverallQualCondScore"] = col("OverallQual") * F.lit(0.7) + col("OverallCond") * F.lit(0.3)
    return _add(df, new)


def luxury_features(df: DataFrame, porch_median: float | None) -> DataFrame:
    """Needs ``TotalPorchSF`` for the porch point (see :func:`area_features`)."""
    points = []
    if "PoolArea" in df.columns:
        points.append(_flag(col("PoolArea") > 0) * 2)
    if "Fireplaces" in df.columns:
        points.append(clip_high(col("Fireplaces"), 2))
    if "GarageCars" in df.columns:
        points.append(_flag(col("GarageCars") >= 3) * 2)
    if "TotalPorchSF" in df.columns:
        points.append(_flag(col("TotalPorchSF") > F.lit(porch_median)))
    new: dict[str, Column] = {}
    if points:
        new["LuxuryScore"] = sum(points[1:], points[0])
    if "GrLivArea" in df.columns:
        new["PropertySizeCategory"] = size_class(col("GrLivArea"))
    return _add(df, new)


def value_features(df: DataFrame) -> DataFrame:
    if not _known(df, "GrLivArea", "TotalBsmtSF"):
        return df
    quality = col("OverallQual") if "OverallQual" in df.columns else F.lit(5)
    area = col("GrLivArea") + col("TotalBsmtSF")
    worth = F.when(area != 0, quality * area)
    return _add(df, {"PropertyValueIndex": F.coalesce(worth, F.lit(0)) / F.lit(1000.0)})


def neighborhood_quality(df: DataFrame) -> DataFrame:
    """``Neighborhood, NeighborhoodQualityScore``: partially aggregated, safe for hot places."""
    return df.groupBy("Neighborhood").agg(F.avg("OverallQual").alias("NeighborhoodQualityScore"))


def porch_median(df: DataFrame) -> float | None:
    """Median of the porch total (NULL when the frame has no porch total)."""
    if not _known(df, "1stFlrSF", "2ndFlrSF"):
        return None
    total = (_or_zero(df, "OpenPorchSF") + _or_zero(df, "WoodDeckSF")).alias("porch")
    return exact_quantiles(df.select(total), ["porch"], [0.5])["porch"][0]


@dataclass
class FrameStats:
    """The two frame statistics. ``places`` is a table ``Neighborhood, NeighborhoodQualityScore``."""

    porch_median: float | None
    places: DataFrame | None


def frame_stats(df: DataFrame) -> FrameStats:
    places = neighborhood_quality(df) if _known(df, "Neighborhood", "OverallQual") else None
    return FrameStats(porch_median(df), places)


def row_features(df: DataFrame, porch: float | None, current_year=None, absent_garage_age=None) -> DataFrame:
    """Every derived column that needs no lookup."""
    out = age_features(df, current_year, absent_garage_age)
    out = quality_features(room_features(area_features(out)))
    return value_features(luxury_features(out, porch))


def add_features(
    df: DataFrame,
    stats: FrameStats | None = None,
    current_year: int | None = None,
    absent_garage_age: int | None = None,
) -> DataFrame:
    """All derived columns. Without ``stats`` they come from the frame itself."""
    own = stats is None
    stats = stats or frame_stats(df)
    out = row_features(df, stats.porch_median, current_year, absent_garage_age)
    if stats.places is not None and _known(df, "Neighborhood", "OverallQual"):
        out = lookup_join(out, stats.places, ["Neighborhood"])
        if not own:
            out = _own_quality_if_unseen(out)
    order = [c for c in df.columns if c not in DERIVED] + [c for c in DERIVED if c in out.columns]
    return out.select(*[quoted(c) for c in order])


def _own_quality_if_unseen(df: DataFrame) -> DataFrame:
    score = F.coalesce(col("NeighborhoodQualityScore"), col("OverallQual").cast("double"))
    return df.withColumn("NeighborhoodQualityScore", score)


engineer_features = add_features


# ------------------------------------------------------------------- stage pair
class _FeatureParams(Params):
    currentYear = Param(Params._dummy(), "currentYear", "sale year where the table has none", TypeConverters.toInt)
    absentGarageAge = Param(Params._dummy(), "absentGarageAge", "age of a garage that does not exist", TypeConverters.toInt)

    def _options(self) -> dict:
        return {
            "current_year": self.getOrDefault(self.currentYear) if self.isSet(self.currentYear) else None,
            "absent_garage_age": self.getOrDefault(self.absentGarageAge) if self.isSet(self.absentGarageAge) else None,
        }


class FeatureBuilder(Estimator, _FeatureParams):
    """Freezes the two frame statistics so that a request is derived as the training rows were."""

    @keyword_only
    def __init__(self, *, currentYear=None, absentGarageAge=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "FeatureBuilderModel":
        stats = frame_stats(df)
        places = cut_lineage(stats.places) if stats.places is not None else None
        model = FeatureBuilderModel(places)
        self._copyValues(model)
        if stats.porch_median is not None:
            model._set(porchMedian=float(stats.porch_median))
        return model._set(placeCount=places.count() if places is not None else 0)


class FeatureBuilderModel(Model, _FeatureParams, WithTable):
    """Carries the neighborhood table."""

    porchMedian = Param(Params._dummy(), "porchMedian", "median porch total of the training rows", TypeConverters.toFloat)
    placeCount = Param(Params._dummy(), "placeCount", "rows of the neighborhood table", TypeConverters.toInt)

    def __init__(self, places: DataFrame | None = None):
        super().__init__()
        self.table = places

    def copy(self, extra=None):
        return self._copyValues(FeatureBuilderModel(self.table), extra)

    def _transform(self, df: DataFrame) -> DataFrame:
        porch = self.getOrDefault(self.porchMedian) if self.isSet(self.porchMedian) else None
        out = row_features(df, porch, **self._options())
        if self.table is not None and _known(df, "Neighborhood", "OverallQual"):
            out = _own_quality_if_unseen(lookup_join(out, self.table, ["Neighborhood"]))
        order = [c for c in df.columns if c not in DERIVED] + [c for c in DERIVED if c in out.columns]
        return out.select(*[quoted(c) for c in order])
