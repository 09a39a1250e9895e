"""Fixed values of the house table: columns, codes, missing-value rules, request rules."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "Id"
TARGET = "SalePrice"

# ---------------------------------------------------------------- fixed values
INT_COLUMNS = """
Id MSSubClass LotArea OverallQual OverallCond YearBuilt YearRemodAdd TotalBsmtSF 1stFlrSF 2ndFlrSF
GrLivArea BsmtFullBath FullBath HalfBath BedroomAbvGr TotRmsAbvGrd Fireplaces GarageCars GarageArea
WoodDeckSF OpenPorchSF PoolArea MoSold YrSold
""".split()
DOUBLE_COLUMNS = "LotFrontage MasVnrArea GarageYrBlt SalePrice".split()
STRING_COLUMNS = """
MSZoning Street LotShape LandContour Utilities Neighborhood BldgType HouseStyle RoofStyle Exterior1st
ExterQual Foundation BsmtQual BsmtCond HeatingQC CentralAir KitchenQual GarageType GarageQual Fence
SaleType SaleCondition
""".split()

# Text that stands for a missing cell in delimited files.
NA_TOKENS = ["", "NA", "N/A", "n/a", "nan", "NaN", "-nan", "-NaN", "NULL", "null", "None", "<NA>", "#N/A", "#NA", "#N/A N/A",
             "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN"]

# A missing code here means that the house has no such part.
ABSENT_IS_NONE = """
BsmtQual BsmtCond BsmtExposure BsmtFinType1 BsmtFinType2 GarageType GarageFinish GarageQual GarageCond
FireplaceQu PoolQC Fence MiscFeature Alley MasVnrType
""".split()
# A missing number here means zero.
ABSENT_IS_ZERO = """
GarageYrBlt GarageArea GarageCars MasVnrArea BsmtFinSF1 BsmtFinSF2 BsmtUnfSF TotalBsmtSF BsmtFullBath
BsmtHalfBath
""".split()
CODE_COLUMNS = ["MSSubClass"]
YEAR_COLUMNS = ["YearBuilt", "YearRemodAdd", "GarageYrBlt", "YrSold"]
NEVER_CAPPED = ["YearBuilt", "YearRemodAdd", "GarageYrBlt", "YrSold", "MoSold"]

QUALITY_POINTS = {"None": 0, "Po": 1, "Fa": 2, "TA": 3, "Gd": 4, "Ex": 5}
QUALITY_COLUMNS = ["ExterQual", "KitchenQual", "HeatingQC", "BsmtQual", "GarageQual"]
SIZE_CLASSES = [(900, "Compact"), (1400, "Small"), (2000, "Medium"), (2800, "Large"), (None, "Estate")]

KEY_NUMERIC = """
SalePrice GrLivArea TotalBsmtSF 1stFlrSF 2ndFlrSF LotArea LotFrontage GarageArea OverallQual OverallCond
YearBuilt YearRemodAdd TotalBathrooms TotRmsAbvGrd Fireplaces GarageCars WoodDeckSF OpenPorchSF
""".split()
KEY_CATEGORICAL = """
Neighborhood HouseStyle BldgType MSZoning SaleCondition Foundation ExterQual KitchenQual CentralAir GarageType
""".split()

# Request rules: column -> (low, high); None leaves that side open.
REQUEST_RANGES = {
    "LotFrontage": (0, 500),
    "LotArea": (500, 250000),
    "OverallQual": (1, 10),
    "OverallCond": (1, 10),
    "YearBuilt": (1800, 2026),
    "YearRemodAdd": (1800, 2026),
    "MasVnrArea": (0, None),
    "TotalBsmtSF": (0, None),
    "1stFlrSF": (0, None),
    "2ndFlrSF": (0, None),
    "GrLivArea": (200, None),
    "BsmtFullBath": (0, 4),
    "FullBath": (0, 6),
    "HalfBath": (0, 4),
    "BedroomAbvGr": (0, 12),
    "TotRmsAbvGrd": (1, 20),
    "Fireplaces": (0, 5),
    "GarageCars": (0, 6),
    "GarageArea": (0, None),
    "WoodDeckSF": (0, None),
    "OpenPorchSF": (0, None),
    "PoolArea": (0, None),
    "MoSold": (1, 12),
    "YrSold": (2000, 2026),
}
REQUEST_REQUIRED = """
MSSubClass MSZoning LotFrontage LotArea Neighborhood HouseStyle OverallQual OverallCond YearBuilt
YearRemodAdd ExterQual TotalBsmtSF 1stFlrSF GrLivArea FullBath BedroomAbvGr KitchenQual TotRmsAbvGrd
MoSold YrSold
""".split()
REQUEST_DEFAULTS = {
    "Street": "Pave",
    "LotShape": "Reg",
    "LandContour": "Lvl",
    "Utilities": "AllPub",
    "BldgType": "1Fam",
    "RoofStyle": "Gable",
    "Exterior1st": "VinylSd",
    "MasVnrArea": 0.0,
    "Foundation": "PConc",
    "BsmtQual": "TA",
    "BsmtCond": "TA",
    "HeatingQC": "TA",
    "CentralAir": "Y",
    "2ndFlrSF": 0.0,
    "BsmtFullBath": 0,
    "HalfBath": 0,
    "Fireplaces": 0,
    "GarageType": "None",
    "GarageCars": 0,
    "GarageArea": 0.0,
    "GarageQual": "None",
    "WoodDeckSF": 0.0,
    "OpenPorchSF": 0.0,
    "PoolArea": 0.0,
    "Fence": "None",
    "SaleType": "WD",
    "SaleCondition": "Normal",
}
REQUEST_ALIASES = {"FirstFlrSF": "1stFlrSF", "SecondFlrSF": "2ndFlrSF"}
REQUEST_FLOATS = """
LotFrontage MasVnrArea TotalBsmtSF 1stFlrSF 2ndFlrSF GrLivArea GarageYrBlt GarageArea WoodDeckSF OpenPorchSF
PoolArea
""".split()
# ------------------------------------------------------------ end fixed values

# Columns that go with a request: the text of a body that cannot be read, and the field names it holds.
CORRUPT, GIVEN = "corrupt", "_given"


def house_schema(with_target: bool = True) -> T.StructType:
    """The raw table: 24 integers, 4 doubles, 22 strings."""
    fields = [T.StructField(c, T.IntegerType()) for c in INT_COLUMNS]
    fields += [T.StructField(c, T.DoubleType()) for c in DOUBLE_COLUMNS if with_target or c != TARGET]
    fields += [T.StructField(c, T.StringType()) for c in STRING_COLUMNS]
    return T.StructType(fields)


def request_schema() -> T.StructType:
    """One scoring request: the raw columns without id and target, areas as doubles."""
    fields = []
    for c in INT_COLUMNS + DOUBLE_COLUMNS + STRING_COLUMNS:
        if c in (ID, TARGET):
            continue
        if c in REQUEST_FLOATS:
            kind = T.DoubleType()
        elif c in STRING_COLUMNS or c in CODE_COLUMNS:
            kind = T.StringType()
        else:
            kind = T.IntegerType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def leaderboard_schema() -> T.StructType:
    names = "mae mse rmse r2 adjusted_r2 mape cv_rmse_mean cv_rmse_std train_time_seconds".split()
    return T.StructType(
        [T.StructField("name", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names]
    )


def numeric_columns(schema: T.StructType, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def other_columns(schema: T.StructType, skip: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in schema if not isinstance(f.dataType, T.NumericType) and f.name not in skip]
