"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """A double, rounded: sums in another order differ in the last bits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


# The house table as plain SQL (the same view as ``sources.listing``).
LISTING = """
li AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_totalprice AS tp, o.o_orderpriority AS pr,
             o.o_orderstatus AS st, year(o.o_orderdate) AS y, month(o.o_orderdate) AS m,
             cu.c_acctbal AS bal, cu.c_mktsegment AS seg, n.n_name AS nb,
             li.n_lines AS n_lines, li.qty AS qty, (o.o_custkey * 13) % 90 AS age
      FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey
                    JOIN nation n ON cu.c_nationkey = n.n_nationkey
                    LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
listing AS (
SELECT k AS Id, 20 + 10 * (c % 10) AS MSSubClass, seg AS MSZoning, nb AS Neighborhood,
  CASE WHEN k % 6 = 0 THEN NULL ELSE 21 + abs(bal) / 100 END AS LotFrontage,
  CASE WHEN k % 97 = 0 THEN 0 ELSE CAST(floor(tp / 20) AS INT) END AS LotArea,
  1 + (c * 7) % 10 AS OverallQual, 1 + k % 9 AS OverallCond,
  y - age AS YearBuilt, y - age + least(k % 40, age) AS YearRemodAdd,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 300 AS DOUBLE) END AS MasVnrArea,
  CASE pr WHEN '1-URGENT' THEN 'Ex' WHEN '2-HIGH' THEN 'Gd' WHEN '3-MEDIUM' THEN 'TA'
          WHEN '4-NOT SPECIFIED' THEN 'Fa' ELSE 'Po' END AS ExterQual,
  CASE k % 4 WHEN 0 THEN ' TA ' WHEN 1 THEN 'Gd' WHEN 2 THEN 'Ex' ELSE 'Fa' END AS KitchenQual,
  CASE WHEN k % 41 = 0 THEN NULL WHEN c % 3 = 0 THEN 'Gd' ELSE 'TA' END AS BsmtQual,
  CASE st WHEN 'F' THEN 'Gd' WHEN 'O' THEN 'TA' ELSE 'Ex' END AS HeatingQC,
  (c * 29) % 2000 AS TotalBsmtSF, 334 + (c * 37) % 1800 AS "1stFlrSF",
  CASE WHEN k % 9 < 4 THEN 0 ELSE (k * 53) % 1400 END AS "2ndFlrSF",
  334 + (c * 37) % 1800 + CASE WHEN k % 9 < 4 THEN 0 ELSE (k * 53) % 1400 END + k % 60 AS GrLivArea,
  c % 2 AS BsmtFullBath, 1 + k % 3 AS FullBath, k % 2 AS HalfBath, k % 6 AS BedroomAbvGr,
  3 + k % 10 AS TotRmsAbvGrd, k % 4 AS Fireplaces,
  CASE WHEN n_lines IS NULL THEN NULL WHEN n_lines > 4 THEN 4 ELSE n_lines END AS GarageCars,
  qty * 5 AS GarageArea,
  CASE WHEN n_lines IS NULL THEN NULL WHEN k % 3 = 0 THEN 'Detchd' ELSE 'Attchd' END AS GarageType,
  CASE WHEN n_lines IS NULL THEN NULL ELSE CAST(y - age AS DOUBLE) END AS GarageYrBlt,
  CASE WHEN n_lines IS NULL THEN NULL ELSE 'TA' END AS GarageQual,
  (k * 17) % 300 AS WoodDeckSF, (c * 11) % 200 AS OpenPorchSF,
  CASE WHEN k % 200 = 0 THEN 400 ELSE 0 END AS PoolArea,
  CASE WHEN k % 5 = 0 THEN 'MnPrv' ELSE NULL END AS Fence, m AS MoSold, y AS YrSold,
  20000 + 55 * (334 + (c * 37) % 1800 + CASE WHEN k % 9 < 4 THEN 0 ELSE (k * 53) % 1400 END)
    + 12000 * (1 + (c * 7) % 10) + 30 * coalesce(qty * 5, 0) - 210 * age + 0.02 * tp AS SalePrice
FROM b)
"""

# Trimmed and filled, fills learned on all rows.
CLEAN = """,
clean AS (SELECT * REPLACE (
    trim(KitchenQual) AS KitchenQual, CAST(MSSubClass AS VARCHAR) AS MSSubClass,
    coalesce(LotFrontage, (SELECT median(LotFrontage) FROM listing)) AS LotFrontage,
    coalesce(MasVnrArea, 0) AS MasVnrArea, coalesce(BsmtQual, 'None') AS BsmtQual,
    coalesce(GarageCars, 0) AS GarageCars, coalesce(GarageArea, 0) AS GarageArea,
    coalesce(GarageType, 'None') AS GarageType, coalesce(GarageYrBlt, 0) AS GarageYrBlt,
    coalesce(GarageQual, 'None') AS GarageQual, coalesce(Fence, 'None') AS Fence)
  FROM listing)
"""


def points(c: str) -> str:
    return f"CASE {c} WHEN 'Po' THEN 1 WHEN 'Fa' THEN 2 WHEN 'TA' THEN 3 WHEN 'Gd' THEN 4 WHEN 'Ex' THEN 5 ELSE 0 END"


DERIVED_SQL = f"""
    greatest(YrSold - YearBuilt, 0) AS HouseAge,
    greatest(YrSold - YearRemodAdd, 0) AS RemodAge,
    greatest(YrSold - GarageYrBlt, 0) AS GarageAge,
    CASE WHEN greatest(YrSold - YearRemodAdd, 0) < greatest(YrSold - YearBuilt, 0) THEN 1 ELSE 0 END AS IsRemodeled,
    CASE WHEN greatest(YrSold - YearBuilt, 0) <= 5 THEN 1 ELSE 0 END AS IsNewHouse,
    coalesce(CAST(GarageArea AS DOUBLE) / nullif(LotArea, 0), 0) AS GarageRatio,
    least(coalesce(CAST(TotalBsmtSF AS DOUBLE) / nullif("1stFlrSF", 0), 0), 3) AS BasementRatio,
    coalesce(CAST(GrLivArea AS DOUBLE) / nullif(LotArea, 0), 0) AS LivingAreaRatio,
    OpenPorchSF + WoodDeckSF AS TotalPorchSF,
    "1stFlrSF" + "2ndFlrSF" + TotalBsmtSF AS TotalSF,
    FullBath + 0.5::DOUBLE * HalfBath + BsmtFullBath AS TotalBathrooms,
    TotRmsAbvGrd + FullBath + 0.5::DOUBLE * HalfBath + BsmtFullBath AS TotalRooms,
    coalesce(CAST(TotRmsAbvGrd AS DOUBLE) / nullif(BedroomAbvGr, 0), TotRmsAbvGrd) AS RoomsPerBedroom,
    ({points('ExterQual')} + {points('KitchenQual')} + {points('HeatingQC')} + {points('BsmtQual')}
      + {points('GarageQual')}) / 5.0::DOUBLE AS ConstructionQualityIndex,
    0.7::DOUBLE * OverallQual + 0.3::DOUBLE * OverallCond AS OverallQualCondScore,
    CASE WHEN PoolArea > 0 THEN 2 ELSE 0 END + least(Fireplaces, 2) + CASE WHEN GarageCars >= 3 THEN 2 ELSE 0 END
      + CASE WHEN OpenPorchSF + WoodDeckSF > porch THEN 1 ELSE 0 END AS LuxuryScore,
    CASE WHEN GrLivArea <= 900 THEN 'Compact' WHEN GrLivArea <= 1400 THEN 'Small' WHEN GrLivArea <= 2000 THEN 'Medium'
         WHEN GrLivArea <= 2800 THEN 'Large' ELSE 'Estate' END AS PropertySizeCategory,
    place AS NeighborhoodQualityScore,
    OverallQual * CAST(GrLivArea + TotalBsmtSF AS DOUBLE) / 1000 AS PropertyValueIndex
"""
DERIVED_CTE = f""",
with_stats AS (SELECT *, (SELECT median(OpenPorchSF + WoodDeckSF) FROM clean) AS porch,
    avg(OverallQual) OVER (PARTITION BY Neighborhood) AS place FROM clean),
derived AS (SELECT * EXCLUDE (porch, place), {DERIVED_SQL} FROM with_stats)
"""


def bucket(key: str, n: int, seed: int) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT % {n})"


def with_listing(body: str, *ctes: str) -> str:
    return f"WITH {LISTING}{''.join(ctes)} {body}"


def with_clean(body: str, *ctes: str) -> str:
    return with_listing(body, CLEAN, *ctes)


def with_derived(body: str, *ctes: str) -> str:
    return with_listing(body, CLEAN, DERIVED_CTE, *ctes)
