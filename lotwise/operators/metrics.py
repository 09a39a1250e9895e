"""Error measures, the leaderboard and its reports. Each is one aggregate over predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.scalar import col

# ---------------------------------------------------------------- fixed values
BOARD_TITLES = {
    "name": "Model",
    "rmse": "RMSE ($)",
    "mae": "MAE ($)",
    "r2": "R²",
    "mape": "MAPE (%)",
    "cv_rmse_mean": "CV RMSE",
}
# ------------------------------------------------------------ end fixed values


def metric_columns(y: Column, p: Column, n_features: int) -> list[Column]:
    # All measures are over the rows that have both values.
    y = F.when(p.isNotNull(), y)
    error = y - p
    mse = F.avg(error * error)
    n = F.count(F.when(error.isNotNull(), 1))
    r2 = 1 - F.try_divide(F.sum(error * error), F.var_pop(y) * n)
    free = n - n_features - 1
    adjusted = F.when(free > 0, 1 - (1 - r2) * (n - 1) / F.nullif(free, F.lit(0))).otherwise(r2)
    return [
        F.avg(F.abs(error)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        r2.alias("r2"),
        adjusted.alias("adjusted_r2"),
        (100 * F.avg(F.when(y != 0, F.abs(error / F.nullif(y, F.lit(0.0)))))).alias("mape"),
        F.avg(F.when(y != 0, (F.abs(error) <= 0.1 * F.abs(y)).cast("double"))).alias("within_10_percent"),
    ]


def regression_metrics(
    predictions: DataFrame, actual: str, predicted: str, n_features: int, by: Sequence[str] = ()
) -> DataFrame:
    """One row (per group): mae, mse, rmse, r2, adjusted_r2, mape, within_10_percent."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    return predictions.groupBy(*[col(b) for b in by]).agg(*metric_columns(y, p, n_features))


def fold_summary(scores: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Mean and population deviation of fold errors."""
    return scores.groupBy(*by).agg(
        F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std")
    )


def ranked(board: DataFrame, by: str = "rmse") -> DataFrame:
    """Leaderboard order and the winner's flag. One row per model, so one small window."""
    order = Window.orderBy(F.col(by).asc_nulls_last(), F.col("name"))
    return board.withColumn("position", F.row_number().over(order)).withColumn("is_best", F.col("position") == 1)


def select_best(board: DataFrame, by: str = "rmse") -> str:
    row = board.orderBy(F.col(by).asc_nulls_last(), "name").select("name").first()
    if row is None:
        raise RuntimeError("No model was trained.")
    return row["name"]


def board_view(board: DataFrame) -> DataFrame:
    """Six columns under their display titles."""
    return board.select(*[F.col(c).alias(t) for c, t in BOARD_TITLES.items()])


def model_info(board: DataFrame, names: DataFrame) -> DataFrame:
    """The winning row with the number of feature columns."""
    best = board.where("is_best").select(
        F.col("name").alias("model_name"),
        "trained_at",
        F.col("rmse").alias("test_rmse"),
        F.col("r2").alias("test_r2"),
        F.col("mape").alias("test_mape"),
    )
    counted = names.agg(F.count(F.lit(1)).alias("feature_count"))
    return best.crossJoin(counted)  # one row by one row


def residual_table(predictions: DataFrame, actual: str, predicted: str, key: str) -> DataFrame:
    return predictions.select(
        col(key), col(predicted).alias("predicted"), (col(actual) - col(predicted)).alias("residual")
    )


def error_limits(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Common axis limits of actual and predicted."""
    return predictions.agg(
        F.least(F.min(col(actual)), F.min(col(predicted))).alias("low"),
        F.greatest(F.max(col(actual)), F.max(col(predicted))).alias("high"),
    )
