"""Report jobs: one small table per chart, written side by side."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.operators import explain, profile
from lotwise.operators.encoding import FEATURES
from lotwise.operators.gram import correlation_matrix
from lotwise.operators.metrics import error_limits, residual_table
from lotwise.operators.models import build_model
from lotwise.operators.tuning import GRIDS, learning_curve, validation_curve
from lotwise.plans.training import Prepared, predict
from lotwise.schema import ID, KEY_CATEGORICAL, KEY_NUMERIC, TARGET, numeric_columns
from lotwise.session import via_table


def eda_tables(df: DataFrame, target: str = TARGET) -> dict[str, DataFrame]:
    """The data behind every exploration chart of a cleaned, derived table."""
    numeric = [c for c in KEY_NUMERIC if c in df.columns]
    categories = [c for c in KEY_CATEGORICAL if c in df.columns]
    logged = df.select(F.log1p(col(target)).alias(f"log1p_{target}"))
    tables = {
        "target_summary": profile.target_summary(df, target),
        "target_histogram": profile.histograms(df, [target], 30),
        "log_target_histogram": profile.histograms(logged, [f"log1p_{target}"], 30),
        "histograms": profile.histograms(df, numeric, 30),
        "boxes": profile.box_stats(df, numeric),
        "missing_map": profile.missing_map(df),
        "correlation": correlation_matrix(df, numeric_columns(df.schema)),
        "top_correlation": profile.top_correlated(df, target),
        "scatter": profile.scatter(df, [c for c in numeric if c != target], target),
        "category_counts": profile.category_counts(df, categories),
        "pairs": profile.sample_rows(df, 500).select(
            *[col(c) for c in ("GrLivArea", "OverallQual", "TotalBsmtSF", "GarageArea", "YearBuilt") if c in df.columns],
            col(target),
        ),
        "year_trend": profile.group_median(df, "YearBuilt", target, descending=False),
        "market_view": profile.group_median(df, "Neighborhood", target),
    }
    for c in [*categories, "GarageCars"]:
        tables[f"box_by_{c}"] = profile.group_box(df, c, target)
    for c in ("OverallQual", "GarageCars", "Fireplaces", "BldgType"):
        if c in df.columns:
            tables[f"shape_by_{c}"] = profile.group_shapes(df, c, target, 30)
    return tables


def evaluation_tables(
    data: Prepared, model: Transformer, name: str, board: DataFrame, target: str = TARGET
) -> dict[str, DataFrame]:
    """Leaderboard, residuals, limits and curves of the winner."""
    priced = predict(model, data.test, [ID, target])
    residuals = residual_table(priced, target, "predicted", ID)
    tables = {
        "leaderboard": board,
        "residuals": residuals,
        "residual_histogram": profile.histograms(residuals, ["residual"], 40),
        "error_limits": error_limits(priced, target, "predicted"),
        "learning_curve": learning_curve(lambda: build_model(name), data.train),
    }
    if name == "ridge":
        tables["validation_curve"] = validation_curve("ridge", "alpha", GRIDS["ridge"]["alpha"], data.train)
    return tables


def explanation_tables(
    data: Prepared, model: Transformer, explained: int = explain.EXPLAINED_ROWS, permutations: int = 20
) -> dict[str, DataFrame]:
    """Contributions of a winner of any kind on a sample of the test rows, and their chart tables."""
    sample = explain.background(data.train)
    rows = profile.sample_rows(data.test, explained)
    exact = explain.row_cells(model, sample, data.slots)
    if exact is not None:
        cells = rows.select(col(ID), exact[0].alias("cells"), F.lit(exact[1]).alias("base_value"))
        if getattr(model, "coefficients", None) is None:
            cells = via_table(cells, "cells")  # every chart reads them
    else:
        phi, own_base = explain.sampled_contributions(rows, model, data.train, data.slots, permutations)
        slots = F.posexplode(vector_to_array(FEATURES)).alias("at", "x")
        names = F.array(*[F.lit(n) for n in data.slots])
        values = rows.select(col(ID), slots).select(col(ID), names[F.col("at")].alias("feature"), "x")
        listed = phi.join(values, [ID, "feature"]).groupBy(col(ID))
        listed = listed.agg(F.collect_list(F.struct("feature", "x", "contribution")).alias("cells"))  # one per feature
        cells = via_table(listed.join(own_base, ID), "cells")
    base = F.col("base_value")  # each row starts where its own contributions do
    phi = explain.long_form(cells)
    return {
        "global_summary": explain.global_summary(phi),
        "waterfall": explain.waterfall(cells, base),
        "dependence": explain.dependence(phi, explain.widest_feature(phi)),
        "decision": explain.decision_paths(cells, base),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> list[str]:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return [f"{path}/{name}" for name in tables]
