"""Scaling and one-hot encoding as JVM-side ML stages, fitted once and saved with the model."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scalar import col
from lotwise.schema import ID, TARGET, numeric_columns, other_columns

FEATURES = "features"
MAX_LABELS = 10_000


def _check_labels(df: DataFrame, columns: Sequence[str], limit: int) -> None:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    counted = df.select(F.inline(cells)).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    wide = [f"{r['column']} ({r['n']})" for r in counted.where(F.col("n") > limit).collect()]  # one row per column
    if wide:
        raise ValueError(f"More than {limit} values, which is no code column: {', '.join(sorted(wide))}")


class AlignColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the columns of training that a table lacks: 0, as text in text columns."""

    columns = Param(Params._dummy(), "columns", "names and types (JSON)", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns="{}"):
        super().__init__()
        self._setDefault(columns="{}")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        kinds = json.loads(self.getOrDefault(self.columns))
        missing = {c: F.lit(0).cast(kind) for c, kind in kinds.items() if c not in df.columns}
        return df.withColumns(missing) if missing else df


def align_stage(df: DataFrame, names: Sequence[str]) -> AlignColumns:
    return AlignColumns(columns=json.dumps({n: df.schema[n].dataType.simpleString() for n in names}))


def split_feature_types(df: DataFrame, skip: Sequence[str] = (ID, TARGET)) -> tuple[list[str], list[str]]:
    return numeric_columns(df.schema, tuple(skip)), other_columns(df.schema, tuple(skip))


def standardize_columns(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / population std`` as columns; a constant column becomes 0. One aggregate pass."""
    source = fitted_on if fitted_on is not None else df
    stats = source.agg(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    new = {}
    for i, c in enumerate(columns):
        mean, std = stats[f"m{i}"], stats[f"s{i}"]
        new[c] = (col(c) - F.lit(mean)) / F.lit(std if std else 1.0)
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def onehot_long(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame, key: str = ID) -> DataFrame:
    """``key, feature`` for the ones of the encoding; values not seen in ``fitted_on`` give no row.

    The long form of the encoder, for looking at it with SQL.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns])
    seen = fitted_on.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    ones = df.select(col(key), F.inline(cells)).join(seen, ["column", "value"], "left_semi")
    return ones.select(col(key), F.concat_ws("_", "column", "value").alias("feature"))


def fit_encoder(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    scaling: str = "standard",
    max_labels: int = MAX_LABELS,
) -> PipelineModel:
    """Numeric block, then one-hot block, into ``features``; all other columns stay as they are.

    The label lists live on the driver, so a text column with more than ``max_labels`` values (a key, free
    text) is an error, found before any list is built.

    Spark's scaler divides by the sample deviation; one constant factor turns that into the
    population deviation. Unseen or missing categories give an all-zero block.
    """
    stages, blocks = [], []
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="num_block", handleInvalid="error"))
        if scaling == "standard":
            n = df.count()
            scaler = StandardScaler(inputCol="num_block", outputCol="num_std", withMean=True, withStd=True)
            stages.append(scaler.fit(stages[0].transform(df)))
            factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
            stages.append(
                ElementwiseProduct(
                    inputCol="num_std", outputCol="num_scaled", scalingVec=Vectors.dense([factor] * len(numeric))
                )
            )
            blocks.append("num_scaled")
        else:
            blocks.append("num_block")
    if categorical:
        _check_labels(df, categorical, max_labels)
        indexer = StringIndexer(
            inputCols=list(categorical),
            outputCols=[f"{c}_ix" for c in categorical],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ).fit(df)
        encoder = OneHotEncoder(
            inputCols=[f"{c}_ix" for c in categorical],
            outputCols=[f"{c}_hot" for c in categorical],
            handleInvalid="error",
            dropLast=True,
        ).fit(indexer.transform(df))
        stages += [indexer, encoder]
        blocks += [f"{c}_hot" for c in categorical]
    stages.append(VectorAssembler(inputCols=blocks, outputCol=FEATURES))
    return PipelineModel(stages)


def build_full_preprocessor(df: DataFrame, scaling: str = "standard") -> PipelineModel:
    numeric, categorical = split_feature_types(df)
    return fit_encoder(df, numeric, categorical, scaling)


def encoded_names(encoder: PipelineModel) -> list[str]:
    """Names of the slots of ``features``: numeric columns, then ``column_value``."""
    names: list[str] = []
    for stage in encoder.stages:
        kind = type(stage).__name__
        if kind == "VectorAssembler" and stage.getOutputCol() == "num_block":
            names += stage.getInputCols()
        elif kind == "StringIndexerModel":
            for c, labels in zip(stage.getInputCols(), stage.labelsArray):
                names += [f"{c}_{label}" for label in labels]
    return names


def encode(encoder: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` plus ``features`` only: helper columns do not travel on."""
    return encoder.transform(df).select(*[col(c) for c in keep], FEATURES)

