"""Scoring requests as they arrive: JSON files in, prices and quarantine out.

Stateless, so there is no watermark: each micro-batch runs the very code of batch scoring. A batch
is written under its own id and overwritten on a retry, so a lost executor or driver neither loses
nor repeats a row.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotwise.operators.scoring import score, split_valid, validated
from lotwise.schema import CORRUPT
from lotwise.sources.files import open_request_schema


def read_request_stream(
    spark: SparkSession, path: str, key: str = "Id", key_type: T.DataType | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """One JSON object per line. A line that cannot be read keeps its text and its file."""
    fields = [T.StructField(key, key_type or T.LongType()), *open_request_schema().fields, T.StructField(CORRUPT, T.StringType())]
    reader = spark.readStream.schema(T.StructType(fields)).option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return lines.select("*", F.col("_metadata.file_name").alias("file"))


def score_stream(
    requests: DataFrame,
    pipeline: Transformer,
    model_name: str,
    rmse: float,
    out: str,
    quarantine: str,
    checkpoint: str,
    key: str = "Id",
    once: bool = False,
) -> StreamingQuery:
    """Start the stream. ``once`` works off what is there and stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validated(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = split_valid(checked, key)
            score(good, pipeline, model_name, rmse, key).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        finally:
            checked.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
