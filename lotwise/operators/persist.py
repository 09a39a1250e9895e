"""Saving for stages that carry a table besides their parameters."""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter


class WithTable(MLWritable, MLReadable):
    """The table lives in the attribute ``table`` and is written next to the parameters."""

    table = None

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: WithTable):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        table = self.stage.table
        extra = {"tableSchema": json.loads(table.schema.json()) if table is not None else None}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata=extra)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        from pyspark.sql.types import StructType

        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        if metadata["tableSchema"] is not None:
            schema = StructType.fromJson(metadata["tableSchema"])
            stage.table = self.sparkSession.read.schema(schema).parquet(f"{path}/table")
        return stage
