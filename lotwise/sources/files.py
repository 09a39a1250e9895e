"""Reading and writing: house tables, requests, leaderboards, feature lists, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.scalar import col, no_nan, strip
from lotwise.schema import CORRUPT, GIVEN, NA_TOKENS, REQUEST_ALIASES, house_schema, leaderboard_schema, request_schema


# -------------------------------------------------------------------- house rows
def read_house_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header. Missing-value tokens become NULL, unreadable numbers too.

    Columns are matched by name; those without a declared type stay text. Cells are read as text
    because Spark knows one missing-value token per reader, then cast in the same projection. A quote
    inside a quoted cell is written twice. The files of a folder must have one column order: a file with
    another header ends the read instead of shifting its cells.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    names = reader.csv(path).columns
    raw = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("enforceSchema", False).csv(path)
    kinds = {f.name: f.dataType for f in (schema or house_schema())}
    out = []
    for name in raw.columns:
        text = col(name)
        cell = F.when(~strip(text).isin(NA_TOKENS), text)
        kind = kinds.get(name.strip(), T.StringType())
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            cell = no_nan(strip(cell).try_cast("double"))
        elif isinstance(kind, T.NumericType):  # whole numbers may be written as 3.0
            cell = strip(cell).try_cast("double").try_cast(kind)
        out.append(cell.alias(name))
    return raw.select(*out)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """The raw cache; CSV gets a header."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def _read_any(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame | None:
    """The table at ``path``, by suffix; None if there is none."""
    try:
        if path.endswith(".csv"):
            return read_house_csv(spark, path, schema)
        if path.endswith(".json"):
            return spark.read.schema(schema or house_schema()).json(path)
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def resolve_source(
    spark: SparkSession,
    cache: str,
    candidates: Sequence[str],
    force: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The cached table, or the first candidate that exists, which is then cached as parquet."""
    if not force:
        cached = _read_any(spark, cache, schema)
        if cached is not None:
            return cached
    for path in candidates:
        found = _read_any(spark, path, schema)
        if found is not None:
            write_table(found, cache)
            return spark.read.schema(found.schema).parquet(cache)
    raise RuntimeError(f"None of the sources exists: {list(candidates)}")


# ---------------------------------------------------------------------- requests
def open_request_schema() -> T.StructType:
    """Request fields plus the alias spellings, all as text: cells are converted by the request rules, so
    one that cannot be read is reported and neither ends the job nor looks like an absent one."""
    return T.StructType([T.StructField(n, T.StringType()) for n in [*request_schema().names, *REQUEST_ALIASES]])


def records(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A handful of dicts as request rows with their position (for clients, not for tables)."""
    names = open_request_schema().names
    kind = T.StructType(
        [
            T.StructField("row_index", T.IntegerType()),
            *open_request_schema().fields,
            T.StructField(GIVEN, T.ArrayType(T.StringType())),
            T.StructField("explain", T.BooleanType()),
        ]
    )
    cells = []
    for i, row in enumerate(rows):
        values = [None if row.get(n) is None else str(row[n]) for n in names]
        cells.append([i, *values, list(row), bool(row.get("explain", False))])
    return spark.createDataFrame(cells, kind)


_READ = {"columnNameOfCorruptRecord": CORRUPT}


def _body(value: Column, name: str) -> Column:
    """The JSON text of one field of a body, with ``explain``; a broken body has ``corrupt``."""
    return F.from_json(value, f"{name} string, explain string, {CORRUPT} string", _READ)


def _properties(df: DataFrame, kept: Sequence[str], text: Column, broken: Column, body: Column) -> DataFrame:
    """The fields of a property given as JSON text; ``body`` is kept where it cannot be read."""
    schema = T.StructType([*open_request_schema().fields, T.StructField(CORRUPT, T.StringType())])
    read = df.withColumn("_p", F.from_json(text, schema, _READ))
    names = F.json_object_keys(text)
    unread = broken | text.isNull() | F.col("_p").isNull() | F.col(f"_p.{CORRUPT}").isNotNull() | names.isNull()
    return read.select(
        *[col(c) for c in kept],
        *[F.col("_p")[n].alias(n) for n in open_request_schema().names],
        names.alias(GIVEN),
        F.when(unread, F.coalesce(body, F.lit(""))).alias(CORRUPT),
    )


def parse_requests(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON bodies ``{"property": {...}, "explain": ...}`` as flat rows; none is lost."""
    kept = [c for c in df.columns if c != value]
    parsed = df.withColumn("_b", _body(col(value), "property")).withColumn("explain", _asked("_b.explain"))
    broken = F.col(f"_b.{CORRUPT}").isNotNull()
    return _properties(parsed, [*kept, "explain"], F.col("_b.property"), broken, col(value))


def parse_batches(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON bodies ``{"properties": [...], "explain": ...}`` as rows with their position.

    Entries are read one by one, so a broken one spoils no other. A body without a list of properties is
    one row without a position.
    """
    kept = [c for c in df.columns if c != value]
    parsed = df.withColumn("_b", _body(col(value), "properties")).withColumn("explain", _asked("_b.explain"))
    listed = F.when(F.startswith(F.trim(F.col("_b.properties")), F.lit("[")), F.from_json("_b.properties", "array<string>"))
    rows = (
        parsed.withColumn("_list", listed)
        .select("*", F.posexplode_outer("_list").alias("row_index", "_entry"))
        .where(F.col("_list").isNull() | F.col("row_index").isNotNull())
    )
    broken = F.col("_list").isNull()
    body = F.when(broken, col(value)).otherwise(F.col("_entry"))
    return _properties(rows, [*kept, "explain", "row_index"], F.col("_entry"), broken, body)


def _asked(flag: str) -> Column:
    return F.coalesce(F.lower(F.col(flag)) == "true", F.lit(False))


# ----------------------------------------------------------- leaderboard and logs
def save_leaderboard(board: DataFrame, path: str) -> None:
    """``board`` with ``is_best`` (see ``metrics.ranked``) gets its time stamp and is written as JSON."""
    board.withColumn("trained_at", F.current_timestamp()).write.mode("overwrite").json(path)


def read_leaderboard(spark: SparkSession, path: str, array_form: bool = False) -> DataFrame:
    """JSON lines, or one file with an array."""
    schema = T.StructType(
        [
            *leaderboard_schema().fields,
            T.StructField("position", T.IntegerType()),
            T.StructField("is_best", T.BooleanType()),
            T.StructField("trained_at", T.TimestampType()),
        ]
    )
    return spark.read.schema(schema).option("multiLine", array_form).json(path)


def save_feature_list(spark: SparkSession, names: Sequence[str], path: str) -> None:
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "pos int, name string").coalesce(1).write.mode("overwrite").json(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """One entry per column of the model."""
    table = spark.read.schema("pos int, name string").json(path)
    return [r["name"] for r in table.orderBy("pos").collect()]


RUN_SCHEMA = "model string, logged_at timestamp, params map<string,string>, metrics map<string,double>"


def run_rows(spark: SparkSession, runs: Sequence[tuple[str, dict, dict]]) -> DataFrame:
    """One row per trained model: parameters that are set, metrics that are numbers."""
    rows = []
    for model, params, metrics in runs:
        kept = {k: str(v) for k, v in params.items() if v is not None}
        numbers = {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        rows.append((model, kept, numbers))
    schema = "model string, params map<string,string>, metrics map<string,double>"
    out = spark.createDataFrame(rows, schema)
    return out.select("model", F.current_timestamp().alias("logged_at"), "params", "metrics")


def log_runs(spark: SparkSession, runs: Sequence[tuple[str, dict, dict]], path: str) -> None:
    run_rows(spark, runs).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)
