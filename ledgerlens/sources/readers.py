"""Reading transaction logs, scoring requests and configuration."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import content_key
from ..operators.scoring import with_request_defaults
from ..schema import KEY, LABEL, REQUEST, TRANSACTIONS
from ..session import stage

log = logging.getLogger(__name__)
_BAD = "_bad_record"
#: Column of a row's place in its log.
FILE_ROW = "file_row"
_COPIES_PER_TASK = 100_000


def with_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """Adds a stable key to a table that has none: a hash of the content and the copy number.

    Copies of a row are counted and then unrolled again, so a row copied very
    often is spread over tasks instead of being numbered in one of them.
    """
    if key in df.columns:
        return df
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    block = F.lit(_COPIES_PER_TASK)

    def unroll(part: DataFrame) -> DataFrame:
        last = F.least(F.col("_n"), (F.col("_block") + 1) * block) - 1
        return part.withColumn("_copy", F.explode(F.sequence(F.col("_block") * block, last)))

    few = counted.where(F.col("_n") <= block).withColumn("_block", F.lit(0).cast("bigint"))
    many = (
        counted.where(F.col("_n") > block)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block))))
        .repartition("_block", *columns)
    )
    rows = unroll(few).unionByName(unroll(many))
    return rows.select(F.md5(F.concat_ws("|", content_key(columns), F.col("_copy").cast("string"))).alias(key), *columns)


def validate_source(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """The raw scan; a missing path is a ``FileNotFoundError``."""
    try:
        raw = spark.read.format(file_format).option("header", True).load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"Dataset not found at {path}") from problem
        raise
    log.info("reading %s", path)
    return raw


def _file_schema(columns: list[str], schema: T.StructType) -> T.StructType:
    known = {f.name: f for f in schema.fields}
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in columns])


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The readable rows of a CSV log, without those that have more fields than the header."""
    columns = validate_source(spark, path).columns
    full = _file_schema(columns, schema)
    rows = (
        spark.read.schema(T.StructType([*full.fields, T.StructField(_BAD, T.StringType())]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _BAD)
        .csv(path)
    )
    unquoted = F.regexp_replace(F.col(_BAD), '"[^"]*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    return rows.where(F.col(_BAD).isNull() | (fields <= len(columns)))


def read_transactions(spark: SparkSession, path: str, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """A CSV log with a header in any column order.

    Rows with more fields than the header are skipped.  Short rows are padded
    with nulls and unreadable values become null, so neither is lost.
    """
    return with_key(_rows(spark, path, schema).drop(_BAD))


def read_in_file_order(spark: SparkSession, path: str, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """The same rows with ``file_row``: the place of each in the log, from 0, files in the order of their names.

    A split's rows come in the order of the file, so a row's place is its place in the split plus the rows of all
    splits before. Only the splits' row counts are summed up in one place. Without a key of its own a row is keyed by content and place.
    """
    read = _rows(spark, path, schema)
    names = [c for c in read.columns if c != _BAD]
    # The running number comes after the filter, so skipped rows take no place. It is written, so both uses see the same.
    rows = stage(read.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn(
        "_at", F.monotonically_increasing_id()), "file-order")
    splits = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row a split.
    before = F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    placed = rows.join(splits.select("_file", "_block", (before - F.col("_first")).alias("_shift")), ["_file", "_block"])
    placed = placed.select(*names, (F.col("_at") + F.col("_shift")).alias(FILE_ROW))
    if KEY in names:
        return placed
    return placed.select(F.md5(F.concat_ws("|", content_key(names), F.col(FILE_ROW).cast("string"))).alias(KEY), *names, FILE_ROW)


def read_parquet_transactions(spark: SparkSession, path: str) -> DataFrame:
    return with_key(validate_source(spark, path, "parquet"))


def read_columns(spark: SparkSession, path: str, columns: list[str], file_format: str = "parquet") -> DataFrame:
    """A column subset; only those columns reach the scan."""
    if file_format == "csv":
        return read_transactions(spark, path).select(*columns)
    return validate_source(spark, path, file_format).select(*columns)


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fraud rows, all other rows) for augmentation; an unreadable label is not fraud."""
    rows = read_transactions(spark, path)
    fraud = F.coalesce(F.col(LABEL) == 1, F.lit(False))
    return rows.where(fraud), rows.where(~fraud)


def read_requests(spark: SparkSession, requests: list[dict] | DataFrame | str) -> DataFrame:
    """Scoring requests from dicts, a table or a JSON-lines path, with defaults for missing fields.

    Requests without a key get their position (dicts) or a content key.
    """
    if isinstance(requests, str):
        rows = spark.read.schema(REQUEST).json(requests)
        blank = rows.where(F.col(KEY).isNull()).drop(KEY)
        return with_request_defaults(rows.where(F.col(KEY).isNotNull()).unionByName(with_key(blank)))
    if isinstance(requests, DataFrame):
        return with_request_defaults(with_key(requests))
    names = [f.name for f in REQUEST.fields]
    typed = []
    for i, request in enumerate(requests):
        row = [request.get(n) for n in names]
        row[0] = str(request.get(KEY, i))
        typed.append([float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for v, f in zip(row, REQUEST.fields)])
    return with_request_defaults(spark.createDataFrame(typed, REQUEST))
