"""Session settings for local runs, and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROW_GROUP_BYTES = 8 * 1024 * 1024
#: Keys are hex digits, of which this codec stores half the bytes.
COMPRESSION = "zstd"
#: Deletes what an action has shuffled when it ends, instead of some time after.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task writing a partitioned table keeps open; rows of further values are sorted first.
_OPEN_WRITERS, _FEW_VALUES = "spark.sql.maxConcurrentOutputFileWriters", 8


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "ledgerlens") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A single-machine session (``local[...]``, as in tests) without the setting gets a scratch
    folder that goes when Python ends.  Any other session must name the folder: a local one
    would scatter the tables over the executors' disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, _SCRATCH[app], ignore_errors=True)
    return _SCRATCH[app]


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    Used where several passes read the same derived table: the scan prunes
    columns and pushes filters down, and survives the loss of any executor.
    """
    path = new_folder(df.sparkSession, name)
    write_staged(df, path, partition_by)
    return read_staged(df.sparkSession, path, df.schema)


def write_staged(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes a staged table with row groups small enough for a single file to be read by many tasks.

    The few values of ``partition_by`` are written side by side, so a task's rows are not sorted by them.
    """
    spark, writer = df.sparkSession, df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", COMPRESSION)
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        if not partition_by:
            writer.parquet(path)
            return
        with setting(spark, _OPEN_WRITERS, str(_FEW_VALUES)):
            writer.partitionBy(*partition_by).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Holds a setting of the session for the actions of the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows that a task groups or sorts.
_TASK_ROWS = 2_000_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Deals rows by columns to more tasks than the session's number if that is too few for them.

    What is grouped by these columns afterwards is not shuffled again. Copies are not collapsed before, so a key must have few rows.
    """
    tasks = rows // _TASK_ROWS + 1
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def read_staged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan of a staged table with its columns in schema order."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under this application's id."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex[:8]}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


_OPEN: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged inside the block when it ends; results must have been written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for name in _OPEN.pop():
            delete_folder(spark, name)


def delete_folder(spark: SparkSession, name: str) -> None:
    """Deletes a staged table that no later pass reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """Driver-side scalars (fitted parameters, search targets) as a local relation.

    ``columns`` maps names to SQL types.  The rows are parameters, never data:
    their number is fixed by the operator that calls this.
    """
    if not rows:
        fields = ", ".join(f"cast(null as {t}) as {c}" for c, t in columns.items())
        return spark.sql(f"select {fields} where false")

    def text(value, kind: str) -> str:
        if value is None:
            return f"cast(null as {kind})"
        if isinstance(value, (bool, int)):
            return f"cast({value} as {kind})"
        if isinstance(value, float):
            return f"cast('{value!r}' as {kind})"
        quoted = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{quoted}'"

    kinds = list(columns.values())
    body = ", ".join("(" + ", ".join(text(v, k) for v, k in zip(row, kinds)) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(columns)})")
