"""Session-level helpers: durable intermediate tables, spreading, size checks."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


BATCH_BYTES = 16 << 20  # of a batch of rows of known length

_STEPS = threading.local()  # the open steps of a thread, the innermost last
_LOCAL_DIRS: dict[str, str] = {}  # folders of applications in local mode, by application id


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; in local mode, where one machine does
    all the work, a temp folder if it names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        configured = _LOCAL_DIRS.get(application) or _LOCAL_DIRS.setdefault(application, tempfile.mkdtemp(prefix="bindscape-"))
    return configured


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back.  The shuffle files of the write go with its end
    instead of staying until the driver collects garbage: from here on the table is read."""
    spark = df.sparkSession
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, row_bytes: int) -> Iterator[None]:
    """Jobs inside send Python workers batches that the number of rows alone keeps below ``BATCH_BYTES``;
    rows have ``row_bytes`` at most.  Where Spark is to bound bytes, it sizes the batch anew
    for every row, which takes longer than sending short rows does."""
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = {name: spark.conf.get(name, None) for name in (rows, size)}
    now, fit = int(spark.conf.get(rows)), max(1, BATCH_BYTES // max(row_bytes, 1))
    spark.conf.set(rows, str(min(now, fit) if now > 0 else fit))
    spark.conf.set(size, str(2**31 - 1))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What produced it runs once, several branches can read it, a lost executor
    re-reads files, and the planner knows its true size.
    """
    return write_table(df, scratch_path(df.sparkSession, "settled"))


def broadcast_if_small(dim: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Settle a dimension table; mark it for broadcast when its count allows.

    Keys such as sample or chromosome are few and hot: joining them by shuffle
    would send all rows of one key to one task.
    """
    table = settle(dim)
    return F.broadcast(table) if table.count() <= max_rows else table


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/bindscape/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if open_ := getattr(_STEPS, "open", None):
        open_[-1].paths.append(path)
    return path


class StepTables:
    """The tables of the shared folder that a step has written so far."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def only(self, *frames: DataFrame) -> None:
        """Remove those that none of ``frames`` reads; no other frame may be used from here on."""
        read = {folder for df in frames for file in df.inputFiles() for folder in file.split("/")}
        for path in self.paths:
            if path.rsplit("/", 1)[1] not in read:
                remove(self.spark, path)
        self.paths = [path for path in self.paths if path.rsplit("/", 1)[1] in read]


@contextlib.contextmanager
def step_tables(spark: SparkSession) -> Iterator[StepTables]:
    """The tables that are written inside; those that it has not removed stay, as tables of the step around it."""
    open_ = _STEPS.__dict__.setdefault("open", [])
    open_.append(StepTables(spark))
    try:
        yield open_[-1]
    finally:
        step = open_.pop()
        if open_:
            open_[-1].paths += step.paths


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application has settled; call when its results are out."""
    remove(spark, _scratch_root(spark))


def spread(df: DataFrame, *cols) -> DataFrame:
    """Repartition to a fixed count before work whose cost the bytes do not
    show (row generation, Python scans, repeated passes); a fixed count is not
    coalesced at run time."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *cols)


def rows_if_small(df: DataFrame, max_rows: int):
    """Rows of ``df`` when it has at most ``max_rows``, else ``None``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
