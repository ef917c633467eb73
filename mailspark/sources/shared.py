"""Tables written to the folder that all executors share, so that later steps restart from files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Spark drops a query's shuffle files as soon as it ends: what it wrote replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary one is made in local mode (tests); a cluster needs a shared one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mailspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, by: list[str]) -> None:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _opened(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.saved_at = path
    return out


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    _write(df, path, [])
    return _opened(df.sparkSession, df.schema, path)


def by_slice(df: DataFrame, name: str, slices: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the rows of each ``slice`` (0 to ``slices`` - 1) in turn, the results in one table.

    The rows are written once by slice; a slice's shuffle files go before the next one starts, and its rows with them.
    """
    spark, rows, out = df.sparkSession, new_path(df.sparkSession, f"{name}-slices"), new_path(df.sparkSession, name)
    _write(df, rows, ["slice"])
    schema = StructType([f for f in df.schema if f.name != "slice"])
    empty = work(spark.createDataFrame([], schema)).limit(0)
    _write(empty, out, [])  # a table even where no slice has rows
    for k in range(slices):
        folder = f"{rows}/slice={k}"
        if exists(spark, folder):
            part = _opened(spark, schema, folder)
            _write(work(part), out, [])
            discard(part)
    return _opened(spark, empty.schema, out)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def discard(*frames: DataFrame) -> None:
    """Delete saved tables that no later step reads."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
