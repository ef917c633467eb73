"""Cases on disk with what belongs to them, saved by partition and safe to save again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailspark.sources.shared import discard, saved


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def read_part(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stored table; an empty one where nothing has been saved yet."""
    system, place = _files(spark, f"{folder}/{name}")
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if system.exists(place) else spark.createDataFrame([], schema)


def _replace(rows: DataFrame, folder: str, name: str, touched: list[int]) -> None:
    """Overwrite the partitions that ``rows`` has; touched ones that it lacks have become empty and go."""
    spark = rows.sparkSession
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/{name}")
    held = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most as many as buckets
    for bucket in sorted(set(touched) - held):
        system, place = _files(spark, f"{folder}/{name}/bucket={bucket}")
        system.delete(place, True)


def save_cases(folder: str, cases: DataFrame, children: dict[str, DataFrame], version: str = "version", buckets: int = 256) -> None:
    """Save cases (case_id, version, ...) and their children (case_id, ...; such as signals and indicators).

    A case is replaced if the fresh version is not older than the stored one, and then all its children are; a late
    older one changes neither.  Of several fresh rows of a case the newest counts, of equal versions the largest row.
    Tables are partitioned by a hash of the case, and only partitions with a fresh case are read and written, so a
    save costs what it touches.  Each table is merged into a table of its own first; saving the same again, also after
    a save that was cut short between two tables, gives the same store.  Fresh children of cases that are not saved
    are left out.  Columns must be orderable (no maps); all saves into a folder must use the same number of buckets.
    Ids meet by sorted shuffles: as compressed files they look small enough to broadcast, but there is one for each case.
    """
    spark = cases.sparkSession
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int").alias("bucket")
    whole = F.struct(*cases.columns)
    newest = cases.groupBy("case_id").agg(F.max_by(whole, F.struct(version, whole)).alias("c")).select("c.*")
    fresh = saved(newest.select(*cases.columns, bucket), "fresh")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most as many as buckets
    mine = F.col("bucket").isin(touched)
    stored = read_part(spark, folder, "cases", fresh.schema).where(mine)
    have = stored.select("case_id", F.col(version).alias("_have")).hint("merge")
    won = saved(fresh.join(have, "case_id", "left").where(F.col("_have").isNull() | (F.col(version) >= F.col("_have"))).select(*fresh.columns), "won")
    ids = won.select("case_id").hint("merge")
    for name, rows in children.items():
        new = rows.select(*rows.columns, bucket).join(ids, "case_id", "left_semi")
        old = read_part(spark, folder, name, new.schema).where(mine).join(ids, "case_id", "left_anti")
        merged = saved(old.unionByName(new), name)
        _replace(merged, folder, name, touched)
        discard(merged)
    merged = saved(stored.join(ids, "case_id", "left_anti").unionByName(won), "cases")
    _replace(merged, folder, "cases", touched)
    discard(merged, fresh, won)
