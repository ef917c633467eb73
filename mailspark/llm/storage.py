"""Stashed tables (written to the shared folder, so lineage ends there) and small helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.sources.shared import discard, shared_dir
from mailspark.sources.shared import saved as stash

__all__ = ["discard", "fresh", "row_hash", "sampled", "shared_dir", "stash", "table"]


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to clash with no column (Spark is blind to case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, to order rows that agree in everything that counts."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])


def sampled(rows: DataFrame, share: float, *columns: str) -> DataFrame:
    """The rows whose hash over ``columns``, on the scale from 0 to 1, lies under ``share``."""
    return rows.where(F.xxhash64(*columns) / 2.0**64 + 0.5 < share)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
