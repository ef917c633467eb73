"""Campaigns: cases of one fingerprint within a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_S = 168 * 3600


def _blocks(cases: DataFrame, window_s: int) -> DataFrame:
    """Each case in its own time block and, as ``own`` = false, in the next: a block holds all that its windows reach back to.

    A fingerprint with very many cases is cut by time.
    """
    block = F.floor(F.col("created_s") / window_s)
    return cases.select("case_id", "fingerprint", "created_s", F.explode(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).alias("b")).select("case_id", "fingerprint", "created_s", "b.block", "b.own")


def siblings(cases: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """How many cases of the same fingerprint came within the window before (a range frame in time blocks, no self-join)."""
    frame = W.partitionBy("fingerprint", "block").orderBy("created_s").rangeBetween(-window_s, 0)
    same = W.partitionBy("fingerprint", "block", "created_s")
    rank = F.row_number().over(same.orderBy("case_id"))
    # The frame holds all cases of the same second: those with a larger id don't count as earlier.
    counted = _blocks(cases, window_s).select("case_id", "fingerprint", "created_s", "own", (F.count("*").over(frame) - F.count("*").over(same) + rank - 1).alias("siblings"))
    return counted.where("own").drop("own")


def assign(cases: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Campaign id, first case in the window, duplicate mark."""
    frame = W.partitionBy("fingerprint", "block").orderBy("created_s").rangeBetween(-window_s, 0)
    first = F.min(F.struct("created_s", "case_id")).over(frame)
    out = _blocks(cases, window_s).select("case_id", "fingerprint", "created_s", "own", first.alias("first")).where("own")
    mine = F.col("first.case_id") == F.col("case_id")
    return out.select(
        "case_id", F.concat(F.lit("camp-"), F.substring("fingerprint", 1, 12)).alias("campaign_id"), F.col("first.created_s").alias("first_seen_s"), (~mine).alias("is_duplicate"), F.when(~mine, F.col("first.case_id")).alias("merged_into")
    )


def first_by_hash(rows: DataFrame, digest: str, order: list[str], id_col: str) -> DataFrame:
    """Byte-identical resubmissions mapped to the earliest case; only digest and ids are shuffled."""
    first = rows.groupBy(digest).agg(F.min_by(id_col, F.struct(*order)).alias("first_id"), F.count("*").alias("n"))
    return rows.select(id_col, digest).join(first, digest).select(id_col, "first_id", (F.col("n") - 1).alias("resubmissions"))
