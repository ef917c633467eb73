"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of every partition are merged into at most ``k``
candidate digests.  The candidates are counted exactly, and these verified
winners (``k`` rows at most, whatever the corpus) are broadcast, so that the
rows of frequent texts are decided without a shuffle.  The remaining digests,
none of which can be frequent, take an ordinary shuffle by digest.

Defined results: a null text counts as the empty text; a null id loses to any
other id and wins only in a group without ids; rows that repeat both id and
text are counted in ``group_size`` and exactly one of them is kept (by
``keep_one`` the one whose whole row has the least hash); texts of any length
are digested whole; an empty table gives an empty result; other columns,
whatever their names, are ignored by ``annotate`` and carried through by
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.llm.storage import fresh, row_hash, stash


def shrink(counts: dict[str, int], k: int) -> dict[str, int]:
    """The Misra-Gries step: take the (k+1)th count off all counters and drop those used up."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: n - cut for d, n in counts.items() if n > cut}


def summarise(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One partition's summary: k counters at most."""
    counts: dict[str, int] = {}
    for batch in batches:
        for pair in batch.column(0).value_counts().to_pylist():
            counts[pair["values"]] = counts.get(pair["values"], 0) + pair["counts"]
        counts = shrink(counts, k)
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def frequent(digests: DataFrame, k: int) -> DataFrame:
    """Candidates: every digest with more than 2/k of the rows is among these k rows."""
    parts = digests.select("digest").mapInArrow(lambda it: summarise(it, k), "digest string, n bigint")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    digests = stash(docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")), "digests")
    winners = (
        digests.join(F.broadcast(frequent(digests, k)), "digest")
        .groupBy("digest").agg(F.count("*").alias("size"), F.max("id").alias("keep"))
        .where("size > 1")
    )
    split = digests.join(F.broadcast(winners), "digest", "left")
    hot = split.where("size is not null")
    is_keep = F.col("id").eqNullSafe(F.col("keep"))
    first = F.row_number().over(W.partitionBy("digest").orderBy("id")) == 1
    newest = W.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())
    whole = newest.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cold = split.where("size is null").select(
        "id", "digest", F.count("*").over(whole).alias("size"), F.first("id").over(whole).alias("keep"), (F.row_number().over(newest) == 1).alias("kept")
    )
    rows = (
        hot.where(~is_keep).select("id", "digest", "size", "keep", F.lit(False).alias("kept"))
        .unionByName(hot.where(is_keep).select("id", "digest", "size", "keep", first.alias("kept")))
        .unionByName(cold)
    )
    return rows.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """The rows that stay, with all their columns."""
    key = F.concat_ws(":", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.col(id_col).cast("string"))
    same, nth = fresh(docs.columns, "same_row", "nth")
    marks = annotate(docs, id_col, text_col, k).where("kept").select(F.concat_ws(":", "text_sha256", F.col(id_col).cast("string")).alias(same))
    joined = docs.withColumn(same, key).join(marks, same, "left_semi")
    # Same keys as the join, so no further shuffle: one of the rows that repeat id and text.
    return joined.withColumn(nth, F.row_number().over(W.partitionBy(same).orderBy(row_hash(docs)))).where(F.col(nth) == 1).drop(same, nth)
