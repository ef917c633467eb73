"""The hash-chained custody log.

An entry's hash covers its case, index, kind, payload digest and the hash of
the entry before.  Since each row carries that hash, all links are verified in
one pass; only building a chain is sequential, and reads each case in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZERO = "0" * 64


def entry_hash(case: Column, idx: Column, kind: Column, payload: Column, prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", case.cast("string"), idx.cast("string"), kind, payload, prev), 256)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by case and index -> with both hashes; only the last hash is carried on."""
    case, last = None, ZERO
    for batch in batches:
        before, own = [], []
        for c, idx, kind, payload in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != case:
                case, last = c, ZERO
            before.append(last)
            last = hashlib.sha256("|".join(str(x) for x in (c, idx, kind, payload, last) if x is not None).encode()).hexdigest()
            own.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*batch.schema.names, "prev_hash", "entry_hash"])


def append(entries: DataFrame) -> DataFrame:
    """(case_id, idx, kind, payload_hash) -> with prev_hash and entry_hash.

    A chain is sequential within its case: entries are dealt by case, sorted, and read once, a batch at a time.
    """
    rows = entries.select("case_id", "idx", "kind", "payload_hash")
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.repartition("case_id").sortWithinPartitions("case_id", "idx").mapInArrow(_chain, f"{kinds}, prev_hash string, entry_hash string")


def verify(log: DataFrame) -> DataFrame:
    """Per case: number of entries, first broken index (null if none), head hash."""
    before = F.coalesce(F.lag("entry_hash").over(W.partitionBy("case_id").orderBy("idx")), F.lit(ZERO))
    good = (F.col("prev_hash") == before) & (F.col("entry_hash") == entry_hash(F.col("case_id"), F.col("idx"), F.col("kind"), F.col("payload_hash"), F.col("prev_hash")))
    return log.withColumn("good", good).groupBy("case_id").agg(F.count("*").alias("entries"), F.min(F.when(~F.col("good"), F.col("idx"))).alias("first_broken"), F.max_by("entry_hash", "idx").alias("head"))
