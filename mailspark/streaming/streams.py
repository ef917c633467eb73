"""The live half: ingest, counters, waves, timers, joins and alerts as Structured Streaming.

Each function takes a streaming frame and returns one; ``drain`` runs a frame
over all files there are (availableNow) into a Parquet table, which is how the
registered queries compare a stream with its batch twin.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.sources.shared import new_path


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/{table}.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows  # watermarks need an instant


def drain(frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run to the end of the input and read what was written."""
    spark = frame.sparkSession
    out = new_path(spark, name)
    query = frame.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", new_path(spark, f"{name}-offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def drain_batches(frame: DataFrame, each: Callable[[DataFrame, int], None], name: str) -> None:
    query = frame.writeStream.foreachBatch(each).option("checkpointLocation", new_path(frame.sparkSession, f"{name}-offsets")).trigger(availableNow=True).start()
    query.awaitTermination()


def dedupe(messages: DataFrame, digest: str, at: str, late: str = "1 hour") -> DataFrame:
    """Resubmitted bytes are dropped before any costly step."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark([digest])


def tumbling_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n")


def sliding_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "168 hours", "24 hours"), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("window.start").alias("start_s"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("session_window.start").alias("start_s"), "user_id", "n")


def enrich(events: DataFrame, table: DataFrame, key: str, other: str) -> DataFrame:
    """Stream joined to a reference table, read anew in every micro-batch."""
    return events.join(table, events[key] == table[other], "left")


def exposure(delivered: DataFrame, clicked: DataFrame) -> DataFrame:
    """Delivery joined to a click of the same user within 24 hours; without one it comes out alone, once none can follow."""
    a = delivered.select(F.col("event_id").alias("delivery"), F.col("user_id").alias("u1"), F.col("ts").alias("t1")).withWatermark("t1", "1 hour")
    b = clicked.select(F.col("event_id").alias("click"), F.col("user_id").alias("u2"), F.col("ts").alias("t2")).withWatermark("t2", "1 hour")
    return a.join(b, F.expr("u1 = u2 and t2 >= t1 and t2 <= t1 + interval 24 hours"), "left_outer").select("delivery", "click")


def upsert(frame: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Each micro-batch adds its partial result under its own number, so a batch that runs again replaces what it wrote.

    The stored table is the merge of all parts; no batch rewrites another's.
    """
    spark, folder = frame.sparkSession, new_path(frame.sparkSession, name)

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.max(value).alias(value)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    drain_batches(frame, merge, name)
    return spark.read.parquet(folder).groupBy(key).agg(F.max(value).alias(value))


def sla_timer(cases: DataFrame, minutes: int = 20, late: str = "1 hour") -> DataFrame:
    """cases (owner, case_id, opened, at): per opened case whether its limit passed without a decision of its owner.

    A case comes out when the watermark has passed its deadline, since then no decision in time can follow; an
    event-time timer of the owner's state sees to it.  Decisions are kept only as long as a case is open before them.
    """
    limit = minutes * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, decided = json.loads(state.get[0]) if state.exists else ([], [])
        if not state.hasTimedOut:
            for rows in batches:
                for case, is_open, at in zip(rows["case_id"], rows["opened"], rows["at_ms"], strict=True):
                    (opened if is_open else decided).append([int(at), int(case)])
        now = state.getCurrentWatermarkMs()
        due = [x for x in opened if x[0] + limit + 1 < now]
        out = [(case, not any([at, case] < d and d[0] <= at + limit for d in decided)) for at, case in due]
        opened = sorted(x for x in opened if x[0] + limit + 1 >= now)
        if opened:
            state.update((json.dumps([opened, [d for d in decided if d > opened[0]]]),))
            state.setTimeoutTimestamp(opened[0][0] + limit + 1)
        elif decided and max(d[0] for d in decided) >= now:
            # A case opened before one of these may still arrive.
            state.update((json.dumps([[], decided]),))
            state.setTimeoutTimestamp(max(d[0] for d in decided) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["case_id", "breached"]).astype({"case_id": "int64", "breached": "bool"})

    timed = cases.withWatermark("at", late).select("owner", "case_id", "opened", "at", F.unix_millis("at").alias("at_ms"))
    return timed.groupBy("owner").applyInPandasWithState(step, "case_id bigint, breached boolean", "events string", "append", "EventTimeTimeout")


def alerts(cases: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Every threat case once per verdict; one that stays silent for longer than ``late`` may be alerted again, so state stays bounded."""
    return cases.where(F.col("event_type").isin("error", "purchase")).withWatermark(at, late).dropDuplicatesWithinWatermark(["user_id", "event_type"])
