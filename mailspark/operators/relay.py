"""Relay paths: hop order, timing and origin, with windows inside a message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _before():
    """The earlier hops of a message (made in a call: a window needs a session)."""
    return W.partitionBy("case_id").orderBy("hop_index").rowsBetween(W.unboundedPreceding, -1)


def hop_index(headers: DataFrame, key: str, position: str) -> DataFrame:
    """Headers stand newest first: index 0 is the earliest."""
    return headers.withColumn("hop_index", F.row_number().over(W.partitionBy(key).orderBy(F.desc(position))) - 1)


def relay_path(hops: DataFrame) -> DataFrame:
    """Delay to the previous timed hop, and sorted reasons why a hop is anomalous."""
    timed = hops.withColumn("delay_s", F.col("ts_s") - F.last("ts_s", ignorenulls=True).over(_before())).withColumn("after_private", F.coalesce(F.max("is_private").over(_before()), F.lit(False)))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("delay_s") < -60, F.lit("backwards time")), F.when(F.col("delay_s") > 3600, F.lit("long gap")), F.when(~F.col("is_private") & F.col("after_private"), F.lit("public after private")),
            F.when(~F.col("parse_ok"), F.lit("unparsed")), F.when(~F.col("is_private") & F.col("country").isNull(), F.lit("unresolved")),
        )
    )
    return timed.select("case_id", "hop_index", "ip", "country", "is_private", "delay_s", F.array_sort(reasons).alias("reasons"))


def relay_signals(path: DataFrame) -> DataFrame:
    """One signal for each anomalous hop, and one for a path through three countries or more."""
    n = F.size("reasons")
    single = path.where(n > 0).select("case_id", F.concat(F.lit("relay.anomaly."), F.col("hop_index").cast("string")).alias("signal_id"), F.least(115 + 25 * (n - 1), F.lit(190)).alias("w100"), F.array_join("reasons", "; ").alias("result"))
    public = path.where(~F.col("is_private") & F.col("country").isNotNull())
    many = public.groupBy("case_id").agg(F.count_distinct("country").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("hop_index", "country"))), lambda x: x["country"]).alias("list")).where("n >= 3")
    return single.unionByName(many.select("case_id", F.lit("relay.multi_country").alias("signal_id"), F.lit(80).alias("w100"), F.array_join(F.array_distinct("list"), " -> ").alias("result")))


def earliest_reliable(hops: DataFrame) -> DataFrame:
    """The first public, parsed hop outside documentation ranges; else the first public one."""
    tier = F.when(~F.col("is_documentation") & F.col("parse_ok"), 0).otherwise(1)
    public = hops.where(~F.col("is_private")).withColumn("tier", tier)
    best = public.withColumn("nth", F.row_number().over(W.partitionBy("case_id").orderBy("tier", "hop_index"))).where("nth = 1")
    return best.select("case_id", "hop_index", "ip", "country", (F.col("tier") == 0).alias("reliable"))


def origin_summary(hops: DataFrame) -> DataFrame:
    """Place, confidence tier and how many hops came later."""
    sizes = hops.groupBy("case_id").agg(F.count("*").alias("n"))
    both = sizes.join(earliest_reliable(hops), "case_id", "left")
    tier = F.when(F.col("ip").isNull(), "none").when(~F.col("reliable"), "low").when(F.col("country").isNull(), "medium").otherwise("high")
    return both.select("case_id", F.coalesce("country", F.lit("not established")).alias("place"), tier.alias("confidence"), F.coalesce(F.col("n") - 1 - F.col("hop_index"), F.lit(0)).alias("later_hops"))
