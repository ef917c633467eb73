"""The case store: filtered queues, look-ups, upserts, trails and counters as set operations."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SORTS = {
    "newest": [F.desc, "created_s"], "oldest": [F.asc, "created_s"], "risk": [F.desc, "risk"], "confidence": [F.asc, "confidence"], "number": [F.asc, "case_number"],
}
THREATS = ("phishing", "suspicious", "bec", "malware")


def queue_filter(cases: DataFrame, status: str = "", verdict: str = "", threat_class: str = "", min_risk: float = 0.0, campaign: str = "", include_duplicates: bool = True) -> DataFrame:
    """All given predicates together; one scan, pushed down."""
    tests: list[Column] = []
    for name, value in (("status", status), ("verdict", verdict), ("threat_class", threat_class), ("fingerprint", campaign)):
        if value:
            tests.append(F.col(name) == value)
    if min_risk:
        tests.append(F.col("risk") >= min_risk)
    if not include_duplicates:
        tests.append(~F.col("is_duplicate"))
    return cases.where(reduce(lambda a, b: a & b, tests)) if tests else cases


def sorted_page(cases: DataFrame, sort: str, skip: int, limit: int) -> DataFrame:
    """A page of the queue; the case id breaks ties."""
    way, column = SORTS[sort]
    return cases.orderBy(way(column), F.asc("case_id")).offset(skip).limit(limit)


def summaries(cases: DataFrame, signals: DataFrame) -> DataFrame:
    """Compact case rows with counts of their triggered signals (one aggregation, one join)."""
    counts = signals.groupBy("case_id").agg(
        F.count("*").alias("n_signals"), F.count_if("triggered").alias("n_triggered"), F.count_if(F.col("triggered") & F.col("severity").isin("high", "critical")).alias("n_strong")
    )
    return cases.join(counts, "case_id", "left").na.fill(0, ["n_signals", "n_triggered", "n_strong"])


def search_prefix(rows: DataFrame, columns: list[str], query: str, id_col: str) -> DataFrame:
    """Rows where every term begins some word of the columns; ranked by the number of such words.

    Words are exploded and probed against the few terms: no row is compared with another.
    """
    terms = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    text = F.concat_ws(" ", *columns)
    words = rows.select(id_col, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    begun = F.array(*[F.when(F.col("word").startswith(t), F.lit(t)) for t in terms])
    hits = words.select(id_col, F.explode(F.array_compact(begun)).alias("term"))
    return hits.groupBy(id_col).agg(F.count_distinct("term").alias("terms"), F.count("*").alias("hits")).where(F.col("terms") == len(terms)).drop("terms")


def search_contains(rows: DataFrame, columns: list[str], needle: str, id_col: str, order: str, limit: int) -> DataFrame:
    """Case-insensitive substring over several columns, newest first."""
    test = reduce(lambda a, b: a | b, [F.lower(c).contains(needle.lower()) for c in columns])
    return rows.where(test).orderBy(F.desc(order), F.asc(id_col)).limit(limit)


def ioc_pivot(iocs: DataFrame, cases: DataFrame, value: str, limit: int) -> DataFrame:
    """Cases that share an indicator, newest first."""
    ids = iocs.where(F.lower("value") == value.lower()).select("case_id").distinct()
    return cases.join(ids, "case_id", "left_semi").orderBy(F.desc("created_s"), "case_id").limit(limit)


def audit_trail(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest ``n`` events of every case (the rank limit is applied before the shuffle)."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return events.withColumn("nth", rank).where(F.col("nth") <= n)


def alert_candidates(cases: DataFrame, threshold: float = 40.0, suppress_duplicates: bool = False) -> DataFrame:
    test = F.col("verdict").isin(*THREATS) | F.col("threat_class").isin("phishing", "fraud", "impersonated") | (F.col("risk") >= threshold)
    return cases.where(test & ~F.col("is_duplicate") if suppress_duplicates else test)


#: Signals (by beginning) that leave a sender's identity in doubt.
IDENTITY_DOUBT = ("id.lookalike", "id.brand", "id.confusable", "id.punycode", "id.suspicious_tld")


def enrichment_gate(cases: DataFrame, signals: DataFrame, hops: DataFrame, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """Per case: whether costly look-ups are worth it, and why.

    hops (case_id, host, reasons): an origin counts as anonymised where a hop's reasons name Tor or its host a proxy.
    """
    doubts = signals.where(F.col("triggered") & reduce(or_, [F.col("signal_id").startswith(p) for p in IDENTITY_DOUBT]))
    doubt = doubts.groupBy("case_id").agg(F.lit(True).alias("doubt"))
    hidden = hops.where(F.lower(F.array_join("reasons", " ")).contains("tor") | F.lower("host").contains("proxy"))
    anonymised = hidden.groupBy("case_id").agg(F.lit(True).alias("anonymised"))
    both = cases.join(doubt, "case_id", "left").join(anonymised, "case_id", "left")
    open_ = (F.col("risk") > low) & (F.col("risk") < high)
    reason = F.when(open_, "not conclusive").when(F.coalesce("anonymised", F.lit(False)), "anonymised origin").when(F.coalesce("doubt", F.lit(False)), "identity doubt").otherwise("conclusive")
    return both.select("case_id", reason.alias("reason"), (reason != "conclusive").alias("enrich"))


def retention_redact(messages: DataFrame, now_s: int, days: int) -> DataFrame:
    """Bodies of messages older than the limit are stripped; ids, sizes and digests stay."""
    old = F.col("received_s") < now_s - days * 86400
    return messages.select(
        "msg_id", F.when(old, F.lit("")).otherwise(F.col("body")).alias("body"), F.sha2("body", 256).alias("body_sha256"), F.when(old, F.lit("[redacted]")).otherwise(F.col("subject")).alias("subject"), old.alias("redacted")
    )


def upsert_iocs(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Shared indicators merged by (type, lower value): highest confidence, first context, number of cases."""
    rows = stored.unionByName(fresh).withColumn("key", F.lower("value"))
    return rows.groupBy("ioc_type", "key").agg(
        F.max("confidence").alias("confidence"), F.min_by("context", F.struct("first_seen_s", "case_id", "pos", "context")).alias("context"), F.min("first_seen_s").alias("first_seen_s"), F.count_distinct("case_id").alias("cases")
    )


def upsert_cases(stored: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row of each case; of equal versions the fresh one."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n", "_new")


def stats_counters(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("phishing", "suspicious", "bec", "malware", "likely_benign", "benign")],
        F.count_if("needs_review").alias("awaiting_review"), F.count_if("is_duplicate").alias("duplicates"), F.count_if("anchored").alias("anchored"),
        F.round(F.avg("risk"), 4).alias("avg_risk"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def stats_breakdowns(cases: DataFrame) -> DataFrame:
    """Counts by threat class and by actor type in one pass; blanks excluded."""
    both = cases.groupingSets([["threat_class"], ["actor_type"]], "threat_class", "actor_type").agg(F.count("*").alias("n"), F.grouping("threat_class").alias("g"))
    name = F.when(F.col("g") == 0, F.col("threat_class")).otherwise(F.col("actor_type"))
    return both.select(F.when(F.col("g") == 0, "threat_class").otherwise("actor_type").alias("breakdown"), name.alias("name"), "n").where("name <> ''")


def campaign_rollup(cases: DataFrame) -> DataFrame:
    return cases.groupBy("fingerprint").agg(
        F.count("*").alias("cases"), F.max("risk").alias("max_risk"), (F.floor(F.sum(F.round(F.col("risk") * 10).cast("bigint")) * 100.0 / F.count("*")) / 1000).alias("avg_risk"), F.min("created_s").alias("first_seen_s"), F.max("created_s").alias("last_seen_s"),
        F.count_if(F.col("verdict") == "phishing").alias("phishing"), F.array_join(F.sort_array(F.collect_set("from_domain")), ",").alias("domains"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("threat_class") != "", F.col("threat_class")))), ",").alias("classes"),
    )


def case_numbering(cases: DataFrame, prefix: str = "MT") -> DataFrame:
    """Sequential numbers per year, in order of creation.

    A year is too coarse a key for a window: ranks are taken within days and
    shifted by the number of cases on the year's earlier days (a small table).
    """
    dated = cases.withColumn("day", F.floor(F.col("created_s") / 86400)).withColumn("year", F.year(F.timestamp_seconds("created_s")))
    days = dated.groupBy("year", "day").agg(F.count("*").alias("n"))
    before = days.select("year", "day", (F.sum("n").over(W.partitionBy("year").orderBy("day")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("year", "day").orderBy("created_s", "case_id"))
    numbered = dated.withColumn("nth", rank).join(before, ["year", "day"]).withColumn("nth", (F.col("nth") + F.col("before")).cast("bigint"))
    return numbered.select("case_id", F.concat_ws("-", F.lit(prefix), F.col("year").cast("string"), F.when(F.col("nth") > 9999, F.col("nth").cast("string")).otherwise(F.lpad(F.col("nth").cast("string"), 4, "0"))).alias("case_number"))


def sla_report(cases: DataFrame, now_s: int, minutes: int = 20) -> DataFrame:
    """cases with closed_s (null while open): time taken and left, and whether the limit was passed."""
    end = F.coalesce("closed_s", F.lit(now_s))
    rows = cases.select("case_id", "created_s", end.alias("end_s"))
    left = F.col("created_s") + minutes * 60 - F.col("end_s")
    return rows.select("case_id", (F.col("end_s") - F.col("created_s")).alias("elapsed_s"), left.alias("remaining_s"), (left < 0).alias("breached"))


def apply_decisions(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """The latest valid decision of each case: approve, override (with a verdict) or escalate."""
    valid = decisions.where(F.col("decision").isin("approve", "override", "escalate") & ((F.col("decision") != "override") | (F.col("new_verdict") != "")) & (F.trim("analyst") != ""))
    last = valid.groupBy("case_id").agg(F.max_by(F.struct("decision", "new_verdict", "analyst", "at_s"), F.struct("at_s", "decision_id")).alias("d"))
    state = F.when(F.col("d.decision") == "approve", "approved").when(F.col("d.decision") == "escalate", "escalated").when(F.col("d.decision") == "override", "overridden")
    return cases.join(last, "case_id", "left").select(
        "case_id", F.coalesce(state, F.col("status")).alias("status"), F.when(F.col("d.decision") == "override", F.col("d.new_verdict")).otherwise(F.col("verdict")).alias("verdict"),
        (F.col("needs_review") & F.col("d").isNull()).alias("needs_review"), F.col("d.at_s").alias("closed_s"),
    )
