"""What follows from a verdict: containment steps and a case's indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHOWN_HOSTS = 6
LEAST, MOST, SURE = 30, 90, 95


def next_actions(cases: DataFrame, retention_days: int = 30) -> DataFrame:
    """(case_id, nth, action, detail, urgency): the steps that each case's own findings call for, in order.

    cases: case_id, verdict, threat_class, actor_type, message_id, raw_sha256, from_domain, clicked and submitted
    (counts), link_domains (array), origin_ip and custody_head; anything but the id may be null and then calls for
    nothing.  Every case ends with the step that preserves evidence, so none is without rows.
    """
    c = F.col
    domain = F.coalesce("from_domain", F.lit(""))
    hosts = F.sort_array(F.array_distinct(F.filter("link_domains", lambda h: h != "")))
    message = F.when(c("message_id") != "", c("message_id")).otherwise("(absent)")
    head = F.when(c("custody_head") != "", F.concat(F.substring("custody_head", 1, 18), F.lit("..."))).otherwise("not recorded")
    submitted = c("submitted") > 0
    # Action, detail and urgency of each step.
    steps: list[tuple[Column, str, Column, str]] = [
        (c("verdict").isin("phishing", "suspicious"), "Quarantine estate-wide", F.format_string("purge by Message-ID %s and by raw SHA-256 %s", message, F.substring(F.coalesce("raw_sha256", F.lit("")), 1, 16)), "immediate"),
        (submitted, "Force password reset and revoke sessions", F.format_string("%d recipient(s) submitted credentials", c("submitted")), "immediate"),
        (~F.coalesce(submitted, F.lit(False)) & (c("clicked") > 0), "Reset credentials for users who clicked", F.format_string("%d click(s) recorded", c("clicked")), "immediate"),
        (F.size(hosts) > 0, "Block link domains at the proxy and DNS", F.array_join(F.slice(hosts, 1, SHOWN_HOSTS), ", "), "today"),
        (c("origin_ip") != "", "Block the origin IP at the mail gateway", c("origin_ip"), "today"),
        (c("actor_type") == "compromised-account", "Notify the sending organisation of a suspected account compromise", F.format_string("authentication aligned for %s, so the mailbox itself is likely in attacker hands", domain), "today"),
        ((c("actor_type") == "spoofed-domain") & (domain != ""), "Raise DMARC enforcement / add a spoofing rule", F.format_string("inbound mail claiming %s failed alignment", domain), "this week"),
        (c("threat_class") == "fraud", "Freeze and re-verify the payment instruction out of band", F.lit("call the known-good number on file; do not reply to the thread"), "immediate"),
        (F.lit(True), "Preserve evidence", F.format_string(f"custody chain head %s; retention {retention_days} days", head), "record"),
    ]
    due = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(action).alias("action"), detail.alias("detail"), F.lit(urgency).alias("urgency"))) for test, action, detail, urgency in steps]))
    return cases.select("case_id", F.posexplode(due).alias("nth", "step")).select("case_id", (c("nth") + 1).cast("bigint").alias("nth"), "step.*")


def extract_iocs(cases: DataFrame, artefacts: DataFrame, max_urls: int = 20, url_chars: int = 400) -> DataFrame:
    """(case_id, ioc_type, value, confidence, context): a case's artefacts as indicators, unique by type and lower-cased value.

    cases: case_id, risk.  artefacts: case_id, kind (sender, domain, ip, url_host, url, file), value, pos (order
    within the kind; an ip at 0 is the origin) and note (the case's number for a sender, name and type for a file).
    The case's risk is the base; what is less its own (relays, sender-side domains) counts less, a file's digest more.
    Of equal indicators the first in the order of kinds stays.  Empty and null values are left out.
    """
    base = F.floor(F.greatest(F.lit(float(LEAST)), F.least(F.lit(float(MOST)), F.coalesce("risk", F.lit(0.0))))).cast("int")
    less = lambda n: F.greatest(F.lit(LEAST), base - n)
    origin, note = F.col("pos") == 0, F.coalesce("note", F.lit(""))
    # Kind, type of indicator, confidence and context, in the order that keeps the first of equal ones.
    rules: list[tuple[str, str, Column, Column]] = [
        ("sender", "email-addr", base, F.concat(F.lit("From address on "), note)),
        ("domain", "domain-name", less(10), F.lit("sender-side domain")),
        ("ip", "ipv4-addr", F.when(origin, base).otherwise(less(20)), F.when(origin, "relay hop (origin)").otherwise("relay hop")),
        ("url_host", "domain-name", base, F.lit("link destination")),
        ("url", "url", base, F.lit("embedded link")),
        ("file", "file-hash", F.least(F.lit(SURE), base + 10), F.concat(F.lit("attachment "), note)),
    ]
    # Only URLs are ranked: a case's URLs are those of one message.
    urls = artefacts.where("kind = 'url'").withColumn("_n", F.row_number().over(W.partitionBy("case_id").orderBy("pos", "value"))).where(F.col("_n") <= max_urls).drop("_n")
    cut = urls.withColumn("value", F.substring("value", 1, url_chars))
    rows = artefacts.where("kind <> 'url'").unionByName(cut).where("value <> ''").join(cases.select("case_id", "risk"), "case_id")
    one = F.coalesce(*[F.when(F.col("kind") == kind, F.struct(F.lit(i).alias("ord"), F.col("pos"), F.col("value"), F.lit(ioc_type).alias("ioc_type"), confidence.alias("confidence"), context.alias("context"))) for i, (kind, ioc_type, confidence, context) in enumerate(rules)])
    typed = rows.select("case_id", one.alias("i")).where("i is not null")
    first = typed.groupBy("case_id", F.col("i.ioc_type").alias("t"), F.lower("i.value").alias("key")).agg(F.min("i").alias("i"))
    return first.select("case_id", "i.ioc_type", "i.value", "i.confidence", "i.context")
