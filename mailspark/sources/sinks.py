"""Indicator and corpus exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STIX_PATH = {"ipv4-addr": "ipv4-addr:value", "domain-name": "domain-name:value", "url": "url:value", "email-addr": "email-addr:value", "file-hash": "file:hashes.'SHA-256'"}
MISP_TYPE = {"ipv4-addr": "ip-src", "domain-name": "domain", "url": "url", "email-addr": "email-src", "file-hash": "sha256"}
NAMESPACE = "00abedb4aa42466c9c01fed23315a9b7"  # the namespace of deterministic indicator ids


def _map(col: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) from the SHA-1 of namespace and name."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def stix(iocs: DataFrame) -> DataFrame:
    """One indicator object per known (type, value), as JSON."""
    path = _map(F.col("ioc_type"), STIX_PATH)
    rows = iocs.where(path.isNotNull()).groupBy("ioc_type", F.lower("value").alias("key")).agg(F.min("value").alias("value"), F.max("confidence").alias("confidence"))
    ident = F.concat(F.lit("indicator--"), uuid5(F.concat("ioc_type", F.lit(":"), "key")))
    pattern = F.concat(F.lit("["), path, F.lit(" = '"), F.replace("value", F.lit("'"), F.lit("\\'")), F.lit("']"))
    return rows.select(ident.alias("id"), pattern.alias("pattern"), F.col("confidence"))


def misp(iocs: DataFrame) -> DataFrame:
    """One event per case: attribute lines, whether to act, threat level by the strongest confidence."""
    line = F.concat_ws("|", F.coalesce(_map(F.col("ioc_type"), MISP_TYPE), F.lit("other")), "value", F.when(F.col("confidence") >= 60, "1").otherwise("0"))
    return iocs.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("attributes"), F.when(F.max("confidence") >= 80, "2").otherwise("3").alias("threat_level"))


def write_csv(iocs: DataFrame, path: str) -> None:
    iocs.select("ioc_type", "value", "first_seen_s", "confidence", "context").write.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split."""
    rows.write.partitionBy("split").json(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("day").json(path)
