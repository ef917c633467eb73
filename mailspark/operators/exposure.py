"""Who was reached by a wave, and how far it got."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH_VALUE = ("ceo", "cfo", "cto", "chief", "director", "president", "head", "finance", "payroll", "treasury", "admin", "manager")


def with_staff(exposures: DataFrame, staff: DataFrame) -> DataFrame:
    """Exposures with name, role, department and the high-value mark."""
    people = staff.select(F.lower("email").alias("key"), "name", "role", "department")
    joined = exposures.withColumn("key", F.lower("email")).join(people, "key", "left").drop("key")
    text = F.lower(F.concat_ws(" ", "role", "department"))
    return joined.withColumn("is_high_value", text.rlike("|".join(HIGH_VALUE)))


def blast_radius(exposed: DataFrame, key: str = "wave") -> DataFrame:
    """Per wave, after merging a recipient's events."""
    flags = ("opened", "clicked", "submitted", "reported", "is_high_value")
    people = exposed.groupBy(key, "email").agg(*[F.max(f).alias(f) for f in flags], F.max("department").alias("department"))
    return people.groupBy(key).agg(
        F.count("*").alias("recipients"), F.count_if("opened").alias("opened"), F.count_if("clicked").alias("clicked"), F.count_if("submitted").alias("submitted"), F.count_if("reported").alias("reported"),
        F.count_if("is_high_value").alias("high_value"), F.array_join(F.sort_array(F.collect_set("department")), ",").alias("departments"),
    )


def priority(radius: DataFrame, risk: str = "risk") -> DataFrame:
    """Containment label from exposure and risk."""
    label = (
        F.when(F.col("submitted") > 0, "P1 - credentials submitted").when((F.col("clicked") > 0) & (F.col("high_value") > 0), "P1 - high-value target clicked").when(F.col("clicked") > 0, "P2 - link clicked")
        .when((F.col(risk) >= 80) & (F.col("recipients") > 5), "P2 - high-risk wave").when(F.col("high_value") > 0, "P3 - high-value target in recipient list").when(F.col(risk) >= 45, "P3 - suspicious").otherwise("P4 - monitor")
    )
    return radius.withColumn("priority", label)


def wave_lookup(cases: DataFrame, by_fingerprint: DataFrame, by_domain: DataFrame) -> DataFrame:
    """The wave of a case's fingerprint, else of its sender domain."""
    joined = cases.join(by_fingerprint.select("fingerprint", F.col("wave").alias("w1")), "fingerprint", "left").join(by_domain.select("from_domain", F.col("wave").alias("w2")), "from_domain", "left")
    return joined.select("case_id", F.coalesce("w1", "w2").alias("wave"), F.when(F.col("w1").isNotNull(), "fingerprint").when(F.col("w2").isNotNull(), "domain").otherwise("none").alias("matched_by"))


def complete_recipients(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known recipients plus those seen in headers that nobody listed."""
    key = known.select(F.lower("email").alias("k")).distinct()
    fresh = seen.join(key, F.lower(seen["email"]) == key["k"], "left_anti").select(F.lower("email").alias("email"), F.lit("header").alias("origin")).distinct()
    return known.select(F.lower("email").alias("email"), F.lit("gateway").alias("origin")).distinct().unionByName(fresh)
