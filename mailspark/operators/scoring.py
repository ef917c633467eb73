"""Signals to verdicts: dedupe, log-odds score, confidence, class risk, rationale and attribution.

Weights are carried in hundredths (``w100``), so sums are exact whatever the
order of the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Prior log-odds in hundredths, and the classes with the ends of their risk bands.
PRIOR = -260
CLASSES = {0: ("benign", 1.0, 18.0), 1: ("suspicious", 28.0, 52.0), 2: ("phishing", 58.0, 78.0), 3: ("bec", 74.0, 89.0), 4: ("malware", 80.0, 95.0)}
# Techniques with their tactics, the tactics in kill-chain order, and the techniques that a signal is evidence of, the most specific first.
TECHNIQUE_NAMES = {
    "T1566": ("Phishing", "Initial Access"), "T1566.001": ("Phishing: Spearphishing Attachment", "Initial Access"), "T1566.002": ("Phishing: Spearphishing Link", "Initial Access"), "T1566.003": ("Phishing: Spearphishing via Service", "Initial Access"),
    "T1598": ("Phishing for Information", "Reconnaissance"), "T1598.002": ("Phishing for Information: Spearphishing Attachment", "Reconnaissance"), "T1598.003": ("Phishing for Information: Spearphishing Link", "Reconnaissance"),
    "T1656": ("Impersonation", "Defense Evasion"), "T1585.002": ("Establish Accounts: Email Accounts", "Resource Development"), "T1583.001": ("Acquire Infrastructure: Domains", "Resource Development"),
    "T1583.006": ("Acquire Infrastructure: Web Services", "Resource Development"), "T1584.001": ("Compromise Infrastructure: Domains", "Resource Development"), "T1586.002": ("Compromise Accounts: Email Accounts", "Resource Development"),
    "T1036": ("Masquerading", "Defense Evasion"), "T1036.005": ("Masquerading: Match Legitimate Name or Location", "Defense Evasion"), "T1036.007": ("Masquerading: Double File Extension", "Defense Evasion"),
    "T1027": ("Obfuscated Files or Information", "Defense Evasion"), "T1027.006": ("Obfuscated Files or Information: HTML Smuggling", "Defense Evasion"), "T1204.001": ("User Execution: Malicious Link", "Execution"),
    "T1204.002": ("User Execution: Malicious File", "Execution"), "T1059": ("Command and Scripting Interpreter", "Execution"), "T1137": ("Office Application Startup", "Persistence"), "T1090.003": ("Proxy: Multi-hop Proxy", "Command and Control"),
    "T1102": ("Web Service", "Command and Control"), "T1534": ("Internal Spearphishing", "Lateral Movement"), "T1114": ("Email Collection", "Collection"), "T1056.003": ("Input Capture: Web Portal Capture", "Collection"),
    "T1657": ("Financial Theft", "Impact"), "T1078": ("Valid Accounts", "Defense Evasion"), "T1620": ("Reflective Code Loading", "Defense Evasion"), "T1070": ("Indicator Removal", "Defense Evasion"),
}
TACTICS = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery", "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
]
SIGNAL_TECHNIQUES = {
    "auth.spf_fail": ("T1566", "T1656"), "auth.spf_unaligned": ("T1656", "T1036.005"), "auth.dkim_fail": ("T1566", "T1656"), "auth.dmarc_fail": ("T1566", "T1656"), "auth.no_auth": ("T1566",), "auth.arc_fail": ("T1566",),
    "id.brand_impersonation": ("T1656", "T1036.005"), "id.lookalike_domain": ("T1583.001", "T1036.005"), "id.confusable_chars": ("T1036", "T1583.001"), "id.punycode_sender": ("T1036", "T1583.001"),
    "id.name_contains_other_address": ("T1656", "T1036"), "id.replyto_divergence": ("T1585.002", "T1656"), "id.returnpath_mismatch": ("T1656",), "id.suspicious_tld": ("T1583.001",),
    "nlp.urgency": ("T1566",), "nlp.credential_lure": ("T1598.003", "T1056.003"), "nlp.payment_diversion": ("T1657", "T1566"), "nlp.authority_pressure": ("T1656", "T1657"), "nlp.secrecy": ("T1657",),
    "nlp.bec_no_payload": ("T1656", "T1657", "T1534"), "nlp.shouting_subject": ("T1566",), "nlp.hidden_text": ("T1027",), "nlp.image_only": ("T1027",), "nlp.possible_quishing": ("T1566.002", "T1204.001"),
    "url.ip_literal": ("T1566.002", "T1583.006"), "url.anchor_mismatch": ("T1566.002", "T1036"), "url.punycode": ("T1566.002", "T1036"), "url.shortener": ("T1566.002", "T1102"), "url.lookalike": ("T1566.002", "T1583.001"),
    "url.credential_path": ("T1566.002", "T1056.003", "T1204.001"), "url.bad_tld": ("T1583.001",), "url.many": ("T1566.002",),
    "att.executable": ("T1566.001", "T1204.002"), "att.double_ext": ("T1036.007", "T1204.002"), "att.type_mismatch": ("T1036", "T1027"), "att.macro": ("T1566.001", "T1137", "T1059"), "att.archive": ("T1027", "T1566.001"),
    "hdr.no_message_id": ("T1566",), "hdr.message_id_mismatch": ("T1036",), "hdr.no_received": ("T1027",), "hdr.undisclosed_recipients": ("T1566",), "hdr.mass_recipients": ("T1566",), "hdr.bulk_mailer": ("T1566",),
    "relay.multi_country": ("T1090.003",), "relay.forged_timestamp": ("T1070", "T1090.003"), "relay.chain_manipulation": ("T1090.003",),
    "intel.tor_exit": ("T1090.003",), "intel.abuse_reports": ("T1583.006",), "intel.new_domain": ("T1583.001",), "intel.blacklisted": ("T1583.006",), "intel.no_mx": ("T1583.001",),
    "sandbox.credential_form": ("T1056.003", "T1204.001"), "sandbox.redirect_chain": ("T1027", "T1204.001"), "sandbox.brand_clone": ("T1656", "T1036.005"),
}


def dedupe(signals: DataFrame) -> DataFrame:
    """One signal per id and case: the largest absolute weight, the first on a tie."""
    rank = F.row_number().over(W.partitionBy("case_id", "signal_id").orderBy(F.desc(F.abs("w100")), F.asc("pos")))
    return signals.withColumn("_n", rank).where("_n = 1").drop("_n")


def level(risk: Column) -> Column:
    return F.when(risk >= 85, "critical").when(risk >= 65, "high").when(risk >= 40, "medium").when(risk >= 15, "low").otherwise("clean")


def score(signals: DataFrame) -> DataFrame:
    """(case_id, logit, risk, level, breakdown map) from deduped, triggered signals."""
    per = dedupe(signals).where("triggered").groupBy("case_id", "category").agg(F.sum("w100").alias("w"))
    whole = per.groupBy("case_id").agg(F.sum("w").alias("w"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.col("w") / 100)))).alias("breakdown"))
    logit = (F.col("w") + PRIOR) / 100
    risk = F.round(F.least(F.lit(99.9), F.greatest(F.lit(0.1), 100 / (1 + F.exp(-logit)))), 1)
    return whole.select("case_id", logit.alias("logit"), risk.alias("risk"), level(risk).alias("level"), "breakdown")


def confidence(signals: DataFrame, context: DataFrame) -> DataFrame:
    """context (case_id, probability or null, coverage) -> confidence and how many ambiguity flags."""
    own = dedupe(signals).where("triggered").groupBy("case_id").agg(
        F.sum("w100").alias("w"), F.max(F.col("severity").isin("high", "critical")).alias("strong"),
        F.min((F.col("w100") <= 0) | ((F.col("category") == "heuristic") & (F.col("signal_type") == "language"))).alias("language"),
    )
    both = context.join(own, "case_id").withColumn("risk", F.round(F.least(F.lit(99.9), F.greatest(F.lit(0.1), 100 / (1 + F.exp(-(F.col("w") + PRIOR) / 100)))), 1))
    decisive = F.abs(F.col("risk") - 50) / 50
    agree = F.coalesce(1 - F.abs(F.col("risk") / 100 - F.col("probability")), F.lit(0.62))
    flags = [
        decisive < 0.2, F.col("probability").isNotNull() & (agree < 0.6), F.col("probability").isNull(), F.col("coverage") < 0.7,
        (F.col("risk") >= 50) & ~F.col("strong"), F.col("risk").between(35, 70) & F.col("language"),
    ]
    n = sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))
    eps = F.lit(1e-6)
    raw = 100 * F.pow(F.greatest(decisive, eps), 0.45) * F.pow(F.greatest(agree, eps), 0.35) * F.pow(F.greatest(F.col("coverage"), eps), 0.20)
    return both.select("case_id", "risk", n.alias("n_flags"), F.round(F.round(F.greatest(F.lit(1.0), F.least(F.lit(99.0), raw)), 1) * F.pow(F.lit(0.9), n), 1).alias("confidence"))


def class_risk(cls: Column, p: Column, n_critical: Column, n_high: Column, n_medium: Column, spear: Column) -> Column:
    """Risk from the model's class band, a severity bonus and a spear-phishing bonus."""
    low, high = F.lit(28.0), F.lit(52.0)
    for k, (_, a, b) in CLASSES.items():
        low, high = F.when(cls == k, F.lit(a)).otherwise(low), F.when(cls == k, F.lit(b)).otherwise(high)
    benign = low + (high - low) * F.pow(F.greatest(F.lit(0.0), 1 - p), 1.5)
    bonus = F.least(F.lit(8.0), n_critical * 2.0 + n_high * 1.0 + n_medium * 0.4)
    other = low + (high - low) * F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)), 0.85) + bonus
    other = F.when(spear > 0, F.least(F.lit(94.0), other + spear * 4.5)).otherwise(other)
    return F.round(F.least(F.lit(97.5), F.greatest(F.lit(0.5), F.when(cls == 0, benign).otherwise(other))), 1)


def severity_counts(signals: DataFrame) -> DataFrame:
    good = F.col("triggered") & (F.col("w100") > 0)
    return dedupe(signals).groupBy("case_id").agg(*[F.count_if(good & (F.col("severity") == s)).alias(f"n_{s}") for s in ("critical", "high", "medium")])


def rationale(signals: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` heaviest positive signals of a case as one text."""
    good = dedupe(signals).where("triggered and w100 > 0")
    top = good.withColumn("nth", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("w100"), F.asc("pos"), F.asc("signal_id")))).where(F.col("nth") <= n)
    text = F.concat(F.col("signal_id"), F.lit(" (+"), (F.col("w100") / 100).cast("decimal(9,2)").cast("string"), F.lit(" logit)"))
    return top.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))), lambda x: x["t"]), "; ").alias("rationale"))


def label_of(risk: Column) -> Column:
    return F.when(risk >= 80, "phishing").when(risk >= 45, "suspicious").when(risk >= 20, "likely_benign").otherwise("benign")


def assemble(scored: DataFrame, reasons: DataFrame, conf: DataFrame) -> DataFrame:
    """Label (indeterminate if confidence is too low), recommended action, review flag and rationale."""
    both = scored.join(conf.select("case_id", "confidence"), "case_id").join(reasons, "case_id", "left")
    label = F.when((F.col("confidence") < 35) & F.col("risk").between(20, 80), "indeterminate").otherwise(label_of(F.col("risk")))
    out = both.withColumn("label", label)
    action = (
        F.when(F.col("label") == "phishing", "quarantine").when(F.col("label") == "suspicious", "hold for analyst").when(F.col("label") == "indeterminate", "manual review")
        .when(F.col("label") == "likely_benign", "release with banner").otherwise("release")
    )
    return out.select("case_id", "label", "risk", "level", "confidence", action.alias("action"), ((F.col("label") != "benign") | (F.col("confidence") < 70)).alias("needs_review"), F.coalesce("rationale", F.lit("no positive signals fired")).alias("rationale"))


def canonical(signal_id: Column) -> Column:
    """A signal id without its index."""
    return F.regexp_replace(signal_id, r"\.\d+$", "")


def technique_table(spark) -> DataFrame:
    pairs = [(signal, t) for signal, techniques in SIGNAL_TECHNIQUES.items() for t in techniques]
    rows = [(i, signal, t, *TECHNIQUE_NAMES[t], TACTICS.index(TECHNIQUE_NAMES[t][1])) for i, (signal, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "ord int, id string, technique string, name string, tactic string, tactic_ord int")


def signal_techniques(signals: DataFrame) -> DataFrame:
    """Each triggered signal with its techniques; the first of the table is the primary one."""
    table = technique_table(signals.sparkSession)
    mapped = signals.where("triggered").select("case_id", "signal_id", canonical(F.col("signal_id")).alias("id")).distinct()
    first = table.groupBy("id").agg(F.min("ord").alias("first"))
    return mapped.join(F.broadcast(table.join(first, "id")), "id", "left").select("case_id", "signal_id", "technique", (F.col("ord") == F.col("first")).alias("is_primary"))


def case_techniques(signals: DataFrame) -> DataFrame:
    """Per case and technique: distinct evidence, kill-chain place."""
    table = technique_table(signals.sparkSession)
    mapped = signals.where("triggered").select("case_id", "signal_id", canonical(F.col("signal_id")).alias("id")).distinct()
    return mapped.join(F.broadcast(table), "id").groupBy("case_id", "technique", "tactic", "tactic_ord").agg(
        F.count_distinct("signal_id").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("signal_id")), 1, 6), ",").alias("evidence")
    )


def threat_class(signals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Five-way class from the set of triggered ids and the verdict."""
    ids = signals.where("triggered").groupBy("case_id").agg(F.collect_set(canonical(F.col("signal_id"))).alias("ids"))
    both = verdicts.join(ids, "case_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    has = lambda *names: F.arrays_overlap("ids", F.array(*[F.lit(n) for n in names]))
    credential = has("nlp.credential_lure", "url.credential_path", "sandbox.credential_form")
    fraud = has("nlp.payment_diversion", "nlp.bec_no_payload", "nlp.secrecy")
    fake = has("id.brand_impersonation", "id.lookalike_domain", "id.confusable_chars", "id.punycode_sender", "id.name_contains_other_address", "auth.spf_unaligned")
    v = F.col("verdict")
    quiet = (v == "likely_benign") & (F.size(F.array_except("ids", F.array(F.lit("ml.score")))) == 0)
    return both.select(
        "case_id",
        F.when((v == "benign") | quiet, "legitimate").when((v == "phishing") & credential, "phishing").when(fraud & ~credential, "fraud")
        .when(fake & v.isin("phishing", "suspicious"), "impersonated").when(v == "phishing", "phishing").otherwise("suspicious").alias("threat_class"),
    )


# Words in notes on the origin, and the four hypotheses in the order that breaks ties.
ANONYMISING = ("tor", "vpn", "proxy", "open relay", "open-relay", "anonymis", "anonymiz", "bulletproof")
HOSTING = ("hosting", "cloud", "data center", "datacenter", "colo", "vps")
RESIDENTIAL = ("dynamic", "residential", "botnet", "cpe", "dsl", "broadband")
ACTORS = ["compromised-account", "spoofed-domain", "anonymised", "direct-actor"]
SPOOFING = ("auth.spf_fail", "auth.dkim_fail", "auth.dmarc_fail", "auth.spf_unaligned", "id.returnpath_mismatch")
SOCIAL = ("nlp.payment_diversion", "nlp.bec_no_payload", "nlp.credential_lure", "nlp.authority_pressure", "nlp.secrecy")
FAKE_DOMAIN = ("id.lookalike_domain", "id.confusable_chars", "id.punycode_sender")
LEAST_MALICIOUS = 150


def actor_points(c: dict[str, Column]) -> dict[str, Column]:
    """Points (hundredths) of each hypothesis: a table of (points, test) for each, or points times a count."""
    ids, notes = c["ids"], F.lower(c["indicators"])
    has = lambda *names: F.arrays_overlap(ids, F.array(*[F.lit(n) for n in names]))
    says = lambda words, text=notes: reduce(or_, [text.contains(w) for w in words])
    anonymous = says(ANONYMISING) | says(ANONYMISING, F.lower(c["hop_hosts"]))
    passes, age = c["aligned"] & c["dmarc_pass"], c["domain_age"]
    unsupported = F.size(F.array_intersect(ids, F.array(*[F.lit(n) for n in SPOOFING])))
    rules = {
        "compromised-account": [(300, passes & has(*SOCIAL)), (60, passes & ~has(*SOCIAL)), (100, passes & (age > 365)), (80, c["aligned"] & has("hdr.mass_recipients"))],
        "spoofed-domain": [(100, has("id.brand_impersonation") & (F.coalesce(age, F.lit(0)) == 0)), (80, has("auth.no_auth"))],
        "anonymised": [(300, anonymous), (200, has("intel.tor_exit")), (150, c["manipulated"]), (50, c["unplaced"]), (100, says(RESIDENTIAL))],
        "direct-actor": [(200, age <= 30), (120, has(*FAKE_DOMAIN)), (80, says(HOSTING) & ~says(ANONYMISING)), (60, has("intel.abuse_reports"))],
    }
    points = {actor: reduce(add, [F.when(test, p).otherwise(0) for p, test in table]) for actor, table in rules.items()}
    points["spoofed-domain"] = points["spoofed-domain"] + 120 * unsupported
    return points


def attribution(signals: DataFrame, context: DataFrame) -> DataFrame:
    """The strongest hypothesis of each case and the ranked others, gated by the malicious weight.

    context: case_id, indicators, hop_hosts (texts), aligned, dmarc_pass, manipulated, unplaced (booleans), domain_age (days or
    null).  A case's signal ids are a small set.  Confidence is the winner's share times a factor of how much there is; its band is high from 70 on, moderate from 40.
    """
    seen = signals.where("triggered").groupBy("case_id").agg(F.collect_set(canonical(F.col("signal_id"))).alias("ids"), F.sum(F.greatest(F.col("w100"), F.lit(0))).alias("malicious"))
    both = seen.join(context, "case_id", "left")
    values = {"ids": F.col("ids"), "domain_age": F.col("domain_age")} | {c: F.coalesce(F.col(c), F.lit("")) for c in ("indicators", "hop_hosts")} | {c: F.coalesce(F.col(c), F.lit(False)) for c in ("aligned", "dmarc_pass", "manipulated", "unplaced")}
    points = actor_points(values)
    ranked = F.array_sort(F.array(*[F.struct((-points[a]).alias("minus"), F.lit(i).alias("order"), F.lit(a).alias("actor")) for i, a in enumerate(ACTORS)]))
    scored = both.select("case_id", "malicious", ranked.alias("ranked")).withColumn("total", F.aggregate("ranked", F.lit(0), lambda n, x: n - x["minus"]))
    top = -F.col("ranked")[0]["minus"]
    known = (F.col("malicious") >= LEAST_MALICIOUS) & (F.col("total") > 0)
    confidence = F.round(100.0 * top / F.nullif("total", F.lit(0)) * (0.55 + 0.45 * F.least(F.lit(1.0), top / 400.0)), 1)
    others = F.filter(F.slice("ranked", 2, len(ACTORS)), lambda x: x["minus"] < 0)
    shown = F.array_join(F.transform(others, lambda x: F.concat(x["actor"], F.lit(":"), (-x["minus"]).cast("string"))), ";")
    return scored.select(
        "case_id", F.when(known, F.col("ranked")[0]["actor"]).otherwise("unknown").alias("actor_type"), F.when(known, F.least(F.lit(95.0), confidence)).otherwise(0.0).alias("confidence"),
        F.when(known & (confidence >= 70), "high").when(known & (confidence >= 40), "moderate").otherwise("low").alias("band"), F.when(known, shown).otherwise("").alias("alternatives")
    )


def ml_weight(p: Column) -> Column:
    """The model's damped log-odds contribution."""
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.greatest(F.lit(-2.2), F.least(F.lit(2.2), 0.6 * F.log(q / (1 - q))))
