"""Registered queries over cases, signals, links, hops, exposures and the custody log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.functions.network import network_prefix
from mailspark.operators import campaigns, casefiles, custody, exposure, intel, links, relay, scoring, store, triage
from mailspark.plans.adapters import given, view
from mailspark.sources.shared import new_path

NOW_S = 1_041_379_200  # the "now" of the store's reports
DAY = 86_400


def queue_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = store.queue_filter(view(spark, d, "v_cases"), status="open", verdict="phishing", min_risk=40.0, include_duplicates=False)
    return rows.select("case_id", "risk", "threat_class", "created_s")


def case_summary(spark: SparkSession, d: str) -> DataFrame:
    out = store.summaries(view(spark, d, "v_cases"), view(spark, d, "v_signals"))
    return out.select("case_id", "case_number", "subject", "sender", "from_domain", "status", "verdict", "threat_class", "actor_type", "risk", "created_s", "n_signals", "n_triggered", "n_strong", "needs_review", "is_duplicate")


def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return store.search_prefix(view(spark, d, "v_messages"), ["subject", "source", "from_domain"], "th. ex", "msg_id")


def search_contains(spark: SparkSession, d: str) -> DataFrame:
    return store.search_contains(view(spark, d, "v_cases"), ["subject", "sender", "from_domain", "case_number", "fingerprint"], "Wave 17", "case_id", "created_s", 50).select("case_id", "subject", "created_s")


def ioc_pivot(spark: SparkSession, d: str) -> DataFrame:
    return store.ioc_pivot(view(spark, d, "v_iocs"), view(spark, d, "v_cases"), "d7.EXAMPLE.org", 20).select("case_id", "created_s")


def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return store.audit_trail(given(spark, d, "events"), "user_id", "event_id", 5).select("user_id", "event_id", "event_type", "nth")


def alert_candidates(spark: SparkSession, d: str) -> DataFrame:
    return store.alert_candidates(view(spark, d, "v_cases")).select("case_id", "verdict", "threat_class", "risk")


def enrichment_gate(spark: SparkSession, d: str) -> DataFrame:
    hops = view(spark, d, "v_context").select("case_id", F.col("hop_hosts").alias("host"), F.array("indicators").alias("reasons"))
    return store.enrichment_gate(view(spark, d, "v_cases"), view(spark, d, "v_signals"), hops)


def retention_redact(spark: SparkSession, d: str) -> DataFrame:
    out = store.retention_redact(view(spark, d, "v_messages"), 1704067200 + 400 * DAY, 399)
    return out.select("msg_id", F.length("body").cast("bigint").alias("body_chars"), "body_sha256", "subject", "redacted")


def retention_preview(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_messages").select(F.floor((F.lit(1704067200 + 400 * DAY) - F.col("received_s")) / DAY).alias("age_days"), F.octet_length("body").alias("size"))
    return m.where("age_days >= 399").groupBy("age_days").agg(F.count("*").alias("messages"), F.sum("size").alias("bytes"))


def resubmission_join(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_messages").select("msg_id", "received_s", F.sha2("body", 256).alias("digest"))
    return campaigns.first_by_hash(m, "digest", ["received_s", "msg_id"], "msg_id")


def stats_counters(spark: SparkSession, d: str) -> DataFrame:
    return store.stats_counters(view(spark, d, "v_cases"))


def stats_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    return store.stats_breakdowns(view(spark, d, "v_cases"))


def top_techniques(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.case_techniques(view(spark, d, "v_signals"))
    return t.groupBy("technique").agg(F.count_distinct("case_id").alias("cases")).orderBy(F.desc("cases"), "technique").limit(10)


def top_origins(spark: SparkSession, d: str) -> DataFrame:
    n = F.broadcast(given(spark, d, "nation").select("n_nationkey", "n_name"))  # a table of countries: fixed size
    c = given(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = given(spark, d, "orders").select("o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), "country").limit(10)


def campaign_rollup(spark: SparkSession, d: str) -> DataFrame:
    return store.campaign_rollup(view(spark, d, "v_cases"))


def signal_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return scoring.dedupe(view(spark, d, "v_signals")).select("case_id", "signal_id", "w100", "triggered")


def logodds_score(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.score(view(spark, d, "v_signals"))
    parts = F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 100).cast("int").cast("string"))), ",")
    return out.select("case_id", "logit", "risk", "level", parts.alias("breakdown"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("case_id")
    return view(spark, d, "v_cases").select("case_id", F.when(c % 4 != 0, (c % 97) / 97.0).alias("probability"), (1.0 - (c % 5) / 10.0).alias("coverage"))


def verdict_confidence(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.confidence(view(spark, d, "v_signals"), _context(spark, d))
    return out.select("case_id", "risk", F.col("n_flags").cast("bigint").alias("n_flags"), "confidence")


def class_risk(spark: SparkSession, d: str) -> DataFrame:
    n = scoring.severity_counts(view(spark, d, "v_signals"))
    c = F.col("case_id")
    risk = scoring.class_risk(c % 5, (c % 101) / 100.0, F.col("n_critical"), F.col("n_high"), F.col("n_medium"), F.when(c % 6 == 0, 1.0).otherwise(0.0))
    return n.select("case_id", risk.alias("risk"))


def verdict_assembly(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "v_signals")
    return scoring.assemble(scoring.score(s), scoring.rationale(s), scoring.confidence(s, _context(spark, d)))


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_intel")
    return r.groupBy("subject").agg(F.count("*").alias("planned"), F.count_if(F.col("score") > 10).alias("answered"), F.round(F.count_if(F.col("score") > 10) / F.count("*"), 6).alias("coverage"))


def relay_signals(spark: SparkSession, d: str) -> DataFrame:
    return relay.relay_signals(relay.relay_path(view(spark, d, "v_hops"))).select("case_id", "signal_id", F.col("w100").cast("bigint").alias("w100"), "result")


def ml_signal(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, "labels").select("doc_id", F.round(scoring.ml_weight((F.col("doc_id") % 1000) / 999.0), 6).alias("weight"))


def case_techniques(spark: SparkSession, d: str) -> DataFrame:
    return scoring.case_techniques(view(spark, d, "v_signals"))


def signal_techniques(spark: SparkSession, d: str) -> DataFrame:
    return scoring.signal_techniques(view(spark, d, "v_signals"))


def technique_coverage(spark: SparkSession, d: str) -> DataFrame:
    seen = view(spark, d, "v_signals").where("triggered").select(scoring.canonical(F.col("signal_id")).alias("id")).distinct()
    known = scoring.technique_table(spark).groupBy("id").agg(F.count("*").alias("techniques"))
    return seen.join(F.broadcast(known), "id", "left").select("id", F.coalesce("techniques", F.lit(0)).alias("techniques"), F.col("techniques").isNull().alias("missing"))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    return scoring.attribution(view(spark, d, "v_signals"), view(spark, d, "v_context"))


def threat_class(spark: SparkSession, d: str) -> DataFrame:
    return scoring.threat_class(view(spark, d, "v_signals"), view(spark, d, "v_cases").select("case_id", "verdict"))


def top_rationale(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rationale(view(spark, d, "v_signals"))


def _exposed(spark: SparkSession, d: str) -> DataFrame:
    return exposure.with_staff(view(spark, d, "v_exposures"), view(spark, d, "v_staff"))


def exposure_directory(spark: SparkSession, d: str) -> DataFrame:
    return _exposed(spark, d).select("event_id", "email", "name", "department", "role", "is_high_value")


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return exposure.blast_radius(_exposed(spark, d))


def containment_priority(spark: SparkSession, d: str) -> DataFrame:
    radius = exposure.blast_radius(_exposed(spark, d)).withColumn("risk", (F.col("wave") * 2.5).cast("double"))
    return exposure.priority(radius).select("wave", "recipients", "priority")


def wave_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_cases")
    one = c.where("custkey % 200 < 60").select("fingerprint", (F.col("custkey") % 200).alias("wave")).distinct()
    two = c.where("custkey % 40 < 20").select("from_domain", (1000 + F.col("custkey") % 40).alias("wave")).distinct()
    return exposure.wave_lookup(c, one, two)


def recipients_complete(spark: SparkSession, d: str) -> DataFrame:
    return exposure.complete_recipients(view(spark, d, "v_exposures").select("email"), view(spark, d, "v_staff").select("email"))


def hop_index(spark: SparkSession, d: str) -> DataFrame:
    return relay.hop_index(view(spark, d, "v_hops").select("case_id", "ip", F.col("hop_index").alias("position")), "case_id", "position").select("case_id", "ip", "position", "hop_index")


def relay_path(spark: SparkSession, d: str) -> DataFrame:
    return relay.relay_path(view(spark, d, "v_hops")).select("case_id", "hop_index", "ip", "delay_s", F.array_join("reasons", ";").alias("reasons"))


def earliest_reliable_hop(spark: SparkSession, d: str) -> DataFrame:
    return relay.earliest_reliable(view(spark, d, "v_hops"))


def origin_summary(spark: SparkSession, d: str) -> DataFrame:
    return relay.origin_summary(view(spark, d, "v_hops"))


def case_numbering(spark: SparkSession, d: str) -> DataFrame:
    return store.case_numbering(view(spark, d, "v_cases").drop("case_number"))


def campaign_assign(spark: SparkSession, d: str) -> DataFrame:
    return campaigns.assign(view(spark, d, "v_cases"))


def campaign_siblings(spark: SparkSession, d: str) -> DataFrame:
    return campaigns.siblings(view(spark, d, "v_cases")).select("case_id", "siblings")


def custody_append(spark: SparkSession, d: str) -> DataFrame:
    return custody.append(view(spark, d, "v_custody")).select("case_id", "idx", "prev_hash", "entry_hash")


def custody_verify(spark: SparkSession, d: str) -> DataFrame:
    log = custody.append(view(spark, d, "v_custody"))
    # Every 17th entry's payload is altered after the fact: the check must find it.
    altered = log.withColumn("payload_hash", F.when((F.col("case_id") + F.col("idx")) % 17 == 5, F.lit("altered")).otherwise(F.col("payload_hash")))
    return custody.verify(altered)


def queue_sorted_page(spark: SparkSession, d: str) -> DataFrame:
    return store.sorted_page(view(spark, d, "v_cases"), "risk", 20, 40).select("case_id", "risk")


def relate_cases(spark: SparkSession, d: str) -> DataFrame:
    return links.relate(view(spark, d, "v_links"))


def case_clusters(spark: SparkSession, d: str) -> DataFrame:
    return links.clusters(view(spark, d, "v_links"), view(spark, d, "v_cases"))


def artefact_intersect(spark: SparkSession, d: str) -> DataFrame:
    return links.intersect(view(spark, d, "v_links"))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return links.nodes(view(spark, d, "v_links"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return links.edges(view(spark, d, "v_links"))


def new_indicators(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "v_iocs")
    key = lambda df: df.select("ioc_type", F.lower("value").alias("value")).distinct()
    cut = 946684800
    return key(i.where(F.col("first_seen_s") >= cut)).join(key(i.where(F.col("first_seen_s") < cut)), ["ioc_type", "value"], "left_anti")


def extract_iocs(spark: SparkSession, d: str) -> DataFrame:
    """Senders, domains, relays, link hosts, URLs and files of each case."""
    c, links, none = view(spark, d, "v_cases"), view(spark, d, "v_links"), F.lit(None).cast("string").alias("note")
    at = F.lit(0).cast("bigint").alias("pos")
    hops = view(spark, d, "v_hops").where("not is_private").groupBy("case_id", F.col("ip").alias("value")).agg(F.min("hop_index").cast("bigint").alias("pos"))
    parts = [
        c.select("case_id", F.lit("sender").alias("kind"), F.col("sender").alias("value"), at, F.col("case_number").alias("note")), c.select("case_id", F.lit("domain").alias("kind"), F.col("from_domain").alias("value"), at, none),
        links.where("kind in ('domain', 'url_host')").select("case_id", "kind", "value", at, none), hops.select("case_id", F.lit("ip").alias("kind"), "value", "pos", none),
        view(spark, d, "v_iocs").where("ioc_type = 'url'").select("case_id", F.lit("url").alias("kind"), "value", "pos", none),
        links.where("kind = 'attachment'").select("case_id", F.lit("file").alias("kind"), F.md5("value").alias("value"), at, F.concat("value", F.lit(".bin (unknown)")).alias("note")),
    ]
    return triage.extract_iocs(c, reduce(DataFrame.unionByName, parts))


def sink_case_upsert(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "v_iocs")
    return store.upsert_iocs(i.where("case_id % 2 = 0"), i.where("case_id % 2 = 1"))


def case_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Cases saved again replace the stored row of the same id: every third case comes back with another verdict, some twice, and every fifth too late."""
    stored = view(spark, d, "v_cases").select("case_id", "verdict", "risk", F.when(F.col("case_id") % 5 == 0, 3).otherwise(0).alias("version"))
    fresh = stored.where("case_id % 3 = 0").select("case_id", F.lit("benign").alias("verdict"), "risk", F.explode(F.when(F.col("case_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("version"))
    return store.upsert_cases(stored, fresh, "case_id", "version")


def case_store(spark: SparkSession, d: str) -> DataFrame:
    """All cases saved on disk with their signals; then every third again, some too late, with its heavy signals only."""
    folder, c, signals = new_path(spark, "casestore"), F.col("case_id"), view(spark, d, "v_signals").select("case_id", "signal_id", "w100", "pos")
    stored = view(spark, d, "v_cases").select("case_id", "verdict", F.when(c % 5 == 0, 3).otherwise(0).alias("version"))
    fresh = stored.where(c % 3 == 0).select("case_id", F.lit("benign").alias("verdict"), F.lit(1).alias("version"))
    casefiles.save_cases(folder, stored, {"signals": signals}, buckets=16)
    casefiles.save_cases(folder, fresh, {"signals": signals.where((c % 3 == 0) & (F.col("w100") >= 150))}, buckets=16)
    n = casefiles.read_part(spark, folder, "signals", signals.schema).groupBy("case_id").agg(F.count("*").alias("n_signals"))
    cases = casefiles.read_part(spark, folder, "cases", stored.schema)
    return cases.join(n, "case_id", "left").select("case_id", "verdict", "version", F.coalesce("n_signals", F.lit(0)).alias("n_signals"))


def sla_report(spark: SparkSession, d: str) -> DataFrame:
    closed = F.when(F.col("status") == "closed", F.col("created_s") + F.col("case_id") % 3600)
    return store.sla_report(view(spark, d, "v_cases").withColumn("closed_s", closed), NOW_S)


def apply_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    decisions = given(spark, d, "events").select(
        e.alias("decision_id"), (e * 3).alias("case_id"), F.unix_timestamp("ts").alias("at_s"),
        F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "override").when(F.col("event_type") == "error", "escalate").otherwise("ignore").alias("decision"),
        F.when(e % 2 == 0, "benign").otherwise("").alias("new_verdict"), F.when(e % 7 == 0, "").otherwise(F.concat(F.lit("analyst"), (e % 5).cast("string"))).alias("analyst"),
    )
    return store.apply_decisions(view(spark, d, "v_cases"), decisions)


def geo_resolve(spark: SparkSession, d: str) -> DataFrame:
    s = given(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    one = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("city of supplier "), F.col("s_suppkey").cast("string")).alias("place"))
    n = F.broadcast(given(spark, d, "nation"))
    two = s.where("s_nationkey < 20").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("place"))
    return intel.geo_resolve(s, one, two, "s_suppkey").select("s_suppkey", "place", "source")


def intel_asof(spark: SparkSession, d: str) -> DataFrame:
    return intel.as_of(view(spark, d, "v_lookups"), view(spark, d, "v_intel"), 168 * 3600)


def intel_signals(spark: SparkSession, d: str) -> DataFrame:
    return intel.intel_signals(view(spark, d, "v_answers"))


def intel_plan(spark: SparkSession, d: str) -> DataFrame:
    i = view(spark, d, "v_iocs").where("ioc_type = 'url'")
    from pyspark.sql import Window as W

    urls = i.withColumn("nth", F.row_number().over(W.partitionBy("case_id").orderBy("pos", "value"))).select("case_id", "nth", "value")
    return intel.plan(view(spark, d, "v_cases"), urls, view(spark, d, "v_hops"))


def ip_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Hops in ranges made of suppliers: /20 blocks and, first in order, some /24 blocks inside them."""
    k = F.col("s_suppkey")
    base = (20 + k % 200) * 16777216 + 7 * 65536
    wide = given(spark, d, "supplier").select((k + 1000000).alias("ord"), base.alias("first"), (base + 20479).alias("last"), F.concat(F.lit("wide-"), (k % 200).cast("string")).alias("net"))
    narrow = given(spark, d, "supplier").where("s_suppkey % 4 = 0").select(k.alias("ord"), (base + (k % 250) * 256).alias("first"), (base + (k % 250) * 256 + 255).alias("last"), F.concat(F.lit("narrow-"), k.cast("string")).alias("net"))
    return intel.range_join(view(spark, d, "v_hops").where("not is_private").select("case_id", "hop_index", "ip"), wide.unionByName(narrow), "ip").select("case_id", "hop_index", "ip", "net")


def ip_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    """IPv4 and IPv6 addresses in networks of /0 to /48: the first that holds each, and the narrowest."""
    networks = view(spark, d, "v_networks").withColumn("prefix", network_prefix(F.col("cidr")))
    rows = view(spark, d, "v_addresses")
    first = intel.prefix_join(rows, networks, "ip").select("id", "ip", F.lit("first").alias("rule"), "cidr")
    return first.unionByName(intel.prefix_join(rows, networks, "ip", "longest").select("id", "ip", F.lit("longest").alias("rule"), "cidr"))


def next_actions(spark: SparkSession, d: str) -> DataFrame:
    c, key = view(spark, d, "v_cases"), F.col("case_id").cast("string")
    radius = exposure.blast_radius(_exposed(spark, d)).select("wave", "clicked", "submitted")
    hosts = view(spark, d, "v_links").where("kind = 'url_host'").groupBy("case_id").agg(F.collect_set("value").alias("link_domains"))  # of one message
    origin = view(spark, d, "v_hops").where("hop_index = 0").select("case_id", F.col("ip").alias("origin_ip"))
    known = c.withColumn("wave", F.col("case_id") % 40).join(radius, "wave", "left").join(hosts, "case_id", "left").join(origin, "case_id", "left")
    facts = known.withColumn("message_id", F.when(F.col("case_id") % 6 != 0, F.concat(F.lit("<"), key, F.lit("@"), F.col("from_domain"), F.lit(">")))).withColumn("raw_sha256", F.sha2(key, 256)).withColumn("custody_head", F.when(F.col("anchored"), F.sha2("case_number", 256)))
    return triage.next_actions(facts)


def campaign_risk_reach(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: signals deduped and scored, rolled up by campaign, joined with how far each wave reached."""
    scored = scoring.score(view(spark, d, "v_signals")).select("case_id", F.col("risk").alias("scored_risk"))
    cases = view(spark, d, "v_cases").select("case_id", "fingerprint", (F.col("custkey") % 40).alias("wave")).join(scored, "case_id")
    rolled = cases.groupBy("fingerprint", "wave").agg(F.count("*").alias("cases"), F.max("scored_risk").alias("risk"))
    radius = exposure.blast_radius(_exposed(spark, d)).drop("departments")
    return exposure.priority(rolled.join(radius, "wave")).select("fingerprint", "wave", "cases", "risk", "recipients", "clicked", "submitted", "high_value", "priority")


NAMES = """queue_filter case_summary search_prefix search_contains ioc_pivot audit_trail alert_candidates enrichment_gate retention_redact retention_preview
resubmission_join stats_counters stats_breakdowns top_techniques top_origins campaign_rollup signal_dedupe logodds_score verdict_confidence class_risk verdict_assembly
evidence_coverage relay_signals ml_signal case_techniques signal_techniques technique_coverage attribution threat_class top_rationale exposure_directory blast_radius
containment_priority wave_lookup recipients_complete hop_index relay_path earliest_reliable_hop origin_summary case_numbering campaign_assign campaign_siblings custody_append
custody_verify queue_sorted_page relate_cases case_clusters artefact_intersect graph_nodes graph_edges new_indicators extract_iocs sink_case_upsert case_upsert case_store sla_report apply_decisions
geo_resolve intel_asof intel_signals intel_plan ip_range_join ip_prefix_join next_actions campaign_risk_reach""".split()

QUERIES = {name: globals()[name] for name in NAMES}
