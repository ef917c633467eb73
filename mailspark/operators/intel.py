"""Enrichment: range and as-of joins, tiered look-ups, reputation signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.functions.network import family, ip_bits
from mailspark.sources.shared import saved


#: Networks with fewer leading bits than this are few (2^8 prefixes of each shorter length at most) and hold many addresses: they are broadcast.
SHORT = 8


def range_prefixes(first: Column, last: Column) -> Column:
    """An IPv4 range as the fewest aligned networks that make it up (62 at most): at each size the odd one out on either side."""
    low, high = lambda k: F.floor((first + (1 << k) - 1) / (1 << k)), lambda k: F.floor((last + 1) / (1 << k))
    name = lambda number, k: F.concat(F.lit("4"), F.substring(F.lpad(F.conv(number.cast("string"), 10, 2), 32, "0"), 1 + k, 32 - k) if k < 32 else F.lit(""))
    each = []
    for k in range(33):
        here = low(k) < high(k)
        each += [F.when(here & (low(k) % 2 == 1), name(low(k), k)), F.when(here & (high(k) % 2 == 1), name(high(k) - 1, k))]
    return F.array_compact(F.array(*each))


def prefix_join(rows: DataFrame, networks: DataFrame, ip_col: str, rule: str = "first") -> DataFrame:
    """The network of each address: the ``first`` in order, or the ``longest`` prefix (of equal ones the first).

    networks (ord, prefix, ...): a family digit and leading bits, as ``network_prefix`` and ``range_prefixes`` write
    them.  Each distinct address is looked up once for every prefix length that occurs (33 + 129 at most), by
    equality; a network is one row, whatever it holds.  Short prefixes would be hot keys: they are at most one
    row each and are broadcast, longer ones are joined by shuffle.  Rows without a network keep nulls.
    """
    others = [c for c in networks.columns if c != "prefix"]
    best = networks.where("prefix is not null").groupBy("prefix").agg(F.min_by(F.struct(*others), "ord").alias("r"))
    best = saved(best.withColumn("bits", F.length("prefix") - 1), "networks")
    lengths = {(r["f"], r["bits"]) for r in best.select(F.substring("prefix", 1, 1).alias("f"), "bits").distinct().collect()}
    ips = rows.select(F.col(ip_col).alias("ip")).distinct().withColumn("b", ip_bits(F.col("ip"))).where("b is not null").withColumn("b", F.concat(family(F.col("b")), F.col("b")))
    ips = saved(ips, "addresses")

    def hits(part: DataFrame, few: bool) -> DataFrame:
        sizes = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n in sorted(lengths) if (n < SHORT) == few] or [F.struct(F.lit("").alias("f"), F.lit(0).alias("n"))])
        keyed = ips.select("ip", "b", F.explode(sizes).alias("s")).where(F.col("s.f") == F.substring("b", 1, 1)).select("ip", F.substring("b", F.lit(1), F.col("s.n") + 1).alias("prefix"))
        return keyed.join(F.broadcast(part) if few else part, "prefix").select("ip", "bits", "r")

    found = hits(best.where(F.col("bits") < SHORT), True).unionByName(hits(best.where(F.col("bits") >= SHORT), False))
    order = F.struct(F.col("r.ord")) if rule == "first" else F.struct(-F.col("bits"), F.col("r.ord"))
    one = found.groupBy(F.col("ip").alias(ip_col)).agg(F.min_by("r", order).alias("r")).select(ip_col, "r.*")
    return rows.join(saved(one, "resolved"), ip_col, "left")


def range_join(rows: DataFrame, ranges: DataFrame, ip_col: str) -> DataFrame:
    """First matching IPv4 range of each address; ranges (ord, first, last, ...) by number, ends included."""
    networks = ranges.withColumn("prefix", F.explode(range_prefixes(F.col("first"), F.col("last"))))
    return prefix_join(rows, networks, ip_col)


def as_of(lookups: DataFrame, records: DataFrame, ttl_s: int) -> DataFrame:
    """Latest record of (provider, subject) at the look-up's time, if not older than the limit.

    One sorted pass over the union of both sides: no join, no candidate rows.
    """
    left = lookups.select("provider", "subject", "at_s", F.lit(1).alias("side"), "lookup_id", F.lit(None).cast("struct<queried_s:bigint,event_id:bigint,score:double>").alias("r"))
    right = records.select("provider", "subject", F.col("queried_s").alias("at_s"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("lookup_id"), F.struct("queried_s", "event_id", "score").alias("r"))
    sweep = W.partitionBy("provider", "subject").orderBy("at_s", "side", "r.event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("r", F.last("r", ignorenulls=True).over(sweep)).where("side = 1")
    fresh = F.col("r.queried_s") >= F.col("at_s") - ttl_s
    return seen.select("lookup_id", "provider", "subject", F.when(fresh, F.col("r.score")).alias("score"), F.when(fresh, F.col("at_s") - F.col("r.queried_s")).alias("age_s"), F.when(fresh, "cache").otherwise("unavailable").alias("source"))


def geo_resolve(rows: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Tiered look-up: the first table with an answer wins, and its name is kept."""
    one, two = first.select(key, F.col("place").alias("p1")), second.select(key, F.col("place").alias("p2"))
    both = rows.join(one, key, "left").join(two, key, "left")
    return both.withColumn("place", F.coalesce("p1", "p2")).withColumn("source", F.when(F.col("p1").isNotNull(), "live").when(F.col("p2").isNotNull(), "offline-table").otherwise("unavailable")).drop("p1", "p2")


def intel_signals(answers: DataFrame) -> DataFrame:
    """Providers' answers as weighted signals.

    answers (provider, subject, status, data, summary, source): ``data`` is each
    provider's own JSON, read as a VARIANT; paths that are missing or of another
    type count as absent, and text that isn't JSON gives no signal.  An answer may raise several signals.
    """
    rows = answers.where("status = 'ok'").withColumn("d", F.try_parse_json("data"))
    at = lambda path, kind: F.try_variant_get("d", f"$.{path}", kind)
    whole = lambda path: F.coalesce(at(path, "double"), F.lit(0.0)).cast("bigint")
    is_ = lambda path: F.coalesce(at(path, "boolean"), F.lit(False))
    subject, provider = F.col("subject"), F.col("provider")
    score, flagged, listed = whole("abuse_confidence_score"), whole("malicious") + whole("suspicious"), whole("listed_count")
    age = F.when(F.schema_of_variant(at("domain_age_days", "variant")) == "BIGINT", at("domain_age_days", "bigint"))
    signal = lambda test, name, title, result, weight, severity, evidence: F.when(test, F.struct(F.concat(F.lit(f"intel.{name}."), subject if name != "vt" else F.substring(subject, 1, 60)).alias("signal_id"), F.lit(title).alias("title"), result.alias("result"), F.round(weight.cast("double"), 4).alias("weight"), severity.alias("severity"), evidence.alias("evidence")))
    # Thresholds, weights, severities and texts of each provider's signals.
    found = [
        signal((provider == "abuseipdb") & (score >= 25), "abuse", "Sending IP has abuse reports", F.format_string("%d%% confidence, %d report(s)", score, whole("total_reports")), 0.9 + F.least(F.lit(1.3), score / 100.0 * 1.3), F.when(score >= 60, "high").otherwise("medium"), F.col("summary")),
        signal((provider == "abuseipdb") & is_("is_tor"), "tor", "Sending IP is a known Tor node", F.lit("tor exit"), F.lit(1.5), F.lit("high"), F.lit("AbuseIPDB flags this address as Tor infrastructure")),
        signal((provider == "whois") & (age <= 30), "newdomain", "Sender domain registered very recently", F.format_string("%d day(s) old", age), F.when(age <= 7, 2.0).otherwise(1.5), F.when(age <= 7, "critical").otherwise("high"), F.format_string("Registered %s. Phishing domains are typically used within days of registration.", F.coalesce(at("created", "string"), F.lit("")))),
        signal((provider == "virustotal") & (flagged != 0), "vt", "URL flagged by URL-reputation engines", F.format_string("%d engine(s)", flagged), F.least(F.lit(2.3), 0.8 + 0.25 * flagged), F.when(flagged >= 5, "critical").otherwise("high"), F.col("summary")),
        signal((provider == "dnsbl") & (listed != 0), "dnsbl", "Sending IP is on a public blocklist", F.array_join(F.coalesce(at("listed_on", "array<string>"), F.array().cast("array<string>")), ", "), 0.9 + 0.5 * listed, F.lit("high"), F.col("summary")),
        signal((provider == "rdns") & (F.size(F.coalesce(at("ptr", "array<string>"), F.array().cast("array<string>"))) > 0) & ~is_("forward_confirmed"), "rdns", "Reverse DNS does not forward-confirm", F.array_join(F.slice(at("ptr", "array<string>"), 1, 2), ", "), F.lit(0.8), F.lit("medium"), F.col("summary")),
    ]
    notes = F.when(provider == "dns", F.coalesce(at("notes", "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    # The note's number is a checksum: it must be the same in every process.
    noted = F.transform(notes, lambda note: F.struct(F.concat(F.lit("intel.dns."), subject, F.lit("."), (F.crc32(note.cast("binary")) % 9999).cast("string")).alias("signal_id"), F.lit("Sender-domain DNS weakness").alias("title"), note.alias("result"), F.lit(0.7).cast("double").alias("weight"), F.lit("medium").alias("severity"), F.concat(F.lit("Structural DNS check on "), subject).alias("evidence")))
    carried = [c for c in answers.columns if c not in ("status", "data", "summary")]
    return rows.select(*carried, F.explode(F.concat(F.array_compact(F.array(*found)), noted)).alias("s")).select(*carried, "s.*")


def plan(cases: DataFrame, urls: DataFrame, hops: DataFrame) -> DataFrame:
    """Distinct look-ups of a whole batch: sender domains, the first URLs' hosts, public addresses of the first hops."""
    domains = cases.select(F.lit("domain").alias("kind"), F.col("from_domain").alias("subject"))
    hosts = urls.where("nth <= 3").select(F.lit("domain").alias("kind"), F.col("value").alias("subject"))
    links = urls.where("nth <= 2").select(F.lit("url").alias("kind"), F.col("value").alias("subject"))
    ips = hops.where("hop_index < 2 and not is_private").select(F.lit("ip").alias("kind"), F.col("ip").alias("subject"))
    return domains.unionByName(hosts).unionByName(links).unionByName(ips).distinct()
