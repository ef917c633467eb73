"""Networks of any length in both families, and providers' answers read as variants."""

import ipaddress
import random

from pyspark.sql import functions as F

from mailspark.functions.network import ip_bits, network_prefix
from mailspark.operators import intel

ADDRESSES = ["1.2.3.4", "::1", "::", "2001:DB8::8:800:200c:417a", "fe80::1%eth0", "::ffff:1.2.3.4", "1::2::3", "12345::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "300.1.1.1", "abc", "", None, "1:2:3:4:5:6:7:8::", ":::", "::1.2.3.4.5"]


def bits(text):
    try:
        a = ipaddress.ip_address((text or "").split("%")[0])
        return format(int(a), f"0{a.max_prefixlen}b")
    except ValueError:
        return None


def test_address_bits(spark):
    got = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select("ip", ip_bits(F.col("ip")).alias("bits")).collect()
    assert [(r.ip, r.bits) for r in got] == [(a, bits(a)) for a in ADDRESSES]


def test_network_prefixes(spark):
    nets = ["10.0.0.0/8", "x/8", "1.2.3.4/33", "::/0", "1.1.1.1", "1.2.3.4/-1", "2001:db8::/32", "0.0.0.0/0", "1.2.3.4/x", None]
    got = [r.p for r in spark.createDataFrame([(n,) for n in nets], "n string").select(network_prefix(F.col("n")).alias("p")).collect()]
    assert got == ["400001010", None, None, "6", "4" + bits("1.1.1.1"), None, "6" + bits("2001:db8::")[:32], "4", None, None]


def test_ranges_are_cut_into_their_networks(spark):
    rnd = random.Random(2)
    pairs = [(0, 2**32 - 1), (5, 5), (1, 2**32 - 2), (0, 0), (2**32 - 1, 2**32 - 1), (256, 511)] + [tuple(sorted((rnd.randrange(2**32), rnd.randrange(2**32)))) for _ in range(40)]
    got = spark.createDataFrame(pairs, "first long, last long").select("first", "last", intel.range_prefixes(F.col("first"), F.col("last")).alias("p")).collect()
    for r in got:
        want = ipaddress.summarize_address_range(ipaddress.ip_address(r.first), ipaddress.ip_address(r.last))
        assert sorted(r.p) == sorted("4" + format(int(n.network_address), "032b")[: n.prefixlen] for n in want)


def test_first_and_longest_network(spark):
    rnd = random.Random(4)
    nets = ["0.0.0.0/0", "::/0", "20.0.0.0/7", "::/3"]
    nets += [str(ipaddress.ip_network((rnd.randrange(2**32), rnd.choice([6, 8, 9, 15, 23, 24, 30, 32])), strict=False)) for _ in range(150)] + [str(ipaddress.ip_network((rnd.randrange(2**128), rnd.choice([16, 47, 64, 128])), strict=False)) for _ in range(50)]
    rnd.shuffle(nets)
    ips = [str(ipaddress.ip_network(n).network_address + rnd.randrange(min(1000, ipaddress.ip_network(n).num_addresses))) for n in nets for _ in range(3)] + [str(ipaddress.ip_address(rnd.randrange(2**32))) for _ in range(100)] + ["nowhere", None]
    rows = spark.createDataFrame(list(enumerate(ips)), "id long, addr string")
    table = spark.createDataFrame(list(enumerate(nets)), "ord long, cidr string").withColumn("prefix", network_prefix(F.col("cidr")))
    parsed = [ipaddress.ip_network(n) for n in nets]
    for rule, key in (("first", lambda i: i), ("longest", lambda i: (-parsed[i].prefixlen, i))):
        got = {r.id: r.cidr for r in intel.prefix_join(rows, table, "addr", rule).collect()}
        for k, ip in enumerate(ips):
            held = [i for i, n in enumerate(parsed) if bits(ip) and ipaddress.ip_address(ip) in n]
            assert got[k] == (nets[min(held, key=key)] if held else None), (ip, rule)


def test_one_network_for_all_and_many_small_ones(spark):
    """A /0 is one row, and 5,000 neighbouring networks aren't one key."""
    small = [(i + 1, f"20.1.{i // 250}.{i % 250}/32") for i in range(5000)]
    table = spark.createDataFrame([(0, "0.0.0.0/0"), *small], "ord long, cidr string").withColumn("prefix", network_prefix(F.col("cidr")))
    rows = spark.range(6000).select("id", F.format_string("20.1.%d.%d", (F.col("id") / 250).cast("int"), F.col("id") % 250).alias("ip"))
    got = intel.prefix_join(rows, table, "ip", "longest").groupBy(F.col("cidr") == "0.0.0.0/0").count().collect()
    assert sorted(tuple(r) for r in got) == [(False, 5000), (True, 1000)]


def test_answers_that_are_odd(spark):
    rows = [
        ("abuseipdb", "a", "ok", '{"abuse_confidence_score": "80", "total_reports": null, "is_tor": "true"}'), ("abuseipdb", "b", "ok", '{"abuse_confidence_score": 24}'), ("abuseipdb", "c", "error", '{"abuse_confidence_score": 90}'), ("abuseipdb", "d", "ok", "no json"), ("abuseipdb", "e", "ok", None),
        ("whois", "f", "ok", '{"domain_age_days": 7}'), ("whois", "g", "ok", '{"domain_age_days": 8.0}'), ("virustotal", "v" * 80, "ok", '{"malicious": 9, "suspicious": 1}'), ("dnsbl", "h", "ok", '{"listed_count": 2}'), ("rdns", "i", "ok", '{"ptr": ["p"]}'), ("dns", "j", "ok", '{"notes": "one"}'), (None, None, None, None),
    ]
    got = {r.signal_id: (r.result, r.weight, r.severity) for r in intel.intel_signals(spark.createDataFrame([(*r, "s", "cache") for r in rows], "provider string, subject string, status string, data string, summary string, source string")).collect()}
    assert got["intel.abuse.a"] == ("80% confidence, 0 report(s)", 1.94, "high") and got["intel.tor.a"][1] == 1.5
    assert got["intel.newdomain.f"] == ("7 day(s) old", 2.0, "critical") and got["intel.vt." + "v" * 60] == ("10 engine(s)", 2.3, "critical")
    assert got["intel.dnsbl.h"] == ("", 1.9, "high") and got["intel.rdns.i"] == ("p", 0.8, "medium") and len(got) == 6
