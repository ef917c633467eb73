"""Boundary rules on hand-made frames."""

import uuid

from pyspark.sql import functions as F

from mailspark.functions import headers, network, privacy, text, urls
from mailspark.operators import campaigns, corpus, custody, intel, links, relay, scoring, store
from mailspark.sources import mail, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


def signals(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "case_id int, signal_id string, w100 int, severity string, category string, signal_type string, triggered boolean, pos long")


def test_score_prior_clamp_and_dedupe(spark):
    s = lambda *w: signals(spark, [(f"s{i}", x, "high", "heuristic", "t", True, i) for i, x in enumerate(w)])
    risk = lambda df: scoring.score(df).collect()[0].risk
    assert risk(s(0)) == 6.9
    assert risk(s(150)) < risk(s(150, 150)) < risk(s(99900)) == 99.9
    twice = signals(spark, [("a", 150, "high", "h", "t", True, 0), ("a", 150, "high", "h", "t", True, 1)])
    assert risk(twice) == risk(s(150))
    tie = signals(spark, [("a", -150, "high", "h", "t", True, 0), ("a", 150, "high", "h", "t", True, 1)])
    assert scoring.dedupe(tie).collect()[0].w100 == -150


def test_link_threshold(spark):
    rows = [(1, "domain", "d"), (2, "domain", "d"), (1, "asn", "n"), (2, "asn", "n"), (3, "subject_shape", "s"), (4, "subject_shape", "s"), (3, "asn", "m"), (4, "asn", "m")]
    got = links.relate(spark.createDataFrame(rows, "case_id int, kind string, value string")).collect()
    assert [(r.a, r.b, r.w100) for r in got] == [(1, 2, 80)]


def test_campaign_window_edge(spark):
    c = spark.createDataFrame([(1, "f", 0), (2, "f", 168 * 3600), (3, "f", 2 * 168 * 3600 + 1)], "case_id int, fingerprint string, created_s long")
    got = {r.case_id: (r.is_duplicate, r.merged_into) for r in campaigns.assign(c).collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (False, None)}


def test_relay_gaps(spark):
    hops = [(0, 1000, True, "A"), (1, 940, False, "A"), (2, 879, False, "A"), (3, 879 + 3600, False, "A"), (4, 879 + 3600 + 3601, False, None), (5, None, False, "A")]
    df = spark.createDataFrame([(1, i, t, f"9.9.9.{i}", p, False, t is not None, c) for i, t, p, c in hops], "case_id int, hop_index int, ts_s long, ip string, is_private boolean, is_documentation boolean, parse_ok boolean, country string")
    got = {r.hop_index: r.reasons for r in relay.relay_path(df).collect()}
    assert got[1] == ["public after private"] and "backwards time" in got[2] and "long gap" not in got[3]
    assert {"long gap", "unresolved"} <= set(got[4]) and "unparsed" in got[5]


def test_as_of_ttl_edge(spark):
    look = spark.createDataFrame([(1, "p", 7, 1000), (2, "p", 7, 1101)], "lookup_id long, provider string, subject long, at_s long")
    rec = spark.createDataFrame([("p", 7, 900, 5.0, 1)], "provider string, subject long, queried_s long, score double, event_id long")
    got = {r.lookup_id: r.score for r in intel.as_of(look, rec, 100).collect()}
    assert got == {1: 5.0, 2: None}


def test_custody_finds_change(spark):
    e = spark.createDataFrame([(1, i, "k", f"p{i}") for i in range(4)], "case_id long, idx long, kind string, payload_hash string")
    log = custody.append(e)
    assert custody.verify(log).collect()[0].first_broken is None
    bad = log.withColumn("payload_hash", F.when(F.col("idx") == 2, "x").otherwise(F.col("payload_hash")))
    assert custody.verify(bad).collect()[0].first_broken == 2


def test_alignment_is_three_valued(spark):
    got = lambda h: one(spark, headers.auth(F.lit(h), F.lit("a.com"))["spf_aligned"])
    assert got("spf=pass smtp.mailfrom=x@mail.a.com") is True and got("spf=pass smtp.mailfrom=x@b.com") is False and got("spf=pass") is None


def test_functions(spark):
    assert one(spark, urls.registrable(F.lit("a.b.co.uk"))) == "b.co.uk" and one(spark, urls.registrable(F.lit("x.y.com"))) == "y.com"
    assert one(spark, urls.host(F.lit("https://u@H.com:8/p"))) == "h.com"
    assert one(spark, text.skeleton(F.lit("rnicr0s0ft"))) == "microsoft"
    assert one(spark, network.ip_class(F.lit("203.0.113.9"))) == "documentation" and one(spark, network.ip_class(F.lit("::1"))) == "loopback"
    assert one(spark, headers.domain_age_days(F.lit("1970-01-02"), 86400 * 11)) == 10
    assert one(spark, sinks.uuid5(F.lit("url:http://x"))) == str(uuid.uuid5(uuid.UUID("00abedb4-aa42-466c-9c01-fed23315a9b7"), "url:http://x"))
    masked = privacy.mask_one("priya.sharma@acme.co.in")
    assert masked == f"p**********a@acme.co.in [#{privacy.tag('Priya.Sharma@acme.co.in ')}]" and len(privacy.tag("x")) == 6
    assert "4242424242424242" not in privacy.mask_one("card 4242424242424242")


def test_null_and_empty_tables(spark):
    empty = spark.createDataFrame([], "case_id int, signal_id string, w100 int, severity string, category string, signal_type string, triggered boolean, pos long")
    assert scoring.score(empty).count() == 0
    raw = spark.createDataFrame([(1, bytearray(b"")), (2, None), (3, bytearray(b"From: <@@@>\n\nhi"))], "id long, content binary")
    assert {r.id: r.body for r in mail.parse_messages(raw).collect()} == {1: "", 2: "", 3: "hi"}


def test_greedy_keep_follows_the_first_kept(spark):
    ids = spark.createDataFrame([(i,) for i in range(5)], "id int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a int, b int")
    assert sorted(r.id for r in corpus.greedy_keep(ids, pairs).where("kept").collect()) == [0, 2, 3]


def test_search_needs_every_term(spark):
    rows = spark.createDataFrame([(1, "invoice due"), (2, "invoice")], "id int, t string")
    assert [r.id for r in store.search_prefix(rows, ["t"], "inv du*", "id").collect()] == [1]
