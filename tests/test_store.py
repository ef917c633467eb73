"""Saving cases and deciding on look-ups: late rows, ties and partial evidence."""

from mailspark.operators import store


def test_a_late_older_row_replaces_nothing(spark):
    columns = "case_id long, verdict string, version int"
    stored = spark.createDataFrame([(1, "phishing", 5), (2, "benign", 1), (3, "bec", 1)], columns)
    fresh = spark.createDataFrame([(1, "benign", 2), (2, "malware", 1), (4, "suspicious", 0)], columns)
    once = store.upsert_cases(stored, fresh, "case_id", "version")
    want = [(1, "phishing", 5), (2, "malware", 1), (3, "bec", 1), (4, "suspicious", 0)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, store.upsert_cases(once, fresh, "case_id", "version").collect())) == want


def test_gate_reads_hops_and_only_the_doubtful_identities(spark):
    cases = spark.createDataFrame([(i, r) for i, r in enumerate([50.0, 90.0, 90.0, 5.0, 5.0, 20.0, 90.0])], "case_id long, risk double")
    signals = spark.createDataFrame([(1, "id.lookalike_domain", True), (2, "id.display_name", True), (6, "id.punycode", False), (3, "intel.tor_exit", True)], "case_id long, signal_id string, triggered boolean")
    hops = spark.createDataFrame([(4, "open-PROXY.example", []), (4, None, None), (3, "mx.example", ["backwards time"]), (5, None, ["named as a Tor node"])], "case_id long, host string, reasons array<string>")
    got = {r.case_id: r.reason for r in store.enrichment_gate(cases, signals, hops).collect()}
    assert got == {0: "not conclusive", 1: "identity doubt", 2: "conclusive", 3: "conclusive", 4: "anonymised origin", 5: "anonymised origin", 6: "conclusive"}
