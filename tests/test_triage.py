"""Containment steps, indicators from artefacts, and cases saved on disk."""

import os

from mailspark.operators import casefiles, triage
from mailspark.sources.shared import new_path

CASE = "case_id long, verdict string, threat_class string, actor_type string, message_id string, raw_sha256 string, from_domain string, clicked long, submitted long, link_domains array<string>, origin_ip string, custody_head string"


def test_steps_follow_from_the_findings(spark):
    rows = [
        (1, "phishing", "fraud", "compromised-account", "<m@x>", "a" * 64, "x.org", 3, 2, ["b.com", "a.com", "b.com", ""], "9.9.9.9", "f" * 64),
        (2, "benign", None, "spoofed-domain", None, None, "", 4, 0, [], "", ""),
        (3,) + (None,) * 11,
    ]
    got = {}
    for r in sorted(triage.next_actions(spark.createDataFrame(rows, CASE), 90).collect(), key=lambda r: (r.case_id, r.nth)):
        got.setdefault(r.case_id, []).append((r.action.split()[0], r.detail, r.urgency))
    assert [s[0] for s in got[1]] == ["Quarantine", "Force", "Block", "Block", "Notify", "Freeze", "Preserve"]
    assert got[1][0][1:] == ("purge by Message-ID <m@x> and by raw SHA-256 " + "a" * 16, "immediate") and got[1][2][1] == "a.com, b.com"
    assert got[2] == [("Reset", "4 click(s) recorded", "immediate"), ("Preserve", "custody chain head not recorded; retention 90 days", "record")]
    assert [s[0] for s in got[3]] == ["Preserve"]


def test_indicators_from_artefacts(spark):
    cases = spark.createDataFrame([(1, 72.9), (2, 5.0), (3, None)], "case_id long, risk double")
    rows = [(1, "sender", "A@x.org", 0, "MT-1"), (1, "domain", "X.org", 0, None), (1, "url_host", "x.ORG", 0, None), (1, "ip", "1.1.1.1", 0, None), (1, "ip", "2.2.2.2", 1, None), (1, "file", "ff", 0, "a.exe (pe)"), (2, "file", "ff", 0, None), (2, "ip", "3.3.3.3", 4, None), (3, "url", "", 0, None), (3, "url", None, 0, None), (3, "other", "v", 0, None)]
    rows += [(2, "url", f"http://h/{i:03}" + "x" * 500, i, None) for i in range(30)]
    got = {(r.case_id, r.ioc_type, r.value): (r.confidence, r.context) for r in triage.extract_iocs(cases, spark.createDataFrame(rows, "case_id long, kind string, value string, pos long, note string")).collect()}
    assert got[1, "email-addr", "A@x.org"] == (72, "From address on MT-1") and got[1, "domain-name", "X.org"] == (62, "sender-side domain")
    assert (1, "domain-name", "x.ORG") not in got and got[1, "ipv4-addr", "1.1.1.1"] == (72, "relay hop (origin)") and got[1, "ipv4-addr", "2.2.2.2"] == (52, "relay hop")
    assert got[1, "file-hash", "ff"] == (82, "attachment a.exe (pe)") and got[2, "file-hash", "ff"][0] == 40 and got[2, "ipv4-addr", "3.3.3.3"][0] == 30
    urls = [v for c, t, v in got if t == "url"]
    assert len(urls) == 20 and all(len(v) == 400 for v in urls) and not any(c == 3 for c, _, _ in got)


def _listing(folder):
    return {f"{name}/{part}": sorted(os.listdir(f"{folder}/{name}/{part}")) for name in ("cases", "signals") for part in os.listdir(f"{folder}/{name}") if part.startswith("bucket=")}


def test_cases_saved_by_partition_and_again(spark):
    folder = new_path(spark, "casefiles")
    case = lambda rows: spark.createDataFrame(rows, "case_id long, verdict string, version int")
    signal = lambda rows: spark.createDataFrame(rows, "case_id long, signal_id string, w100 int")

    def state():
        cases = casefiles.read_part(spark, folder, "cases", case([]).schema).collect()
        signals = casefiles.read_part(spark, folder, "signals", signal([]).schema).collect()
        return sorted((r.case_id, r.verdict, r.version) for r in cases), sorted((r.case_id, r.signal_id) for r in signals)

    casefiles.save_cases(folder, case([(i, "phishing", 1) for i in range(40)] + [(0, "old", 0)]), {"signals": signal([(i, s, 10) for i in range(40) for s in ("a", "b")] + [(99, "stray", 1)])}, buckets=16)
    first = state()
    assert first == ([(i, "phishing", 1) for i in range(40)], [(i, s) for i in range(40) for s in ("a", "b")])
    before = _listing(folder)
    # Case 3 is replaced and loses a signal, case 5 comes too late.
    again = (case([(3, "benign", 2), (5, "benign", 0)]), {"signals": signal([(3, "c", 10), (5, "c", 10)])})
    for _ in range(2):
        casefiles.save_cases(folder, *again, buckets=16)
        cases, signals = state()
        assert dict((c, v) for c, v, _ in cases)[3] == "benign" and dict((c, v) for c, v, _ in cases)[5] == "phishing" and len(cases) == 40
        assert [s for c, s in signals if c == 3] == ["c"] and [s for c, s in signals if c == 5] == ["a", "b"] and len(signals) == 79
    changed = {part for part, files in _listing(folder).items() if before[part] != files}
    assert 2 <= len(changed) <= 4 < len(before)
    # All cases come back without signals: their partitions go.
    casefiles.save_cases(folder, case([(i, "benign", 3) for i in range(40)]), {"signals": signal([])}, buckets=16)
    assert state() == ([(i, "benign", 3) for i in range(40)], [])
    casefiles.save_cases(folder, case([]), {"signals": signal([])}, buckets=16)
    assert len(state()[0]) == 40


def test_saving_broadcasts_no_ids(spark, monkeypatch):
    """One id for each case: however small its compressed file looks, it doesn't pass through the driver."""
    plans, keep = [], casefiles.saved

    def spy(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(casefiles, "saved", spy)
    folder = new_path(spark, "plans")
    for version in (1, 2):
        cases = spark.range(50).selectExpr("id AS case_id", "'bec' AS verdict", f"{version} AS version")
        casefiles.save_cases(folder, cases, {"signals": cases.selectExpr("case_id", "'s' AS signal_id")}, buckets=4)
    assert sum("Join" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)
