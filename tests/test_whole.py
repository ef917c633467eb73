"""Registered queries answer for every row and pair; held against brute force, without their twins."""

from collections import defaultdict

from mailspark.operators import links
from mailspark.plans import registry
from mailspark.plans.adapters import view

FOLDER = "/root/testdata/sf0.001"


def test_artefact_intersect_shows_every_related_pair(spark):
    cases, holders = defaultdict(set), defaultdict(set)
    for r in view(spark, FOLDER, "v_links").collect():
        cases[r.case_id].add((r.kind, r.value))
        holders[r.kind, r.value].add(r.case_id)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    want = {}
    for a, b in pairs:
        shared = defaultdict(list)
        for kind, value in sorted(cases[a] & cases[b]):
            shared[kind].append(value)
        if sum(links.WEIGHTS[k] for k in shared) >= 80:
            want |= {(a, b, k): ",".join(v[:3]) for k, v in shared.items()}
    got = registry.queries()["artefact_intersect"](spark, FOLDER).collect()
    assert {(r.a, r.b, r.kind): r.shared for r in got} == want and len(got) == len(want)


def test_corpus_union_keeps_every_row(spark, tmp_path):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(["src0", "src5", "src6", "src19", "hot", "", None, "src6"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["corpus_union"](spark, str(tmp_path)).collect()
    assert sorted((r.msg_id, r.origin) for r in got) == [(i, s) for i, _, _, s, _ in rows]
