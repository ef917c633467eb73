"""Exact, near and substring duplicates against brute force, with nulls, empties, ties and repeated rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from mailspark.llm import components, exact_dedup, line_dedup, minhash_dedup, queries, substring_dedup

SCHEMA = "doc_id long, text string, kept string"
BASE = " ".join(f"w{i}" for i in range(120))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], SCHEMA)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (7, BASE), (8, BASE.replace("w3 ", "x ")), (9, BASE.replace("w60 ", "y ")), (10, BASE[: len(BASE) // 2]), (11, "x" * 5000)]


def test_exact(spark):
    for k in (1, 1024):  # hot groups by broadcast, or all by shuffle
        got = exact_dedup.annotate(docs(spark, ROWS), k=k).collect()
        size = Counter(t or "" for _, t in ROWS)
        assert len(got) == len(ROWS)
        assert Counter(r.group_size for r in got) == Counter(size[t or ""] for _, t in ROWS)
        assert sorted(str(r.doc_id) for r in got if r.kept) == sorted(["2", "4", "5", "None", "7", "8", "9", "10", "11"])
    assert exact_dedup.keep_one(docs(spark, ROWS)).count() == 9
    assert exact_dedup.annotate(docs(spark, [])).count() == 0


def test_misra_gries_keeps_frequent():
    counts = {f"d{i}": 1 for i in range(50)} | {"hot": 40}
    assert "hot" in exact_dedup.shrink(counts, 4)


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near(spark):
    rng = np.random.default_rng(3)
    rows = [(1, BASE), (2, BASE), (3, None), (4, ""), (5, "Short one"), (6, "short  ONE")]
    for i in range(10, 40):  # many copies of one text with more and more edits
        words = BASE.split()
        for at in rng.choice(120, (i - 10) // 4, replace=False):
            words[at] = f"e{i}-{at}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.annotate(docs(spark, rows)).collect()}
    assert got == brute_near(rows)
    assert minhash_dedup.annotate(docs(spark, [])).count() == 0
    assert minhash_dedup.keep_one(docs(spark, [(1, "a b"), (1, "a b"), (2, "a b"), (3, None)])).count() == 2


def test_near_query_on_documents(spark):
    """The query's rows against an exact join of all shingle sets: no link is lost or made up."""
    folder = "/root/testdata/sf0.01"
    sets = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders, shared = {}, Counter()
    for i in sorted(sets):
        for x in sets[i]:
            for j in holders.setdefault(x, []):
                shared[j, i] += 1
            holders[x].append(i)
    component = {i: i for i in sets}
    find = lambda i: i if component[i] == i else find(component[i])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in links:
        one, two = find(a), find(b)
        component[max(one, two)] = min(one, two)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op9_minhash_dedup(spark, folder).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets} and len(links) > 50


def test_bayes_bounds_rise():
    least = minhash_dedup.least_matches(0.85, 1e-9)
    assert least == sorted(least) and least[-1] < 0.85 * 128


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31)], "u int, v int")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 21)} | {30: 30, 31: 30}


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raws for k in range(len(b) - length + 1))
    out = []
    for b in raws:
        end, kept, n = 0, bytearray(), 0
        for k in range(len(b)):
            if k <= len(b) - length and seen[b[k : k + length]] > 1:
                end = k + length
            if k < end:
                n += 1
            else:
                kept.append(b[k])
        out.append((len(b), n, bytes(kept)))
    return out


@pytest.mark.parametrize("near, run", [(128, 16_384), (1, 16_384), (1, 2)])
def test_repeats(spark, near, run, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN", run)
    sent = substring_dedup._bucket  # the tasks see what the driver hands over, not the patched module

    def bucket(batches, length):
        substring_dedup.NEAR = near
        return sent(batches, length)

    monkeypatch.setattr(substring_dedup, "_bucket", bucket)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdeé "), n))
    shared = word(500)
    texts = [word(300) + shared + word(200), shared[20:470] + word(100), word(900), None, "", "ab" * 400, word(700), shared[:399] + "#"]
    texts += [texts[2], texts[6][:450] + word(50)] + [word(30) + shared + word(30) for _ in range(4)]
    texts += ["same line, again and again\n" * 40 + word(20), word(5) + "z" * 1000, "z" * 600]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.removed), bytes(r.kept)) for r in substring_dedup.remove_repeats(docs(spark, rows), length=400).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))


def test_repeats_of_empty_table_and_repeated_rows(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    long_text = " ".join(f"word{i}" for i in range(200_000))
    rows = spark.createDataFrame([(1, BASE, "k", 1), (1, BASE, "k", 1), (None, BASE[:450], "k", 2), (None, None, "k", 3), (2, long_text, "k", 4)], "doc_id long, text string, key string, gram int")
    got = sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in substring_dedup.remove_repeats(rows).collect())
    assert got == sorted([("1", len(BASE), b""), ("1", len(BASE), b""), ("None", 450, b""), ("None", 0, b""), ("2", len(long_text), long_text.encode())])


@pytest.mark.parametrize("run", [16_384, 8])
def test_repeats_query_on_documents(spark, run, monkeypatch):
    """The query's columns against all strings of 400 bytes of all documents."""
    monkeypatch.setattr(substring_dedup, "RUN", run)
    folder = "/root/testdata/sf0.01"
    raws = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    names = {i: [xxhash.xxh3_128_intdigest(b[k : k + 400]) for k in range(len(b) - 399)] for i, b in raws.items()}
    seen = Counter(h for own in names.values() for h in own)
    want = {}
    for i, b in raws.items():
        end, kept, removed, spans = 0, [], 0, 0
        for k in range(len(b)):
            if k < len(names[i]) and seen[names[i][k]] > 1:
                spans += k > end or end == 0
                end = k + 400
            if k < end:
                removed += 1
            else:
                kept.append(b[k : k + 1])
        want[i] = (len(b), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, folder).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 100_000


def test_lines(spark):
    rows = [(i, f"{'abcdefghij'[i]}x begins its own line here\nPage 1{i} of 20 printed today\n\nsame line") for i in range(4)] + [(9, None), (10, "")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_recurring(docs(spark, rows), min_texts=3).collect()}
    assert got[0][:2] == (3, 2) and got[9] == (0, 0, None) and got[10] == (0, 0, "")
    assert got[2][2].splitlines()[0].startswith("cx begins") and "same line" not in got[2][2] and "Page" not in got[2][2]
    assert line_dedup.drop_recurring(docs(spark, [])).count() == 0


def test_digest_is_sha256(spark):
    assert exact_dedup.annotate(docs(spark, [(1, "é")])).collect()[0].text_sha256 == hashlib.sha256("é".encode()).hexdigest()
