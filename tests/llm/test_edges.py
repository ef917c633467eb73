"""Clashing names, letters, samples, long texts, empty tables, nulls and repeated rows of the training operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspark.llm import decontaminate, exact_dedup, language_id, line_dedup, minhash_dedup, queries, sentencepiece_codec, sharding, storage, substring_dedup, toxicity, url_filter

WORDS = " ".join(f"w{i}" for i in range(40))
LONG = " ".join(f"{i:06d}x" for i in range(130_000))  # a million characters


def test_fresh_names_clash_with_nothing():
    assert storage.fresh(["Nth", "_nth", "x"], "nth", "same") == ["__nth", "same"]


def test_toxicity_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "i", 1), (2, None, 8, "j", 0)], "doc_id long, text string, __label int, __id string, label int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_rows(docs, labels, docs.doc_id > 0).collect()
    assert sorted((r.id, r.text, r.label) for r in got) == [(1, "a b", 1), (2, None, None)]
    voters, weights = toxicity.fit(toxicity.labelled_rows(docs, labels, docs.doc_id > 0))
    assert toxicity.score(docs, (voters, weights)).count() == 2 and toxicity.keep_clean(docs, (voters, weights)).columns == docs.columns


def test_samples_at_any_size(spark):
    rows = spark.range(40_000).select("id", F.lit("t").alias("text"))
    assert storage.sampled(rows, 0.0, "id", "text").count() == 0 and storage.sampled(rows, 1.0, "id", "text").count() == 40_000
    assert 250 < storage.sampled(rows, 0.01, "id", "text").count() < 550
    assert 0 < storage.sampled(rows, 1e-4, "id", "text").count() < 20  # a share of 1e-7 and less used to be 0


def test_fit_without_a_drawn_row_fails_loudly(spark):
    labelled = spark.createDataFrame([(i, f"text {i}", "en", 1) for i in range(50)], "id long, text string, lang string, label int")
    with pytest.raises(ValueError):
        language_id.fit(labelled, max_rows=0)
    with pytest.raises(ValueError):
        toxicity.fit(labelled, max_rows=0)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", 0), (2, "le chat et le chien", "fr", 1), (3, None, "en", 2), (4, "", None, 3), (5, "½ ² 12 Ⅷ", "en", 4), (1, "the cat and the dog", "en", 5), (None, "der Hund", None, 6), (7, "的", "zh", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language_id.predict(docs, learn=F.lit(True)).collect()
    by = [(r.doc_id, r.lang_pred) for r in got]
    assert len(got) == len(rows) and by.count((1, "en")) == 2 and (2, "fr") in by and (7, "zh") in by
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert language_id.predict(docs.limit(0), learn=F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, learn=F.lit(False)).collect()} == {"und"}


def test_language_equals_brute_force(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("abc abd", "x"), ("xyz", "y"), ("abz", "x"), ("zzz y", "y"), ("abcxyz", "y")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    buckets = language_id.BUCKETS
    counts = {g: np.zeros(buckets) for g in "xy"}
    for _, t, g in rows:
        for part in language_id.ngram_buckets(t, buckets):
            for b in part:
                counts[g][b] += 1
    want = {}
    for i, t, _ in rows:
        logits = {g: np.log(sum(r[2] == g for r in rows) / len(rows)) for g in "xy"}
        for part in language_id.ngram_buckets(t, buckets):
            for b in part:
                for g in "xy":
                    logits[g] += np.log((counts[g][b] + 0.5) / (counts[g].sum() + 0.5 * buckets))
        best = max("xy", key=lambda g: logits[g])
        want[i] = (best, 1 / sum(np.exp(logits[g] - logits[best]) for g in "xy"))
    for r in language_id.predict(docs, learn=F.lit(True)).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-4)


def test_keep_one_keeps_clashing_columns_and_chooses_by_row(spark):
    rows = [(1, WORDS, "a", "k", 2), (1, WORDS, "b", "k", 2), (1, WORDS, "b", "k", 2), (2, None, "c", "k", 3), (None, WORDS + " z", "d", "k", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __nth string, __same_row string, nth int")
    for op in (exact_dedup, minhash_dedup):
        kept = {tuple(r) for r in op.keep_one(docs).collect()}
        again = {tuple(r) for r in op.keep_one(docs.orderBy(F.desc("__nth"))).collect()}
        assert kept == again and kept <= {tuple(r) for r in rows} and len([r for r in kept if r[0] == 1]) == 1
        assert op.keep_one(docs).columns == docs.columns


def test_codec_with_clashing_columns_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", "x"), (1, "a b", "mine", "x"), (2, None, None, "y")], "doc_id long, text string, _text string, _IDS string")
    got = sentencepiece_codec.round_trip(docs, queries.piece_model())
    assert got.columns == ["doc_id", "text", "_text", "_ids", "_n_tokens", "_decoded"]
    assert sorted((r.doc_id, r["_text"] or "", r._decoded) for r in got.collect()) == [(1, "mine", "a b"), (1, "mine", "a b"), (2, "", "")]
    assert sentencepiece_codec.round_trip(docs.limit(0), queries.piece_model()).count() == 0


def test_urls_with_clashing_columns_in_any_case_and_empty_tables(spark):
    rules = spark.createDataFrame([*url_filter.RULES, ("net/es/", "allow"), ("com/", "allow"), (None, "block")], "rule string, verdict string")
    urls = spark.createDataFrame([(1, "http://x.net/es/", "mine"), (1, "http://x.net/es/", "mine"), (None, None, "mine"), (3, "http://a.com/" + "p" * 1_000_000, "mine")], "page_id long, url string, HOST string")
    got = url_filter.judge(urls, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in got.collect()) == [("1", "x.net", "net/es/", "block")] * 2 + [("3", "a.com", "com/", "allow"), ("None", "", None, "allow")]
    assert url_filter.judge(urls.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in url_filter.judge(urls, rules.limit(0)).collect()} == {(None, "allow")}


def test_decontamination_with_nulls_and_clashes(spark):
    docs = spark.createDataFrame([(None, WORDS, "k", "i"), (None, "other", "k", "i"), (None, None, "k", "i"), (4, LONG + " " + WORDS, "k", "i")], "doc_id long, text string, __bad_key string, __bad_id string")
    items = spark.createDataFrame([(1, WORDS), (None, WORDS)], "item_id long, text string")
    found = {(r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(docs, items).collect()}
    assert found == {(None, 40, 40), (None, 1, 0), (None, 0, 0), (4, 130_040, 40)}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.text)[:5] for r in kept.collect()) == ["00000", "None", "other"]
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_lines_of_repeated_rows_and_ties(spark):
    text = [f"line of words number one\n{c} alone" for c in ("a", "b", "b")]
    docs = spark.createDataFrame([(1, text[0], 1), (2, text[1], 1), (2, text[1], 1), (None, None, 1)], "doc_id long, text string, leaf int")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring(docs, min_texts=2).collect())
    assert got == [("1", 2, 1), ("2", 2, 1), ("2", 2, 1), ("None", 0, 0)]
    three = line_dedup.drop_recurring(docs, min_texts=3).collect()  # repeated rows are one text
    assert all(r.n_dropped == 0 for r in three)


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG), (3, LONG[: len(LONG) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in exact_dedup.annotate(docs).collect()} == {1: False, 2: True, 3: True}
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in minhash_dedup.annotate(docs).collect()} == {1: (1, 129_996), 2: (1, 129_996), 3: (3, 64_996)}
    assert {r.doc_id: len(r.kept) for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert sharding.assign(docs, shards=2).count() == 3
    model = (["zork"], np.array([5.0, 1.0, 1.0, 1.0, -3.0]))
    assert all(r.score < 0.5 for r in toxicity.score(docs, model).collect())


def test_near_copies_with_null_ids(spark):
    docs = spark.createDataFrame([(None, WORDS), (5, WORDS), (None, "one two"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in minhash_dedup.annotate(docs).collect())
    assert got == [("5", "5", 36), ("None", "5", 36), ("None", "None", 0), ("None", "None", 1)]


def test_sharding_sizes_checksums_and_clashes(spark):
    import zlib

    texts = ["é" * 5, None, "", "same", "same"]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, shard int, key string")
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in sharding.assign(docs, shards=2).collect()}
    assert got == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t in enumerate(texts)}
