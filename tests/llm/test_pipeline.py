"""The pipeline's stages: their columns, their order and their SQL-expressible decisions."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from mailspark.llm import oracle, queries, toxicity
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


def test_twins(spark):
    for name, sql in oracle.oracle_sql().items():
        same(spark, queries.queries()[name], sql, FOLDER)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "decontaminate", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        if name == "exact_dedup":
            assert len({r.text for r in rows}) == len(rows)
    out = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, FOLDER).collect()}
    assert set(out) == {r.doc_id for r in docs.collect()}
    assert all(out[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.replace("▁", " ").encode()).hexdigest() for r in docs.collect())


def test_near_copies_from_four_fifths_on_go(spark):
    words = [f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(100)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    # 96 shingles of five words each: two changed words leave 86 of 106 (0.81), three 81 of 111 (0.73).
    docs = spark.createDataFrame([(1, changed()), (2, changed(30, 60)), (3, changed(20, 50, 80))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()) == [1, 3]


def brute_force(spark, folder):
    """All five stages in plain Python: (doc_id, n_tokens, digest of ids, digest of the decoded text)."""
    import sentencepiece

    frame = spark.read.parquet(f"{folder}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in frame.collect()}
    voters, weights = queries.toxic_model(spark, frame, folder)
    places, n = {v: j for j, v in enumerate(voters)}, len(voters)
    kept = {}
    for i, t in docs.items():
        words = re.findall(r"[^\W\d_]+", t.lower())
        hits, counts = 0, {}
        for w in words:
            own = [x for x in [w] + [w[:k] + "*" for k in range(4, 8) if len(w) > k] if x in places or x + "@" in places]
            hits += bool(own)
            for x in own:
                counts[x] = counts.get(x, 0) + 1
        fired = {places[x] for x in counts if x in places} | {places[x + "@"] for x, c in counts.items() if c * toxicity.DENSE >= len(words) and x + "@" in places}
        logit = weights[-1]
        if fired or hits:
            logit += sum(weights[j] for j in fired) + weights[n] * min(1.0, 20.0 * hits / max(len(words), 1)) + weights[n + 1] * min(1.0, np.log1p(hits) / 2) + weights[n + 2] * min(1.0, len(fired) / 3)
        if 1 / (1 + np.exp(-logit)) < 0.7:
            kept[i] = t
    largest = {}
    for i, t in kept.items():
        largest[t] = max(largest.get(t, i), i)
    docs = {i: t for t, i in largest.items()}
    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    component = {i: i for i in docs}
    find = lambda i: i if component[i] == i else find(component[i])
    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                one, two = find(a), find(b)
                component[max(one, two)] = min(one, two)
    docs = {i: t for i, t in docs.items() if find(i) == i}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = cut(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {}
    for i, t in docs.items():
        w, hit = cut(t), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = t
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    coded = {i: library.encode(t, add_eos=True) for i, t in clean.items()}
    return {(i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in coded.items()}


def test_the_whole_result_equals_brute_force(spark):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == brute_force(spark, FOLDER) and len(got) > 100


def test_nulls_empties_repeats_and_more_columns(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, __nth string, _text string"
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None, "en", "s", 0, "a", "x"), (2, "", None, None, 0, "b", "x"), (3, words, "en", "s", 1, "c", "x"), (3, words, "en", "s", 1, "d", "x"), (4, words, "en", "s", 1, "e", "x"), (None, "alone", "en", "s", 1, "f", "x"), (6, words + " more", "en", "s", 1, "g", "x")]
    for name, schema, data in (("documents", columns, rows), ("labels", "doc_id long, quality int, toxic int", [(3, 1, 0), (9, 0, 1)]), ("benchmark", "item_id long, text string", [(1, None), (2, "no match at all")])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["2", "4", "None"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
