"""Codec round trips, classifiers on held-out rows, decontamination, sharding and URL rules."""

import zlib
from collections import Counter

import numpy as np
import pytest

from mailspark.llm import decontaminate, language_id, queries, sentencepiece_codec, sharding, toxicity, url_filter

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def test_codec_equals_library(spark, library):
    texts = [None, "", " ", "  a b", "a\n\nb", "É ①ﬁ\t x y", "▁a", "a\x00b", "😀é", "<s></s><0x41>", "x" * 3000, " " * 40 + "z", "isArray====----", "日本語 ข"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, _ids string")
    got = {r.doc_id: r for r in sentencepiece_codec.round_trip(df, queries.piece_model()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert got[i]._ids == " ".join(map(str, ids)) and got[i]._n_tokens == len(ids) and got[i]._decoded == library.decode(ids)


def test_codec_on_documents(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sentencepiece_codec.round_trip(docs, queries.piece_model(), columns=["doc_id"]).collect():
        assert r._ids == " ".join(map(str, library.encode(texts[r.doc_id], add_eos=True)))


def test_decode_of_any_ids(library):
    table = sentencepiece_codec.PrefixTable(sentencepiece_codec.load_vocabulary(queries.piece_model()))
    assert table.decode(library.encode("a b")) == "a b"
    assert table.decode([3 + 0xE2, 3 + 0x82]) == "��"


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, FOLDER).toPandas()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = got[got.held_out]
    assert all(held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0))
    assert (held.lang_pred == held.doc_id.map(langs)).mean() > 0.95


def test_language_without_letters():
    assert language_id.score_text("12 !?", ["en"], None, None) == ("und", 0.0)
    assert language_id.score_text(None, [], None, None) == ("und", 0.0)


def test_label_model_recovers_planted_voters():
    draw = np.random.default_rng(3)
    truth = (draw.random(4000) < 0.2).astype(float)
    planted = [(0.8, 0.05), (0.6, 0.1), (0.5, 0.02), (0.4, 0.15)]
    single = [np.where(truth > 0, draw.random(4000) < a, draw.random(4000) < b).astype(float) for a, b in planted]
    votes = np.column_stack([*single, single[3]])  # the last two are one voter, heard twice
    given = np.where(draw.random(4000) < 0.1, 1 - truth, truth)
    post, rate1, rate0, weight = toxicity.label_model(votes, given)
    for j, (a, b) in enumerate([*planted, planted[3], (0.9, 0.1)]):
        assert abs(rate1[j] - a) < 0.05 and abs(rate0[j] - b) < 0.05
    assert abs(weight[3] + weight[4] - 1) < 0.1 and min(weight[:3]) > 0.9
    flipped = given != truth
    assert ((post > 0.5) == truth).mean() > 0.96 and ((post > 0.5) == truth)[flipped].mean() > 0.7


def test_label_model_outvotes_random_labels():
    draw = np.random.default_rng(5)
    truth = (draw.random(4000) < 0.2).astype(float)
    votes = np.column_stack([np.where(truth > 0, draw.random(4000) < a, draw.random(4000) < b).astype(float) for a, b in [(0.8, 0.05), (0.6, 0.1), (0.5, 0.02), (0.4, 0.15)]])
    post, rate1, rate0, _ = toxicity.label_model(votes, (draw.random(4000) < 0.5).astype(float))
    assert ((post > 0.5) == truth).mean() > 0.9 and abs(rate1[-1] - rate0[-1]) < 0.1


def test_lists_vote_if_a_term_does():
    votes = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]])
    got = toxicity.list_votes(votes, ["idio*", "idiot@", "moron"])
    assert got.shape == (3, toxicity.LISTS) and (got[0] == got[1]).all() and got.sum(1).tolist() == [1.0, 1.0, 0.0]


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, FOLDER).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    pairs = Counter((labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels)
    assert pairs[1, 1] >= 0.8 * (pairs[1, 0] + pairs[1, 1]) and pairs[0, 1] <= 0.02 * (pairs[0, 0] + pairs[0, 1])


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "id long, text string, label int")
    model = toxicity.fit(none)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot scum"), (3, "you idiot scum")], "doc_id long, text string")
    got = sorted((r.doc_id, round(r.score, 3)) for r in toxicity.score(docs, model).collect())
    assert len(got) == 4 and got[0][1] == got[1][1] < 0.5 < got[2][1]
    assert toxicity.keep_clean(docs, model).count() == 2


def test_decontamination(spark):
    item = " ".join(f"Word{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    text = "start " + item.upper().replace(" ", ", ") + " end"
    docs = spark.createDataFrame([(1, text), (2, "a tiny  item here"), (3, None), (4, ""), (5, " ".join(item.split()[:12])), (1, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(1, 22, 20, (1,)), (1, 22, 20, (1,)), (2, 4, 2, (2,)), (3, 0, 0, ()), (4, 0, 0, ()), (5, 12, 0, ())]
    blocks = decontaminate.contamination(docs, items, block_items=1)
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in blocks.collect()) == got
    assert decontaminate.drop_contaminated(docs, items).count() == 3
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_sharding(spark):
    rows = [(i, "same" if i < 60 else f"t{i % 37}") for i in range(200)] + [(None, None), (5, "same")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_url_rules(spark):
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    urls = [None, "no scheme", "http://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://a.b.example.com/en/x?q#f", "http://x.net/es/", "http://x.net/de/", "http://com", "http://www.example.com/fr", "://"]
    for ranges in (1, 5):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, ranges=ranges).collect()}
        assert got[0] == ("", "", None, "allow") and got[2] == ("example.com", "/en/1", "example.com/en/", "block") and got[3][2] == "www.example.com/en/"
        assert got[4] == ("a.b.example.com", "/en/x", "example.com/en/", "block") and got[5][2] == "net/es/" and got[6][2] is None and got[7][2] is None and got[8][2] == "com/"


def test_clashing_columns(spark):
    urls = spark.createDataFrame([(1, "http://a.com/x", "mine", "k")], "page_id long, url string, host string, _key string")
    got = url_filter.judge(urls, spark.createDataFrame(url_filter.RULES, "rule string, verdict string")).collect()[0]
    assert (got.host, got["_key"], got.rule) == ("a.com", "k", "com/")
    docs = spark.createDataFrame([(1, "w " * 20, 9, "i", "k")], "doc_id long, text string, label int, _id string, _key string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.label for r in toxicity.labelled_rows(docs, labels, docs.doc_id > 0).collect()] == [1]
    items = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns


def test_sharding_keeps_groups_whole(spark):
    sizes = {"over": 250, "a": 96, "b": 90, "c": 61, "d": 40, "e": 25, "f": 7} | {f"p{i}": 2 for i in range(40)}
    texts = [t for t, n in sizes.items() for _ in range(n)] + [f"alone {i}" for i in range(251)]
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=9).collect()
    shards = Counter(r.shard for r in got)
    assert len(got) == len(texts) == 900 and set(shards.values()) == {100} and len(shards) == 9
    assert len({(r.shard, r.slot) for r in got}) == 900 and {r.slot for r in got} == set(range(100))
    held = {t: {r.shard for r in got if texts[r.doc_id] == t} for t in sizes}
    assert len(held["over"]) == 3 and all(len(held[t]) == 1 for t in sizes if t != "over")


def test_propagation_moves_documents_within_quotas(spark):
    nodes = [(k, 0, (k + i) % 4, 3 if i == 0 else 1) for k in range(40) for i in range(3)]
    got = sharding.propagate(spark.createDataFrame(nodes, "key long, part int, label int, n long"), 4, 60, 2).collect()
    assert sum(r.n for r in got) == 200 and len(got) < len(nodes) / 2
    heavy = [(k, 0, 0, 1) for k in range(200)]
    moved = Counter()
    for r in sharding.propagate(spark.createDataFrame(heavy, "key long, part int, label int, n long"), 4, 60, 3).collect():
        moved[r.label] += r.n
    assert moved[0] < 120 and sum(moved.values()) == 200


def _groups_cut(got, texts):
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    return sum(len(s) > 1 for s in shards.values())


def test_placement_follows_the_rounds(spark):
    # A third in one text, groups of two to forty, and rows without links.
    texts = ["hot"] * 1000 + [f"g{k}" for k in range(150) for _ in range(2 + k % 39)]
    texts = (texts + [f"alone {i}" for i in range(3000)])[:6000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {n: sharding.assign(docs, shards=8, rounds=n).collect() for n in (0, 1, 2)}
    for rows in got.values():
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and len({(r.shard, r.slot) for r in rows}) == len(texts)
    # Without rounds linked documents lie apart; with them only the text larger than a shard is cut.
    assert _groups_cut(got[0], texts) > 100 and _groups_cut(got[1], texts) == _groups_cut(got[2], texts) == 1
    place = {n: {r.doc_id: r.shard for r in rows} for n, rows in got.items()}
    linked = [i for i, t in enumerate(texts) if not t.startswith("alone")]
    assert all(sum(place[a][i] != place[b][i] for i in linked) > 0 for a, b in ((0, 1), (0, 2), (1, 2)))


def test_rounds_unite_units_before_any_mending(spark):
    nodes = [(k, 0, (7 * k + 5 * i) % 8, (7 * k + 5 * i) % 8, 1 + (i == 0)) for k in range(400) for i in range(3)]
    frame = spark.createDataFrame(nodes, "key long, part int, start int, label int, n long")
    cut = []
    for n in (0, 1, 2):
        held = {}
        for r in sharding.propagate(frame, 8, 220, n).collect():
            held.setdefault(r.key, set()).add(r.label)
        cut.append(sum(len(s) > 1 for s in held.values()))
    assert cut[0] == 400 and cut[1] < 200 and cut[2] <= cut[1]


def test_toxicity_scores_scattered_dense_words(spark):
    voters, weights = ["zork@"], toxicity.np.array([1.0, 6.0, 4.0, 0.5, -3.0])
    text = " ".join("zork" if i % 125 == 0 else "plain" for i in range(2000))
    hits, hit_words, words = toxicity.Votes(voters).of(text)
    assert hits == [] and hit_words == 16
    logit = toxicity.features(hits, hit_words, words, 1) @ weights[:-1] + weights[-1]
    docs = spark.createDataFrame([(1, text), (2, "plain " * 2000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, (voters, weights)).collect()}
    assert got[1] == pytest.approx(1 / (1 + toxicity.np.exp(-logit))) and got[1] > 0.5 > got[2]
    assert [r.doc_id for r in toxicity.keep_clean(docs, (voters, weights), threshold=0.5).collect()] == [2]
