"""Training, calibration and evaluation against plain Python on the same rows."""

from collections import Counter, defaultdict

import pytest

from mailspark.operators import corpus, models
from mailspark.plans import message_queries as q
from mailspark.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    words = {0: "meeting agenda lunch team notes", 1: "urgent invoice payment transfer wire", 2: "password login verify account secure"}
    rows = [(i, i % 3, " ".join(words[i % 3].split()[(i // 3 + k) % 5] for k in range(4)) + f" row{i}") for i in range(90)]
    return spark.createDataFrame([(i, float(y), t, f"{i % 16:x}{i % 7:x}{i:04x}") for i, y, t in rows], "id long, label double, text string, o string")


def test_vectors_hold_tfidf_and_structural_features(labelled):
    vectors = models.vectorised(labelled, max_features=50)
    rows = vectors.collect()
    assert len(rows) == 90 and {r.features.size for r in rows} == {50 + 21}
    for r in rows:  # the terms' part has norm 1
        assert sum(v * v for i, v in zip(r.features.indices, r.features.values, strict=True) if i < 50) == pytest.approx(1.0)


def test_training_separates_the_classes(labelled):
    vectors = models.vectorised(labelled, max_features=50)
    folds = corpus.folds(labelled, "label", "o", 3)
    scored = models.out_of_fold(vectors, folds, 3, c=1.0, iterations=10)
    got = scored.collect()
    assert sorted(r.id for r in got) == list(range(90)) and sum(r.prediction == r.label for r in got) >= 85
    calibrated = models.calibrate(models.saved(scored, "scored"), 3).collect()
    assert len(calibrated) == 90 and all(sum((r.c0, r.c1, r.c2)) == pytest.approx(1.0) for r in calibrated)
    best = Counter(max(range(3), key=lambda k: (r.c0, r.c1, r.c2)[k]) == r.label for r in calibrated)
    assert best[True] >= 85


def test_calibration_is_isotonic(spark):
    # Scores that overstate: of the rows with 0.9 only half are positive.
    rows = [(i, float(i % 2), [0.1, 0.9]) for i in range(20)] + [(20 + i, 0.0, [0.8, 0.2]) for i in range(20)]
    scored = spark.createDataFrame(rows, "id long, label double, p array<double>")
    got = {r.id: r.c1 for r in models.calibrate(scored, 2).collect()}
    assert all(got[i] == pytest.approx(0.5) for i in range(20)) and all(got[i] == pytest.approx(0.0) for i in range(20, 40))


def test_metrics_of_a_class_that_never_occurs(spark):
    rows = spark.createDataFrame([(0, 0)] * 3 + [(0, 5), (1, 0)], "label int, prediction int")
    got = {r.name: (r.precision, r.recall, r.f1, r.support) for r in models.metrics(rows).collect()}
    assert got["5"] == (0.0, 0.0, 0.0, 0) and got["1"][:3] == (0.0, 0.0, 0.0) and got["0"] == (0.75, 0.75, 0.75, 4)
    assert got["accuracy"][0] == 0.6 and got["macro avg"][2] == 0.25 and got["weighted avg"][2] == 0.6


def test_auc_with_ties_and_one_sided_classes(spark):
    scores = [(0, (i * 7919) % 1000 / 10, i % 3 == 0) for i in range(3000)] + [(1, 0.5, True), (1, 0.5, False), (2, 1.0, True)]
    got = {r["class"]: r.auc for r in models.auc(spark.createDataFrame(scores, "class int, score double, positive boolean"), ranges=8).collect()}
    pos = [s for c, s, p in scores if c == 0 and p]
    below, equal = Counter(), Counter(s for c, s, p in scores if c == 0 and not p)
    values = sorted(equal)
    seen = 0
    for v in values:
        below[v] = seen
        seen += equal[v]
    order = sorted(set(values) | set(pos))
    running, before = 0, {}
    for v in order:
        before[v] = running
        running += equal[v]
    want = sum(before[s] + equal[s] / 2 for s in pos) / (len(pos) * sum(equal.values()))
    assert got[0] == pytest.approx(want) and got[1] == 0.5 and got[2] is None


def test_spear_override(spark):
    text = "As discussed with the team, please find attached the shared document and verify your account"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "lunch?")], "id long, text string")
    predicted = spark.createDataFrame([(1, 0, 0.9, 0.02), (2, 3, 0.1, 0.1), (3, 0, 0.97, 0.01)], "id long, prediction int, p_benign double, p_phishing double")
    got = {r.id: (r.prediction, r.raised, round(r.p_malicious, 4)) for r in models.spear_override(predicted, docs).collect()}
    assert got == {1: (2, True, 0.9), 2: (3, False, 0.9), 3: (0, False, 0.03)}


def test_registered_training_queries(spark):
    labels = {r.id: r.label for r in q._labelled(spark, FOLDER).collect()}
    confusion = registry.queries()["train_logreg"](spark, FOLDER).collect()
    sizes = Counter(labels.values())
    assert sum(r.n for r in confusion) == sum(n - int(n * 0.8) for n in sizes.values())
    calibrated = registry.queries()["calibrate_isotonic"](spark, FOLDER).collect()
    assert {r.id for r in calibrated} == set(labels)
    folds = defaultdict(dict)
    for r in registry.queries()["cross_validate"](spark, FOLDER).collect():
        folds[r.fold][r.measure] = r
        assert 0 <= r.val <= 1 and r.gap == pytest.approx(r.train - r.val, abs=1e-5)
    assert set(folds) == set(range(5)) and all(set(f) == {"accuracy", "macro_f1"} for f in folds.values())


def test_classes_with_equal_products(spark):
    """0.3 and 0.1 + 0.2 are one product whatever the order of the sum: the first class counts."""
    vectors = spark.createDataFrame([(i, t, 1.0) for i in range(8) for t in ("s", "t")], "id long, term string, w double").repartition(4)
    weights = spark.createDataFrame([("s", 0, 0.3), ("t", 0, 0.0), ("s", 2, 0.1), ("t", 2, 0.2), ("s", 1, -1.0), ("t", 1, 0.0)], "term string, class int, weight double")
    got = models.batch_predict(vectors, weights).collect()
    assert [r.prediction for r in got] == [0] * 8 and {round(r.p_benign - r.p_phishing, 9) for r in got} == {0.0}
