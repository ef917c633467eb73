"""Training and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.functions import text
from mailspark.operators import features
from mailspark.sources.shared import saved


def train_words(texts: Column) -> Column:
    """The words that the classifier learns from: two characters or more, a letter first."""
    return F.regexp_extract_all(F.lower(texts), F.lit(r"\b([a-z][a-z0-9_\-\.]+)\b"), 1)


def vectorised(docs: DataFrame, max_features: int = 50_000, n: int = 3) -> DataFrame:
    """docs (id, label, text) -> (id, label, features): TF-IDF of 1- to ``n``-grams, then the structural features.

    Terms are weighted as rows; a document's own terms are put together at the end.
    """
    counts = saved(features.term_counts(docs, n, words=train_words), "counts")
    vocabulary = features.tfidf_fit(counts, docs.count(), max_df_ratio=1.0, max_features=max_features)
    # Places of the kept terms: max_features rows, ranked in one small table.
    places = saved(vocabulary.withColumn("place", F.row_number().over(W.orderBy(F.desc("df"), "term")) - 1), "vocabulary")
    weights = features.tfidf_transform(counts, places).join(F.broadcast(places.select("term", "place")), "term")
    terms = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("terms"))
    names = [name for name, *_ in text.STRUCTURAL]
    own = docs.select("id", "label", F.array(*[c for _, c in text.structural(F.col("text")).items()]).alias("own"))
    size = max_features + len(names)

    @F.udf(VectorUDT(), useArrow=False)
    def vector(found: list, more: list) -> SparseVector:
        pairs = [(x["place"], x["w"]) for x in found or []] + [(max_features + i, v) for i, v in enumerate(more) if v]
        return SparseVector(size, [p for p, _ in pairs], [v for _, v in pairs])

    return saved(own.join(terms, "id", "left").select("id", F.col("label").cast("double").alias("label"), vector("terms", "own").alias("features")), "vectors")


def train(rows: DataFrame, c: float = 2.0, iterations: int = 20):
    """Multinomial logistic regression, balanced class weights, L2 of 1 / (c * n), no standardisation."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n_c"))
    total, classes = counts.agg(F.sum("n_c"), F.count("*")).collect()[0]
    weighted = rows.join(F.broadcast(counts), "label").withColumn("weight", F.lit(total) / (classes * F.col("n_c")))  # one row a class
    lr = LogisticRegression(family="multinomial", weightCol="weight", regParam=1.0 / (c * max(total, 1)), standardization=False, maxIter=iterations)
    return lr.fit(weighted)


def probabilities(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("id", "label", F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("p"))


def out_of_fold(rows: DataFrame, folds: DataFrame, k: int, c: float, iterations: int) -> DataFrame:
    """Each row's probabilities by a model that was trained on the other folds.  folds (id, fold)."""
    parts = rows.join(folds.select("id", "fold"), "id")
    scored = [probabilities(train(parts.where(F.col("fold") != i).drop("fold"), c, iterations), parts.where(F.col("fold") == i)) for i in range(k)]
    return reduce(DataFrame.unionByName, scored)


def calibrate(scored: DataFrame, classes: int) -> DataFrame:
    """Isotonic calibration of out-of-fold probabilities, one class against the rest, renormalised."""
    out = scored
    for k in range(classes):
        data = scored.select("id", (F.col("label") == k).cast("double").alias("y"), F.col("p")[k].alias("x"))
        model = IsotonicRegression(featuresCol="x", labelCol="y", predictionCol=f"c{k}").fit(data)
        out = out.join(model.transform(data).select("id", f"c{k}"), "id")
    total = F.greatest(sum((F.col(f"c{k}") for k in range(classes)), F.lit(0.0)), F.lit(1e-9))
    return out.select("id", "label", *[(F.col(f"c{k}") / total).alias(f"c{k}") for k in range(classes)])


def confusion(rows: DataFrame) -> DataFrame:
    """(label, prediction) counts."""
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def metrics(rows: DataFrame) -> DataFrame:
    """(name, precision, recall, f1, support) of every class, then of accuracy, macro and weighted means, from one count table."""
    c = confusion(rows)
    each = (
        c.select(F.col("label").alias("class"), F.col("n").alias("support"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("predicted"))
        .unionByName(c.select(F.col("prediction").alias("class"), F.lit(0).alias("support"), F.lit(0).alias("tp"), F.col("n").alias("predicted")))
        .groupBy("class").agg(*[F.sum(x).alias(x) for x in ("support", "tp", "predicted")])
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    scored = each.select(F.col("class").cast("string").alias("name"), ratio(tp, predicted).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, predicted + support).alias("f1"), "support", "tp")
    measures = ("precision", "recall", "f1")
    mean = scored.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")).withColumn("name", F.lit("macro avg"))
    weighted = scored.agg(*[(F.sum(F.col(m) * support) / F.sum("support")).alias(m) for m in measures], F.sum("support").alias("support")).withColumn("name", F.lit("weighted avg"))
    accuracy = scored.agg((F.sum("tp") / F.sum("support")).alias("a"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("name"), *[F.col("a").alias(m) for m in measures], "support")
    return reduce(DataFrame.unionByName, [scored.drop("tp"), mean, weighted, accuracy]).select("name", *[F.round(m, 6).alias(m) for m in measures], "support")


def auc(scores: DataFrame, ranges: int = 64) -> DataFrame:
    """scores (class, score, positive) -> (class, auc): area under the ROC curve with ties; null for a class with one kind of rows.

    Equal scores are summed first; the running sum is taken within ranges of scores (cut at sampled quantiles) and
    shifted by the sums of the ranges before, a table of ``ranges`` rows a class.
    """
    by = saved(scores.groupBy("class", "score").agg(F.sum(F.col("positive").cast("int")).alias("pos"), F.sum((~F.col("positive")).cast("int")).alias("neg")), "scores")
    cuts = F.broadcast(by.groupBy("class").agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 1000).alias("cuts")))
    cut = by.join(cuts, "class").select("class", "score", "pos", "neg", F.size(F.filter("cuts", lambda q: q < F.col("score"))).alias("r"))
    sums = cut.groupBy("class", "r").agg(F.sum("neg").alias("n"))
    before = sums.select("class", "r", (F.sum("n").over(W.partitionBy("class").orderBy("r")) - F.col("n")).alias("before"))
    below = F.col("before") + F.sum("neg").over(W.partitionBy("class", "r").orderBy("score")) - F.col("neg")
    each = cut.join(F.broadcast(before), ["class", "r"]).select("class", "pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("wins"))
    return each.groupBy("class").agg(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auc"))


def macro_auc(scores: DataFrame) -> DataFrame:
    """Per class, and the mean over the classes that have both kinds of rows."""
    each = auc(scores).select(F.col("class").cast("string").alias("name"), "auc")
    return each.unionByName(each.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("name"), "auc")).select("name", F.round("auc", 6).alias("auc"))


def batch_predict(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, prediction, p_benign, p_phishing): softmax of sparse dot products, a join and two aggregations.  weights (term, class, weight).

    Of classes with equal products the first counts, as numpy's argmax has it; products are compared to nine decimals, so
    that the order in which a sum was taken decides nothing.
    """
    logits = vectors.join(weights, "term").groupBy("id", "class").agg(F.sum(F.col("w") * F.col("weight")).alias("z"))
    top = logits.groupBy("id").agg(F.max("z").alias("m"))
    e = logits.join(top, "id").withColumn("e", F.exp(F.col("z") - F.col("m")))
    of = lambda k: F.coalesce(F.max(F.when(F.col("class") == k, F.col("e"))), F.lit(0.0)) / F.sum("e")
    return e.groupBy("id").agg(F.max_by("class", F.struct(F.round("z", 9), -F.col("class"))).alias("prediction"), of(0).alias("p_benign"), of(2).alias("p_phishing"))


#: The class that spear phishing is raised to, and the least malicious probability then.
SPEAR_CLASS, SPEAR_LEAST = 2, 0.85


def spear_override(predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """Predictions of harmless classes are raised where the text (docs: id, text) shows spear phishing."""
    both = predicted.join(docs.select("id", "text"), "id")
    both = both.select("id", "prediction", "p_benign", "p_phishing", text.spear_points(F.col("text"), F.col("prediction")).alias("points"))
    found, score = F.col("points") >= text.SPEAR_LIMIT, F.least(F.col("points"), F.lit(100)) / 100
    benign = F.when(found, F.least("p_benign", F.round(1 - score, 4))).otherwise(F.col("p_benign"))
    malicious = F.when(found, F.greatest(1 - benign, F.lit(SPEAR_LEAST))).otherwise(1 - benign)
    return both.select("id", F.when(found, SPEAR_CLASS).otherwise(F.col("prediction")).cast("int").alias("prediction"), found.alias("raised"), F.when(found, F.greatest("p_phishing", score)).otherwise(F.col("p_phishing")).alias("p_phishing"), malicious.alias("p_malicious"))
