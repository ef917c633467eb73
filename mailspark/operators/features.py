"""Text features in long format (id, term, weight): no row ever holds the vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.functions.text import anchor_words, ngrams, strip, tokens
from mailspark.sources.shared import saved


def term_counts(docs: DataFrame, n: int, id_col: str = "id", text_col: str = "text", words: Callable[[Column], Column] = tokens) -> DataFrame:
    words = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    return words.select("id", F.explode(ngrams("words", n)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))


def tfidf_fit(counts: DataFrame, n_docs: int, min_df: int = 2, max_df_ratio: float = 0.85, max_features: int = 5000) -> DataFrame:
    """(term, df, idf): smoothed inverse document frequency of the kept terms."""
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df_ratio * n_docs))
    top = df.orderBy(F.desc("df"), "term").limit(max_features)
    return top.select("term", "df", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_transform(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, term, w): (1 + ln c) * idf, each document's weights of norm 1.

    The vocabulary may be as large as max_features lets it: Spark broadcasts it only if its measured size is under
    the session's threshold, else it is shuffled by term.
    """
    raw = counts.join(vocabulary.select("term", "idf"), "term").select("id", "term", ((1 + F.log("c")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


#: For each kind of lure the least similarity that counts, the signal, and its weight as a factor of the similarity with least and largest (hundredths).
LURES = [
    ("urgency", 0.08, "nlp.urgency", 350, 40, 180), ("credential", 0.08, "nlp.credential_lure", 380, 50, 190), ("financial", 0.08, "nlp.payment_diversion", 380, 50, 190),
    ("authority", 0.08, "nlp.authority_pressure", 350, 50, 180), ("secrecy", 0.08, "nlp.secrecy", 350, 50, 175), ("malware", 0.12, "nlp.malware_lure", 380, 60, 190),
]


def _anchor_terms(docs: DataFrame) -> DataFrame:
    words = docs.select("id", anchor_words(F.col("text")).alias("words"))
    return words.select("id", F.explode(ngrams("words", 2)).alias("term"))


def anchor_vectors(spark: SparkSession, anchors: dict[str, str]) -> DataFrame:
    """(term, idf, one weight for each anchor): 1- and 2-gram TF-IDF fitted on the anchors themselves, of norm 1.

    As many rows as a handful of fixed texts has terms.
    """
    texts = spark.createDataFrame(list(anchors.items()), "id string, text string")
    counts = _anchor_terms(texts).groupBy("id", "term").agg(F.count("*").alias("c"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.join(df, "term").withColumn("idf", F.log((1.0 + len(anchors)) / (1 + F.col("df"))) + 1).withColumn("w", (1 + F.log("c")) * F.col("idf"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    each = raw.join(norm, "id").withColumn("w", F.col("w") / F.col("norm"))
    return each.groupBy("term").agg(F.first("idf").alias("idf"), *[F.sum(F.when(F.col("id") == a, F.col("w")).otherwise(0.0)).alias(a) for a in anchors])


def anchor_similarity(docs: DataFrame, anchors: dict[str, str]) -> DataFrame:
    """docs (id, text) -> (id, a similarity for each anchor): cosines, a text's norm taken over the anchors' terms.

    Only words of the anchors leave the first join; ids without one have no row.
    """
    vectors = saved(anchor_vectors(docs.sparkSession, anchors), "anchors")
    # Both words of a pair are terms themselves, so only words that are terms are looked at.
    known = F.broadcast(vectors.where(~F.col("term").contains(" ")).select(F.col("term").alias("word")))
    words = docs.where(F.length(strip(F.col("text"))) >= 5).select("id", F.posexplode(anchor_words(F.col("text"))).alias("at", "word")).join(known, "word", "left_semi")
    after = F.lead(F.struct("at", "word")).over(W.partitionBy("id").orderBy("at"))
    paired = words.select("id", "at", "word", after.alias("next"))
    terms = paired.select("id", F.explode(F.array_compact(F.array("word", F.when(F.col("next.at") == F.col("at") + 1, F.concat_ws(" ", "word", "next.word"))))).alias("term"))
    counted = terms.join(F.broadcast(vectors), "term").groupBy("id", "term").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("idf", *anchors)])
    d = (1 + F.log("c")) * F.col("idf")
    sums = counted.groupBy("id").agg(F.sqrt(F.sum(d * d)).alias("norm"), *[F.sum(d * F.col(a)).alias(a) for a in anchors])
    return sums.select("id", *[F.round(F.col(a) / F.col("norm"), 6).alias(a) for a in anchors])


def lure_weight(similarity: Column, factor: int, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(similarity * factor + 0.5))).cast("int")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9\\s'\\-]", " "), "\\s+"), "")


def bigrams(docs: DataFrame) -> DataFrame:
    """(id, w1, w2) of every pair of neighbouring words."""
    words = docs.select("id", words_of(F.col("text")).alias("w")).where("size(w) > 1")
    return words.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("w1"), F.element_at("w", i + 1).alias("w2")))).alias("b")).select("id", "b.w1", "b.w2")


def lm_fit(docs: DataFrame, vocabulary: int = 800) -> DataFrame:
    """(w1, w2, logp): smoothed bigram model."""
    pairs = bigrams(docs)
    uni = docs.select(F.explode(words_of(F.col("text"))).alias("w1")).groupBy("w1").agg(F.count("*").alias("u"))
    both = pairs.groupBy("w1", "w2").agg(F.count("*").alias("c")).join(uni, "w1")
    return both.select("w1", "w2", F.round(F.log((F.col("c") + 1) / (F.col("u") + vocabulary)), 5).alias("logp"), "u")


def perplexity(docs: DataFrame, lm: DataFrame, vocabulary: int = 800) -> DataFrame:
    """(id, perplexity): exp of the mean negative log-probability; 999 under three words."""
    uni = lm.select("w1", "u").distinct()
    counted = bigrams(docs).groupBy("id", "w1", "w2").agg(F.count("*").alias("n"))
    scored = counted.join(lm.select("w1", "w2", "logp"), ["w1", "w2"], "left").join(uni, "w1", "left")
    logp = F.coalesce("logp", F.log(1 / (F.coalesce("u", F.lit(0)) + vocabulary)))
    mean = scored.groupBy("id").agg((F.sum(F.col("n") * logp) / F.sum("n")).alias("m"), F.sum("n").alias("pairs"))
    return docs.select("id").join(mean, "id", "left").select("id", F.when(F.col("pairs") >= 2, F.round(F.exp(-F.col("m")), 2)).otherwise(999.0).alias("perplexity"))


def burstiness(docs: DataFrame) -> DataFrame:
    """(id, burstiness): (sd - mean) / (sd + mean) of words per sentence; 0 under two sentences."""
    marked = F.regexp_replace(F.regexp_replace("text", r"([.!?])\s+([A-Z])", "$1\n$2"), r"\n+", "\n")
    lengths = F.filter(F.transform(F.split(marked, "\n"), lambda s: F.size(F.array_remove(F.split(s, "\\s+"), ""))), lambda n: n >= 2)
    each = docs.select("id", F.explode_outer(lengths).alias("n"))
    stats = each.groupBy("id").agg(F.count("n").alias("k"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    return stats.select("id", F.when(F.col("k") < 2, 0.0).otherwise(F.round((F.col("sd") - F.col("mean")) / (F.col("sd") + F.col("mean")), 4)).alias("burstiness"))


#: Texts of fewer characters aren't judged, and the score they get.
SHORT_TEXT, SHORT_SCORE = 20, 0.05


def ai_score(perplexity_: Column, burstiness_: Column, phrases: Column) -> Column:
    sigmoid = lambda x: 1 / (1 + F.exp(x))
    p, b = sigmoid((perplexity_ - 520) / 104), sigmoid((burstiness_ + 0.2) * 10)
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.round(0.45 * p + 0.35 * b + 0.20 * F.least(F.lit(1.0), phrases * 0.25), 4)))


def feature_means(vectors: DataFrame, n_docs: int) -> DataFrame:
    """Mean of each feature over all documents (absent counts as 0)."""
    return vectors.groupBy("term").agg((F.sum("w") / n_docs).alias("mean"))


def top_features(vectors: DataFrame, weights: DataFrame, means: DataFrame, k: int = 10) -> DataFrame:
    """Per document the ``k`` present features with the largest contribution w * (x - mean)."""
    phi = vectors.withColumnRenamed("w", "x").join(weights, "term").join(means, "term").select("id", "term", "x", F.round(F.col("weight") * (F.col("x") - F.col("mean")), 6).alias("phi"))
    return phi.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.abs("phi")), "term"))).where(F.col("nth") <= k).select("id", "nth", "term", "phi")
