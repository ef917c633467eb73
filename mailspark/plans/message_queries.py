"""Registered queries over messages, URLs, texts and the training corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.functions import headers, network, privacy, text, urls
from mailspark.operators import corpus, features, leakage, models, scoring, signals
from mailspark.plans.adapters import given, view

NOW_S = 1_041_379_200


def _join(col: Column) -> Column:
    return F.array_join(col, ";")


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", F.sha2("body", 256).alias("sha256"))


def address_split(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mail").select("msg_id", F.regexp_extract("body", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0).alias("address"))
    return m.select("msg_id", headers.address_domain(F.col("address")).alias("domain"))


def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_urls").select("page_id", urls.registrable(urls.host(urls.normalise(F.col("url")))).alias("registrable"))


def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    u = urls.normalise(F.col("url"))
    return view(spark, d, "v_urls").select("page_id", u.alias("normalised"), urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"))


def url_extract(spark: SparkSession, d: str) -> DataFrame:
    """Links first, with the text they show, then URLs of the stripped text that no link has; each once, with where it was seen."""
    h = view(spark, d, "v_html")
    links = h.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(urls.ANCHOR), 0)).alias("at", "whole"))
    part = lambda k: F.regexp_extract("whole", urls.ANCHOR, k)
    href = F.when(part(1) != "", part(1)).when(part(2) != "", part(2)).otherwise(part(3))
    anchors = links.select("page_id", text.unescape(href).alias("url"), text.strip(text.strip_html(part(4))).alias("anchor"), F.lit(0).alias("kind"), "at")
    plain = h.select("page_id", F.posexplode(F.regexp_extract_all(text.strip_html(F.col("html")), F.lit(urls.LINK), 0)).alias("at", "url")).select("page_id", "url", F.lit("").alias("anchor"), F.lit(1).alias("kind"), "at")
    rows = anchors.unionByName(plain).withColumn("url", urls.normalise(F.col("url"))).where(~F.lower("url").rlike("^(?:" + "|".join(urls.SKIPPED_SCHEMES) + ")") & (urls.host(F.col("url")) != ""))
    first = rows.groupBy("page_id", "url", "anchor").agg(F.min(F.struct("kind", "at")).alias("f"))
    # A URL of the text is left out where a link has it.
    linked = first.groupBy("page_id", "url").agg(F.min("f.kind").alias("least"))
    kept = first.join(linked, ["page_id", "url"]).where(F.col("f.kind") == F.col("least"))
    return kept.select("page_id", "url", F.substring("anchor", 1, 200).alias("anchor"), F.when(F.col("f.kind") == 0, "anchor").otherwise("body_html").alias("location"), F.col("f.at").alias("position"))


def url_flags(spark: SparkSession, d: str) -> DataFrame:
    u = urls.normalise(F.col("url"))
    return view(spark, d, "v_urls").select("page_id", *[c.alias(n) for n, c in urls.flags(u).items()], _join(urls.reasons(u)).alias("reasons"))


def url_static_verdict(spark: SparkSession, d: str) -> DataFrame:
    u = urls.static_analysis(view(spark, d, "v_urls").select("page_id", urls.normalise(F.col("url")).alias("url")), "url")
    return u.select("page_id", _join(F.col("indicators")).alias("indicators"), "brand", "verdict")


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_html").select("page_id", F.sha2(text.squeeze(text.strip_html(F.col("html"))), 256).alias("text_sha256"))


def attachment_flags(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", *[c.alias(n) for n, c in headers.attachment(F.col("attachment"), F.col("first_bytes")).items()])


def auth_results(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", *[c.alias(n) for n, c in headers.auth(F.col("auth_header"), F.col("from_domain")).items()])


def received_parse(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", *[c.alias(n) for n, c in headers.received(F.col("received_header")).items()])


def subject_shape(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", text.subject_shape(F.col("subject")).alias("shape"))


def campaign_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    domains = F.array(F.concat(F.lit("site"), (F.col("msg_id") % 5).cast("string"), F.lit(".example.com")), F.lit("cdn.example.net"), F.lit("cdn.example.net"))
    digests = F.when(F.col("attachment") != "", F.array(F.sha2("attachment", 256))).otherwise(F.array().cast("array<string>"))
    return view(spark, d, "v_mail").select("msg_id", text.campaign_fingerprint(F.col("from_domain"), F.col("from_name"), F.col("subject"), domains, digests).alias("fingerprint"))


def confusable_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", text.skeleton(F.col("from_name")).alias("skeleton"))


def lookalike_brand(spark: SparkSession, d: str) -> DataFrame:
    """Distance once per distinct label, against a fixed list of names."""
    label = F.substring_index(urls.registrable(urls.host(urls.normalise(F.col("url")))), ".", 1)
    u = view(spark, d, "v_urls").select("page_id", label.alias("raw")).withColumn("label", text.skeleton(F.col("raw")))
    names = F.array(*[F.struct(F.lit(b).alias("brand"), F.lit(max(1, len(b) // 5)).alias("limit")) for b in text.BRANDS])
    first = F.filter(names, lambda n: F.levenshtein(F.col("label"), n["brand"]).between(F.lit(1), n["limit"]))
    near = u.where("label <> ''").select("label").distinct().select("label", F.try_element_at(first, F.lit(1))["brand"].alias("brand"))
    return u.join(near, "label", "left").select("page_id", "label", "brand")


def brand_in_name(spark: SparkSession, d: str) -> DataFrame:
    name, dom = text.skeleton(F.col("from_name")), text.skeleton(urls.registrable(F.col("from_domain")))
    m = view(spark, d, "v_mail").select("msg_id", name.alias("n"), dom.alias("d"))
    hits = F.filter(F.array(*[F.lit(b) for b in text.BRANDS]), lambda b: F.col("n").contains(b) & ~F.col("d").contains(b))
    return m.select("msg_id", F.try_element_at(hits, F.lit(1)).alias("brand"))


def ip_class(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    ip = F.concat_ws(".", F.element_at(F.array(*[F.lit(x) for x in ("10.0", "172.20", "192.168", "127.0", "169.254", "100.70", "192.0", "203.0", "8.8", "300.1")]), (k % 10 + 1).cast("int")), F.when(k % 10 == 6, "2").when(k % 10 == 7, "113").otherwise((k % 250).cast("string")), (k % 256).cast("string"))
    return given(spark, d, "supplier").select("s_suppkey", ip.alias("ip"), network.ip_class(ip).alias("class"))


def infra_indicators(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_relays").select("p_partkey", _join(network.infra_indicators(F.col("host"), F.col("ip"), F.col("isp"), F.col("cloud"))).alias("notes"))


def domain_age(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd"]
    raw = F.when(k % 7 == 6, "not a date")
    for i, s in enumerate(shapes):
        raw = raw.when(k % 7 == i, F.date_format(t, s))
    return given(spark, d, "orders").select("o_orderkey", headers.domain_age_days(raw, NOW_S).alias("age_days"))


def pii_inventory(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", *[c.cast("bigint").alias(n) for n, c in privacy.counts(F.col("body")).items()])


def pii_mask(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", F.sha2(privacy.mask_fixed(F.col("body")), 256).alias("masked_sha256"))


def pii_mask_full(spark: SparkSession, d: str) -> DataFrame:
    masked = privacy.mask_full(F.col("body"))
    return view(spark, d, "v_mail").select("msg_id", F.sha2(masked, 256).alias("masked_sha256"))


def pii_leak_scan(spark: SparkSession, d: str) -> DataFrame:
    """What the fixed masks leave, and what is left once all masks are on."""
    m = view(spark, d, "v_mail").select("msg_id", privacy.mask_fixed(F.col("body")).alias("some"))
    return m.select("msg_id", _join(privacy.leaks(F.col("some"))).alias("leaks"))


def pii_leak_scan_full(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that a fully masked text still shows: none, where masks and scan agree."""
    m = view(spark, d, "v_mail").select("msg_id", privacy.mask_full(F.col("body")).alias("all"))
    return m.select("msg_id", _join(privacy.leaks(F.col("all"))).alias("leaks"))


def redact_nested(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mail")
    nested = m.select("msg_id", F.struct(F.col("from_name").alias("display_name"), F.struct(F.col("body").alias("text"), F.sha2("body", 256).alias("digest")).alias("inner"), F.array("subject").alias("lines")).alias("mail"))
    out = privacy.redact_nested(nested, always=("display_name",))
    return out.select("msg_id", F.col("mail.display_name").alias("display_name"), F.sha2("mail.inner.text", 256).alias("text_sha256"), F.col("mail.inner.digest").alias("digest"), F.col("mail.lines")[0].alias("line"))


def text_obfuscation(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "v_html").withColumn("visible", text.squeeze(text.strip_html(F.col("html"))))
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return p.select("page_id", F.round(text.caps_ratio(title), 6).alias("caps_ratio"), F.regexp_count("html", F.lit(text.HIDDEN)).cast("bigint").alias("hidden"), ((F.length("html") > 400) & (F.length("visible") < 40)).alias("image_only"))


def mail_text_normalise(spark: SparkSession, d: str) -> DataFrame:
    p = given(spark, d, "pages")
    body = text.squeeze(F.concat_ws(" ", "url", text.strip_html(F.col("html")), F.concat(F.lit("[Attachment: "), F.col("page_id").cast("string"), F.lit(".pdf]"))))
    return p.select("page_id", body.alias("text")).where("length(text) > 30").select("page_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("chars"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select(F.col("msg_id").alias("id"), F.col("body").alias("text"))


def ngram_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = view(spark, d, "v_mail").select("msg_id", text.tokens(F.col("body")).alias("words"))
    t = words.select("msg_id", text.ngrams("words", 2).alias("t"))
    return t.select("msg_id", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", "|"), 256).alias("tokens_sha256"))


def text_document(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.array("subject", "from_name", "from_domain", "body", "attachment"), lambda x: x != "")
    return view(spark, d, "v_mail").select("msg_id", F.sha2(F.array_join(parts, "\n"), 256).alias("document_sha256"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Parsed messages with their links and files as arrays."""
    lines = lambda c: F.array_remove(F.split(c, "\n"), "")
    left, right = lambda x: F.substring_index(x, "|", 1), lambda x: F.expr("''") if x is None else F.regexp_extract(x, r"\|(.*)$", 1)
    m = view(spark, d, "v_parsed")
    links = F.transform(lines("link_lines"), lambda x: F.struct(left(x).alias("url"), right(x).alias("anchor")))
    files = F.transform(lines("file_lines"), lambda x: F.struct(left(x).alias("name"), right(x).alias("first_bytes")))
    return m.withColumns({"links": links, "files": files}).drop("link_lines", "file_lines")


def meta_features(spark: SparkSession, d: str) -> DataFrame:
    return signals.meta_features(parsed(spark, d))


def structural_features(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").select("msg_id", *[F.round(c, 6).alias(n) for n, c in text.structural(F.col("body")).items()])


def _fitted(spark: SparkSession, d: str, n: int = 1) -> tuple[DataFrame, DataFrame, int]:
    docs = _docs(spark, d)
    counts = features.term_counts(docs, n)
    total = docs.count()
    return counts, features.tfidf_fit(counts, total), total


def tfidf_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, 2)[1].select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_transform(spark: SparkSession, d: str) -> DataFrame:
    counts, vocabulary, _ = _fitted(spark, d)
    return features.tfidf_transform(counts, vocabulary).select("id", "term", F.round("w", 6).alias("w"))


def anchor_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine to the five reference texts, and the weight of the signal where it counts (else null)."""
    near = features.anchor_similarity(_docs(spark, d), text.ANCHORS)
    weights = {kind: F.when(F.col(kind) >= least, features.lure_weight(F.col(kind), *clamp)) for kind, least, _, *clamp in features.LURES if kind in text.ANCHORS}
    return near.select("id", *text.ANCHORS, *[w.alias(f"{kind}_w100") for kind, w in weights.items()])


def _benign(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_mail").where("lang = 'en'").select(F.col("msg_id").alias("id"), F.col("body").alias("text"))


def bigram_lm_fit(spark: SparkSession, d: str) -> DataFrame:
    return features.lm_fit(_benign(spark, d)).select("w1", "w2", "logp")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), "role")


def bigram_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return features.perplexity(_turns(spark, d), features.lm_fit(_benign(spark, d)))


def sentence_burstiness(spark: SparkSession, d: str) -> DataFrame:
    return features.burstiness(_turns(spark, d))


def ai_text_score(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    both = features.perplexity(t, features.lm_fit(_benign(spark, d))).join(features.burstiness(t), "id").join(t.select("id", "text"), "id")
    s = features.ai_score(F.col("perplexity"), F.col("burstiness"), text.how_many(F.col("text"), text.AI_PHRASES))
    s = F.when(F.length(text.strip(F.col("text"))) < features.SHORT_TEXT, features.SHORT_SCORE).otherwise(s)
    return both.select("id", s.alias("score"), F.when(s >= 0.70, "AI_GENERATED").when(s >= 0.45, "LIKELY_AI").otherwise("HUMAN").alias("verdict"))


def spearphish_score(spark: SparkSession, d: str) -> DataFrame:
    points = text.spear_points(F.col("body"), F.col("msg_id") % 3)
    return view(spark, d, "v_mail").select("msg_id", (F.least(points, F.lit(100)) / 100).alias("score"), F.when(points >= text.SPEAR_LIMIT, 2).otherwise(F.col("msg_id") % 3).cast("int").alias("upgraded_class"))


def rule_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.message_signals(parsed(spark, d))


def message_risk(spark: SparkSession, d: str) -> DataFrame:
    """From parsed mail to a score: all checks of a message, combined in log-odds space."""
    found = signals.message_signals(parsed(spark, d))
    rows = found.select(F.col("msg_id").alias("case_id"), "signal_id", "w100", F.lit("heuristic").alias("category"), F.lit(True).alias("triggered"), F.lit(0).alias("pos"))
    return scoring.score(rows).select(F.col("case_id").alias("msg_id"), "risk", "level")


def takedown_draft(spark: SparkSession, d: str) -> DataFrame:
    u = urls.normalise(F.col("url"))
    target = urls.registrable(urls.host(u))
    contact = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("registrar"), (F.col("page_id") % 9).cast("string"), F.lit("@abuse.example"))).otherwise(F.concat(F.lit("abuse@"), target))
    return view(spark, d, "v_urls").select("page_id", target.alias("target"), contact.alias("abuse_contact"), F.format_string("Phishing abuse report - %s - case %d", target, F.col("page_id")).alias("subject"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_messages").where("label is not null").select(F.col("msg_id").alias("id"), F.col("body").alias("text"), "label", F.md5(F.concat(F.lit("s"), F.col("msg_id").cast("string"))).alias("o"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split(_labelled(spark, d), "label", "o")


def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    return corpus.folds(_labelled(spark, d), "label", "o")


def corpus_class_report(spark: SparkSession, d: str) -> DataFrame:
    return corpus.class_report(corpus.split(_labelled(spark, d), "label", "o")).select("label", "split", "n", F.col("level").cast("bigint").alias("level"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and distinct texts, the largest class over the smallest, the number of sources and the share of the largest."""
    m = view(spark, d, "v_mail").select("source", F.length("body").alias("n"), F.sha2("body", 256).alias("h"))
    lengths = m.agg(F.count("*").alias("rows"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_samp("n"), 4).alias("sd"), F.min("n").cast("bigint").alias("least"), F.max("n").cast("bigint").alias("most"), F.count_distinct("h").alias("texts"), F.count_distinct("source").alias("sources"))
    classes = view(spark, d, "v_messages").where("label is not null").groupBy("label").agg(F.count("*").alias("c")).agg(F.round(F.max("c") / F.min("c"), 4).alias("balance"))
    shares = m.groupBy("source").agg(F.count("*").alias("c")).agg(F.round(F.max("c") / F.sum("c"), 6).alias("largest_share"))
    return lengths.join(classes).join(shares)  # one row each


def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mail").select("msg_id", "source")
    named = ("src0", "src1", "src2", "src3", "src4", "src5")
    parts = {k: m.where(F.col("source") == k).select("msg_id") for k in named}
    # Rows of all other sources, nulls included, keep their own tag.
    rest = m.where(~F.coalesce(F.col("source").isin(*named), F.lit(False))).select("msg_id", F.col("source").alias("origin"))
    return corpus.union_sources(parts).unionByName(rest)


def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return corpus.exact_dedupe(view(spark, d, "v_mail").select("msg_id", "source", F.col("body").alias("text")), ["source", "msg_id"]).select("msg_id", "source")


def train_test_leakage(spark: SparkSession, d: str) -> DataFrame:
    m = _docs(spark, d)
    return corpus.leakage(m.where("id % 5 <> 0"), m.where("id % 5 = 0")).select("id")


def train_test_containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents and benchmark items (ids under 0) that stand in other documents, whole or as a part."""
    m = _docs(spark, d).select("id", "text")
    items = given(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    return leakage.contained(m.where("id % 5 <> 0"), m.where("id % 5 = 0").unionByName(items)).select("id")


def _dup_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _labelled(spark, d).select("id", "text", F.col("label").alias("grp"))
    counts = features.term_counts(rows, 1)
    n = rows.count()
    vectors = features.tfidf_transform(counts, features.tfidf_fit(counts, n, min_df=1, max_df_ratio=1.0, max_features=1 << 30))
    return rows.select("id", "grp"), corpus.near_dup_pairs(vectors, rows.select("id", "grp"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _dup_pairs(spark, d)[1].select("a", "b", F.round("cosine", 4).alias("cosine"))


def near_dup_keep(spark: SparkSession, d: str) -> DataFrame:
    ids, pairs = _dup_pairs(spark, d)
    return corpus.greedy_keep(ids.select("id"), pairs)


def _weights(vocabulary: DataFrame) -> DataFrame:
    """Fixed weights of a linear model, made from the terms' digests."""
    return vocabulary.select("term", ((F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int") % 201 - 100) / 50.0).alias("weight"))


def feature_means(spark: SparkSession, d: str) -> DataFrame:
    counts, vocabulary, n = _fitted(spark, d)
    return features.feature_means(features.tfidf_transform(counts, vocabulary), n).select("term", F.round("mean", 6).alias("mean"))


def shap_top_features(spark: SparkSession, d: str) -> DataFrame:
    counts, vocabulary, n = _fitted(spark, d)
    v = features.tfidf_transform(counts, vocabulary)
    top = features.top_features(v, _weights(vocabulary), features.feature_means(v, n))
    return top.select("id", F.col("nth").cast("int").alias("nth"), "term", "phi")


def batch_predict(spark: SparkSession, d: str) -> DataFrame:
    counts, vocabulary, _ = _fitted(spark, d)
    classes = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class")
    w = vocabulary.select("term", classes).select("term", "class", ((F.conv(F.substring(F.md5(F.concat("term", F.col("class").cast("string"))), 1, 4), 16, 10).cast("int") % 201 - 100) / 50.0).alias("weight"))
    out = models.spear_override(models.batch_predict(features.tfidf_transform(counts, vocabulary), w), _docs(spark, d))
    return out.select("id", "prediction", "raised", F.round("p_phishing", 5).alias("p_phishing"), F.round("p_malicious", 5).alias("p_malicious"))


def _rule_predicted(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_messages").where("label is not null").select(F.col("msg_id").alias("id"), F.col("label").cast("int").alias("label"), F.when(F.length("body") > 1500, 1).when(F.col("msg_id") % 4 == 0, 3).otherwise(F.col("msg_id") % 3).cast("int").alias("prediction"))


def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return models.metrics(_rule_predicted(spark, d))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return models.confusion(_rule_predicted(spark, d))


def roc_auc_ovr(spark: SparkSession, d: str) -> DataFrame:
    """One class against the rest, for each class, and their mean."""
    rows = _labelled(spark, d).select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("class"))
    mine = F.col("label") == F.col("class")
    return models.macro_auc(rows.select("class", ((F.col("id") * 37 + F.col("class") * 11) % 100 + mine.cast("int") * 20).alias("score"), mine.alias("positive")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return models.vectorised(_labelled(spark, d).select("id", "label", "text"), max_features=5000)


def train_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of the held-out fifth by a model of the other four."""
    rows = _vectors(spark, d).join(corpus.split(_labelled(spark, d), "label", "o").select("id", "split"), "id")
    model = models.train(rows.where("split = 'train'").drop("split"), iterations=8)
    return models.confusion(models.probabilities(model, rows.where("split = 'test'")).select("label", F.col("prediction").cast("double").alias("prediction")))


def calibrate_isotonic(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    folds = corpus.folds(_labelled(spark, d), "label", "o", 3)
    return models.calibrate(models.saved(models.out_of_fold(rows, folds, 3, c=1.0, iterations=5), "scored"), 4)


def cross_validate(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and macro-F1 on each fold's held-out rows and on its training rows, and the gap of the accuracies."""
    rows = _vectors(spark, d).join(corpus.folds(_labelled(spark, d), "label", "o").select("id", "fold"), "id")
    out = []
    for k in range(5):
        model = models.train(rows.where(F.col("fold") != k).drop("fold"), c=0.5, iterations=5)
        p = models.saved(model.transform(rows).select((F.col("fold") == k).alias("held_out"), "label", "prediction"), "predicted")
        side = lambda held, mark: models.metrics(p.where(F.col("held_out") == held)).where("name in ('accuracy', 'macro avg')").select("name", F.col("f1").alias(mark))
        both = side(True, "val").join(side(False, "train"), "name")
        out.append(both.select(F.lit(k).alias("fold"), F.when(F.col("name") == "accuracy", "accuracy").otherwise("macro_f1").alias("measure"), "train", "val", F.round(F.col("train") - F.col("val"), 6).alias("gap")))
    return reduce(DataFrame.unionByName, out)


NAMES = """content_hash address_split registrable_domain url_normalise url_extract url_flags url_static_verdict html_strip attachment_flags auth_results received_parse subject_shape
campaign_fingerprint confusable_skeleton lookalike_brand brand_in_name ip_class infra_indicators domain_age pii_inventory pii_mask pii_mask_full pii_leak_scan pii_leak_scan_full redact_nested
text_obfuscation mail_text_normalise ngram_tokens text_document meta_features structural_features tfidf_fit tfidf_transform anchor_similarity bigram_lm_fit bigram_perplexity
sentence_burstiness ai_text_score spearphish_score rule_signals message_risk takedown_draft stratified_split stratified_kfold corpus_class_report corpus_stats corpus_union exact_dedupe
train_test_leakage train_test_containment near_dup_pairs near_dup_keep feature_means shap_top_features batch_predict classification_metrics confusion_matrix roc_auc_ovr train_logreg calibrate_isotonic cross_validate""".split()

QUERIES = {name: globals()[name] for name in NAMES}
