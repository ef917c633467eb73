"""The thin ``opN_`` queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm import conversation_repair, decontaminate, exact_dedup, html_extract, language_id, line_dedup, minhash_dedup, sentencepiece_codec, sharding, substring_dedup, token_alignment, toxicity, url_filter
from mailspark.llm.storage import table


def id_fold(folds: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple:
    """Learned only from rows whose fold (of three) isn't 1."""
    return toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"), learn=id_fold(3) != 1))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxic_model(spark, docs, sf_dir))
    return scored.select("doc_id", (id_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(table(spark, sf_dir, "documents"), min_texts=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + (s["stop"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.predict(table(spark, sf_dir, "documents"), learn=id_fold(5) != 0)
    return found.select("doc_id", (id_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.annotate(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def piece_model() -> str:
    """The public vocabulary file of the contract."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), piece_model(), columns=["doc_id"])
    return coded.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_decoded", 256).alias("decoded_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), piece_model(), columns=["doc_id"], written=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_sharding, op4_toxicity, op5_decontaminate, op6_suffix_dedup, op7_language_id, op8_exact_dedup, op9_minhash_dedup, op10_sentencepiece, op11_alignment, op12_html_extraction, op13_conversation_repair)}
