"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of an item (a shorter item is one
window).  Containment of a whole window needs every word of it, so of its
words, ordered by rarity over all documents, the single rarest is a necessary
prefix.  Documents' word positions are joined with these prefix words; the
position bounds (the window must fit into the document around that word) and
the exact words of the window decide.  Covered words are counted as the union
of the matched intervals.

The benchmark is broadcast in blocks of ``block_items`` items with
``block_words`` words at most, so each broadcast has a fixed bound, whatever
the benchmark's size; documents are never shuffled, only counts and matches.

Defined results: words are runs of digits, a-z (A-Z lower-cased) and
characters above ASCII; a null or empty text has no words; a null item or one
without words has no windows; equal windows of several items count for each;
rows that repeat id and text are judged alike and stay repeated; null ids are
ids like others; texts may be of any length; an empty table on either side
works; other columns, whatever their names, are ignored
(``drop_contaminated`` carries them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import fresh

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "\x00"  # no word holds it: the entry that each document has once


def ascii_lower(col: Column) -> Column:
    """A-Z only.  The built-in lower() does the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, words, size): each item's distinct windows."""
    cut = items.select("item", F.transform(raw_words(F.col("text")), ascii_lower).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    return cut.select("item", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("all", i, window)))).alias("words")).select("item", "words", F.size("words").alias("size"))


def _rarity(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often each word of the windows stands in all documents."""
    wanted = windows.select(F.explode("words").alias("word")).distinct()
    words = docs.select(F.explode(raw_words(F.col("text"))).alias("raw")).select(ascii_lower(F.col("raw")).alias("word"))
    seen = words.join(F.broadcast(wanted), "word").groupBy("word").agg(F.count("*").alias("n"))
    return wanted.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def _matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, text_key, n_words, start, size, items): one row for each document (start null) and each matched window.

    The join's condition compares the words themselves, so only true matches leave it, without the document's words.
    """
    one = windows.groupBy("words", "size").agg(F.collect_set("item").alias("items"))
    placed = one.select("words", "size", "items", F.posexplode("words").alias("offset", "word"))
    rarest = (
        placed.join(F.broadcast(_rarity(docs, windows)), "word")
        .groupBy("words", "size", "items").agg(F.min(F.struct("n", "word", "offset")).alias("first"))
        .select(F.col("first.word").alias("word"), F.col("first.offset").alias("offset"), "size", F.array_join("words", " ").alias("window"), "items")
    )
    mark = rarest.sparkSession.range(1).select(F.lit(MARK).alias("word"), F.lit(0).alias("offset"), F.lit(0).alias("size"), F.lit("").alias("window"), F.lit(None).cast(rarest.schema["items"].dataType).alias("items"))
    words = docs.select("id", "text_key", raw_words(F.col("text")).alias("words"))
    placed_docs = words.select("id", "text_key", "words", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(MARK)), "words")).alias("at", "raw"))
    positions = placed_docs.select("*", ascii_lower(F.col("raw")).alias("first_word"))
    start = F.col("at") - F.col("offset")  # 1-based: ``at`` counts the mark as 0
    fits = (start >= 1) & (start + F.col("size") <= F.col("n_words") + 1)
    same = ascii_lower(F.array_join(F.slice("words", F.greatest(start, F.lit(1)), F.col("size")), " ")) == F.col("window")
    found = positions.join(F.broadcast(rarest.unionByName(mark)), (F.col("first_word") == F.col("word")) & ((F.col("at") == 0) | (fits & same)))
    return found.select("id", "text_key", "n_words", F.when(F.col("at") > 0, start).alias("start"), "size", "items")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = 2_000, block_words: int = 400_000) -> DataFrame:
    """Per row of ``docs``: id, text_key, n_words, n_hit, items (array of item ids with occurring windows)."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), text_key(text).alias("text_key"))
    windows = item_windows(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), window)
    blocks = _blocks(windows, block_items, block_words)
    found = reduce(DataFrame.unionByName, [_matches(rows, b).withColumn("block", F.lit(i)) for i, b in enumerate(blocks)])
    spans = F.array_sort("spans")
    zero = F.named_struct(F.lit("stop"), F.lit(0), F.lit("n"), F.lit(0))
    step = lambda acc, s: F.named_struct(F.lit("stop"), F.greatest(acc["stop"], s["stop"]), F.lit("n"), acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["stop"], s["start"])))
    mark = F.col("start").isNull()
    per_doc = found.groupBy("id", "text_key").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count_if(mark & (F.col("block") == 0)).cast("int").alias("copies"),
        F.collect_set(F.when(~mark, F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("spans"),
        F.collect_set("items").alias("items"),
    )
    return per_doc.select(
        F.col("id").alias(id_col), "text_key", "n_words", F.aggregate(spans, zero, step, lambda acc: acc["n"]).cast("bigint").alias("n_hit"),
        F.array_distinct(F.flatten("items")).alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def _blocks(windows: DataFrame, block_items: int, block_words: int) -> list[DataFrame]:
    """Parts of the windows whose broadcasts stay within the bounds: one, unless the benchmark is large."""
    items, words = windows.agg(F.count_distinct("item"), F.sum("size")).collect()[0]
    n = max(-(-(items or 0) // block_items), -(-(words or 0) // block_words), 1)
    return [windows] if n == 1 else [windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == i) for i in range(n)]


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that aren't contaminated, with all their columns."""
    bad_id, bad_key = fresh(docs.columns, "bad_id", "bad_key")
    bad = contamination(docs, items, id_col=id_col, text_col=text_col).where(is_contaminated()).select(F.col(id_col).alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(bad_id)) & (text_key(docs[text_col]) == F.col(bad_key)), "left_anti")
