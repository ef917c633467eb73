"""Line dedup by log templates.

A line's leaf in the fixed-depth tree is its number of tokens and its leading
tokens, tokens with digits being wildcards.  Leaves of fewer than ``min_texts``
texts cannot hold a recurring template and are dropped at once, from counts
alone.  Within a leaf a position keeps its token if at least ``min_texts``
occurrences share it and becomes a wildcard otherwise: what is left is the
line's template.  Templates with enough fixed tokens that stand in at least
``min_texts`` different texts are recurring, and all their lines are dropped.

Documents with equal texts count as one.  All steps are aggregations with
partial sums or joins on keys whose repeated values were merged before.

Defined results: lines end at a line feed; lines of white space only are kept
and not counted; a null text has no lines and stays null; rows with equal
texts are treated alike and stay repeated; null ids are ids like others; texts
and lines may be of any length; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import stash

GAP, WILDCARD = "[ \\t\\r\\f]+", "<*>"


def masked(line: Column) -> Column:
    """Tokens with digits become wildcards (the expression runs only where there are digits)."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ \\t\\r\\f]*[0-9][^ \\t\\r\\f]*", WILDCARD)).otherwise(line)


def _lines(docs: DataFrame, leading: int) -> DataFrame:
    """(text_key, at, line, leaf) of all lines with tokens."""
    each = docs.select("text_key", F.posexplode(F.split("text", "\n")).alias("at", "raw")).where(F.col("raw").rlike("[^ \\t\\r\\f]"))
    cut = each.select("text_key", "at", masked(F.col("raw")).alias("line")).withColumn("tokens", F.array_remove(F.split("line", GAP), ""))
    return cut.select("text_key", "at", F.array_join("tokens", " ").alias("line"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, leading)).alias("leaf"))


def drop_recurring(docs: DataFrame, min_texts: int = 10, leading: int = 4, min_fixed: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_dropped, text (what is left)."""
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text_key"), F.col(text_col).alias("text"))
    lines = _lines(rows, leading)
    # Counts that are joined again are written first: such joins are of plain shuffles, which Spark splits where a leaf or a text is hot.
    leaves = stash(lines.select("text_key", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select("leaf"), "leaves")
    found = stash(lines.join(leaves, "leaf", "left_semi"), "lines")
    distinct = found.select("leaf", "line", "text_key").distinct().groupBy("leaf", "line").agg(F.count("*").alias("texts"))
    tokens = distinct.select("leaf", "line", "texts", F.posexplode(F.split("line", " ")).alias("at", "token"))
    fixed = tokens.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("n")).where((F.col("n") >= min_texts) & (F.col("token") != WILDCARD)).select("leaf", "at", "token", F.lit(1).alias("fixed"))
    general = tokens.join(fixed, ["leaf", "at", "token"], "left").groupBy("leaf", "line").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed") == 1, F.col("token")).otherwise(F.lit(WILDCARD)).alias("token")))).alias("parts"), F.count("fixed").alias("fixed"), F.count("*").alias("n")
    )
    templates = stash(general.where(F.col("fixed") >= min_fixed * F.col("n")).select("leaf", "line", F.array_join(F.transform("parts", lambda p: p["token"]), " ").alias("template")), "templates")
    named = found.join(templates, ["leaf", "line"])
    recurring = named.select("template", "text_key").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select("template")
    drops = stash(found.join(templates.join(recurring, "template", "left_semi"), ["leaf", "line"]).groupBy("text_key").agg(F.collect_set("at").alias("drops")), "drops")
    joined = rows.join(drops, "text_key", "left").withColumn("lines", F.split("text", "\n"))
    kept = F.filter("lines", lambda _, i: ~F.array_contains("drops", i))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(F.size(F.filter("lines", lambda x: x.rlike("[^ \\t\\r\\f]"))), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
