"""Language by multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams per language (partial sums in the tasks,
summed by a shuffle); the matrix of log-probabilities (buckets x languages)
is broadcast, its size fixed by ``buckets`` and the number of languages.
Scoring sums the rows of the matrix that a text's n-grams name.

The fit reads a bounded sample of the labelled rows: those whose hash over id
and text, on a scale from 0 to 1, falls under ``max_rows`` / (number of
labelled rows).  Scoring reads every row and whole texts, a bounded piece at a
time, so texts may be of any length.

Defined results: ``und`` and score 0 for a null text or one without letters
(characters of Unicode's category L), and for all rows if there are no labelled
ones; ties go to the first language in
order; labelled rows with a null text or language teach nothing; repeated rows
are scored one by one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import sampled

BUCKETS, MAX_ROWS, CHUNK = 1 << 15, 20_000, 1 << 16
LETTER = regex.compile(r"\p{L}")


def ngram_buckets(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all 1-, 2- and 3-grams, a bounded piece at a time."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for start in range(0, len(points), CHUNK):
        part = points[start : start + CHUNK + 2]
        inner = min(CHUNK, len(points) - start)
        one = part * np.uint64(0x9E3779B97F4A7C15)
        yield (one[:inner] >> shift).astype(np.int64)
        two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + part[1:] * np.uint64(0x165667B19E3779F9)
        yield (two[:inner] >> shift).astype(np.int64)
        three = two[:-1] * np.uint64(0x27D4EB2F165667C5) + part[2:] * np.uint64(0x85EBCA77C2B2AE63)
        yield (three[:inner] >> shift).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table = counts.setdefault(lang, np.zeros(buckets, np.int64))
            rows[lang] = rows.get(lang, 0) + 1
            for found in ngram_buckets(text, buckets):
                table += np.bincount(found, minlength=buckets)
    for lang, table in counts.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(table[at], rows[lang])})


def fit(labelled: DataFrame, buckets: int = BUCKETS, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """labelled (id, text, lang) -> languages, log-probabilities (buckets x languages), log-priors."""
    rows = labelled.where("text is not null and lang is not null")
    total = rows.count()
    sample = rows if total <= max_rows else sampled(rows, max_rows / total, "id", "text")
    sums = sample.select("text", "lang").mapInArrow(lambda it: _count(it, buckets), "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    langs = sorted(got.lang.unique())
    if total and not langs:
        raise ValueError("no labelled row was drawn: raise max_rows")
    counts, rows_of = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        own = got[got.lang == lang]
        inner = own[own.bucket >= 0]
        counts[inner.bucket.to_numpy(), j] = inner.n.to_numpy()
        rows_of[j] = own[own.bucket < 0].n.sum()
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * buckets)).astype(np.float32)
    return langs, logs, np.log(rows_of / max(1, rows_of.sum()))


def score_text(text: str | None, langs: list[str], logs: np.ndarray, priors: np.ndarray) -> tuple[str, float]:
    if not text or not langs or not LETTER.search(text):
        return "und", 0.0
    total = priors.astype(float).copy()
    for found in ngram_buckets(text, len(logs)):
        total += logs[found].sum(0, dtype=np.float64)
    best = int(total.argmax())
    return langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, max_rows: int = MAX_ROWS) -> DataFrame:
    """Fit on the rows where ``learn`` holds; per row of ``docs``: id, lang_pred, score."""
    langs, logs, priors = fit(docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), buckets, max_rows)
    model = docs.sparkSession.sparkContext.broadcast((langs, logs, priors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score_text(t, *model.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
