"""Toxicity by weak supervision.

Voters are lexicon words and word-beginning patterns: a short general lexicon
plus terms mined from the labelled rows (words and 4- to 7-letter beginnings
that stand, or stand densely, mostly in toxic texts).  A generative label model, fitted by
expectation-maximisation over word lists of these terms, estimates each list's accuracies and how lists
correlate within a class; correlated voters share their weight, and the given
label is one more voter, whose rates are estimated like theirs.  A linear classifier over the voters'
presence and density is trained on the posterior labels.

The fit uses a bounded sample of the labelled rows (``max_rows``: those whose
hash over id and text, on a scale from 0 to 1, falls under ``max_rows`` /
number of labelled rows); the model is ``max_voters`` terms, whatever the
corpus.  Scoring reads every row and whole texts, of any length.

Defined results: a null text counts as empty and gets the score of a text
without votes; repeated rows are scored one by one; labelled rows with a null
label teach nothing, and of several labels of an id the largest holds; without labelled rows the lexicon alone decides; an empty
table gives an empty result; other columns are ignored (``keep_clean`` carries
them).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import sampled

MAX_ROWS, MAX_VOTERS, THRESHOLD = 12_000, 300, 0.7
#: A word in so many makes a term dense; from this correlation within a class on, voters share their weight; word lists that vote.
DENSE, CORRELATED, LISTS = 100, 0.3, 4
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(4, 8)
#: Common abusive words of four languages.
LEXICON = (
    "idiot moron stupid loser scum trash garbage worthless pathetic disgusting clown filth vermin imbecile dumbass retard "
    "imbécile crétin connard salaud ordure abruti dummkopf arschloch abschaum trottel wichser estúpido imbécil basura escoria cabrón"
).split()


def terms(word: str) -> list[str]:
    """A word as voters name it: itself, and its beginnings marked by a star."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


def firing(counts: dict[str, int], words: int) -> set[str]:
    """Voters that a text calls up: its terms, and with an @ those that make up one word in DENSE at least."""
    return set(counts) | {t + "@" for t, n in counts.items() if n * DENSE >= words}


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: how many texts of either label call up each possible voter."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = WORD.findall((text or "").lower())
            own: dict[str, int] = {}
            for word, n in Counter(words).items():
                for t in terms(word):
                    own[t] = own.get(t, 0) + n
            for voter in firing(own, len(words)):
                counts.setdefault(voter, [0, 0])[label] += 1
    yield pa.RecordBatch.from_pydict({"term": list(counts), "clean": pa.array([c[0] for c in counts.values()], pa.int64()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})


class Votes:
    """Which voters a text calls up; a bounded memory of words already seen."""

    def __init__(self, voters: list[str]):
        self.index = {t: j for j, t in enumerate(voters)}
        self.terms = {t.rstrip("@") for t in voters}
        self.seen: dict[str, tuple[str, ...]] = {}

    def of(self, text: str | None) -> tuple[list[int], int, int]:
        """Voters called up, words with one of their terms, words."""
        counts: dict[str, int] = {}
        words = WORD.findall((text or "").lower())
        hit_words, seen = 0, self.seen
        for word in words:
            found = seen.get(word)
            if found is None:
                found = tuple(t for t in terms(word) if t in self.terms)
                if len(seen) >= 200_000:
                    seen.clear()
                seen[word] = found
            if found:
                hit_words += 1
                for t in found:
                    counts[t] = counts.get(t, 0) + 1
        return sorted(self.index[v] for v in firing(counts, len(words)) if v in self.index), hit_words, len(words)


def features(hits: list[int], hit_words: int, words: int, n: int) -> np.ndarray:
    """Presence of each voter, then density, number of hits and number of voters."""
    x = np.zeros(n + 3)
    x[hits] = 1.0
    x[n:] = min(1.0, 20.0 * hit_words / max(words, 1)), min(1.0, np.log1p(hit_words) / 2), min(1.0, len(hits) / 3)
    return x


def list_votes(votes: np.ndarray, voters: list[str]) -> np.ndarray:
    """Terms dealt into LISTS word lists by their first four letters; a list votes if one of its terms does.

    A toxic text calls up only some terms (those of its language), so single terms exclude each other within the
    class, and their silence says little; every list spans all languages, and its silence counts.
    """
    dealt = np.array([zlib.crc32(t[:4].encode()) % LISTS for t in voters])
    return np.column_stack([votes[:, dealt == k].max(1, initial=0.0) for k in range(LISTS)])


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """votes (rows x voters, 0/1), given labels (0/1) -> posterior probability of the toxic class; and of each voter,
    the given label last, its rate of voting within the toxic class, within the clean one, and its weight.

    The first guess comes from the votes alone: the rows with most votes, rare
    voters counting more, as many as the given labels call toxic.  Each round
    estimates class prior, every voter's rates, and the correlations of voters
    within the classes; a voter's weight is one over its summed correlation with
    all voters (itself counts as one).  The given label votes like the others,
    with rates estimated like theirs, so it can be outvoted.
    """
    votes = np.column_stack([votes, given])
    strength = votes @ (1 / np.maximum(votes.mean(0), 1e-3))
    post = np.where(strength > np.quantile(strength, 1 - np.clip(given.mean(), 0.02, 0.5)), 0.8, 0.1)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 0.01, 0.99)
        rate1 = np.clip((post @ votes + 0.5) / (post.sum() + 1), 1e-3, 1 - 1e-3)
        rate0 = np.clip(((1 - post) @ votes + 0.05) / ((1 - post).sum() + 1), 1e-4, 1 - 1e-3)
        within = votes - np.outer(post, rate1) - np.outer(1 - post, rate0)
        spread = np.sqrt((within**2).mean(0)) + 1e-9
        corr = np.abs((within.T @ within) / len(votes) / np.outer(spread, spread))
        weight = 1 / np.maximum(1.0, np.where(corr > CORRELATED, corr, 0).sum(1))
        on, off = np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))
        logit = np.log(prior / (1 - prior)) + votes @ (weight * on) + (1 - votes) @ (weight * off)
        fresh = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(fresh - post).max() < 1e-5
        post = fresh
        if done:
            break
    return post, rate1, rate0, weight


def train(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (target - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, max_voters: int = MAX_VOTERS) -> tuple[list[str], np.ndarray]:
    """labelled (id, text, label 0/1) -> voters and weights."""
    rows = labelled.where("label in (0, 1)")
    total = rows.count()
    if total > max_rows:
        rows = sampled(rows, max_rows / total, "id", "text")
    rows = rows.select("text", F.col("label").cast("int").alias("label")).dropDuplicates()
    mined = rows.mapInArrow(_mine, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Mostly toxic and not by chance: how far toxic lies above what clean texts would lead to.
    precision = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    toxic_rows = rows.where("label = 1").count()
    good = mined.where((F.col("toxic") >= max(3, 0.015 * toxic_rows)) & (precision >= 0.8)).withColumn("gain", F.col("toxic") - 4 * F.col("clean"))
    lines = good.orderBy(F.desc("gain"), F.length("term"), "term").limit(max_voters - len(LEXICON)).collect()
    voters = list(dict.fromkeys(LEXICON + [r["term"] for r in lines]))
    n = len(voters)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Votes(voters)
        for batch in batches:
            found = [own.of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([h for h, _, _ in found], pa.list_(pa.int32())), pa.array([h for _, h, _ in found], pa.int32()), pa.array([w for _, _, w in found], pa.int32())],
                names=["label", "voters", "hit_words", "words"],
            )

    # A bounded sample: max_rows short lists.
    seen = rows.mapInArrow(votes, "label int, voters array<int>, hit_words int, words int").collect()
    if total and not seen:
        raise ValueError("no labelled row was drawn: raise max_rows")
    prior = [1.0] * len(voters) + [2.0, 2.0, 1.0, -3.0]
    if not any(r["label"] for r in seen):
        return voters, np.array(prior)
    x = np.array([features(r["voters"], r["hit_words"], r["words"], n) for r in seen])
    target, *_ = label_model(list_votes(x[:, :n], voters), np.array([r["label"] for r in seen], float))
    return voters, train(x, target)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score."""
    voters, weights = model
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, base = Votes(voters), len(voters), float(weights[-1])
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hits, hit_words, words = own.of(text)
                logit = base + (float(features(hits, hit_words, words, n) @ weights[:-1]) if hits or hit_words else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of the rows that may teach."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    return docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id")


def keep_clean(docs: DataFrame, model: tuple[list[str], np.ndarray], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows scored under the threshold, with all their columns."""
    voters, weights = model
    n, base = len(voters), float(weights[-1])
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Votes(voters)
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                hits, hit_words, words = own.of(text)
                logit = base + (float(features(hits, hit_words, words, n) @ weights[:-1]) if hits or hit_words else 0.0)
                keep.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
