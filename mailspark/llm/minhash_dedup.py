"""Near-duplicate texts: banded MinHash with sequential Bayesian verification.

Texts with the same set of word shingles form one class; only classes are
compared.  Signatures of 128 values in 32 bands of 4 rows miss a pair at the
threshold 0.85 with a probability of 5e-11.  Candidates' signatures are
compared batch by batch, and a pair is dropped as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold is under
``miss``.  Survivors are confirmed on their full shingle sets.

A bucket is not expanded into its pairs.  At first each member is paired only
with the bucket's most central class, the one with the most bucket mates over
all bands; classes found linked are merged.  Buckets that still hold several
components are finished exactly: shingles are ordered by rarity, and a pair
from different components is compared only if both hold a common shingle so
early in this order that enough others can follow in both (prefix, length and
positional bounds of set joins), which no pair over the threshold fails.

Defined results: words are split at ASCII white space, A-Z lower-cased; texts
with fewer than ``size`` words have their whole sequence as the one shingle;
null texts and texts without words have an empty set and are linked with
nothing; a null id never names a component unless none of its documents has
an id; repeated rows stay repeated and get the same component (``keep_one``
keeps the one whose whole row has the least hash); texts may be of any length;
an empty table gives an empty result; other columns, whatever their names, are
ignored (``keep_one`` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.llm.components import components
from mailspark.llm.storage import fresh, row_hash, stash

BANDS, ROWS, BATCH = 32, 4, 16
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SEEDS = np.random.default_rng(20).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[3]
    h = (h ^ (h >> np.uint64(29))) * _M[4]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, total = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = _mix(total + each[k : k + n] + _M[k % 3])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS smallest values under random multiply-shift orders."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        out = np.minimum(out, ((part[None, :] ^ _SEEDS[0][:, None]) * (_SEEDS[1][:, None] | np.uint64(1))).min(1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            n, digest, sig = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingles(text, size)
                n.append(len(own))
                digest.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                sig.append(signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(sig, pa.list_(pa.int32()))],
                names=["id", "text_key", "n", "digest", "sig"],
            )


@lru_cache(maxsize=None)
def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of batches: the fewest equal values with which a pair lives on.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


def survives(a: str, b: str, threshold: float, miss: float) -> Column:
    """The sequential test on two signature columns: false at the first batch that fails."""
    test = F.lit(True)
    for k, least in reversed(list(enumerate(least_matches(threshold, miss)))):
        same = F.size(F.filter(F.zip_with(F.slice(a, 1, (k + 1) * BATCH), F.slice(b, 1, (k + 1) * BATCH), lambda x, y: x == y), lambda z: z))
        test = F.when(same < least, F.lit(False)).otherwise(test)
    return test


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b): those whose full sets are similar enough."""
    kept: dict[str, np.ndarray] = {}
    for batch in batches:
        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        good = []
        for i in range(len(a)):
            sets = []
            for key, text in ((a[i], ta[i]), (b[i], tb[i])):
                if key not in kept:
                    if len(kept) >= 64:
                        kept.pop(next(iter(kept)))
                    kept[key] = shingles(text, size)
                sets.append(kept[key])
            x, y = sets
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                good.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.string()), pa.array([b[i] for i in good], pa.string())], names=["u", "v"])


def _verified(pairs: DataFrame, active: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """pairs (a, b) -> linked pairs (u, v), written."""
    side = lambda s: active.select(F.col("digest").alias(s), F.col("sig").alias(f"sig_{s}"))
    text = lambda s: active.select(F.col("digest").alias(s), F.col("text").alias(f"text_{s}"))
    plausible = stash(pairs.join(side("a"), "a").join(side("b"), "b").where(survives("sig_a", "sig_b", percent / 100, miss)).select("a", "b"), "plausible")
    full = plausible.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    return stash(full.mapInArrow(lambda it: _confirm(it, size, percent), "u string, v string"), "links")


def _tokens(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(digest, text) -> a row for each shingle of the set."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets])
            row = pa.array(np.repeat(np.arange(len(sets)), sizes))
            tokens = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.repeat(sizes, sizes), pa.int32()), pa.array(tokens)], names=["digest", "n", "token"])


def _prefix_pairs(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """texts (digest, component, text) -> pairs (a, b), a < b, from different components that may reach the threshold.

    x and y over it share ceil(t / (1 + t) * (|x| + |y|)) shingles at least; with both sorted by rarity,
    some common shingle stands so early that this many can still follow in both.
    """
    tokens = stash(texts.select(F.unhex("digest").alias("digest"), "text").mapInArrow(lambda it: _tokens(it, size), "digest binary, n int, token bigint"), "tokens")
    common = stash(tokens.groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    order = W.partitionBy("digest").orderBy("df", "token")
    placed = tokens.join(common, "token").withColumn("at", F.row_number().over(order))
    # ``at`` counts from 1: with the least overlap needed of any partner, ceil(t * n), later places can't be the first common one.
    early = placed.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1))
    components_ = texts.select("digest", "component")
    early = early.select("token", F.lower(F.hex("digest")).alias("digest"), "n", "at").join(components_, "digest")
    x = early.select("token", F.col("digest").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"))
    y = early.select("token", F.col("digest").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    room = 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    lengths = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = x.join(y, "token").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & lengths & (room >= needed))
    return pairs.select("a", "b").distinct()


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, miss: float = 1e-9) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    key = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("text_key"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sketches = stash(rows.mapInArrow(lambda it: _sketch(it, size), f"id {kind}, text_key bigint, n bigint, digest string, sig array<int>"), "sketches")
    # One class for each distinct set; its text comes from the row named by ``first``.
    classes = sketches.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "text_key")).alias("first"), F.min("id").alias("least"), F.any_value("sig").alias("sig"))
    classes = stash(classes, "classes")
    numbers = F.sequence(F.lit(0), F.lit(BANDS - 1))
    bands = classes.select("digest", F.explode(F.transform(numbers, lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, F.lit(ROWS))))).alias("band"))
    # Written, so that the joins with them are of plain shuffles, which Spark splits where a band is hot.
    buckets = stash(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "bands")
    shared = stash(bands.join(buckets, "band"), "shared")
    central = shared.groupBy("digest").agg(F.sum("members").alias("mates"))
    ranked = shared.join(central, "digest").select("band", "digest", "mates")
    reps = stash(ranked.groupBy("band").agg(F.max_by("digest", F.struct("mates", "digest")).alias("rep")), "representatives")
    crowded = stash(ranked.join(reps, "band").select("band", "digest", "rep"), "buckets")
    needed = classes.join(crowded.select("digest").distinct(), "digest").select("digest", "sig", F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"))
    whole = lambda df: F.concat_ws(":", df["id"].cast("string"), df["text_key"])
    texts = rows.withColumn("_key", whole(rows)).select("_key", "text")
    active = stash(needed.withColumn("_key", whole(needed)).select("_key", "digest", "sig").join(texts, "_key").drop("_key").dropDuplicates(["digest"]), "active")

    stars = crowded.where("digest <> rep").select(F.col("rep").alias("a"), F.col("digest").alias("b")).distinct()
    links = _verified(stars, active, size, percent, miss)
    merged = components(links)
    # Buckets that still hold several components: their cross pairs, each once.
    placed = crowded.join(merged, crowded["digest"] == merged["node"], "left").select("band", "digest", F.coalesce("component", "digest").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    open_ = placed.join(mixed, "band").select("digest", "component").distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = _prefix_pairs(active.join(open_, "digest").select("digest", "component", "text"), size, percent).join(tried, ["a", "b"], "left_anti")
    more = _verified(cross, active, size, percent, miss)
    final = components(links.unionByName(more))

    ids = classes.select("digest", "least").join(final, F.col("digest") == F.col("node"), "left").select("digest", F.coalesce("component", "digest").alias("component"), "least")
    ids = ids.groupBy("component").agg(F.min("least").alias("component_id")).join(ids.select("component", "digest"), "component").select("digest", "component_id")
    out = sketches.select("id", "text_key", "n", "digest").join(ids, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with all columns (a row without words is its own component)."""
    marks = annotate(docs, id_col, text_col, **options)
    key = lambda i, t: F.concat_ws(":", i.cast("string"), t)
    same, nth = fresh(docs.columns, "same_row", "nth")
    kept = marks.where("kept").select(key(F.col(id_col), F.col("text_key")).alias(same)).distinct()
    joined = docs.withColumn(same, key(F.col(id_col), F.xxhash64(F.col(text_col)))).join(kept, same, "left_semi")
    # Rows that repeat id and text: same keys as the join, so no further shuffle.
    return joined.withColumn(nth, F.row_number().over(W.partitionBy(same).orderBy(row_hash(docs)))).where(F.col(nth) == 1).drop(same, nth)
