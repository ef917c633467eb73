"""Removal of long byte strings that occur more than once.

A sparse suffix array: of all suffixes only those that start at an anchor are
kept, an anchor being the place with the least hash of GRAM bytes among the
starts in a string of ``length`` bytes.  Equal strings have their anchor at
the same place, so two equal strings of ``length`` bytes always bring two
suffixes with equal leading bytes into play.  Anchors whose leading bytes
(their tokens) occur once are dropped by a count with partial sums.

The rest have a context: ``length - GRAM`` bytes before the anchor and
``length`` from it on.  Anchors with equal contexts are one entry with a count;
its bytes are cut from one owner's text, and only where a run (equal leading
bytes) holds several contexts.  Contexts are range-partitioned by their leading
bytes at sampled splitters.  Each bucket sorts by multikey quicksort (digits of
eight bytes; only ties are sorted on), and the contexts of a run are compared
to both sides: in pairs, or, if there are more than NEAR, by the hashes of all
strings of ``length`` bytes around the anchor, sorted offset by offset, with
equal neighbours compared byte by byte.  Ranges hold all suffixes with the same
leading bytes, so no pair crosses a boundary.

A run of more than RUN contexts doesn't go to one task.  A string of
``length`` bytes around the anchor that starts within STEP given offsets
contains the bytes common to all of these; contexts are grouped by 128-bit
digests of these bytes for each such stretch of offsets, and only those that
meet another are grouped by digests of the whole strings.  All of these are
counts with partial sums and joins.

Since every string of a run contains the anchor, what an anchor's matches cover
is one span around it.

Defined results: a null text is empty; matches don't cross documents; strings
are judged on the input; rows that repeat a text match each other in full;
null ids are ids like others; texts may be of any length (an anchor is 736
bytes of context at most, whatever the text); an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import discard, stash

#: Bytes of an anchor; contexts taken at a time; contexts of a run that are compared in pairs; contexts of the largest run of one task; offsets that a part of a larger run covers.
GRAM, CHUNK, NEAR, RUN, STEP = 64, 1500, 128, 16_384, 43
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, step in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, step, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i] = sum of (data[j] + 1) * base**j for j < i."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes, the same wherever it stands."""
    n = len(sums) - width
    h = (sums[width:] - sums[:n]) * _powers(n)[1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of ``width`` values.

    Blocks of ``width``: the least of a run is the least of a block's end and of the next one's start.
    """
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(blocks, width)
    head = np.minimum.accumulate(rows, axis=1).reshape(-1)
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors: every string of ``length`` bytes holds the first least one of its own."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = window_hashes(prefix_sums(data), GRAM)
    width = length - GRAM + 1
    least = sliding_min(grams, width)
    # A place is an anchor if it is the least of some run around it: no greater than the largest of these
    # runs' least values (a sliding maximum, by the same blocks).  Equal grams are anchors alike.
    rest = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    at = np.flatnonzero(grams <= ~sliding_min(np.concatenate([rest, ~least, rest]), width))
    return at, grams[at]


def multikey_order(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of digits: sort by a digit, go on to the next among ties only.

    Returns the order and, for each place but the first, whether the row equals the one before.
    """
    n = len(digits)
    order = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = True
    open_rows = np.arange(n)
    for k in range(digits.shape[1]):
        if not len(open_rows):
            break
        # Groups of ties among the open places, then sort within them by the next digit.
        group = np.cumsum(~same[open_rows])
        key = digits[order[open_rows], k]
        inner = np.lexsort((key, group)) if k else np.argsort(key, kind="stable")
        order[open_rows] = order[open_rows][inner]
        key = key[inner]
        fresh = np.zeros(len(open_rows), bool)
        fresh[1:] = (key[1:] == key[:-1]) & same[open_rows[1:]]
        fresh[0] = False
        same[open_rows] = fresh
        tied = same[open_rows].copy()
        tied[:-1] |= same[open_rows][1:]
        open_rows = open_rows[tied]
    return order, same


def extents(lefts: np.ndarray, rights: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far contexts agree before and after the anchor, pair by pair (the last column of either side always differs)."""
    return np.argmax(lefts[i] != lefts[j], axis=1), np.argmax(rights[i] != rights[j], axis=1)


def spread(contexts: list[bytes], lefts: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as two matrices, read outwards from the anchor; past their ends stands a number of the row's own."""
    before, after = length - GRAM, length
    pad = np.arange(256, 256 + len(contexts), dtype=np.uint16)[:, None]
    out_left, out_right = np.repeat(pad, before + 1, axis=1), np.repeat(pad, after + 1, axis=1)
    for k, (text, left) in enumerate(zip(contexts, lefts, strict=True)):
        row = np.frombuffer(text, np.uint8)
        out_left[k, :left] = row[:left][::-1]
        out_right[k, : len(row) - left] = row[left:]
    return out_left, out_right


def match_pairs(contexts: list[bytes], lefts: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) for each context: what its repeated strings cover around the anchor; 0, 0 if there is none."""
    left, right = spread(contexts, lefts, length)
    before, after = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    for i in range(len(contexts) - 1):
        others = np.arange(i + 1, len(contexts))
        back, ahead = extents(left, right, i, others)
        good = back + ahead >= length
        if good.any():
            others, back, ahead = others[good], back[good], ahead[good]
            before[i], after[i] = max(before[i], back.max()), max(after[i], ahead.max())
            before[others], after[others] = np.maximum(before[others], back), np.maximum(after[others], ahead)
    return before, after


def match_windows(contexts: list[bytes], lefts: list[int], length: int, columns: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The same for large runs: strings of ``length`` bytes at one offset are sorted by their hash, equal neighbours compared."""
    n, reach = len(contexts), length - GRAM
    left, right = spread(contexts, lefts, length)
    sizes = np.array([len(c) for c in contexts])
    own = np.array(lefts)
    rows = np.concatenate([left[:, -2::-1], right[:, :-1]], axis=1)
    up, _ = _powers(rows.shape[1])
    sums = np.zeros((n, rows.shape[1] + 1), np.uint64)
    for at in range(0, n, 1024):
        np.cumsum((rows[at : at + 1024].astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[at : at + 1024, 1:])
    del rows
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for first in range(0, reach + 1, columns):
        starts = np.arange(first, min(first + columns, reach + 1))  # columns of the matrix; the anchor stands at ``reach``
        hashes = sums[:, starts + length] - sums[:, starts]
        order = np.argsort(hashes, axis=0, kind="stable")
        ordered = np.take_along_axis(hashes, order, 0)
        at, col = np.nonzero(ordered[1:] == ordered[:-1])
        a, b, start = order[at, col], order[at + 1, col], starts[col] - reach
        inside = (own[a] >= -start) & (own[b] >= -start) & (start + length <= sizes[a] - own[a]) & (start + length <= sizes[b] - own[b])
        a, b, start = a[inside], b[inside], start[inside]
        # The bytes decide, once for each pair of contexts.
        pairs, which = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        for part in range(0, len(pairs), 4096):
            back, ahead = extents(left, right, pairs[part : part + 4096] >> 32, pairs[part : part + 4096] & 0xFFFFFFFF)
            mine = (which >= part) & (which < part + 4096)
            k = which[mine] - part
            good = (back[k] >= -start[mine]) & (ahead[k] >= start[mine] + length)
            for who in (a[mine][good], b[mine][good]):
                np.maximum.at(before, who, -start[mine][good])
                np.maximum.at(after, who, start[mine][good] + length)
    return before, after


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, size, places, grams, ctxs): the anchors with the digests of their leading bytes and of their contexts."""
    reach = length - GRAM
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            keys, sizes, places, hashes, contexts = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                at, grams = anchors(np.frombuffer(raw, np.uint8), length)
                keys.append(key)
                sizes.append(len(raw))
                places.append(at.astype(np.int32))
                hashes.append(grams.view(np.int64))
                contexts.append([xxhash.xxh3_64_intdigest(raw[max(0, p - reach) : p + length], min(p, reach)) - (1 << 63) for p in at.tolist()])
            big, small = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(places, small), pa.array(hashes, big), pa.array(contexts, big)], names=["key", "size", "places", "grams", "ctxs"])


CONTEXT = "gram bigint, ctx bigint, n bigint, large boolean, left int, context binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, text, wanted), sorted by key -> a row for each wanted anchor, with its bytes; rows that repeat id and text bring it once."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    names = [part.split()[0] for part in CONTEXT.split(", ")]
    reach, last = length - GRAM, None
    for batch in batches:
        rows = []
        for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == last:
                continue
            raw, last = text.encode(), key
            for w in wanted:
                p = w["place"]
                rows.append((w["gram"], w["ctx"], w["n"], w["large"], min(p, reach), raw[max(0, p - reach) : p + length]))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _bucket(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of their leading bytes -> (gram, ctx, before, after) of those with a match."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # Suffixes in order; those with equal leading bytes are neighbours.
        leading = np.frombuffer(b"".join(r[4][r[3] : r[3] + GRAM] for r in rows), ">u8").astype(np.uint64).reshape(-1, GRAM // 8)
        order, same = multikey_order(leading)
        starts = np.flatnonzero(~same).tolist()
        out = []
        for first, stop in zip(starts, [*starts[1:], len(order)], strict=True):
            run = list({rows[i][:2]: rows[i] for i in order[first:stop].tolist()}.values())  # several tasks may have brought a context
            match = match_pairs if len(run) <= NEAR else match_windows
            before, after = match([r[4] for r in run], [r[3] for r in run], length)
            out += [(run[k][0], run[k][1], int(before[k]), int(after[k])) for k in np.flatnonzero(after).tolist() if run[k][2] == 1]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["gram", "ctx", "before", "after"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= CHUNK and held[-1][0] != row[0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _digests(batches: Iterator[pa.RecordBatch], length: int, each: bool) -> Iterator[pa.RecordBatch]:
    """Digests of a large run's contexts: of the bytes common to the strings of a stretch of offsets, or (``each``) of the strings of one stretch."""
    reach = length - GRAM
    for batch in batches:
        rows = []
        for gram, ctx, left, context, stretch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if each:
                offsets = [(o, o + length) for o in range(stretch * STEP - reach, min((stretch + 1) * STEP - reach, 1))]
            else:
                offsets = [(min((k + 1) * STEP - 1 - reach, 0), k * STEP - reach + length) for k in range(-(-(reach + 1) // STEP))]
            for k, (a, b) in enumerate(offsets):
                # A string must lie in the context; none of a stretch does if their common bytes don't.
                if left + a >= 0 and left + b <= len(context):
                    at = a if each else k
                    rows.append((xxhash.xxh3_128_digest(context[left + a : left + b], at & 0xFFFF), gram, ctx, at))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())], names=["digest", "gram", "ctx", "at"])


def _large_runs(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, before, after) for runs too large for one task, by shuffled digests alone."""
    schema = "digest binary, gram bigint, ctx bigint, at int"
    twice = lambda d: d.join(stash(d.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "met"), "digest", "left_semi")
    columns = ["gram", "ctx", "left", "context"]
    large = contexts.select(*columns).dropDuplicates(["gram", "ctx"])
    parts = stash(large.withColumn("stretch", F.lit(0)).mapInArrow(lambda it: _digests(it, length, False), schema), "stretches")
    met = twice(parts).select("gram", "ctx", F.col("at").alias("stretch"))
    strings = stash(large.join(met, ["gram", "ctx"]).select(*columns, "stretch").mapInArrow(lambda it: _digests(it, length, True), schema), "strings")
    return twice(strings).groupBy("gram", "ctx").agg((-F.min("at")).cast("int").alias("before"), (F.max("at") + length).cast("int").alias("after"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans (start, stop)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> (id, n_bytes, removed, kept)."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            sizes, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                runs = merge_spans([(s["start"], s["stop"]) for s in spans or []])
                at, parts = 0, []
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                removed.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join([*parts, raw[at:]]))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, removed (array of start, stop), kept (the remaining bytes)."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = length - GRAM
    name = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_col), F.xxhash64(F.lit(7), F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(name.cast("binary"))).alias("key"), F.col(text_col).alias("text"))
    long_rows = rows.where(F.octet_length("text") >= length)
    schema = "key binary, size bigint, places array<int>, grams array<bigint>, ctxs array<bigint>"
    found = stash(long_rows.select("key", "text").mapInArrow(lambda it: _find_anchors(it, length), schema), "anchors")
    # Counts that are joined again are written first: such joins are of plain shuffles, which Spark splits where a gram is hot.
    common = stash(found.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "common")
    each = found.select("key", "size", F.explode(F.arrays_zip("places", "grams", "ctxs")).alias("a")).select("key", "size", F.col("a.places").alias("place"), F.col("a.grams").alias("gram"), F.col("a.ctxs").alias("ctx"))
    members = stash(each.join(common, "gram", "left_semi").select("gram", "ctx", "key", "place", F.least(F.lit(length), F.col("size") - F.col("place")).cast("int").alias("after")), "members")

    discard(found, common)

    # An entry for each context, with one owner and the number of owners; runs with their number of contexts.
    entries = stash(members.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("owner"), F.min("after").alias("after")), "entries")
    runs = stash(entries.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"), "runs")
    wanted = entries.join(runs, "gram").select(F.col("owner.key").alias("key"), F.struct(F.col("owner.place").alias("place"), "gram", "ctx", "n", (F.col("contexts") > RUN).alias("large")).alias("w"))
    per_text = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    cut = long_rows.select("key", "text").join(per_text, "key").select("key", "text", "wanted").mapInArrow(lambda it: _cut_contexts(it, length), CONTEXT)
    contexts = stash(cut, "contexts")

    # Range partitions by the leading bytes (Spark samples the splitters), each in suffix order.
    lead = F.substring("context", F.col("left") + 1, F.lit(GRAM))
    ordered = contexts.where("not large").withColumn("lead", lead).repartitionByRange(ranges, "lead").sortWithinPartitions("lead", "gram")
    matched = ordered.select("gram", "ctx", "n", "left", "context").mapInArrow(lambda it: _bucket(it, length), "gram bigint, ctx bigint, before int, after int")
    owned = entries.where("n > 1").select("gram", "ctx", F.least(F.col("owner.place"), F.lit(reach)).alias("before"), "after")
    alone = _large_runs(contexts.where("large"), length).join(entries.where("n = 1").select("gram", "ctx"), ["gram", "ctx"], "left_semi")
    spans = stash(matched.unionByName(alone).unionByName(owned), "spans")
    discard(runs, contexts)
    placed = members.select("gram", "ctx", "key", "place").join(spans, ["gram", "ctx"]).select("key", F.struct((F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("stop")).alias("span"))
    per_row = placed.groupBy("key").agg(F.collect_set("span").alias("spans"))
    out = rows.join(per_row, "key", "left").select("id", "text", "spans").mapInArrow(_apply, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, removed array<struct<start:int,stop:int>>, kept binary")
    return out.withColumnRenamed("id", id_col)
