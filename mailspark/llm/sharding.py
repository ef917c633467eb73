"""Shards by balanced label propagation.

Documents that share a link key are linked.  Every linked document starts with
a label (shard) of its own by hash; the state is the count of documents by unit,
first label and present label, a unit being the documents of one key, or a
shard-sized part of them where the key has more than a shard holds.  In each
round every document asks for the label that most of its unit holds, and of the
requests from one label to another only as many are granted as leave no label
with more coming in than going out plus its free capacity; labels over capacity
send documents to the freest one.  A document's place is its label after the rounds: without
rounds, linked documents stay where their hash put them, apart.

What quotas held back in the last round is mended: stragglers follow the most
frequent label of their unit.  Sizes are then made exact by
packing: blocks (documents of a unit with one label) of keys with more than a
64th of a shard (a bounded list) are placed whole, largest first, at their label
or else where they fit; small ones follow in buckets by label and range of keys.
Documents without links, ranked, fill the rest.  A block is cut only if it fits
into no shard's room; of small ones, those of a bucket that fits nowhere whole
are ranked before the unlinked documents and may be cut at a shard's border.

Every step is a join or an aggregation with partial sums: a link key held by a
third of all rows is 24 counts after the map side.  Ranks come from windows
inside small buckets (hot keys are dealt over sub-buckets) plus the running
sum of bucket sizes, a table of bounded length.

Texts are linked by a 64-bit hash: should two share one, they would only be
placed together.  Texts may be of any length.

Law: ``rows``, shard sizes differ by one row at most.  Defined results: a null
text has 0 bytes, checksum 0 and the key of the empty text; null ids are
documents like others; repeated rows each take a slot; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.llm.storage import stash

RANGES, SUBS = 64, 16
SMALL, FILL = 1_000_000, -1


def propagate(nodes: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """nodes (key, part, label, n, ...): documents of a unit (key, part) by their label.  Returns them after ``rounds`` rounds.

    Other columns, such as the documents' first label, are kept apart and carried along.
    """
    spark, labels = nodes.sparkSession, nodes
    own = [c for c in nodes.columns if c != "n"]
    for turn in range(rounds):
        # The favourite label of each unit: what a document of it asks for.
        asked = labels.join(favourites(labels), ["key", "part"])
        flow = asked.groupBy("label", "wish").agg(F.sum("n").alias("n")).collect()  # at most shards * shards rows
        moves = {(r["label"], r["wish"]): r["n"] for r in flow if r["label"] != r["wish"]}
        size = {s: sum(r["n"] for r in flow if r["label"] == s) for s in range(shards)}
        free = {s: max(0, capacity - size[s]) for s in range(shards)}
        grant = [(a, b, b, n / moves[a, b]) for (a, b), n in granted(moves, free).items()]
        freest = max(free, key=free.get)
        grant += [(s, s, freest, min(size[s] - capacity, free[freest]) / size[s]) for s in range(shards) if size[s] > capacity and free[freest]]
        quota = spark.createDataFrame(grant or [(-1, -1, -1, 0.0)], "label int, wish int, goal int, share double")
        luck = F.pmod(F.xxhash64("key", "part", F.lit(turn)), F.lit(1_000_000)) / 1_000_000
        moved = asked.join(F.broadcast(quota), ["label", "wish"], "left").withColumn("label", F.when(luck < F.coalesce("share", F.lit(0.0)), F.col("goal")).otherwise(F.col("label")))
        labels = stash(moved.groupBy(*own).agg(F.sum("n").alias("n")), "labels")
    return labels


def granted(moves: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], float]:
    """Of the requests (from, to) -> n as many as leave no label with more coming in than going out plus its free room."""
    flow = {move: float(n) for move, n in moves.items()}
    for _ in range(8 * len(free)):
        room = dict(free)
        asked = dict.fromkeys(free, 0.0)
        for (a, b), n in flow.items():
            room[a] += n
            asked[b] += n
        tight = {s: room[s] / asked[s] for s in free if asked[s] > room[s] + 0.5}
        if not tight:
            break
        flow = {(a, b): n * tight.get(b, 1.0) for (a, b), n in flow.items()}
    return flow


def favourites(labels: DataFrame) -> DataFrame:
    """(key, part, wish): the label that most documents of each unit hold, ties by hash."""
    held = labels.groupBy("key", "part", "label").agg(F.sum("n").alias("n"))
    return held.groupBy("key", "part").agg(F.max_by("label", F.struct("n", F.xxhash64("key", "part", "label"))).alias("wish"))


def mended(labels: DataFrame) -> DataFrame:
    """Labels after the rounds, the stragglers of each unit joined to its favourite."""
    return labels.join(favourites(labels), ["key", "part"]).select("key", "part", "start", F.col("wish").alias("label"), "n")


def pack(units: list[tuple[int, int, int]], room: list[int], at_home: bool = True) -> tuple[list[tuple[int, int, int]], list[int], int]:
    """units (queue, n, home), largest first -> pieces (queue, shard, n), room left, number of documents in cut units.

    A unit goes home if it fits there, else to the tightest shard that holds it whole; what fits nowhere is cut last.
    """
    room, pieces, cut = list(room), [], []
    for queue, n, home in sorted(units, key=lambda u: (-u[1], u[0])):
        fits = [s for s, r in enumerate(room) if r >= n]
        if not fits:
            cut.append((queue, n))
            continue
        s = home if at_home and room[home] >= n else min(fits, key=lambda s: (room[s], s))
        room[s] -= n
        pieces.append((queue, s, n))
    for queue, n in cut:
        while n > 0:
            s = max(range(len(room)), key=lambda s: room[s])
            take = min(n, room[s])
            room[s] -= take
            n -= take
            pieces.append((queue, s, take))
    return pieces, room, sum(n for _, n in cut)


def assign(docs: DataFrame, shards: int = 24, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (bytes + 8), text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text, F.octet_length(text)).alias("key"), F.xxhash64(F.col(id_col)).alias("salt"),
        ).withColumn("start", F.pmod(F.hash("salt", F.lit(11)), F.lit(shards))),
        "rows",
    )
    total = rows.count()
    low, over = divmod(total, shards)
    target = [low + (s < over) for s in range(shards)]
    capacity = max(1, max(target))
    keys = stash(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "keys")
    # A key with more documents than a shard holds is placed in parts; at most shards such keys.
    parts = keys.where(F.col("members") > capacity).select("key", F.ceil(F.col("members") / capacity).cast("int").alias("parts"))
    started = rows.join(F.broadcast(parts), "key", "left").select("key", F.pmod(F.hash("salt"), F.coalesce("parts", F.lit(1))).alias("part"), "start", F.col("start").alias("label"))
    nodes = started.groupBy("key", "part", "start", "label").agg(F.count("*").alias("n")).join(keys.select("key"), "key", "left_semi")
    labels = propagate(stash(nodes, "nodes"), shards, capacity, rounds)
    labels = stash((mended(labels) if rounds else labels).join(keys, "key"), "mended")

    large = F.col("members") > capacity / RANGES
    blocks, over = defaultdict(list), defaultdict(lambda: defaultdict(int))
    # At most shards * RANGES keys, each with a row for every first label and part.
    for r in labels.where(large).orderBy("key", "part", "start").collect():
        if r["members"] > capacity:
            over[r["key"], r["members"]][r["label"]] += r["n"]
        else:
            blocks[r["key"], r["label"]].append((r["start"], r["n"]))
    named_rows, units = [], []
    for queue, (key, label) in enumerate(sorted(blocks)):
        held = blocks[key, label]
        named_rows += [(key, start, queue) for start, _ in held]
        units.append((queue, sum(n for _, n in held), label))
    for queue, (key, members) in enumerate(sorted(over), len(blocks)):
        # A key larger than a shard goes in equal parts, as few as hold it; the labels most held are used in turn.
        count, own = -(-members // capacity), sorted(over[key, members], key=lambda s: (-over[key, members][s], s))
        named_rows += [(key, start, queue) for start in range(shards)]
        units += [(queue, members // count + (i < members % count), own[i % len(own)]) for i in range(count)]
    span = F.pmod(F.shiftrightunsigned("key", 32), F.lit(RANGES)).cast("int")
    small = labels.where(~large).select("key", "start", "label")
    counted = labels.where(~large).groupBy("label", span.alias("span")).agg(F.sum("n").alias("n")).collect()  # at most shards * RANGES rows
    pieces, room, cut = pack(units, target)
    if cut:
        tight = pack(units, target, at_home=False)
        pieces, room, cut = tight if tight[2] < cut else (pieces, room, cut)
    loose = []
    for r in sorted(counted, key=lambda r: (-r["n"], r["label"], r["span"])):
        queue = SMALL + r["label"] * RANGES + r["span"]
        fits = [s for s in range(shards) if room[s] >= r["n"]]
        if not fits:
            loose.append(queue)  # fewer than ``shards``: each is larger than any room left
            continue
        s = r["label"] if room[r["label"]] >= r["n"] else min(fits, key=lambda s: (room[s], s))
        room[s] -= r["n"]
        pieces.append((queue, s, r["n"]))
    pieces += [(FILL, s, n) for s, n in enumerate(room) if n]
    used, runs, ways = [0] * shards, defaultdict(int), defaultdict(list)
    for queue, s, n in pieces:
        ways[queue].append((runs[queue], s, used[s]))
        runs[queue] += n
        used[s] += n
    way = spark.createDataFrame(list(ways.items()), "queue int, way array<struct<start: bigint, shard: int, base: bigint>>")

    dealt = 1 + F.pmod(F.hash("salt", F.lit(7)), F.lit(SUBS))
    columns = ["id", "size", "crc", "key", "salt"]
    named = spark.createDataFrame(named_rows, "key bigint, start int, queue int")
    known = rows.join(F.broadcast(named), ["key", "start"], "left")
    hot = known.where("queue is not null").select(*columns, "queue", F.lit(1).alias("tier"), F.lit(0).alias("label"), F.lit(0).alias("span"), dealt.cast("int").alias("sub"))
    home = F.col("label").isNotNull()
    bucket_queue = (F.lit(SMALL) + F.col("label") * RANGES + span).cast("int")
    rest = (
        known.where("queue is null").drop("queue").join(small, ["key", "start"], "left")
        .withColumn("queue", F.when(home & ~bucket_queue.isin(loose), bucket_queue).otherwise(F.lit(FILL)))
        .select(*columns, "queue", F.when(home, 0).otherwise(1).alias("tier"), F.coalesce("label", F.pmod("key", F.lit(shards)).cast("int")).alias("label"), span.alias("span"), F.lit(0).alias("sub"))
    )
    labelled = stash(hot.unionByName(rest), "labelled")
    bucket = ["queue", "tier", "label", "span", "sub"]
    sizes = labelled.groupBy(*bucket).agg(F.count("*").alias("c"))  # shards * RANGES * (SUBS + 2) rows at most
    before = sizes.select(*bucket, (F.sum("c").over(W.partitionBy("queue").orderBy(*bucket[1:])) - F.col("c")).alias("before"))
    ranked = labelled.join(F.broadcast(before), bucket).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(*bucket).orderBy("key", "salt", "id")) - 1)
    placed = ranked.join(F.broadcast(way), "queue").withColumn("at", F.element_at(F.filter("way", lambda w: w["start"] <= F.col("rank")), -1))
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("at.shard").alias("shard"),
        (F.col("at.base") + F.col("rank") - F.col("at.start")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
