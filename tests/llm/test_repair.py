"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from mailspark.llm import conversation_repair as cr
from mailspark.llm import queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.strip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All ways of editing in order of (cost, edits); the first that gives the wanted roles."""
    kinds = faults(rows)
    heap, known = [(0, "", 0, "", ())], set()
    done = None
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if done and cost > done[0]:
            break
        if (i, roles, cost, audit) in known or not re.fullmatch("s?(ua)*u?", roles):
            continue
        known.add((i, roles, cost, audit))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            done = min(done or (cost, audit, out), (cost, audit, out))
            continue
        for r, name in NAMES.items():
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + r, (*out, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            more = kinds[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            if kinds[i] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + (role[:1] or "-"), (*out, f"{role}:{text}")))
                for r, name in NAMES.items():
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + r, (*out, f"{name}:{text}")))
    return done


def brute(rows):
    """The report's columns for one conversation; rows of (turn, role, text, present)."""
    left = sorted(((t is not None, t or 0, r, x) for t, r, x, there in rows if there))
    turns = [t for given, t, _, _ in left if given]
    talk = [(r, x) for _, _, r, x in left]
    kinds = faults(talk)
    cost, audit, out = cheapest(talk)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def harmed(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text, fault != 0)] * (2 if fault == 3 else 1)
    return out


def test_query_on_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, FOLDER).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {c: brute(x) for c, x in harmed(rows).items()} and len(got) == len({r[0] for r in rows})


def test_random_conversations(spark, monkeypatch):
    """Many faults, ties, nulls and odd roles; with and without spilling, over batches of three rows."""
    rnd, rows = random.Random(5), []
    for conv in [None, *range(150)]:
        for _ in range(rnd.randint(1, 7)):
            rows.append((conv, rnd.choice([None, *range(9)]), rnd.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rnd.choice(["hi.", "yo!", "cut", "", " \t", "q? ", None, "é ", "x\ny."])))
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {c: brute(x) for c, x in harmed(rows).items()}
    monkeypatch.setattr(cr, "IN_MEMORY", 16)
    monkeypatch.setattr(cr, "DIGESTS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r[0]: tuple(r)[1:] for r in cr.report(cr.damaged(turns)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    talk = defaultdict(list)
    for r in cr.repair(cr.damaged(turns)).collect():
        if r.edit != "D":
            talk[r.conv_id].append((r.pos, f"{r.role}:{r.text}"))
    assert {c: hashlib.sha256("\n".join(t for _, t in sorted(v)).encode()).hexdigest() for c, v in talk.items()} == {c: w[-1] for c, w in want.items() if w[-1] != EMPTY}


@pytest.mark.parametrize("low", [True, False])
def test_giant_conversation(low, monkeypatch):
    """Backpointers, rows and digests in files give what memory gives."""
    if low:
        monkeypatch.setattr(cr, "IN_MEMORY", 1000)
        monkeypatch.setattr(cr, "DIGESTS", 100)
    talk = cr.Conversation(1)
    rnd = random.Random(1)
    for i in range(200_000):
        talk.add(i, "user" if i % 2 == 0 else "assistant", f"t{i if rnd.random() < 0.99 else 0}.")
    assert (talk.back._rolled, talk.seen.base is not None) == (low, True)
    cost, audit = talk.finish()
    kept = [r for e, _, r, _ in talk.replay(audit) if e != "D"]
    assert audit.count("D") >= talk.duplicate > 1000 and kept == ["user", "assistant"] * (len(kept) // 2)
    assert cost == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R"))


def test_edge_cases(spark):
    assert cr.report(spark.createDataFrame([], SCHEMA)).collect() == []
    big = 2**60 + 1
    rows = [(big, big, "user", "Hi.", 1), (big, big + 1, "assistant", "Yes. " * 200_000, 1), (None, None, None, None, 2)]
    got = {r[0]: tuple(r)[1:] for r in cr.report(spark.createDataFrame(rows, SCHEMA + ", cost int")).collect()}
    assert got[big][:7] == (0, 0, 0, 0, 0, 0, "KK") and got[None] == (0, 1, 0, 0, 0, 3, "D", EMPTY)
    absent = spark.createDataFrame([(1, 1, "user", "a", False)], SCHEMA + ", present boolean")
    assert [tuple(r) for r in cr.report(absent).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", EMPTY)]
