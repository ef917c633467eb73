"""Conversation structure repair by a dynamic program streamed over secondary-sorted turns.

Turns are dealt out by conversation and sorted by turn within it, so that one
pass meets each conversation's rows in order, across Arrow batches.  Of what went
before, the pass keeps the cheapest way into each of four states (nothing yet, a
system turn, a user turn, an assistant turn) and one byte of backpointer for each
state and row.  Each row's edits are a word of the prefix-free form ``I*(D|K|R)``,
so equal costs are decided by the order of the four ways so far and then by the
word alone.  When a conversation ends, the backpointers are read from the end,
and its rows are replayed with their edits.  Backpointers, rows and the digests of texts
seen stay in memory while small; a giant conversation's go to temporary files of
its task, so memory doesn't grow with it (but for the audit, one letter an edit).

Edits: keep (0), rerole to user or assistant (2), delete (3; the only one for
blank and duplicate rows), insert an empty user or assistant turn (2); a
truncated row that isn't deleted costs 1 more.  The result's role initials match
``(s?(ua)+)?``.

Defined results: a null role or text counts as one space; null turns come first and aren't
counted in gaps; rows of equal turn are ordered by role and text; a null
conversation id is a conversation; other roles than the three can only be
reroled or deleted; extra columns aren't carried; a conversation without rows that
are ``present`` is reported with zeros; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after an inserted or reroled turn.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Words of edits for one row, in ASCII order; a backpointer is 4 * place + state before.
WORDS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
PLACE = {w: i for i, w in enumerate(WORDS)}
DEAD = 255
#: Bytes of rows or backpointers of a conversation, and digests, that stay in memory.
IN_MEMORY, DIGESTS = 1 << 23, 1 << 17
BLANK, FULL_STOP = re.compile(r"[^\x20\x09-\x0D]"), ".!?"


def _inserted(state: int) -> Iterator[tuple[str, int, int]]:
    """No insert, one, or two: the letters, what they cost and the state after them.  More never pay."""
    yield "", 0, state
    one = NEXT[state]
    yield "I", INSERT, one
    if state in (START, SYSTEM):
        yield "II", 2 * INSERT, NEXT[one]


#: For each state: (place of the word, cost, state after), by what the row allows.
def _moves(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, int]]]:
    moves: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    for state in range(4):
        for letters, cost, at in _inserted(state):
            moves[state].append((PLACE[letters + "D"], cost + DELETE, at))
            if must_go:
                continue
            moves[state].append((PLACE[letters + "R"], cost + REROLE + truncated * TRUNCATED, NEXT[at]))
            role = INITIAL.get(initial)
            if role is not None and (role == NEXT[at] or (role == SYSTEM and at == START)):
                moves[state].append((PLACE[letters + "K"], cost + KEEP + truncated * TRUNCATED, role))
    return moves


MOVES = {(i, g, t): _moves(i, g, t) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}


class _Seen:
    """Digests of the turns so far; beyond a bound in a temporary database."""

    def __init__(self) -> None:
        self.kept: set[bytes] = set()
        self.base: sqlite3.Connection | None = None

    def add(self, role: str, text: str) -> bool:
        """Whether the turn was new."""
        name = role.encode("utf-8", "surrogatepass")
        digest = hashlib.blake2b(b"%d:%b%b" % (len(name), name, text.encode("utf-8", "surrogatepass")), digest_size=16).digest()
        if self.base is None:
            if digest in self.kept:
                return False
            self.kept.add(digest)
            if len(self.kept) >= DIGESTS:
                self.base = sqlite3.connect("")  # a private file, deleted when closed
                self.base.execute("CREATE TABLE seen (digest BLOB PRIMARY KEY) WITHOUT ROWID")
                self.base.executemany("INSERT INTO seen VALUES (?)", ((d,) for d in self.kept))
                self.kept.clear()
            return True
        return self.base.execute("INSERT OR IGNORE INTO seen VALUES (?)", (digest,)).rowcount == 1

    def close(self) -> None:
        if self.base is not None:
            self.base.close()


class Conversation:
    """One conversation's rows in order: counts, the program's four ways, and its spools."""

    def __init__(self, key: int | None) -> None:
        self.key, self.n = key, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.before = None
        self.turns = 0
        self.ways: list[tuple[int, int] | None] = [(0, 0), None, None, None]  # cost, order among the ways
        self.seen = _Seen()
        self.back, self.rows = tempfile.SpooledTemporaryFile(IN_MEMORY), tempfile.SpooledTemporaryFile(IN_MEMORY)

    def add(self, turn: int | None, role: str, text: str) -> None:
        words = BLANK.search(text)
        blank = words is None
        again = not blank and not self.seen.add(role, text)
        cut = not blank and not again and text.rstrip(" \t\n\v\f\r")[-1] not in FULL_STOP
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + cut
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.n:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.n += 1
        self._step(MOVES[initial if initial in INITIAL else "", blank or again, cut])
        pickle.dump((turn, role, text), self.rows, protocol=5)

    def _step(self, moves: list[list[tuple[int, int, int]]]) -> None:
        best: list[tuple[int, int, int, int] | None] = [None] * 4  # cost, order of the way before, word, state before
        for state, way in enumerate(self.ways):
            if way is not None:
                for word, cost, after in moves[state]:
                    found = (way[0] + cost, way[1], word, state)
                    if best[after] is None or found < best[after]:
                        best[after] = found
        order = {p: i for i, p in enumerate(sorted(b[1:3] for b in best if b))}
        self.ways = [b and (b[0], order[b[1:3]]) for b in best]
        self.back.write(bytes(DEAD if b is None else 4 * b[2] + b[3] for b in best))

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns

    def finish(self) -> tuple[int, str]:
        """The least cost, and its edits in order."""
        ends = [(way[0] + cost, way[1], letters, state) for state, way in enumerate(self.ways) if way for letters, cost, at in _inserted(state) if at in (ASSISTANT, START)]
        cost, _, letters, state = min(ends)
        words = [letters]
        step = 1 << 16  # rows read at once, from the end
        for high in range(self.n, 0, -step):
            low = max(0, high - step)
            self.back.seek(4 * low)
            block = self.back.read(4 * (high - low))
            for row in range(high - low - 1, -1, -1):
                code = block[4 * row + state]
                words.append(WORDS[code >> 2])
                state = code & 3
        words.reverse()
        return cost, "".join(words)

    def replay(self, audit: str) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) in order; deleted turns keep what they held."""
        self.rows.seek(0)
        state = START
        for edit in audit:
            turn, role, text = (None, "", "") if edit == "I" else pickle.load(self.rows)
            if edit != "D":
                state = INITIAL[role[0]] if edit == "K" else NEXT[state]
                role = role if edit == "K" else ROLE[state]
            yield edit, turn, role, text

    def close(self) -> None:
        self.seen.close()
        self.back.close()
        self.rows.close()


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Each conversation when its last row has come, whatever batches it spans; it is closed when the next is asked for."""
    held: Conversation | None = None
    for batch in batches:
        for key, turn, role, text, present in zip(batch["key"], batch["turn"], batch["role"], batch["text"], batch["present"]):
            key = None if key is None else int(key)
            if held is None or held.key != key:
                if held is not None:
                    yield held
                    held.close()
                held = Conversation(key)
            if present:
                held.add(None if turn is None else int(turn), role, text)
    if held is not None:
        yield held
        held.close()


ROWS = 4096
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, pos long, edit string, turn long, role string, text string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    return pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="Int64" if k == "long" else "object") for i, (n, k) in enumerate(zip(names, kinds))})


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for c in _conversations(batches):
        cost, audit = c.finish()
        digest, first = hashlib.sha256(), True
        for edit, _, role, text in c.replay(audit):
            if edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        out.append((c.key, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, audit, digest.hexdigest()))
        if len(out) >= ROWS:
            yield _frame(out, REPORT)
            out = []
    yield _frame(out, REPORT)


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, size = [], 0
    for c in _conversations(batches):
        pos = 0
        for edit, turn, role, text in c.replay(c.finish()[1]):
            out.append((c.key, None if edit == "D" else pos, edit, turn, role, text))
            pos += edit != "D"
            size += len(text)
            if len(out) >= ROWS or size > IN_MEMORY:
                yield _frame(out, TURNS)
                out, size = [], 0
    yield _frame(out, TURNS)


def _sorted(turns: DataFrame) -> DataFrame:
    """Rows dealt out by conversation and in order; absent rows only name their conversation."""
    blank = F.lit(" ")
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in turns.columns else F.lit(True)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("key"), F.col("turn").cast("long").alias("turn"), F.when(present, F.coalesce("role", blank)).alias("role"), F.when(present, F.coalesce("text", blank)).alias("text"), present.alias("present"),
    )
    ordered = rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")
    # pandas would make floats of whole numbers with nulls
    return ordered.select(F.col("key").cast("string").alias("key"), F.col("turn").cast("string").alias("turn"), "role", "text", "present")


def report(turns: DataFrame) -> DataFrame:
    """Per conversation: faults, least cost, its edits, and the digest of the repaired turns (``role:text``, a line each).

    ``turns`` has conv_id, turn, role, text and may have ``present``: false for
    rows that only tell that the conversation exists.
    """
    return _sorted(turns).mapInPandas(_report, REPORT)


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations' turns: place (null if deleted), edit, the turn number it had, role and text."""
    return _sorted(turns).mapInPandas(_turns, TURNS)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (``present`` is false), 1 empties
    its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.  A null counts as one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    rows = rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fault != 0).alias("present"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")
