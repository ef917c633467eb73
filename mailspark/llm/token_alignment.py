"""Alignment of two tokenizers' tokens by coalescing their byte intervals.

Both tokenizers' tokens of many texts are laid out as byte intervals on one axis
and lexsorted by start; the running maximum of the ends (``maximum.accumulate``)
tells where groups break: at a start that has reached it.  Within a group,
overlapping tokens are expanded pair by pair; those that end together are links.

Where both vocabularies allow it, texts are cut before single spaces that stand
between two characters other than white space: side A's pattern starts a new
token there, and no piece of side B holds a space after another character, so
both sides' tokens end there in any text, and neither groups nor links cross.
A word that comes again is then looked up instead of being aligned again.  A
worker knows words within a bound: beyond it, the half that was met least goes.

A pair can only end together if one token's bytes are a suffix of the other's.
So the pairs that can occur follow from the two vocabularies alone: they are
numbered once, counts over the corpus are vectors of that length, summed within
tasks before any shuffle, and the broadcast of the sums is bounded by the
vocabularies, whatever the corpus.

Defined results: texts that are null or empty, or whose tokens' bytes don't give
the text back in both vocabularies, have no tokens (zeros, no groups); special
tokens' strings are plain text; texts may be of any length and are encoded whole;
repeated rows count as often as they stand; other columns are carried through, those
named like a result column give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import fresh, stash

#: Text bytes that one numpy step takes (a longer text is a step of its own).
STEP = 1 << 21
#: Characters of known words (each counted with WORD more for its entries) beyond which words are dropped.
KEPT, WORD = 16_000_000, 50
A, B = 0, 1
BETWEEN = re.compile(r" (?<=\S )(?=\S)")


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes as."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE, which reads space + text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        before = plan.get("pre_tokenizer") or {}
        self.by_words = not plan.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece BPE, which adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            self.pieces.append(bytes([int(piece[1:-1], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode())
        self.by_words = not any(b" " in piece.lstrip(b" ") for piece in self.pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys ``a_id * len(b) + b_id`` of all pairs of which one's bytes end with the other's."""
    by_bytes: tuple[dict, dict] = ({}, {})
    for side, pieces in enumerate((a, b)):
        for i, piece in enumerate(pieces):
            if piece:
                by_bytes[side].setdefault(piece, []).append(i)
    keys = set()
    for i, piece in enumerate(a):
        for start in range(len(piece)):
            keys.update(i * len(b) + j for j in by_bytes[B].get(piece[start:], ()))
    for j, piece in enumerate(b):
        for start in range(len(piece)):
            keys.update(i * len(b) + j for i in by_bytes[A].get(piece[start:], ()))
    return np.array(sorted(keys), dtype=np.int64)


class Aligner:
    """Both tokenizers, their tables, the words aligned so far, and the alignment of batches of texts; made once in each Python worker."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str) -> None:
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        self.lengths = tuple(np.array([len(p) for p in s.pieces], dtype=np.int64) for s in self.sides)
        self.pairs = possible_pairs(self.sides[A].pieces, self.sides[B].pieces)
        self.b_of_pair = self.pairs % len(self.sides[B].pieces)
        # each id's decimals with what follows: another token of its side, or the end of its side in the group
        self.written = tuple(tuple(np.array([f"{i}{mark}" for i in range(len(s.pieces))], dtype=object) for mark in (",", end)) for s, end in zip(self.sides, "|;"))
        self.by_words = all(s.by_words for s in self.sides)
        self._forget()

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Aligner:
        if paths not in cls._made:
            cls._made[paths] = cls(*paths)
        return cls._made[paths]

    def _forget(self) -> None:
        """No word is known: their numbers, counts (n_a, n_b, n_groups, n_links), groups in writing, linked pairs one after another, uses, and size."""
        self.words: dict[str, int] = {}
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.groups: list[str] = []
        self.links = np.zeros(0, dtype=np.int32)
        self.uses = np.zeros(0, dtype=np.int64)
        self.kept = 0

    def _drop_rare(self) -> None:
        """Keeps the half of the known words that was met most; none if these alone are beyond the bound."""
        stay = np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2]
        names = list(self.words)
        self.links = self.links[self._places(stay)]
        self.counts, self.uses = self.counts[stay], self.uses[stay] // 2
        stay = stay.tolist()
        self.groups = [self.groups[k] for k in stay]
        self.words = {names[k]: i for i, k in enumerate(stay)}
        self.kept = sum(map(len, self.words)) + WORD * len(stay)
        if self.kept > KEPT:
            self._forget()

    def _places(self, number: np.ndarray) -> np.ndarray:
        """Where in ``links`` these words' links stand, word by word."""
        width = self.counts[number, 3]
        first = (np.cumsum(self.counts[:, 3]) - self.counts[:, 3])[number]
        return np.arange(width.sum()) + np.repeat(first - (np.cumsum(width) - width), width)

    def _whole(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids; none where the bytes don't give back space + word."""
        coded = [s.encode(words) for s in self.sides]
        raws = [b" " + w.encode("utf-8") for w in words]
        joined, sizes = b"".join(raws), [len(r) for r in raws]
        if any(b"".join(map(s.pieces.__getitem__, chain.from_iterable(c))) != joined for s, c in zip(self.sides, coded)) or any(self._sizes(side, coded[side]) != sizes for side in (A, B)):
            for k, raw in enumerate(raws):
                if not all(b"".join([s.pieces[x] for x in c[k]]) == raw for s, c in zip(self.sides, coded)):
                    coded[A][k] = coded[B][k] = []
        return coded[A], coded[B]

    def _sizes(self, side: int, ids: list[list[int]]) -> list[int]:
        """How many bytes each word's tokens have."""
        upto = np.cumsum([0, *map(len, ids)])
        total = np.concatenate(([0], np.cumsum(self.lengths[side][np.fromiter(chain.from_iterable(ids), dtype=np.int64)])))
        return (total[upto[1:]] - total[upto[:-1]]).tolist()

    def _learn(self, words: list[str]) -> None:
        """Aligns words that aren't known yet."""
        n, ids = len(words), self._whole(words)
        flat = [np.fromiter(chain.from_iterable(side), dtype=np.int64) for side in ids]
        count = [np.array([len(one) for one in side], dtype=np.int64) for side in ids]
        word = [np.repeat(np.arange(n), c) for c in count]
        # one axis for all words, since each covers the same bytes on both sides
        end = [np.cumsum(length[f]) for length, f in zip(self.lengths, flat)]
        start = [e - length[f] for e, length, f in zip(end, self.lengths, flat)]
        starts, ends, side = np.concatenate(start), np.concatenate(end), np.repeat([A, B], [len(flat[A]), len(flat[B])])
        order = np.lexsort((side, starts))
        breaks = np.ones(len(order), dtype=bool)
        breaks[1:] = starts[order][1:] >= np.maximum.accumulate(ends[order])[:-1]
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(breaks) - 1
        n_groups = np.bincount(np.concatenate(word)[order][breaks], minlength=n)
        at_a, pair = self._linked(start, end, flat)
        n_links = np.bincount(word[A][at_a], minlength=n)
        self.words.update(zip(words, range(len(self.words), len(self.words) + n)))
        self.counts = np.concatenate([self.counts, np.stack([*count, n_groups, n_links], axis=1)])
        self.groups += self._written(flat, count, (group[: len(flat[A])], group[len(flat[A]) :]))
        self.links = np.concatenate([self.links, pair.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(n, dtype=np.int64)])
        self.kept += sum(map(len, words)) + WORD * n

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' words, and how many words each text has (null and empty ones none)."""
        if self.kept > KEPT:
            self._drop_rare()
        cut = BETWEEN.split if self.by_words else lambda text: [text]
        parts = [cut(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        if unknown := [w for w in dict.fromkeys(flat) if w not in self.words]:
            self._learn(unknown)
        number = np.fromiter(map(self.words.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.uses += np.bincount(number, minlength=len(self.uses))
        return number, np.array([len(part) for part in parts], dtype=np.int64)

    def align(self, texts: list[str | None], written: bool) -> dict[str, pa.Array]:
        """For each text: its tokens on both sides, its groups (in writing, or their digest) and links, its linked pairs (numbers in ``pairs``) and how often each stands."""
        n = len(texts)
        number, size = self._numbers(texts)
        doc = np.repeat(np.arange(n), size)
        # a word without tokens takes its whole text's
        whole = np.bincount(doc[self.counts[number, 0] == 0], minlength=n) == 0
        number, doc, size = number[whole[doc]], doc[whole[doc]], size * whole
        counts = self.counts[number]
        upto = np.concatenate(([0], np.cumsum(size)))
        sums = np.concatenate((np.zeros((1, 4), dtype=np.int64), np.cumsum(counts, axis=0)))[upto]
        n_a, n_b, n_groups, n_links = (sums[1:] - sums[:-1]).T
        keys, times = np.unique(np.repeat(doc, counts[:, 3]) * len(self.pairs) + self.links[self._places(number)], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(n + 1) * len(self.pairs))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
        number, upto = number.tolist(), upto.tolist()
        groups = (";".join(map(self.groups.__getitem__, number[i:j])) for i, j in zip(upto, upto[1:]))
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links),
            "groups": pa.array(list(groups) if written else [sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()), "pairs": lists(keys % len(self.pairs)), "times": lists(times),
        }

    def _linked(self, start: list, end: list, flat: list) -> tuple[np.ndarray, np.ndarray]:
        """For each link its A token's place and its pair: overlapping tokens are expanded, those that end together stay."""
        low, high = np.searchsorted(end[B], start[A], "right"), np.searchsorted(start[B], end[A], "left")
        width = high - low
        at_a = np.repeat(np.arange(len(flat[A])), width)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        together = end[A][at_a] == end[B][at_b]
        at_a, at_b = at_a[together], at_b[together]
        return at_a, np.searchsorted(self.pairs, flat[A][at_a] * len(self.sides[B].pieces) + flat[B][at_b])

    def _written(self, flat: list, count: list, group: tuple) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each word."""
        token = [[], []]
        for side in (A, B):
            last = np.ones(len(flat[side]), dtype=bool)  # of its side in its group
            last[:-1] = group[side][1:] != group[side][:-1]
            token[side] = np.where(last, self.written[side][1][flat[side]], self.written[side][0][flat[side]])
        order = np.lexsort((np.repeat([A, B], [len(flat[A]), len(flat[B])]), np.concatenate(group)))
        ordered = np.concatenate(token)[order].tolist()
        cuts = np.concatenate(([0], np.cumsum(count[A] + count[B]))).tolist()
        return ["".join(ordered[i:j])[:-1] for i, j in zip(cuts, cuts[1:])]


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about STEP characters."""
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= STEP:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", columns: list[str] | None = None, written: bool = True) -> DataFrame:
    """``columns`` (all by default) and, for each row: n_a, n_b, n_groups, n_links, the groups as ``a1,a2|b1;...`` (or their SHA-256), n_best (links
    whose pair is its B token's most frequent in the corpus) and count_sum (of the links' pairs' counts in the corpus)."""
    spark, paths = docs.sparkSession, (a_path, b_path)
    carried = [c for c in (docs.columns if columns is None else columns) if c.lower() not in RESULT]
    text, pairs, times = fresh(carried, "align_text", "align_pairs", "align_times")
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    kinds += ", " if kinds else ""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Aligner.of(paths)
        for batch in batches:
            texts = batch.column(len(carried)).to_pylist()
            for low, high in _steps(texts):
                found = tables.align(texts[low:high], written)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in range(len(carried))), *found.values()], names=[*carried, "n_a", "n_b", "n_groups", "n_links", "groups", pairs, times])

    coded = stash(rows.mapInArrow(first, f"{kinds}n_a long, n_b long, n_groups long, n_links long, groups string, `{pairs}` array<int>, `{times}` array<int>"), "aligned")
    counts, best = _counts(coded.select(pairs, times), paths)
    known = spark.sparkContext.broadcast((counts, best))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = known.value
        for batch in batches:
            held = batch.column(batch.num_columns - 2)
            cuts = held.offsets.to_numpy() - held.offsets[0].as_py()
            pair, time = held.flatten().to_numpy(), batch.column(batch.num_columns - 1).flatten().to_numpy().astype(np.int64)
            sums = [np.concatenate(([0], np.cumsum(time * x[pair]))) for x in (best, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(s[cuts[1:]] - s[cuts[:-1]]) for s in sums)], names=[*batch.schema.names[:-2], "n_best", "count_sum"])

    return coded.mapInArrow(second, f"{kinds}n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")


def _counts(linked: DataFrame, paths: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """How many links hold each possible pair, and whether (1 or 0) that is the most of all pairs with its B token.

    The result is as long as the list of possible pairs, which the vocabularies bound.
    """
    tables = Aligner.of(paths)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(Aligner.of(paths).pairs), dtype=np.int64)
        for batch in batches:
            pair, time = (batch.column(i).flatten().to_numpy() for i in range(2))
            total += np.bincount(pair, weights=time, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = linked.mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(tables.pairs), dtype=np.int64)
    counts[rows["pair"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    most = np.zeros(len(tables.sides[B].pieces), dtype=np.int64)
    np.maximum.at(most, tables.b_of_pair, counts)
    return counts, (counts == most[tables.b_of_pair]).astype(np.int64)
