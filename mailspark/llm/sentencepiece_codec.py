"""SentencePiece BPE ids by a prefix table, and their text again.

In BPE every prefix of a text has exactly one last token: the one that is
compatible with the last token of what precedes it, that is, encoding the two
tokens' joined text gives back just these two.  One pass over the automaton's
matches fills the table of last tokens, and the ids are read off backwards.
Pieces merge by type (any two neighbours whose joined text is a piece, best
score first, leftmost first), so a pair's compatibility is tested by merging
its few characters once and remembered.  No piece has a space mark after
another character, so a text is cut before space marks and at characters that
no longer piece holds; tables of words already seen are kept within a bound.

Defined results: a null text counts as empty (its ids are the end id alone);
characters without a piece become their UTF-8 bytes' ids; the text may be of
any length; repeated rows and ids are encoded one by one; other columns are
carried through, those named like a result column give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from mailspark.llm.storage import fresh

SPACE = "▁"
WORDS_KEPT, PAIRS_KEPT = 250_000, 600_000
NEVER = float("-inf")


def load_vocabulary(path: str) -> dict:
    """The vocabulary file's pieces as plain values (a fixed, small size), read with the library's own reader."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "piece"
    return {"pieces": [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in ids], "end": model.eos_id(), "unknown": model.unk_id()}


class PrefixTable:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.rows = vocabulary["pieces"]
        self.end = vocabulary["end"]
        self.unknown = vocabulary["unknown"]
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.rows) if kind == "piece"}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.rows) if kind == "byte"}
        self.byte_values = {i: b for b, i in self.byte_ids.items()}
        self.score = {p: s for p, s, kind in self.rows if kind == "piece"}
        self.numbers = {p: str(i) for p, i in self.ids.items()}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.pairs_kept = 0
        self.words: dict[str, tuple[str, int, str]] = {}
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:
                self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in inside)
        self.segment = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The merges themselves; used on single tokens and pairs only."""
        parts, score = list(text), self.score
        scores = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score.get(parts[i] + parts[i + 1], NEVER)
            if i:
                scores[i - 1] = score.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def followers(self, left: str) -> dict[str, bool]:
        """What is known of the tokens that may stand right of ``left``."""
        known = self.pairs.get(left)
        if known is None:
            known = self.pairs[left] = {}
        return known

    def compatible(self, left: str, right: str) -> bool:
        self.pairs_kept += 1
        if self.pairs_kept > PAIRS_KEPT:
            for known in self.pairs.values():
                known.clear()
            self.pairs_kept = 0
        found = self.followers(left)[right] = self.merged(left + right) == [left, right]
        return found

    def tokens(self, text: str) -> list[str]:
        """The tokens of one segment (a piece each, or a character without one)."""
        last = [""] * (len(text) + 1)
        after: list[dict[str, bool] | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, piece in self.matches.iter(text):
            end += 1
            if last[end]:
                continue
            start = end - len(piece)
            if start:
                known = after[start]
                if known is None:
                    before = last[start]
                    if not before:  # a character at which no piece ends
                        before = last[start] = text[start - 1]
                    known = pairs.get(before)
                    if known is None:
                        known = self.followers(before)
                    after[start] = known
                fits = known.get(piece)
                if fits is None:
                    fits = self.compatible(last[start], piece)
                if not fits:
                    continue
            last[end] = piece
        out, end = [], len(text)
        while end:
            token = last[end] or text[end - 1]
            out.append(token)
            end -= len(token)
        out.reverse()
        return out

    def ids_of(self, tokens: list[str]) -> list[int]:
        out = []
        for token in tokens:
            piece = self.ids.get(token)
            if piece is not None:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in token.encode()]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; runs of byte ids are joined first.  ``first``: a leading space mark is the added one."""
        out, run = [], bytearray()

        def flush() -> None:
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as bad:
                    out.append(run[: bad.start].decode() + "�")
                    del run[: bad.start + 1]

        for i in ids:
            if i in self.byte_values:
                run.append(self.byte_values[i])
                continue
            flush()
            piece, _, kind = self.rows[i]
            if kind == "piece":
                if first and not out and piece.startswith(SPACE):
                    piece, first = piece[1:], False
                out.append(piece.replace(SPACE, " "))
            elif kind == "unknown":
                out.append(" ⁇ ")
        flush()
        return "".join(out)

    def word(self, word: str) -> tuple[str, int, str]:
        """(ids, how many, their text) of one segment."""
        tokens = self.tokens(word)
        try:
            numbers = [self.numbers[t] for t in tokens]
            return " ".join(numbers), len(numbers), "".join(tokens).replace(SPACE, " ")
        except KeyError:  # a character that becomes bytes
            ids = self.ids_of(tokens)
            return " ".join(map(str, ids)), len(ids), self.decode(ids, first=False)

    def codec(self, text: str | None) -> tuple[str, int, str]:
        """(decimal ids joined by one space, with the end id; how many; the ids' text)."""
        if not text:
            return str(self.end), 1, ""
        ids, count, decoded = [], 1, []
        words = self.words
        for word in self.segment.findall(SPACE + text.replace(" ", SPACE)):
            known = words.get(word)
            if known is None:
                known = self.word(word)
                if len(word) <= 64:
                    if len(words) >= WORDS_KEPT:
                        words.clear()
                    words[word] = known
            ids.append(known[0])
            count += known[1]
            decoded.append(known[2])
        ids.append(str(self.end))
        return " ".join(ids), count, "".join(decoded)[1:]


_TABLES: dict[int, PrefixTable] = {}


def table_of(vocabulary: dict) -> PrefixTable:
    """One table for each Python worker and vocabulary."""
    key = hash((len(vocabulary["pieces"]), *vocabulary["pieces"][-50:], vocabulary["end"]))
    if key not in _TABLES:
        _TABLES[key] = PrefixTable(vocabulary)
    return _TABLES[key]


def _encoder(vocabulary: Callable[[], dict], at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(vocabulary())
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = [table.codec(t) for t in batch.column(at).to_pylist()]
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(batch.columns + more, names=[*batch.schema.names, "_ids", "_n_tokens", "_decoded"])

    return run


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all, unless given) with _ids (decimal ids joined by a space), _n_tokens and _decoded."""
    columns = [c for c in (columns if columns is not None else docs.columns) if c.lower() not in ("_ids", "_n_tokens", "_decoded")]
    (sent_text,) = fresh([*columns, "_ids", "_n_tokens", "_decoded"], "text")
    sent = docs.select(*[docs[f"`{c}`"] for c in columns], docs[text_col].alias(sent_text))
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema)
    out = sent.mapInArrow(_encoder(lambda: shared.value, len(columns)), f"{schema}, _ids string, _n_tokens bigint, _decoded string")
    return out.drop(sent_text)
