"""Cross-tokenizer alignment against a plain reading of the rules with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mailspark.llm import queries, token_alignment

FOLDER = "/root/testdata/sf0.001"
PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def brute(texts):
    a_coder, b_coder = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_coder.encode_special_tokens = True
    letters = {}
    other = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(other)] = b
            other += 1
    a_bytes = {i: bytes(letters[c] for c in s) for s, i in a_coder.get_vocab().items() if s != "<|endoftext|>"}
    found = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        b_raw = [(lambda s: bytes([int(s[3:5], 16)]) if b_coder.is_byte(i) else s.replace("▁", " ").encode())(b_coder.id_to_piece(i)) for i in b]
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_raw) != raw:
            found.append((0, 0, "", []))
            continue
        ends = []
        for lengths in ([len(a_bytes[i]) for i in a], [len(x) for x in b_raw]):
            at, out = 0, []
            for n in lengths:
                at += n
                out.append(at)
            ends.append(out)
        groups, links = [], []
        i = j = 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = i, j
            while ends[0][i] < cut:
                i += 1
            while ends[1][j] < cut:
                j += 1
            i, j = i + 1, j + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.append((a[i - 1], b[j - 1]))
        found.append((len(a), len(b), ";".join(groups), links))
    counts = Counter(p for f in found for p in f[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(na, nb, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), groups) for na, nb, groups, links in found]


AWKWARD = [None, "", " ", "a", "  two  spaces ", "▁mark", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve Ünïcödé 中文字 🙂🙃 ​́", "tab\tnew\nline\r\n", "\x00\x01", "x" * 3000, "aaaa aaaa", "don't I'll", "1234567890 12 345", "a", "ﬁ ㎏ Ⅷ"]


def as_rows(df, *names):
    return sorted(((r[names[0]],) + tuple(r[n] for n in names[1:]) for r in df.collect()), key=str)


def test_operator_on_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "STEP", 40)
    docs = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string").repartition(3)
    got = as_rows(token_alignment.align(docs, *PATHS, columns=["doc_id"]), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert got == sorted(((i, *w) for i, w in enumerate(brute(AWKWARD))), key=str)


def test_query_on_all_documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for r, w in zip(rows, brute([r.text for r in rows]))]
    assert as_rows(queries.op11_alignment(spark, FOLDER), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == sorted(want, key=str)


def test_edge_cases(spark):
    long = "word and " * 120_000
    docs = spark.createDataFrame([(None, "a b", 7, 1), (1, "a b", 7, 2), (1, "a b", 7, 2), (2, long, None, None)], "doc_id long, text string, n_a int, align_pairs int")
    got = token_alignment.align(docs, *PATHS).collect()
    assert docs.columns[:2] + ["align_pairs"] == [c for c in got[0].asDict()][:3]
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert len(by_id[1]) == 2 and by_id[1][0] == by_id[1][1] and by_id[None][0].n_a == 2 and by_id[2][0].n_groups == by_id[2][0].n_links > 200_000
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_possible_pairs_cover_what_can_end_together():
    a, b = [b"he", b"the", b"", b"x"], [b" the", b"e", b"y", b"he"]
    assert [divmod(int(k), 4) for k in token_alignment.possible_pairs(a, b)] == [(0, 0), (0, 1), (0, 3), (1, 0), (1, 1), (1, 3)]


def test_a_word_that_comes_again_is_encoded_once(monkeypatch):
    aligner = token_alignment.Aligner(*PATHS)
    sent = []
    for side in aligner.sides:
        monkeypatch.setattr(side, "encode", lambda texts, encode=side.encode: sent.extend(texts) or encode(texts))
    for _ in range(3):
        got = aligner.align(["the same words again " * 500 + "end", "words again"], True)
    assert sorted(sent) == sorted(["the", "same", "words", "again", "end"] * 2)
    assert [tuple(got[k][i].as_py() for k in ("n_a", "n_b", "n_groups", "n_links", "groups")) for i in range(2)] == [(w[0], w[1], w[2], w[3], w[6]) for w in brute(["the same words again " * 500 + "end", "words again"])]


@pytest.mark.parametrize("kept", [12_000_000, 3_000, 0])
def test_words_against_whole_texts(kept, monkeypatch):
    """Cut texts, with words dropped on the way or not, give what whole texts give, whatever white space and signs stand together."""
    monkeypatch.setattr(token_alignment, "KEPT", kept)
    draw = random.Random(11)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\u200b", "\u180e", "\x1c", "\x85", "\ufeff", "word", "Ünï", "中文", "🙂", "12", "'s", "'", "...", "|", "<s>", "<|endoftext|>", "e\u0301", "\x00", "▁"]
    texts = ["".join(draw.choices(parts, weights=[4] * 3 + [1] * (len(parts) - 4) + [0.5], k=draw.randint(1, 40))) for _ in range(600)] + AWKWARD
    cut, uncut = token_alignment.Aligner(*PATHS), token_alignment.Aligner(*PATHS)
    uncut.by_words = False
    want = brute(texts)
    assert cut.by_words and 100 < sum(w[0] > 0 for w in want) < len(texts) - 50
    for low in range(0, len(texts), 50):
        found = [a.align(texts[low : low + 50], True) for a in (cut, uncut)]
        assert all(found[0][k].equals(found[1][k]) for k in found[0])
        assert [tuple(found[0][k][i].as_py() for k in ("n_a", "n_b", "n_groups", "n_links", "groups")) for i in range(len(found[0]["n_a"]))] == [(w[0], w[1], w[2], w[3], w[6]) for w in want[low : low + 50]]


def test_dropped_words_are_the_ones_met_least(monkeypatch):
    aligner = token_alignment.Aligner(*PATHS)
    monkeypatch.setattr(token_alignment, "KEPT", 200)
    aligner.align(["one two two three three three four"], True)
    aligner._drop_rare()
    assert list(aligner.words) == ["three", "two"] and aligner.groups == [w[6] for w in brute(["three", "two"])]
    assert aligner.align(["two three"], True)["groups"].to_pylist() == [brute(["two three"])[0][6]]
    monkeypatch.setattr(token_alignment, "KEPT", 10)
    aligner._drop_rare()
    assert not aligner.words and not aligner.groups and not len(aligner.links)
