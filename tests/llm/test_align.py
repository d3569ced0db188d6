"""Cross-tokenizer alignment against an alignment of whole texts by the libraries, byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "   ", "a", "a  b", " a b ", "the cat sat on the unbelievable mat", "a▁b", "<0x41> <s>hi</s> <|endoftext|> x", "日本 語 x ﬁ é", "x\n y \n\n z", "a\x1cb c\x00d", "👍🏽 ok", "ab" * 3000, "it's 'llama '' re ''re 'rf", "tokenizers tokenizers tokenizers", "the cat sat on the unbelievable mat", "café naïve", "a　b c"]
DDL = "doc_id long, text string, id string, row string, pair int, n int, groups string, rest string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "g", "r") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DDL)


def plain(texts):
    """Rows as the contract has them, from whole texts and all pairs of overlapping tokens."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    chars = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printed)}
    back = {c: b for b, c in chars.items()}
    rows, counts = [], Counter()
    for t in texts:
        a = b = []
        if t:
            a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
            a_bytes = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
                a = b = []
        if not a:
            rows.append(([], [], [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        owner_a, owner_b = np.repeat(range(len(a)), [len(x) for x in a_bytes]), np.repeat(range(len(b)), [len(x) for x in b_bytes])
        pairs = [(a[i], b[j]) for i, j in sorted(set(zip(owner_a.tolist(), owner_b.tolist(), strict=True)))]
        counts.update(pairs)
        groups, p, q = [], 0, 0
        for end in sorted(set(a_end.tolist()) & set(b_end.tolist())):
            r, s = int((a_end <= end).sum()), int((b_end <= end).sum())
            groups.append(",".join(map(str, a[p:r])) + "|" + ",".join(map(str, b[q:s])))
            p, q = r, s
        rows.append((a, b, pairs, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), g) for a, b, p, g in rows]


@pytest.mark.parametrize("head", [0, 7, 1_000_000])
def test_align_equals_plain_alignment(spark, head):
    ids = [None, 7, 7, *range(10, 7 + len(TEXTS))][: len(TEXTS)]
    got = align.align(frame(spark, TEXTS, ids), A, B, head=head).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, *w) for i, w in zip(ids, plain(TEXTS), strict=True)], key=key)


def test_align_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in align.align_digests(docs, A, B, head=500).collect()}
    want = plain([r.text for r in rows])
    assert got == {r.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for r, w in zip(rows, want, strict=True)}


def test_align_nothing(spark):
    assert align.align(frame(spark, []), A, B).count() == 0
    assert [tuple(r)[1:] for r in align.align(frame(spark, [None, ""]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pointer_jumping_long_chain():
    a_end, b_end = np.arange(2, 4002, 2), np.append(np.arange(1, 4000, 2), 4000)  # ends meet at the last byte only
    of_a, of_b = align.group_ends(a_end, b_end)
    assert set(of_a.tolist()) == set(of_b.tolist()) == {len(b_end) - 1}
    assert [x.tolist() for x in align.group_ends(a_end, a_end)] == [[*range(2000)]] * 2


def test_units_equal_whole_texts(monkeypatch):
    """Text by text and all at once, with hardly anything remembered: what units encode to is what whole texts do."""
    rnd = random.Random(8)
    alphabet = "aabcdeeinorst '’!?\n\t  0123ÉéßñЖ中👍_-=<>|▁\\\u00a0\u0085"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    want = plain(texts)
    monkeypatch.setattr(align, "UNITS", 300)
    words = align.Vocabularies(A, B)
    got = []
    for k in range(0, len(texts), 50):
        found = align.Aligned(words, words.encode(texts[k : k + 50]))
        n_groups, groups = found.groups()
        got += list(zip(found.n_a.tolist(), found.n_b.tolist(), n_groups, found.n_links.tolist(), groups, strict=True))
    assert got == [(*w[:4], w[6]) for w in want]
    assert len(words.known) <= 400


def test_most_counted(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 20 + [9, 100, 10_000])], "pair long, n long")
    assert [align.most_counted(counts, h).count() for h in (0, 1, 2, 22, 23, 72, 73, 1000)] == [0, 1, 2, 3, 23, 23, 73, 73]
