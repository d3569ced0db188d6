"""Spelling variants against all pairs of words in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import spelling

DDL = "doc_id long, text string, word string, n int, form string, key string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "w", 3, "f", "k") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DDL)


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def plain(pairs):
    counts = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items())


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def made_texts(seed=5, n=250):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("aabeiéÿ×nrst") for _ in range(rnd.randint(4, 11))) for _ in range(60)]

    def bent(w):
        at = rnd.randrange(len(w) + 1)
        return rnd.choice([w, w, w.upper(), w[:at] + rnd.choice("abé") + w[at:], w[:at] + w[at + 1 :], w[:at] + "z" + w[at + 1 :]])

    return [None, "", " ", "1 2", *(rnd.choice([" ", "-", "\n"]).join(bent(rnd.choice(base)) for _ in range(rnd.randint(1, 60))) for _ in range(n)), "É" * 70000 + " " + "long " * 20000]


@pytest.mark.parametrize("group", [3, 20_000])
def test_spelling_equals_all_pairs(spark, group, monkeypatch):
    if group == 3:
        monkeypatch.setattr(spelling, "CHUNK", 5)
    texts = made_texts()
    ids = [None, 4, 4, *range(10, 7 + len(texts))]
    want = plain(zip(ids, texts, strict=True))
    assert sum(r[3] is not None for r in want) > 40
    assert rows(spelling.spelling_variants(frame(spark, texts, ids), group=group)) == want


def test_spelling_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = sorted(tuple(r) for r in spelling.vocabulary(docs).collect())
    got = spelling.variants(spark.createDataFrame(counts[::3], "word string, n bigint"))
    words = dict(counts[::3])
    near = {w: 0 for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for size, some in by_length.items():
        for w in some:
            near[w] += sum(one_edit(w, v) for m in (size - 1, size, size + 1) for v in by_length.get(m, []))
    assert {r.word: r.n_near for r in got.collect()} == near


def test_spelling_nothing(spark):
    assert rows(spelling.spelling_variants(frame(spark, []))) == []
    assert rows(spelling.spelling_variants(frame(spark, [None, "", "a b c", "alone"]))) == []
    assert rows(spelling.spelling_variants(frame(spark, ["alone alone alone"]), every=10**9)) == [("alone", 3, 0, None, None, "alone")]


def test_forms_lead_to_roots(spark):
    words = [("aaaaa", 2), ("aaaab", 4), ("aaabb", 8), ("aabbb", 16), ("abbbb", 33), ("bbbbb", 66), ("bbbbc", 66), ("bbbbd", 20)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert got["aaaaa"].root == got["abbbb"].root == "bbbbb" and got["bbbbb"].form is None
    assert got["bbbbd"].form == "bbbbb" and got["bbbbd"].n_near == 2  # tie of 66: the smaller word


def test_lists_of_any_depth():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))).encode() for _ in range(70)})
    m = spelling.matrix(words, 8)
    zero = np.zeros(len(words), np.int64)
    i, j = spelling.near_in_list(m, zero, m, zero, 0)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((p, q) for p, x in enumerate(words) for q, y in enumerate(words) if one_edit(x, y))
