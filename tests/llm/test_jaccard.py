"""The similarity join against all pairs, with hot passages, near copies, tiles, blank texts and rows that share an id."""

import random
import re
import time

import numpy as np
import pytest

from ledgerloom.llm import jaccard, simhash

DDL = "doc_id long, text string, id string, row string, n int, node string, comp string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "c") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DDL)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1 if words else 0))}


def plain(texts, ids, k=3, percent=90):
    """(id, n, component) for each row; links by all pairs."""
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, p in enumerate(sets):
        for j in range(i):
            if p and sets[j] and 100 * len(p & sets[j]) >= percent * len(p | sets[j]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(texts)):
        least.setdefault(find(i), []).append(ids[i])
    return sorted(((ids[i], len(p), (min((x for x in least[find(i)] if x is not None), default=None)) if p else ids[i]) for i, p in enumerate(sets)), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed=4):
    rnd = random.Random(seed)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    popular = [own(30) for _ in range(6)]
    texts = [None, "", " \t", "One", "one", "one two", "ONE Two", "a b c", "a b c d", "É é", "é É"]
    for _ in range(25):
        base = own(rnd.randint(20, 150))
        texts += [" ".join(base)] * rnd.choice([1, 1, 3])
        for _ in range(rnd.randint(0, 4)):  # near or not quite
            some = list(base)
            for _ in range(rnd.choice([1, 1, 2, 3, 5])):
                some[rnd.randrange(len(some))] = f"x{rnd.randrange(10**6)}"
            texts.append("\n".join(some))
    for _ in range(140):  # made of popular passages
        texts.append(" ".join(w for k in rnd.sample(range(6), rnd.randint(1, 4)) for w in popular[k]) + " " + " ".join(own(rnd.choice([0, 0, 2, 6]))))
    chain = own(200)
    texts += [" ".join(chain[k : k + 150]) for k in range(0, 50, 5)]
    texts.append(" ".join(own(30_000)))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("light,tile", [(64, 2048), (0, 3)])
def test_classes_equal_all_pairs(spark, monkeypatch, light, tile):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "TILE", tile)
    texts = corpus()
    ids = [None, None, 5, 5, *range(10, 6 + len(texts))]
    want = plain(texts, ids)
    assert len({r[2] for r in want}) < len(want) - 50
    assert rows(jaccard.classes(frame(spark, texts, ids))) == want


def test_join_alone_finds_all_links(spark, monkeypatch):
    """Without the first step, all links come from the prefixes."""
    monkeypatch.setattr(jaccard, "likely_pairs", lambda reps: reps.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard, "LIGHT", 8)
    texts = corpus(9)
    assert rows(jaccard.classes(frame(spark, texts), similarity=0.8, shingle=2)) == plain(texts, list(range(len(texts))), 2, 80)


def test_given_documents(spark, sf):
    got = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(jaccard.classes(spark.read.parquet(f"{sf}/documents.parquet"))) == plain([t for _, t in got], [i for i, _ in got])


def test_nothing(spark):
    assert rows(jaccard.classes(frame(spark, []))) == []
    assert rows(jaccard.classes(frame(spark, [None, "", "a"]))) == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def test_a_passage_that_many_texts_share_costs_rows_not_pairs(spark):
    rnd = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(100))
    texts = [passage + " " + " ".join(f"w{rnd.randrange(10**7)}" for _ in range(24)) for _ in range(20_000)]
    began = time.time()
    got = simhash.near_copies(frame(spark, texts))
    assert got.where("doc_id = component_id").count() == len(texts) and time.time() - began < 240


def test_length_classes_hold_all_partners(spark):
    """Rows of equal shingle whose lengths and places allow a link meet in one key and tile, exactly once."""
    monkey = [(1, node, n, at, node) for node, (n, at) in enumerate([(n, at) for n in range(1, 60, 2) for at in range(0, n - int(np.ceil(0.8 * n - 1e-9)) + 1)])]
    mixed = spark.createDataFrame(monkey, "shingle long, node long, n int, at int, comp long").selectExpr("*", "0L as most")
    dense = jaccard.tiles(jaccard.length_keys(mixed, 0.8))
    keys = ["shingle", "short", "long", "turn", "i", "j"]
    met = jaccard._met(dense.where("shorter"), dense.where("not shorter"), keys, "x.comp <> y.comp and (x.n < y.n or x.n = y.n and x.node < y.node)")
    pairs = [(r.a, r.b) for r in met.collect()]
    ok = lambda x, y: min(x[2], y[2]) >= 0.8 * max(x[2], y[2]) - 1e-6 and min(x[2] - x[3], y[2] - y[3]) >= 0.8 / 1.8 * (x[2] + y[2]) - 1e-6
    want = {(x[1], y[1]) for x in monkey for y in monkey if x[1] < y[1] and ok(x, y)}
    assert len(pairs) == len(set(pairs)) and want <= set(pairs)


def test_rows_that_share_an_id_are_judged_each(spark):
    texts = ["a b c d e f", "a b c d e f", "other words of this text here", "a b c d e f"]
    kept = simhash.keep_first_copies(frame(spark, texts, [1, 2, 2, None]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, texts[0]), (2, texts[2]), (None, texts[0])]
