"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import decontam, langid, linededup, packing, pseudonym, quality, simhash, tokencount, tokenfile
from ledgerloom.llm.components import components
from ledgerloom.llm.tokenized import PieceEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", " a", "a ", "  x  y ", "it's  'llama 'red we'll ''re 'rf\n\n z", "ﬁ ǅ İ", "a\x1cb c", "\0x y", "<|endoftext|> x <|endoftext|>", "x\n y \n", "日本 語 x", "é é Å", "foo\n", "foo\n bar", "-" * 300, "ab" * 5000, "The Cat sat.", "the cat SAT.", "1234567 12"]
DDL = "doc_id long, text string, id string, mark string, n_lines int, score double, lang string"


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", "m", 7, 0.5, "en") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DDL)


def rnd_texts(n, seed=3):
    rnd = random.Random(seed)
    alphabet = "aabcdeeinorst '’!?\n\t  0123ÉéßñЖ中👍_-=<>|\\"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_piece_encoder_equals_library(path):
    texts = ODD + rnd_texts(1500)
    encoder = PieceEncoder(path, limit=400)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x for k in range(0, len(texts), 64) for x in encoder.encode(texts[k : k + 64])] == want


def test_token_counts_equal_library(spark):
    texts = ODD + rnd_texts(800) + ["".join(random.Random(k).choice("etaoinshrdlu'") for _ in range(400)) for k in range(50)]
    got = {r.doc_id: r for r in tokencount.with_token_counts(frame(spark, texts), BYTE).collect()}
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[k].n_tokens for k in range(len(texts))] == want
    assert all(got[k].n_bytes == len((t or "").encode()) and got[k].over_limit == (want[k] > 1024) for k, t in enumerate(texts))
    assert tokencount.with_token_counts(frame(spark, []), BYTE).count() == 0


def test_splitter_chunks_compose():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 9, 1000).astype(np.uint8)
    whole, end = tokencount.word_starts(classes)
    first, state = tokencount.word_starts(classes[:377])
    second, end2 = tokencount.word_starts(classes[377:], state)
    assert (np.concatenate([first, second]) == whole).all() and end == end2
    state, starts = tokencount.START, []
    for c in classes:
        starts.append(bool(tokencount.EMIT[state, c]))
        state = tokencount.TO[state, c]
    assert starts == whole.tolist() and state == end


def test_variable_length_coding():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 3, 4, 5, 1000, 2])
    values = rng.choice([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], counts.sum()).astype(np.uint32)
    control, data = tokenfile.encode_ranks(values, counts)
    parts = [tokenfile.encode_ranks(x) for x in np.split(values, np.cumsum(counts)[:-1])]
    assert control == b"".join(c for c, _ in parts) and data == b"".join(d for _, d in parts)
    assert (tokenfile.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), counts) == values).all()


@pytest.mark.parametrize("texts", [ODD + ODD[:3], []])
def test_token_files_roundtrip(spark, texts):
    ids = [None, 7, 7, *range(10, 7 + len(texts))][: len(texts)]
    got = tokenfile.roundtrip(frame(spark, texts, ids), WORD, 2).orderBy("start").collect()
    want = {}
    for i, e in zip(ids, Tokenizer.from_file(WORD).encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        want.setdefault(i, []).append(np.array([*e.ids, 2], "<u4").tobytes())
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and bytes(r.ids) in want[r.doc_id]
        at += r.n_tokens


@pytest.mark.parametrize("lengths", [[], [7], [2048] * 3, [1, 1], [9999, 2049, 1], [1025] * 300, list(range(1, 2300, 3)), [random.Random(k).randint(1, 900) for k in range(5000)]])
def test_bins_keep_all_and_cut_little(lengths):
    bins = packing.Bins(2048)
    sequences = [s for i, n in enumerate(lengths) for s in bins.add(i, np.arange(n, dtype="<u4").tobytes())]
    assert all(sum(len(p[3]) for p in s) == 4 * 2048 for s in sequences) and len(bins.waiting) <= packing.WAITING + 1
    sequences += bins.close()
    pieces = {}
    for s in sequences:
        assert sum(len(p[3]) for p in s) <= 4 * 2048
        for doc, start, n, ids in s:
            assert n == lengths[doc]
            pieces.setdefault(doc, []).append((start, ids))
    for doc, n in enumerate(lengths):
        assert b"".join(ids for _, ids in sorted(pieces[doc])) == np.arange(n, dtype="<u4").tobytes()
    assert len(sequences) == -(-sum(lengths) // 2048)
    if len(lengths) == 5000:
        assert sum(len(p) > 1 for p in pieces.values()) < 0.12 * len(lengths)


def test_classes_are_reciprocals():
    bins = packing.Bins(2048)
    for n in (1025, 1024, 683, 682, 3):
        bins.add(n, bytes(4 * n))
    assert sorted(len(p) for _, _, p in bins.waiting) == [1, 2] and set(bins.open) == {3, 682}  # 1,025 alone; 1,024 and 683 make a pair


def test_packing(spark):
    texts = ODD + ["word " * k for k in range(0, 4000, 97)]
    got = packing.pack(frame(spark, texts), BYTE, 1).toPandas()
    full = [[*e.ids, 1] for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for doc, rows in got.groupby("doc_id"):
        rows = rows.sort_values("start")
        assert np.frombuffer(b"".join(rows.ids), "<u4").tolist() == full[doc] and rows.start.tolist() == [0, *rows.length.cumsum()[:-1]]
        assert set(rows.doc_tokens) == {len(full[doc])}
    assert set(got.doc_id) == set(range(len(texts)))
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        n = rows.length.sum()
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and n <= 2048
        assert set(rows.padding) == {0 if n & (n - 1) == 0 else 2048 - n}
    assert packing.pack(frame(spark, []), BYTE, 1).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(200)) for _ in range(12)]
    texts = ODD + base + [b + " tail" for b in base] + [b.replace("a", "b", 1) for b in base] + base[:3] * 4
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    assert [(got[k].fingerprint, got[k].component_id) for k in range(len(texts))] == [(f"{fps[k]:016x}", want[k]) for k in range(len(texts))]
    kept = simhash.keep_first(frame(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == frame(spark, []).columns
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    nulls = simhash.near_duplicates(frame(spark, ["x y z", "x y z", "q"], [None, 5, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in nulls if r.component_id) == [(False, 5), (True, 5)]


def test_near_copies_equal_brute_force(spark):
    rnd = random.Random(5)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    base = [[rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(60)] for _ in range(15)]
    edited = [[*b[:k], "new", *b[k + 1 :]] for b in base for k in (0, 30, 31, 59)] + [[*b[:20], *b[26:]] for b in base]
    texts = [" ".join(w) for w in base + edited] + ODD + [" ".join(base[0])] * 30 + ["boiler plate line here now ok " + " ".join(base[k][:30]) for k in range(15)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts)).collect()}
    sets = [set(simhash.shingle_set((t or "").encode()).tolist()) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = brute_components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    assert got == want
    assert {r.doc_id for r in simhash.keep_first_copies(frame(spark, texts)).collect()} == set(want.values())
    assert simhash.near_copies(frame(spark, [])).count() == 0
    nulls = simhash.keep_first_copies(frame(spark, ["a b", "a b", "c"], [None, 5, None]))
    assert sorted((r.doc_id is None, r.text) for r in nulls.collect()) == [(False, "a b"), (True, "a b"), (True, "c")]


def test_near_copies_that_share_a_long_passage(spark):
    rnd = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(200))
    own = [[f"w{rnd.randrange(10**6)}" for _ in range(40)] for _ in range(2000)]
    own += [[*w[:k], "new", *w[k + 1 :]] for w in own[:200] for k in [rnd.randrange(6, 34)]]
    rnd.shuffle(own)
    texts = [f"{passage} {' '.join(w)}" for w in own]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts)).collect()}
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if 1.8 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]))]
    assert len(alike) == 200 and sum(got[i] != got[j] for i, j in alike) == 0
    assert len(set(got.values())) == 2000


def test_wider_ball(spark):
    fps = spark.createDataFrame([(0,), (0b1111,), (0b111100000,), (-1,)], "fp long")
    assert {frozenset((r.src, r.dst)) for r in simhash.close_pairs(fps.where("fp >= 0 or fp = -1"), distance=4).collect()} == {frozenset((0, 15)), frozenset((0, 480))}


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def brute_decontaminate(texts, items, width=10):
    cut = lambda t: [w.decode() for w in decontam.words((t or "").encode())]
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for key, item in items:
            iw = cut(item)
            k = min(width, len(iw))
            windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else []:
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(str(key))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    items = [(k, " ".join(rnd.choice("a b c d e f".split()) for _ in range(rnd.randint(0, 16)))) for k in range(30)] + [(30, None), (3, "Zed, zed!"), (31, "ÉTÉ b")]
    texts = ODD + [" ".join(rnd.choice(["a", "B", "c", "d", "e", "f", items[rnd.randrange(30)][1]]) for _ in range(60)) for _ in range(40)] + ["x zed ZED y", "été b", "ÉTÉ B " * 2000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_decontaminate(texts, items)
    for words_at_a_time in (decontam.QUERY_WORDS, 40):
        monkeypatch.setattr(decontam, "QUERY_WORDS", words_at_a_time)
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.decontaminate(frame(spark, texts), bench).collect()}
        assert [got[k] for k in range(len(texts))] == want
    clean = decontam.drop_contaminated(frame(spark, texts), bench)
    assert {r.doc_id for r in clean.collect()} == {k for k, x in enumerate(want) if not x[1]}
    assert decontam.decontaminate(frame(spark, []), bench).count() == 0
    assert decontam.decontaminate(frame(spark, texts), bench.where(F.lit(False))).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = frame(spark, ["one x two y three", "one two three", "three two one", "one x x two three"])
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in decontam.decontaminate(docs, bench, slop=1).collect()}
    assert got == {0: [(0, 5)], 1: [(0, 3)], 2: [], 3: []}


def test_line_dedup(spark):
    shared, varied = "This page was printed by the office of records", "Share this with {} other people today and then come back"
    texts = [f"own text {'abcdefgh'[k]}\n{shared}\n{varied.format(k)}\n\nlast" for k in range(6)] + [None, "", "\n", f"{shared}", "one two three four five six seven eight nine ten alpha", "one two three four five six seven eight nine ten beta"]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in linededup.dedup_lines(docs, min_docs=3).collect()}
    assert got[0].text == texts[0] and all(got[k].text == f"own text {'abcdefgh'[k]}\n" for k in range(1, 6))
    assert got[6].text is None and got[7].text == "" and got[8].text == "\n" and got[9].text == "" and got[10].text == texts[10]
    assert linededup.dedup_lines(docs, min_docs=3).columns[-2:] == ["_n_lines", "n_dropped"]
    pair = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs.where("doc_id >= 10"), min_docs=2).collect()}
    assert pair == {10: 0, 11: 1}  # the last word is in the open quarter
    kept = linededup.without_recurring_lines(docs, min_docs=3)
    assert {r.doc_id for r in kept.collect()} == set(range(12)) - {9} and kept.columns == docs.columns
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_repeated_passages(spark):
    passage = " ".join(f"{w}{'abcde'[k % 5]}" for k, w in enumerate(["word"] * 50))
    texts = [f"first\n{passage}\nshort line", f"second\n{passage}\nshort line", passage, None, "", "third\nshort line"]
    got = {r.doc_id: r.text for r in linededup.without_repeated_passages(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "second\nshort line", 3: None, 4: "", 5: texts[5]}


def test_near_dedup_drops_passages_of_other_documents(spark):
    import corpus_pipeline

    rnd = random.Random(12)
    line = lambda n: " ".join(f"w{'abcdefghijklmnop'[rnd.randrange(16)]}{'abcdefghijklmnop'[rnd.randrange(16)]}" for _ in range(n))
    passage, own = line(60), [line(200) for _ in range(3)]
    texts = [f"{own[0]}\n{passage}", f"{own[1]}\n{passage}", own[2], f"{own[2]}\none more short line"]
    got = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), "").collect()}
    assert got == {0: texts[0], 1: own[1], 2: own[2]}


def test_language_id(spark):
    rnd = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["shu", "ber", "ung"], "cc": ["ción", "que", "ñal"]}
    rows = [(k, " ".join("".join(rnd.choices(syllables[lang], k=3)) for _ in range(12)), lang) for k, lang in enumerate(list(syllables) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(langid.learnable(docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()}
    assert sum(got[k][0] == lang for k, _, lang in rows) >= 0.97 * len(rows)
    assert all(got[k] == ("und", 0.0) for k in (900, 901, 902))
    assert (model.weights == 0).mean() > 0.5
    assert langid.accepted(docs, model).where("doc_id >= 900").count() == 0
    assert langid.predicted(docs, langid.fit(docs.where("lang = 'zz'"))).where("lang_pred <> 'und'").count() == 0
    long = "kalomi " * 300_000
    assert (langid.ngram_counts(long) > 0).sum() == (langid.ngram_counts(long[: 7 * 500]) > 0).sum()


def test_language_id_rejects_strange_texts_and_learns_rare_labels(spark):
    rnd = random.Random(18)
    syllables = {"aa": ["ka", "lo", "mi", "tas"], "bb": ["shu", "ber", "ung", "ei"]}
    said = lambda lang, n: " ".join("".join(rnd.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(k, said("aa" if k % 50 else "bb", 3 + k % 40), "aa" if k % 50 else "bb") for k in range(1500)]
    strange = [(5000, "привет мир как дела сегодня у всех людей", None), (5001, "".join(rnd.choices("ξψζθδφγλπ", k=400)), None), (5002, "漢字仮名交じり文を書く練習をしている", None)]
    docs = spark.createDataFrame([*rows, *strange, *rows[:3] * 50], "doc_id long, text string, lang string")
    model = langid.fit(langid.learnable(docs), sample=60)
    assert model.labels == ["aa", "bb"]
    got = {r.doc_id: r.lang_pred for r in langid.predicted(docs, model).collect()}
    assert sum(got[k] == lang for k, _, lang in rows) >= 0.99 * len(rows)
    kept = {r.doc_id for r in langid.accepted(docs, model).collect()}
    assert kept == {k for k, _, _ in rows}
    df, n = langid._document_frequencies(docs.select("text"))
    counts = [langid.ngram_counts(r.text) > 0 for r in docs.collect()]
    assert n == len(counts) and (df == np.sum(counts, axis=0)).all()
    again = langid.fit(langid.learnable(docs.repartition(7, "text")), sample=60)
    assert (again.weights == model.weights).all() and again.most_surprise == model.most_surprise


def test_quality(spark):
    rnd = random.Random(9)
    good = ["The people " + " ".join(rnd.choice("went home and then slept well".split()) for _ in range(40)) + "." for _ in range(150)]
    bad = ["$$$ ".join(rnd.choice("buy now free".split()) for _ in range(40)) for _ in range(60)]
    docs = frame(spark, good + bad + ["", None])
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(210)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert sum(got[k].predicted == (k < 150) for k in range(0, 210, 3)) >= 68
    assert 0 <= got[210].score <= 1 and got[210].score == got[211].score
    assert quality.fit(docs, labels.where(F.lit(False))).rules == []
    assert 0 < len(model.rules) < 200


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["card 4111 1111 1111 1111 and 4111111111111112.", "mail jo.24@mail4.example.com.", "+1 (678) 555-5272", "173.33.203.46, 999.1.1.1", "2024-02-29 2023-02-30 02/29/2024 29.02.2024", "123-45-6789 000-12-3456", "again 4111 1111 1111 1111", None, "", "plain text, version 2.0", '"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"']
    got = {r.doc_id: r for r in pseudonym.pseudonymise(frame(spark, texts), "k").collect()}
    assert luhn(got[0].text[5:24].replace(" ", "")) and got[0].text[24:] == texts[0][24:] and got[0].text[5:24] == got[6].text[6:25] != texts[0][5:24]
    assert got[1].text.endswith("@mail4.example.com.") and got[1].text != texts[1]
    assert got[2].text.startswith("+1 (") and len(got[2].text) == 17 and got[2].text != texts[2]
    assert got[3].text.endswith(", 999.1.1.1") and got[3].n_values == 1
    iso, kept, us, dotted = got[4].text.split()
    assert kept == "2023-02-30" and us == f"{iso[5:7]}/{iso[8:]}/{iso[:4]}" and dotted == f"{iso[8:]}.{iso[5:7]}.{iso[:4]}"
    assert got[5].text.endswith(" 000-12-3456") and got[5].n_values == 1
    assert [got[k].text for k in (7, 8, 9)] == texts[7:10] and not got[9].changed
    assert got[10].n_values == 1 and len(got[10].text) == len(texts[10])
    other = pseudonym.pseudonymise(frame(spark, texts[:1]), "another key").first()
    assert other.text != got[0].text
    v = got[0]["values"][0]
    assert len(got[0]["values"]) == 1 and texts[0][v.start : v.start + v.length] == "4111 1111 1111 1111"  # the other has no right check digit
    assert pseudonym.pseudonymise(frame(spark, []), "k").count() == 0
    clash = frame(spark, texts).withColumn("values", F.lit(1)).withColumn("pii_key", F.lit("kept"))
    assert {r.pii_key for r in pseudonym.pseudonymise(clash, "k").collect()} == {"kept"}


def test_pseudonyms_can_be_undone(spark):
    rnd = random.Random(13)
    ips = [".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(30)]
    texts = [f"{ip} and 5500 0055 5555 5559, id 2{k:03d}-11-0{k % 9 + 1} born 0{k % 9 + 1}.12.1990; user{k}.x@mail.org +44 20 7946 0{k:03d}" for k, ip in enumerate(ips)] + ["no value", None, "", "8" * 16 + " 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"]
    docs = frame(spark, texts)
    made = pseudonym.pseudonymise(docs, "secret-of-mine")
    assert {r.doc_id: r.text for r in pseudonym.restore(made, "secret-of-mine").collect()} == dict(enumerate(texts))
    changed = {r.doc_id: r.text for r in made.collect()}
    assert all(changed[k] != texts[k] and ips[k] not in changed[k] for k in range(30))
    assert "secret-of-mine" not in made._jdf.queryExecution().toString()


def test_settings_stay(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    tokenfile.roundtrip(frame(spark, ["a b", "c"]), WORD, 2).collect()
    simhash.near_copies(frame(spark, ["a b", "c"])).collect()
    assert [spark.conf.get(k) for k in keys] == before


def test_long_lines_are_read_once(spark):
    import time

    began = time.time()
    long = "x" * 1_000_000
    texts = [long + "\nshared line of this site", "\t" * 300_000 + "z\nshared line of this site", None, "shared line of this site"] + ["shared line of this site"] * 4
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(frame(spark, texts, [0, 1, 2, None, 4, 4, 5, 6]), min_docs=5).collect()}
    assert got[0] == 0 and got[1] == got[5] == got[6] == got[None] == 1 and time.time() - began < 60
    many = "\n".join(f"line {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)} of many" for k in range(60_000))
    rows = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(frame(spark, [many] * 5 + [f"own\n{many}"]), min_docs=5).collect()}
    assert rows[0] == (many, 0) and rows[4] == ("", 60_000) and rows[5] == ("own", 60_000) and time.time() - began < 120


def test_transducer_states_are_bounded():
    merger = tokencount.Merger(BYTE, limit=2000)
    word = "".join(random.Random(3).choice("abcdefghijklmnopqrst") for _ in range(60_000))
    assert merger.count(word.encode()) == len(Tokenizer.from_file(BYTE).encode(word, add_special_tokens=False).ids)
    assert len(merger.states) <= 2002


def test_rules_as_columns_equal_numpy(spark):
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("ab c.,|!7X\n$") for _ in range(rnd.randint(0, 80))) for _ in range(200)] + ["", None]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, k * 7 % 3 % 2) for k in range(200)] * 2 + [(0, 1)], "doc_id long, quality int")
    model = quality.fit(docs.unionByName(docs), labels)
    stats = docs.select("doc_id", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).toPandas().set_index("doc_id")
    z = {k: model.bias + sum(w for rule, w in model.rules if all((stats.loc[k, n] > at) == above for n, above, at in rule)) for k in range(len(texts))}
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert model.rules and all(abs(got[k] - 1 / (1 + np.exp(-z[k]))) < 1e-9 for k in z)
    assert quality.scored(frame(spark, []), model).count() == 0


def test_feistel_is_a_permutation(spark):
    n = 27 * 11
    p = pseudonym.feistel_pair(F.floor(F.col("id") / 11), F.col("id") % 11, 27, 11, F.lit("k"), "x")
    assert {(r.p.a, r.p.b) for r in spark.range(n).select(p.alias("p")).collect()} == {(a, b) for a in range(27) for b in range(11)}
    t = pseudonym.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("k"), "x")
    assert len({r.t for r in spark.range(1000).select(t.alias("t")).collect()}) == 1000


def test_items_digest(spark, sf):
    from ledgerloom.llm.queries import op1_decontamination

    rows = op1_decontamination(spark, sf).collect()
    assert all(len(r.items_sha256) == 64 and r.contaminated == (r.n_hit > 0) for r in rows)
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}


def test_crc_folds(spark):
    from ledgerloom.llm._common import crc_bucket

    df = spark.createDataFrame([(0,), (17,), (None,)], "doc_id long").select("doc_id", crc_bucket("doc_id", 5).alias("f"))
    assert [r.f for r in df.collect()] == [zlib.crc32(x) % 5 for x in (b"0", b"17", b"")]
