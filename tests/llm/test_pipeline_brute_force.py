"""Each filtering stage of the pipeline, and packing, against versions in plain Python, on documents with planted cases."""

import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DDL = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, id string"
STAGES = dict(corpus_pipeline.STAGES)
LETTERS = "abcdefghijklmnop"


def cases():
    """(id, text): own prose; lines of one template; exact and near copies; a long line that two documents share; a benchmark
    passage; null, empty and blank texts; repeated rows; ids out of order."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice(LETTERS) for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, passage = prose(14), prose(55)
    rows = [(100 - k, f"{prose(60)}\nPrinted on day {k} by the office\n{prose(7)}") for k in range(20)]
    rows += [(200 + k, f"{prose(9)}\nRead more of this story by {word()} in our weekly letter today\n\n{prose(40)}") for k in range(7)]
    own = [prose(80) for _ in range(4)]
    rows += [(300 + k, t) for k, t in enumerate([*own, own[0], own[1] + " end", "start " + own[2], own[0]])]
    rows += [(400, f"{prose(70)}\n{passage} 7"), (401, f"{prose(70)}\n{passage} 8")]
    rows += [(500, f"{prose(30)} {item.upper()} {prose(30)}"), (501, f"{prose(30)} {item[: len(item) // 2]} {prose(30)}")]
    rows += [(600, None), (601, ""), (602, "\n \n"), (603, "Printed on day 99 by the office"), *[(604, prose(30))] * 2]
    return rows, [(1, item), (2, prose(14)), (3, None), (4, "")]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rows, items = cases()
    where = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return frame(spark, rows), where, rows, items


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x") for i, t in rows], DDL)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def tokens(line):
    return ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\r\f\x0b]+", line.strip(" \t\r\f\x0b"))]


def templates(line):
    t = tokens(line)
    if t == [""]:
        return []
    out = [(len(t), -1, *t)]
    for j in range(4 if len(t) >= 8 else 0):
        lo, hi = len(t) * j // 4 if j else 2, len(t) * (j + 1) // 4
        if hi > lo:
            out.append((len(t), j, " ".join(t[:lo]), " ".join(t[hi:])))
    return out


def passages(line):
    return [tuple(tokens(line))] if len(tokens(line)) >= 20 else []


def without_lines(rows, of_line, min_docs):
    found = defaultdict(list)
    for i, text in rows:
        for t in {t for line in (text or "").split("\n") for t in of_line(line)}:
            found[t].append(i)
    first = {t: min(ids) for t, ids in found.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not any(first.get(t, i) != i for t in of_line(x))]
        if len(kept) == len(lines):
            out.append((i, text))
        elif " ".join(kept).strip():
            out.append((i, "\n".join(kept)))
    return out


def first_copies(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))}

    sets, label = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    links = [(a, b) for a, p in sets for b, q in sets if a < b and (len(p & q) >= 0.8 * len(p | q))]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return [(i, t) for i, t in rows if label[i] == i]


def without_items(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    windows = {tuple(w[k : k + 10]) for w in map(words, (t for _, t in items)) if w for k in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return [(i, t) for i, t in rows if not hit(words(t))]


def test_stages_equal_brute_force(spark, planted):
    docs, where, rows, items = planted
    lined = STAGES["line_dedup"](spark, docs, where).persist()
    want = without_lines(rows, templates, 5)
    assert texts(lined) == sorted(want, key=str) and lined.columns == docs.columns
    assert len(want) < len(rows) and (603, rows[-3][1]) not in want
    near = STAGES["near_dedup"](spark, lined, where).persist()
    want = without_lines(first_copies(want), passages, 2)
    assert texts(near) == sorted(want, key=str) and near.columns == docs.columns
    ids = {i for i, _ in want}
    assert {300, 301, 302, 303, 400, 401, 500, 501} <= ids and not {304, 305, 306, 307} & ids
    clean = STAGES["decontaminate"](spark, near, where).persist()
    want = without_items(want, items)
    assert texts(clean) == sorted(want, key=str) and clean.columns == docs.columns
    assert {i for i, _ in want} == ids - {500}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = defaultdict(list)
    for i, t in want:
        expected[i].append(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    pieces, used = defaultdict(int), defaultdict(list)
    for r in STAGES["pack"](spark, clean, where).collect():
        pieces[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert dict(pieces) == {i: sum(n) for i, n in expected.items()}
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    spark.catalog.clearCache()


def test_empty_table_and_null_columns(spark, planted):
    where = planted[1]
    for rows in ([], [(None, None), (None, "one two"), (3, None)]):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, where)
            got = out.collect()
            assert rows or not got, name
            assert name == "pack" or out.columns == docs.columns, name
    spark.catalog.clearCache()
