"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import knn


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int, id string")


def test_recall_scores_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[200:500] = x[200]
    ids = np.arange(1500)
    rows = [(int(i), v.tolist(), 1, "x") for i, v in zip(ids, x, strict=True)]
    odd = [(5000, None, 1, "x"), (5100, [0.0] * 16, 1, "x"), (5200, [float("nan")] * 16, 1, "x"), (5300, [1.0] * 15 + [None], 1, "x"), (5400, [1.0] * 3, 1, "x"), (None, [1.0] * 16, 1, "x"), (5500, [], 1, "x")]
    got: dict = {}
    for r in knn.nearest(table(spark, rows + odd), F.col("vec_id") % 100 == 0, sample=300, cell_rows=200, block_rows=150, query_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = brute(ids, x.astype(np.float64), range(0, 1500, 100))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [i for i, _ in got[200]] == list(range(201, 211)) and all(d == 0 for _, d in got[200])
    exact = {(i, d) for q in want for i, d in want[q]}
    assert all(abs(d - np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum())) < 1e-12 for q in got for i, d in got[q]) and exact


def test_many_cells_are_pruned(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = 6 * rng.standard_normal((60, 16))
    x = (centres[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 16))).astype(np.float32)
    ids, written = np.arange(4000), {}
    kept = knn.materialize
    monkeypatch.setattr(knn, "materialize", lambda df, label: written.setdefault(label, kept(df, label)))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in knn.nearest(df, F.col("vec_id") % 100 == 0, cell_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(ids, x.astype(np.float64), range(0, 4000, 100))
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    cells = written["cells"].select("cell").distinct().count()
    assert cells >= 40 and written["home"].count() == 40
    assert written["far"].count() < 0.2 * 40 * cells


def test_tree_and_boxes_agree():
    p = np.random.default_rng(5).standard_normal((3000, knn.M))
    p[:500] = p[0]
    tree = knn.kd_leaves(p, 40, tight=False)
    leaf = tree.leaf_of(p)
    assert all((leaf[rows] == k).all() for k, rows in enumerate(tree.rows))
    assert ((p <= tree.high[leaf]) & (p >= tree.low[leaf])).all()
    assert (knn.kd_leaves(p[:0], 40).leaf_of(p) == 0).all()


def test_repeated_and_null_ids_and_queries(spark):
    rows = [(0, [1.0, 2.0], 1, "x"), (0, [9.0, 2.0], 1, "x"), (1, [1.0, 3.0], 1, "x"), (1, [1.0, 3.0], 1, "y"), (None, [1.0, 2.0], 1, "x"), (2, None, 1, "x")]
    got = knn.nearest(table(spark, rows), F.col("vec_id") % 2 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 1.0), (0, 1, 1.0)]
    assert knn.nearest(table(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0], 1, "x"), (1, [1.0, 3.0], 1, "x"), (2, [5.0, 5.0], 1, "x")]
    got = knn.nearest(table(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 5.0)]
    assert knn.nearest(table(spark, []), F.col("vec_id") == 0).count() == 0


def test_quantile():
    assert abs(knn.chi_square_quantile(0.95, 8) - 15.507) < 0.01
