"""Approximate nearest neighbours by stable projections and kd-trees with a chi-square stopping test.

A Gaussian (2-stable) projection to M dimensions turns a distance d into d times a chi variable of M degrees of freedom. The
projected space is cut into cells by a kd-tree fitted on a bounded sample of projected rows; every row is indexed in its cell.
A query first searches the cell it lies in; its k-th distance there bounds which other cells it visits. Within a cell it takes
the leaves of a local kd-tree in order of projected distance, verifies each row found with the true distance, and stops when a
row as near as its current k-th would have shown up by then with the wanted confidence: projected distance squared >=
chi-square quantile * k-th distance squared.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._common import materialize

M = 8  # even, for the closed form below
LEAF = 64


def chi_square_cdf(x: float, dims: int) -> float:
    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(dims // 2))


def chi_square_quantile(p: float, dims: int = M) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


@dataclass
class Boxes:
    """Leaves of a kd-tree: rows of each, and bounds of each in projected space; and its inner nodes: the dimension and place of
    the split, and the two nodes below (a leaf's number as -1 - leaf)."""

    rows: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    dim: np.ndarray
    at: np.ndarray
    below: np.ndarray

    def gap2(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance from p to each box, less what rounding may add: products of one row and of many differ in
        their last bits, and an exact copy must not lie outside its own box."""
        d = np.maximum(np.maximum(self.low - p, 0) + np.maximum(p - self.high, 0) - 1e-9 * (1 + np.abs(p)), 0)
        return (d * d).sum(axis=1)

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        """The leaf that each projected row lies in: as many steps as the tree is deep."""
        node = np.full(len(p), 0 if len(self.dim) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            node[inner] = self.below[n, (p[inner, self.dim[n]] > self.at[n]).astype(int)]
        return -1 - node


def kd_leaves(points: np.ndarray, leaf: int, tight: bool = True) -> Boxes:
    """Median splits on the widest dimension. tight: bounds are those of the rows; otherwise the splits', open outwards, so that
    the boxes cover all of space."""
    done, splits, todo = [], [], [(np.arange(len(points)), np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf), None)]
    while todo:
        rows, low, high, above = todo.pop()
        p = points[rows]
        spread = np.ptp(p, axis=0) if len(rows) else np.zeros(1)
        f = int(spread.argmax())
        ends = len(rows) <= leaf or spread[f] == 0
        if above is not None:
            splits[above[0]][2][above[1]] = -1 - len(done) if ends else len(splits)
        if ends:
            done.append((rows, *((p.min(axis=0), p.max(axis=0)) if tight and len(rows) else (low, high))))
            continue
        at = float(np.median(p[:, f]))
        left = p[:, f] <= at
        if left.all():
            left = p[:, f] < at
            at = float(p[left, f].max())
        lower, upper = high.copy(), low.copy()
        lower[f], upper[f] = at, at
        todo += [(rows[left], low, lower, (len(splits), 0)), (rows[~left], upper, high, (len(splits), 1))]
        splits.append((f, at, [0, 0]))
    inner = [np.array([x[k] for x in splits], t).reshape(shape) for k, (t, shape) in enumerate(((int, -1), (float, -1), (int, (-1, 2))))]
    return Boxes([d[0] for d in done], np.array([d[1] for d in done]), np.array([d[2] for d in done]), *inner)


def usable(id_col: str, vector_col: str) -> Column:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def fit(projected: DataFrame, n_rows: int, sample: int = 1 << 18, cell_rows: int = 2048) -> Boxes:
    """Cells from at most `sample` projected rows (M numbers each), those of smallest id hash: one for each cell_rows rows of
    the table, with at least 32 sampled rows each, so up to sample / 32 cells."""
    got = projected.select("id", "p").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    points = np.array([np.asarray(p) for p in got["p"]]).reshape(-1, M)
    return kd_leaves(points, max(32, -(-len(points) * cell_rows // max(n_rows, 1))), tight=False)


def search_block(ids: np.ndarray, x: np.ndarray, g: np.ndarray, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, stop: float):
    """(query row, ids, distances) of the k nearest rows of a block for each query; bound: a distance that k rows don't exceed."""
    tree = kd_leaves(x @ g, LEAF)
    for i in range(len(q)):
        gaps = tree.gap2(q[i] @ g)
        order = np.argsort(gaps, kind="stable")
        best_i, best_d, kth, at = np.zeros(0, np.int64), np.zeros(0), bound[i] ** 2, 0
        while at < len(order) and not gaps[order[at]] > stop * kth:
            some = order[at : at + 4]
            some = some[~(gaps[some] > stop * kth)]
            rows = np.concatenate([tree.rows[s] for s in some])
            rows = rows[ids[rows] != q_ids[i]]
            d = ((x[rows] - q[i]) ** 2).sum(axis=1)
            best_i, best_d = np.concatenate([best_i, ids[rows]]), np.concatenate([best_d, d])
            nearest = np.lexsort((best_i, best_d))[:k]
            best_i, best_d = best_i[nearest], best_d[nearest]
            if len(best_d) == k:
                kth = min(kth, best_d[-1])
            at += len(some)
        yield i, best_i, np.sqrt(best_d)


def nearest(table: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, confidence: float = 0.97, sample: int = 1 << 18, cell_rows: int = 2048, block_rows: int = 8192, query_rows: int = 4096, seed: int = 11) -> DataFrame:
    """(query_id, rank, id_col, score): for each row for which `queries` holds its k nearest other rows found, nearest first, by
    Euclidean distance in double precision; ties to the smaller id; all others if there are fewer.

    Rows with a null id, and vectors that are null, empty, zero, hold null or non-finite components, or differ in length from
    most of the table take no part. Rows that share the query's id count as its own; of several queries of one id the smallest
    vector asks. Exact copies are rows of their own. Cells of more than block_rows rows (copies can't be cut apart) are dealt by
    id hash to blocks that are searched one by one, and many queries of one block in parts, so no group grows with the data.
    Every row is indexed; the index is exact but for the stopping test, whose confidence bounds what may be missed.
    """
    spark = table.sparkSession
    kind = "float" if table.schema[vector_col].dataType.elementType == T.FloatType() else "double"  # as stored; reckoned in double
    rows = table.where(usable(id_col, vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n_rows = (lengths["dim"], lengths["count"]) if lengths else (1, 0)
    stop, g = chi_square_quantile(confidence), np.random.default_rng(seed).standard_normal((dim, M))

    def matrix(column, width: int = dim) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)

    def listed(x: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), x.shape[1]).cast(pa.list_(pa.float64()))

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, listed(matrix(batch.column(1)) @ g)], names=["id", "v", "asks", "p"])

    rows = rows.where(F.size("v") == dim).mapInArrow(project, f"id bigint, v array<{kind}>, asks boolean, p array<double>")
    shared = spark.sparkContext.broadcast(fit(rows, n_rows, sample, cell_rows))

    @F.arrow_udf("bigint")
    def cell_of(p: pa.Array) -> pa.Array:
        return pa.array(shared.value.leaf_of(matrix(p, M)), pa.int64())

    placed = materialize(rows.select(cell_of("p").alias("cell"), "id", "v", "asks"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts")).collect()  # a row for each cell
    parts = spark.createDataFrame([(r.cell, int(r.parts)) for r in sizes], "cell bigint, parts int")
    blocks = placed.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, x = left.column("id").to_numpy(), matrix(left.column("v").combine_chunks())
            q_ids, q = right.column("query_id").to_numpy(), matrix(right.column("q").combine_chunks())
            for i, got, d in search_block(ids, x, g, q_ids, q, right.column("bound").to_numpy(), k, stop):
                out[0].append(np.full(len(got), q_ids[i]))
                out[1].append(got)
                out[2].append(d)
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    def searched(routes: DataFrame, label: str) -> DataFrame:
        """The nearest rows that each block holds for the queries sent to its cell."""
        sent = materialize(routes.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "q", "bound"), label)
        loads = sent.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("turns"))
        sent = sent.join(loads, ["cell", "part"]).withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns").cast("int")).drop("turns")
        held = blocks.join(loads, ["cell", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        key = ["cell", "part", "turn"]
        return materialize(held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(search, "query_id bigint, id bigint, score double"), f"{label}-found")

    def route(batches):
        """The other cells that may hold a row nearer than the k-th of the query's own cell."""
        cells = shared.value
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column(2))
                visits = [np.flatnonzero(~(cells.gap2(p) > stop * bound**2)) for p, bound in zip(q @ g, batch.column(3).to_numpy(), strict=True)]
                visits = [v[v != own] for v, own in zip(visits, batch.column(0).to_numpy(), strict=True)]
                again = np.repeat(np.arange(len(q)), [len(v) for v in visits])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(visits), pa.int64()), batch.column(1).take(pa.array(again)), batch.column(2).take(pa.array(again)), batch.column(3).take(pa.array(again))], names=["cell", "query_id", "q", "bound"])

    asked = placed.where("asks").groupBy("id").agg(F.min(F.struct("v", "cell")).alias("x")).select(F.col("x.cell").alias("cell"), F.col("id").alias("query_id"), F.col("x.v").alias("q"), F.lit(float("inf")).alias("bound"))
    near = _best(searched(asked, "home"), k)
    bounds = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    asked = asked.join(bounds, "query_id", "left").select("cell", "query_id", "q", F.coalesce("kth", "bound").alias("bound"))
    far = searched(asked.mapInArrow(route, f"cell bigint, query_id bigint, q array<{kind}>, bound double"), "far")
    return _best(near.drop("rank").unionByName(far), k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
