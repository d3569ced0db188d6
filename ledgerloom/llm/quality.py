"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Statistics of whole texts are built-in column functions. On a bounded sample of labelled rows small boosted trees are grown;
each path from a root is a conjunctive rule; a lasso logistic regression over all rules keeps few of them; the kept rules and
their weights become one column expression, so scoring runs inside Spark's generated code without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import fresh

LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123)]))


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, doubles; a null text counts as empty, whose statistics are all 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t).cast("double")
    lacks = lambda s: n - F.length(F.replace(t, F.lit(s), F.lit("")))
    among = lambda s: n - F.length(F.translate(t, s, ""))
    share = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    spaces, lines = lacks(" "), F.split(t, "\n")
    words = F.split(t, " ")
    return {
        "log_chars": F.log1p(n),
        "spaces": share(spaces),
        "lines": share(lacks("\n")),
        "stops": share(lacks(".")),
        "commas": share(lacks(",")),
        "bars": share(lacks("|")),
        "bangs": share(lacks("!")),
        "symbols": share(among("*%$&#@^~=<>{}[]\\/_+")),
        "digits": share(among("0123456789")),
        "capitals": share(among(LETTERS[:26])),
        "small": share(among(LETTERS[26:])),
        "word_size": n / (spaces + 1),
        "new_words": F.when(n > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(0.0)),
        "new_lines": F.when(n > 0, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(0.0)),
    }


#: A rule: conditions (statistic, above?, threshold) that all hold.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class RuleModel:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        """Probability of label 1 as a column expression over columns of statistics."""
        terms = [F.lit(self.bias)]
        for rule, weight in self.rules:
            held = [stats[name] > at if above else stats[name] <= at for name, above, at in rule]
            terms.append(F.when(reduce(and_, held), F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:  # in pairs, so that the expression stays shallow
            terms = [reduce(add, terms[k : k + 2]) for k in range(0, len(terms), 2)]
        total = terms[0]
        return 1 / (1 + F.exp(-total))


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in path]) if path else np.ones(len(x), bool)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, least: int) -> list[tuple[tuple, float, bool]]:
    """One regression tree on gradients g and curvatures h of `rows`: (path, value, is leaf) of its nodes."""
    best = (1e-6, -1, 0.0)
    gt, ht = g[rows].sum(), h[rows].sum()
    for f, edges in enumerate(cuts if depth else []):
        at = np.searchsorted(edges, x[rows, f], side="left")  # x <= edges[k] goes left of cut k
        gs, hs, ns = (np.cumsum(np.bincount(at, weights=w, minlength=len(edges) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
        ok = (ns >= least) & (len(rows) - ns >= least)
        gain = np.where(ok, gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1), 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, float(edges[k]))
    _, f, edge = best
    if f < 0:
        return [(path, gt / (ht + 1), True)]
    nodes = [(path, 0.0, False)]
    for above in (False, True):
        nodes += _grow(x, g, h, cuts, rows[(x[rows, f] > edge) == above], depth - 1, (*path, (f, above, edge)), least)
    return nodes


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, penalty: float = 0.0015, seed: int = 7) -> RuleModel:
    """x: rows by statistics, y: labels 0/1. With one label only (or no row) the model is a constant: its smoothed share, 0.5
    without rows."""
    base = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(base / (1 - base)))
    if len(np.unique(y)) < 2:
        return RuleModel(bias)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    z, paths = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.unique(rng.choice(len(y), size=max(20, len(y) // 2)))
        for path, value, leaf in _grow(x, y - p, np.maximum(p * (1 - p), 1e-6), cuts, rows, depth, (), max(5, len(y) // 500)):
            if path:
                paths.append(path)
            if leaf:
                z[_holds(x, path)] += 0.3 * value
    unique: dict[bytes, tuple] = {}  # rules that hold for the same rows are one
    for path in paths:
        held = _holds(x, path)
        if 0 < held.sum() < len(y):
            key = np.packbits(held).tobytes()
            if key not in unique or len(path) < len(unique[key][0]):
                unique[key] = (path, held)
    if not unique:
        return RuleModel(bias)
    w, b = _lasso(np.column_stack([held for _, held in unique.values()]).astype(float), y, penalty, bias)
    return RuleModel(float(b), [(tuple((names[f], above, t) for f, above, t in path), float(v)) for (path, _), v in zip(unique.values(), w, strict=True) if v])


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, bias: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty on scaled rule weights; the bias is free."""
    scale = np.maximum(r.std(axis=0), 0.05)
    a = np.column_stack([r / scale, np.ones(len(y))])
    step = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.append(np.zeros(r.shape[1]), bias)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        new = v - step * a.T @ (1 / (1 + np.exp(-a @ v)) - y) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return w[:-1] / scale, w[-1]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000) -> RuleModel:
    """Fits on at most `sample` labelled rows, those of smallest id hash. The sample's ids are broadcast (a bounded number), so
    statistics are computed for sampled documents only; the driver gets one row of statistics for each, whatever repeats: of an id's labels
    the smallest counts, of its texts the one with the smallest statistics."""
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample)
    stats = statistics(F.col("t"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "id").select("id", "y", F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"))
    got = rows.groupBy("id", "y").agg(F.min("s").alias("s")).select("id", "y", "s.*").toPandas().sort_values("id", kind="stable")
    return fit_rules(got[list(stats)].to_numpy(dtype=float), got["y"].to_numpy(dtype=float), list(stats))


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs and the columns score (0 to 1) and predicted (1 if score >= threshold), in their place if docs has such.

    A null text scores like an empty one. Rows are scored by themselves: repeats, null ids and ties need no care.
    """
    stats = statistics(F.col(text_col))
    names = dict(zip(stats, fresh(docs, *[f"stat_{n}" for n in stats]), strict=True))
    wide = docs.withColumns({names[n]: c for n, c in stats.items()})
    out = wide.withColumn("score", model.score({n: F.col(c) for n, c in names.items()})).drop(*names.values())
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
