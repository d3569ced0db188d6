"""Language identification: multinomial logistic regression on hashed TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader (FTRL-Proximal) with elastic-net penalties, which leaves most of them
zero; a temperature fitted on a part of the sample that training doesn't see turns scores into calibrated probabilities.
Document frequencies are counted over all labelled documents; the weights are fitted on a bounded sample of them (`sample` ids,
the labels in turn) whose n-gram counts executors extract; every document is then scored over its whole text. A text is
accepted by how familiar its n-grams are, not by its score: that is at least 1/K for K labels, whatever the text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import crc_bucket, fresh, runs, slices

UNKNOWN = "und"
#: Hashed n-gram features and the longest n-gram.
WIDTH, ORDERS = 1 << 15, (1, 2, 3)
#: Characters that are counted at a time; a longer text is counted piece by piece, overlapping by the longest n-gram.
PIECE = 1 << 20
_MIX = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of the lower-cased letters, with one space for whatever stands between them; None if
    there is no letter."""
    if not text:
        return None
    letter, total, some = _is_letter(), np.zeros(WIDTH, dtype=np.int64), False
    for at in range(0, len(text), PIECE):
        cps = np.frombuffer(text[max(0, at - max(ORDERS) + 1) : at + PIECE].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        keep = letter[cps]
        some = some or bool(keep.any())
        cps = np.where(keep, cps, np.uint32(32))
        cps = cps[np.concatenate([[True], keep[1:] | keep[:-1]])] if len(cps) else cps
        for n in ORDERS:
            if len(cps) < n:
                break
            h = np.full(len(cps) - n + 1, n, dtype=np.uint32)
            for j in range(n):
                h = (h ^ cps[j : len(cps) - n + 1 + j]) * _MIX[j]
                h ^= h >> np.uint32(15)
            total += np.bincount(h & np.uint32(WIDTH - 1), minlength=WIDTH)
    return total if some else None


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: (1 + log tf) idf, of length 1."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(np.sqrt(v @ v), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """FTRL-Proximal with per-coordinate rates for a softmax over `classes`."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3

    def __post_init__(self) -> None:
        self.z = np.zeros((WIDTH, self.classes))
        self.n = np.zeros((WIDTH, self.classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[label] -= 1
        g = v[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    most_surprise: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, calibrated score, and whether the text's n-grams are familiar: an answer that doesn't depend on the number of
        labels, as a score does."""
        counts = ngram_counts(text) if self.labels else None
        if counts is None:
            return UNKNOWN, 0.0, False
        at, v = weigh(counts, self.idf)
        p = softmax(v @ self.weights[at] / self.temperature)
        k = int(p.argmax())  # ties: the first label in text order
        return self.labels[k], float(p[k]), surprise(at, counts[at], self.idf) <= self.most_surprise


def surprise(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> float:
    """Mean inverse document frequency of a text's n-grams: low where they are those of the documents learned from."""
    return float(n @ idf[at] / n.sum())


def fit_counts(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int, epochs: int = 3) -> Model:
    """Model from (label, n-gram numbers, counts) and the document frequencies of all learnable documents; every fifth row is
    kept for the temperature and for the bound on surprise. That bound lies halfway from the kept rows' median to the mean over
    all n-gram numbers, which a text of unknown n-grams has, and is at least as high as every kept row's."""
    labels = sorted({r[0] for r in rows})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    if not labels:
        return Model([], idf, np.zeros((WIDTH, 0)), 1.0, 0.0)
    number = {label: k for k, label in enumerate(labels)}

    def values(at: np.ndarray, n: np.ndarray) -> np.ndarray:  # made anew each time: kept for all rows they are four times as large
        v = (1 + np.log(n)) * idf[at]
        return v / np.sqrt(v @ v)

    learner, order = Ftrl(len(labels)), np.random.default_rng(7)
    learned, kept = [x for k, x in enumerate(rows) if k % 5], rows[::5]
    for _ in range(epochs):
        for k in order.permutation(len(learned)):
            label, at, n = learned[k]
            learner.learn(at, values(at, n), number[label])
    w = learner.weights()
    z = np.array([values(at, n) @ w[at] for _, at, n in kept])
    y = np.array([number[label] for label, _, _ in kept])
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    grid = np.geomspace(0.05, 5, 60)
    seen = np.array([surprise(at, n, idf) for _, at, n in rows[::5]])
    bound = max(seen.max(), (np.median(seen) + idf.mean()) / 2)
    return Model(labels, idf, w, float(min(grid, key=loss)), float(bound))


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram number stands, over all texts, and how many hold a letter. Tasks add up their texts before
    anything is shuffled; the driver gets one row for each number."""

    def count(batches):
        df, n = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text)
                if counts is not None:
                    df += counts > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, WIDTH), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["number", "docs"])

    df = np.zeros(WIDTH + 1, dtype=np.int64)
    found = texts.mapInArrow(count, "number int, docs bigint").groupBy("number").agg(F.sum("docs").alias("docs")).toPandas()  # two arrays: as rows they would take a hundred times that
    df[found["number"].to_numpy()] = found["docs"].to_numpy()
    return df[:WIDTH], int(df[WIDTH])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000) -> Model:
    """Document frequencies come from all rows with an id, a text and a label; weights from at most `sample` ids of these, dealt
    to the labels in turn (smallest id hash first), so that a rare label is learned beside a hot one. An id's label is its
    smallest; of rows that share an id, one counts. Rows without letters teach nothing; without any usable row the model has no
    label and predicts `und`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("id is not null and lang is not null and t is not null")
    ids = rows.groupBy("id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("id"))
    # the 4 x sample smallest hashes of each label, by its count: what is ranked stays small whatever a label's size
    few = ids.join(ids.groupBy("lang").count(), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("count") < 4 * sample)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    picked = few.withColumn("turn", turn).where(F.col("turn") <= sample).orderBy("turn", "h", "id").limit(sample).select("id")

    def count(batches):
        for batch in slices(batches):
            found = [ngram_counts(x) for x in batch.column(2).to_pylist()]
            at = [None if c is None else np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([None if c is None else c[a] for a, c in zip(at, found, strict=True)], pa.list_(pa.int32()))], names=["id", "lang", "at", "n"])

    texts = rows.join(F.broadcast(picked), "id", "left_semi").select("id", "lang", "t")
    got = texts.mapInArrow(count, "id string, lang string, at array<int>, n array<int>").where("at is not null").groupBy("id").agg(F.min(F.struct("lang", "at", "n")).alias("x")).select("id", "x.*").toArrow().combine_chunks()
    # views of two arrays for the whole sample: as objects they would take ten times that
    lists = [got.column(c).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("at", "n")]
    cut, (flat_at, flat_n) = lists[0].offsets.to_numpy(), (x.values.to_numpy() for x in lists)
    named = sorted((i, k, lang) for k, (i, lang) in enumerate(zip(got.column("id").to_pylist(), got.column("lang").to_pylist(), strict=True)))
    return fit_counts([(lang, flat_at[cut[k] : cut[k + 1]], flat_n[cut[k] : cut[k + 1]]) for _, k, lang in named], *_document_frequencies(rows.select("t")))


def _predict_column(spark, model: Model, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, known boolean")
    def predict(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(x) for part in runs(texts) for x in part]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=["lang_pred", "score", "known"])

    return predict(text.cast("string"))


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs and its columns lang_pred and score (in their place if docs has such), a row for each input row.

    A null text or one without a letter is `und` with score 0; a text of any length is read whole; repeated rows and null ids
    stay. The broadcast model has a fixed number of features for each label.
    """
    got, = fresh(docs, "predicted")
    out = docs.withColumn(got, _predict_column(docs.sparkSession, model, F.col(text_col)))
    return out.withColumns({"lang_pred": F.col(f"{got}.lang_pred"), "score": F.col(f"{got}.score")}).drop(got)


def learnable(docs: DataFrame, id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> DataFrame:
    return docs.where(crc_bucket(id_col, folds) != held_out)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs in a language the model knows: with a letter, and n-grams no more surprising than the model's bound;
    columns as in docs. Scored in place, without a join."""
    got, = fresh(docs, "predicted")
    return docs.withColumn(got, _predict_column(docs.sparkSession, model, F.col(text_col))).where(F.col(f"{got}.known")).drop(got)
