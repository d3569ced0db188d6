"""Spelling variants of a corpus's words by dynamic programming over the sorted vocabulary.

Two words are near if one inserted, deleted or replaced character separates them. A word is held against a sorted list of words
by rows of the edit matrix, of which a band of three cells matters. Neighbours in the list share a prefix (adjacent longest common
prefixes say how long), and so do their rows: each range of the list with one prefix gets one row, made from the row of the range
around it, and a range whose row has no cell of at most one edit is skipped with all it holds. All ranges of one depth, of many
words, are handled at a time in numpy.

The list is dealt out so that near words meet in short lists. The shorter of two near words, of n characters, shares its first or
its last n // 2 characters with the other, so words are sorted within groups of equal beginnings, and once more, read backwards,
within groups of equal endings. A group above GROUP words is cut into tiles; each tile holds its part of the list and is asked by
all words of the group, which are read in chunks, so no task holds more than a tile and a chunk, however large a group is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import discard, materialize, slices

#: Words of one tile, and of one chunk that asks it.
GROUP, CHUNK = 20_000, 20_000
_RUNS = re.compile("[a-zÀ-ÿ]+")


def words_of(doc_id, text: str | None, every: int = 97) -> Counter:
    """Words of a text with their occurrences: runs of Latin letters (U+00C0 to U+00FF included), A-Z lower-cased; where `every`
    divides the crc32 h of `<doc_id>:<run>`, without the character h % length. No words for null; a null id counts as empty."""
    out: Counter = Counter()
    if not text:
        return out
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUNS.findall(text.encode().lower().decode())).items():  # of bytes: A-Z only
        h = zlib.crc32(run.encode(), before)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): words of at least min_length characters with at least min_count occurrences in all texts."""

    def run(batches):
        for batch in slices(batches):
            counts: Counter = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update(words_of(doc_id, text, every))
            kept = [(w, n) for w, n in counts.items() if len(w) >= min_length]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def matrix(words: list[bytes], width: int) -> np.ndarray:
    """A row of characters for each word, then zeros."""
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)


def near_in_list(listed: np.ndarray, list_group: np.ndarray, asked: np.ndarray, ask_group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all asked[i] and listed[j] of one group that differ by one insertion, deletion or replacement.

    listed: characters of different words, zeros behind them, sorted within each group and groups one after another in order of
    list_group; asked: the same for those that ask. All words of a group share their first `depth` characters.
    """
    nothing = np.zeros(0, np.int64)
    if not len(listed) or not len(asked):
        return nothing, nothing
    width = listed.shape[1]
    same = listed[1:] == listed[:-1]
    lcp = np.concatenate([[-1], np.where(list_group[1:] != list_group[:-1], -1, np.where(same.all(axis=1), width, np.argmin(same, axis=1)))])
    lengths = (asked != 0).sum(axis=1)
    wide = np.pad(asked, ((0, 0), (0, 3)))
    starts = np.flatnonzero(lcp < 0)  # ranges of the list with one prefix of the depth at hand
    at = np.minimum(np.searchsorted(list_group[starts], ask_group), len(starts) - 1)
    q = np.flatnonzero(list_group[starts][at] == ask_group)
    node = at[q]
    r0, r1, r2 = np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)  # edits to depth - 1, depth, depth + 1 characters
    if depth == 0:
        r0[:] = 2
    found_q, found_w = [], []
    while len(q) and depth < width:
        inner = np.flatnonzero(lcp < depth + 1)
        first = np.append(np.searchsorted(inner, starts), len(inner))
        size = first[node + 1] - first[node]
        take = np.repeat(np.arange(len(q)), size)
        child = np.arange(len(take)) - np.repeat(np.cumsum(size) - size, size) + first[node][take]
        c = listed[inner[child], depth]
        ended = c == 0
        done, word = take[ended], inner[child[ended]]
        cell = lengths[q[done]] - depth
        edits = np.select([cell == -1, cell == 0, cell == 1], [r0[done], r1[done], r2[done]], 2)
        found_q.append(q[done][edits == 1])
        found_w.append(word[edits == 1])
        take, child, c = take[~ended], child[~ended], c[~ended]
        of = q[take]
        n0 = np.minimum(r0[take] + (wide[of, depth - 1] != c) if depth else 2, r1[take] + 1)
        n1 = np.minimum(np.minimum(r1[take] + (wide[of, depth] != c), r2[take] + 1), n0 + 1)
        n2 = np.minimum(r2[take] + (wide[of, depth + 1] != c), n1 + 1)
        alive = np.minimum(np.minimum(n0, n1), n2) <= 1
        q, node, starts, depth = of[alive], child[alive], inner, depth + 1
        r0, r1, r2 = (np.minimum(x[alive], 2).astype(np.int8) for x in (n0, n1, n2))
    return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (nothing, nothing)


def _near_pairs(group: int):
    """For mapInArrow: rows (depth, backward, tile, key, asks, word, n), sorted so -> near pairs (a, na, b, nb), a < b; those of equal
    endings only if they don't share their beginnings. asks: -1 is listed only, 1 asks only, 0 both."""
    names = ["a", "na", "b", "nb"]

    def answer(of, listed, asking):
        depth, backward = of
        if not listed or not asking:
            return
        width = max(len(x[1]) for x in (*listed, *asking)) + 1
        numbers = [np.array([x[0] for x in rows]) for rows in (listed, asking)]
        i, j = near_in_list(matrix([x[1] for x in listed], width), numbers[0], matrix([x[1] for x in asking], width), numbers[1], depth)
        out = []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            (_, x, nx), (_, y, ny) = asking[p], listed[q]
            if backward:
                x, y = x[::-1], y[::-1]
            half = min(len(x), len(y)) // 2
            if x < y and half == depth and not (backward and x[:half] == y[:half]):
                out.append((x.decode("latin-1"), nx, y.decode("latin-1"), ny))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())]))

    def run(batches):
        listed, asking, of, place, number = [], [], None, None, 0
        for batch in batches:
            for depth, backward, tile, key, asks, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, backward, tile, key) != place:
                    if (depth, backward) != of or len(listed) > CHUNK or len(asking) > CHUNK:
                        if of:
                            yield from answer(of, listed, asking)
                        listed, asking = [], []
                    of, place, number = (depth, backward), (depth, backward, tile, key), number + 1
                row = (number, word.encode("latin-1"), n)
                if asks <= 0:
                    listed.append(row)
                if asks >= 0:
                    asking.append(row)
                    if len(asking) > CHUNK + group:  # in a tiled group, whose list is complete
                        yield from answer(of, listed, asking)
                        listed, asking = [x for x in listed if x[0] == number], []
        if of:
            yield from answer(of, listed, asking)

    return run


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, na, b, nb): all near pairs of words(word, n), a < b, each once. Words are of Latin letters, up to U+00FF, and different.

    Each word stands in up to two groups by its beginning and two by its ending. Sizes of groups are counted first: a word alone
    in its group goes no further, and a group of more than `group` words is tiled.
    """
    n = F.length("word")
    depths = F.array_distinct(F.array(F.floor(n / 2), F.floor((n - 1) / 2)).cast("array<int>"))
    sides = words.select("word", "n", F.explode(depths).alias("depth")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    keyed = sides.select("depth", "backward", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n").withColumn("key", F.expr("left(word, depth)"))
    sizes = keyed.groupBy("depth", "backward", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    found = keyed.join(sizes, ["depth", "backward", "key"])
    tiles = F.ceil(F.col("size") / group).cast("int")
    own = F.pmod(F.hash("word"), tiles)
    one = F.array(F.struct(F.lit(0).alias("tile"), F.lit(0).alias("asks")))
    many = F.concat(F.array(F.struct(own.alias("tile"), F.lit(-1).alias("asks"))), F.transform(F.sequence(F.lit(0), tiles - 1), lambda k: F.struct(k.alias("tile"), F.lit(1).alias("asks"))))
    dealt = found.select("depth", "backward", "key", "word", "n", F.explode(F.when(tiles == 1, one).otherwise(many)).alias("t")).select("depth", "backward", "t.tile", "key", "t.asks", "word", "n")
    order = ["depth", "backward", "tile", "key", "asks", "word", "n"]
    return dealt.repartition("depth", "backward", "tile", "key").sortWithinPartitions(*order).mapInArrow(_near_pairs(group), "a string, na bigint, b string, nb bigint")


def variants(words: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of words(word, n).

    n_near: number of near words; form: the near word of largest n (ties: smallest in code-point order) if that n is at least
    ratio * n, else null, as form_n; root: the last word that forms lead to, the word itself without one. Forms grow by `ratio`, so
    a chain is no longer than the logarithm of the largest n, and following doubles at each round.
    """
    spark, held = words.sparkSession, []
    words = materialize(words, "words", held)
    pairs = near_words(words, group)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))).alias("p")).select("p.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    takes = -F.col("best.less") >= ratio * F.col("n")
    marked = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    marked = materialize(marked, "variants", held)
    roots = materialize(marked.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots", held)
    while not roots.where("moved").isEmpty():
        over = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = materialize(roots.join(over, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots", held)
    out = materialize(marked.join(roots.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "spelling")
    discard(spark, held)
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, every: int = 97, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """variants of the vocabulary of docs. Null and empty texts have no words; an empty table gives an empty result; repeated rows
    count again; other columns are not read."""
    return variants(vocabulary(docs, id_col, text_col, min_length, min_count, every), ratio, group)
