"""Similarity join of texts by the Jaccard similarity of their word n-grams (shingles), closed over links.

Shingles are ordered rare first, by counts over all texts in a fixed table of counters (ties, and shingles that share a counter,
by hash; any order gives the same links). In that order two sets of enough similarity share one of their first
n - ceil(similarity * n) + 1 shingles, so texts are joined on these prefixes. What the filters do:

* length: a set of n shingles has partners of similarity * n to n / similarity only;
* position: from a shared shingle at place `at` on, n - at shingles are left, which bounds the partner's length further. Where a
  prefix shingle has many texts, classes of both lengths are part of the join key, so texts that can't be partners never meet;
* suffix: a histogram of hashes, less what stands before the first shared shingle, bounds what two sets share after it.

What passes is verified once a pair on whole sets. Groups of near copies come first: a text's shingles of smallest hash link it
to a few likely copies, these pairs are verified, and the join then looks only for pairs between the classes found. A large group
so costs its rows, not its pairs, and no link between different texts is lost. Groups that stay large are cut into square tiles.
"""

from __future__ import annotations

import zlib
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._common import discard, materialize, slices
from ledgerloom.llm.components import components

#: Shingles of smallest hash that the first step looks at, how many of them a pair of it must have in common, and members of one
#: shingle's group that one task puts in order. What the first step leaves out, the join finds.
ANCHORS, AGREEING, CHAIN = 8, 3, 4096
#: Counters of shingles (a table of fixed size, 16 MB, is broadcast), and the parts in which tasks send theirs.
COUNTERS, PARTS = 1 << 22, 64
#: Rows of a prefix shingle above which lengths are part of the join key, and rows of one side of a tile.
LIGHT, TILE = 64, 2048
#: Size of the bitmap of ids whose sets are asked for.
ASKED_BITS = 1 << 25


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of a UTF-8 text's word shingles in order, repeats included; of all its words if there are fewer, none without words."""
    words = (text or b"").lower().split()  # of bytes: A-Z only; cut at space, tab, line feed, vertical tab, form feed, return
    n, hashed = max(min(len(words), 1), len(words) - shingle + 1), xxhash.xxh64_intdigest
    return np.fromiter((hashed(b" ".join(words[i : i + shingle]), seed) for i in range(n)), dtype=np.uint64, count=n)


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 7) -> np.ndarray:
    """Sorted different hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle, seed))


def shingle_counts(source: DataFrame, shingle: int, counters: int = COUNTERS) -> np.ndarray:
    """In how many rows of source(t) shingles stand, counted over all rows by the lower bits of their hash: `counters` numbers.

    A task counts in a table of its own and sends it in compressed parts, so what is shuffled and what the driver gets is bounded
    by the table's size and doesn't grow with the number of different shingles.
    """
    size = counters // PARTS

    def count(batches):
        mine = np.zeros(counters, dtype=np.uint32)
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            at, n = np.unique(np.concatenate(sets) & np.uint64(counters - 1), return_counts=True)
            mine[at.astype(np.int64)] += n.astype(np.uint32)
        for part in range(PARTS):
            some = mine[part * size : (part + 1) * size]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(part, np.zeros(size, dtype=np.int64))[:] += np.frombuffer(zlib.decompress(counts), np.uint32)
        for part, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(np.minimum(n, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary())], names=["part", "counts"])

    out = np.zeros(counters, dtype=np.uint32)
    for row in source.select("t").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(total, "part int, counts binary").collect():
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out


def rare_first(s: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set of which every set of at least `similarity` has one among its own: rare ones first, ties by hash."""
    if not len(s):
        return s
    return s[np.lexsort((s, counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]))][: len(s) - ceil(similarity * len(s) - 1e-9) + 1]


def histogram(s: np.ndarray) -> bytes | None:
    """How many shingles of a set fall into each of 2**k classes of hashes, half as many as shingles or up to four times that,
    a byte for each; None if a class has too many for that."""
    size = 1 << max(6, min(13, (max(len(s), 2) - 1).bit_length() - 1))
    n = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def most_shared(a: bytes | None, b: bytes | None, most: int, before_a=(), before_b=()) -> int:
    """Upper bound of the number of shingles that two sets with these histograms share, or `most` where one has none; before_a and
    before_b are shingles of either that the other is known not to have."""
    if a is None or b is None:
        return most
    each = []
    for h, before in ((a, before_a), (b, before_b)):
        n = np.frombuffer(h, np.uint8).astype(np.int64)
        if len(before):
            n -= np.bincount(np.asarray(before, dtype=np.int64) & (len(n) - 1), minlength=len(n))
        each.append(n)
    size = min(map(len, each))
    return int(np.minimum(*(n.reshape(-1, size).sum(axis=0) for n in each)).sum())


def sketches(source: DataFrame, shingle: int, similarity: float, of_hashes=None) -> tuple[DataFrame, Broadcast]:
    """(row, id, text_hash, same, n, mark, anchors, prefix, classes) for each row of source(id, text_hash, t): a number, a 128-bit digest and the size of
    its shingle set, of_hashes of all its shingles (a 64-bit number; null without), its shingles of smallest hash, those of prefix
    filtering, and its histogram. The broadcast is the shingles' counts, to be destroyed once the rows are written."""
    counts = source.sparkSession.sparkContext.broadcast(shingle_counts(source, shingle))

    def sketch(batches):
        for batch in slices(batches):
            hashes = [shingle_hashes(t, shingle, 7) for t in batch.column(3).to_pylist()]
            sets = [np.unique(h) for h in hashes]
            firsts = [rare_first(s, counts.value, similarity).view(np.int64) for s in sets]
            marks = pa.array(np.array([of_hashes(h) for h in hashes], dtype=np.uint64).view(np.int64)) if of_hashes else pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), marks, pa.array([s[:ANCHORS].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64())), pa.array([histogram(s) for s in sets], pa.binary())], names=["row", "id", "text_hash", "same", "n", "mark", "anchors", "prefix", "classes"])

    longs = T.ArrayType(T.LongType())
    fields = {"row": T.LongType(), "id": source.schema["id"].dataType, "text_hash": T.LongType(), "same": T.BinaryType(), "n": T.IntegerType(), "mark": T.LongType(), "anchors": longs, "prefix": longs, "classes": T.BinaryType()}
    return source.select(F.monotonically_increasing_id().alias("row"), "id", "text_hash", "t").mapInArrow(sketch, T.StructType([T.StructField(c, t) for c, t in fields.items()])), counts


def likely_pairs(reps: DataFrame) -> DataFrame:
    """(a, b), a < b: a few pairs of reps(node, n, anchors) that are likely to be copies.

    An anchor's group is linked to its smallest node and along one order, in parts of at most about CHAIN rows, so a shingle that
    a third of all rows hold costs two links a row and no task gets its whole group; a pair counts if it comes about in AGREEING
    groups (in half of them for sets with fewer anchors), so passages that many texts share make none by themselves.
    """
    members = reps.select("node", "n", F.least(F.lit(AGREEING), F.ceil(F.size("anchors") / 2)).alias("enough"), F.explode("anchors").alias("anchor"))
    heads = members.groupBy("anchor").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    grouped = members.join(heads, "anchor").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHAIN)).cast("int"))
    before = F.lag("node").over(Window.partitionBy("anchor", "part").orderBy("n", "node"))
    pairs = grouped.select("node", "enough", "head", before.alias("before")).select(F.explode(F.array_distinct(F.array("head", "before"))).alias("a"), F.col("node").alias("b"), "enough").where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("enough").alias("enough")).where("k >= enough").select("a", "b")


def _met(x: DataFrame, y: DataFrame, keys: list[str], condition: str) -> DataFrame:
    """Pairs of rows of x and y with equal keys: (a, b, ca, cb, at_a, at_b), a < b."""
    met = x.alias("x").join(y.alias("y"), F.expr(" and ".join([f"x.{k} = y.{k}" for k in keys] + [condition])))
    swap = F.expr("x.node > y.node")
    side = lambda c, one, other: F.when(swap, F.col(f"{other}.{c}")).otherwise(F.col(f"{one}.{c}"))
    return met.select(*[side(c, one, other).alias(name) for name, c, one, other in (("a", "node", "x", "y"), ("b", "node", "y", "x"), ("ca", "comp", "x", "y"), ("cb", "comp", "y", "x"), ("at_a", "at", "x", "y"), ("at_b", "at", "y", "x"))])


def prefix_pairs(reps: DataFrame, known: DataFrame, similarity: float, held: list[str]) -> DataFrame:
    """(a, b, ca, cb, at_a, at_b): each pair of nodes of known(node, comp) with different comp that the length and position filters
    let pass, once, with their comps and the places of their first shared shingle.

    Shingles of one node or one comp are dropped before rows meet, by pre-aggregation. Where most rows of a shingle are of one
    comp, only the others look for partners. A shingle with more than LIGHT rows is joined with the classes of both lengths in
    the key: a row asks for the classes that its own length and place allow, which for a row of a common shingle, late in its
    prefix, are short sets only. What is still large then is dealt in tiles of at most about TILE by TILE rows.
    """
    t = similarity
    each = reps.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = each.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("shingle")
    mixed = each.join(shared, "shingle").join(known, "node")
    mixed = materialize(mixed, "shared", held)
    of_class = mixed.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
    classes = of_class.groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.count(F.lit(1)).alias("classes"), F.sum("k").alias("size"))
    mixed = materialize(mixed.join(classes.where("classes > 1").drop("classes"), "shingle"), "mixed", held)
    length = f"least(x.n, y.n) >= {t} * greatest(x.n, y.n) - 1e-6"
    position = f"least(x.n - x.at, y.n - y.at) >= {t / (1 + t)} * (x.n + y.n) - 1e-6"
    rows = mixed.where(F.col("size") <= LIGHT)
    light = _met(rows.where("comp <> most"), rows, ["shingle"], f"x.comp <> y.comp and (y.comp = x.most or x.node < y.node) and {length} and {position}")
    dense = tiles(length_keys(mixed.where(F.col("size") > LIGHT), t))
    heavy = _met(dense.where("shorter"), dense.where("not shorter"), ["shingle", "short", "long", "turn", "i", "j"], f"x.comp <> y.comp and (x.n < y.n or x.n = y.n and x.node < y.node) and {length} and {position}")
    first = F.min(F.struct("at_a", "at_b")).alias("first")
    return light.unionByName(heavy).groupBy("a", "b", "ca", "cb").agg(first).select("a", "b", "ca", "cb", "first.*")


def length_keys(rows: DataFrame, similarity: float) -> DataFrame:
    """rows(shingle, node, n, at, comp, most) once for each pair of length classes in which each can have a partner: with short and
    long, the classes, shorter, whether the row is the shorter one, and turn: at 1 rows of the less frequent comps that are
    shorter meet all longer ones, at 2 the others that are shorter meet the less frequent ones that are longer."""
    step = -0.5 * log(similarity)
    of = lambda x: F.floor(F.log(x) / step).cast("int")
    n = F.col("n")
    least = F.ceil(similarity * n - 1e-6)
    most = F.floor((1 + similarity) / similarity * (n - F.col("at")) - n + 1e-6)
    upper = F.least(most, F.floor(n / similarity + 1e-6))
    few = F.col("comp") != F.col("most")
    entry = lambda c, shorter: F.struct((of(n) if shorter else c).alias("short"), (c if shorter else of(n)).alias("long"), F.lit(shorter).alias("shorter"))
    listed = lambda lo, hi, shorter: F.when(hi >= lo, F.transform(F.sequence(of(lo), of(hi)), lambda c: entry(c, shorter))).otherwise(F.array().cast("array<struct<short:int,long:int,shorter:boolean>>"))
    keys = F.concat(listed(n, upper, True), listed(least, F.least(most, n), False))
    turns = F.when(F.col("shorter"), F.array(F.when(few, 1).otherwise(2))).when(few, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    wide = rows.select("shingle", "node", "n", "at", "comp", "most", F.explode(keys).alias("k")).select("*", "k.*")
    return wide.select("shingle", "node", "n", "at", "comp", "short", "long", "shorter", F.explode(turns).alias("turn"))


def tiles(rows: DataFrame) -> DataFrame:
    """Rows of length_keys with i and j: each once for each tile in which it meets partners. Keys without both sides are dropped."""
    keys = ["shingle", "short", "long", "turn"]
    one = F.sum(F.col("shorter").cast("long"))
    sizes = rows.groupBy(*keys).agg(one.alias("ks"), (F.count(F.lit(1)) - one).alias("kl")).where("ks > 0 and kl > 0")
    parts = lambda k: F.ceil(F.col(k) / TILE).cast("int")
    own = lambda k: F.pmod(F.xxhash64("node"), parts(k)).cast("int")
    every = lambda k: F.sequence(F.lit(0), parts(k) - 1)
    places = F.when(F.col("shorter"), F.transform(every("kl"), lambda j: F.struct(own("ks").alias("i"), j.alias("j")))).otherwise(F.transform(every("ks"), lambda i: F.struct(i.alias("i"), own("kl").alias("j"))))
    return rows.join(sizes, keys).select(*keys, "node", "n", "at", "comp", "shorter", F.explode(places).alias("p")).select("*", "p.*").drop("p")


def sets_of(source: DataFrame, asked: DataFrame, shingle: int) -> tuple[DataFrame, Broadcast]:
    """(same, set): the shingle sets of rows of source(id, t), those with an id of asked(id) and few others, by their digests.

    Texts are read where they lie, so none is shuffled: asked ids set bits in a bitmap of fixed size (ASKED_BITS), which is all
    that is broadcast, and only rows whose bit is set make a set.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(ASKED_BITS))
    words = asked.select(bit("id").alias("bit")).groupBy((F.col("bit") / 32).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("bits")).toPandas()
    bitmap = np.zeros(ASKED_BITS // 32, dtype=np.uint32)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = source.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches):
        for batch in slices(batches):
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array((shared.value[bits >> 5] >> (bits & 31).astype(np.uint32) & 1).astype(bool)))
            made = [shingle_set(t, shingle) for t in some.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(s.tobytes()) for s in made], pa.binary()), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], names=["same", "set"])

    return source.select("t", bit("id").alias("bit")).mapInArrow(sets, "same binary, set array<bigint>"), shared


def both_sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs(a, b, ..) with x and y, the column of table(node, ..) for each end."""
    return pairs.join(table.select(F.col("node").alias("a"), F.col(column).alias("x")), "a").join(table.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")


def possible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Those pairs(a, b, ..) whose histograms allow the similarity: most pairs of texts that share only a part fall out without a
    look at their sets, which are sixteen times as large. With columns at_a and at_b, the places of the first shared shingle, it is
    a filter of suffixes: what stands before them in either prefix is in one set only."""
    names, placed = pairs.columns, "at_a" in pairs.columns
    fields = ["n", "classes", *["prefix"] * placed]

    def run(batches):
        for batch in slices(batches, 1024):
            (m, p, *u), (n, q, *v) = ([batch.column(c).field(f).to_pylist() for f in fields] for c in (0, 1))
            places = [batch.column(2 + names.index(c)).to_pylist() for c in ("at_a", "at_b")] if placed else None
            before = [(u[0][k][: places[0][k]], v[0][k][: places[1][k]]) if placed else ((), ()) for k in range(batch.num_rows)]
            ok = [(1 + similarity) * most_shared(p[k], q[k], min(m[k], n[k]), *before[k]) >= similarity * (m[k] + n[k]) - 1e-6 for k in range(batch.num_rows)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in range(2, kept.num_columns)], names=names)

    wide = both_sides(pairs, reps.select("node", F.struct(*fields).alias("of")), "of")
    return wide.select("x", "y", *names).mapInArrow(run, pairs.schema)


def similar(a: str, b: str, similarity: float) -> Column:
    """Whether two columns of sets reach the similarity."""
    shared = F.size(F.array_intersect(a, b))
    return shared >= similarity * (F.size(a) + F.size(b) - shared) - 1e-9


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float = 0.9, blank_linked: bool = False, of_hashes=None, more_pairs=None) -> DataFrame:
    """(id_col, n_shingles, component_id, text_hash) for each row of docs: the size of its shingle set, the smallest id that links
    reach from it, its own included, and Spark's xxhash64 of its text. Rows link if their sets have a Jaccard similarity of at least `similarity`.

    Words are cut at ASCII white space, A-Z lower-cased; a text of fewer than `shingle` words is one shingle. Rows of equal sets are
    one node from the start, by a 128-bit digest, so rows that share an id are judged each by its own text. Texts without words,
    empty or null, link with nothing, or with one another if blank_linked. A row with a null id links like any other and gets the
    smallest id of its class, null if that has none. Repeated rows stay repeated; an empty table gives an empty result; other
    columns are not read. more_pairs(reps) may give more pairs (a, b) for the first step from `mark`, of_hashes of all shingles.
    """
    spark, held = docs.sparkSession, []
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("t"))
    rows, counts = sketches(source, shingle, similarity, of_hashes)
    marked = materialize(rows, "sketches", held)
    counts.destroy()
    heads = materialize(marked.groupBy("same").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.max("n").alias("n")), "heads", held)
    own = marked.where("n > 0").join(heads.select(F.col("node").alias("row")), "row", "left_semi")
    reps = materialize(own.withColumnRenamed("row", "node"), "representatives", held)
    pairs = likely_pairs(reps)
    if more_pairs:
        pairs = pairs.unionByName(more_pairs(reps)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "pairs", held)

    def classes_of(pairs, a, b):
        """Components of the verified pairs; what is written on the way is deleted."""
        mine: list[str] = []
        pairs = materialize(possible(pairs, reps, similarity), "possible", mine)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps.select("node", "id", "same"), "node")
        wanted = materialize(wanted, "wanted", mine)
        found, bitmap = sets_of(source, wanted, shingle)
        sets = found.join(wanted.select("node", "same"), "same").groupBy("node").agg(F.any_value("set").alias("set"))
        both = both_sides(pairs, materialize(sets, "sets", mine), "set")
        bitmap.destroy()
        labels = components(both.where(similar("x", "y", similarity)).select(F.col(a).alias("src"), F.col(b).alias("dst")))
        discard(spark, mine)
        return labels

    labels = classes_of(pairs, "a", "b")
    known = materialize(reps.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("comp")), "known", held)
    met: list[str] = []
    rest = materialize(prefix_pairs(reps, known, similarity, met), "rest", held)
    discard(spark, met)
    labels = classes_of(rest, "ca", "cb")
    comps = known.join(labels.select(F.col("node").alias("comp"), "label"), "comp", "left").select("node", F.coalesce("label", "comp").alias("label"))
    owned = materialize(heads.join(comps, "node", "left").select("same", "n", "least", F.coalesce("label", "node").alias("label")), "owned", held)
    of_class = owned.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = owned.join(of_class, "label").select("same", "component_id")
    component = F.when((F.col("n") == 0) & F.lit(not blank_linked), F.col("id")).otherwise(F.col("component_id"))
    out = materialize(marked.select("id", "n", "text_hash", "same").join(of_set, "same").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "text_hash"), "jaccard")
    discard(spark, held)
    return out
