"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a block of documents has one posting list for each of its terms, the sorted positions
at which the term stands in the block. Documents lie GAP positions apart, so no match crosses from one to the next. Blocks
are built where the texts are read (no shuffle of texts) and written to the shared folder. A search keeps the lists of the
terms it asks for, brings those of a block together and intersects them, shifted by their place in the phrase, from the
rarest on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import fresh, materialize, slices

#: Positions between two documents of a block; a proximity search may not reach over more.
GAP = 1024
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Words of test items that one search broadcasts; more items are searched in several passes.
QUERY_WORDS = 1_000_000

#: Word characters are 0-9, a-z (A-Z lower-cased) and everything beyond ASCII; the rest separates.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (block, term, n, positions, doc_ids, starts, lengths): for each block its posting lists, one a row,
    and one row with a null term that lists its documents (id, first position, number of words).

    Null texts have no words. Each input row is a document of its own, ids may be null or repeat. Texts of any length stay
    whole: a document longer than a block makes a block alone.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    id_type = source.schema["id"].dataType.simpleString()

    def flush(name, ids, texts, arrow_id):
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        terms, starts, lengths, at = [], [], [], 0
        for text in texts:
            found = [number(w, len(seen)) for w in words(text)]
            terms.append(np.array(found, dtype=np.int32))
            starts.append(at)
            lengths.append(len(found))
            at += len(found) + GAP
        flat = np.concatenate(terms)
        place = np.concatenate([np.arange(s, s + n, dtype=np.int64) for s, n in zip(starts, lengths, strict=True)])
        order = np.argsort(flat, kind="stable")
        counts = np.bincount(flat, minlength=len(seen))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(place[order]))
        none = lambda kind, k: pa.nulls(k, kind)
        n = len(seen)
        for at in range(0, n, 65536):
            k = min(n - at, 65536)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(list(seen)[at : at + k], pa.binary()), pa.array(counts[at : at + k], pa.int64()), lists.slice(at, k), none(pa.list_(arrow_id), k), none(pa.list_(pa.int64()), k), none(pa.list_(pa.int64()), k)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([name]), none(pa.binary(), 1), none(pa.int64(), 1), none(pa.list_(pa.int64()), 1), pa.array([ids], pa.list_(arrow_id)), pa.array([starts], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))], names=names)

    names = ["block", "term", "n", "positions", "doc_ids", "starts", "lengths"]

    def run(batches):
        part, k, size, ids, texts, kind = TaskContext.get().partitionId(), 0, 0, [], [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
                if size >= BLOCK_BYTES:
                    yield from flush(f"{part}-{k}", ids, texts, kind)
                    k, size, ids, texts = k + 1, 0, [], []
        if ids:
            yield from flush(f"{part}-{k}", ids, texts, kind)

    made = source.mapInArrow(run, f"block string, term binary, n bigint, positions array<bigint>, doc_ids array<{id_type}>, starts array<bigint>, lengths array<bigint>")
    return materialize(made, "postings")


def phrases(item_words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All windows of `width` consecutive words; a shorter item is one window, an empty one has none."""
    if len(item_words) <= width:
        return [tuple(item_words)] if item_words else []
    return [tuple(item_words[i : i + width]) for i in range(len(item_words) - width + 1)]


def intersect(lists: list[np.ndarray], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of matches of terms with these posting lists, in their order.

    slop 0: each term stands right after the one before. Otherwise up to `slop` other words may stand between two terms; for
    each first term the nearest following ones are taken.
    """
    if slop == 0:
        order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
        base = lists[order[0]] - order[0]
        for i in order[1:]:
            if not len(base):
                break
            at = np.searchsorted(lists[i], base + i)
            at[at == len(lists[i])] = 0
            base = base[lists[i][at] == base + i] if len(lists[i]) else base[:0]
        return base, base + len(lists)
    # proximity: the rarest term bounds where a match can be
    rare = min(range(len(lists)), key=lambda i: len(lists[i]))
    reach = (slop + 1) * len(lists)
    first = lists[0]
    near = np.searchsorted(lists[rare], first)
    near[near == len(lists[rare])] = max(len(lists[rare]) - 1, 0)
    start = first[np.abs(lists[rare][near] - first) <= reach] if len(lists[rare]) else first[:0]
    at = start
    for xs in lists[1:]:
        k = np.searchsorted(xs, at, side="right")
        ok = k < len(xs)
        start, at, k = start[ok], at[ok], k[ok]
        ok = xs[k] - at <= slop + 1 if len(k) else np.zeros(0, bool)
        start, at = start[ok], xs[k][ok]
    return start, at + 1


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return list(zip(starts[new].tolist(), ends[np.concatenate([new[1:], [True]])].tolist(), strict=True))


def search(index: DataFrame, items: list[tuple[object, bytes]], width: int = 10, slop: int = 0) -> DataFrame:
    """(block, ord, spans, items): the documents of the index that hold a window of one of the items (id, text).

    spans are merged [start, stop) word places in the document, items the ids (as text) of the items found there, in text
    order. Items come as a bounded list; see decontaminate for whole tables.
    """
    if width * (slop + 1) >= GAP:
        raise ValueError(f"a match may not be longer than {GAP} words")
    spark = index.sparkSession
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for p in phrases(words(text), width):
            owners.setdefault(p, set()).update([] if item is None else [str(item)])
    asked = sorted({w for p in owners for w in p})
    number = {w: i for i, w in enumerate(asked)}
    by_width: dict[int, list] = {}
    for p, ids in sorted(owners.items()):
        by_width.setdefault(len(p), []).append(([number[w] for w in p], sorted(ids)))
    queries = [(np.array([terms for terms, _ in some], dtype=np.int32), [ids for _, ids in some]) for some in by_width.values()]
    shared = spark.sparkContext.broadcast((queries, number))
    vocabulary = spark.createDataFrame([(bytearray(w),) for w in asked], "term binary")
    kept = index.join(F.broadcast(vocabulary), "term", "left_semi").select("block", "term", "positions", F.lit(None).cast("array<bigint>").alias("starts"), F.lit(None).cast("array<bigint>").alias("lengths"))
    kept = kept.unionByName(index.where("term is null").select("block", "term", "positions", "starts", "lengths"))
    names = ["block", "ord", "spans", "items"]

    def match(table: pa.Table) -> pa.Table:
        queries, number = shared.value
        block = table.column("block")[0].as_py()
        of = pc.is_null(table.column("term"))
        directory, postings = table.filter(of), table.filter(pc.invert(of))
        starts = np.array(directory.column("starts")[0].as_py(), dtype=np.int64)
        lists: dict[int, np.ndarray] = {}
        for term, places in zip(postings.column("term").to_pylist(), postings.column("positions"), strict=True):
            lists[number[term]] = places.values.to_numpy(zero_copy_only=False)
        n = np.zeros(len(number) + 1, dtype=np.int64)
        for k, v in lists.items():
            n[k] = len(v)
        found: dict[int, list] = {}
        for terms, ids in queries:
            for k in np.flatnonzero(n[terms].min(axis=1)).tolist():  # windows whose rarest term stands in the block, and so all
                s, e = intersect([lists[t] for t in terms[k].tolist()], slop)
                if not len(s):
                    continue
                of = np.searchsorted(starts, s, side="right") - 1
                for d in np.unique(of).tolist():
                    mine = of == d
                    x = found.setdefault(d, [[], [], set()])
                    x[0].append(s[mine] - starts[d])
                    x[1].append(e[mine] - starts[d])
                    x[2].update(ids[k])
        docs = sorted(found)
        spans = [[{"start": a, "stop": b} for a, b in _merged(np.concatenate(found[d][0]), np.concatenate(found[d][1]))] for d in docs]
        return pa.table([pa.array([block] * len(docs), pa.string()), pa.array(docs, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([sorted(found[d][2]) for d in docs], pa.list_(pa.string()))], names=names)

    return kept.groupBy("block").applyInArrow(match, "block string, ord int, spans array<struct<start:bigint,stop:bigint>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, slop: int = 0) -> DataFrame:
    """One row per input row: id_col, n_words, n_hit, spans, items.

    A window is `width` consecutive words of a benchmark item (all of a shorter item); n_hit counts the document's words that
    lie inside an occurrence of any window. Null, empty and word-less texts have no words and no hits; an item without words
    has no windows; an item with a null id marks hits but is not listed. Repeated item ids count once, repeated documents
    each. An empty benchmark or an empty docs gives no hits. The benchmark is streamed to the driver and broadcast in passes
    of at most QUERY_WORDS words, so its size is bounded by passes, never by memory.
    """
    index = build_index(docs, id_col, text_col)
    passes, batch, size = [], [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("binary").alias("t")).toLocalIterator():
        batch.append((row.i, bytes(row.t or b"")))
        size += len(words(batch[-1][1]))
        if size >= QUERY_WORDS:
            passes.append(materialize(search(index, batch, width, slop), "hits"))
            batch, size = [], 0
    if batch or not passes:
        passes.append(search(index, batch, width, slop))
    hits = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            hits = hits.unionByName(more)
        hits = hits.groupBy("block", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    directory = index.where("term is null").select("block", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("ord", "d")).select("block", "ord", F.col("d.doc_ids").alias(id_col), F.col("d.lengths").alias("n_words"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1))))
    n_hit = F.size(places) if len(passes) > 1 else F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    joined = directory.join(hits, ["block", "ord"], "left")
    return joined.select(id_col, "n_words", F.coalesce(F.when(F.col("spans").isNotNull(), n_hit), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without any hit; columns as in docs. Rows that share an id (or have none) go together."""
    key, = fresh(docs, "hit_id")
    hit = decontaminate(docs, benchmark, id_col, text_col, **how).where("n_hit > 0").select(F.col(id_col).alias(key)).distinct()
    return docs.join(hit, docs[id_col].eqNullSafe(hit[key]), "left_anti")
