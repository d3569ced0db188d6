"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart from data bytes.

Ids are replaced by their rank in the whole corpus (0: most frequent), so that most take one byte. Four ranks share one
control byte with two bits each: the number of data bytes less one. A document's control bytes and data bytes are two byte
strings; a block holds those of consecutive documents, one after another. A file set is a folder with `blocks` (blocks in
ascending document order over its numbered files) and `codebook` (rank to id), both Parquet as the container, so that any
file system Spark knows will do and a lost task leaves no half file. Decoding looks up each control byte in a table of four
lengths and gathers the data bytes with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._common import materialize, scratch_path, slices
from ledgerloom.llm.tokenized import encoder

#: lengths of the four values of each control byte, lowest bits first
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)
BLOCK_TOKENS = 1 << 18
#: Files whose first positions are broadcast to readers; of more they are joined.
MOST_BROADCAST = 500_000


def encode_ranks(ranks: np.ndarray, counts: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values. counts: how many of them each document has (default: one document);
    a document's last control byte is padded with zero bits."""
    ranks = np.asarray(ranks, dtype="<u4")
    counts = np.array([len(ranks)]) if counts is None else np.asarray(counts)
    size = np.ones(len(ranks), dtype=np.uint8)
    for top in (0xFF, 0xFFFF, 0xFFFFFF):
        size += ranks > top
    room = -(-counts // 4) * 4
    code = np.zeros(int(room.sum()), dtype=np.uint8)
    code[np.arange(len(ranks)) + np.repeat(np.cumsum(room - counts) - (room - counts), counts)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    start, octets = ends - size, ranks.view(np.uint8).reshape(-1, 4)
    data[start] = octets[:, 0]
    for j in (1, 2, 3):
        longer = np.flatnonzero(size > j)
        data[start[longer] + j] = octets[longer, j]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of documents with `counts` values each, whose control bytes and data bytes follow one another."""
    groups = -(-counts // 4)
    size = LENGTHS[control].reshape(-1)
    real = np.ones(len(size), dtype=bool)
    ends = np.cumsum(groups) * 4
    for lack in (1, 2, 3):  # padding values at the end of a document have no data
        real[ends[(4 * groups - counts) >= lack] - lack] = False
    size = size[real].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for j in (1, 2, 3):
        more = size > j
        if more.any():
            out[more] |= padded[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 8 << 20) -> None:
    """Writes a file set of all documents (token ids, then end_id) in ascending id order, nulls first.

    Null and empty texts are documents of end_id alone. Documents that share an id stay apart, in an order that their ids'
    hash gives. The corpus is tokenised once, into a written table that also gets each task's token counts; ranks come from
    the sum of these, so from all of the corpus. The codebook has a row for each different id, at most the vocabulary's size,
    which is also the bound of what is broadcast. Files are ranges of ids of about file_tokens tokens; what is shuffled to
    form them is compressed, and ranked and coded only once it is in its place.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    id_type = source.schema["id"].dataType
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokenise(batches):
        encode, press, total, kind = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=1).compress, np.zeros(0, dtype=np.int64), None
        for batch in slices(batches):
            kind = batch.schema.field(0).type
            ids = [x + end for x in encode(batch.column(1).to_pylist())]
            seen = np.bincount(np.frombuffer(b"".join(ids), dtype="<u4"))
            total, seen = (total, seen) if len(total) >= len(seen) else (seen, total)
            total[: len(seen)] += seen
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([press(planes(x)) for x in ids], pa.binary()), pa.nulls(n, pa.int64())], names=["id", "n", "ids", "token"])
        if kind is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kind), pa.array(total[some], pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int64())], names=["id", "n", "ids", "token"])

    def planes(ids: bytes) -> bytes:
        """First bytes of all ids, then second bytes, and so on, without the last ones if they are all zero."""
        x = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4).T
        return x[: max(1, 4 - next((k for k in range(4) if x[3 - k].any()), 3))].tobytes()

    def joined(x: bytes, n: int) -> np.ndarray:
        out = np.zeros((4, n), dtype=np.uint8)
        got = np.frombuffer(x, dtype=np.uint8).reshape(-1, n)
        out[: len(got)] = got
        return np.ascontiguousarray(out.T).view("<u4")[:, 0]

    tokens = materialize(source.mapInArrow(tokenise, T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("token", T.LongType())])), "tokens")
    counts = tokens.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = counts.toPandas().sort_values(["n", "token"], ascending=[False, True])  # one row for each id of the vocabulary
    book, total = ranked["token"].to_numpy(dtype=np.int64), int(ranked["n"].sum())
    spark.createDataFrame([(r, int(t)) for r, t in enumerate(book)], "rank int, token bigint").coalesce(1).write.parquet(f"{path}/codebook")
    rank_of = np.zeros(int(book.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[book] = np.arange(len(book), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)
    names = ["file_no", "block_no", "first_token", "ids", "counts", "control", "data"]

    def block(batches):
        file_no, block_no, first, held, size, kind = TaskContext.get().partitionId(), 0, 0, [], 0, None
        unpress = zstandard.ZstdDecompressor().decompress

        def made():
            n = np.array([k for _, k, _ in held], dtype=np.int64)
            control, data = encode_ranks(ranks.value[np.concatenate([joined(unpress(x), k) for _, k, x in held])], n)
            return pa.RecordBatch.from_arrays([pa.array([file_no], pa.int64()), pa.array([block_no], pa.int64()), pa.array([first], pa.int64()), pa.array([[i for i, _, _ in held]], pa.list_(kind)), pa.array([n], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=names)

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.append(row)
                size += row[1]
                if size >= BLOCK_TOKENS:
                    yield made()
                    block_no, first, held, size = block_no + 1, first + size, [], 0
        if held:
            yield made()

    order = [F.col("id").asc_nulls_first(), F.xxhash64("ids")]
    dealt = tokens.where("token is null").select("id", "n", "ids").repartitionByRange(max(1, -(-total // file_tokens)), *order).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(block, T.StructType([*[T.StructField(x, T.LongType()) for x in names[:3]], T.StructField("ids", T.ArrayType(id_type)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())]))
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids): the documents of a file set. start counts the ids of all documents before it; ids are
    little-endian unsigned 32-bit integers in a byte string. The sizes of earlier files come from one number for each file."""
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType
    book = np.array([r.token for r in spark.read.parquet(f"{path}/codebook").orderBy("rank").collect()], dtype=np.uint32)
    shared = spark.sparkContext.broadcast(book)
    sums = blocks.groupBy("file_no").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    base = sums.select("file_no", (F.sum("tokens").over(Window.orderBy("file_no")) - F.col("tokens")).alias("base"))

    def decode(batches):
        for batch in batches:
            for file_no, first, ids, counts, control, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                n = np.array(counts, dtype=np.int64)
                values = shared.value[decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)].astype("<u4")
                starts = np.cumsum(n) - n
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(starts, starts[-1] + n[-1]).astype(np.int64) * 4), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([pa.array([file_no] * len(n), pa.int64()), pa.array(ids, batch.schema.field(2).type.value_type), pa.array(starts + first), pa.array(n), parts.cast(pa.binary())], names=["file_no", "id", "start", "n_tokens", "ids"])

    source = blocks.select("file_no", "first_token", "ids", "counts", "control", "data")
    out = T.StructType([T.StructField("file_no", T.LongType()), T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    rows = source.mapInArrow(decode, out)
    base = F.broadcast(base) if sums.count() <= MOST_BROADCAST else base  # two numbers for each file
    return rows.join(base, "file_no").select(F.col("id").alias(id_col), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def roundtrip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes a file set (to the shared folder unless a path is given) and returns what read_tokens finds in it."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col)
