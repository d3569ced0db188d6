"""Harmonic packing of tokenised documents into sequences.

Lengths are partitioned into reciprocal classes: class k, for every k from 1 to capacity, has the lengths in
(capacity / (k + 1), capacity / k], and a bin of class k takes exactly k documents, whole. What a filled bin still lacks is
topped up: when more than WAITING filled bins wait, the next documents go there, whole where a gap is wide enough and
otherwise cut along the gaps. So most documents stay whole and there is next to no padding. Every worker fills its own bins
while it reads its part of the corpus: no shuffle, no shared state.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._common import slices
from ledgerloom.llm.tokenized import encoder

#: Sequence numbers of a partition start at its number times this.
PER_PARTITION = 1 << 40
#: Filled bins that wait for documents to top them up.
WAITING = 32
#: Pieces of text whose ids a worker remembers (300 bytes each): workers outlive a stage, and the next one needs memory too.
REMEMBERED = 800_000


#: A piece of a document: id, first token, tokens of the document, token ids in bytes.
Piece = tuple


def _size(piece: Piece) -> int:
    return len(piece[3]) // 4


class Bins:
    """Open bins of one worker. add() and close() return the sequences that are full: lists of pieces."""

    def __init__(self, capacity: int, waiting: int = WAITING) -> None:
        self.capacity, self.most = capacity, waiting
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[tuple[int, int, list[Piece]]] = []  # gap, serial number, pieces; smallest gap first
        self.serial = 0

    def add(self, doc, ids: bytes) -> list[list[Piece]]:
        """A document's whole sequences, and whatever its rest completes."""
        n, at, out = len(ids) // 4, 0, []
        while n - at >= self.capacity:
            out.append([(doc, at, n, ids[4 * at : 4 * (at + self.capacity)])])
            at += self.capacity
        if at < n:
            rest = (doc, at, n, ids[4 * at :])
            out += self._top_up(rest) if len(self.waiting) > self.most else self._place(rest)
        return out

    def _wait(self, pieces: list[Piece]) -> list[list[Piece]]:
        gap = self.capacity - sum(map(_size, pieces))
        if not gap:
            return [pieces]
        self.serial += 1
        insort(self.waiting, (gap, self.serial, pieces))
        return []

    def _place(self, piece: Piece) -> list[list[Piece]]:
        k = self.capacity // _size(piece)
        pile = self.open.setdefault(k, [])
        pile.append(piece)
        return self._wait(self.open.pop(k)) if len(pile) == k else []

    def _top_up(self, piece: Piece) -> list[list[Piece]]:
        """Puts a piece into the narrowest gap that takes it whole, or cuts it along the widest ones."""
        out = []
        while self.waiting:
            doc, start, n, ids = piece
            at = bisect_left(self.waiting, (_size(piece),))
            gap, _, pieces = self.waiting.pop(min(at, len(self.waiting) - 1))
            out += self._wait([*pieces, (doc, start, n, ids[: 4 * gap])])
            if _size(piece) <= gap:
                return out
            piece = (doc, start + gap, n, ids[4 * gap :])
        return out + self._place(piece)

    def close(self) -> list[list[Piece]]:
        """Tops up with what stands in unfilled bins, then takes the emptiest bins apart while the gaps make up a sequence."""
        left = sorted((p for pile in self.open.values() for p in pile), key=_size, reverse=True)
        self.open, out = {}, []
        for piece in left:
            out += self._top_up(piece) if self.waiting else self._wait([piece])
            out += [s for pile in self.open.values() for p in pile for s in self._wait([p])]
            self.open = {}
        while sum(gap for gap, _, _ in self.waiting) >= self.capacity:
            for piece in self.waiting.pop()[2]:
                out += self._top_up(piece)
        out += [pieces for _, _, pieces in self.waiting]
        self.waiting = []
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, padding, ids.

    A document is its token ids and end_id. `ids` holds the piece's ids as little-endian unsigned 32-bit integers; `padding`
    is what its sequence lacks to `capacity`, or 0 where the sequence's length is a power of two. Null and empty texts are
    documents of end_id alone; null and repeated ids stay documents of their own; an empty table gives no rows. Sequences
    never span partitions of the input, so any partition can be computed again alone with the same result.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "padding", "ids"]

    def run(batches):
        encode, bins, number, kind = encoder(tokenizer, REMEMBERED).encode, Bins(capacity), TaskContext.get().partitionId() * PER_PARTITION, None

        def rows(sequences):
            nonlocal number
            cols: list[list] = [[] for _ in names]
            for pieces in sequences:
                total, at = sum(map(_size, pieces)), 0
                pad = 0 if total & (total - 1) == 0 else capacity - total
                for piece in pieces:
                    doc, start, n, ids = piece
                    for c, v in zip(cols, (doc, start, _size(piece), n, number, at, pad, ids), strict=True):
                        c.append(v)
                    at += _size(piece)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, *[pa.int64()] * 6, pa.binary()), strict=True)], names=names)

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            yield rows([s for i, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True) for s in bins.add(i, ids + end)])
        if kind is not None:
            yield rows(bins.close())

    out = T.StructType([T.StructField("id", source.schema["id"].dataType), *[T.StructField(n, T.LongType()) for n in names[1:-1]], T.StructField("ids", T.BinaryType())])
    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)
