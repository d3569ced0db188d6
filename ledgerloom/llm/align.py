"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both token sequences tile the bytes of a space and the text. Every token points to the farthest-right token of the other
sequence that overlaps it (the one that holds its last byte); where both end together, A's points to B's and B's to itself.
Pointers lead to the right only, so doubling all of them at once (pointer jumping) ends at the last token of each group after
as many rounds as the logarithm of the longest chain. That token labels the group.

Texts are cut before single spaces and line ends between two other characters, where neither vocabulary joins anything, and a
worker encodes each different unit once. Token ids are written, two bytes each, and read twice: to count id pairs over all texts,
and to meet the counts. They meet by two ways of the same result: pairs that are counted most (at most `head` of them) are
broadcast and looked up by binary search, all others are joined.
"""

from __future__ import annotations

import json
import os
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._common import materialize, slices
from ledgerloom.llm.tokenized import BYTE_CHARS, ODD

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Remembered units, in two halves; a third of a KB each.
UNITS = 1_000_000
#: Bytes of texts that are aligned at a time (a longer text by itself), and links that a worker counts at a time.
ALIGNED_BYTES, COUNTED_LINKS = 1 << 20, 4_000_000
#: Id pairs whose counts are broadcast (24 bytes each); classes of counts for each power of two by which that bound is kept.
HEAD, STEPS = 1_000_000, 8


def tiling(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a tiling of bytes by the ends of its tokens: for each offset whether a token ends there, and how many end up to there."""
    marks = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=bool)
    marks[ends] = True
    return marks, np.cumsum(marks, dtype=np.int32)


def group_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two tilings of the same bytes: for each token of A, then for each of B, the number of B's token that ends its group."""
    n = len(a_end)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (at_a, up_to_a), (_, up_to_b) = tiling(a_end), tiling(b_end)
    own = np.arange(n, n + len(b_end), dtype=np.int32)
    to = np.concatenate([n + up_to_b[a_end - 1], np.where(at_a[b_end], own, up_to_a[b_end - 1])])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n] - n, to[n:] - n
        to = further


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs of tokens of two tilings, in order: numbers in A and in B. Each byte range between two ends of either
    is what one pair has in common."""
    (at_a, up_to_a), (at_b, up_to_b) = tiling(a_end), tiling(b_end)
    before = np.flatnonzero(at_a | at_b) - 1
    return up_to_a[before], up_to_b[before]


class Vocabularies:
    """Both vocabularies with the bytes of each token. Special strings inside texts are plain text to both."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        plain = {chr(c): b for b, c in BYTE_CHARS.items()}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        decoded = {i: bytes(plain.get(c, 0) for c in s) for s, i in spec["model"]["vocab"].items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [decoded.get(i, b"") for i in range(max(decoded) + 1)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        self.text_of = [f"{i}{mark}" for ids, mark in ((self.a_bytes, ","), (self.a_bytes, "|"), (self.b_bytes, ","), (self.b_bytes, ";")) for i in range(len(ids))]
        self.kind = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"
        pre = spec["pre_tokenizer"] or {}
        self.space = self.b.piece_to_id("▁")
        self.cuts = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}

    def _encode(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of units that start with a space or line end; None where the tokens' bytes aren't the unit's."""
        out: list[tuple[bytes, bytes] | None] = []
        b_ids = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for u, found, b in zip(units, self.a.encode_batch_fast(units, add_special_tokens=False), b_ids, strict=True):
            a, own = found.ids, u.encode()
            if u[0] != " ":
                b = b[1:] if b[:1] == [self.space] else []
            same = b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]) == own
            out.append((np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()) if same else None)
        return out

    def _units(self, text: str) -> list[str]:
        if not self.cuts or any(x in text for x in ODD):
            return [text]
        units = text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")[1:]
        for u in units:
            if u not in self.known and (len(u) < 2 or u[1].isspace() or u[-1].isspace()):
                return CUT.split(text)
        return units

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """A's and B's ids of each text with a space before it; none where a text is null or empty or its tokens differ in bytes."""
        if len(self.known) > UNITS // 2:
            self.before, self.known = self.known, {}
        known = self.known
        cut = [self._units(" " + t) if t else [] for t in texts]
        new = list({u: None for units in cut for u in units if u not in known})
        known.update({u: self.before[u] for u in new if u in self.before})
        new = [u for u in new if u not in known]
        known.update(zip(new, self._encode(new), strict=True))
        out = []
        for units in cut:
            found = [known[u] for u in units]
            if None in found:  # judged by the bytes of the whole text
                found = [self._encode(["".join(units)])[0] if len(units) > 1 else None]
            out.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])) if found != [None] else (b"", b""))
        for u in new:
            if len(u) > 64:
                del known[u]
        return out


class Aligned:
    """Token sequences of some texts, one text after the other: a text's end is an end of both, so no group reaches over it.

    Per text: n_a, n_b and n_links; links: the id pairs of all links in order, A's id in the upper half.
    """

    def __init__(self, words: Vocabularies, ids: list[tuple[bytes, bytes]]) -> None:
        self.words = words
        (self.a, self.n_a), (self.b, self.n_b) = ((np.frombuffer(b"".join(x), words.kind).astype(np.int64), np.array([len(y) for y in x], dtype=np.int64) // int(words.kind[2])) for x in ([i[0] for i in ids], [i[1] for i in ids]))
        self.a_end, self.b_end = np.cumsum(words.a_size[self.a]), np.cumsum(words.b_size[self.b])
        in_a, in_b = links(self.a_end, self.b_end)
        self.links = self.a[in_a] << 32 | self.b[in_b]
        cut = np.cumsum(self.n_b)
        self.n_links = np.searchsorted(in_b, cut) - np.searchsorted(in_b, cut - self.n_b)

    def groups(self) -> tuple[list[int], list[str]]:
        """For each text the number of its groups, and these as `a1,a2|b1;a3|b2,b3`. Group by group A's tokens come before B's, so a
        token's place in what is written is its own number and how many of the other sequence come before it."""
        words, n, m = self.words, len(self.words.a_bytes), len(self.words.b_bytes)
        of_a, of_b = group_ends(self.a_end, self.b_end)
        number_a, number_b = np.arange(len(self.a)), np.arange(len(self.b))
        ends_b = of_b == number_b
        ends_a = np.append(of_a[1:] != of_a[:-1], True)[: len(of_a)]
        up_to_a = np.cumsum(np.bincount(of_a, minlength=len(self.b))) if len(of_a) else of_a
        before_a = of_a - np.diff(np.concatenate([[-1], np.flatnonzero(ends_b)]))[np.cumsum(ends_b)[of_a] - 1] + 1 if len(of_a) else of_a
        out = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        out[number_a + before_a] = self.a + n * ends_a
        out[number_b + up_to_a[of_b]] = self.b + 2 * n + m * ends_b
        cut = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        last = np.concatenate([[0], np.cumsum(ends_b)])[np.concatenate([[0], np.cumsum(self.n_b)])]
        return np.diff(last).tolist(), ["".join(map(words.text_of.__getitem__, out[p:q].tolist()))[:-1] for p, q in zip(cut, cut[1:], strict=False)]

    def sums(self, values: np.ndarray) -> list[int]:
        """For each text the sum of values of its links."""
        total = np.concatenate([[0], np.cumsum(values)])
        end = np.cumsum(self.n_links)
        return (total[end] - total[end - self.n_links]).tolist()


_VOCABULARIES: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One for each worker process and pair of files."""
    key = (a_path, b_path)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabularies(*key)
    return _VOCABULARIES[key]


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, of_groups) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups, a, b): for each row of docs its number, its id, its counts, of_groups of its groups
    and the ids of its tokens."""

    def run(batches):
        words = vocabularies(a_path, b_path)
        for batch in slices(batches, size=ALIGNED_BYTES):
            ids = words.encode(batch.column(2).to_pylist())
            found = Aligned(words, ids)
            n_groups, groups = found.groups()
            columns = [*(x.tolist() for x in (found.n_a, found.n_b)), n_groups, found.n_links.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns], pa.array([of_groups(g.encode()) for g in groups], pa.string()), *(pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1))], names=names)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "a", "b"]
    kinds = [T.LongType(), source.schema["id"].dataType, *[T.LongType()] * 4, T.StringType(), T.BinaryType(), T.BinaryType()]
    return source.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]))


def pair_counts(found: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): how many links of all rows of encoded hold each id pair; A's id in the upper 32 bits, B's in the lower."""

    def counted(some):
        pairs, n = np.unique(np.concatenate(some), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    def run(batches):
        words, some, size = vocabularies(a_path, b_path), [], 0
        for batch in slices(batches, size=ALIGNED_BYTES):
            some.append(Aligned(words, list(zip(*(c.to_pylist() for c in batch.columns), strict=True))).links)
            size += len(some[-1])
            if size > COUNTED_LINKS:
                yield counted(some)
                some, size = [], 0
        if size:
            yield counted(some)

    return found.select("a", "b").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def most_counted(counts: DataFrame, head: int) -> DataFrame:
    """Those rows of counts(pair, n, ..) that are counted most: all above some count, at most `head` rows. The count is found from
    numbers of rows by class of count, of which there are a few hundred at any size."""
    step = F.floor(F.log2("n") * STEPS).alias("step")
    taken, bound = 0, 64 * STEPS
    for row in counts.groupBy(step).count().orderBy(F.desc("step")).collect():
        if taken + row["count"] > head:
            break
        taken, bound = taken + row["count"], row["step"]
    return counts.where(F.floor(F.log2("n") * STEPS) >= bound)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per input row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum (all long) and groups (`a1,a2|b1;a3|b2,b3`, ids
    in order; of a long text as long as the text, some ten bytes a token).

    A text that is null or empty, or whose joined tokens differ in bytes from a space and the text (A's byte-level entries decoded;
    B's pieces with U+2581 as space and byte pieces as bytes), has no tokens: zeros and an empty string. Null and repeated ids and
    repeated rows stay as they are; an empty table gives an empty result. Other columns are not read.
    """
    return _aligned(docs, a_path, b_path, id_col, text_col, head, lambda groups: groups.decode())


def align_digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """As align, with groups_sha256 (lowercase hex; empty without tokens) in place of groups, so no row is longer than its digest."""
    out = _aligned(docs, a_path, b_path, id_col, text_col, head, lambda groups: sha256(groups).hexdigest() if groups else "")
    return out.withColumnRenamed("groups", "groups_sha256")


def _aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, head: int, of_groups) -> DataFrame:
    spark = docs.sparkSession
    rows = materialize(encoded(docs, a_path, b_path, id_col, text_col, of_groups), "encoded")
    counts = materialize(pair_counts(rows, a_path, b_path), "pair-counts")
    low = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = counts.groupBy(low.alias("b")).agg(F.max("n").alias("most"))  # no more rows than B has ids
    frame, most = most_counted(counts, head).toPandas().sort_values("pair"), best.toPandas()
    top = np.zeros(int(most["b"].max()) + 1 if len(most) else 1, dtype=np.int64)
    top[most["b"].to_numpy(np.int64)] = most["most"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((frame["pair"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), top))

    def run(batches):
        words = vocabularies(a_path, b_path)
        keys, ns, top = shared.value
        for batch in slices(batches, size=ALIGNED_BYTES):
            found = Aligned(words, list(zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)))
            at = np.minimum(np.searchsorted(keys, found.links), max(len(keys) - 1, 0))
            hit = keys[at] == found.links if len(keys) else np.zeros(len(found.links), bool)
            n = np.where(hit, ns[at], 0) if len(keys) else np.zeros(len(found.links), np.int64)
            best = hit & (n == top[found.links & 0xFFFFFFFF])
            end = np.cumsum(found.sums(~hit)).tolist()
            rest = pa.ListArray.from_arrays(pa.array([0, *end], pa.int32()), pa.array(found.links[~hit]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(found.sums(x), pa.int64()) for x in (best, n)), rest], names=[*names, "n_best", "count_sum", "rest"])

    names = rows.columns[:-2]
    fields = [*rows.schema.fields[:-2], *(T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")), T.StructField("rest", T.ArrayType(T.LongType()))]
    found = materialize(rows.mapInArrow(run, T.StructType(fields)), "aligned")
    asked = found.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("k"))
    marked = counts.join(best, low == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    added = asked.join(marked, "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more"), F.sum(F.col("k") * F.col("is_best")).alias("more_best"))
    joined = found.join(added, "row", "left")
    return joined.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups")
