"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers count what the tokenizer would emit, without building token lists:

* The splitter reads character classes and emits 1 where a word begins. It has eight states, so a chunk of text is a map from
  entry state to exit state; maps of all chunks are computed side by side, composed by a parallel prefix scan, and the
  emissions follow from the entry states.
* The merger reads the bytes of a word. Its state holds, for the places where a token that is still open may have begun, the
  last token before that place and how many tokens that part has; a transition carries the change of the token count. A token
  may follow another only if merging the two strings apart and together agrees, which is what makes the greedy left-to-right
  result equal to merging by rank. States and transitions are compiled when they are first met, and kept for the worker.

Counts of a document's words add up, so a text of any length is read once, in bounded memory.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm._common import fresh, runs
from ledgerloom.llm.tokenized import BYTE_CHARS

# Character classes. A space or other white space is "last" if no white space follows it; an apostrophe opens a contraction of
# two or three characters if such letters follow. END stands between texts.
SPACE, BLANK, LAST_SPACE, LAST_BLANK, LETTER, NUMBER, OTHER, SHORT, LONG, END = range(10)
# Splitter states: the next character begins a word / joins whatever comes / white space run / runs / inside a contraction.
START, JOIN, RUN, LETTERS, NUMBERS, OTHERS, TWO_LEFT, ONE_LEFT = range(8)
CHUNK = 64
#: Characters handled at a time.
PIECE = 1 << 20
#: Stands after each text, beyond all code points.
END_POINT = 0x110000


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted) for each state and class."""
    to, emit = np.zeros((8, 10), np.uint8), np.ones((8, 10), np.uint8)
    begin = {SPACE: RUN, BLANK: RUN, LAST_SPACE: JOIN, LAST_BLANK: START, LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT}
    for s in range(8):
        for c in range(9):
            to[s, c] = begin[c]
    for c, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS), (SHORT, OTHERS), (LONG, OTHERS)):
        for s in (JOIN, run):  # after a space an apostrophe is an ordinary character
            to[s, c], emit[s, c] = run, 0
    for c in (SPACE, BLANK):
        emit[RUN, c] = 0
    to[:, END] = START
    for c in range(9):
        to[TWO_LEFT, c], emit[TWO_LEFT, c] = ONE_LEFT, 0
        to[ONE_LEFT, c], emit[ONE_LEFT, c] = START, 0
    return to, emit


TO, EMIT = _splitter()


def word_starts(classes: np.ndarray, entry: int = START) -> tuple[np.ndarray, int]:
    """(1 at each position where a word begins, exit state) for a run of character classes read from `entry`."""
    n = len(classes)
    if not n:
        return np.zeros(0, bool), entry
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, OTHER, np.uint8)
    padded[:n] = classes
    cols = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    flat = TO.reshape(-1)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # each chunk's state map, one character further each time
    for k in range(CHUNK):
        maps = flat[maps.astype(np.uint16) * 10 + cols[k][:, None]]
    before = np.roll(maps, 1, axis=0)
    before[0] = np.arange(8)
    step = 1
    while step < rows:  # prefix scan: after log2 rounds each row maps the entry of the text to the entry of its chunk
        joined = before.copy()
        joined[step:] = np.take_along_axis(before[step:], before[:-step].astype(np.int64), axis=1)
        before, step = joined, 2 * step
    state = before[:, entry]
    out = np.empty((CHUNK, rows), bool)
    emit = EMIT.reshape(-1)
    ends = state
    for k in range(CHUNK):
        at = state.astype(np.uint16) * 10 + cols[k]
        out[k] = emit[at]
        state = flat[at]
        if k == (n - 1) % CHUNK:
            ends = state
    return out.T.reshape(-1)[:n], int(ends[-1])


@lru_cache(2)
def class_table(path: str) -> np.ndarray:
    """Class of every code point by its Unicode category: L, N, and white space (Z and six controls).

    Where Python's Unicode version and a later one differ, the vocabulary's own splitter is asked: which class a character has
    shows in whether it joins two letters, or two numbers.
    """
    of = {"L": LETTER, "N": NUMBER, "Z": BLANK}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out = np.append(out, np.uint8(END))
    out[[*range(9, 14), 0x85]] = BLANK
    out[0x20] = SPACE
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    later = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, points))
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for m in regex.finditer(f"{name}+", every):
            at = np.arange(*m.span())
            later[np.where(at < 0xD800, at, at + 0x800)] = kind
    asked = [c for c in np.flatnonzero((later != out) & (out > BLANK) & (out != END)).tolist()]
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    out[asked] = OTHER
    for kind, side in ((LETTER, "a"), (NUMBER, "1")):
        begins = {b for _, (b, _) in split("".join(f"{side}{chr(c)}{side} " for c in asked))}
        out[[c for k, c in enumerate(asked) if not {4 * k + 1, 4 * k + 2} & begins]] = kind
    return out


def classify(cps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes of the characters of texts, each with END_POINT after it; what follows in the text is taken into account."""
    cls = table[cps]
    blank = cls <= BLANK
    last = blank[:-1] & ~blank[1:] & (cls[1:] != END)
    cls[:-1][last] += LAST_SPACE
    at = np.flatnonzero(cps == 0x27)
    if len(at):
        follow = np.concatenate([cps, [0, 0]])
        x, y = follow[at + 1], follow[at + 2]
        short = np.isin(x, [ord(c) for c in "stmd"])
        long = (x == ord("r")) & (y == ord("e")) | (x == ord("v")) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        cls[at[short]], cls[at[long]] = SHORT, LONG
    return cls


class Merger:
    """The transducer of one vocabulary's merges. States are numbered tuples; `arcs` maps (state, byte) to (state, change)."""

    def __init__(self, path: str, limit: int = 100_000) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = {chr(v): k for k, v in BYTE_CHARS.items()}
        raw = lambda s: bytes(chars[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.born: dict[bytes, int] = {}
        for token in {a + b for a, b in self.rank}:  # those that no merge ever reaches are no tokens
            whole, last = self.merge(token)
            if len(whole) == 1:
                self.parts[token], self.born[token] = last, self.rank[last]
        self.tokens = {bytes([b]) for b in range(256)} | set(self.parts)
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}  # proper ones
        self.fit: dict[tuple[bytes, bytes], bool] = {}
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.arcs: list[dict[int, tuple[int, int]]] = []
        self.at(((b"", b"", 0),))

    def at(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.arcs.append({})
        return self.number[state]

    def merge(self, word: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """Tokens of a short byte string by the merge rules (lowest rank first, leftmost on ties), and the last merge."""
        parts, last = [word[k : k + 1] for k in range(len(word))], None
        while len(parts) > 1:
            pair = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
            if pair not in self.rank:
                break
            out, k, last = [], 0, pair
            while k < len(parts):
                both = parts[k : k + 2] == [*pair]
                out.append(pair[0] + pair[1] if both else parts[k])
                k += 1 + both
            parts = out
        return parts, last

    def may_follow(self, left: bytes, right: bytes) -> bool:
        if not left:
            return True
        key = (left, right)
        if key not in self.fit:
            if len(self.fit) > 500_000:
                self.fit.clear()
            self.fit[key] = self._stays_apart(left, right)
        return self.fit[key]

    def _stays_apart(self, a: bytes, b: bytes) -> bool:
        """Undoes the merges that made a and b, latest first. What stands at the border at any time must not be a pair that
        merges earlier than the merge undone last (of equal ranks the leftmost goes first)."""
        before = len(self.rank)
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            made_a, made_b = self.born.get(a, -1), self.born.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                before, a = made_a, self.parts[a][1]
            else:
                before, b = made_b + 1, self.parts[b][0]

    def compile(self, number: int, byte: int) -> tuple[int, int]:
        """A state is a tuple of (open string, last token before it, tokens before it less tokens so far), longest first; the
        last one is the empty string, before which the whole text so far stands."""
        state = self.states[number]
        b = bytes([byte])
        for open_, left, count in state:  # the token that ends here is the longest that may follow what stands before it
            token = open_ + b
            if token in self.tokens and self.may_follow(left, token):
                break
        else:
            raise AssertionError("a single byte is always a token")
        change = count + 1
        after = [(o + b, left, c - change) for o, left, c in state if o + b in self.prefixes]
        arc = (self.at((*after, (b"", token, 0))), change)
        self.arcs[number][byte] = arc
        return arc

    def count(self, word: bytes) -> int:
        arcs, s, n = self.arcs, 0, 0
        for b in word:
            arc = arcs[s].get(b)
            if arc is None:
                if len(self.states) > self.limit:  # within a word too: the state it is in is numbered anew
                    here = self.states[s]
                    self.reset()
                    arcs, s = self.arcs, self.at(here)
                arc = self.compile(s, b)
            s = arc[0]
            n += arc[1]
        return n


class TokenCounter:
    """count(texts): for each how many ids the library would return, special strings counting as one each, null as empty."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies that keep texts as they are can be compiled")
        self.special = [x["content"] for x in spec["added_tokens"] if not (x["single_word"] or x["lstrip"] or x["rstrip"])]
        if len(self.special) != len(spec["added_tokens"]):
            raise ValueError("special strings that take their surroundings can't be compiled")
        self.table = class_table(path)
        self.merger = Merger(path)
        self.known: dict[str, int] = {}
        self.limit = limit

    def _add(self, texts: list[str], owners: list[int], totals: list[int]) -> None:
        """Adds the counts of texts without special strings to the totals of their owners."""
        joined = "".join(texts)
        size = np.array([len(x) for x in texts])
        cps = np.insert(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), np.cumsum(size), END_POINT)
        classes = classify(cps, self.table)
        starts, state = [], START
        for at in range(0, len(cps), PIECE):
            here, state = word_starts(classes[at : at + PIECE], state)
            starts.append(np.flatnonzero(here) + at)
        # END begins a "word" of its own; without the ENDs before it a word's place is its place in the joined text
        starts = np.concatenate(starts)
        starts = starts[classes[starts] != END]
        ends = np.cumsum(size + 1)
        of = np.searchsorted(ends, starts, side="right")
        starts = starts - of
        cuts = np.append(starts, len(joined)).tolist()
        known, count = self.known, self.merger.count
        counts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            word = joined[a:b]
            n = known.get(word)
            if n is None:
                n = count(word.encode())
                if b - a <= 32:
                    known[word] = n
            counts.append(n)
        for k, n in enumerate(np.bincount(of, weights=counts, minlength=len(texts)).tolist()):
            totals[owners[k]] += int(n)

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > self.limit:
            self.known.clear()
        totals, parts, owners = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            pieces = [text or ""]
            for special in self.special:
                split = [p.split(special) for p in pieces]
                totals[k] += sum(len(p) - 1 for p in split)
                pieces = [x for p in split for x in p]
            pieces = [p for p in pieces if p]
            parts += pieces
            owners += [k] * len(pieces)
        if parts:
            self._add(parts, owners, totals)
        return totals


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    """One for each worker process and vocabulary."""
    return TokenCounter(path)


def token_count(tokenizer: str, text: Column) -> Column:
    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([n for part in runs(texts) for n in counter(tokenizer).count(part)], pa.int64())

    return count(text.cast("string"))


def with_token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """docs and the columns n_bytes, n_tokens, over_limit (in their place if docs has such). Null and empty texts count 0; every
    row is counted by itself over its whole text, so repeated rows, null ids and an empty table need no care. No shuffle."""
    n, = fresh(docs, "token_n")
    counted = docs.withColumn(n, token_count(tokenizer, F.col(text_col)))
    return counted.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "n_tokens": F.col(n), "over_limit": F.col(n) > limit}).drop(n)
