"""Whole texts to token ids with the tokenizers library, remembering what pieces between white space encode to.

Both kinds of vocabulary cut a text before they merge. Where a cut is certain (before a space between two other characters,
or at all white space if the vocabulary drops it), the pieces encode independently, so equal pieces need the library once.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np
import regex

CUT = re.compile(r"(?<=\S) (?=\S)")
#: How byte-level vocabularies split a text that comes without a pattern of its own (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character the Unicode versions of all libraries agree on classes, composition and case.
SETTLED = "\u0250"
#: Byte-level vocabularies write bytes as characters: printable ones as themselves, the others from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_CHARS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: White space to Python's str, not to the library's patterns; and the mark of a first piece.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\0")


class PieceEncoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit integers in bytes; null encodes as the empty text.

    Equal to Tokenizer.encode(text, add_special_tokens=False) for every text. `limit` bounds the number of remembered pieces, at
    half as many in each of three tables (about 300 bytes a piece, so 400 to 600 MB at most): those not seen for half as many
    new ones are forgotten, which costs time only.
    """

    def __init__(self, path: str, limit: int = 1_400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.library.model
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.kind = self._kind(spec)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        pattern = BYTE_LEVEL if self.kind == "led" else spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.kind == "bare" else ""
        self.split = regex.compile(pattern).findall

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            return "led"  # a space belongs to the word after it
        steps = pre.get("pretokenizers", [])
        if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s" in steps[0]["pattern"]["Regex"]:
            steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
            return "bare" if steps == ["NFC", "Replace", "Lowercase"] else "whole"  # white space is dropped
        return "whole"

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str] | None:
        """None: only the library as a whole will do. In the led kind the first piece is marked as having no space before it."""
        if self.kind == "whole" or any(x in text for x in self.special) or any(x in text for x in ODD):
            return None
        if self.kind == "bare":
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split()
            return text.lower().split()  # such texts are composed; fewer different pieces are left
        pieces = text.split(" ")
        pieces[0] = "\0" + pieces[0]
        return pieces

    def _fits(self, piece: str) -> bool:
        return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()

    def _merged(self, part: str) -> bytes:
        """Ids of one part that the splitter doesn't cut, merged by the library's model."""
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(BYTE_CHARS))
        return struct.pack(f"<{len(tokens)}I", *[x.id for x in tokens])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece. One of settled characters is split by the vocabulary's pattern; any other goes to the library."""
        led = self.kind == "led"
        text = piece if not led else piece[1:] if piece[0] == "\0" else " " + piece
        if not piece.isascii() and max(piece) >= SETTLED:
            return self._ids([text])[0]
        if not led:
            text = unicodedata.normalize("NFC", piece).lower()
        if led and piece.isalpha():
            return self._merged(text)
        out = []
        for part in self.split(text):
            word = led and part[0] == " " and len(part) > 1
            memo, key = (self.known, part[1:]) if word else (self.parts, part)
            ids = memo.get(key)
            if ids is None:
                ids = self._merged(part)
                if len(part) < 32:
                    memo[key] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.limit // 2:
            self.before, self.known = self.known, {}
        if len(self.parts) > self.limit // 2:
            self.parts.clear()
        return [self._text(x or "") for x in texts]

    def _text(self, text: str) -> bytes:
        pieces = self._pieces(text)
        if pieces is None:
            return self._ids([text])[0]
        known = self.known
        ids = list(map(known.get, pieces))
        if None not in ids:
            return b"".join(ids)
        if self.kind == "led" and not all(self._fits(p) for p, x in zip(pieces, ids, strict=True) if x is None):
            pieces = CUT.split(text)
            pieces[0] = "\0" + pieces[0]
            ids = list(map(known.get, pieces))
        for k, x in enumerate(ids):
            if x is None:
                p = pieces[k]
                x = self.before.get(p)
                if x is None:
                    x = known.get(p)  # met earlier in this text
                    if x is None:
                        x = self._piece(p)
                if len(p) <= 48 and (self.kind == "bare" or self._fits(p)):
                    known[p] = x
                ids[k] = x
        return b"".join(ids)


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, limit: int = 1_400_000) -> PieceEncoder:
    """One encoder for each worker process, vocabulary and limit of remembered pieces."""
    key = (path, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]
