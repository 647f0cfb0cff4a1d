"""Token ids of whole texts under a BPE vocabulary with word ends.

A blank and a line feed end a word for this tokenizer whatever stands beside
them, so a text's ids are the ids of its blank-separated chunks one after
another.  Each worker keeps the encoded bytes of the chunks it has met in a
bounded table; chunks that are new run as one byte-pair merge through a rank
table of the same vocabulary, in which the end-of-word mark is a control byte.
Whatever that table cannot express (special strings, control bytes, letters whose
lower case depends on context, other white space) goes to the library itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: The word pattern of the vocabulary: a fixed value.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "\x01"
_CHUNKS = 1_000_000
_LONGEST = 64


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class WordEncoder(dict):
    """Chunk -> little-endian unsigned 32-bit ids, filled on demand."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        self.specials = tuple(t["content"] for t in spec["added_tokens"])

        def raw(piece: str) -> bytes:
            end = piece.endswith("</w>")
            return bytes(letters[c] for c in (piece[:-4] if end else piece)) + (END.encode() if end else b"")

        order = [bytes([b]) for b in range(256)] + [bytes([b]) + END.encode() for b in range(256)]
        for m in merges:
            left, right = m if isinstance(m, list) else m.split(" ")
            order.append(raw(left) + raw(right))
        ranks: dict[bytes, int] = {}
        for r, piece in enumerate(order):
            ranks.setdefault(piece, r)
        ids = {raw(p): i for p, i in vocab.items() if p not in self.specials}
        self.ids = np.zeros(len(order), "<u4")
        for piece, r in ranks.items():
            self.ids[r] = ids.get(piece, 0)
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        out = self._encode(chunk)
        if len(chunk) <= _LONGEST:
            if len(self) >= _CHUNKS:
                self.clear()
            self[chunk] = out
        return out

    def _encode(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii():
            if not chunk.isprintable() or "<|" in chunk:
                return self._library(chunk)
            words = WORDS.findall(chunk.lower())
        else:
            plain = unicodedata.normalize("NFC", chunk)
            if "<|" in chunk or "Σ" in plain or not plain.isprintable():
                return self._library(chunk)
            words = WORDS.findall(plain.lower())
        return self.ids[self.merger.encode_ordinary(END.join(words) + END)].tobytes() if words else b""

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, as the library gives them without special tokens."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
