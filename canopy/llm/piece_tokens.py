"""SentencePiece encoding and decoding by a prefix table.

For a merge-type vocabulary every prefix of a text has exactly one last token.
An automaton reports the tokens that end at each place; the one that belongs
there is the one whose predecessor, the last token of the prefix before it, is
compatible: the two tokens side by side must come out of the merges as just
these two.  Following the table backwards gives the ids.  No merge crosses the
place before a word mark or beside a character that no token holds, so a text is
encoded in chunks, and each worker keeps a bounded table of chunks that it met.

Defined cases: a null text counts as the empty text, which has no tokens and
decodes to itself; characters outside the vocabulary become their bytes; repeated
rows give equal rows; an empty table gives an empty table; only key and text are
read, so further columns do not clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, once, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
_CHUNKS, _PAIRS, _LONGEST = 1_500_000, 400_000, 64
#: Marks that often close a word: cut off where no token spans the place.
_CLOSING = ".,;:!?*$%&#|"
#: A chunk of a text with several marks in a row: the marks and what follows.
_RUNS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class PieceEncoder(dict):
    """Chunk -> little-endian unsigned 32-bit ids, filled on demand.

    A chunk stands for itself after a word mark, or, where it begins with a line
    feed, for that line feed and a word without a mark.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.rank = {p: (-sp.get_score(i)) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = {c for p in self.ids for c in p}
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(c in self.chars for c in " \n") or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has tokens that cross a word or line end")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.lengths = {i: len(p) for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.closings: dict[str, bytes] = {}
        self.names = [str(i) for i in range(size)]
        for probe in ("a  b", " x\ny ", "\u0001é"):
            if self.encode(probe).tolist() != sp.encode(probe):
                raise ValueError("the model normalises texts or is not of merge type")

    def _merge(self, text: str) -> list[str]:
        """The merges themselves, on the few characters of one or two tokens."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _pair(self, code: int, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: nothing before it)."""
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        want = [self.pieces[token]] if before < 0 else [self.pieces[before], self.pieces[token]]
        out = self.pairs[code] = self._merge("".join(want)) == want
        return out

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary."""
        fits, unseen = self.pairs.get, self._pair
        last: list[int] = [-1] * (len(text) + 1)
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            before = last[start]
            if before < 0 and start:
                continue
            code = before << 20 | token
            ok = fits(code)
            if ok or (ok is None and unseen(code, before, token)):
                last[end] = token
        out, at, lengths = [], len(text), self.lengths
        while at > 0:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def _encode(self, chunk: str) -> list[int]:
        if self.chars.issuperset(chunk):
            return self._known(chunk) if chunk else []
        out, run = [], ""
        for c in chunk:
            if c in self.chars:
                run += c
                continue
            if run:
                out += self._known(run)
                run = ""
            out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return out + (self._known(run) if run else [])

    def __missing__(self, chunk: str) -> bytes:
        stem = chunk.rstrip(_CLOSING)
        if stem and stem != chunk and chunk[len(stem) - 1 : len(stem) + 1] not in self.neighbours:
            closing = chunk[len(stem) :]
            if closing not in self.closings:
                if len(self.closings) >= _PAIRS:
                    self.closings.clear()
                self.closings[closing] = array("I", self._encode(closing)).tobytes()
            out = self[stem] + self.closings[closing]
        else:
            ids = [self.bytes[10], *self._encode(chunk[1:])] if chunk[:1] == "\n" else self._encode(MARK + chunk)
            out = array("I", ids).tobytes()
        if len(chunk) <= _LONGEST:
            if len(self) >= _CHUNKS:
                self.clear()
            self[chunk] = out
        return out

    def _run(self, chunk: str) -> bytes:
        """A chunk of a text with several marks in a row."""
        if chunk[0] == MARK and chunk[1:2] != MARK:
            return self[chunk[1:]]
        return array("I", self._encode(chunk)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, without begin and end ids."""
        if not text:
            return np.zeros(0, "<u4")
        spaced = text.replace("\n", " \n") if "\n" in text else text
        if "  " in spaced or MARK in text or spaced[0] == " " or text[-1] == " ":
            parts = map(self._run, _RUNS.findall(MARK + text.replace(" ", MARK)))
        else:
            parts = map(self.__getitem__, spaced.split(" "))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids) -> str:
        return self.library.decode(ids if isinstance(ids, list) else np.asarray(ids).tolist())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: key and ids (array of int)."""

    def run(batches):
        e = once(("pieces", path), lambda: PieceEncoder(path))
        for b in batches:
            ids = [e.encode(t).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return _mapped(docs, run, key, text, "ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Columns: key and text."""

    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            texts = [sp.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return _mapped(encoded, run, key, ids, "text string")


def _mapped(rows: DataFrame, run, key: str, value: str, out: str) -> DataFrame:
    picked = rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{value}`").alias("__value"))
    return map_arrow(picked, run, f"`{key}` {picked.schema[0].dataType.simpleString()}, {out}")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass and keep the digests of both."""

    def run(batches):
        e = once(("pieces", path), lambda: PieceEncoder(path))
        name = e.names.__getitem__
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                ids = e.encode(t).tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, run, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1(spark, sf_dir: str) -> DataFrame:
    from .packing import vocabulary_path

    return digests(table(spark, sf_dir, "documents"), vocabulary_path(MODEL))
