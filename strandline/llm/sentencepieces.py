"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a text once; at each position its output links give every piece that ends there,
longest first, and the best way to the position is relaxed through them. In a unigram model the best way has the
largest sum of scores. In a byte-pair model the only way that merging can leave is the one whose neighbours are all
pairs that merging itself leaves apart: a piece relaxes a position where it may stand after the piece before it. At most one
piece can, so there are no scores to compare there and the rest of the position's links are passed over; pairs are judged once, by
merging them by their scores, and remembered. Characters without a piece become their bytes' pieces.

Where no piece holds a space mark behind another character, words cannot meet in a piece and are encoded one by one and remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bytes_of, column, received, send_file

#: Fixed values of the model file's format: the space mark, and the numbers of fields and model types.
SPACE = "▁"
TRAINER, NORMALIZER, MODEL_TYPE, CHARSMAP, DUMMY_PREFIX, SQUEEZE = 2, 3, 3, 2, 3, 4
UNIGRAM, BYTE_PAIR = 1, 2
#: About so many bytes of words with their ids, and so many pairs (some 100 bytes each), are remembered by a worker.
CACHE_BYTES, CACHE_PAIRS = 200 << 20, 600_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A model file's pieces, and its encoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = dict(x for x in _fields(f.read()) if x[0] != 1)
        trainer, normal = dict(_fields(parts.get(TRAINER, b""))), dict(_fields(parts.get(NORMALIZER, b"")))
        self.kind = trainer.get(MODEL_TYPE, UNIGRAM)
        if self.kind not in (UNIGRAM, BYTE_PAIR) or normal.get(CHARSMAP) or normal.get(SQUEEZE, 1):
            raise ValueError("only unigram and byte-pair models without a normalization table or white-space squeezing are read")
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.score: list[float] = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id, self.text = plain, {i: p for p, i in plain.items()}
        self.out = [self.text[i].replace(SPACE, " ").encode() if i in self.text else b"" for i in range(n)]
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])
        self.automaton = ahocorasick.Automaton()
        for p, i in plain.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        by_word = not any(SPACE in p.lstrip(SPACE) for p in plain)
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if by_word else re.compile("(?s).+")
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b as they are, side by side."""
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return self.pairs[key]

    def _merged(self, text: str) -> list[str]:
        """A few characters merged pair by pair, best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[self.id[p]], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.id]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[x] for x in char.encode()] if self.bytes else [self.unknown]

    def _viterbi(self, text: str) -> list[int]:
        """The ids of a run of text: last[i] is the piece that ends the best way to i, below zero for a character of its own."""
        n = len(text)
        last, length = [-1] * (n + 1), [1] * (n + 1)
        if self.kind == UNIGRAM:
            self._relax_scores(text, last, length)
        else:
            pairs = self.pairs
            for end, (size, piece) in self.automaton.iter(text):
                end += 1
                if last[end] >= 0:
                    continue
                before = last[end - size]
                ok = pairs.get(before << 32 | piece) if before >= 0 else size == 1 or self._merged_alone(piece)
                if ok or ok is None and self._apart(before, piece):
                    last[end], length[end] = piece, size
        out: list[int] = []
        while n:
            out += [last[n]] if last[n] >= 0 else self._fallback(text[n - 1])[::-1]
            n -= length[n]
        return out[::-1]

    def _relax_scores(self, text: str, last: list[int], length: list[int]) -> None:
        """A character of its own scores below every piece."""
        best, at, floor = [0.0] * (len(text) + 1), 1, min(self.score) - 10
        reached = [False] * (len(text) + 1)

        def alone(upto: int) -> None:
            nonlocal at
            while at < upto:
                if not reached[at]:
                    best[at] = best[at - 1] + floor
                at += 1

        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            alone(end)
            score = best[end - size] + self.score[piece]
            if not reached[end] or score > best[end]:
                reached[end], last[end], length[end], best[end] = True, piece, size, score
        alone(len(text) + 1)

    def _merged_alone(self, piece: int) -> bool:
        """Whether merging makes the piece from its characters."""
        key = -1 - piece
        if key not in self.pairs:
            self.pairs[key] = self._merged(self.text[piece]) == [self.text[piece]]
        return self.pairs[key]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        words, known = self.words.findall(text), self.known
        for w in words:
            if w not in known:
                known[w] = ids = np.array(self._viterbi(w), "<u4").tobytes()
                self.held += 200 + 2 * len(w) + len(ids)
        out = b"".join(map(known.__getitem__, words))
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. Space marks in the encoded text come back as spaces."""
        raw = b"".join(map(self.out.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_workers: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of df. Null and empty texts have no ids; repeated rows and null ids are kept; extra columns are not read."""
    name = send_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(received(name))
        for b in batches:
            raw = [pieces.encode(t.decode("utf-8", "replace")) for t in column(b, "text")]
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), bytes_of(F.col(text_col)).alias("text")), run, f"id {kind}, ids array<int>")


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded`, the text of its ids; null ids decode as the empty text."""
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    name = send_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(received(name))
        for b in batches:
            at = b.column(b.schema.get_field_index(ids_col))
            texts = [pieces.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return arrow_map(df, run, schema)


def crc32_of_ids(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
