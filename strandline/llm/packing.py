"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each text becomes its token ids and an end id. Whole runs of `capacity` ids are sequences of their own; what is left of
each text is one piece, or two: a long rest gives up a short tail, since few large pieces could not level windows. Pieces are dealt into blocks of about BLOCK_TOKENS tokens by their running total, and each block
is packed on its own: every piece starts as a partial partition of one loaded and k-1 empty windows; the two partitions
with the largest imbalances are merged again and again, heaviest windows onto lightest, until one partition of k nearly
equal windows is left. k is the least number that could hold the block; while a window exceeds the capacity, k rises.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, column, received, send_file, store

CAPACITY = 2048
END_ID = 1
#: Tokens packed together: the memory and time of one task, whatever the input.
BLOCK_TOKENS = 1 << 18
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_200_000
#: How the tokenizer's file splits words in lower case, of printable ASCII and of the letters from U+00DF to U+017F.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
#: Words of these characters have no other normal form than themselves in lower case.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Characters that stand for bytes in byte-level models; other bytes are themselves.
BYTES = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: A rest of at least LONG ids is cut once more, so that differencing has small pieces to level windows with: the tail has TAIL[0] to TAIL[0] + TAIL[1] - 1 ids.
LONG, TAIL = 256, (32, 96)


def tokenizer(path: str):
    """The tokenizer in a file, with its special strings taken as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Memory(dict):
    """Ids of words or parts of words, little-endian, made when one comes up first; CACHE_WORDS are remembered."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = self.encode(word)
        return ids


class Encoder:
    """ids(UTF-8 text) for a tokenizer.

    Where its file says that white space only separates (a Split whose matches never hold white space), words are encoded
    apart and remembered. Where besides the file is of the kind that SPLIT describes, PLAIN words, which its normalizer only
    lowers, are split here and their parts, remembered too, go straight to the file's merges. Other words go through the
    whole tokenizer, and so do the whole texts of other tokenizers.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_word = _words_stand_alone(rules)
        self.plain = self.by_word and _parts_stand_alone(rules)
        self.words, self.parts = Memory(self._word), Memory(self._part)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        if self.plain and (low := word.lower()).isalpha():  # ASCII letters alone
            return self.parts[low.decode()]
        text = word.decode("utf-8", "replace")
        if self.plain and PLAIN.fullmatch(text):
            return b"".join(map(self.parts.__getitem__, SPLIT.findall(text.lower())))
        return self._whole(text)

    def _part(self, part: str) -> bytes:
        own = part if part.isascii() else part.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(own)]).tobytes()

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return self._whole(text.decode("utf-8", "replace"))
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder, and what it remembers, for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts_stand_alone(rules: dict) -> bool:
    """True if the Split's pattern is SPLIT with classes for all of Unicode, and its matches, as bytes, go to a BPE model."""
    steps = rules["pre_tokenizer"]["pretokenizers"]
    byte_level = len(steps) == 2 and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": steps[1].get("trim_offsets"), "use_regex": False}
    pattern = SPLIT.pattern.replace(LETTERS, r"\p{L}").replace("0-9]+", r"\p{N}]+").replace("[0-9]", r"[\p{N}]")
    return byte_level and steps[0]["pattern"]["Regex"] == pattern and rules["model"]["type"] == "BPE" and rules.get("post_processor") is None


def _words_stand_alone(rules: dict) -> bool:
    """True for: NFC, runs of white space to one space, lower case; then a Split that keeps only matches without white space."""
    steps = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kept = splits and splits[0].get("type") == "Split" and splits[0].get("invert") and splits[0].get("behavior") == "Removed"
    plain = kept and re.fullmatch(r"(?:'\w+\||\[\\p\{[LN]\}\]\+?\||\[\^\\s\\p\{L\}\\p\{N\}\]\+)+", splits[0]["pattern"].get("Regex", "")) is not None
    return steps == ["NFC", "Replace", "Lowercase"] and bool(plain)


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """The window (0 to k-1) of each item: largest differencing first over k windows."""
    if k == 1:
        return [0] * len(sizes)
    # A partial partition: the loads above its least one, descending, each with its chain of items; empty windows are implied.
    parent: list[tuple[int, int] | int] = list(range(len(sizes)))
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        la, lb = len(a), len(b)
        over = max(0, la + lb - k)  # so many windows get a load from either side: heaviest of a with lightest of b
        loads, nodes = a[: la - over] + b[: lb - over], an[: la - over] + bn[: lb - over]
        for j in range(over):
            parent.append((an[la - 1 - j], bn[lb - over + j]))
            loads.append(a[la - 1 - j] + b[lb - over + j])
            nodes.append(len(parent) - 1)
        order = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        loads, nodes = [loads[i] for i in order], [nodes[i] for i in order]
        if len(loads) == k:
            low = loads[-1]
            loads = [x - low for x in loads]
        count += 1
        heapq.heappush(heap, (-loads[0] + (loads[-1] if len(loads) == k else 0), count, loads, nodes))
    where = [0] * len(sizes)
    for w, top in enumerate(heap[0][3]):
        stack = [top]
        while stack:
            x = parent[stack.pop()]
            if isinstance(x, tuple):
                stack += x
            else:
                where[x] = w
    return where


def windows(sizes: list[int], capacity: int) -> list[int]:
    """The window of each item; the number of windows rises until none exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        where = karmarkar_karp(sizes, k)
        if np.bincount(where, weights=sizes).max() <= capacity:
            return where
        k += max(1, k // 256)


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): whole runs of `capacity` ids, and the rest in one or two pieces."""

    name = send_file(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(received(name)), end_id.to_bytes(4, "little")
        for b in batches:
            ids, texts = column(b, "id"), column(b, "text")
            rows: list[tuple] = []
            for i, text in zip(ids, texts, strict=True):
                raw = encoder.ids(text) + end
                n = len(raw) // 4
                cuts = [*range(0, n, capacity), n]
                if LONG <= cuts[-1] - cuts[-2] < capacity:
                    cuts.insert(-1, n - TAIL[0] - zlib.crc32(raw) % TAIL[1])
                rows += [(i, at, to - at, zlib.crc32(raw[4 * at : 4 * to]), n) for at, to in pairwise(cuts)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("id").type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), bytes_of(F.col(text_col)).alias("text")), run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed again. A null id is kept. Extra columns are not
    read. A window's pieces follow one another from offset 0 without gaps.
    """
    spark = df.sparkSession
    cut = store(pieces(df, id_col, text_col, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    part = F.shiftright("row", 33)
    rest = F.when(F.col("length") < capacity, F.col("length")).otherwise(0)
    # One number per partition, so that each knows where its pieces lie in the whole; bounded by the partitions.
    sums = sorted((r.part, r.n) for r in cut.groupBy(part.alias("part")).agg(F.sum(rest).alias("n")).collect())
    before, total = {}, 0
    for p, n in sums:
        before[p], total = total, total + n
    blocks = max(1, round(total / BLOCK_TOKENS))
    deal = spark.createDataFrame([(p, (b * blocks) // max(1, total), -(-n * blocks // max(1, total))) for (p, n), b in zip(sums, before.values(), strict=True)] or [(0, 0, 1)], "part bigint, first bigint, span bigint")
    # A partition's pieces are spread over the blocks that its share of the total covers.
    spread = F.col("first") + F.pmod(F.xxhash64("row"), F.greatest(F.col("span"), F.lit(1)))
    dealt = cut.withColumn("part", part).join(F.broadcast(deal), "part").withColumn("block", F.least(spread, F.lit(blocks - 1))).drop("part", "first", "span")
    whole = cut.where(F.col("length") == capacity).select("id", "start", "length", "ids_crc32", "doc_tokens", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))

    def one_block(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("row", kind="stable")
        where = np.array(windows(block["length"].tolist(), capacity), np.int64)
        block = block.assign(sequence_id=(block["block"].to_numpy() << 24) + where)
        block["offset"] = block.groupby("sequence_id")["length"].cumsum() - block["length"]
        return block[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = df.schema[id_col].dataType.simpleString()
    short = dealt.where(F.col("length") < capacity).groupBy("block").applyInPandas(one_block, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return whole.unionByName(short)
