"""Removal of repeated passages, with a count-min prefilter.

A window is WINDOW consecutive words of one text. Copies of whole texts are settled first, by their hashes: of each text
only rows with its smallest id are searched further.

First pass: every window has a minimizer, the least hash of the GRAM-word runs in it, and equal windows have equal
minimizers, so the number of texts that hold a minimizer bounds from above the number that hold any of its windows.
Each partition sketches its texts' distinct minimizers into DEPTH rows of cells; the partition sketches are merged cell
by cell, and a bit per cell says whether its count reached two. Sketches travel as lists of filled cells, so merging
costs in proportion to the texts; the merged bits are broadcast, at most 2 * MAX_CELLS / 8 bytes whatever the input.

Second pass: only windows whose estimate is two or more are grouped exactly, by two independent 64-bit hashes over the
word sequence, to the smallest id that holds them. Estimates never fall short, so none is lost. Windows that a smaller
id holds are removed, word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, column, discard, store

WINDOW = 50
GRAM = 32
DEPTH = 2
#: Cells of a sketch row: a power of two from CELLS_PER_WORD times the words (some 8 per minimizer), within bounds.
CELLS_PER_WORD, MIN_CELLS, MAX_CELLS = 0.6, 1 << 20, 1 << 29
#: Cells that are merged at once.
BLOCK = 1 << 20
#: Fixed odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words whose hashes a worker remembers.
CACHE_WORDS = 500_000
#: Bytes of row ids or removed spans that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _raised(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def rolling(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    up, down = _raised(base, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return _mixed((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def minimizers(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The minimizer of each window."""
    gram = min(GRAM, window)
    return sliding_min(rolling(words, gram, BASES[0]), window - gram + 1)


def _cells(m: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((m * np.uint64(BASES[row]) + np.uint64(row)) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def sketch(texts: DataFrame, cells: int, window: int) -> list[np.ndarray]:
    """For each sketch row, a bit per cell: in two texts or more, by estimate. texts(text)."""
    block = min(BLOCK, cells)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's filled cells, told apart into those filled once and more often."""
        hashes, held = WordHashes(), []

        def out() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            for row in range(DEPTH):
                at, n = np.unique(_cells(every, row, cells), return_counts=True)
                cut = np.flatnonzero(np.diff(at // block)) + 1
                for own, counts in zip(np.split(at, cut), np.split(n, cut), strict=True):
                    if len(own):
                        key = row * (cells // block) + int(own[0]) // block
                        local = (own % block).astype("<u4")
                        yield pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int64()), "once": [local[counts == 1].tobytes()], "more": [local[counts > 1].tobytes()]})

        total = 0
        for b in batches:
            for t in column(b, "text"):
                w = hashes.of(t)
                if len(w) >= window:
                    held.append(np.unique(minimizers(w, window)))
                    total += len(held[-1])
            if total > 4_000_000:
                yield from out()
                held, total = [], 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the blocks, which come sorted."""
        now, one, two = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int64()), "bits": [np.packbits(two).tobytes()]})

        for b in batches:
            for key, once, more in zip(*(column(b, c) for c in ("block", "once", "more")), strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now, one, two = key, np.zeros(block, bool), np.zeros(block, bool)
                once = np.frombuffer(once, "<u4")
                two[once[one[once]]] = True
                one[once] = True
                two[np.frombuffer(more, "<u4")] = True
        if now is not None:
            yield done()

    parts = arrow_map(texts.select("text"), part, "block bigint, once binary, more binary")
    blocks = DEPTH * cells // block
    dealt = parts.repartition(min(blocks, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block").sortWithinPartitions("block")
    rows = [np.zeros(cells // 8, np.uint8) for _ in range(DEPTH)]
    # Bounded by MAX_CELLS: one packed block after the other.
    for r in dealt.mapInArrow(merge, "block bigint, bits binary").toLocalIterator():
        row, at = divmod(r.block, cells // block)
        rows[row][at * block // 8 : (at + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return rows


def _few(rows: DataFrame, count: int, each: int) -> DataFrame:
    return F.broadcast(rows) if count * each <= BROADCAST_BYTES else rows


def found_spans(source: DataFrame, kind: str, window: int) -> tuple[DataFrame, DataFrame]:
    """What source(row, id, text) loses: base(row, id, text_1, text_2, n_words, sha) of all its rows, and results(row, gone, spans) of those searched that lose words.

    Of the rows with a text, the first with its smallest id is searched. row must stay the same when source is read again.
    """
    spark = source.sparkSession
    hashed = source.select("row", "id", "text", F.xxhash64("text").alias("text_1"), F.xxhash64(F.lit(1), "text").alias("text_2"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha = [], []
            for t in column(b, "text"):
                words = t.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(n, pa.int64()), pa.array(sha)], ["row", "id", "text_1", "text_2", "n_words", "sha"])

    base = store(arrow_map(hashed, facts, f"row bigint, id {kind}, text_1 bigint, text_2 bigint, n_words bigint, sha string"), "substring-base")
    long = base.where(F.col("id").isNotNull() & (F.col("n_words") >= window))
    many = long.groupBy("text_1", "text_2").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = store(long.join(many, ["text_1", "text_2"]).where("row != least.row").select("row"), "substring-copies")
    texts = source.where(F.col("id").isNotNull()).join(_few(copies, copies.count(), 16), "row", "left_anti")
    words = base.agg(F.sum("n_words")).first()[0] or 0
    cells = max(MIN_CELLS, min(MAX_CELLS, 1 << int(words * CELLS_PER_WORD).bit_length()))
    bits = spark.sparkContext.broadcast(sketch(texts, cells, window))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows whose estimate is two or more."""
        hashes = WordHashes()
        for b in batches:
            ids, rows = column(b, "id"), column(b, "row")
            for i, t in enumerate(column(b, "text")):
                w = hashes.of(t)
                if len(w) < window:
                    continue
                m = minimizers(w, window)
                twice = np.ones(len(m), bool)
                for row in range(DEPTH):
                    at = _cells(m, row, cells)
                    twice &= (bits.value[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(twice)
                if len(at):
                    h1 = rolling(w, window, BASES[0])[at].view(np.int64)
                    h2 = rolling(_mixed(w), window, BASES[1])[at].view(np.int64)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1), pa.array(h2), pa.array([ids[i]] * n, b.schema.field("id").type), pa.array(np.full(n, rows[i])), pa.array(at.astype(np.int32))],
                        ["h1", "h2", "id", "row", "at"],
                    )

    found = store(arrow_map(texts.select("id", "row", "text"), candidates, f"h1 bigint, h2 bigint, id {kind}, row bigint, at int"), "substring-windows")
    held = found.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    held = store(held, "substring-held")
    covered = found.join(held, ["h1", "h2"]).where("least < id").groupBy("row").agg(F.collect_list("at").alias("at"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of the words that windows from these places cover."""
        for b in batches:
            gone, spans = [], []
            for at in b.column(1):
                at = np.unique(at.values.to_numpy()).astype(np.int64)
                cut = np.flatnonzero(np.diff(at) > window)
                begin, end = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + window
                gone.append(int((end - begin).sum()))
                spans.append(np.stack((begin, end), 1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["row", "gone", "spans"])

    results = store(arrow_map(covered, together, "row bigint, gone bigint, spans array<bigint>"), "substring-results")
    discard(copies, found, held)
    return base, results


def _shared(base: DataFrame, results: DataFrame, window: int) -> DataFrame:
    """base with n_removed and spans, of copies too; and `from_row`, the row whose result a row shares."""
    long = F.col("id").isNotNull() & (F.col("n_words") >= window)
    firsts = base.where(long).groupBy("text_1", "text_2").agg(F.min(F.struct("id", "row")).alias("least"))
    rows = base.join(firsts, ["text_1", "text_2"], "left")
    copy = long & (F.col("id") != F.col("least.id"))
    rows = rows.withColumns({"copy": F.coalesce(copy, F.lit(False)), "from_row": F.when(long & ~copy, F.col("least.row"))}).drop("least")
    rows = rows.join(results.withColumnRenamed("row", "from_row"), "from_row", "left")
    whole = F.array(F.lit(0).cast("bigint"), F.col("n_words"))
    return rows.withColumns({"n_removed": F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))), "spans": F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast("array<bigint>")))})


def left_words(text: bytes, spans: list[int]) -> bytes:
    """The words outside the spans, joined by one space."""
    words, at, kept = text.split(), 0, []
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept += words[at:start]
        at = end
    return b" ".join(kept + words[at:])


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), bytes_of(F.col(text_col)).alias("text"))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_1, text_2, n_words, n_removed, spans, kept_sha256) for each row of df.

    df must give the same rows in the same order when it is read again, as files and stored tables do. text_1 and text_2 are
    two 64-bit hashes of the text; spans are the removed runs of words, as [start, end) pairs in order. Null texts have no
    words. Texts shorter than a window lose nothing. Rows with a null id neither lose words nor take any from others. Repeated
    rows (equal id and text) share a result, a row each; texts under one id don't take words from each other. Extra columns
    are not read.
    """
    source, kind = _rows(df, id_col, text_col), df.schema[id_col].dataType.simpleString()
    base, results = found_spans(source, kind, window)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256(left_words(t, s)).hexdigest() for t, s in zip(column(b, "text"), column(b, "spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha)], ["from_row", "cut_sha"])

    n, ends = results.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    cut = source.join(_few(results.select("row", "spans"), 64 * n + 8 * ends, 1), "row").select("row", "text", "spans")
    cut = store(arrow_map(cut, digest, "from_row bigint, cut_sha string"), "substring-cut")
    nothing = hashlib.sha256(b"").hexdigest()
    kept = F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")
    return _shared(base, results, window).join(cut, "from_row", "left").select("id", "text_1", "text_2", "n_words", "n_removed", "spans", kept)


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """df with the words that removals() names cut out of its texts; rows that lose nothing keep their text as it is. df must give the same rows when read again."""
    names = df.columns
    base, results = found_spans(_rows(df, id_col, text_col), df.schema[id_col].dataType.simpleString(), window)
    found = store(_shared(base, results, window).where("n_removed > 0").select("row", "spans"), "substring-spans")
    discard(base, results)
    n, ends = found.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    # Whole rows travel as one column, so that no name of theirs clashes.
    keyed = df.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row"))
    joined = keyed.join(_few(found, 64 * n + 8 * ends, 1), "row", "left").select("doc", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(names, b.column(0).flatten(), strict=True))
            texts = cols[text_col].to_pylist()
            for i, spans in enumerate(column(b, "spans")):
                if spans:
                    texts[i] = left_words(texts[i].encode(), spans).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else cols[c] for c in names], names)

    return arrow_map(joined, cut, df.schema)
