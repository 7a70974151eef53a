"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned into integers. At each resolution a vector is cut into segments, and each keeps its mean and its
deviation; two segments of m components have an inner product of at most m * (mean * mean + deviation * deviation), and
a squared distance of at least m * ((difference of means)^2 + (difference of deviations)^2), which is the same bound since
distance^2 = |q|^2 + |x|^2 - 2 * q.x. Summed over segments this bounds a pair from a few numbers, and finer segments bound it
more closely. Queries are packed into tiles of at most TILE, rows into blocks of at most CHUNK, on the executors, and each tile meets
each block. A task keeps the k best so far of each query of its tiles, drops pairs whose bound at a resolution falls short of
the query's k-th best, coarse to fine, and computes exact integer scores of the pairs that are left. Tasks' k best meet in one ranking
per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, store

SCALE = 1024
#: Segments at each resolution.
RESOLUTIONS = (1, 4, 16)
#: Queries of a tile and rows of a block (fewer of wide vectors: WIDE components in all at most); a task's memory is some numbers for each pair of these.
TILE, CHUNK, WIDE = 1024, 2048, 1 << 18
#: Tiles whose queries a task keeps the best of at once.
TILES = 16
#: Share of pairs up to which survivors are scored pair by pair.
SPARSE = 0.15
#: Largest integer that doubles hold exactly with all below it.
EXACT = float(1 << 53)
#: Room for rounding in bounds.
SLACK = 1e-9


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) without vectors that are null or hold null, NaN or infinite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(v.isNotNull() & F.col("id").isNotNull() & ~bad)


def matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """The lists as rows, filled up with zeros to a common width."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = flat
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that the inner product of two rows' statistics bounds that of the rows."""
    edges = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = x[:, a:b]
        root = np.sqrt(max(1, b - a))
        out += [own.mean(1) * root if b > a else np.zeros(len(x)), own.std(1) * root if b > a else np.zeros(len(x))]
    return np.stack(out, 1)


def quantized(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles; infinite where a double holds it no more."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as unbounded integers; large components are whole numbers."""
    return np.array([[int(v) * SCALE if abs(v) >= 1 << 42 else int(np.floor(v * SCALE)) for v in row] for row in x], object).reshape(x.shape)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of quantized vectors: by doubles where those are exact, else by unbounded integers, cut to 64 bits."""
    a, b = quantized(q), quantized(x)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, q.shape[1]) < EXACT:
        return (a @ b.T).astype(np.int64)
    return np.clip(_whole(q) @ _whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def exact_pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """exact_scores of each row of q with the same row of x."""
    a, b = quantized(q), quantized(x)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, q.shape[1]) < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.clip((_whole(q) * _whole(x)).sum(1), -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """Each query's k best rows so far: by score, then by smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.widen(queries)

    def widen(self, queries: np.ndarray) -> None:
        self.q = queries
        self.stats = [statistics(quantized(queries), r) for r in RESOLUTIONS]

    def floors(self) -> tuple[np.ndarray, np.ndarray]:
        """Which queries have k rows already, and their k-th best score."""
        n = np.bincount(self.query, minlength=len(self.ids))
        full, last = n == self.k, np.cumsum(n) - 1
        floor = np.zeros(len(self.ids), np.int64)
        floor[full] = self.score[last[full]]
        return full, floor

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        width = max(x.shape[1], self.q.shape[1])
        if self.q.shape[1] < width:
            self.widen(_widened(self.q, width))
        x, (full, floor) = _widened(x, width), self.floors()
        left = ids[None, :] != self.ids[:, None]
        if full.any():
            whole = quantized(x)
            for r, of_q in zip(RESOLUTIONS, self.stats, strict=True):
                with np.errstate(invalid="ignore", over="ignore"):
                    of_x = statistics(whole, r)
                    bound = of_q @ of_x.T
                    bound += SLACK * np.outer(np.linalg.norm(of_q, axis=1), np.linalg.norm(of_x, axis=1)) + 1
                    left &= ~((bound < floor[:, None]) & full[:, None])  # what no number bounds is kept
        i, j = np.nonzero(left)
        if not len(i):
            return
        if len(i) <= SPARSE * left.size:
            step = max(1, WIDE // max(1, width))
            got = np.concatenate([exact_pairs(self.q[i[at : at + step]], x[j[at : at + step]]) for at in range(0, len(i), step)])
        else:
            some, rows = np.flatnonzero(left.any(1)), np.flatnonzero(left.any(0))
            got = exact_scores(self.q[some], x[rows])[np.searchsorted(some, i), np.searchsorted(rows, j)]
        good = ~full[i] | (got >= floor[i])
        i, j, got = i[good], j[good], got[good]
        query = np.concatenate((self.query, i))
        score, row = np.concatenate((self.score, got)), np.concatenate((self.row, ids[j]))
        order = np.lexsort((row, ~score, query))  # ~ turns the order around and never overflows
        query, score, row = query[order], score[order], row[order]
        top = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.score, self.row = query[top], score[top], row[top]


def packed(rows: DataFrame, most: int) -> DataFrame:
    """rows(id, v) as blocks of `most` at most: (block, ids, width, vectors), shorter vectors filled up with zeros; block is any number of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, most)
                x = matrix(pa.array(part.column(1)))
                if x.size > WIDE and part.num_rows > 1:
                    part = b.slice(at, max(1, WIDE // x.shape[1]))
                    x = matrix(pa.array(part.column(1)))
                at += part.num_rows
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "width", "vectors"])

    return arrow_map(rows, pack, "ids binary, width int, vectors binary")


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every`, its k rows of highest integer inner product, itself left out.

    Ties go to the smaller id. Vectors that are null or hold null, NaN or infinite components take no part, nor do rows with
    a null id. Shorter vectors count as filled up with zeros. Repeated rows are candidates each; a repeated query
    answers once for each distinct vector and doesn't find rows of its own id. Scores are exact for finite components of any size; beyond
    64 bits they are cut to these. Extra columns are not read.
    """
    rows = store(vectors(df, id_col, vector_col), "topk-rows")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    tiles = store(packed(queries, TILE).withColumn("tile", F.monotonically_increasing_id()), "topk-tiles")
    blocks = packed(rows, CHUNK).select(F.col("ids").alias("row_ids"), F.col("width").alias("row_width"), F.col("vectors").alias("rows"))
    # The stated queries against all rows, block by block.
    met = blocks.crossJoin(tiles).select("tile", "ids", "width", "vectors", "row_ids", "row_width", "rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for tile, b in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.query), tile)), pa.array(b.query), pa.array(b.ids[b.query]), pa.array(b.row), pa.array(b.score)], ["tile", "query", "query_id", "id", "score"])
            best.clear()

        for batch in batches:
            for n in range(batch.num_rows):
                tile, ids, width, found, row_ids, row_width, own = (c[n].as_py() for c in batch.columns)
                if tile not in best:
                    if len(best) == TILES:
                        yield from out()
                    best[tile] = Best(np.frombuffer(found).reshape(-1, width), np.frombuffer(ids, np.int64), k)
                best[tile].add(np.frombuffer(own).reshape(-1, row_width), np.frombuffer(row_ids, np.int64))
        yield from out()

    part = store(arrow_map(met, search, "tile bigint, query bigint, query_id bigint, id bigint, score bigint"), "topk-part")
    discard(tiles)
    rank = F.row_number().over(Window.partitionBy("tile", "query").orderBy(F.desc("score"), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
