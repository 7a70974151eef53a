"""Groups of similar texts: SimHash and exact prefix filtering for candidates, exact Jaccard similarity for the decision.

A text is the set of the 64-bit hashes of its shingles. Texts with equal sets are linked first, and only one of each goes on.
Then come the components that SimHash fingerprints make (`simhash.near_duplicates`): each text is decided against the
first one of its component. Fingerprints miss similar texts and join others, so prefix filtering finds every pair that is still apart:
All shingles have one order: by how many texts have them, rare ones first. Sets of the similarity sought share a shingle among
the first 1 - similarity of each (and one). Shingles that only one text has cannot be shared, so they count as part of
that prefix but are filed nowhere: most texts have enough of them, and file nothing at all. What is filed is therefore little, and
what many unlike texts share (a licence, a passage) comes last in the order and is not filed by them.

The number of texts that have a shingle is found by sending hashes, packed by ranges, to the tasks that count them, and
sending back those that occur twice or more. Shingles that are very common in a sample are not sent: they are the last of all
in the order, by their counts there. The sample moves work only, never a result.

At each place (a shingle and the texts filed under it) every text is compared with the first one; each text's likeliest pair is decided first, then
those that the links leave apart. Where a place still holds texts of several groups, texts of different groups are compared with each
other: within blocks, by the sizes and by 64 * WORDS bits, each the parity of the number of shingles that fall on it (no similar pair breaks these bounds),
first each text's closest one, then, with the groups that this leaves, all; and what passes is decided on the sets. No pair is missed, whatever the crowd, and the groups do not depend on how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_GAP, arrow_map, bytes_of, column, discard, store
from .simhash import SEED, components, near_duplicates
from .substrings import WordHashes, rolling

#: 64-bit words of parities, and words into which they are folded for a first look.
WORDS, FOLDED = 32, 8
#: Texts whose shingles are counted, to find common ones: those of LEAST of them or more, COMMON at most (16 bytes each are broadcast).
SAMPLE, LEAST, COMMON = 20_000, 8, 1_000_000
#: Shingles that are sent at once, those that are counted at once, and texts in a chunk of them.
SENT, COUNTED, CHUNK_TEXTS = 1 << 20, 1 << 21, 1 << 16
#: Texts of a crowded place that meet in one block; pairs that are looked at at once, and of those that are compared bit by bit (8 * WORDS bytes each, three times).
CROWD, CELLS, COMPARED = 4096, 1 << 20, 1 << 16
#: Against rounding, towards more candidates.
SLACK = 1e-6
#: Rows (8 or 16 bytes each), and bytes of shingle sets, that are broadcast at most; more are joined.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
BASE = 0x9E3779B97F4A7C15


def shingle_set(text: bytes, shingle: int, words: WordHashes) -> np.ndarray:
    """The sorted set of the shingles' hashes; a shorter text is one shingle, one without words none."""
    w = words.of(text.lower())
    if len(w) >= shingle:
        h = rolling(w, shingle, BASE)
        h.sort()
        return h[np.concatenate(([True], h[1:] != h[:-1]))]
    return np.array([xxhash.xxh64_intdigest(w.tobytes(), SEED)], np.uint64) if len(w) else np.zeros(0, np.uint64)


def parities(own: np.ndarray) -> np.ndarray:
    """WORDS words of parities: two sets differ in as many shingles as in bits, at least."""
    counts = np.bincount((own & np.uint64(64 * WORDS - 1)).astype(np.intp), minlength=64 * WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def prefix_sizes(n: np.ndarray, similarity: float) -> np.ndarray:
    """A similar set has at least similarity * n shingles of a set of n, so one of the first so many."""
    return np.minimum(n, n - np.ceil(similarity * n - SLACK).astype(np.int64) + 1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def common_shingles(rows: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that LEAST or more of about SAMPLE of the n rows have, and their counts there: the commonest ones, COMMON at most."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sets = [shingle_set(t, shingle, words) for t in column(b, "text")]
            h, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    some = rows.sample(fraction=min(1.0, SAMPLE / max(1, n)), seed=SEED)
    seen = arrow_map(some.select("text"), every, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST)
    table = seen.orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h, c = table["h"].to_numpy().astype(np.int64).view(np.uint64), table["c"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def whole_keys(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[pa.Array]]:
    """The rows of each key, which come sorted by it: the first of the names."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        b = b.select(list(names))
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[begin] != now:
                yield _together(held)
                held = []
            now = keys[begin]
            held.append(b.slice(begin, end - begin))
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> list[pa.Array]:
    return [x.combine_chunks() for x in pa.Table.from_batches(held).columns]


def _joined(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def filed_texts(rows: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray], total: int) -> DataFrame:
    """(row, n, lone, places) for the rows(row, text) that file something: places are the shared shingles of the prefix in order, behind `lone` ones of its own.

    total: about how many shingles there are; it sets the ranges in which they are counted.
    """
    spark = rows.sparkSession
    bits = max(0, min(31, (total // COUNTED).bit_length()))
    shared = spark.sparkContext.broadcast(common)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed hashes by range (x: hashes, y: numbers of texts in the chunk); and a row for each chunk, in a range of its own (x: row ids, y: sizes, z, w: common shingles and texts)."""
        words, (known, _) = WordHashes(), shared.value
        names = ["range", "chunk", "x", "y", "z", "w"]

        def out(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in sets], np.int64)
            h, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes).astype("<u2")
            at = np.searchsorted(known, h) if len(known) else np.zeros(len(h), np.int64)
            at[at == len(known)] = 0
            often = known[at] == h if len(known) else np.zeros(len(h), bool)
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in (-1 - ids[0], ids[0], np.array(ids, "<i8").tobytes(), sizes.astype("<i8").tobytes(), at[often].astype("<u4").tobytes(), text[often].tobytes())), strict=True)))
            h, text = h[~often], text[~often]
            high = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            low = (h >> np.uint64(32 - bits)).astype("<u4")
            order = np.argsort(high, kind="stable")
            high, low, text = high[order], low[order], text[order]
            edges = [0, *(np.flatnonzero(np.diff(high)) + 1).tolist(), len(high)] if len(high) else []
            for begin in range(0, max(0, len(edges) - 1), 256):
                some = list(zip(edges[begin : begin + 256], edges[begin + 1 : begin + 257], strict=False))
                some = some[: len(edges) - 1 - begin]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(high[i]) for i, _ in some], pa.int64()), pa.array([ids[0]] * len(some), pa.int64()), pa.array([low[i:j].tobytes() for i, j in some], pa.binary()), pa.array([text[i:j].tobytes() for i, j in some], pa.binary()), *[pa.array([b""] * len(some), pa.binary())] * 2], names
                )

        ids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for b in batches:
            for row, t in zip(column(b, "row"), column(b, "text"), strict=True):
                own = shingle_set(t, shingle, words)
                if len(own):
                    ids.append(row)
                    sets.append(own)
                    held += len(own)
                if held >= SENT or len(ids) == CHUNK_TEXTS:
                    yield from out(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield from out(ids, sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range, what occurs twice or more, chunk by chunk (x: hashes, y: numbers of texts, z: counts)."""
        names = ["range", "chunk", "x", "y", "z", "w"]
        for group in whole_keys(batches, tuple(names)):
            span, chunk, x, y, z, w = (g.to_pylist() for g in group)
            if span[0] < 0:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (span, chunk)] + [pa.array(v, pa.binary()) for v in (x, y, z, w)], names)
                continue
            h, ends = _joined(x, "<u4"), np.cumsum([len(v) // 4 for v in x]).tolist()
            order = np.argsort(h, kind="stable")
            new = np.concatenate(([True], np.diff(h[order]) != 0)) if len(h) else np.zeros(0, bool)
            run = np.cumsum(new) - 1
            n = np.empty(len(h), np.int64)
            n[order] = np.bincount(run)[run] if len(h) else 0
            for c, begin, end, own, text in zip(chunk, [0, *ends[:-1]], ends, x, y, strict=True):
                twice = n[begin:end] > 1
                if twice.any():
                    values = np.frombuffer(own, "<u4")[twice].tobytes(), np.frombuffer(text, "<u2")[twice].tobytes(), np.minimum(n[begin:end][twice], 1 << 30).astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([span[0]], pa.int64()), pa.array([c], pa.int64()), *(pa.array([v], pa.binary()) for v in (*values, b""))], names)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a chunk with their shared shingles in order, cut to the prefix."""
        counts = shared.value[1]
        for group in whole_keys(batches, ("chunk", "range", "x", "y", "z", "w")):
            _, span, x, y, z, w = (g.to_pylist() for g in group)
            own = next(k for k, s in enumerate(span) if s < 0)
            rest = [k for k in range(len(span)) if k != own]
            ids, n = np.frombuffer(x[own], "<i8"), np.frombuffer(y[own], "<i8")
            often = np.frombuffer(z[own], "<u4").astype(np.int64)
            high = np.repeat(np.array([span[k] for k in rest], np.int64), [len(x[k]) // 4 for k in rest])
            place = np.concatenate(((high << 32) | _joined([x[k] for k in rest], "<u4").astype(np.int64), -1 - often))
            level = np.concatenate((_joined([z[k] for k in rest], "<u4").astype(np.int64), (1 << 40) + counts[often]))
            text = np.concatenate((_joined([y[k] for k in rest], "<u2"), np.frombuffer(w[own], "<u2"))).astype(np.int64)
            order = np.lexsort((place, level, text))
            place, text = place[order], text[order]
            seen = np.bincount(text, minlength=len(ids))
            lone = n - seen
            need = prefix_sizes(n, similarity) - lone
            start = np.cumsum(seen) - seen
            keep = np.arange(len(text)) - start[text] < need[text]
            place, text = place[keep], text[keep]
            sizes = np.bincount(text, minlength=len(ids))
            some = np.flatnonzero(sizes)
            if len(some):
                offsets = np.concatenate(([0], np.cumsum(sizes[some]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(lone[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place))], ["row", "n", "lone", "places"])

    packed = "range bigint, chunk bigint, x binary, y binary, z binary, w binary"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = arrow_map(rows.select("row", "text"), send, packed)
    counted = arrow_map(sent.repartition(partitions, "range").sortWithinPartitions("range"), count, packed)
    return store(arrow_map(counted.repartition(partitions, "chunk").sortWithinPartitions("chunk"), file, "row bigint, n bigint, lone bigint, places array<bigint>"), "similar-filed")


def _close(a: str, b: str, similarity: float) -> Column:
    """Whether sets can be similar, of their sizes n, lone shingles and the rank of a shingle that both file."""
    f = lambda name, of: F.col(f"{of}.{name}")
    left = lambda of: f("n", of) - f("lone", of) - f("rank", of)
    most = F.least(f("rank", a), f("rank", b)) + F.least(left(a), left(b))
    both = f("n", a) + f("n", b)
    return (most * (1 + similarity) + SLACK >= similarity * both) & (F.least(f("n", a), f("n", b)) + SLACK >= similarity * F.greatest(f("n", a), f("n", b)))


def close_pairs(place: np.ndarray, row: np.ndarray, size: np.ndarray, label: np.ndarray, block: np.ndarray, blocks: np.ndarray, wide: np.ndarray, words: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a block's texts, by their numbers there, that can be similar, and the bits in which they differ: some at a time, so memory grows with the texts only."""
    folded = np.bitwise_xor.reduce(words.reshape(len(row), -1, FOLDED), axis=1)
    step = max(1, CELLS // len(row))
    for i in range(0, len(row), step):
        some = slice(i, i + step)
        x, y = np.nonzero((label[some, None] != label[None, i:]) & (place[some, None] == place[None, i:]))
        x, y = x + i, y + i
        here = (x < y) & (~(wide[x] & wide[y]) | ((row[x] + row[y]) % blocks[x] == block[x]))
        x, y = x[here], y[here]
        for at in range(0, len(x), COMPARED):
            p, q = x[at : at + COMPARED], y[at : at + COMPARED]
            for own in (folded, words):
                most = (size[p] + size[q]) * (1 - similarity) / (1 + similarity) + SLACK
                off = np.bitwise_count(own[p] ^ own[q]).sum(1, dtype=np.int64)
                good = (off <= most) & (np.minimum(size[p], size[q]) + SLACK >= similarity * np.maximum(size[p], size[q]))
                p, q, off = p[good], q[good], off[good]
            yield p, q, off


def closest(row: np.ndarray, wide: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each wide text its closest one in close_pairs(), the smaller row of equally close ones."""
    least, best = np.full(len(row), 1 << 62), np.full(len(row), -1)
    for p, q, off in pairs:
        owner, other, off = np.concatenate((p, q)), np.concatenate((q, p)), np.concatenate((off, off))
        mine = wide[owner]
        owner, other, off = owner[mine], other[mine], off[mine]
        order = np.lexsort((row[other], off, owner))
        first = order[np.flatnonzero(np.append(True, np.diff(owner[order]) != 0))] if len(order) else order
        owner, other, off = owner[first], other[first], off[first]
        better = (off < least[owner]) | ((off == least[owner]) & (row[other] < row[best[owner]]))
        least[owner[better]], best[owner[better]] = off[better], other[better]
    owner = np.flatnonzero(best >= 0)
    yield owner, best[owner]


def groups(df: DataFrame, row_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, group) for the rows that are similar to another one: group is the smallest row of their group.

    row_col must tell rows apart and keep its values when df is read again. Texts without words are in no group. Null texts count as empty.
    Shingles are told apart by 64-bit hashes, equal sets by 128-bit ones. Groups are exact, whatever the partitioning.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_col).cast("bigint").alias("row"), bytes_of(F.col(text_col)).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            ids, found, sizes = [], [], []
            for row, text in zip(column(b, "row"), column(b, "text"), strict=True):
                own = shingle_set(text, shingle, words)
                if len(own):
                    ids.append(row)
                    found.append(xxhash.xxh128_digest(own.tobytes()))
                    sizes.append(len(own))
            d = _joined(found, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64())], ["row", "d0", "d1", "n"])

    sizes = store(arrow_map(rows, digests, "row bigint, d0 bigint, d1 bigint, n bigint"), "similar-sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    same = sizes.groupBy("d0", "d1").agg(F.min("row").alias("first"), F.count("*").alias("k")).where("k > 1")
    same = store(sizes.join(same, ["d0", "d1"]).where("row != first").select(F.col("row").alias("a"), F.col("first").alias("b")), "similar-same")
    copies = same.select(F.col("a").alias("row"))
    own = rows.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "row", "left_anti")

    filed = filed_texts(own, shingle, similarity, common_shingles(own, n, shingle), total)
    spots = filed.select("row", "n", "lone", F.posexplode("places").alias("rank", "place"))
    spot = F.struct("row", "n", "lone", F.col("rank").cast("bigint").alias("rank")).alias("a")

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle, words).tobytes() for t in column(b, "text")], pa.binary())], ["b", "other"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            good, last, own = [], None, None
            for row, text, other in zip(column(b, "a"), column(b, "text"), column(b, "other"), strict=True):
                if row != last:
                    last, own = row, shingle_set(text, shingle, words)
                good.append(jaccard(own, np.frombuffer(other, np.uint64)) >= similarity)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the stored pairs(a, b) that are similar. Sets of b are made once each; texts of a move only where the pairs are too many to broadcast."""
        count, kinds = pairs.agg(F.count("*"), F.count_distinct("b")).first()
        few = lambda x, yes: F.broadcast(x) if yes else x
        asked = pairs.select("b").distinct()
        sets = store(arrow_map(rows.withColumnRenamed("row", "b").join(few(asked, kinds <= BROADCAST_ROWS), "b", "left_semi"), make_sets, "b bigint, other binary"), "similar-sets")
        size = sets.agg(F.coalesce(F.sum(F.octet_length("other") + 64), F.lit(0))).first()[0]
        texts = rows.withColumnRenamed("row", "a").join(few(pairs, count <= BROADCAST_ROWS), "a")
        links = store(arrow_map(texts.join(few(sets, size <= BROADCAST_BYTES), "b").select("a", "b", "text", "other"), decide, "a bigint, b bigint"), "similar-links")
        discard(sets)
        return links

    def apart_by(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that the links so far do not connect."""
        label = lambda name: labels.select(F.col("row").alias(name), F.col("label").alias(f"{name}_label"))
        named = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
        return named.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select(*pairs.columns)

    def joined(pairs: DataFrame, links: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """links and labels(row, label) after deciding pairs(a, b, shared) that the labels before leave apart: each row's likeliest first, then those still apart."""
        pairs = store(apart_by(pairs, before), "similar-apart")
        best = store(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")), "similar-best")
        links = links.unionByName(similar(best))
        labels = labelled(links)
        rest = store(apart_by(pairs.join(best, ["a", "b"], "left_anti"), labels).select("a", "b"), "similar-rest")
        discard(best, before, pairs)
        if not rest.isEmpty():
            links = links.unionByName(similar(rest))
            discard(labels)
            labels = labelled(links)
        discard(rest)
        return links, labels

    def labelled(links: DataFrame) -> DataFrame:
        return store(components(links).select(F.col("node").alias("row"), F.col("root").alias("label")), "similar-labels")

    # Texts that the fingerprints join are decided first; what the sets do not confirm, and what fingerprints miss, is left to the places.
    marked = near_duplicates(own.where(F.col("text").cast("string").rlike(NOT_GAP)), "row", "text", shingle)
    near = store(marked.where("id != component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b")), "similar-near")
    links = similar(near)
    labels = labelled(links)
    firsts = spots.groupBy("place").agg(F.min(spot).alias("b"), F.count("*").alias("k")).where("k > 1").select("place", "b")
    met = spots.select("place", spot).join(firsts, "place").where(F.col("a.row") != F.col("b.row")).where(_close("a", "b", similarity))
    star = store(met.select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared")), "similar-star")
    links, labels = joined(star, links, labels)

    # Places that still hold several groups: the largest is dealt to blocks, and the others' texts go to each block.
    member = lambda: spots.select("place", "row", "n").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))

    def crowds() -> DataFrame:
        """(place, most, blocks) of places of three texts or more and several labels: the label of most texts."""
        by_label = member().groupBy("place", "label").agg(F.count("*").alias("k"))
        mixed = by_label.groupBy("place").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("labels")).where("labels > 1 AND k > 2")
        return store(mixed.select("place", "most", (F.floor(F.col("k") / CROWD) + 1).cast("int").alias("blocks")), "similar-mixed")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            marks = [parities(shingle_set(t, shingle, words)).tobytes() for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.binary())], ["row", "mark"])

    def meet(best_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Pairs of rows of different labels at a place that can be similar; rows that are in all blocks meet in one. best_only: of each such row the closest other one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in whole_keys(batches, ("key", "place", "row", "n", "label", "block", "blocks", "wide", "mark")):
                _, place, row, size, label, block, blocks, wide = (g.to_numpy(zero_copy_only=False) for g in group[:-1])
                words = _joined(group[-1].to_pylist(), "<u8").reshape(-1, WORDS)
                found = close_pairs(place, row, size, label, block, blocks, wide, words, similarity)
                for p, q in closest(row, wide, found) if best_only else ((p, q) for p, q, _ in found):
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(row[p], row[q])), pa.array(np.minimum(row[p], row[q]))], ["a", "b"])

        return run

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for best_only in (True, False):  # most rows are linked by their closest one; what is left then is compared in full
        mixed = crowds()
        if mixed.isEmpty():
            discard(mixed)
            break
        apart = store(member().join(mixed, "place"), "similar-apart")
        asked = store(apart.select("row").distinct(), "similar-asked")
        marks = arrow_map(rows.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "row", "left_semi"), mark, "row bigint, mark binary")
        block = F.when(F.col("label") == F.col("most"), F.array(F.pmod(F.xxhash64("row"), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        wide = (F.col("label") != F.col("most")).alias("wide")
        dealt = apart.join(marks, "row").select("place", F.explode(block).alias("block"), "blocks", wide, "row", "n", "label", "mark")
        dealt = dealt.withColumn("key", F.xxhash64("place", "block"))
        pairs = arrow_map(dealt.repartition(partitions, "key").sortWithinPartitions("key", "place"), meet(best_only), "a bigint, b bigint")
        pairs = store(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")), "similar-pairs")
        links, labels = joined(pairs, links, labels)
        discard(mixed, apart, asked, pairs)
    every = store(links.unionByName(same), "similar-all")
    discard(sizes, filed, near, star, labels, same)
    return components(every).select(F.col("node").alias("row"), F.col("root").alias("group"))


def one_of_each(df: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without the rows that are similar to an earlier one of their group; the first row of each group stays.

    df must give the same rows in the same order when it is read again, as stored tables do. All columns are kept; rows
    without words stay. Links are between texts of at least the similarity; a group is what they connect.
    """
    numbered = df.select(F.struct(*df.columns).alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    gone = store(groups(numbered, "row", "text", shingle, similarity).where("row != group").select("row"), "similar-gone")
    return numbered.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "row", "left_anti").select("doc.*")
