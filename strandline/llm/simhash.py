"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes one bit per hash bit: set where more than half of the shingles' XXH64 hashes have it set.
Equal fingerprints are grouped first, so copies cost one row. Distinct fingerprints within MAX_DISTANCE bits are linked
by two 32-bit segments: of at most three differing bits one segment has at most one, so each fingerprint looks up the
33 values of the radius-1 Hamming ball around each of its segments, and matches are verified over all 64 bits.

A segment value that more than HEAVY fingerprints share is not expanded into pairs. There, fingerprints meet at whole
64-bit points between them: the indexed side emits the ball of radius 1 over the other segment, the probing side the
ball that is left of the distance. Each point links its members to one representative, which joins the same components
with rows in proportion to the fingerprints. No bucket is capped.

Components are found by alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, column, discard, store

MAX_DISTANCE = 3
#: Fingerprints that may share a segment value and still be paired one by one.
HEAVY = 128
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint as a signed integer; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts], np.uint64)
    ones, at = np.zeros(64, np.int64), 0
    while at < len(h):  # long texts in pieces, for memory
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += 65536
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp bigint) for each row of df; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), bytes_of(F.col(text_col)).alias("text")), run, f"id {kind}, fp bigint")


def _ball(radius: int) -> list[tuple[int, int]]:
    """(mask over 32 bits, bits set) within the radius."""
    return [(sum(1 << i for i in c), r) for r in range(radius + 1) for c in combinations(range(32), r)]


def _masks(radius: int, least: int = 0) -> Column:
    return F.array(*[F.lit(m) for m, r in _ball(radius) if r >= least]).cast("array<bigint>")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def _key(k: int, value: Column) -> Column:
    """A segment and its value in one long; the segment's number is bit 32."""
    return value.bitwiseOR(F.lit(k << 32).cast("bigint"))


def _around(k: int) -> Column:
    """The keys of the radius-1 ball around segment k."""
    return F.transform(_masks(1), lambda m: _key(k, _segment(F.col("fp"), k).bitwiseXOR(m)))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs, or links to a representative, that join the distinct fingerprints of fps(fp) exactly as all pairs within MAX_DISTANCE do."""
    index = fps.select("fp", F.explode(F.array(*[_key(k, _segment(F.col("fp"), k)) for k in (0, 1)])).alias("key"))
    heavy = store(index.groupBy("key").count().where(F.col("count") > HEAVY).select("key"), "simhash-heavy")
    probe = fps.select("fp", F.explode(F.concat(*[_around(k) for k in (0, 1)])).alias("key"))
    any_heavy = not heavy.isEmpty()
    light = index.join(heavy, "key", "left_anti") if any_heavy else index
    pairs = (
        probe.withColumnRenamed("fp", "a")
        .join(light.withColumnRenamed("fp", "b"), "key")
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE))
        .select("a", "b")
    )
    if any_heavy:
        pairs = pairs.unionByName(_heavy_links(index, probe, heavy))
    return store(pairs.distinct(), "simhash-links")


def _heavy_links(index: DataFrame, probe: DataFrame, heavy: DataFrame) -> DataFrame:
    """Links through the points between fingerprints, for segment values in heavy(key)."""

    def points(df: DataFrame, masks: Column) -> DataFrame:
        """The points with the key's segment and the fingerprint's other one, changed by each mask."""
        of_1 = F.col("key") >= (1 << 32)
        value = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        low = F.when(of_1, _segment(F.col("fp"), 0)).otherwise(value)
        high = F.when(of_1, value).otherwise(_segment(F.col("fp"), 1))
        df = df.select("key", "fp", low.alias("low"), high.alias("high"), of_1.alias("of_1"), F.explode(masks).alias("m"))
        low = F.when(F.col("of_1"), F.col("low").bitwiseXOR(F.col("m"))).otherwise(F.col("low"))
        high = F.when(F.col("of_1"), F.col("high")).otherwise(F.col("high").bitwiseXOR(F.col("m")))
        return df.select("key", "fp", F.shiftleft(high, 32).bitwiseOR(low).alias("point"))

    seg = F.when(F.col("key") >= (1 << 32), _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    value = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    here = probe.join(heavy, "key", "left_semi").withColumn("off", F.bit_count(seg.bitwiseXOR(value)))
    first = store(points(index.join(heavy, "key", "left_semi"), _masks(1)).groupBy("key", "point").agg(F.min("fp").alias("b")), "simhash-points")
    near = points(here.where("off = 0"), _masks(2)).unionByName(points(here.where("off = 1"), _masks(1)))
    return near.join(first, ["key", "point"]).where(F.col("fp") != F.col("b")).select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of edges(a, b), the smallest node that it reaches."""
    edges = store(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    while True:
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = store(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = store(small, "cc-small")
        discard(large, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of df.

    Null texts count as empty; texts without words share fingerprint zero. Repeated rows give a row each. component_id is
    the smallest id reachable, itself included; rows with a null id belong to components but never name them (null where
    no row of the component has an id). Extra columns are not read.
    """
    marked = store(with_fingerprints(df, id_col, text_col, shingle), "simhash-docs")
    fps = store(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-fps")
    near = links(fps.select("fp"))
    comps = store(components(near), "simhash-comps")
    linked = comps.join(fps, comps.node == fps.fp)
    named = store(linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id"), "simhash-named")
    names = store(fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-names")
    discard(near, fps, comps, named)
    return marked.join(names, "fp").select("id", "fp", "component_id")
