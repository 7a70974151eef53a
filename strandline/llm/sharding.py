"""Sharding by k-d tree over row metadata, weighted by bytes; SQL functions only.

Every row is a point: its size, its place among ids, and the places that hashing gives its source and language. A node's
rows are split along its widest dimension (largest range as a share of that dimension's whole range) at the weighted median,
or at m/n of the weight where n leaves are to come of it. A point's place along a dimension is one 62-bit number: the
value in the upper 31 bits and a hash of the row below, so that a source with a third of all rows, or equal rows, can be
cut anywhere. Medians are found by counting: bytes are added up per node and bin of the node's own range, the bin that holds the
median is counted again more finely, until its bytes no longer matter or it holds one row or is one place. All nodes of a level are split at once:
each level's nodes are a table (what they weigh, where they are cut) that the rows are joined with, so neither plans nor the driver grow
with the leaves. A count has BINS rows per node at most, whatever the input, and no rows are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, has, store

#: Bins of one count of a node, and of a level's few nodes together.
BINS, BINS_OF_LEVEL = 2048, 1 << 17
#: Nodes whose table (some 100 bytes each) is broadcast at most; more are joined.
BROADCAST_NODES = 200_000
#: A split may miss its weight by this share of the target bytes of a leaf.
TOLERANCE = 2e-4
#: Width of a place along a dimension, and of its value.
PLACE_BITS, VALUE_BITS = 62, 31


def leaves_for(total: int, target_bytes: int) -> int:
    """So many leaves that each stays within the target bytes."""
    return max(1, -(-total // max(1, target_bytes)))


def _scaled(value: Column, low: float, high: float) -> Column:
    """value between low and high as VALUE_BITS bits, in order; null as the least."""
    span = max(1.0, float(high) - float(low))
    return F.coalesce(F.floor((value.cast("double") - F.lit(float(low))) / F.lit(span) * ((1 << VALUE_BITS) - 1)), F.lit(0)).cast("bigint")


def _hashed(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), 64 - VALUE_BITS)


def _few(nodes: DataFrame, count: int) -> DataFrame:
    return F.broadcast(nodes) if count <= BROADCAST_NODES else nodes


def _cuts(rows: DataFrame, state: DataFrame, count: int, allowed: float) -> DataFrame:
    """(node, axis, half, cut) for each node of state(node, half, axis, low, high, below, want): rows(node, place, weight) from `cut` on go right.

    low to high is where the cut lies, below the weight before it.
    """
    steps, bins = [], max(BINS, BINS_OF_LEVEL // count)
    while True:
        here = rows.join(_few(state, count), "node").where("place BETWEEN low AND high")
        here = here.withColumns({"step": F.expr(f"(high - low) div {bins} + 1")}).withColumn("bin", F.expr("(place - low) div step"))
        counts = here.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.count("*").alias("rows"), *[F.any_value(c).alias(c) for c in ("half", "axis", "low", "high", "below", "want", "step")])
        so_far = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("upto", F.col("below") + so_far).where("upto >= want")
        hit = counts.groupBy("node").agg(F.min(F.struct("bin", "w", "rows", "upto", "half", "axis", "low", "high", "want", "step")).alias("x")).select("node", "x.*")
        start = F.col("low") + F.col("bin") * F.col("step")
        end = F.least(F.col("high"), start + F.col("step") - 1)
        cut = F.when(F.col("upto") - F.col("want") <= F.col("want") - (F.col("upto") - F.col("w")), end + 1).otherwise(start)
        done = (F.col("step") == 1) | (F.col("rows") == 1) | (F.col("w") <= allowed)
        hit = store(hit.select("node", "half", "axis", start.alias("low"), end.alias("high"), (F.col("upto") - F.col("w")).alias("below"), "want", F.when(done, cut).alias("cut")), "sharding-state")
        steps.append(hit)
        state = hit.where("cut IS NULL").drop("cut")
        if state.isEmpty():
            found = store(reduce(DataFrame.unionByName, [h.where("cut IS NOT NULL").select("node", "axis", "half", "cut") for h in steps]), "sharding-cuts")
            discard(*steps)
            return found


def with_leaves(points: DataFrame, weight: str, dims: list[str], leaves: int) -> DataFrame:
    """points with `leaf`, from 0 to leaves-1: near-equal sums of weight. points' rows should be stored: they are scanned again and again."""
    whole = points.agg(F.sum(weight).alias("w"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]).first()
    if whole.w is None:
        return points.withColumn("leaf", F.lit(0))
    allowed = TOLERANCE * float(whole.w) / leaves
    range_of = {d: float(max(1, whole[f"high_{d}"] - whole[f"low_{d}"])) for d in dims}
    # A node's number is its first leaf; n leaves are to come of it.
    at, most = points.withColumns({"node": F.lit(0).cast("bigint"), "n": F.lit(leaves).cast("bigint")}), leaves
    count, own = 1, None
    while most > 1:
        lows, highs = (F.array(*[f(d) for d in dims]) for f in (F.min, F.max))
        nodes = at.where("n > 1").groupBy("node", "n").agg(F.sum(weight).alias("w"), lows.alias("lows"), highs.alias("highs"))
        wide = F.array(*[(F.col("highs")[k] - F.col("lows")[k]) / F.lit(range_of[d]) for k, d in enumerate(dims)])
        nodes = nodes.withColumn("axis", F.array_position(wide, F.array_max(wide)).cast("int")).withColumn("half", F.expr("n div 2"))
        state = store(nodes.select("node", "half", "axis", F.element_at("lows", F.col("axis")).alias("low"), F.element_at("highs", F.col("axis")).alias("high"), F.lit(0).cast("bigint").alias("below"), (F.col("w") * F.col("half") / F.col("n")).cast("double").alias("want")), "sharding-nodes")
        axes = _few(state.select("node", "axis"), count)
        place = F.element_at(F.array(*dims), F.col("axis"))
        cuts = _cuts(at.where("n > 1").join(axes, "node").select("node", F.col(weight).alias("weight"), place.alias("place")), state, count, allowed)
        right = F.coalesce(place >= F.col("cut"), F.lit(False))
        moved = at.join(_few(cuts, count), "node", "left").withColumns({"node": F.when(right, F.col("node") + F.col("half")).otherwise(F.col("node")), "n": F.when(F.col("cut").isNull(), F.col("n")).when(right, F.col("n") - F.col("half")).otherwise(F.col("half"))})
        before, own = own, store(moved.select(*points.columns, "node", "n"), "sharding-level")
        at, most, count = own, most - most // 2, 2 * count
        discard(state, cuts, *([before] if before is not None else []))
    return at.withColumn("leaf", F.col("node").cast("int")).drop("node", "n")


def shard(df: DataFrame, shards: int = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of df; with target_bytes, as many shards as keep each within it.

    A row's size is its text's bytes plus 1, so null and empty texts weigh 1. Equal rows are told apart by their position and may
    part. A null id, source or language counts as the least value or the empty string; missing columns as nulls. slot
    numbers a shard's rows from 0 without gaps. An empty table gives no rows. Other columns are not read.
    """
    col = lambda name: F.col(name) if has(df, name) else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"), _hashed(col(source_col)).alias("source"), _hashed(col(lang_col)).alias("lang"))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "sharding-rows")
    numeric = F.expr("try_cast(id as double)")
    edge = rows.agg(F.min(numeric).alias("a"), F.max(numeric).alias("b"), F.max("size").alias("s"), F.sum("size").alias("w")).first()
    tie = F.shiftrightunsigned(F.xxhash64("row"), 64 - (PLACE_BITS - VALUE_BITS))
    at = lambda value: F.shiftleft(value, PLACE_BITS - VALUE_BITS).bitwiseOR(tie)
    points = rows.select("id", "size", "text_crc32", "row", at(_scaled(numeric, edge.a or 0, edge.b or 0)).alias("by_id"), at(_scaled(F.col("size"), 1, edge.s or 1)).alias("by_size"), at(F.col("source")).alias("by_source"), at(F.col("lang")).alias("by_lang"))
    points = store(points, "sharding-points")
    n = leaves_for(edge.w or 0, target_bytes) if target_bytes else shards
    dealt = with_leaves(points, "size", ["by_id", "by_source", "by_lang", "by_size"], n).select("id", "size", "text_crc32", "row", F.col("leaf").alias("shard"))
    # Rows are numbered within stored partition and shard; a partition's numbers start where the ones before it end.
    part = F.shiftright("row", 33)
    dealt = store(dealt.withColumn("part", part), "sharding-dealt")
    discard(rows, points)
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = starts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "part", F.coalesce("start", F.lit(0)).alias("start"))
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")))
    return numbered.join(starts, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))
