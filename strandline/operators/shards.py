"""Shards of a channel's history: windows of equal time, or of equal estimated messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import from_ms, to_ms

HOUR_MS = 3_600_000
#: A window ends this long after now; below SHORT_MS a history is one shard.
AHEAD_MS, SHORT_MS = 60_000, 7 * 24 * 3600 * 1000
PROBES_PER_SHARD, LEAST_PROBES, MOST_PROBES, MOST_SHARDS, PROBE_SPAN_MS = 3, 4, 36, 12, 24 * 3600 * 1000


def equal_shards(channels: DataFrame, now_ms: int, shards: Column | int, channel: str = "channel") -> DataFrame:
    """channels' columns with (shard, after, before) for each shard; `channel` is the channel's id as a number."""
    count = shards if isinstance(shards, Column) else F.lit(shards)
    df = channels.withColumns({"_start": to_ms(F.col(channel)), "_p": count})
    df = df.withColumn("_span", F.lit(now_ms) - F.col("_start"))
    df = df.withColumn("_n", F.when(F.col("_span") < SHORT_MS, F.lit(1)).otherwise(F.col("_p")).cast("int")).withColumn("_step", F.floor(F.col("_span") / F.col("_n")))
    df = df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    after = F.when(F.col("_span") < SHORT_MS, F.col(channel)).otherwise(from_ms(F.col("_start") + F.col("shard") * F.col("_step")))
    last = F.col("shard") == F.col("_n") - 1
    before = F.when(last, from_ms(F.lit(now_ms + AHEAD_MS))).otherwise(from_ms(F.col("_start") + (F.col("shard") + 1) * F.col("_step")))
    return df.withColumns({"after": after, "before": before}).drop("_start", "_p", "_span", "_n", "_step")


def probe_count(parallelism: Column, override: Column) -> Column:
    derived = F.least(F.greatest(F.lit(LEAST_PROBES), parallelism * PROBES_PER_SHARD), F.lit(MOST_PROBES))
    asked = F.greatest(F.lit(1), F.least(F.floor(override + 0.5), F.lit(MOST_PROBES)))
    return F.when(override > 0, asked).otherwise(derived).cast("int")


def probe_times(channels: DataFrame, now_ms: int, probes: int, channel: str = "channel") -> DataFrame:
    """channels with a row per probe (k from 1, t); none for a history under a day."""
    df = channels.withColumn("_start", to_ms(F.col(channel))).withColumn("_span", F.lit(now_ms) - F.col("_start")).where(F.col("_span") >= PROBE_SPAN_MS)
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(probes))))
    return df.withColumn("t", (F.col("_start") + F.floor(F.col("_span") * F.col("k") / (probes + 1))).cast("bigint")).drop("_start", "_span")


def local_rates(times: DataFrame, messages: DataFrame, channel: str = "channel", page: int = 100) -> DataFrame:
    """(channel, k, t, rate, samples): the newest `page` messages before each probe time, over the time back to the oldest of them.

    messages(channel, ms). Messages are counted by hour, and the counts say from which hour on a probe's page can begin; only
    messages from there to the probe are looked at. No task sorts a channel's messages, only its hours and probes.
    """
    hour = lambda c: F.floor(F.col(c) / HOUR_MS).cast("bigint")
    counts = messages.groupBy(channel, hour("ms").alias("h")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(channel).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hours = counts.select(channel, "h", upto.alias("upto"))
    none = lambda kind: F.lit(None).cast(kind)
    # All messages of the hours before the probe's: then the hour that holds the first of the last `page` of them.
    both = hours.select(channel, "h", "upto", none("int").alias("k"), none("bigint").alias("t")).unionByName(times.select(channel, hour("t").alias("h"), none("bigint").alias("upto"), "k", "t"))
    earlier = Window.partitionBy(channel).orderBy("h", F.col("k").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    probes = both.withColumn("want", F.coalesce(F.max("upto").over(earlier), F.lit(0)) - page).where("k IS NOT NULL")
    both = hours.select(channel, F.col("upto").alias("at"), "h", none("int").alias("k"), none("bigint").alias("t")).unionByName(probes.select(channel, F.col("want").alias("at"), none("bigint").alias("h"), "k", "t"))
    later = Window.partitionBy(channel).orderBy("at", F.col("k").isNotNull().cast("int")).rowsBetween(1, Window.unboundedFollowing)
    probes = both.withColumn("from_h", F.first("h", ignorenulls=True).over(later)).where("k IS NOT NULL").select(channel, "k", "t", "from_h")
    windows = probes.groupBy(channel).agg(F.collect_list(F.struct("k", "t", "from_h")).alias("_w"))  # MOST_PROBES at most
    hit = F.filter("_w", lambda w: (F.col("ms") < w.t) & (F.col("_h") >= w.from_h))
    near = messages.select(channel, "ms", hour("ms").alias("_h")).join(windows, channel).select(channel, "ms", F.explode(hit).alias("w")).select(channel, "ms", "w.k")
    newest = near.withColumn("n", F.row_number().over(Window.partitionBy(channel, "k").orderBy(F.desc("ms")))).where(F.col("n") <= page)
    pages = newest.groupBy(channel, "k").agg(F.count("*").alias("samples"), F.min("ms").alias("oldest"))
    out = times.select(channel, "k", "t").join(pages, [channel, "k"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    width = F.when(F.col("t") > F.col("oldest"), F.col("t") - F.col("oldest")).otherwise(1000)
    return out.select(channel, "k", "t", F.when(F.col("samples") == 0, F.lit(0.0)).otherwise(F.col("samples") / F.greatest(F.lit(1), width)).alias("rate"), "samples")


def density_curve(probes: DataFrame, now_ms: int, by: str = "channel") -> DataFrame:
    """(by, t, next_t, rate): a piecewise constant rate from the channel's start to its end, by probes(by, t, rate, seq).

    Probes outside the history, without a finite rate or below zero are left out; of equal times the first counts.
    """
    start, end = to_ms(F.col(by)), F.lit(now_ms + AHEAD_MS).cast("bigint")
    good = probes.where((F.col("t") > start) & (F.col("t") < end) & (F.col("rate") >= 0) & ~F.isnan("rate") & (F.col("rate") < float("inf")))
    first = Window.partitionBy(by, "t").orderBy("seq")
    good = good.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    ordered = Window.partitionBy(by).orderBy("t")
    good = good.select(by, "t", "rate", F.row_number().over(ordered).alias("_k"), F.count("*").over(Window.partitionBy(by)).alias("usable")).where("usable >= 2")
    points = good.select(by, "t", "rate").unionByName(good.where("_k = 1").select(by, start.alias("t"), "rate"))
    return points.select(by, "t", F.coalesce(F.lead("t").over(ordered), end).alias("next_t"), "rate")


def mass_between(curve: DataFrame, low: Column, high: Column, *by: str) -> DataFrame:
    overlap = F.least(high, F.col("next_t")) - F.greatest(low, F.col("t"))
    return curve.groupBy(*by).agg(F.sum(F.when(overlap > 0, F.col("rate") * overlap).otherwise(0.0)).alias("mass"))


def density_shards(channels: DataFrame, probes: DataFrame, now_ms: int, shards: int, by: str = "channel") -> DataFrame:
    """(by, strategy, shard, after, before): windows of equal estimated mass; of equal time where the probes give no valid cut.

    A cut lies where the running mass first reaches each equal share, by linear interpolation, rounded to milliseconds.
    """
    p = max(1, min(shards, MOST_SHARDS))
    end = now_ms + AHEAD_MS
    curve = density_curve(probes, now_ms, by).withColumn("m", F.col("rate") * (F.col("next_t") - F.col("t"))).where("m > 0")
    so_far = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = curve.withColumns({"cum": F.sum("m").over(so_far), "total": F.sum("m").over(Window.partitionBy(by))})
    if p > 1:
        curve = curve.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(p - 1)))).withColumn("share", F.col("total") / p * F.col("k")).where("cum >= share")
        hit = curve.groupBy(by, "k").agg(F.min_by(F.struct("t", "next_t", "m", "cum", "share"), "t").alias("x")).select(by, "k", "x.*")
        part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("share") - (F.col("cum") - F.col("m"))) / F.col("m"))
        cuts = hit.select(by, "k", F.floor(F.col("t") + part * (F.col("next_t") - F.col("t")) + 0.5).cast("bigint").alias("cut"))
        cuts = cuts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "cut"))).alias("cuts")).select(by, F.expr("transform(cuts, x -> x.cut)").alias("cuts"))
    else:
        cuts = channels.select(by).limit(0).withColumn("cuts", F.array().cast("array<bigint>"))
    bounds = F.concat(F.array(to_ms(F.col(by))), "cuts", F.array(F.lit(end).cast("bigint")))
    found = channels.select(by).join(cuts, by, "left").withColumn("bounds", bounds)
    rising = F.forall(F.sequence(F.lit(1), F.size("bounds") - 1), lambda i: F.col("bounds")[i] > F.col("bounds")[i - 1])
    found = found.withColumn("ok", F.coalesce((F.size("bounds") == p + 1) & rising, F.lit(False)))
    dense = found.where("ok").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    dense = dense.select(by, F.lit("density").alias("strategy"), "shard", F.when(F.col("shard") == 0, F.col(by)).otherwise(from_ms(F.col("bounds")[F.col("shard")])).alias("after"), from_ms(F.col("bounds")[F.col("shard") + 1]).alias("before"))
    rest = found.where("NOT ok").select(by)
    if p == 1:
        even = rest.select(by, F.lit("equal-time").alias("strategy"), F.lit(0).alias("shard"), F.col(by).alias("after"), from_ms(F.lit(end)).alias("before"))
    else:
        even = equal_shards(rest, now_ms, p, by).select(by, F.lit("equal-time").alias("strategy"), "shard", "after", "before")
    return dense.unionByName(even)


def assign(messages: DataFrame, shards: DataFrame, by: str = "channel", num: str = "id_num") -> DataFrame:
    """messages with their `shard`: the one window [after, before) of their channel that holds them; messages in none are dropped.

    A channel has at most MOST_SHARDS windows, so the windows travel as one array per channel.
    """
    bounds = shards.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("after", "before", "shard"))).alias("_w"))
    hit = F.filter("_w", lambda w: (F.col(num) >= w.after) & (F.col(num) < w.before))
    return messages.join(bounds, by).withColumn("_hit", F.element_at(F.when(F.size(hit) > 0, hit), 1)).where("_hit IS NOT NULL").withColumn("shard", F.col("_hit.shard")).drop("_w", "_hit")


def contiguity(shards: DataFrame, by: str = "channel") -> DataFrame:
    """(by, shards, gaps, overlaps): how many shards don't begin where the one before ends."""
    prev = F.lag("before").over(Window.partitionBy(by).orderBy("shard"))
    return shards.withColumn("_prev", prev).groupBy(by).agg(F.count("*").alias("shards"), F.count_if(F.col("after") > F.col("_prev")).alias("gaps"), F.count_if(F.col("after") < F.col("_prev")).alias("overlaps"))


def imbalance(loads: Column) -> Column:
    """Aggregate: (max - min) / mean of loads; null for a mean of zero."""
    return F.when(F.avg(loads) > 0, (F.max(loads) - F.min(loads)) / F.avg(loads))
