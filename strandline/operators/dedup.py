"""Duplicates within a run and against the archive, and the dealing of new rows to parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: estimated bytes of one indexed id.
BYTES_PER_ID = 56
#: Ids of one hour.
HOUR = 3_600_000 << 22


def first_of_each(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by seq. A key's rows meet after each task has kept its own first, so hot keys cost a row per task."""
    least = rows.groupBy(*keys).agg(F.min(F.struct(F.col(seq).alias("_seq"), *[F.col(c) for c in rows.columns if c not in keys])).alias("_r"))
    return least.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def guard_ids(archive: DataFrame, mode: str = "exact", parts: int = 3, max_ids: int | None = None, channel: str = "channel_id") -> DataFrame:
    """(channel, id) that new rows are held against: all archived ids, those of the newest parts, or at most the newest max_ids of either; none if parts is 0."""
    if parts <= 0:
        return archive.select(channel, "id").limit(0)
    rows = archive
    if mode == "windowed":
        newest = archive.select(channel, "part").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(channel).orderBy(F.desc("part")))).where(F.col("_k") <= parts).drop("_k")
        rows = archive.join(newest, [channel, "part"], "left_semi")
    if max_ids is not None:
        # A part's rows are numbered without gaps, so counts of parts say where each row stands; no rows are sorted.
        sizes = rows.groupBy(channel, "part").agg(F.count("*").alias("_c"), F.max("row_seq").alias("_last"))
        newer = Window.partitionBy(channel).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(channel, "part", "_last", F.coalesce(F.sum("_c").over(newer), F.lit(0)).alias("_newer")).where(F.col("_newer") < max_ids)
        rows = rows.join(sizes, [channel, "part"]).where(F.col("_newer") + F.col("_last") - F.col("row_seq") < max_ids)
    return rows.select(channel, "id")


def new_rows(batch: DataFrame, guard: DataFrame, channel: str = "channel_id") -> DataFrame:
    return batch.join(guard, [channel, "id"], "left_anti")


def numbered(rows: DataFrame, name: str, num: str = "id_num", channel: str = "channel_id") -> DataFrame:
    """rows with their number in the id order of their channel, from 0; rows whose id is no number come first.

    Rows are numbered within an hour of a channel, and hours by the counts of those before, so that no task sorts a whole channel.
    """
    rows = rows.withColumn("_hour", F.coalesce(F.floor(F.col(num) / HOUR), F.lit(-1)).cast("bigint"))
    before = Window.partitionBy(channel).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(channel, "_hour").agg(F.count("*").alias("_c")).select(channel, "_hour", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy(channel, "_hour").orderBy(num, "id")) - 1
    return rows.withColumn("_nth", nth).join(starts, [channel, "_hour"]).withColumn(name, F.col("_start") + F.col("_nth")).drop("_hour", "_nth", "_start")


def deal_parts(rows: DataFrame, tails: DataFrame, chunk: int, num: str = "id_num", channel: str = "channel_id") -> DataFrame:
    """rows with (part, row_seq): each channel's rows in id order fill its open part and go on in new ones.

    tails(channel, part, rows): the part that is written to next and the rows it has; a channel without one begins part 1.
    """
    rows = numbered(rows, "_n", num, channel)
    at = F.coalesce("_rows", F.lit(0)) + F.col("_n")
    out = rows.join(tails.select(channel, F.col("part").alias("_part"), F.col("rows").alias("_rows")), channel, "left")
    return out.withColumns({"part": (F.coalesce("_part", F.lit(1)) + F.floor(at / chunk)).cast("int"), "row_seq": (at % chunk).cast("int")}).drop("_n", "_part", "_rows")


def part_meta(archive: DataFrame, *by: str) -> DataFrame:
    """Per part: rows, first and last id as written, and the true least and greatest."""
    return archive.groupBy(*by, "part").agg(F.count("*").alias("messages"), F.min_by("id", "row_seq").alias("start_id"), F.max_by("id", "row_seq").alias("end_id"), F.min("id_num").alias("min_id"), F.max("id_num").alias("max_id"))


def cost(ids: Column, archived_parts: Column, exact: bool, window_parts: int, chunk: int, max_ids: int) -> dict[str, Column]:
    """What indexing a channel would take, from its totals alone."""
    n = ids if exact else F.least(ids, F.lit(window_parts * chunk))
    return {"ids": n, "archived": ids, "parts": archived_parts, "bytes": n * BYTES_PER_ID, "affordable": n <= max_ids}
