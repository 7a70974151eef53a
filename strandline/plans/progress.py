"""Small keyed tables: progress, channels, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; of rows that tie, the greatest. A hot key costs a row per task."""
    most = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rows.columns if c not in keys])).alias("_r"))
    return most.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of those of the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True).select(*table.columns)


def update(progress: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """progress with updates(channel_id, fields...) applied: a null field keeps the old value. started_at is set when a channel first turns to extracting, completed_at whenever it turns to done or error. Unknown channels begin as pending."""
    given = [c for c in updates.columns if c != "channel_id"]
    both = progress.withColumn("_old", F.lit(True)).join(updates.select("channel_id", *[F.col(c).alias(f"_{c}") for c in given], F.lit(True).alias("_new")), "channel_id", "full")
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in given}
    status = F.col("_status") if "status" in given else F.lit(None).cast("string")
    fresh = F.col("_new").isNotNull()
    new["status"] = F.coalesce(status, F.col("status"), F.lit("pending"))
    new["started_at"] = F.when(fresh & (status == "extracting"), F.coalesce("started_at", now)).otherwise(F.col("started_at"))
    new["completed_at"] = F.when(fresh & status.isin("done", "error"), now).otherwise(F.col("completed_at"))
    new["updated_at"] = F.when(fresh, now).otherwise(F.col("updated_at"))
    new["total_extracted"] = F.coalesce(new.get("total_extracted", F.col("total_extracted")), F.lit(0))
    return both.withColumns(new).select(*progress.columns)


def report(progress: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress with the archive's totals per channel; totals(channel_id, messages, parts, ...)."""
    return progress.join(totals, "channel_id", "left")
