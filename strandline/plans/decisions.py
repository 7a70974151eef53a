"""Decisions over progress rows, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import fmt_count
from ..schemas import RESUME_STATE

#: Versions of the saved state that are understood.
VERSIONS = (2, 3)


def _set(s: Column) -> Column:
    return F.coalesce(s != "", F.lit(False))


def parse_resume(text: Column) -> Column:
    """The saved state as a struct of version 3; null if it is missing, broken or of another version. Windows of version 2 include their lower bound."""
    raw = F.from_json(text, RESUME_STATE)
    usable = raw.version.isin(*VERSIONS) & raw.segments.isNotNull() & raw.parallelism.isNotNull()
    fix = lambda s, i: F.struct(
        F.coalesce(s.index, i).alias("index"),
        F.coalesce(s.after, F.lit("")).alias("after"),
        F.coalesce(s.before, F.lit("")).alias("before"),
        ((raw.version == 2) | F.coalesce(s.afterInclusive, F.lit(False))).alias("afterInclusive"),
        s.cursor.alias("cursor"),
        F.coalesce(s.done, F.lit(False)).alias("done"),
    )
    state = F.struct(F.lit(3).alias("version"), raw.parallelism.alias("parallelism"), raw.updatedAt.alias("updatedAt"), F.transform(raw.segments, fix).alias("segments"), raw.balance.alias("balance"))
    return F.when(usable, state)


def is_complete(segments: Column) -> Column:
    return (F.size(segments) > 0) & F.forall(segments, lambda s: s.done)


def resume_summary(segments: Column) -> Column:
    count = lambda f: F.size(F.filter(segments, f))
    held = lambda s: _set(s.cursor)
    return F.when(segments.isNotNull(), F.format_string("%d/%d shards done, %d partial, %d pending", count(lambda s: s.done), F.size(segments), count(lambda s: ~s.done & held(s)), count(lambda s: ~s.done & ~held(s))))


def has_reusable_windows(state: Column, parallelism: Column) -> Column:
    """Whether a saved state can be resumed as it is: the same number of shards, each with its window."""
    whole = F.forall(state.segments, lambda s: _set(s.after) & _set(s.before))
    return F.coalesce((state.parallelism == parallelism) & (F.size(state.segments) > 0) & whole, F.lit(False))


def new_state(segments: Column, parallelism: Column, updated_at: Column, balance: Column | None = None) -> Column:
    """A state in which nothing is fetched yet, of windows struct<after, before, afterInclusive> in order."""
    fresh = lambda s, i: F.struct(i.alias("index"), s.after.alias("after"), s.before.alias("before"), s.afterInclusive.alias("afterInclusive"), F.lit(None).cast("string").alias("cursor"), F.lit(False).alias("done"))
    none = F.lit(None).cast(StructType.fromDDL(RESUME_STATE)["balance"].dataType)
    return F.struct(F.lit(3).alias("version"), parallelism.alias("parallelism"), updated_at.alias("updatedAt"), F.transform(segments, fresh).alias("segments"), (none if balance is None else balance).alias("balance"))


def resolve_segments(state: Column, parallelism: Column, fresh: Column, updated_at: Column, balance: Column | None = None) -> Column:
    """The state to fetch by: the saved one, its windows in order, if it is reusable; else one of the fresh windows."""
    by_index = lambda a, b: F.when(a.index < b.index, -1).when(a.index > b.index, 1).otherwise(0)
    kept = state.withField("segments", F.array_sort(state.segments, by_index))
    return F.when(has_reusable_windows(state, parallelism), kept).otherwise(new_state(fresh, parallelism, updated_at, balance))


def _change(state: Column, index: Column | int, f: Callable[[Column], Column], updated_at: Column) -> Column:
    """state with f applied to the segment of an index; a segment that is missing is added first, without a window."""
    index = F.lit(index) if isinstance(index, int) else index
    blank = F.struct(index.cast("int").alias("index"), F.lit("").alias("after"), F.lit("").alias("before"), F.lit(False).alias("afterInclusive"), F.lit(None).cast("string").alias("cursor"), F.lit(False).alias("done"))
    every = F.when(F.exists(state.segments, lambda s: s.index == index), state.segments).otherwise(F.array_sort(F.concat(state.segments, F.array(blank)), lambda a, b: a.index - b.index))
    return state.withField("segments", F.transform(every, lambda s: F.when(s.index == index, f(s)).otherwise(s))).withField("updatedAt", updated_at)


def set_cursor(state: Column, index: Column | int, cursor: Column, updated_at: Column) -> Column:
    """state with the place down to which a segment is fetched; columns hold values, so what was made durable before stays as it was."""
    return _change(state, index, lambda s: s.withField("cursor", cursor), updated_at)


def mark_done(state: Column, index: Column | int, updated_at: Column) -> Column:
    return _change(state, index, lambda s: s.withField("done", F.lit(True)).withField("cursor", F.lit(None).cast("string")), updated_at)


def pending_count(segments: Column) -> Column:
    return F.size(F.filter(segments, lambda s: ~s.done))


def describe_balance(balance: Column) -> Column:
    """A line on how a channel's shards were balanced; null without an estimate."""
    shards = F.coalesce(F.size(balance.loads), F.lit(0))
    dense = balance.strategy == "density"
    full = dense & (shards > 0) & balance.minLoad.isNotNull() & balance.maxLoad.isNotNull()
    share = F.when(balance.imbalance.isNotNull(), F.concat(F.lit("imbalance "), F.floor(balance.imbalance * 100 + 0.5).cast("string"), F.lit("%")))
    probes = F.when(balance.probes > 0, F.concat(balance.probes.cast("string"), F.lit(" probes")))
    loads = F.concat(F.lit("~"), fmt_count(balance.minLoad), F.lit("-"), fmt_count(balance.maxLoad), F.lit(" msgs/shard"))
    line = F.concat_ws(", ", F.lit("density"), F.concat(shards.cast("string"), F.lit(" shards")), loads, share, probes)
    return F.when(balance.isNotNull(), F.when(F.coalesce(full, F.lit(False)), line).otherwise(F.concat(F.when(dense, "density").otherwise("equal-time"), F.lit(" (no density estimate)"))))


def window_decision(baseline: Column, state: Column, archive_complete: Column) -> Column:
    """struct<use, reuse, reason>: whether a catch-up may start at the baseline, and whether in the saved window."""
    out = lambda use, reuse, reason: F.struct(F.lit(use).alias("use"), F.lit(reuse).alias("reuse"), F.lit(reason).alias("reason"))
    only = F.element_at(state.segments, 1)
    going_on = (state.parallelism == 1) & (F.size(state.segments) == 1) & (only.after == baseline) & _set(only.before) & ~only.done
    return (
        F.when(~_set(baseline), out(False, False, "no-baseline"))
        .when(state.isNull() & archive_complete, out(True, False, "ok"))
        .when(state.isNull(), out(False, False, "unknown-state"))
        .when(F.coalesce(going_on, F.lit(False)), out(True, True, "ok"))
        .when(is_complete(state.segments), out(True, False, "ok"))
        .otherwise(out(False, False, "pending-shards"))
    )


def auto_incremental(full: Column, incremental: Column, enabled: Column, status: Column, completed_at: Column, baseline: Column) -> Column:
    return ~full & ~incremental & enabled & F.coalesce(status == "done", F.lit(False)) & _set(completed_at) & _set(baseline)


def catchup_plan(active: Column, status: Column, baseline: Column, include_new: Column) -> Column:
    """due, live, in-progress or no-baseline, tested in the order live, in-progress, baseline."""
    return F.when(active, F.lit("live")).when(status == "extracting", F.lit("in-progress")).when(_set(baseline) | include_new, F.lit("due")).otherwise(F.lit("no-baseline"))


def final_status(aborted: Column, failed: Column, all_done: Column) -> Column:
    return F.when(~aborted & (failed == 0) & all_done, F.lit("done")).otherwise(F.lit("error"))


def classify_status(code: Column) -> Column:
    """struct<kind, retryable> of a response code."""
    out = lambda kind, again: F.struct(F.lit(kind).alias("kind"), F.lit(again).alias("retryable"))
    return (
        F.when(code == 429, out("rate_limit", True))
        .when(code.isin(401, 403), out("auth", False))
        .when(code == 404, out("not_found", False))
        .when(code.isin(408, 425) | (code >= 500), out("server", True))
        .when(code >= 400, out("client", False))
        .otherwise(out("unknown", False))
    )
