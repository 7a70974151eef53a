"""One object for what a user does: ingest, catch up, capture, report, query, export, reset."""

from __future__ import annotations

import random
import threading
from collections.abc import Callable, Iterable
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.ids import id_num, ms_to_id
from .operators import dedup, normalize, shards
from .plans import decisions, progress
from .schemas import CHANNELS, PROGRESS, SESSIONS
from .sources import jsonfiles
from .sources.archive import Archive, now
from .sources.tables import Table, WriterLock
from .streaming.live import LiveCapture

#: Functions that run code of their own.
FOREIGN = {"reflect", "java_method", "try_reflect"}
#: Least time between cycles, and the most that is added to it by chance.
LEAST_SECONDS, MOST_JITTER_SECONDS = 1.0, 60.0


def refuse_writes(spark: SparkSession, text: str) -> None:
    """Raises ValueError for what is no query, by its parsed plan: commands but SHOW, DESCRIBE and EXPLAIN, inserts wherever they stand, scripts, and functions that call foreign code."""
    jvm = spark._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"only queries are run: {str(e).splitlines()[0]}") from e
    named = lambda x: x.getClass().getSimpleName()
    is_a = lambda x, kind: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{kind}").isInstance(x)
    stack, root = [plan], plan
    while stack:
        x = stack.pop()
        name = named(x)
        told = x is root and name.startswith(("Show", "Describe", "Explain"))
        if not told and (is_a(x, "Command") or is_a(x, "ParsedStatement") or name.startswith(("Insert", "ScriptTransformation", "CompoundBody"))):
            raise ValueError(f"only queries are run, not {name}")
        for inner in (x.children(), x.innerChildren()) if not told else ():
            stack += [inner.apply(i) for i in range(inner.size()) if hasattr(inner.apply(i), "innerChildren") and is_a(inner.apply(i), "LogicalPlan")]
    if any(f"'{f}(" in plan.toString().lower() or f"{f}(" in text.lower().replace(" ", "") for f in FOREIGN):
        raise ValueError("only queries are run, without foreign code")


class LiveSession:
    """A running capture: holds the writer lock until stop()."""

    def __init__(self, engine: Engine, targets: DataFrame, opened: ExitStack, started: str):
        self.engine, self.targets, self.opened, self.started = engine, targets, opened, started
        self.query = None

    def stop(self) -> None:
        """Ends the stream, seals the archive, closes the sessions, gives the lock back. A stream that failed leaves its error with the sessions, and raises."""
        if self.query.isActive:
            self.query.stop()
        failed = self.query.exception()
        try:
            self.engine.archive.finalize()
            self.engine._advance(self.targets.select("channel_id"), "error" if failed else "done")
            self.engine._close_sessions(self.started, "error" if failed else "stopped")
        finally:
            self.opened.close()
        if failed:
            raise failed


class Engine:
    """An archive with its progress, channel and session tables under one root. Writing calls hold the writer lock."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, **archive_options):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.archive = Archive(spark, self.root, **(self.config.archive_options() | archive_options))
        self.progress = Table(spark, f"{self.root}/progress", PROGRESS)
        self.channels = Table(spark, f"{self.root}/channels", CHANNELS)
        self.sessions = Table(spark, f"{self.root}/sessions", SESSIONS)
        # Small tables that can't be read are put aside, and begun anew; the archive's manifest is made again from its files.
        self.quarantined = [t.root for t in (self.progress, self.channels, self.sessions) if t.version() and t.quarantine()]

    def lock(self) -> WriterLock:
        return WriterLock(self.spark, self.root)

    # Ingest

    def windows(self, channels: DataFrame, now_ms: int, parallelism: int = 6, probes: DataFrame | None = None) -> DataFrame:
        """Shards of channels(channel), balanced by density where probes(channel, t, rate, seq) are given."""
        if probes is None:
            return shards.equal_shards(channels.select("channel"), now_ms, parallelism).withColumn("strategy", F.lit("equal-time"))
        return shards.density_shards(channels, probes, now_ms, parallelism)

    def ingest(self, landing: DataFrame, now_ms: int, incremental: bool | None = None) -> dict[str, int]:
        """Archives landed raw messages up to a minute past now. Data, then manifest, then progress.

        incremental: a channel with a baseline, and no shard of its saved state left open, takes only ids above it; None:
        channels that are done and complete do so by themselves; False: none does.
        """
        with self.lock():
            num = id_num(F.col("id"))
            rows = landing.where("id IS NOT NULL AND channel_id IS NOT NULL").where(F.coalesce(num < ms_to_id(now_ms + shards.AHEAD_MS), F.lit(True)))
            if incremental is not False:
                floors = self.decide(incremental).where("use").select("channel_id", id_num(F.col("baseline")).alias("_base"))
                rows = rows.join(floors, "channel_id", "left").where(F.col("_base").isNull() | F.coalesce(num > F.col("_base"), F.lit(True))).drop("_base")
            done = self.archive.append(normalize.to_rows(rows, "channel_id"))
            self.archive.finalize()
            self._advance(landing.where("channel_id IS NOT NULL").select("channel_id").distinct(), "done")
            return done

    def decide(self, incremental: bool | None = None) -> DataFrame:
        """(channel_id, baseline, use, reuse, reason): whether each channel may take up at its baseline."""
        done = self.archive.totals().select("channel_id", F.col("completed_at").alias("archived_at"))
        p = self.progress.read().join(done, "channel_id", "left")
        state = decisions.parse_resume(F.col("resume_state"))
        asked = F.lit(True) if incremental else decisions.auto_incremental(F.lit(False), F.lit(False), F.lit(self.config.auto_incremental), F.col("status"), F.col("archived_at"), F.col("newest_message_id"))
        # A run that ended well without shards of its own has no state; its archive is whole up to the baseline.
        whole = F.col("archived_at").isNotNull() | (F.col("status") == "done")
        x = decisions.window_decision(F.col("newest_message_id"), state, F.coalesce(whole, F.lit(False)))
        return p.select("channel_id", F.col("newest_message_id").alias("baseline"), x.alias("x"), asked.alias("asked")).select("channel_id", "baseline", (F.col("x.use") & F.col("asked")).alias("use"), "x.reuse", "x.reason")

    def plan_windows(self, channels: DataFrame, now_ms: int, parallelism: int | None = None, probes: DataFrame | None = None) -> DataFrame:
        """(channel_id, state): what to fetch of channels(channel_id): the saved windows where they can be resumed, else fresh ones. Saved with save_states()."""
        p = parallelism or self.config.parallelism
        own = channels.select("channel_id", F.col("channel_id").cast("bigint").alias("channel"))
        fresh = self.windows(own, now_ms, p, probes)
        window = F.struct("shard", F.col("after").cast("string").alias("after"), F.col("before").cast("string").alias("before"), (F.col("shard") >= 0).alias("afterInclusive"))
        fresh = fresh.groupBy("channel").agg(F.array_sort(F.collect_list(window)).alias("fresh"))
        saved = self.progress.read().select("channel_id", decisions.parse_resume(F.col("resume_state")).alias("saved"))
        return own.join(fresh, "channel").join(saved, "channel_id", "left").select("channel_id", decisions.resolve_segments(F.col("saved"), F.lit(p), F.col("fresh"), F.lit(now())).alias("state"))

    def save_states(self, states: DataFrame, status: str = "extracting") -> None:
        """Progress with the states(channel_id, state) and a status."""
        with self.lock():
            updates = states.select("channel_id", F.to_json("state").alias("resume_state"), F.lit(status).alias("status"))
            self.progress.write(progress.update(self.progress.read(), updates, F.lit(now())))

    def _advance(self, touched: DataFrame, status: str) -> None:
        """Progress from the archive: totals, and a baseline that never falls."""
        newest = self.archive.meta().groupBy("channel_id").agg(F.sum("messages").alias("total_extracted"), F.max("max_id").cast("string").alias("newest_message_id"))
        updates = touched.join(newest, "channel_id", "left").withColumn("status", F.lit(status))
        self.progress.write(progress.update(self.progress.read(), updates, F.lit(now())))

    # Channels

    def upsert_channels(self, rows: DataFrame) -> None:
        """rows(channel_id, server_id, server_name, channel_name, enabled) in place of those of the same ids; made and changed now."""
        with self.lock():
            stamped = rows.withColumns({"created_at": F.lit(now()), "updated_at": F.lit(now())})
            self.channels.write(progress.upsert(self.channels.read(), stamped, ["channel_id"]))

    def enabled_channels(self) -> DataFrame:
        return self.channels.read().where("enabled")

    def remove_channel(self, channel: str) -> None:
        with self.lock():
            self.channels.write(self.channels.read().where(F.col("channel_id") != channel))

    def complete(self, channel: str) -> None:
        with self.lock():
            self.archive.complete(channel)

    # Catching up

    def plan_catchup(self, active: Iterable[str] = (), include_new: bool = False) -> DataFrame:
        """(channel_id, channel_name, plan, baseline) for each known channel."""
        p = self.progress.read()
        live = F.col("channel_id").isin(list(active)) if active else F.lit(False)
        plan = decisions.catchup_plan(live, F.col("status"), F.col("newest_message_id"), F.lit(include_new))
        return p.select("channel_id", F.coalesce("channel_name", "channel_id").alias("channel_name"), plan.alias("plan"), F.coalesce("newest_message_id", F.lit("")).alias("baseline"))

    def run_cycle(self, landing: DataFrame, now_ms: int, active: Iterable[str] = (), include_new: bool = False) -> dict[str, int]:
        due = self.plan_catchup(active, include_new).where("plan = 'due'").select("channel_id")
        return self.ingest(landing.join(due, "channel_id", "left_semi"), now_ms, incremental=True)

    def watch(self, landing: Callable[[], tuple[DataFrame, int]], stop: threading.Event, seconds: float | None = None, jitter: float | None = None, done: Callable[[dict | Exception], None] | None = None, **options) -> int:
        """Cycles until `stop` is set, which also ends the wait between them; how many ended well. landing() gives the messages and the time now.

        The wait is `seconds` (one at least) and up to `jitter` more. A cycle that fails is told to done() and the next comes all the same.
        """
        wait = max(LEAST_SECONDS, self.config.watch_interval_ms / 1000 if seconds is None else seconds)
        jitter = max(0.0, min(MOST_JITTER_SECONDS, wait / 10) if jitter is None else jitter)
        well = 0
        while not stop.is_set():
            try:
                rows, now_ms = landing()
                out: dict | Exception = self.run_cycle(rows, now_ms, **options)
                well += 1
            except Exception as e:  # noqa: BLE001  told, and tried again
                out = e
            if done:
                done(out)
            stop.wait(wait + random.random() * jitter)
        return well

    # Live

    def _open(self, targets: DataFrame, started: str) -> DataFrame:
        """Progress as it was; sessions opened, channels live."""
        before = self.progress.read()
        session = targets.select(F.concat(F.col("channel_id"), F.lit("@" + started)).alias("session_id"), "channel_id", F.lit(started).alias("started_at"), F.lit(None).cast("string").alias("last_message_id"), F.lit(0).cast("bigint").alias("message_count"), F.lit("active").alias("status"))
        self.sessions.append(session)
        self.progress.write(progress.update(before, targets.select("channel_id", F.lit("live").alias("status")), F.lit(now())))
        return before

    def _close_sessions(self, started: str, status: str) -> None:
        here = F.col("started_at") == started
        self.sessions.write(self.sessions.read().withColumn("status", F.when(here, F.lit(status)).otherwise(F.col("status"))))

    def _after_batch(self, targets: DataFrame, started: str) -> Callable[[str, dict[str, int]], None]:
        """Once a batch is archived: channels' progress, then their sessions."""

        def run(name: str, done: dict[str, int]) -> None:
            if not done["written"]:
                return
            new = self.archive.meta().where((F.col("append") == name) & (F.col("messages") > 0)).groupBy("channel_id").agg(F.sum("messages").alias("_n"), F.max("max_id").cast("string").alias("_last"))
            self._advance(new.select("channel_id"), "live")
            here = F.col("started_at") == started
            s = self.sessions.read()
            rows = s.join(new, "channel_id", "left").withColumns({"message_count": F.when(here, F.col("message_count") + F.coalesce("_n", F.lit(0))).otherwise(F.col("message_count")), "last_message_id": F.when(here, F.coalesce("_last", "last_message_id")).otherwise(F.col("last_message_id"))})
            self.sessions.write(rows.select(*s.columns))

        return run

    def live(self, targets: DataFrame, landing: str, checkpoint: str, exclude_bots: bool = False, seconds: int | None = None, log_path: str | None = None) -> LiveSession:
        """A running capture under the writer lock. A start that fails puts statuses back, marks the sessions, and gives the lock back."""
        started = now()
        with ExitStack() as stack:
            stack.enter_context(self.lock())
            before = self._open(targets, started)
            session = LiveSession(self, targets, ExitStack(), started)
            try:
                capture = LiveCapture(self.archive, targets, exclude_bots, log_path, self._after_batch(targets, started))
                session.query = capture.start(landing, checkpoint, seconds or max(1, self.config.live_flush_interval_ms // 1000))
            except Exception:
                self.progress.write(before)
                self._close_sessions(started, "error")
                raise
            session.opened = stack.pop_all()
        return session

    def capture(self, targets: DataFrame, landing: str, checkpoint: str, exclude_bots: bool = False, log_path: str | None = None) -> None:
        """Takes what is landed and closes the sessions; a capture that fails puts statuses back and marks them."""
        started = now()
        with self.lock():
            before = self._open(targets, started)
            try:
                LiveCapture(self.archive, targets, exclude_bots, log_path, self._after_batch(targets, started)).drain(landing, checkpoint)
                self.archive.finalize()
                self._advance(targets.select("channel_id"), "done")
                self._close_sessions(started, "stopped")
            except Exception:
                self.progress.write(before)
                self._close_sessions(started, "error")
                raise

    # Reading

    def messages(self, channel: str) -> DataFrame:
        return self.archive.sorted(channel)

    def status(self) -> DataFrame:
        return progress.report(self.progress.read().withColumnRenamed("completed_at", "finished_at"), self.archive.totals()).orderBy(F.desc("updated_at"))

    def dedup_cost(self, max_ids: int = 2_000_000) -> DataFrame:
        t = self.archive.totals()
        guard = self.archive.guard
        return t.select("channel_id", *[c.alias(k) for k, c in dedup.cost(F.col("messages"), F.col("parts"), guard["mode"] == "exact", guard["parts"], self.archive.chunk, max_ids).items()])

    def sql(self, text: str) -> DataFrame:
        """A query over the views messages, parts, channel_progress, channels, live_sessions; statements that write are refused."""
        refuse_writes(self.spark, text)
        views = {"messages": self.archive.read(), "parts": self.archive.meta().where("part > 0"), "channel_progress": self.progress.read(), "channels": self.channels.read(), "live_sessions": self.sessions.read()}
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def dump(self, channel: str, path: str) -> None:
        jsonfiles.dump(self.archive.read(channel), path)

    def export_lines(self, channel: str, path: str) -> None:
        jsonfiles.export_lines(self.archive.read(channel).drop("part", "row_seq", "id_num"), path)

    def reset(self, channel: str) -> None:
        """Forgets a channel's messages, baseline and state."""
        with self.lock():
            self.archive.reset(channel)
            p = self.progress.read()
            here = F.col("channel_id") == channel
            blank = {c: F.when(here, F.lit(None)).otherwise(F.col(c)) for c in ("last_message_id", "last_extracted_ts", "error_message", "completed_at", "resume_state", "newest_message_id")}
            blank |= {"total_extracted": F.when(here, 0).otherwise(F.col("total_extracted")).cast("bigint"), "status": F.when(here, "pending").otherwise(F.col("status")), "updated_at": F.when(here, now()).otherwise(F.col("updated_at"))}
            self.progress.write(p.withColumns(blank))
