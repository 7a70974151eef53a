"""The message archive: immutable Parquet per append, and a manifest that says what counts.

An append stores its batch once, holds it against the archived ids of its channels in the parts whose id ranges it touches,
deals what is new to parts, writes it under data/<append>, then adds to the manifest: what no manifest row names is
invisible, so a crash in between leaves nothing behind but files. A run that comes again finds its rows archived and
drops them. A manifest that is missing or can't be read is rebuilt from the files before anything is read or written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import id_num
from ..operators import dedup
from .tables import Files, Table

MANIFEST = "channel_id string, part int, append string, messages bigint, start_id string, end_id string, min_id decimal(20,0), max_id decimal(20,0), open boolean, completed_at string, updated_at string"
#: Parts that were closed; kept apart from the manifest, so that a rebuilt one knows them.
SEALS = "channel_id string, part int"
#: Rows per part.
CHUNK = 50_000
#: Characters that Spark escapes in folder names.
ESCAPED = "\"#%'*/:=?\\{[]^"
BARE = "id string, id_num decimal(20,0)"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; where that is unset under the warehouse, or for a local master, as in tests, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if base is None and (not master.startswith("local") or master.startswith("local-cluster")):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if base is None:
        base = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = "file://" + base
    return f"{base.rstrip('/')}/archive-{uuid.uuid4().hex}"


def now() -> str:
    return datetime.now(UTC).isoformat()


def escaped(value: str) -> str:
    """A value as Spark writes it in the name of a partition's folder."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 or ord(c) == 127 else c for c in value)


class Archive:
    def __init__(self, spark: SparkSession, root: str, chunk: int = CHUNK, dedup_mode: str = "exact", dedup_parts: int = 3, dedup_ids: int | None = None):
        self.spark, self.root, self.chunk = spark, root.rstrip("/"), chunk
        self.guard = {"mode": dedup_mode, "parts": dedup_parts, "max_ids": dedup_ids}
        self.manifest, self.seals, self.files = Table(spark, f"{self.root}/manifest", MANIFEST), Table(spark, f"{self.root}/seals", SEALS), Files(spark)
        self.checked = False

    # Reading

    def meta(self) -> DataFrame:
        """The manifest's rows. Once per archive object, and whenever its pointer is gone, it is checked first, and rebuilt where it is missing or broken beside data."""
        there = self.manifest.version() is not None
        if not there or not self.checked:
            broken = there and self.manifest.quarantine() is not None
            if (broken or not there) and self.files.glob(f"{self.root}/data/append=*"):
                self.rebuild()
            self.checked = True
        return self.manifest.read()

    def schema(self) -> StructType:
        """The columns of all appends, as they were when written; no footer is read."""
        path = f"{self.root}/SCHEMA"
        return StructType.fromDDL(self.files.read(path)) if self.files.exists(path) else StructType.fromDDL(BARE)

    def _widen(self, df: DataFrame) -> None:
        """Adds columns that are new; before the data that has them is committed."""
        old = self.schema()
        new = [f for f in df.schema.fields if f.name not in (*old.names, "channel_id", "part", "row_seq")]
        if new or not self.files.exists(f"{self.root}/SCHEMA"):
            self.files.replace(f"{self.root}/SCHEMA", StructType([*old.fields, *new]).toDDL())

    def _load(self, meta: DataFrame, whole: bool) -> DataFrame:
        """Rows of the parts in meta. whole: meta has all the parts of its appends or nearly so, else paths of single parts are read."""
        own = meta.where("append IS NOT NULL AND messages > 0").select("append", "channel_id", "part")
        if whole:
            paths = sorted(f"{self.root}/data/append={r.append}" for r in own.select("append").distinct().collect())
        else:
            paths = sorted(f"{self.root}/data/append={r.append}/channel_id={escaped(r.channel_id)}/part={r.part}" for r in own.distinct().collect())
        columns = StructType.fromDDL(self.schema().toDDL() + ", row_seq int, append string, channel_id string, part int")
        if not paths:
            return self.spark.createDataFrame([], columns).drop("append")
        rows = self.spark.read.schema(columns).option("basePath", f"{self.root}/data").parquet(*paths)
        return rows.join(own, ["channel_id", "part", "append"], "left_semi").drop("append")

    def read(self, channel: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
        """Archived rows with channel_id, part and row_seq; with a channel or bounds of ids (inclusive), only parts that can hold them are read."""
        meta = self.meta()
        meta = meta if channel is None else meta.where(F.col("channel_id") == channel)
        meta = meta if low is None else meta.where(F.coalesce(F.col("max_id") >= low, F.lit(True)))
        meta = meta if high is None else meta.where(F.coalesce(F.col("min_id") <= high, F.lit(True)))
        rows = self._load(meta, channel is None and low is None and high is None)
        rows = rows if low is None else rows.where(F.coalesce(F.col("id_num") >= low, F.lit(True)))
        return rows if high is None else rows.where(F.coalesce(F.col("id_num") <= high, F.lit(True)))

    def sorted(self, channel: str) -> DataFrame:
        return self.read(channel).orderBy("id_num", "id")

    def totals(self) -> DataFrame:
        """(channel_id, messages, parts, completed_at) from the manifest alone; parts is the highest number, also of parts without rows."""
        return self.meta().groupBy("channel_id").agg(F.sum("messages").alias("messages"), F.max("part").alias("parts"), F.max("completed_at").alias("completed_at"))

    def stats(self) -> DataFrame:
        """totals() with the bytes of the files that count; files that are gone count nothing."""
        sizes = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data").select("path", "length")
        key = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
        sizes = sizes.groupBy(key("channel_id").alias("channel_id"), key("append").alias("append"), key("part").cast("int").alias("part")).agg(F.sum("length").alias("bytes"))
        live = self.meta().select("channel_id", "append", "part").join(sizes, ["channel_id", "append", "part"])
        return self.totals().join(live.groupBy("channel_id").agg(F.sum("bytes").alias("bytes")), "channel_id", "left")

    # Writing

    def _guard(self, batch: DataFrame, meta: DataFrame) -> DataFrame:
        """(channel_id, id) that the batch is held against. Exact mode reads the parts whose ids overlap the channel's in the batch; ids that are no numbers are sought in all of its parts."""
        if self.guard["mode"] == "exact" and self.guard["parts"] > 0 and self.guard["max_ids"] is None:
            spans = batch.groupBy("channel_id").agg(F.min("id_num").alias("_low"), F.max("id_num").alias("_high"), F.bool_or(F.col("id_num").isNull()).alias("_odd"))
            near = F.col("_odd") | ((F.col("max_id") >= F.col("_low")) & (F.col("min_id") <= F.col("_high")))
            return self._load(meta.join(spans, "channel_id").where(near).select(*meta.columns), False).select("channel_id", "id")
        return dedup.guard_ids(self._load(meta.join(batch.select("channel_id").distinct(), "channel_id", "left_semi"), False), **self.guard)

    def append(self, rows: DataFrame, name: str | None = None) -> dict[str, int]:
        """Archives what is new of rows(channel_id, id, ...); written and skipped rows. A name that was appended before is not appended again."""
        name = name or uuid.uuid4().hex
        meta = self.meta()
        if not meta.where(F.col("append") == name).isEmpty():
            return {"written": 0, "skipped": 0}
        staged = f"{self.root}/staging/{name}"
        rows = rows.withColumn("id_num", id_num(F.col("id")))
        rows.write.mode("overwrite").parquet(staged)
        batch = self.spark.read.schema(rows.schema).parquet(staged)
        n = batch.count()
        if n:
            once = dedup.first_of_each(batch.withColumn("_seq0", F.monotonically_increasing_id()), ["channel_id", "id"], "_seq0").drop("_seq0")
            fresh = dedup.new_rows(once, self._guard(batch, meta))
            own = meta.join(batch.select("channel_id").distinct(), "channel_id", "left_semi")
            per_part = own.groupBy("channel_id", "part").agg(F.sum("messages").alias("n"), F.bool_or("open").alias("open"))
            tails = per_part.groupBy("channel_id").agg(F.max_by(F.struct("part", "n", "open"), "part").alias("t"))
            tails = tails.select("channel_id", F.when(F.col("t.open"), F.col("t.part")).otherwise(F.col("t.part") + 1).alias("part"), F.when(F.col("t.open"), F.col("t.n")).otherwise(0).alias("rows"))
            dealt = dedup.deal_parts(fresh, tails, self.chunk)
            self._widen(dealt)
            dealt.repartition("channel_id", "part").sortWithinPartitions("channel_id", "part", "row_seq").write.mode("overwrite").partitionBy("channel_id", "part").parquet(f"{self.root}/data/append={name}")
        written = self._commit(name) if self.files.glob(f"{self.root}/data/append={name}/channel_id=*") else 0
        self.files.delete(staged)
        return {"written": written, "skipped": n - written}

    def _parts_of(self, name: str, is_open: bool) -> DataFrame:
        columns = StructType.fromDDL(BARE + ", row_seq int, channel_id string, part int")
        parts = dedup.part_meta(self.spark.read.schema(columns).parquet(f"{self.root}/data/append={name}"), "channel_id")
        return parts.select("channel_id", "part", F.lit(name).alias("append"), "messages", "start_id", "end_id", "min_id", "max_id", F.lit(is_open).alias("open"), F.lit(None).cast("string").alias("completed_at"), F.lit(now()).alias("updated_at"))

    def _commit(self, name: str) -> int:
        """Adds the append's parts to the manifest; their rows."""
        parts = self._parts_of(name, True)
        done = self.manifest.read().groupBy("channel_id").agg(F.max("completed_at").alias("_done"))
        fresh = parts.join(done, "channel_id", "left").withColumn("completed_at", F.col("_done")).select(*parts.columns)
        self.manifest.append(fresh)
        return self.manifest.read().where(F.col("append") == name).agg(F.coalesce(F.sum("messages"), F.lit(0))).first()[0]

    def compact(self, seal: bool = False) -> None:
        """Rewrites parts that several appends wrote as one file each; with seal, closes open parts too. Doing it again changes nothing.

        An append whose rows are all rewritten keeps a manifest row without rows, so that its name stays known.
        """
        meta = self.meta()
        if seal and not (fresh := meta.where("open").select("channel_id", "part").distinct()).isEmpty():
            self.seals.append(fresh)
        many = meta.where("append IS NOT NULL AND messages > 0").groupBy("channel_id", "part").agg(F.count("*").alias("n")).where("n > 1").select("channel_id", "part")
        kept = meta.withColumn("open", F.lit(False)) if seal else meta
        if many.isEmpty():
            if seal and not meta.where("open").isEmpty():
                self.manifest.write(kept)
            return
        name = f"compact-{uuid.uuid4().hex}"
        rows = self._load(meta.join(many, ["channel_id", "part"], "left_semi"), False)
        rows.repartition("channel_id", "part").sortWithinPartitions("channel_id", "part", "row_seq").write.partitionBy("channel_id", "part").parquet(f"{self.root}/data/append={name}")
        state = kept.groupBy("channel_id", "part").agg(F.bool_or("open").alias("_open"), F.max("completed_at").alias("_done"))
        parts = self._parts_of(name, False)
        merged = parts.join(state, ["channel_id", "part"]).withColumns({"open": F.col("_open"), "completed_at": F.col("_done")}).select(*parts.columns)
        names = kept.join(many, ["channel_id", "part"], "left_semi").select("channel_id", "append").distinct()
        none = {c: F.lit(None) for c in ("start_id", "end_id", "min_id", "max_id", "completed_at", "updated_at")}
        known = names.withColumns({"part": F.lit(0), "messages": F.lit(0).cast("bigint"), "open": F.lit(False), **none})
        known = known.select(*[F.col(f.name).cast(f.dataType) for f in meta.schema.fields])
        self.manifest.write(kept.join(many, ["channel_id", "part"], "left_anti").select(*meta.columns).unionByName(merged).unionByName(known).distinct())

    def finalize(self) -> None:
        """Seals open parts; parts that several appends wrote are rewritten as one file each. Doing it again changes nothing."""
        self.compact(seal=True)

    def complete(self, channel: str) -> None:
        self.manifest.write(self.meta().withColumn("completed_at", F.when(F.col("channel_id") == channel, F.lit(now())).otherwise(F.col("completed_at"))))

    def reset(self, channel: str) -> None:
        self.manifest.write(self.meta().where(F.col("channel_id") != channel))
        self.seals.write(self.seals.read().where(F.col("channel_id") != channel))
        for p in self.files.glob(f"{self.root}/data/append=*/channel_id={escaped(channel)}"):
            self.files.delete(p)

    def vacuum(self) -> None:
        """Deletes appends that no manifest row names: those of crashed and of rewritten ones."""
        named = {r.append for r in self.meta().where("append IS NOT NULL AND messages > 0").select("append").distinct().collect()}
        for p in self.files.glob(f"{self.root}/data/append=*"):
            if p.rsplit("append=", 1)[1] not in named:
                self.files.delete(p)

    # Recovery

    def forget_manifest(self) -> None:
        self.files.delete(self.manifest.root)

    def rebuild(self) -> Archive:
        """Makes the manifest from the files. Unreadable ones give no rows, but their part numbers stay taken. A channel's last part stays open unless it is full or was sealed. When a channel was completed is not in the files."""
        empty = self.spark.createDataFrame([], MANIFEST)
        meta = empty
        if self.files.glob(f"{self.root}/data/append=*/channel_id=*/part=*/*"):
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/data").select("path")
            key = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
            taken = listed.select(F.expr("url_decode(replace(regexp_extract(path, '/channel_id=([^/]+)/', 1), '+', '%2B'))").alias("channel_id"), key("part").cast("int").alias("part")).where("part IS NOT NULL").distinct()
            columns = StructType.fromDDL(BARE + ", row_seq int, append string, channel_id string, part int")
            rows = self.spark.read.option("ignoreCorruptFiles", "true").option("basePath", f"{self.root}/data").schema(columns).parquet(f"{self.root}/data")
            # The same row in two appends: one was rewritten into the other before the crash; the first by name stays.
            keep = rows.groupBy("channel_id", "part", "row_seq", "id").agg(F.min("append").alias("append"))
            rows = rows.join(keep, ["channel_id", "part", "row_seq", "id", "append"], "left_semi")
            parts = dedup.part_meta(rows.withColumn("channel_append", F.struct("channel_id", "append")), "channel_append").select("channel_append.*", "part", "messages", "start_id", "end_id", "min_id", "max_id")
            none = {c: F.lit(None) for c in ("append", "start_id", "end_id", "min_id", "max_id")}
            held = taken.join(parts, ["channel_id", "part"], "left_anti").withColumns({"messages": F.lit(0), **none})
            every = parts.unionByName(held.select(*[F.col(c).cast(parts.schema[c].dataType) for c in parts.columns]))
            full = every.groupBy("channel_id", "part").agg(F.sum("messages").alias("n"))
            last = full.groupBy("channel_id").agg(F.max("part").alias("part")).join(full, ["channel_id", "part"]).where((F.col("n") > 0) & (F.col("n") < self.chunk))
            opened = last.select("channel_id", "part").join(self.seals.read(), ["channel_id", "part"], "left_anti").withColumn("open", F.lit(True))
            every = every.join(opened, ["channel_id", "part"], "left").withColumns({"open": F.coalesce("open", F.lit(False)), "completed_at": F.lit(None).cast("string"), "updated_at": F.lit(now())})
            meta = empty.unionByName(every.select(*empty.columns))
        self.manifest.write(meta)
        return self
