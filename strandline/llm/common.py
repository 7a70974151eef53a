"""What the operators share: words, crc folds, shared scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: a word is a run of bytes other than space and tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words, as a Java pattern.
GAP = r"[\x20\x09-\x0D]+"
#: What tells a text with words.
NOT_GAP = r"[^\x20\x09-\x0D]"

_own: dict[str, str] = {}
_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent a local master gets a temporary folder; on a cluster the warehouse is taken.
    """
    if root := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors, fixes row ids."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes, empty for null."""
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than these: a small table, or one in few files. Rows lose their order."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def send_file(spark: SparkSession, path: str) -> str:
    """Gives the executors a file of the driver's; its name for received()."""
    spark.sparkContext.addFile(path)
    return Path(path).name


def received(name: str) -> str:
    """The executor's own path of a file sent by send_file()."""
    return SparkFiles.get(name)


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once per application; they may start in any folder."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="strandline-code-")  # served by the driver as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}-code", "zip", package.parent, package.name))
        _shipped.add(app)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
