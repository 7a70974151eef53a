"""Small versioned tables and locks on any file system that Spark reads.

A table is a folder of Parquet versions and a file that names the current one. A write makes a new version, then replaces the
name in one rename, so readers see the old or the new table and a crash leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The few file-system calls that are needed, through Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def fs(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.fs(p).exists(self.path(p))

    def read(self, p: str) -> str:
        stream = self.fs(p).open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, p: str, text: str, overwrite: bool = False) -> None:
        """Fails if the file is there and may not be overwritten."""
        stream = self.fs(p).create(self.path(p), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, p: str, text: str) -> None:
        temp = f"{p}.{uuid.uuid4().hex}"
        self.write(temp, text)
        fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(p).toUri(), self.conf) if "://" in p or p.startswith("file:") else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        mode = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = spark_array(self.jvm, mode)
        fc.rename(fc.makeQualified(self.path(temp)), fc.makeQualified(self.path(p)), array)

    def delete(self, p: str) -> None:
        self.fs(p).delete(self.path(p), True)

    def glob(self, pattern: str) -> list[str]:
        return sorted(str(s.getPath().toString()) for s in self.fs(pattern).globStatus(self.path(pattern)) or [])


def spark_array(jvm, mode):
    gateway_array = jvm.java.lang.reflect.Array.newInstance(mode.getClass(), 1)
    jvm.java.lang.reflect.Array.set(gateway_array, 0, mode)
    return gateway_array


class Table:
    """A versioned table with a fixed schema; empty until first written. The pointer names the folders whose rows count: what was
    written last as a whole, and what was added to it since."""

    #: Added folders beyond which an append puts all into one.
    MOST = 32

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema, self.files = spark, root.rstrip("/"), schema, Files(spark)
        self.pointer = f"{self.root}/CURRENT"

    def version(self) -> str | None:
        return self.files.read(self.pointer) if self.files.exists(self.pointer) else None

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{v}" for v in version.split()])

    def write(self, df: DataFrame) -> None:
        """Replaces all rows. df may be made from the table's current ones."""
        old, version = self.version(), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{version}")
        self.files.replace(self.pointer, version)
        # One version back stays, for readers that began before.
        keep = {version, *(old or "").split()}
        for p in self.files.glob(f"{self.root}/v-*"):
            if p.rsplit("/", 1)[1] not in keep:
                self.files.delete(p)

    def append(self, df: DataFrame) -> None:
        """Adds rows without writing the others again, but for one time in MOST."""
        old, version = self.version(), f"v-{uuid.uuid4().hex}"
        if old is None or len(old.split()) >= self.MOST:
            self.write(df if old is None else self.read().unionByName(df.select(*self.read().columns)))
            return
        df.write.parquet(f"{self.root}/{version}")
        self.files.replace(self.pointer, f"{old}\n{version}")

    def readable(self) -> bool:
        """Whether every row of the current version can be read."""
        try:
            self.read().write.format("noop").mode("overwrite").save()
            return True
        except Exception:  # noqa: BLE001  whatever makes it unreadable
            return False

    def quarantine(self) -> str | None:
        """Puts a table that can't be read aside and starts a new one; the old pointer's text, if any."""
        if self.readable():
            return None
        text = self.files.read(self.pointer)
        self.files.write(f"{self.root}/CORRUPT-{uuid.uuid4().hex}", text)
        self.files.delete(self.pointer)
        return text


class LockHeldError(RuntimeError):
    pass


class WriterLock:
    """One writer at a time: a file made exclusively, released only by who made it, never taken over by age."""

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.path, self.token = Files(spark), f"{root.rstrip('/')}/WRITER.lock", uuid.uuid4().hex
        self.held = False

    def __enter__(self) -> WriterLock:
        try:
            self.files.write(self.path, self.token)
        except Exception as e:
            if self.files.exists(self.path):
                raise LockHeldError(f"another writer holds {self.path}; remove it if that writer is gone") from e
            raise
        self.held = True
        return self

    def __exit__(self, *_: object) -> None:
        if self.held and self.files.exists(self.path) and self.files.read(self.path) == self.token:
            self.files.delete(self.path)
        self.held = False
