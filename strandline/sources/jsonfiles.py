"""JSON layouts: sealed parts (one object with messages), open parts (a header line, then a row per line), array dumps, JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXPORT_ROW

ROW = f"struct<{EXPORT_ROW}>"
HEADER = f"struct<channelId:string,channelName:string,part:int,open:boolean,messages:array<{ROW}>>"


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    """(channel_id, part, layout, row_seq, row) of all parts under root, `layout` being sealed or open.

    A file that parses as an object with messages is sealed; one whose first line is a header with open = true and a part
    is open: lines that are no JSON, or have no id, are dropped, such as a line that was cut short. Other files give no rows.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*").text(root, wholetext=True)
    lines = F.split("value", "\n")
    whole = F.from_json("value", HEADER)
    head = F.from_json(F.element_at(lines, 1), HEADER)
    raw = raw.select("value", whole.alias("whole"), head.alias("head"), lines.alias("lines"))
    sealed = raw.where("whole.messages IS NOT NULL").select(F.col("whole.channelId").alias("channel_id"), F.col("whole.part").alias("part"), F.lit("sealed").alias("layout"), F.posexplode("whole.messages").alias("row_seq", "row"))
    is_open = F.col("whole.messages").isNull() & F.col("head.open") & F.col("head.part").isNotNull()
    rows = raw.where(is_open).select(F.col("head.channelId").alias("channel_id"), F.col("head.part").alias("part"), F.lit("open").alias("layout"), F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.lit(0), F.size("lines") - 1))).alias("row_seq", "line"))
    return sealed.unionByName(rows.withColumn("row", F.from_json("line", ROW)).drop("line")).where("row.id IS NOT NULL")


def _fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("channel_id", "part", "row_seq", "id_num")]


def write_sealed(df: DataFrame, root: str) -> None:
    """A JSON object per part; a part has a bounded number of rows."""
    row = F.struct("row_seq", F.struct(*_fields(df)).alias("m"))
    parts = df.groupBy("channel_id", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.to_json(F.struct(F.col("channel_id").alias("channelId"), F.col("part"), F.size("rows").alias("messageCount"), F.transform("rows", lambda r: r.m).alias("messages")))
    parts.select("channel_id", "part", body.alias("value")).repartition("channel_id", "part").write.option("maxRecordsPerFile", "1").partitionBy("channel_id", "part").text(root)


def write_open(df: DataFrame, root: str) -> None:
    rows = df.select("channel_id", "part", "row_seq", F.to_json(F.struct(*_fields(df))).alias("value"))
    head = df.select("channel_id", "part").distinct().select("channel_id", "part", F.lit(-1).alias("row_seq"), F.to_json(F.struct(F.col("channel_id").alias("channelId"), F.col("part"), F.lit(True).alias("open"))).alias("value"))
    rows.unionByName(head).repartition("channel_id", "part").sortWithinPartitions("channel_id", "part", "row_seq").select("channel_id", "part", "value").write.partitionBy("channel_id", "part").text(root)


def dump(df: DataFrame, path: str) -> None:
    """One JSON array in archive order, over the text files of a folder: read one after the other they are valid JSON."""
    keys = ["channel_id", "part", "row_seq"]
    first = df.agg(F.min(F.struct(*keys)).alias("k")).first().k
    is_first = F.struct(*keys) == F.struct(*[F.lit(v) for v in first]) if first else F.lit(False)
    rows = df.select(*keys, F.lit(0).alias("end"), F.concat(F.when(is_first, "[").otherwise(","), F.to_json(F.struct("channel_id", *_fields(df)))).alias("value"))
    close = df.sparkSession.createDataFrame([(None, None, None, 1, "]" if first else "[]")], "channel_id string, part int, row_seq int, end int, value string")
    rows.unionByName(close).orderBy("end", *keys).select("value").write.text(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    line = F.regexp_replace("value", r"^[\[,]", "")
    return spark.read.text(path).select(F.from_json(line, ROW).alias("r")).where("r.id IS NOT NULL").select("r.*")


def export_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """A JSON object per line; appending adds files."""
    df.write.mode("append" if append else "errorifexists").json(path)
