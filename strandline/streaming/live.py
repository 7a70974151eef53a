"""Live capture: a stream of landed messages into the archive, micro-batch by micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import id_num
from ..operators import normalize
from ..schemas import RAW_MESSAGE
from ..sources.archive import Archive


def not_automated() -> Column:
    """Not from a bot or a webhook."""
    return ~F.coalesce(F.col("author.bot"), F.lit(False)) & (F.coalesce("webhook_id", F.lit("")) == "")


def above_floor(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """Messages of the targets(channel_id, floor), without ids at or below the floor. An empty floor drops nothing; an id or floor that is no number is kept."""
    floors = targets.select("channel_id", id_num(F.col("floor")).alias("_floor"))
    return messages.join(floors, "channel_id").where(F.coalesce(id_num(F.col("id")) > F.col("_floor"), F.lit(True))).drop("_floor")


class LiveCapture:
    """Appends what is new of a stream. Batches are named by the stream's own id, which its checkpoint holds, and their number:
    a batch that runs again appends nothing twice, and a stream with a new checkpoint shares no name with an older one."""

    #: Appends after which open parts are rewritten as one file each.
    COMPACT_EVERY = 50

    def __init__(self, archive: Archive, targets: DataFrame, exclude_bots: bool = False, log_path: str | None = None, after: Callable[[str, dict[str, int]], None] | None = None):
        self.archive, self.targets, self.exclude_bots, self.log_path, self.after = archive, targets, exclude_bots, log_path, after

    def _batch(self, checkpoint: str):
        def run(batch: DataFrame, batch_id: int) -> None:
            kept = above_floor(batch.where("id IS NOT NULL"), self.targets)
            rows = normalize.to_rows(kept.where(not_automated()) if self.exclude_bots else kept, "channel_id")
            if self.log_path:
                try:  # the log holds every processed row; losing it doesn't fail the run
                    rows.write.mode("append").json(self.log_path)
                except Exception as e:  # noqa: BLE001
                    print(f"log degraded: {e}")
                    self.log_path = None
            stream = json.loads(self.archive.files.read(f"{checkpoint}/metadata").splitlines()[0])["id"]
            name = f"live-{stream}-{batch_id}"
            done = self.archive.append(rows, name)
            if batch_id % self.COMPACT_EVERY == self.COMPACT_EVERY - 1:
                self.archive.compact()
            if self.after:
                self.after(name, done)

        return run

    def start(self, landing: str, checkpoint: str, seconds: int | None = 2, files_per_batch: int = 1000, bytes_per_batch: str | None = None):
        """A running query; with seconds None it takes what is there and ends. A batch takes so many files, or bytes, at most."""
        spark = self.archive.spark
        stream = spark.readStream.schema(RAW_MESSAGE)
        stream = stream.option("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else stream.option("maxFilesPerTrigger", files_per_batch)
        writer = stream.json(landing).writeStream.foreachBatch(self._batch(checkpoint.rstrip("/"))).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()

    def drain(self, landing: str, checkpoint: str) -> None:
        self.start(landing, checkpoint, None).awaitTermination()
