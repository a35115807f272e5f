"""Streams: windowed counts under a watermark, and change detection between snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """(start, end, keys, n) of closed windows; events later than `late` are left out."""
    return sliding(events, ts, width, width, late, *keys)


def sliding(events: DataFrame, ts: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    w = F.window(ts, width, step)
    counted = events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    w = F.session_window(ts, gap)
    counted = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def changes(snapshots: DataFrame) -> DataFrame:
    """(path, mtime, change) from a stream of (path, mtime, poll, present): added, modified or deleted since the last
    poll; the first poll only seeds. State is one row a path."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        out = []
        for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.poll):
            now = int(row.mtime) if row.present else None
            if row.poll > 0 and now != known:
                kind = "deleted" if now is None else "added" if known is None else "modified"
                out.append((key[0], known if now is None else now, kind))
            known = now
        if known is None:
            state.remove()
        else:
            state.update((known,))
        yield pd.DataFrame(out, columns=["path", "mtime", "change"])

    return snapshots.groupBy("path").applyInPandasWithState(
        step, "path string, mtime bigint, change string", "mtime bigint", "append", GroupStateTimeout.NoTimeout
    )


def notify(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Give every batch of changes to a handler; it sees a batch again after a failure."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Applied:
    """Results of batches in a shared folder, each visible once it is whole, and once however often it is replayed.

    A batch is written to a folder of its own, which a replay overwrites, and then marked. Readers take marked batches alone; the
    version is the greatest of these, so a table that is held by version is read again only when a batch was added.
    """

    def __init__(self, spark: SparkSession, place: str, schema: str):
        self.spark, self.place, self.schema = spark, place, schema
        self._held: tuple[int, DataFrame] | None = None

    def _path(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        path, fs = self._path("applied")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        return max(self.batches(), default=-1)

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Write and mark a batch; False if it was applied before."""
        if batch in self.batches():
            return False
        rows.write.mode("overwrite").parquet(f"{self.place}/rows/{batch}")
        path, fs = self._path(f"applied/{batch}")
        fs.mkdirs(path)
        return True

    def read(self) -> DataFrame:
        """All rows of marked batches; the same DataFrame until the version changes."""
        found = self.batches()
        version = max(found, default=-1)
        if self._held is None or self._held[0] != version:
            paths = [f"{self.place}/rows/{x}" for x in found]
            reader = self.spark.read.schema(self.schema)
            self._held = (version, reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema))
        return self._held[1]


def notify_once(stream: DataFrame, applied: Applied, checkpoint: str, after: Callable[[int], None] | None = None):
    """Apply every batch of changes once, also when a batch is seen again after a failure. `after` is told of each that was added."""

    def handle(rows: DataFrame, batch: int) -> None:
        if applied.add(rows, batch) and after:
            after(batch)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
