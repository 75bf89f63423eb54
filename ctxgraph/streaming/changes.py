"""Change feeds: micro-batches of file events and of keyed events.

A batch is reduced to the last event per key before it meets the state, and the
state is a table that a batch replaces as a whole, so a batch that runs again
(after a lost executor or a restart) gives the same state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import shared_folder
from ..sources.config import Config
from ..sources.workspace import excluded, language


def last_per_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; a map-side combined maximum."""
    rest = [c for c in events.columns if c != key and c not in order]
    best = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in events.columns if c != key]).select(*events.columns)


class State:
    """The last row per key, one folder a version under the shared folder."""

    def __init__(self, spark: SparkSession, key: str, order: list[str], root: str | None = None):
        self.spark, self.key, self.order = spark, key, order
        self.root = root or f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
        self.batch: int | None = None

    def read(self) -> DataFrame | None:
        return None if self.batch is None else self.spark.read.parquet(f"{self.root}/b{self.batch}")

    def merge(self, batch: DataFrame, number: int) -> None:
        new = last_per_key(batch, self.key, self.order)
        old = self.read() if self.batch is not None and self.batch != number else None
        if old is not None:
            new = last_per_key(old.unionByName(new), self.key, self.order)
        new.write.mode("overwrite").parquet(f"{self.root}/b{number}")
        self.batch = number


def latest(spark: SparkSession, folder: str, pattern: str, schema, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Drain a folder of Parquet files as a stream (``availableNow``) into a
    State; the last row of each key."""
    state = State(spark, key, order)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 100).parquet(folder)
    run = stream.select(*columns).writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{state.root}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    got = state.read()
    return got if got is not None else spark.createDataFrame([], schema).select(*columns)


def relevant(events: DataFrame, config: Config = Config()) -> DataFrame:
    """Events of files that a watch lets pass: known extensions (dotenv files do
    not pass), no excluded folder."""
    kind = language(F.col("path"))
    return events.where(kind.isNotNull() & (kind != "dotenv") & ~excluded(F.col("path"), config.exclude_patterns))


def changed(events: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of a batch's last event per path: changed or deleted;
    an equal modification time drops the event."""
    last = last_per_key(events.select("path", "mtime_ns", "deleted", "seq"), "path", ["seq"])
    known = files.select("path", F.col("mtime_ns").alias("known"))
    status = F.when(F.col("deleted"), "deleted").otherwise("changed")
    return last.join(known, "path", "left").where(F.col("deleted") | F.col("known").isNull() | (F.col("known") != F.col("mtime_ns"))).select("path", status.alias("status"))


def watch(stream: DataFrame, apply, checkpoint: str, config: Config = Config()):
    """Start a query that calls ``apply(paths, number)`` for each micro-batch of
    relevant file events, at the configured debounce interval."""

    def batch(df: DataFrame, number: int) -> None:
        apply(last_per_key(relevant(df, config), "path", ["seq"]), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{config.watcher_debounce_ms} milliseconds").start()
