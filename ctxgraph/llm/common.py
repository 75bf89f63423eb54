"""Shared pieces of the training-data operators.

* :class:`Scratch` writes intermediate tables to the shared folder named by
  ``spark.checkpoint.dir``; reading them back cuts the lineage and survives the
  loss of any executor.
* :func:`global_rank` gives gapless ranks without one large task.
* :func:`connected_components` finds components of an edge table with
  alternating star contractions; it never collects an edge.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tune(spark: SparkSession) -> int:
    """Bound Arrow batches by bytes; return the number of shuffle partitions."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where the session
    names none (tests), a folder of our own, which is then set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + os.path.join(tempfile.gettempdir(), "ctxgraph-scratch")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffle files that no plan refers to any more: Spark deletes them
    when the driver collects its garbage, which a large heap puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """A folder of intermediate Parquet tables under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n, self._paths = 0, {}

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return the table read back."""
        path = f"{self.root}/t{self._n}"
        self._n += 1
        df.write.option("compression", codec).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = kept, path
        return kept

    def release(self, *tables: DataFrame | None) -> None:
        """Delete kept tables that nothing lazy reads any more."""
        for table in tables:
            if table is not None:
                self._delete(self._paths.pop(id(table))[1])

    def drop(self) -> None:
        """Delete the folder: only when nothing lazy still reads it."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, up, up.lower())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def global_rank(df: DataFrame, order: list[str], scratch: Scratch, group: str | None = None, out: str = "rank") -> DataFrame:
    """Add ``out``: the row's 0-based rank by ``order`` (within ``group``).

    Rows are range-partitioned by (group, order) and sorted, so that a hot
    group is spread over many tasks; only one count per (partition, group) is
    summed up.  ``group`` must not be null; ``order`` should be total, ties get
    an arbitrary but gapless order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group] if group else []) + order
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = scratch.keep(ranged.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    sums = ranged.groupBy(part.alias("__part"), *([F.col(group).alias("__group")] if group else [])).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first")
    )
    # One row per (partition, group): the running sum is over counts, not rows.
    order_by = "PARTITION BY __group ORDER BY __part" if group else "ORDER BY __part"
    before = f"sum(__n) OVER ({order_by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = sums.withColumn("__before", F.coalesce(F.expr(before), F.lit(0)))
    on = part == F.col("__part")
    if group:
        on = on & (F.col(group) == F.col("__group"))
    ranked = ranged.join(sums, on).withColumn(out, F.col("__before") + F.col("__row") - F.col("__first"))
    return ranked.drop("__row", "__part", "__group", "__n", "__first", "__before")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star contraction (Kiveris et al. 2014):
    O(log^2) rounds, each a map-side combined ``min`` per node and one join, so
    a star of any size is never gathered in a task.  Nodes without an edge to
    another node are not returned.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = scratch.keep(pairs)
    last = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node go to its smallest neighbour.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        big = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.where("a <> b").distinct()
        # Small star: the smaller neighbours of a node go to the smallest.
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low.withColumnRenamed("a", "u"), big.a == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, pairs = pairs, scratch.keep(small.where("a <> b").distinct())
        scratch.release(before)
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                pairs.select(F.col("b"), F.col("b")).distinct()
            )
        last = mark
    raise RuntimeError("components did not settle")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links a-b as star links (member, smallest)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while not (root[root] == root).all():
            root = root[root]
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]
