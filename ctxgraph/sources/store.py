"""Immutable snapshots: a folder of Parquet tables per version and a pointer.

A commit writes a new version and then the pointer, so readers see the old or
the new snapshot and never a half.  Updates are joins: what a delta replaces
leaves by an anti join, what it brings comes by a union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import write_postings


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The committed version; 0 if there is none."""
        path, fs = self._pointer()
        if not fs.exists(path):
            return 0
        return int(self.spark.read.text(f"{self.root}/CURRENT").first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version or self.version()}/{table}")

    def has(self, table: str) -> bool:
        """Is the table in the committed version?"""
        path, fs = self._pointer()
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{self.version()}/{table}")
        return fs.exists(at)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next version, then move the pointer.
        Postings are written in their buckets."""
        new = self.version() + 1
        for name, df in tables.items():
            if name == "postings":
                write_postings(df, f"{self.root}/v{new}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{self.root}/v{new}/{name}")
        path, fs = self._pointer()
        out = fs.create(path, True)
        out.writeBytes(f"{new}\n")
        out.close()
        return new


def upsert(snapshot: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the delta replace rows of their key."""
    return snapshot.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Files of ``gone(id)`` and all that hangs on them: nodes of the files,
    edges with either end there, refs, links."""
    out = dict(tables)
    out["files"] = tables["files"].join(gone.select("id"), "id", "left_anti")
    out["nodes"] = tables["nodes"].join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    lost = tables["nodes"].join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    for name, ends in {"edges": ("source_node_id", "target_node_id"), "refs": ("source_node_id",), "observation_symbols": ("node_id",), "cross_workspace_edges": ("source_node_id",)}.items():
        if name in tables:
            for end in ends:
                out[name] = out[name].join(lost.select(F.col("id").alias(end)), end, "left_anti")
    if "observation_files" in tables:
        out["observation_files"] = tables["observation_files"].join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return out
