"""Tables in the shared folder: they cut the lineage of iterative plans.

A table written there outlives any executor, unlike a local checkpoint.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + os.path.join(tempfile.gettempdir(), "ctxgraph-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(kept: DataFrame) -> None:
    """Delete the files of a kept table, which nothing may read any more."""
    spark = kept.sparkSession
    root = shared_folder(spark)
    for name in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if root.split(":", 1)[-1].strip("/") in name:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def deal(files: DataFrame, key: str = "path") -> DataFrame:
    """``files`` over as many tasks as a shuffle has: a small table comes as one
    part or a few, and what follows costs far more than its reading."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
