"""Proportional stratified interleaving of rows into shards.

Rows of a stratum (``source``) are shuffled by a seeded hash and ranked; the
fractional rank (rank + 1/2) / size orders all rows; that order is cut into
shards whose row counts differ by one at most, so every shard holds each
stratum in proportion.  Law: ``rows``.  Both ranks are found by range
partitioning, so a stratum with a third of all rows spreads over many tasks.

Defined results: a null source is a stratum of its own; a null text is empty;
rows with equal keys (repeated rows, null ids) all get a slot of their own, in
arbitrary order; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_rank, tune

SEED, SHARDS = 17, 16


def interleave(df: DataFrame, key: str = "doc_id", stratum: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with shard (0 to shards - 1) and slot (gapless in the shard).

    Columns of ``df`` named shard or slot are replaced."""
    spark = df.sparkSession
    tune(spark)
    scratch = Scratch(spark, "shard")
    df = df.drop("shard", "slot")
    keep = df.columns
    df = df.withColumn("__s", F.when(F.col(stratum).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(stratum).cast("string"))))
    df = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    one = global_rank(df, ["__h"], scratch, group="__s", out="__r")
    sizes = df.groupBy("__s").agg(F.count(F.lit(1)).alias("__c")).withColumnRenamed("__s", "__s2")
    one = one.join(sizes, one["__s"] == F.col("__s2")).withColumn("__f", (F.col("__r") * 2 + 1) / (F.col("__c") * 2))
    two = global_rank(one.select(*keep, "__f", "__h", "__s"), ["__f", "__h", "__s"], scratch, out="__p")
    total = two.agg(F.count(F.lit(1)).alias("__t"))
    two = two.crossJoin(F.broadcast(total))  # one row
    two = two.withColumn("shard", F.expr(f"(__p * {shards}) div __t").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * __t + {shards - 1}) div {shards}")
    return two.select(*keep, "shard", (F.col("__p") - first).alias("slot"))
