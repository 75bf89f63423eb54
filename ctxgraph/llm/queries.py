"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, media, packing, quality, sharding, simhash, suffix, transcripts, warc
from .common import read_table


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: each vector of ``embeddings`` is drawn as one,
    so near copies among the vectors are edited copies among the pictures."""
    return media.copies(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", media.drawn)


def op2_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in mixed styles are made of the table's turns; the roles that
    parsing recovers stand beside those given."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = transcripts.transcribe(turns)
    model = transcripts.fit(made.where(transcripts.in_training(F.col("conv_id"))))
    pieces = transcripts.parse(made, model)
    return pieces.select(
        "conv_id", "turn", "segment", "role", "starts", "marker", F.char_length("text").cast("long").alias("n_chars"),
        F.crc32(F.col("rendered").cast("binary")).alias("rendered_crc32"), (~transcripts.in_training(F.col("conv_id"))).alias("held_out"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on the rows whose labels may be learned."""
    labels = read_table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return quality.fit(docs, labels)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.dedup(docs, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_media_copies": op1_media_copies,
    "op2_transcripts": op2_transcripts,
    "op3_license_scan": op3_license_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
}
ORACLE_SQL = {
    "op3_license_scan": license_scan.oracle(),
    "op4_decontaminate": decontaminate.oracle(),
    "op8_warc": warc.ORACLE,
}
