"""Extraction of symbols, edges and refs from source files.

One extractor per language with one signature; files go through Arrow batches
in a single pass, and nodes, edges and refs are exploded from its result.  Ids
are hashes of (path, ordinal), so a file gives the same ids in every run.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...plans.scratch import deal
from . import c_family, markup, python_lang, rust, typescript
from .records import Extracted

EXTRACTORS = {
    "python": python_lang.extract,
    "typescript": lambda p, s: typescript.extract(p, s, "typescript"),
    "javascript": lambda p, s: typescript.extract(p, s, "javascript"),
    "rust": rust.extract,
    "c": lambda p, s: c_family.extract(p, s, "c"),
    "cpp": lambda p, s: c_family.extract(p, s, "cpp"),
    "html": markup.extract_html,
    "dotenv": markup.extract_dotenv,
}
RAW = "path string, nodes string, edges string, refs string"
NODE = "array<struct<kind:string,name:string,qualified_name:string,signature:string,docstring:string,line_start:bigint,line_end:bigint,visibility:string,is_export:boolean,metadata:map<string,string>>>"
EDGE = "array<struct<source:int,target:int,kind:string,confidence:double,context:string>>"
REF = "array<struct<source:int,target_name:string,edge_kind:string,import_path:string,context:string>>"


def extract(language: str, path: str, source: str) -> Extracted:
    """The extraction of one file; an unknown language gives nothing."""
    return EXTRACTORS.get(language, lambda p, s: Extracted(p))(path, source or "")


def extract_files(files: DataFrame) -> DataFrame:
    """``files(path, language, content)`` -> path and arrays nodes, edges, refs."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = extract(language, path, content)
                rows.append((path, json.dumps(got.nodes), json.dumps(got.edges), json.dumps(got.refs)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["path", "nodes", "edges", "refs"])

    raw = deal(files.select("path", "language", "content")).mapInArrow(run, RAW)
    return raw.select("path", F.from_json("nodes", NODE).alias("nodes"), F.from_json("edges", EDGE).alias("edges"), F.from_json("refs", REF).alias("refs"))


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and refs with ids.  Edges whose end is missing go."""
    file_id = F.xxhash64("path")
    node_id = lambda pos: F.xxhash64(F.col("path"), pos)
    n = extracted.select("path", file_id.alias("file_id"), F.posexplode("nodes").alias("pos", "n"))
    nodes = n.select(node_id(F.col("pos")).alias("id"), "file_id", "n.*")
    count = F.size("nodes")
    e = extracted.select("path", count.alias("count"), F.explode("edges").alias("e")).where("e.source < count AND e.target < count")
    edges = e.select(node_id(F.col("e.source")).alias("source_node_id"), node_id(F.col("e.target")).alias("target_node_id"), "e.kind", "e.confidence", "e.context")
    r = extracted.select("path", F.posexplode("refs").alias("pos", "r"))
    refs = r.select(F.xxhash64(F.col("path"), F.lit("ref"), F.col("pos")).alias("id"), node_id(F.col("r.source")).alias("source_node_id"), "r.target_name", "r.edge_kind", "r.import_path", "r.context")
    return nodes, edges, refs


def structure_hash(extracted: DataFrame) -> DataFrame:
    """(path, structure_hash) over sorted nodes and edges."""
    nodes = F.array_sort(F.transform("nodes", lambda n: F.concat_ws("\x01", n["kind"], n["name"], n["signature"], n["line_start"].cast("string"), n["line_end"].cast("string"))))
    edges = F.array_sort(F.transform("edges", lambda e: F.concat_ws("\x01", e["source"].cast("string"), e["target"].cast("string"), e["kind"])))
    return extracted.select("path", F.xxhash64(nodes, edges).alias("structure_hash"))
