"""Indexing a source tree into the next snapshot.

Full and incremental runs are one function: the listing is compared with the
snapshot by time and size, only new and changed files are read and extracted, rows of changed and vanished
files leave with all that hangs on them, and resolution runs over the whole new
snapshot.  So an incremental run gives the snapshot that a full one would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, resolve, search
from ..sources import workspace
from ..sources.config import Config
from ..sources.store import Store, delete_cascade
from .scratch import keep

CONTAINED = ("contains", "reads_env", "defines_api")


def compare(now: DataFrame, files: DataFrame | None) -> DataFrame:
    """(path, status): new, changed, same or deleted, by time and size alone; no
    content is read."""
    now = now.select("path", "mtime_ns", "size_bytes")
    if files is None:
        return now.select("path", F.lit("new").alias("status"))
    old = files.select("path", F.col("mtime_ns").alias("time"), F.col("size_bytes").alias("size"))
    both = now.join(old, "path", "full_outer")
    alike = (F.col("mtime_ns") == F.col("time")) & (F.col("size_bytes") == F.col("size"))
    status = F.when(F.col("time").isNull(), "new").when(F.col("mtime_ns").isNull(), "deleted").when(alike, "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def _postings(nodes: DataFrame, files: DataFrame, new: dict, old: dict | None, gone: DataFrame | None, store: Store) -> DataFrame:
    """The postings of nodes that stay, and those of the files just read."""
    if not old or not store.has("postings"):
        return search.postings(search.node_documents(new["nodes"], new["files"]), search.FIELDS)
    left = old["nodes"].join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("doc"))
    fresh = search.postings(search.node_documents(nodes, files), search.FIELDS)
    return store.read("postings").join(left, "doc", "left_anti").unionByName(fresh)


def index(spark: SparkSession, root: str, store: Store, config: Config = Config(), now: str = "1970-01-01 00:00:00", extra: dict[str, str] | None = None, workspaces: dict[str, DataFrame] | None = None, only: list[str] | None = None) -> dict:
    """Index ``root``, commit, and report counts per status.

    With ``only`` (paths below the root) nothing but these is compared; what
    vanished among them leaves.  A file of another time or size is read; if its
    content is the same it counts as such, and only its time and size change."""
    version = store.version()
    old = {t: store.read(t) for t in ("files", "nodes", "local_edges", "refs")} if version else None
    now_there = workspace.known(spark, root, config, extra)
    before = old["files"].select("path", "mtime_ns", "size_bytes") if old else None
    if only is not None:
        paths = spark.createDataFrame([(p,) for p in dict.fromkeys(only)], "path string")
        now_there = now_there.join(paths, "path", "left_semi")
        before = before.join(paths, "path", "left_semi") if old else None
    status = keep(compare(now_there, before), "status")
    counts = {r[0]: r[1] for r in status.groupBy("status").count().collect()}
    if version and not set(counts) - {"same"}:
        return {"version": version, **counts}
    wanted = now_there.join(status.where("status IN ('new', 'changed')").select("path"), "path", "left_semi")
    fresh = keep(workspace.read(wanted.select("path", "language", "mtime_ns", "size_bytes", "uri")).withColumn("id", F.xxhash64("path")), "fresh")
    if old:
        alike = fresh.join(old["files"].select("path", "content_key"), "path").where(F.xxhash64("content") == F.col("content_key"))
        touched = keep(alike.select("path", F.col("mtime_ns").alias("time"), F.col("size_bytes").alias("size")), "touched")
        moved = touched.count()
        fresh, status = (df.join(touched.select("path"), "path", "left_anti") for df in (fresh, status))
        counts = {"same": 0, **counts, "changed": counts.get("changed", 0)}
        counts["same"], counts["changed"] = counts["same"] + moved, counts["changed"] - moved
        counts = {k: n for k, n in counts.items() if n}
    got = keep(extract.extract_files(fresh), "extracted")
    nodes, edges, refs = extract.tables(got)
    files = fresh.join(extract.structure_hash(got), "path", "left").select(
        "id", "path", "language", "mtime_ns", "size_bytes", "content", F.xxhash64("content").alias("content_key"), F.lower(F.hex(F.xxhash64("content"))).alias("content_hash"),
        F.ceil(F.octet_length("content") / 3.0).cast("long").alias("token_count"), F.lit(now).cast("timestamp").alias("indexed_at"), "structure_hash",
    )
    new = {"files": files, "nodes": nodes, "local_edges": edges, "refs": refs}
    if old:
        gone = status.where("status IN ('changed', 'deleted')").select(F.xxhash64("path").alias("id"))
        left = delete_cascade({"files": old["files"], "nodes": old["nodes"], "edges": old["local_edges"], "refs": old["refs"]}, gone)
        stay = left["files"].join(touched, "path", "left").withColumns({"mtime_ns": F.coalesce("time", "mtime_ns"), "size_bytes": F.coalesce("size", "size_bytes")}).drop("time", "size")
        kept = {"files": stay, "nodes": left["nodes"], "local_edges": left["edges"], "refs": left["refs"]}
        new = {t: keep(kept[t].unionByName(new[t]), t) for t in new}
    else:
        new = {t: keep(df, t) for t, df in new.items()}
    found = resolve.resolve_refs(new["refs"], new["nodes"], new["local_edges"], new["files"])
    every = new["local_edges"].unionByName(found.select("source_node_id", "target_node_id", "kind", "confidence", "context"))
    if old and store.has("submitted_edges"):
        given = store.read("submitted_edges")
        for end in ("source_node_id", "target_node_id"):  # of nodes that are still there
            given = given.join(new["nodes"].select(F.col("id").alias(end)), end, "left_semi")
        new["submitted_edges"] = keep(given, "submitted")
        every = every.unionByName(new["submitted_edges"])
    new["edges"] = keep(every, "edges")
    new["postings"] = keep(_postings(nodes, files, new, old, gone if old else None, store), "postings")
    new["corpus"] = search.corpus(new["postings"])
    if workspaces:
        open_ = new["refs"].join(found.select(F.col("ref_id").alias("id")), "id", "left_anti")
        new["cross_workspace_edges"] = resolve.resolve_cross_workspace(open_, workspaces)
    shared = resolve.shared_types(new["nodes"], new["edges"])
    new["nodes"] = resolve.mark_shared(new["nodes"], shared)
    return {"version": store.commit(new), **counts}
