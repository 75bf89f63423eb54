"""Structured lookups over files, nodes, edges, refs and sessions.

Each function returns a lazy DataFrame; filters stand on the base tables, so
they reach the scans, and every limit has a total order.  Equality on an id
list is a left semi join, "either end of an edge" a union, never an OR join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE_ORDERS = {
    "path": lambda: [F.col("path")],
    "size": lambda: [F.col("size_bytes").desc(), F.col("path")],
    "tokens": lambda: [F.col("token_count").desc_nulls_last(), F.col("path")],
    "modified": lambda: [F.col("indexed_at").desc_nulls_last(), F.col("path")],
}


def exported(is_export: Column, visibility: Column) -> Column:
    """marked as exported, or of public visibility."""
    return F.coalesce(is_export, F.lit(False)) | F.coalesce(visibility.isin("pub", "public"), F.lit(False))


def like_any(text: str, name: Column, qualified: Column, signature: Column, path: Column) -> Column:
    """any word of two bytes or more in any of four columns; if there is no
    such word, the whole text in three of them."""
    words = [w for w in text.split() if len(w.encode()) > 1]
    columns = [name, qualified, signature, path] if words else [name, qualified, path]
    tests = [F.coalesce(c.ilike(f"%{w}%"), F.lit(False)) for w in (words or [text]) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def query_nodes(nodes: DataFrame, files: DataFrame, kind: str | None = None, file_path: str | None = None, visibility: str | None = None, exported_only: bool = False, text: str | None = None, limit: int = 50, pagerank: DataFrame | None = None) -> DataFrame:
    """Nodes by filters, in order of path, line and id."""
    out = filter_nodes(nodes, files, kind, file_path, visibility, exported_only)
    if text is not None:
        out = out.where(like_any(text, F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("path")))
    if pagerank is not None:
        out = out.join(pagerank.select(F.col("id"), F.col("rank").alias("pagerank")), "id", "left")
    names = ["id", "kind", "name", "qualified_name", "signature", "visibility", "is_export", "path", "line_start", "line_end", *(["pagerank"] if pagerank is not None else [])]
    return out.orderBy("path", "line_start", "id").limit(limit).select(*names)


def filter_nodes(nodes: DataFrame, files: DataFrame, kind: str | None = None, file_path: str | None = None, visibility: str | None = None, exported_only: bool = False) -> DataFrame:
    """nodes by filters with path and language of their files, in no order."""
    if kind is not None:
        nodes = nodes.where(F.col("kind") == kind)
    if visibility is not None:
        nodes = nodes.where(F.col("visibility") == visibility)
    if exported_only:
        nodes = nodes.where(F.coalesce("is_export", F.lit(False)))
    files = files.select(F.col("id").alias("file_id"), "path", "language")
    if file_path is not None:
        files = files.where(F.col("path").ilike(f"%{file_path}%"))
    return nodes.join(files, "file_id")


def query_edges(edges: DataFrame, nodes: DataFrame, files: DataFrame, symbol: str | None = None, kind: str | None = None, min_confidence: float | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
    """Edges with the names and paths of both ends, best first."""
    if kind is not None:
        edges = edges.where(F.col("kind") == kind)
    if min_confidence is not None:
        edges = edges.where(F.col("confidence") >= min_confidence)
    place = files.select(F.col("id").alias("file_id"), "path")
    ends = nodes.select("id", "name", "qualified_name", "file_id").join(place, "file_id")
    source = ends.select(F.col("id").alias("source_node_id"), F.col("name").alias("source_name"), F.col("qualified_name").alias("sq"), F.col("path").alias("source_path"))
    target = ends.select(F.col("id").alias("target_node_id"), F.col("name").alias("target_name"), F.col("qualified_name").alias("tq"), F.col("path").alias("target_path"))
    out = edges.join(source, "source_node_id").join(target, "target_node_id")
    if symbol is not None:
        is_source = (F.col("source_name") == symbol) | F.coalesce(F.col("sq") == symbol, F.lit(False))
        is_target = (F.col("target_name") == symbol) | F.coalesce(F.col("tq") == symbol, F.lit(False))
        out = out.where({"outgoing": is_source, "incoming": is_target}.get(direction, is_source | is_target))
    order = [F.col("confidence").desc(), "source_node_id", "target_node_id", "kind", F.col("context").asc_nulls_first()]
    return out.orderBy(*order).limit(limit).select("source_node_id", "source_name", "source_path", "target_node_id", "target_name", "target_path", "kind", "confidence", "context")


def list_files(files: DataFrame, language: str | None = None, sort_by: str = "path", limit: int = 100) -> DataFrame:
    """An unknown order is by path."""
    if language is not None:
        files = files.where(F.col("language") == language)
    return files.orderBy(*FILE_ORDERS.get(sort_by, FILE_ORDERS["path"])()).limit(limit)


def unresolved_refs(refs: DataFrame, nodes: DataFrame, files: DataFrame, file_path: str | None = None, limit: int = 50) -> DataFrame:
    """Refs with their source and its file, by path, name and id."""
    files = files.select(F.col("id").alias("file_id"), "path")
    if file_path is not None:
        files = files.where(F.col("path").ilike(f"%{file_path}%"))
    source = nodes.select(F.col("id").alias("source_node_id"), F.col("name").alias("source_name"), "file_id")
    out = refs.join(source, "source_node_id").join(files, "file_id")
    return out.orderBy("path", "target_name", "id").limit(limit).select("id", "source_name", "path", "target_name", "edge_kind", "import_path")


def sessions_with_counts(sessions: DataFrame, observations: DataFrame, limit: int = 20) -> DataFrame:
    """The counts are made before the join; none is zero."""
    counts = observations.groupBy(F.col("session_id").alias("id")).agg(F.count("id").alias("n"))
    out = sessions.join(counts, "id", "left").withColumn("observation_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return out.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def index_status(files: DataFrame, nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(metric, value) rows, the files of each language among them."""
    parts = [t.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("metric"), "value") for n, t in (("files", files), ("nodes", nodes), ("edges", edges), ("unresolved_refs", refs))]
    by = files.groupBy("language").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("language:"), "language").alias("metric"), "value")
    return reduce(DataFrame.unionByName, [*parts, by])


def node_counts(nodes: DataFrame) -> DataFrame:
    """A02."""
    return nodes.groupBy("file_id").agg(F.count(F.lit(1)).alias("node_count"))


def average_confidence(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Over the edges at either end; a self loop counts twice."""
    ends = edges.select(F.col("source_node_id").alias("node_id"), "confidence").unionAll(edges.select(F.col("target_node_id").alias("node_id"), "confidence"))
    if ids is not None:
        ends = ends.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return ends.groupBy("node_id").agg(F.avg("confidence").alias("avg_confidence"))


def env_vars(nodes: DataFrame, edges: DataFrame, kind: str = "env_var", edge_kind: str = "reads_env") -> DataFrame:
    """Distinct readers by name; the filter on the edges comes
    before the outer join."""
    reads = edges.where(F.col("kind") == edge_kind).select("source_node_id", F.col("target_node_id").alias("id"))
    named = nodes.where(F.col("kind") == kind).select("id", "name")
    out = named.join(reads, "id", "left").groupBy("name").agg(F.countDistinct("source_node_id").alias("reader_count"))
    return out.orderBy(F.col("reader_count").desc(), "name")


def env_lineage(nodes: DataFrame, edges: DataFrame, files: DataFrame, variable: str) -> DataFrame:
    """Definitions and readers of one variable, as rows with a role."""
    place = files.select(F.col("id").alias("file_id"), "path")
    own = nodes.where((F.col("kind") == "env_var") & (F.col("name") == variable))
    defined = own.join(place, "file_id").where(F.element_at("metadata", "defined_in").isNotNull()).select(F.lit("defines").alias("role"), "name", "path", "line_start")
    reads = edges.where(F.col("kind") == "reads_env").join(own.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi")
    readers = nodes.join(reads.select(F.col("source_node_id").alias("id")).distinct(), "id", "left_semi").join(place, "file_id")
    return defined.unionByName(readers.select(F.lit("reads").alias("role"), "name", "path", "line_start"))


def import_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (importing file, imported file)."""
    source = nodes.select(F.col("id").alias("source_node_id"), F.col("file_id").alias("source_file_id"))
    target = nodes.select(F.col("id").alias("target_node_id"), F.col("file_id").alias("target_file_id"))
    return edges.where("kind = 'imports'").join(source, "source_node_id").join(target, "target_node_id").select("source_file_id", "target_file_id").distinct()


def nodes_of(nodes: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes of an id list with their paths."""
    return nodes.join(ids.select("id"), "id", "left_semi").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with either end in the list, each row once."""
    at_source = edges.join(ids.select(F.col("id").alias("source_node_id")), "source_node_id", "left_semi")
    at_target = edges.join(ids.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi")
    only_target = at_target.join(ids.select(F.col("id").alias("source_node_id")), "source_node_id", "left_anti")
    return at_source.unionByName(only_target)


def first_named(nodes: DataFrame, name: str) -> DataFrame:
    """the first node (smallest id) of a name or qualified name."""
    return nodes.where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy("id").limit(1)


def file_summary(nodes: DataFrame, file_id: int) -> DataFrame:
    """F10."""
    return nodes.where(F.col("file_id") == file_id).select("kind", "name", "signature", "line_start", "line_end").orderBy("line_start", "name")


def missing_skeletons(files: DataFrame, level: str) -> DataFrame:
    """F09."""
    return files.where(F.col(f"skeleton_{level}").isNull())


def _shift(c: Column, k: Column) -> Column:
    return F.call_function("shiftright", c.cast("bigint"), k)


def enclosing_nodes(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each (id, file_id, line) the innermost node around the line.

    The smallest span wins (ties: smallest node id).  Nodes and lines of a file
    never meet as pairs: a node's lines are cut into aligned blocks of 2^level
    lines, two a level at most, and each block keeps its best node; a line is in
    one block a level, so the (file, line)s that are asked for, once each, look
    up as many blocks as there are levels."""
    n = nodes.where("line_start <= line_end AND file_id IS NOT NULL").select("file_id", F.col("line_start").cast("bigint").alias("a"), F.col("line_end").cast("bigint").alias("b"), F.col("id").alias("node_id"))
    n = n.groupBy("file_id", "a", "b").agg(F.min("node_id").alias("node_id"))
    # The blocks of level k lie between low, a / 2^k rounded up, and high, (b + 1) / 2^k rounded down.
    top = F.floor(F.log2((F.col("b") - F.col("a") + 1).cast("double"))).cast("int")
    at = n.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    at = at.withColumns({"low": -_shift(-F.col("a"), F.col("level")), "high": _shift(F.col("b") + 1, F.col("level"))}).where("low < high")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    ends = F.filter(F.array(F.when(odd("low"), F.col("low")), F.when(odd("high"), F.col("high") - 1)), lambda x: x.isNotNull())
    best = lambda span: F.min(F.struct(span.alias("span"), F.col("node_id").alias("node_id"))).alias("best")
    blocks = at.select("file_id", "level", F.explode(ends).alias("block"), (F.col("b") - F.col("a")).alias("span"), "node_id").groupBy("file_id", "level", "block").agg(best(F.col("span")))
    levels = n.agg(F.coalesce(F.max(top), F.lit(0)).alias("top"))  # one row
    lines = places.where("line IS NOT NULL").select("file_id", "line").distinct().crossJoin(F.broadcast(levels)).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    lines = lines.select("file_id", "line", "level", _shift(F.col("line"), F.col("level")).alias("block"))
    found = lines.join(blocks, ["file_id", "level", "block"]).groupBy("file_id", "line").agg(F.min("best")["node_id"].alias("node_id"))
    return places.select("id", "file_id", "line").distinct().join(found, ["file_id", "line"]).select("id", "file_id", "line", "node_id")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
