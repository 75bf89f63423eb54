"""Entity resolution: references to nodes, across files and workspaces.

Resolution is a function of the snapshot: refs stay as they are, so a full and
an incremental run give the same edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .lookup import exported, import_pairs

# Confidence by evidence, and the kinds that an edge prefers.
EXACT, SINGLE, AMBIGUOUS, IMPORTED, PATH, BONUS, MOST, LEAST = 0.95, 0.50, 0.30, 0.85, 0.80, 0.05, 0.99, 0.30
PREFERRED = {
    "calls": ("function", "method"),
    "type_ref": ("struct", "class", "trait", "interface", "type_alias", "enum"),
    "implements": ("trait", "interface"),
    "extends": ("class", "struct"),
}
TYPE_KINDS = ("struct", "class", "interface", "enum", "trait", "type_alias")


def preferred(edge_kind: Column, node_kind: Column) -> Column:
    """Does the node's kind suit the edge's?"""
    out = F.lit(False)
    for edge, kinds in PREFERRED.items():
        out = F.when(edge_kind == edge, node_kind.isin(*kinds)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _nearest(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key a list of (kind, id, file): for each kind of node the two
    smallest ids, which are of two files, so one is left whatever file asks.

    The rank limit cuts each part before the shuffle: a name that a million
    files export sends two rows a part and kind."""
    order = Window.partitionBy(*keys, "node_kind").orderBy("id")
    two = rows.withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    return two.groupBy(*keys).agg(F.collect_list(F.struct(F.col("node_kind").alias("kind"), "id", F.col("target_file_id").alias("file"))).alias("found"))


def _scored(found: Column, base: Column) -> Column:
    """(confidence, ~id) of each candidate of another file: the greatest of them
    has the best confidence and then the smallest id."""
    others = F.filter(F.coalesce(found, F.array()), lambda x: x["file"] != F.col("source_file_id"))
    value = lambda x: F.when(preferred(F.col("edge_kind"), x["kind"]), F.least(base + BONUS, F.lit(MOST))).otherwise(base)
    return F.transform(others, lambda x: F.struct(F.round(value(x), 6).alias("confidence"), F.bitwise_not(x["id"]).alias("order")))


def resolve_refs(refs: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, source_node_id, target_node_id, kind, confidence, context).

    Refs meet the exported nodes of their name in other files, but never as
    pairs: nodes are first reduced to one row per (name, file, kind), and each
    sort of evidence to one row per its key with the best node per kind.

    * none: per name, with the count that tells one candidate from several;
    * import: per (asking file, name), over the files that it imports;
    * path: per (name, end of a path), for ends as long as some import path.

    A ref then picks among a few candidates within its own row (ties: smallest
    node id)."""
    has = set(refs.columns)
    context = F.col("context") if "context" in has else F.lit(None).cast("string")
    qualified = F.col("target_qualified_name") if "target_qualified_name" in has else F.lit(None).cast("string")
    source = nodes.select(F.col("id").alias("source_node_id"), F.col("file_id").alias("source_file_id"))
    r = refs.select(F.col("id").alias("ref_id"), "source_node_id", "target_name", qualified.alias("target_qualified_name"), "edge_kind", X.import_bare(F.col("import_path")).alias("bare"), context.alias("context")).join(source, "source_node_id")
    public = nodes.where(exported(F.col("is_export"), F.col("visibility")))
    named = public.groupBy(F.col("qualified_name").alias("target_qualified_name")).agg(F.max("id").alias("exact_id"))
    r = r.join(named, "target_qualified_name", "left")
    exact = r.where("exact_id is not null").select("ref_id", "source_node_id", F.col("exact_id").alias("target_node_id"), F.col("edge_kind").alias("kind"), F.lit(EXACT).alias("confidence"), "context")
    open_ = r.where("exact_id is null").drop("exact_id", "target_qualified_name")
    held = public.groupBy(F.col("name").alias("target_name"), F.col("file_id").alias("target_file_id"), F.col("kind").alias("node_kind")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))

    total = held.where("target_file_id is not null").groupBy("target_name").agg(F.sum("n").alias("total"))
    own = held.groupBy("target_name", F.col("target_file_id").alias("source_file_id")).agg(F.sum("n").alias("own"))
    plain = total.join(_nearest(held, "target_name").withColumnRenamed("found", "plain"), "target_name")

    pairs = import_pairs(edges, nodes).where("source_file_id <> target_file_id")
    asked = open_.select("source_file_id", "target_name").distinct().join(pairs, "source_file_id")
    imported = asked.join(held, ["target_name", "target_file_id"]).groupBy("source_file_id", "target_name", "node_kind").agg(F.min(F.struct("id", "target_file_id")).alias("m"))
    imported = imported.groupBy("source_file_id", "target_name").agg(F.collect_list(F.struct(F.col("node_kind").alias("kind"), F.col("m.id").alias("id"), F.col("m.target_file_id").alias("file"))).alias("imported"))

    wanted = open_.where("bare <> ''").select("target_name", "bare").distinct()
    sizes = wanted.agg(F.collect_set(F.length("bare")).alias("sizes"))  # one row, of as many lengths as import paths have
    stems = files.select(F.col("id").alias("target_file_id"), X.path_stem(F.col("path")).alias("stem"))
    ends = held.join(stems, "target_file_id").crossJoin(F.broadcast(sizes))
    ends = ends.withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("stem"))))
    ends = ends.withColumn("bare", F.substring(F.col("stem"), F.length("stem") - F.col("size") + 1, F.col("size")))
    ends = ends.join(wanted, ["target_name", "bare"], "left_semi")
    placed = _nearest(ends, "target_name", "bare").withColumnRenamed("found", "placed")

    met = open_.join(plain, "target_name").join(own, ["target_name", "source_file_id"], "left").join(imported, ["source_file_id", "target_name"], "left").join(placed, ["target_name", "bare"], "left")
    base = F.when(F.col("total") - F.coalesce("own", F.lit(0)) > 1, AMBIGUOUS).otherwise(SINGLE)
    all_ = F.concat(_scored(F.col("plain"), base), _scored(F.col("imported"), F.lit(IMPORTED)), _scored(F.col("placed"), F.lit(PATH)))
    met = met.withColumn("best", F.array_max(all_)).where(F.col("best.confidence") > LEAST)
    return exact.unionByName(met.select("ref_id", "source_node_id", F.bitwise_not("best.order").alias("target_node_id"), F.col("edge_kind").alias("kind"), "best.confidence", "context"))


def resolve_cross_workspace(refs: DataFrame, workspaces: dict[str, DataFrame]) -> DataFrame:
    """(ref_id, source_node_id, target_workspace, target_qualified_name,
    kind, confidence); a ref found in two workspaces gives two rows.

    The qualified name comes first, then an exported name; of several nodes the
    smallest id."""
    has = set(refs.columns)
    qualified = F.col("target_qualified_name") if "target_qualified_name" in has else F.lit(None).cast("string")
    r = refs.select(F.col("id").alias("ref_id"), "source_node_id", "target_name", qualified.alias("wanted"), "edge_kind")
    out = None
    for name, nodes in workspaces.items():
        label = F.coalesce("qualified_name", "name")
        by_name = nodes.where(exported(F.col("is_export"), F.col("visibility"))).groupBy(F.col("name").alias("target_name")).agg(F.min(F.struct("id", label.alias("q")))["q"].alias("by_name"))
        by_qualified = nodes.where("qualified_name is not null").groupBy(F.col("qualified_name").alias("wanted")).agg(F.min("id").alias("found"))
        hit = r.join(by_name, "target_name", "left").join(by_qualified, "wanted", "left")
        target = F.when(F.col("found").isNotNull(), F.col("wanted")).otherwise(F.col("by_name"))
        hit = hit.withColumn("target_qualified_name", target).where("target_qualified_name is not null")
        hit = hit.select("ref_id", "source_node_id", F.lit(name).alias("target_workspace"), "target_qualified_name", F.col("edge_kind").alias("kind"), F.when(F.col("wanted").isNotNull(), 0.85).otherwise(0.7).alias("confidence"))
        out = hit if out is None else out.unionByName(hit)
    return out


def shared_types(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Type-like nodes referenced from ``least`` files or more."""
    source = nodes.select(F.col("id").alias("source_node_id"), F.col("file_id").alias("source_file_id"))
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("target_node_id"), "name")
    met = edges.select("source_node_id", "target_node_id").join(types, "target_node_id").join(source, "source_node_id")
    return met.groupBy(F.col("target_node_id").alias("id"), "name").agg(F.countDistinct("source_file_id").alias("file_count")).where(F.col("file_count") >= least)


def mark_shared(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """Metadata of the shared nodes says so."""
    flag = shared.select("id", F.lit(True).alias("__shared"))
    own = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rest = F.map_filter(own, lambda k, v: k != "shared_type")
    return nodes.join(flag, "id", "left").withColumn("metadata", F.when(F.col("__shared"), F.map_concat(rest, F.create_map(F.lit("shared_type"), F.lit("true")))).otherwise(F.col("metadata"))).drop("__shared")


def submit_edges(nodes: DataFrame, submitted: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(source_node_id, target_node_id, kind, confidence) of submitted
    (source, target, kind) whose names are both known; unknown kinds are calls."""
    kinds = ("calls", "imports", "implements", "extends", "type_ref", "contains", "reads_env", "defines_api")
    first = nodes.where("qualified_name is not null").groupBy("qualified_name").agg(F.min("id").alias("id"))
    s = first.select(F.col("qualified_name").alias("source"), F.col("id").alias("source_node_id"))
    t = first.select(F.col("qualified_name").alias("target"), F.col("id").alias("target_node_id"))
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("calls")
    return submitted.join(s, "source").join(t, "target").select("source_node_id", "target_node_id", kind.alias("kind"), F.lit(confidence).alias("confidence"))


def structural_diff(old: DataFrame, new: DataFrame, near: int = 5) -> DataFrame:
    """(file_id, kind, name, change, old_name).

    Keys are (file, kind, name), first entry by line; a new key is a rename of
    the old-only one of its kind that starts within ``near`` lines, one to one:
    the pair that is each other's nearest (by distance, then name) is taken."""
    def first(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy("file_id", "kind", "name").orderBy("line_start", F.col("signature").asc_nulls_first())
        one = df.withColumn("__n", F.row_number().over(w)).where("__n = 1")
        return one.select("file_id", "kind", "name", F.col("signature").alias(f"{side}_sig"), F.col("line_start").alias(f"{side}_line"))

    both = first(old, "old").join(first(new, "new"), ["file_id", "kind", "name"], "full_outer")
    changed = both.where("old_line is not null AND new_line is not null AND NOT (old_sig <=> new_sig)").select("file_id", "kind", "name", F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_name"))
    gone = both.where("new_line is null").select("file_id", "kind", F.col("name").alias("old_name"), "old_line")
    come = both.where("old_line is null").select("file_id", "kind", "name", "new_line")
    pairs = come.join(gone, ["file_id", "kind"]).withColumn("gap", F.abs(F.col("new_line") - F.col("old_line"))).where(F.col("gap") <= near)
    w1 = Window.partitionBy("file_id", "kind", "name").orderBy("gap", "old_name")
    w2 = Window.partitionBy("file_id", "kind", "old_name").orderBy("gap", "name")
    taken = pairs.withColumn("a", F.row_number().over(w1)).withColumn("b", F.row_number().over(w2)).where("a = 1 AND b = 1")
    renamed = taken.select("file_id", "kind", "name", F.lit("renamed").alias("change"), "old_name")
    added = come.join(renamed.select("file_id", "kind", "name"), ["file_id", "kind", "name"], "left_anti").select("file_id", "kind", "name", F.lit("added").alias("change"), F.lit(None).cast("string").alias("old_name"))
    left = gone.join(renamed.select("file_id", "kind", "old_name"), ["file_id", "kind", "old_name"], "left_anti")
    removed = left.select("file_id", "kind", F.col("old_name").alias("name"), F.lit("removed").alias("change"), F.lit(None).cast("string").alias("old_name"))
    return changed.unionByName(renamed).unionByName(added).unionByName(removed)
