"""Registered queries of the engine, each over whole tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import context, graph, lookup, memory, resolve, search
from .oracles import ORACLE_SQL  # noqa: F401
from .plans.scratch import keep, shared_folder
from .sources.config import Config
from .sources.views import Views

TEXT, NOW, SYMBOL = "the erbleou of anshe", "2024-03-01 00:00:00", "ASIA"
NODE_TEXT = "blue steel part"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    QUERIES[f.__name__].__doc__ = f.__doc__
    return f


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


_KEPT: dict[tuple, object] = {}


def _once(v: Views, name: str, make):
    """What an engine keeps beside its snapshot, made once per application and
    folder: later queries read it."""
    key = (v.spark.sparkContext.applicationId, shared_folder(v.spark), v.folder, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _ranks(v: Views) -> DataFrame:
    return _once(v, "ranks", lambda: graph.pagerank(v.v_nodes, v.v_edges))


def _index(v: Views, name: str, docs: DataFrame, fields: list[str]) -> search.Index:
    return _once(v, name, lambda: search.build_index(docs, fields, f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"))


def _content_index(v: Views) -> search.Index:
    return _index(v, "content_index", v.v_files.select("id", "content"), ["content"])


def _node_index(v: Views) -> search.Index:
    return _index(v, "node_index", search.node_documents(v.v_nodes, v.v_files), search.FIELDS)


# Retrieval


@query
def bm25_topk(v: Views) -> DataFrame:
    """R01, R02, T01 over the documents."""
    hits = _content_index(v).top(X.Query((("anshe",), ("theaea",), ("re", "eroundth"))), 20).withColumnRenamed("doc", "id")
    return _r(v.v_files.select("id", "path").join(hits, "id"), "bm25")


@query
def bm25_filtered(v: Views) -> DataFrame:
    """Names and paths only, filtered by kind and path after the scores,
    whose statistics are those of the whole index."""
    scored = _node_index(v).bm25(X.parse_or("steel supplier widget src1"), ["name", "qualified_name", "tokenized_name", "tokenized_qualified_name", "path"])
    nodes = lookup.filter_nodes(v.v_nodes, v.v_files, kind="function", file_path="src1")
    return _r(search.top(nodes.join(scored.withColumnRenamed("doc", "id"), "id"), 50).select("id", "name", "path", "bm25"), "bm25")


@query
def bm25_cascade(v: Views) -> DataFrame:
    """R04, X03, X04."""
    return _r(_content_index(v).cascade("theaea_re anshe", 40).select(F.col("doc").alias("id"), "bm25"), "bm25")


@query
def like_fallback(v: Views) -> DataFrame:
    """R05, F02."""
    return search.like_fallback(search.node_documents(v.v_nodes, v.v_files), "arge-x upplie 0001", 40).select("id", "name", "path", "bm25")


@query
def hybrid_score(v: Views) -> DataFrame:
    """R06, R08, A03, A08, X06, X07, X11 over nodes."""
    out = search.hybrid(v.v_nodes, v.v_files, v.v_edges, _ranks(v), "supplier EUROPE module", "explore", 15, index=_node_index(v))
    return _r(out.select("id", "name", "path", "score", "cluster_id"), "score")


@query
def external_merge(v: Views) -> DataFrame:
    """Benchmark items as the nodes of another workspace."""
    nodes = v.benchmark.select(F.col("item_id").alias("id"), F.lit(0).cast("bigint").alias("file_id"), F.lit("function").alias("kind"), F.substring("text", 1, 20).alias("name"), F.col("text").alias("qualified_name"), F.lit(None).cast("string").alias("signature"))
    files = v.region.where("r_regionkey = 0").select(F.lit(0).cast("bigint").alias("id"), F.lit("bench/items.txt").alias("path"))
    out = search.external_hits(nodes, files, "the anshe items", X.INTENT_WEIGHTS["explore"], 10, "bench")
    return _r(out.select("id", "workspace", "score"), "score")


@query
def cluster_labels(v: Views) -> DataFrame:
    """A10 over files by folder."""
    return search.cluster_labels(v.v_files.select("id", "path"))


@query
def detect_intent(v: Views) -> DataFrame:
    """X09, X10 over every turn."""
    w = F.create_map(*[x for k, t in X.INTENT_WEIGHTS.items() for x in (F.lit(k), F.lit(t[0]))])
    return v.v_obs.select("id", X.detect_intent(F.concat_ws(" ", F.col("headline"), F.col("content"))).alias("intent")).withColumn("bm25_weight", F.element_at(w, F.col("intent")))


@query
def token_estimate(v: Views) -> DataFrame:
    """X18."""
    return v.v_files.select("id", X.token_estimate(F.col("content")).alias("tokens"), X.token_count(F.col("content")).alias("tokens_fallback"))


@query
def tokenize_identifier(v: Views) -> DataFrame:
    """X01, X05 over names."""
    return v.v_nodes.select("id", X.tokenize_identifier(F.col("qualified_name")).alias("tokens"), F.array_join(X.score_words(F.col("signature")), " ").alias("words"))


# Lookups


@query
def query_nodes_filter(v: Views) -> DataFrame:
    """F01, F02, T02."""
    return lookup.query_nodes(v.v_nodes, v.v_files, kind="function", file_path="src1", text="al e", limit=50).select("id", "name", "path", "line_start")


@query
def query_nodes_exported(v: Views) -> DataFrame:
    """exported nodes of a visibility."""
    out = lookup.query_nodes(v.v_nodes, v.v_files, visibility="pub", exported_only=True, limit=1000)
    return out.select("id", "kind", "path", lookup.exported(F.col("is_export"), F.col("visibility")).alias("exported"))


@query
def query_edges_filter(v: Views) -> DataFrame:
    """F03, J02, T03."""
    out = lookup.query_edges(v.v_edges, v.v_nodes, v.v_files, symbol="Supplier#000000007", min_confidence=0.87, limit=50)
    return _r(out, "confidence")


@query
def unresolved_refs(v: Views) -> DataFrame:
    """J03, F05."""
    return lookup.unresolved_refs(v.v_refs, v.v_nodes, v.v_files, "src3", 100)


@query
def list_files(v: Views) -> DataFrame:
    """F04, T04."""
    return lookup.list_files(v.v_files, "en", "size", 100).select("id", "path", "language", "content_hash", "size_bytes")


@query
def index_status(v: Views) -> DataFrame:
    """A01."""
    return lookup.index_status(v.v_files, v.v_nodes, v.v_edges, v.v_refs)


@query
def node_counts(v: Views) -> DataFrame:
    """A02."""
    return lookup.node_counts(v.v_nodes)


@query
def avg_confidence(v: Views) -> DataFrame:
    """A03."""
    return _r(lookup.average_confidence(v.v_edges), "avg_confidence")


@query
def sessions_with_counts(v: Views) -> DataFrame:
    """J04, A04, T05."""
    return lookup.sessions_with_counts(v.v_sessions, v.v_obs, 1000).select("id", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"), "observation_count")


@query
def env_var_readers(v: Views) -> DataFrame:
    """Parts as variables, calls as reads."""
    return lookup.env_vars(v.v_nodes, v.v_edges, "function", "calls")


@query
def import_pairs(v: Views) -> DataFrame:
    """J07."""
    return lookup.import_pairs(v.v_edges, v.v_nodes)


@query
def edges_touching(v: Views) -> DataFrame:
    """edges with an end in Asia's nations or among suppliers in the red."""
    ids = v.v_nodes.where("kind = 'struct' AND visibility = 'private'").select("id").unionByName(v.v_nodes.where("kind = 'class' AND file_id = 4").select("id"))
    return _r(lookup.edges_touching(v.v_edges, ids).select("source_node_id", "target_node_id", "kind", "confidence"), "confidence")


@query
def enclosing_node(v: Views) -> DataFrame:
    """Each ref's place is line 7 x (id mod 60) of file id mod 50."""
    places = v.v_refs.select("id", (F.col("id") % 50).alias("file_id"), (F.col("id") % 60 * 7).alias("line"))
    return lookup.enclosing_nodes(places, v.v_nodes)


# Graph


@query
def edge_kind_counts(v: Views) -> DataFrame:
    """A07."""
    return graph.edge_kind_counts(v.v_edges)


@query
def degrees(v: Views) -> DataFrame:
    """A14."""
    return graph.degrees(v.v_edges)


@query
def pagerank_k(v: Views) -> DataFrame:
    """P06, P07, ten steps."""
    vertices, edges = graph.build(v.v_nodes, v.v_edges)
    return _r(graph.pagerank(vertices, edges, 10, tolerance=None), "rank", places=10)


@query
def top_pagerank(v: Views) -> DataFrame:
    """T07."""
    return _r(graph.top_pagerank(v.v_nodes, _ranks(v), 20, "class"), "rank", places=10)


@query
def impact_bfs(v: Views) -> DataFrame:
    """P08."""
    return graph.impact(v.v_nodes, v.v_edges, SYMBOL, "both", 3)


@query
def simple_paths(v: Views) -> DataFrame:
    """P09 from a supplier to a region."""
    out = graph.simple_paths(v.v_nodes, v.v_edges, "Supplier#000000007", SYMBOL, 6)
    return out.select("hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query
def bridges(v: Views) -> DataFrame:
    """J13, R13."""
    return graph.bridges(v.v_edges, v.v_nodes.where("kind = 'struct'").select("id"))


# Resolution


def _more_exports(v: Views) -> DataFrame:
    """Nodes of which every third is exported."""
    return v.v_nodes.withColumn("is_export", F.col("is_export") | (F.col("id") % 3 == 0))


@query
def resolve_refs(v: Views) -> DataFrame:
    """P03, J08, X20, X21."""
    return resolve.resolve_refs(v.v_refs, _more_exports(v), v.v_edges, v.v_files).select("ref_id", "source_node_id", "target_node_id", "kind", "confidence")


@query
def cross_workspace(v: Views) -> DataFrame:
    """The parts as another workspace."""
    return resolve.resolve_cross_workspace(v.v_refs, {"parts": _more_exports(v).where("kind = 'function'")})


@query
def shared_types(v: Views) -> DataFrame:
    """A06."""
    return resolve.shared_types(v.v_nodes, v.v_edges)


@query
def structural_diff(v: Views) -> DataFrame:
    """Parts of even keys have moved on: some renamed, some resized."""
    old = v.v_nodes.where("kind = 'function'")
    new = old.where("id % 7 <> 0").withColumns({
        "name": F.when(F.col("id") % 11 == 0, F.concat(F.col("name"), F.lit(" new"))).otherwise(F.col("name")),
        "signature": F.when(F.col("id") % 5 == 0, F.concat(F.col("signature"), F.lit(" -> i64"))).otherwise(F.col("signature")),
        "line_start": F.col("line_start") + F.col("id") % 3,
    })
    key = F.col("name").alias("name")
    unique = lambda df: df.select("file_id", "kind", key, "signature", "line_start")
    return resolve.structural_diff(unique(old), unique(new)).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("file_id").alias("files"))


@query
def submit_edges(v: Views) -> DataFrame:
    """Edges by qualified names."""
    given = v.supplier.select(F.concat(F.lit("supplier::"), "s_name").alias("source"), F.concat(F.lit("region::"), F.when(F.col("s_suppkey") % 3 == 0, "ASIA").when(F.col("s_suppkey") % 3 == 1, "EUROPE").otherwise("NOWHERE")).alias("target"), F.when(F.col("s_suppkey") % 2 == 0, "imports").otherwise("odd").alias("kind"))
    return resolve.submit_edges(v.v_nodes, given)


# Context


@query
def range_merge(v: Views) -> DataFrame:
    """R12 over all nodes of a file."""
    return context.merge_ranges(v.v_nodes.withColumn("total_lines", F.lit(300).cast("bigint")), 5)


@query
def excerpt_choice(v: Views) -> DataFrame:
    """And the first lines of each file."""
    out = context.excerpt_choice(v.v_files, v.v_nodes.where("kind = 'function'"), lookup.node_counts(v.v_nodes))
    head = v.v_files.select(F.col("id").alias("file_id"), F.md5(X.lines(F.col("content"), F.lit(2), F.lit(4))).alias("lines_md5"))
    return out.join(head, "file_id").select("file_id", F.col("total_lines").cast("long").alias("total_lines"), "matched", "full", "lines_md5")


@query
def budget_split(v: Views) -> DataFrame:
    """R10 for budgets of many sizes."""
    b = v.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9000).cast("long").alias("budget"))
    return b.select("id", "budget", *[c.alias(k) for k, c in context.budget_split(F.col("budget"), Config()).items()])


@query
def budget_allocation(v: Views) -> DataFrame:
    """R09, R13 to R16 over the best nodes."""
    results = search.hybrid(v.v_nodes, v.v_files, v.v_edges, _ranks(v), "supplier EUROPE module", "explore", 50, index=_node_index(v))
    return context.context(results, v.v_nodes, v.v_files, v.v_edges, "explore", 8000).drop("content")


# Memory


@query
def memory_search(v: Views) -> DataFrame:
    """R19, X12, X13."""
    out = memory.search(v.v_obs, "anshe theaea user", NOW, 20, session_id=7)
    return _r(out.select("id", "session_id", "score"), "score")


@query
def consolidate(v: Views) -> DataFrame:
    """P12, X14, X15 for one new row."""
    return memory.consolidation(v.v_obs, 702)


@query
def trigram_similarity(v: Views) -> DataFrame:
    """Each turn with the next of its session."""
    a = v.v_obs.select("id", F.col("content").alias("a"))
    b = v.v_obs.select((F.col("id") - 1).alias("id"), F.col("content").alias("b"))
    out = a.join(b, "id").select("id", X.jaccard(X.trigrams(F.col("a")), X.trigrams(F.col("b"))).alias("similarity"), X.headline(F.col("a")).alias("headline"))
    return _r(out, "similarity")


@query
def anti_patterns(v: Views) -> DataFrame:
    """A11, J11, J15 over all activity."""
    links = v.v_activity.select("observation_id", "file_id")
    symbols = v.v_activity.select("observation_id", (F.col("file_id") % 40).alias("node_id"))
    return memory.anti_patterns(v.v_activity.withColumnRenamed("observation_id", "id"), links, symbols)


@query
def session_summary(v: Views) -> DataFrame:
    """A12 with headlines of many lengths."""
    obs = v.v_obs.withColumn("headline", F.col("content"))
    return memory.session_summaries(v.v_sessions, obs, NOW)


@query
def session_context(v: Views) -> DataFrame:
    """P14, T05, T06."""
    return memory.session_context(v.v_sessions, v.v_obs, None, True, 3)


@query
def detect_staleness(v: Views) -> DataFrame:
    """Links to files of which some have changed."""
    links = v.v_obs.select(F.col("id").alias("observation_id"), (F.col("id") % 200).alias("file_id")).join(v.v_files.select(F.col("id").alias("file_id"), F.col("content_hash").alias("h")), "file_id")
    links = links.select("observation_id", "file_id", F.when(F.col("file_id") % 4 == 0, F.lit("old")).otherwise(F.col("h")).alias("content_hash_at_link"))
    return memory.stale(links, v.v_files)


@query
def ttl_cleanup(v: Views) -> DataFrame:
    """K10, X24."""
    return memory.ttl(v.v_obs, NOW, 58).select("id", "session_id")


# Ingest, extraction, snapshots, streams


@query
def upsert_snapshot(v: Views) -> DataFrame:
    """Files of which some have new content and some are new."""
    from .sources.store import upsert

    delta = v.v_files.where("id % 5 = 0").select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10000000).alias("id"), "path", F.lit("new").alias("content_hash"))
    return upsert(v.v_files.select("id", "path", "content_hash"), delta, ["id"])


@query
def cascade_delete(v: Views) -> DataFrame:
    """What is left per table when some files go."""
    from .sources.store import delete_cascade

    left = delete_cascade({"files": v.v_files, "nodes": v.v_nodes, "edges": v.v_edges, "refs": v.v_refs}, v.v_files.where("id % 4 = 1").select("id"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query
def html_extract(v: Views) -> DataFrame:
    """Links and styles of every page."""
    from .operators import extract

    files = v.pages.select(F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    nodes, _, refs = extract.tables(extract.extract_files(files))
    by = nodes.groupBy("file_id").agg(F.count(F.when(F.col("kind") == "module", 1)).alias("styles"), F.count(F.when(F.col("kind") == "import", 1)).alias("imports"))
    ids = v.pages.select("page_id", F.xxhash64(F.concat(F.lit("page/"), "page_id", F.lit(".html"))).alias("file_id"))
    return ids.join(by, "file_id", "left").select("page_id", F.coalesce("styles", F.lit(0)).alias("styles"), F.coalesce("imports", F.lit(0)).alias("imports"))


def _sources(v: Views) -> DataFrame:
    """A source file per part, in four languages."""
    n = F.col("p_name")
    ident = F.regexp_replace(F.initcap(n), " ", "")
    env = F.upper(F.regexp_replace(n, "[^A-Za-z]+", "_"))
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, F.concat(F.lit("import os\n\ndef make_"), F.regexp_replace(n, " ", "_"), F.lit("(n):\n    if n:\n        load(n)\n    return os.getenv('"), env, F.lit("')\n\n@app.get('/"), n, F.lit("')\ndef show():\n    pass\n")))
    body = body.when(k == 1, F.concat(F.lit("import { load } from './load';\nexport class "), ident, F.lit(" extends Base {\n  run(a) { return load(process.env."), env, F.lit("); }\n}\nrouter.post('/"), n, F.lit("', run);\n")))
    body = body.when(k == 2, F.concat(F.lit("use crate::base::Base;\n/// one\npub struct "), ident, F.lit(" { a: i32 }\nimpl Base for "), ident, F.lit(" {\n    fn run(&self) -> String { env::var(\""), env, F.lit("\").unwrap() }\n}\n")))
    body = body.otherwise(F.concat(F.lit("#include <stdlib.h>\n\nchar *get_"), F.regexp_replace(n, " ", "_"), F.lit("(int a) {\n    /* look */\n    return getenv(\""), env, F.lit("\");\n}\n")))
    ext = F.when(k == 0, "py").when(k == 1, "ts").when(k == 2, "rs").otherwise("c")
    lang = F.when(k == 0, "python").when(k == 1, "typescript").when(k == 2, "rust").otherwise("c")
    return v.part.select("p_partkey", F.concat(F.lit("src/"), "p_partkey", F.lit("."), ext).alias("path"), lang.alias("language"), body.alias("content"))


@query
def env_scan(v: Views) -> DataFrame:
    """Variables and their readers in a file per part."""
    from .operators import extract

    nodes, edges, _ = extract.tables(keep(extract.extract_files(_sources(v)), "extracted"))
    reads = edges.where("kind = 'reads_env'").groupBy("target_node_id").agg(F.count(F.lit(1)).alias("readers"))
    found = nodes.where("kind = 'env_var'").join(reads, nodes.id == reads.target_node_id, "left")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("readers", F.lit(0))).alias("readers"))


@query
def api_scan(v: Views) -> DataFrame:
    """Routes in a file per part."""
    from .operators import extract

    nodes, _, _ = extract.tables(extract.extract_files(_sources(v)))
    return nodes.where("kind = 'api_endpoint'").groupBy("name").agg(F.count(F.lit(1)).alias("files"))


@query
def symbol_counts(v: Views) -> DataFrame:
    """Nodes by kind and refs by kind."""
    from .operators import extract

    nodes, _, refs = extract.tables(keep(extract.extract_files(_sources(v)), "extracted"))
    return nodes.groupBy(F.lit("node").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(refs.groupBy(F.lit("ref").alias("what"), F.col("edge_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query
def skeletons(v: Views) -> DataFrame:
    """Three levels of a file per part."""
    from .operators.skeleton import skeletons as fold

    return fold(_sources(v)).groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))


@query
def change_stream_latest(v: Views) -> DataFrame:
    """The last event per user, drained as a stream."""
    from .streaming.changes import latest

    return latest(v.spark, v.folder, "events.parquet", v.events.schema, "user_id", ["ts", "event_id"], ["user_id", "ts", "event_id", "event_type"]).select("user_id", "event_id", "event_type")
