"""One method per tool of the engine, over a snapshot store."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import context, graph, lookup, memory, resolve, search
from .operators.skeleton import LEVELS, skeleton
from .plans.index import index
from .plans.scratch import keep
from .sources.config import Config
from .sources.store import Store
from .sources.workspace import extra_roots, inside

OBSERVATION = "id long, session_id string, content string, headline string, summary string, created_at timestamp, is_stale boolean, stale_reason string, consolidated_into long, anti_pattern string"
SESSION = "id string, created_at timestamp, updated_at timestamp, compressed boolean, summary string"


def check(name: str, value, low, high):
    """a number within bounds, a text within a length in bytes."""
    size = len(value.encode()) if isinstance(value, str) else value
    if not low <= size <= high:
        raise ValueError(f"{name} must be within {low} and {high}")
    return value


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, config: Config = Config(), roots: list[str] = ()):
        """``roots`` are further folders (S10); their files stand behind the folder's name."""
        self.spark, self.root, self.config = spark, root, config
        self.extra = {Path(r).name: r for r in extra_roots(root, roots)} if roots else None
        self.store = Store(spark, store or f"{root}/{config.store}")
        self.notes = Store(spark, (store or f"{root}/{config.store}") + "-notes")
        self.external: dict[str, Store] = {}
        self._cache: dict[tuple, tuple[float, DataFrame]] = {}
        self._ranks: tuple[int, DataFrame] | None = None

    # Snapshot

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def trigger_reindex(self, now: str = "1970-01-01 00:00:00", files: list[str] | None = None, full: bool = False) -> dict:
        """The files named, which must lie in the workspace, or with
        ``full`` or without names the whole tree and the extra roots."""
        others = {n: s.read("nodes") for n, s in self.external.items()}
        only = None
        if files is not None and not full:
            main = Path(self.root).resolve()
            only = [str(inside(self.root, f).relative_to(main)) for f in files]
        return index(self.spark, self.root, self.store, self.config, now, self.extra, others or None, only)

    def index_status(self) -> DataFrame:
        return lookup.index_status(self.table("files"), self.table("nodes"), self.table("edges"), self.table("refs"))

    def add_workspace(self, name: str, store: str) -> None:
        self.external[name] = Store(self.spark, store)

    def pagerank(self) -> DataFrame:
        version = self.store.version()
        if self._ranks is None or self._ranks[0] != version:
            self._ranks = (version, graph.pagerank(self.table("nodes"), self.table("edges")))
        return self._ranks[1]

    def text_index(self) -> search.Index | None:
        """The snapshot's postings; None for a snapshot without."""
        return search.Index(self.table("postings"), self.table("corpus"), search.FIELDS) if self.store.has("postings") else None

    # Search and context

    def search(self, query: str, limit: int = 20, intent: str | None = None, cross_workspace: bool = True) -> DataFrame:
        check("query", query, 1, 10_000)
        check("limit", limit, 1, 1000)
        external = {n: (s.read("nodes"), s.read("files")) for n, s in self.external.items()} if cross_workspace else None
        return search.hybrid(self.table("nodes"), self.table("files"), self.table("edges"), self.pagerank(), query, intent, limit, external, self.text_index())

    def get_context_capsule(self, query: str, token_budget: int | None = None, session_id: str | None = None, intent: str | None = None, cross_workspace: bool = True) -> DataFrame:
        """R17, R18.  A cached answer serves calls without a session."""
        check("query", query, 1, 10_000)
        if intent is not None and intent not in X.INTENT_WEIGHTS:
            raise ValueError(f"intent {intent!r}")
        intent, budget = intent or X.intent_of(query), token_budget or self.config.token_budget
        key = (query, budget, intent, cross_workspace, self.store.version())
        hit = self._cache.get(key)
        if session_id is None and hit and time.monotonic() - hit[0] < self.config.capsule_cache_ttl_secs:
            return hit[1]
        results = keep(self.search(query, context.RESULTS, intent, cross_workspace), "results")
        code = budget - budget * self.config.memory_budget_pct // 100
        files = self.table("files")

        def outline(file_id: int, level: str) -> str | None:
            row = files.where(F.col("id") == file_id).select("language", "content").first()
            return skeleton(row[1], row[0], level) if row else None

        out = context.context(results.where("workspace is null"), self.table("nodes"), files, self.table("edges"), intent, code, outline, self.config)
        more = results.where("workspace is not null").select(F.lit("external").alias("section"), F.concat("workspace", F.lit(":"), "path").alias("path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(0).alias("tokens"), F.col("name").alias("detail"), F.lit("").alias("content"))
        out = out.unionByName(more)
        if session_id is not None:
            notes = self.search_memory(query, 5, session_id).select(F.lit("memory").alias("section"), F.lit("").alias("path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(0).alias("tokens"), F.col("headline").alias("detail"), "content")
            return out.unionByName(notes)
        if len(self._cache) >= self.config.capsule_cache_size:
            self._cache.pop(min(self._cache, key=lambda k: self._cache[k][0]))
        self._cache[key] = (time.monotonic(), out)
        return out

    def get_skeleton(self, file_path: str, level: str | None = None) -> str | None:
        level = level or self.config.default_skeleton_level
        if level not in LEVELS:
            raise ValueError(f"level {level!r}")
        row = self.table("files").where(F.col("path") == file_path).select("language", "content").first()
        return skeleton(row[1], row[0], level) if row else None

    # Lookups

    def query_nodes(self, query: str | None = None, kind: str | None = None, file_path: str | None = None, visibility: str | None = None, exported_only: bool = False, include_pagerank: bool = False, limit: int = 50) -> DataFrame:
        """A text goes to the index of names and paths; if it finds
        nothing, to LIKE.  Without a kind the index leaves imports out."""
        check("limit", limit, 1, 1000)
        nodes, files = self.table("nodes"), self.table("files")
        ranks = self.pagerank() if include_pagerank else None
        filters = {"kind": kind, "file_path": file_path, "visibility": visibility, "exported_only": exported_only}
        if not query:
            return lookup.query_nodes(nodes, files, **filters, limit=limit, pagerank=ranks)
        own = nodes if kind else nodes.where("kind <> 'import'")
        wide = lookup.filter_nodes(own, files, **filters)
        names = ["name", "qualified_name", "tokenized_name", "tokenized_qualified_name", "path"]
        found, some = self.text_index(), X.parse_or(query)
        if found is None:
            scored = search.bm25(search.node_documents(nodes, files), some, names).select(F.col("id").alias("doc"), "bm25")
        else:
            scored = found.bm25(some, names)  # statistics of the whole index, filters after
        hits = keep(search.top(wide.join(scored.withColumnRenamed("doc", "id"), "id"), limit), "hits")
        if hits.isEmpty():
            return lookup.query_nodes(nodes, files, **filters, text=query, limit=limit, pagerank=ranks)
        out = hits.select("id", "kind", "name", "qualified_name", "signature", "visibility", "is_export", "path", "line_start", "line_end", "bm25")
        out = out.join(ranks.withColumnRenamed("rank", "pagerank"), "id", "left") if ranks is not None else out
        return out.orderBy(F.col("bm25").desc(), "id").drop("bm25")

    def query_edges(self, symbol: str | None = None, kind: str | None = None, min_confidence: float | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
        check("limit", limit, 1, 1000)
        return lookup.query_edges(self.table("edges"), self.table("nodes"), self.table("files"), symbol, kind, min_confidence, direction, limit)

    def list_files(self, language: str | None = None, sort_by: str = "path", limit: int = 100) -> DataFrame:
        check("limit", limit, 1, 1000)
        return lookup.list_files(self.table("files").drop("content"), language, sort_by, limit)

    def get_unresolved_refs(self, file_path: str | None = None, limit: int = 50) -> DataFrame:
        check("limit", limit, 1, 1000)
        refs, nodes, files = self.table("refs"), self.table("nodes"), self.table("files")
        done = resolve.resolve_refs(refs, nodes, self.table("local_edges"), files).select(F.col("ref_id").alias("id"))
        return lookup.unresolved_refs(refs.join(done, "id", "left_anti"), nodes, files, file_path, limit)

    def get_env_lineage(self, var_name: str | None = None, list_all: bool = False) -> DataFrame:
        if list_all or var_name is None:
            return lookup.env_vars(self.table("nodes"), self.table("edges"))
        return lookup.env_lineage(self.table("nodes"), self.table("edges"), self.table("files"), var_name)

    # Graph

    def get_impact_graph(self, symbol: str, direction: str = "both", depth: int = 3, edge_kinds: list[str] | None = None) -> DataFrame:
        check("symbol", symbol, 1, 10_000)
        check("depth", depth, 1, 20)
        if direction not in ("callers", "callees", "both"):
            raise ValueError(f"direction {direction!r}")
        found = graph.impact(self.table("nodes"), self.table("edges"), symbol, direction, depth, edge_kinds)
        return found.join(self.table("nodes").select("id", "kind", "name", "qualified_name"), "id").orderBy("direction", "depth", "id")

    def search_logic_flow(self, from_symbol: str, to_symbol: str, max_depth: int = 5) -> DataFrame:
        check("max_depth", max_depth, 1, 20)
        return graph.simple_paths(self.table("nodes"), self.table("edges"), from_symbol, to_symbol, max_depth)

    def graph_stats(self, top_n: int = 20, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
        return graph.edge_kind_counts(self.table("edges")), graph.top_pagerank(self.table("nodes"), self.pagerank(), top_n, kind)

    def submit_lsp_edges(self, edges: list[dict]) -> dict:
        given = self.spark.createDataFrame([(e["source"], e["target"], e["kind"]) for e in edges], "source string, target string, kind string")
        new = keep(resolve.submit_edges(self.table("nodes"), given), "submitted")
        added = new.count()
        if added:
            carried = ("files", "nodes", "local_edges", "refs", "edges", "postings", "corpus", "cross_workspace_edges", "submitted_edges")
            tables = {t: self.table(t) for t in carried if self.store.has(t)}
            new = new.withColumn("context", F.lit(None).cast("string"))
            tables["edges"] = tables["edges"].unionByName(new)
            tables["submitted_edges"] = tables["submitted_edges"].unionByName(new) if "submitted_edges" in tables else new
            self.store.commit(tables)
        return {"added": added, "skipped": len(edges) - added}

    # Memory

    def _notes(self, name: str) -> DataFrame:
        schemas = {"observations": OBSERVATION, "sessions": SESSION, "symbols": "observation_id long, node_id long", "files": "observation_id long, file_id long, content_hash_at_link string"}
        return self.notes.read(name) if self.notes.version() else self.spark.createDataFrame([], schemas[name])

    def save_observation(self, content: str, session_id: str, now: str, symbols: list[str] = (), files: list[str] = ()) -> int:
        """A note with its links; alike older notes point to it."""
        check("content", content, 1, 50_000)
        nodes, own = self.table("nodes"), self.table("files")
        obs, sessions = self._notes("observations"), self._notes("sessions")
        number = (obs.agg(F.max("id")).first()[0] or 0) + 1
        new = self.spark.createDataFrame([(number, session_id, content)], "id long, session_id string, content string")
        rows, links, paths = memory.save(new, nodes, own)
        rows = rows.withColumns({"created_at": F.lit(now).cast("timestamp"), "is_stale": F.lit(False), "stale_reason": F.lit(None).cast("string"), "consolidated_into": F.lit(None).cast("long"), "anti_pattern": F.lit(None).cast("string")}).select(*obs.columns)
        if symbols:
            named = nodes.where(F.col("name").isin(list(symbols))).groupBy("name").agg(F.min("id").alias("node_id"))
            links = links.unionByName(named.select(F.lit(number).cast("long").alias("observation_id"), "node_id")).distinct()
        if files:
            given = own.where(F.col("path").isin(list(files))).select(F.lit(number).cast("long").alias("observation_id"), F.col("id").alias("file_id"), F.col("content_hash").alias("content_hash_at_link"))
            paths = paths.unionByName(given).dropDuplicates(["observation_id", "file_id"])
        links, paths = self._notes("symbols").unionByName(links), self._notes("files").unionByName(paths)
        every = keep(obs.unionByName(rows), "observations")
        every = keep(memory.apply_consolidation(every, memory.consolidation(every, number, links, paths)).select(*obs.columns), "observations")
        tags = memory.anti_patterns(every.where(F.col("session_id") == session_id), paths, links).select("id", F.col("anti_pattern").alias("tag"))
        every = every.join(tags, "id", "left").withColumn("anti_pattern", F.coalesce("anti_pattern", "tag")).drop("tag")
        at = F.lit(now).cast("timestamp")
        known = sessions.where(F.col("id") == session_id)
        touched = self.spark.createDataFrame([(session_id,)], "id string").join(known.select("id", "created_at", "compressed", "summary"), "id", "left")
        touched = touched.select("id", F.coalesce("created_at", at).alias("created_at"), at.alias("updated_at"), F.coalesce("compressed", F.lit(False)).alias("compressed"), "summary")
        sessions = sessions.where(F.col("id") != session_id).unionByName(touched)
        self.notes.commit({"observations": every, "sessions": sessions, "symbols": links, "files": paths})
        return number

    def search_memory(self, query: str, limit: int = 10, session_id: str | None = None, now: str | None = None) -> DataFrame:
        check("query", query, 1, 10_000)
        now = now or time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
        return memory.search(self._notes("observations"), query, now, limit, session_id, self._notes("symbols"), self.pagerank())

    def get_session_context(self, session_id: str | None = None, include_previous: bool = False, previous_limit: int = 3) -> DataFrame:
        return memory.session_context(self._notes("sessions"), self._notes("observations"), session_id, include_previous, previous_limit)

    def list_sessions(self, limit: int = 20) -> DataFrame:
        return lookup.sessions_with_counts(self._notes("sessions"), self._notes("observations"), limit)

    def detect_staleness(self, now: str) -> dict:
        """Marking, TTL and session summaries."""
        obs, sessions, links, paths = (self._notes(n) for n in ("observations", "sessions", "symbols", "files"))
        before = obs.count()
        marked = keep(memory.ttl(memory.mark_stale(obs, paths, self.table("files")), now, self.config.observation_ttl_days).select(*obs.columns), "observations")
        short = memory.session_summaries(sessions.where("NOT compressed"), marked, now, self.config.session_compress_after_hours).withColumnRenamed("summary", "new")
        sessions = keep(sessions.join(short, "id", "left").withColumns({"compressed": F.col("compressed") | F.col("new").isNotNull(), "summary": F.coalesce("new", "summary")}).drop("new"), "sessions")
        alive = marked.select(F.col("id").alias("observation_id"))
        self.notes.commit({"observations": marked, "sessions": sessions, "symbols": links.join(alive, "observation_id", "left_semi"), "files": paths.join(alive, "observation_id", "left_semi")})
        return {"stale": marked.where("is_stale").count(), "expired": before - marked.count(), "compressed": sessions.where("compressed").count()}

    def get_config(self) -> Config:
        return self.config

    def workspace_setup(self, force: bool = False):
        from .sources.config import setup

        return setup(self.root, force)
