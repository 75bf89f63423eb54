"""Observation memory: search with recency, consolidation, rules, summaries.

``now`` is always a parameter, so results do not depend on the clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .search import bm25, top

SIMILAR, SAME, OTHER = 0.7, 20, 10
THRASH, CHURN, CHURN_SECONDS, SUMMARY_BYTES = 3, 5, 600, 500


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def age_days(created: Column, now: datetime | str) -> Column:
    return (_seconds(F.lit(str(now)).cast("timestamp")) - _seconds(created)) / 86400.0


def search(observations: DataFrame, text: str, now, limit: int = 10, session_id=None, symbols: DataFrame | None = None, pagerank: DataFrame | None = None) -> DataFrame:
    """0.4 BM25 + 0.3 recency + 0.2 PageRank of linked nodes + 0.1, + 0.2 in
    the same session, times a penalty; of the best 3 x limit by BM25.

    Words of two bytes or more are alternatives."""
    terms = [t for w in text.split() if len(w.encode()) > 1 for t in ["".join(ch for ch in w if ch.isalnum() or ch == "_")] if len(t.encode()) > 1]
    # An underscore parts words in the index, so its parts are wanted together.
    query = X.Query(tuple(tuple(p for p in t.lower().split("_") if p) for t in terms if t.strip("_")))
    fields = [c for c in ("content", "headline", "summary") if c in observations.columns]
    hits = top(bm25(observations, query, fields), 3 * limit)
    norm = F.col("bm25") / F.max("bm25").over(Window.partitionBy(F.lit(1)))  # over 3 x limit rows
    near = F.lit(0.0)
    if symbols is not None and pagerank is not None:
        linked = symbols.join(pagerank.select(F.col("id").alias("node_id"), "rank"), "node_id").groupBy(F.col("observation_id").alias("id")).agg(F.least(F.max("rank") * 1000, F.lit(1.0)).alias("near"))
        hits = hits.join(linked, "id", "left")
        near = F.coalesce("near", F.lit(0.0))
    reason = F.col("stale_reason") if "stale_reason" in hits.columns else F.lit(None).cast("string")
    bonus = F.when(F.col("session_id") == session_id, 0.2).otherwise(0.0) if session_id is not None else F.lit(0.0)
    base = 0.4 * norm + 0.3 * X.recency(age_days(F.col("created_at"), now)) + 0.2 * near + 0.1 + bonus
    scored = hits.withColumn("score", base * X.staleness_penalty(F.col("is_stale"), reason))
    return scored.orderBy(F.col("score").desc(), "id").limit(limit)


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of (text, symbols, files): trigram Jaccard alone if neither has a link."""
    content = X.jaccard(X.trigrams(a["text"]), X.trigrams(b["text"]))

    def part(name: str) -> Column:
        return F.when(F.size(F.array_union(a[name], b[name])) == 0, 0.0).otherwise(X.jaccard(a[name], b[name]))

    bare = F.size(F.array_union(a["symbols"], b["symbols"])) + F.size(F.array_union(a["files"], b["files"])) == 0
    return F.when(bare, content).otherwise(0.3 * part("symbols") + 0.3 * part("files") + 0.4 * content)


def consolidation(observations: DataFrame, new_id: int, symbols: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(id, similarity, consolidated) of the candidates for a new row: the
    latest of its session and of others, neither stale nor consolidated."""
    new = observations.where(F.col("id") == new_id).select(F.col("id").alias("new_id"), F.col("session_id").alias("new_session"), F.col("content").alias("new_content"))
    open_ = observations.where((F.col("id") != new_id) & ~F.coalesce("is_stale", F.lit(False)))
    if "consolidated_into" in observations.columns:
        open_ = open_.where("consolidated_into is null")
    open_ = open_.select("id", "session_id", "content", "created_at").crossJoin(F.broadcast(new))  # one row
    latest = [F.col("created_at").desc(), "id"]
    same = open_.where("session_id = new_session").orderBy(*latest).limit(SAME)
    other = open_.where("session_id <> new_session").orderBy(*latest).limit(OTHER)
    found = same.unionByName(other)
    for name, links, key in (("symbols", symbols, "node_id"), ("files", files, "file_id")):
        sets = None if links is None else links.groupBy("observation_id").agg(F.collect_set(key).alias("s"))
        for prefix, at in (("", "id"), ("new_", "new_id")):
            if sets is None:
                found = found.withColumn(prefix + name, F.array().cast("array<bigint>"))
            else:
                found = found.join(sets.select(F.col("observation_id").alias(at), F.col("s").alias(prefix + name)), at, "left").withColumn(prefix + name, F.coalesce(prefix + name, F.array().cast("array<bigint>")))
    score = similarity({"text": F.col("new_content"), "symbols": F.col("new_symbols"), "files": F.col("new_files")}, {"text": F.col("content"), "symbols": F.col("symbols"), "files": F.col("files")})
    return found.select("id", "new_id", F.round(score, 6).alias("similarity")).withColumn("consolidated", F.col("similarity") >= SIMILAR)


def apply_consolidation(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Older rows point to the new one and are stale."""
    into = pairs.where("consolidated").select("id", F.col("new_id").alias("__into"))
    out = observations.join(into, "id", "left")
    hit = F.col("__into").isNotNull()
    return out.withColumns({
        "consolidated_into": F.coalesce("__into", F.col("consolidated_into") if "consolidated_into" in observations.columns else F.lit(None).cast("bigint")),
        "is_stale": hit | F.coalesce("is_stale", F.lit(False)),
        "stale_reason": F.when(hit, "consolidated").otherwise(F.col("stale_reason") if "stale_reason" in observations.columns else F.lit(None).cast("string")),
    }).drop("__into")


def anti_patterns(observations: DataFrame, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(id, session_id, anti_pattern) of tagged rows; the first rule wins.

    Counts per (session, file) and (session, node) are aggregated and joined
    back; rapid churn counts per second first, so a busy second is one row."""
    own = observations.select("id", "session_id", F.floor(_seconds(F.col("created_at"))).cast("long").alias("sec"))

    def crowd(links: DataFrame, key: str) -> DataFrame:
        linked = links.select(F.col("observation_id").alias("id"), key).join(own.select("id", "session_id"), "id")
        many = linked.groupBy("session_id", key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > THRASH)
        return linked.join(many, ["session_id", key], "left_semi").select("id").distinct()

    tags = crowd(files, "file_id").select("id", F.lit(1).alias("rank"))
    if symbols is not None:
        tags = tags.unionByName(crowd(symbols, "node_id").select("id", F.lit(2).alias("rank")))
    per = own.groupBy("session_id", "sec").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session_id").orderBy("sec").rangeBetween(-(CHURN_SECONDS - 1), CHURN_SECONDS - 1)
    busy = per.withColumn("around", F.sum("n").over(w)).where(F.col("around") > CHURN).select("session_id", "sec")
    tags = tags.unionByName(own.join(busy, ["session_id", "sec"], "left_semi").select("id", F.lit(3).alias("rank")))
    best = tags.groupBy("id").agg(F.min("rank").alias("rank"))
    name = F.when(F.col("rank") == 1, "file_thrashing").when(F.col("rank") == 2, "circular_investigation").otherwise("rapid_churn")
    return own.join(best, "id").select("id", "session_id", name.alias("anti_pattern"))


def session_summaries(sessions: DataFrame, observations: DataFrame, now, hours: int = 2) -> DataFrame:
    """(id, summary) of sessions untouched for ``hours``.

    Headlines in time order, once each, while they fit; one that does not is
    passed over.  Only a headline's first time counts, and none longer than the
    summary can be taken, so what is gathered per session is distinct headlines
    that fit at all; the fold keeps the parts and the bytes so far."""
    old = sessions.where(_seconds(F.col("updated_at")) < _seconds(F.lit(str(now)).cast("timestamp")) - hours * 3600).select("id")
    lines = observations.where(F.col("headline").isNotNull() & (F.octet_length("headline") + 2 <= SUMMARY_BYTES)).groupBy("session_id", "headline").agg(F.min(F.struct("created_at", "id")).alias("at"))
    lines = lines.join(old.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("at"), "headline")))
    grown = lines.groupBy("session_id").agg(ordered.alias("hs"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("size"))

    def step(acc, h):
        size = acc["size"] + F.octet_length(h["headline"]) + 2
        fits = size <= SUMMARY_BYTES
        return F.struct(F.when(fits, F.concat(acc["parts"], F.array(h["headline"]))).otherwise(acc["parts"]).alias("parts"), F.when(fits, size).otherwise(acc["size"]).alias("size"))

    return grown.select(F.col("session_id").alias("id"), F.array_join(F.aggregate("hs", start, step)["parts"], "; ").alias("summary"))


def session_context(sessions: DataFrame, observations: DataFrame, session_id=None, include_previous: bool = False, previous: int = 3, each: int = 5) -> DataFrame:
    """Rows (section, session_id, nth, id, headline) of a session
    (the latest if none is named), and the first ``each`` of earlier ones."""
    latest = [F.col("updated_at").desc(), "id"]
    current = sessions.where(F.col("id") == session_id) if session_id is not None else sessions
    current = current.orderBy(*latest).limit(1).select(F.col("id").alias("session_id"))
    w = Window.partitionBy("session_id").orderBy("created_at", "id")

    def rows(picked: DataFrame, section: str) -> DataFrame:
        own = observations.join(picked, "session_id", "left_semi").withColumn("nth", F.row_number().over(w))
        return own.select(F.lit(section).alias("section"), "session_id", "nth", "id", "headline", "is_stale")

    out = rows(current, "current")
    if include_previous:
        others = sessions.join(current.withColumnRenamed("session_id", "id"), "id", "left_anti").orderBy(*latest).limit(previous).select(F.col("id").alias("session_id"))
        out = out.unionByName(rows(others, "previous").where(F.col("nth") <= each))
    return out


def stale(links: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of observations with a linked file that has changed."""
    now = files.select(F.col("id").alias("file_id"), F.col("content_hash").alias("now_hash"))
    return links.join(now, "file_id").where("now_hash <> content_hash_at_link").select(F.col("observation_id").alias("id")).distinct()


def mark_stale(observations: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    hit = stale(links, files).withColumn("__hit", F.lit(True))
    reason = F.col("stale_reason") if "stale_reason" in observations.columns else F.lit(None).cast("string")
    out = observations.withColumn("stale_reason", reason).join(hit, "id", "left")
    new = F.coalesce("__hit", F.lit(False)) & ~F.coalesce("is_stale", F.lit(False))
    return out.withColumns({"stale_reason": F.when(new, "linked file changed").otherwise(F.col("stale_reason")), "is_stale": F.coalesce("is_stale", F.lit(False)) | new}).drop("__hit")


def ttl(observations: DataFrame, now, days: int = 90) -> DataFrame:
    """Rows younger than ``days``; exactly that old stays."""
    return observations.where(_seconds(F.col("created_at")) >= _seconds(F.lit(str(now)).cast("timestamp")) - days * 86400)


def save(observations: DataFrame, nodes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows with headline and summary, their symbol links (ten at
    most, from thirty candidates, exported nodes first) and their file links."""
    from ..sources.workspace import EXTENSIONS

    rows = observations.withColumns({"headline": X.headline(F.col("content")), "summary": X.summary(F.col("content"))})
    words = observations.select(F.col("id").alias("observation_id"), F.posexplode(F.slice(X.symbol_candidates(F.col("content")), 1, 30)).alias("pos", "name"))
    public = F.coalesce("is_export", F.lit(False)) | F.coalesce(F.col("visibility") == "pub", F.lit(False))
    best = nodes.groupBy("name").agg(F.min(F.struct((~public).alias("p"), "id"))["id"].alias("node_id"))
    nth = F.row_number().over(Window.partitionBy("observation_id").orderBy("pos"))
    symbols = words.join(best, "name").withColumn("nth", nth).where("nth <= 10").select("observation_id", "node_id").distinct()
    paths = F.transform(F.split("content", r"\s+"), lambda w: F.regexp_replace(w, r"""^["'`,.:()]+|["'`,.:()]+$""", ""))
    code = F.filter(F.array_distinct(paths), lambda w: F.contains(w, F.lit("/")) & F.regexp_extract(w, r"\.([^./]+)$", 1).isin(*EXTENSIONS))
    named = observations.select(F.col("id").alias("observation_id"), F.posexplode(code).alias("pos", "path"))
    found = named.join(files.select("path", F.col("id").alias("file_id"), F.col("content_hash").alias("content_hash_at_link")), "path").withColumn("nth", nth).where("nth <= 10")
    return rows, symbols, found.select("observation_id", "file_id", "content_hash_at_link").dropDuplicates(["observation_id", "file_id"])
