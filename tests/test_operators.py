"""Operators on small tables, against plain Python."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxgraph.functions import text as X
from ctxgraph.operators import context, graph, lookup, memory, resolve, search
from ctxgraph.sources.config import Config

NODES = "id long, file_id long, kind string, name string, qualified_name string, signature string, line_start long, line_end long, visibility string, is_export boolean"


def nodes(spark, rows):
    base = {"file_id": 1, "kind": "function", "qualified_name": None, "signature": None, "line_start": 1, "line_end": 10, "visibility": "pub", "is_export": True}
    names = [c.split()[0] for c in NODES.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], NODES)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, c, None) for a, b, k, c in rows], "source_node_id long, target_node_id long, kind string, confidence double, context string")


def files(spark, rows):
    return spark.createDataFrame(rows, "id long, path string")


def resolved(spark, ns, refs, es=(), fs=((1, "src/a.py"), (2, "src/b.py"), (3, "src/c.py"))):
    r = spark.createDataFrame(refs, "id long, source_node_id long, target_name string, edge_kind string, import_path string")
    return {x["ref_id"]: (x["target_node_id"], x["confidence"]) for x in resolve.resolve_refs(r, nodes(spark, ns), edges(spark, list(es)), files(spark, list(fs))).collect()}


def test_resolution_confidences(spark):
    a, b = {"id": 1, "file_id": 1, "name": "main"}, {"id": 2, "file_id": 2, "name": "helper"}
    ref = (9, 1, "helper", "calls", None)
    assert resolved(spark, [a, b], [ref]) == {9: (2, 0.55)}
    assert resolved(spark, [a, b], [ref], [(1, 2, "imports", 1.0)]) == {9: (2, 0.90)}
    assert resolved(spark, [a, b], [(9, 1, "helper", "calls", "./b")]) == {9: (2, 0.85)}
    c = {"id": 3, "file_id": 3, "name": "helper"}
    assert resolved(spark, [a, b, c], [ref]) == {9: (2, 0.35)}
    types = [a, b | {"kind": "struct"}, c | {"kind": "struct"}]
    assert resolved(spark, types, [ref]) == {}  # 0.30 is not enough
    assert resolved(spark, types, [(9, 1, "helper", "type_ref", None)]) == {9: (2, 0.35)}
    assert resolved(spark, [a, b | {"file_id": 1}], [ref]) == {}  # the same file
    assert resolved(spark, [a, b | {"is_export": False, "visibility": "private"}], [ref]) == {}
    assert resolved(spark, [a, b, c], [(9, 1, "helper", "calls", "./c")]) == {9: (3, 0.85)}


def test_resolution_equals_all_pairs(spark):
    """A name that most files export, against candidates looked at one by one."""
    rng = random.Random(5)
    kinds = ["function", "struct", "method", None]
    ns = [{"id": i - 60, "file_id": rng.randint(1, 12), "name": rng.choice(["new", "new", "get", "x"]), "kind": rng.choice(kinds), "is_export": rng.random() < 0.8, "visibility": None} for i in range(120)]
    fs = [(i, f"src/{'ab'[i % 2]}/{'mod' if i % 3 else 'm'}{i % 4}.rs") for i in range(1, 13)]
    es = [(rng.choice(ns)["id"], rng.choice(ns)["id"], "imports", 1.0) for _ in range(30)]
    refs = [(i, rng.choice(ns)["id"], rng.choice(["new", "get", "x", "none"]), rng.choice(["calls", "type_ref", "imports"]), rng.choice([None, "./mod1", "b/m0", "", "nowhere", "./"])) for i in range(200)]
    by, path = {n["id"]: n for n in ns}, dict(fs)
    imports = {(by[a]["file_id"], by[b]["file_id"]) for a, b, *_ in es}
    want = {}
    for i, s, name, kind, imp in refs:
        f = by[s]["file_id"]
        met = [n for n in ns if n["is_export"] and n["name"] == name and n["file_id"] != f]
        bare = (imp or "").removeprefix("./")
        best = []
        for n in met:
            v = 0.85 if (f, n["file_id"]) in imports else 0.8 if bare and path[n["file_id"]].rsplit(".", 1)[0].endswith(bare) else 0.3 if len(met) > 1 else 0.5
            best.append((-round(min(v + 0.05, 0.99) if n["kind"] in resolve.PREFERRED.get(kind, ()) else v, 6), n["id"]))
        if best and -min(best)[0] > 0.3:
            want[i] = (min(best)[1], -min(best)[0])
    assert resolved(spark, ns, refs, es, fs) == want and len({v for _, v in want.values()}) >= 4


def test_bm25_equals_definition_and_index(spark, tmp_path):
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "gh", "ij"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(40)]
    query = X.Query((("ab",), ("cd", "ef")))
    df = spark.createDataFrame(docs, "id long, t string")
    got = {r["id"]: r["bm25"] for r in search.bm25(df, query, ["t"]).collect()}
    split = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, split.values())) / len(docs)
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t in words for d in [sum(t in w for w in split.values())]}
    want = {}
    for i, w in split.items():
        parts = [sum((idf[t] if idf[t] > 0 else 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in g) for g in query.groups if all(t in w for t in g)]
        if parts:
            want[i] = sum(parts)
    assert got == pytest.approx(want)
    search.build_index(df, ["t"], str(tmp_path / "ix"), buckets=4)
    found = {r["doc"]: r["bm25"] for r in search.search_index(spark, str(tmp_path / "ix"), query, 100, buckets=4).collect()}
    assert found == pytest.approx(want)


def test_cluster_labels(spark):
    df = spark.createDataFrame([(1, "a/x"), (2, "a/y"), (3, "a/z"), (4, "b/x"), (5, "r"), (6, "s"), (7, "t")], "id long, path string")
    assert {r["id"]: r["cluster_id"] for r in search.cluster_labels(df).collect()} == {1: "a", 2: "a", 3: "a", 4: None, 5: "", 6: "", 7: ""}


def ranks_by_hand(ids, es, steps):
    out = {i: sum(a == i for a, _ in es) for i in ids}
    r = {i: 1 / len(ids) for i in ids}
    for _ in range(steps):
        lost = sum(r[i] for i in ids if not out[i])
        r = {i: 0.15 / len(ids) + 0.85 * (sum(r[a] / out[a] for a, b in es if b == i) + lost / len(ids)) for i in ids}
    return r


def test_pagerank(spark):
    es = [(1, 2), (1, 2), (2, 3), (3, 3), (3, 1)]  # parallel edges, a loop, vertex 4 without a way out
    ns = nodes(spark, [{"id": i, "name": f"n{i}"} for i in range(1, 5)])
    got = {r["id"]: r["rank"] for r in graph.pagerank(ns, edges(spark, [(a, b, "calls", 1.0) for a, b in es]), 8, tolerance=None).collect()}
    assert got == pytest.approx(ranks_by_hand([1, 2, 3, 4], es, 8)) and sum(got.values()) == pytest.approx(1.0)


def test_impact_and_paths(spark):
    es = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (1, 2)]
    ns, ed = nodes(spark, [{"id": i, "name": f"n{i}"} for i in range(1, 7)]), edges(spark, [(a, b, "calls", 1.0) for a, b in es])
    got = {(r["direction"], r["id"]): r["depth"] for r in graph.impact(ns, ed, "n1", "both", 2).collect()}
    assert got == {("callees", 2): 0, ("callees", 3): 0, ("callees", 4): 1, ("callers", 4): 0, ("callers", 2): 1, ("callers", 3): 1}
    assert graph.impact(ns, ed, "nobody", "callees", 3).count() == 0
    paths = [r["path"] for r in graph.simple_paths(ns, ed, "n1", "n5", 5).collect()]
    assert paths == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert [r["path"] for r in graph.simple_paths(ns, ed, "n1", "n1", 5).collect()] == [[1]]
    assert graph.simple_paths(ns, ed, "n1", "n6", 5).count() == 0 and graph.simple_paths(ns, ed, "n1", "n5", 2).count() == 0
    assert {r["id"] for r in graph.bridges(ed, spark.createDataFrame([(4,)], "id long")).collect()} == {1, 2, 3, 5}


def most_rows(df):
    """The most rows that a step of the plan gave while ``df`` was collected."""
    def walk(plan):
        own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
        kids = plan.children()
        return max([own, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_enclosing_meets_no_pairs(spark):
    """A file of many nodes that many places ask for, against all pairs."""
    rng = random.Random(7)
    ns = [{"id": i, "name": "n", "file_id": rng.choice([1, 1, 1, 2, None]), "line_start": a, "line_end": a + rng.choice([-2, 0, 1, 3, 40, 400])} for i in range(600) for a in [rng.randint(-30, 500)]]
    ns.append({"id": 900, "name": "n", "line_start": None})
    ps = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-60, 900)])) for i in range(900)]
    want = {}
    for i, f, line in ps:
        hit = [(n["line_end"] - n["line_start"], n["id"]) for n in ns[:-1] if f is not None and line is not None and n["file_id"] == f and n["line_start"] <= line <= n["line_end"]]
        if hit:
            want[i] = min(hit)[1]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = lookup.enclosing_nodes(spark.createDataFrame(ps, "id long, file_id long, line long"), nodes(spark, ns))
        assert {r["id"]: r["node_id"] for r in df.collect()} == want and len(want) > 300
        assert most_rows(df) < 15000  # the pairs of a file are over 100,000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_enclosing_and_touching(spark):
    ns = nodes(spark, [{"id": 1, "name": "a", "line_start": 1, "line_end": 50}, {"id": 2, "name": "b", "line_start": 10, "line_end": 20}, {"id": 3, "name": "c", "line_start": 10, "line_end": 20}])
    places = spark.createDataFrame([(7, 1, 15), (8, 1, 40), (9, 1, 60)], "id long, file_id long, line long")
    assert {r["id"]: r["node_id"] for r in lookup.enclosing_nodes(places, ns).collect()} == {7: 2, 8: 1}
    ed = edges(spark, [(1, 2, "calls", 0.5), (2, 3, "calls", 0.5), (4, 5, "calls", 0.5), (1, 2, "calls", 0.5)])
    assert lookup.edges_touching(ed, spark.createDataFrame([(2,)], "id long")).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 80), st.integers(0, 30)), max_size=12), st.integers(0, 6))
def test_merge_is_disjoint_and_covers(ranges, padding):
    total = 100
    got = context.merge([(a, a + n, "x") for a, n in ranges], total, padding)
    lines = {i for a, b, _ in got for i in range(a, b + 1)}
    assert lines == {i for a, n in ranges for i in range(max(1, a - padding), min(a + n + padding, total) + 1)}
    assert all(x[1] + 1 < y[0] for x, y in itertools.pairwise(got))


def test_merge_and_split_by_hand(spark):
    assert context.merge([(10, 20, "a"), (18, 30, "b"), (50, 60, "c")], 100, 5) == [(5, 35, ["a", "b"]), (45, 65, ["c"])]
    df = spark.createDataFrame([(1, 10, 20, 100), (1, 18, 30, 100), (1, 50, 60, 100)], "file_id long, line_start long, line_end long, total_lines long")
    assert sorted((r["line_start"], r["line_end"], r["n"]) for r in context.merge_ranges(df).collect()) == [(5, 35, 2), (45, 65, 1)]
    b = spark.createDataFrame([(8000,)], "b long")
    r = b.select(*[c.alias(k) for k, c in context.budget_split(F.col("b"), Config()).items()]).first().asDict()
    assert (r["memory"], r["code"], r["usable"], r["pivot"], r["bridge"], r["skeleton"]) == (800, 7200, 6480, 3888, 648, 1944)


def test_allocation_skips_what_does_not_fit():
    results = [{"id": i, "file_id": i, "path": f"d/f{i}", "name": f"n{i}", "score": 1.0 - i / 10, "cluster_id": None} for i in range(4)]
    ranges = [{"id": i, "file_id": i, "path": f"d/f{i}", "name": f"n{i}", "line_start": 1, "line_end": 2} for i in range(3)]
    contents = {0: "x" * 300, 1: "y" * 5000, 2: "z" * 200}
    got = context.allocate(results, ranges, contents, {}, lambda ids: [{"id": 9, "path": "p", "name": "b", "signature": "fn b()"}] if ids else [], lambda f, level: "sk" * 5, 400, "explore")
    assert [(r[0], r[1]) for r in got.rows] == [("pivot", "d/f0"), ("pivot", "d/f2"), ("bridge", "p"), ("skeleton", "d/f3")]
    assert got.total_tokens == 100 + 67 + 2 + 4
    assert context.allocate([], [], {}, {}, lambda ids: [], lambda f, level: None, 400, "explore").rows == []


def observations(spark, rows):
    return spark.createDataFrame(rows, "id long, session_id long, content string, headline string, created_at string, is_stale boolean").withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_consolidation(spark):
    obs = observations(spark, [(1, 1, "the cache is wrong here", "a", "2024-01-01 00:00:00", False), (2, 1, "something else altogether", "b", "2024-01-01 00:01:00", False), (3, 1, "the cache is wrong here!", "c", "2024-01-01 00:02:00", False)])
    pairs = memory.consolidation(obs, 3)
    assert {r["id"]: r["consolidated"] for r in pairs.collect()} == {1: True, 2: False}
    done = {r["id"]: (r["consolidated_into"], r["is_stale"], r["stale_reason"]) for r in memory.apply_consolidation(obs, pairs).collect()}
    assert done == {1: (3, True, "consolidated"), 2: (None, False, None), 3: (None, False, None)}


def test_anti_patterns(spark):
    rows = [(i, 1, "t", "h", f"2024-01-01 0{i}:00:00", False) for i in range(5)] + [(10 + i, 2, "t", "h", f"2024-01-01 00:00:{i:02d}", False) for i in range(6)]
    obs = observations(spark, rows)
    links = spark.createDataFrame([(i, 7) for i in range(4)] + [(4, 8)], "observation_id long, file_id long")
    got = {r["id"]: r["anti_pattern"] for r in memory.anti_patterns(obs, links).collect()}
    assert got == {0: "file_thrashing", 1: "file_thrashing", 2: "file_thrashing", 3: "file_thrashing"} | {10 + i: "rapid_churn" for i in range(6)}


def test_summary_passes_over_what_does_not_fit(spark):
    obs = observations(spark, [(1, 1, "", "a" * 300, "2024-01-01 00:00:00", False), (2, 1, "", "b" * 300, "2024-01-01 00:01:00", False), (3, 1, "", "c", "2024-01-01 00:02:00", False), (4, 1, "", "c", "2024-01-01 00:03:00", False), (5, 1, "", "x" * 900, "2024-01-01 00:04:00", False)])
    sessions = spark.createDataFrame([(1, "2024-01-01 00:04:00")], "id long, u string").select("id", F.col("u").cast("timestamp").alias("updated_at"))
    assert [r["summary"] for r in memory.session_summaries(sessions, obs, "2024-01-02 00:00:00").collect()] == ["a" * 300 + "; c"]
    assert memory.session_summaries(sessions, obs, "2024-01-01 01:00:00").count() == 0


def test_search_ttl_and_staleness(spark):
    obs = observations(spark, [(1, 1, "alpha beta", "h", "2024-01-01 00:00:00", False), (2, 2, "alpha", "h", "2024-01-08 00:00:00", True)] + [(i, 3, "other", "h", "2024-01-01 00:00:00", False) for i in range(3, 9)])
    got = [(r["id"], round(r["score"], 6)) for r in memory.search(obs, "alpha", "2024-01-08 00:00:00", 5, session_id=1).collect()]
    assert got[0][0] == 1 and got[1] == (2, round((0.4 + 0.3 + 0.1) * 0.4, 6))
    assert memory.ttl(obs, "2024-01-08 00:00:00", 7).count() == 8 and memory.ttl(obs, "2024-01-08 00:00:01", 7).count() == 1
    links = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "observation_id long, file_id long, content_hash_at_link string")
    fs = spark.createDataFrame([(5, "a"), (6, "c")], "id long, content_hash string")
    assert [r["id"] for r in memory.stale(links, fs).collect()] == [2]


def test_structural_diff(spark):
    old = nodes(spark, [{"id": 1, "name": "same", "signature": "s", "line_start": 1}, {"id": 2, "name": "mod", "signature": "s", "line_start": 20}, {"id": 3, "name": "old", "signature": "s", "line_start": 40}, {"id": 4, "name": "gone", "signature": "s", "line_start": 80}])
    new = nodes(spark, [{"id": 1, "name": "same", "signature": "s", "line_start": 3}, {"id": 2, "name": "mod", "signature": "t", "line_start": 20}, {"id": 3, "name": "new", "signature": "s", "line_start": 42}, {"id": 5, "name": "add", "signature": "s", "line_start": 200}])
    got = {(r["name"], r["change"], r["old_name"]) for r in resolve.structural_diff(old, new).collect()}
    assert got == {("mod", "modified", None), ("new", "renamed", "old"), ("add", "added", None), ("gone", "removed", None)}


def test_shared_and_cross(spark):
    ns = nodes(spark, [{"id": 1, "file_id": 1, "name": "a"}, {"id": 2, "file_id": 2, "name": "b"}, {"id": 3, "file_id": 3, "name": "T", "kind": "struct"}])
    ed = edges(spark, [(1, 3, "type_ref", 1.0), (2, 3, "contains", 1.0)])
    assert [(r["id"], r["file_count"]) for r in resolve.shared_types(ns, ed).collect()] == [(3, 2)]
    meta = ns.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    assert {r["id"]: r["metadata"] for r in resolve.mark_shared(meta, resolve.shared_types(ns, ed)).collect()}[3] == {"shared_type": "true"}
    refs = spark.createDataFrame([(9, 1, "T", "type_ref", None), (8, 1, "zz", "calls", None)], "id long, source_node_id long, target_name string, edge_kind string, import_path string")
    got = resolve.resolve_cross_workspace(refs, {"w1": ns, "w2": ns}).collect()
    assert sorted((r["ref_id"], r["target_workspace"], r["target_qualified_name"], r["confidence"]) for r in got) == [(9, "w1", "T", 0.7), (9, "w2", "T", 0.7)]


def test_files_are_dealt_before_they_are_parsed(spark):
    """A table that is read as one part is parsed by more tasks than one."""
    from ctxgraph.operators import extract
    from ctxgraph.operators.skeleton import skeletons

    df = spark.createDataFrame([(f"src/{i}.py", "python", f"def f{i}():\n    pass\n") for i in range(40)], "path string, language string, content string").coalesce(1)
    for out in (extract.extract_files(df), skeletons(df)):
        assert out.rdd.getNumPartitions() == 4 and out.select("path").distinct().count() == 40


def test_postings_are_counted_where_their_document_is(spark, monkeypatch):
    """One exchange, by document, of more parts the more text there is."""
    df = spark.createDataFrame([(i, f"ab cd ab w{i}") for i in range(50)], "id long, t string")
    monkeypatch.setattr(search, "PART_BYTES", 50)
    kept = search.postings(df, ["t"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc") == plan.count("Exchange") == 1
    total = sum(len(f"ab cd ab w{i}") for i in range(50))
    assert kept.rdd.getNumPartitions() == -(-total // 50) and kept.where("term = 'ab' AND tf = 2").count() == 50
