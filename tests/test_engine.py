"""Source trees end to end: scan, extract, index, tools, streams."""

import pytest
from pyspark.sql import functions as F

from ctxgraph.engine import Engine
from ctxgraph.functions import text as X
from ctxgraph.operators.extract import extract
from ctxgraph.operators.skeleton import skeleton
from ctxgraph.sources import workspace
from ctxgraph.sources.config import Config, load, setup
from ctxgraph.streaming import changes

A = "pub fn alpha(n: i32) -> i32 {\n    beta(n)\n}\n\npub struct Widget { pub size: i32 }\n\nimpl Widget {\n    pub fn new() -> Self { Widget { size: 1 } }\n}\n"
B = "pub fn beta(n: i32) -> i32 { n + 1 }\nfn gamma() { alpha(2); }\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "src/a.rs").write_text(A)
    (root / "src/b.rs").write_text(B)
    (root / "src/app.py").write_text("import os\n\nclass Service:\n    def start(self):\n        return os.getenv('API_KEY')\n")
    (root / ".env").write_text("API_KEY=secret\n")
    (root / "node_modules/x.js").write_text("function hidden() {}\n")
    (root / "notes.txt").write_text("no")
    e = Engine(spark, str(root), str(tmp_path_factory.mktemp("store")))
    e.trigger_reindex()
    return e


def test_scan_and_index(engine):
    assert sorted(r["path"] for r in engine.list_files().collect()) == [".env", "src/a.rs", "src/app.py", "src/b.rs"]
    assert engine.trigger_reindex() == {"version": 1, "same": 4}
    names = {r["name"]: r for r in engine.table("nodes").collect()}
    assert {"alpha", "beta", "gamma", "Widget", "new", "Service", "start"} <= set(names) and "hidden" not in names
    calls = {(r["source_name"], r["target_name"]): r["confidence"] for r in engine.query_edges(kind="calls").collect()}
    assert calls == {("alpha", "beta"): 0.55, ("gamma", "alpha"): 0.55}


def test_incremental_equals_full(spark, engine, tmp_path):
    import pathlib
    import shutil

    root = tmp_path / "ws"
    shutil.copytree(engine.root, root)
    one = Engine(spark, str(root), str(tmp_path / "one"))
    one.trigger_reindex()
    pathlib.Path(root / "src/b.rs").write_text(B.replace("beta(n: i32)", "beta(n: i64)") + "pub fn delta() { alpha(3); }\n")
    pathlib.Path(root / "src/app.py").unlink()
    assert one.trigger_reindex() == {"version": 2, "same": 2, "changed": 1, "deleted": 1}
    two = Engine(spark, str(root), str(tmp_path / "two"))
    two.trigger_reindex()
    for t in ("files", "nodes", "edges", "refs", "postings", "corpus"):
        cols = [c for c in one.table(t).columns if c not in ("metadata", "content")]
        a, b = (sorted(map(str, e.table(t).select(*cols).collect())) for e in (one, two))
        assert a == b, t


def test_reindex_by_time_names_and_submitted_edges(spark, engine, tmp_path):
    import os
    import shutil

    root = tmp_path / "ws"
    shutil.copytree(engine.root, root)
    more = tmp_path / "lib"
    more.mkdir()
    (more / "z.rs").write_text("pub fn zeta() {}\n")
    e = Engine(spark, str(root), str(tmp_path / "store"), roots=[str(more)])
    assert e.trigger_reindex() == {"version": 1, "new": 5} and e.query_nodes("zeta").collect()[0]["path"] == "lib/z.rs"
    (root / "src/b.rs").write_text(B + "pub fn delta() {}\n")
    (root / "src/new.rs").write_text("pub fn fresh() {}\n")
    assert e.trigger_reindex(files=["src/b.rs"]) == {"version": 2, "changed": 1}
    assert {r["name"] for r in e.table("nodes").collect()} >= {"delta", "zeta"} and not e.table("nodes").where("name = 'fresh'").count()
    assert e.trigger_reindex(files=["src/b.rs"], full=True) == {"version": 3, "same": 5, "new": 1}
    os.utime(root / "src/a.rs", ns=(1, 1))  # a new time, the same content
    assert e.trigger_reindex() == {"version": 4, "same": 6}
    assert e.table("files").where("path = 'src/a.rs'").first()["mtime_ns"] == 1
    assert e.trigger_reindex() == {"version": 4, "same": 6}
    with pytest.raises(ValueError):
        e.trigger_reindex(files=["../out.rs"])
    ids = {r["name"]: r["qualified_name"] for r in e.table("nodes").where("qualified_name is not null").collect()}
    assert e.submit_lsp_edges([{"source": ids["delta"], "target": ids["fresh"], "kind": "calls"}, {"source": "no", "target": "no", "kind": "calls"}]) == {"added": 1, "skipped": 1}
    has = lambda: e.query_edges("delta").where("source_name = 'delta' AND target_name = 'fresh'").count()
    assert has() == 1
    (root / "src/c.rs").write_text("pub fn last() {}\n")
    assert e.trigger_reindex() == {"version": 6, "same": 6, "new": 1}
    assert has() == 1 and e.query_nodes("last").collect()[0]["name"] == "last"
    (root / "src/new.rs").unlink()
    e.trigger_reindex()
    assert has() == 0 and e.table("submitted_edges").count() == 0


def test_text_statistics_are_the_whole_index(engine):
    by_kind = {r["id"]: r["name"] for r in engine.query_nodes("alpha beta", kind="function").collect()}
    assert set(by_kind.values()) == {"alpha", "beta"}
    scores = engine.text_index().bm25(X.parse_or("alpha"), ["name"])
    assert {by_kind.get(r["doc"]) for r in scores.collect()} == {"alpha"}
    assert engine.table("corpus").first()["n"] == engine.table("nodes").count()


def test_tools(engine):
    assert [r["name"] for r in engine.query_nodes("beta").collect()][0] == "beta"
    assert {r["name"] for r in engine.query_nodes(kind="struct").collect()} == {"Widget"}
    assert engine.query_nodes("lph", kind="function").collect()[0]["name"] == "alpha"  # by LIKE
    hits = engine.search("alpha widget", 5).collect()
    assert {"alpha", "Widget"} <= {r["name"] for r in hits}
    got = engine.get_context_capsule("alpha beta").collect()
    assert any(r["section"] == "pivot" and "beta(n)" in r["content"] for r in got)
    assert engine.get_context_capsule("alpha beta").collect() == got
    assert {r["name"] for r in engine.get_impact_graph("beta", "callers").collect()} == {"alpha", "gamma"}
    assert engine.search_logic_flow("gamma", "beta").collect()[0]["hops"] == 2
    assert {r["metric"]: r["value"] for r in engine.index_status().collect()}["files"] == 4
    assert "{ ... }" in engine.get_skeleton("src/a.rs", "minimal") and engine.get_skeleton("nope") is None
    kinds, top = engine.graph_stats(3)
    assert kinds.count() >= 2 and top.count() == 3
    assert [(r["name"], r["reader_count"]) for r in engine.get_env_lineage(list_all=True).collect()] == [("API_KEY", 1)]
    roles = {(r["role"], r["path"]) for r in engine.get_env_lineage("API_KEY").collect()}
    assert ("defines", ".env") in roles and ("reads", "src/app.py") in roles
    assert engine.get_unresolved_refs().count() >= 1
    for bad in (lambda: engine.query_nodes(limit=0), lambda: engine.query_nodes(limit=1001), lambda: engine.search(""), lambda: engine.get_impact_graph("a", depth=21), lambda: engine.get_impact_graph("a", "up"), lambda: engine.get_context_capsule("a", intent="odd")):
        with pytest.raises(ValueError):
            bad()


def test_submitted_edges(engine):
    alpha, widget = (engine.table("nodes").where(F.col("name") == n).first()["qualified_name"] for n in ("alpha", "Widget"))
    assert engine.submit_lsp_edges([{"source": alpha, "target": widget, "kind": "type_ref"}, {"source": alpha, "target": "x::none", "kind": "calls"}]) == {"added": 1, "skipped": 1}
    assert engine.query_edges(symbol="Widget", kind="type_ref", direction="incoming").first()["confidence"] == 0.95


def test_memory_tools(engine):
    a = engine.save_observation("cache sizes come from the alpha call", "s1", "2024-01-01 00:00:00")
    b = engine.save_observation("cache sizes come from the alpha call.", "s1", "2024-01-01 00:01:00")
    engine.save_observation("unrelated note on src/app.py here", "s2", "2024-01-01 00:02:00", symbols=["Widget"])
    rows = {r["id"]: r for r in engine._notes("observations").collect()}
    assert rows[a]["consolidated_into"] == b and rows[a]["is_stale"] and rows[b]["consolidated_into"] is None
    assert engine._notes("files").count() == 1 and engine._notes("symbols").count() == 1
    assert engine.search_memory("cache sizes", 5, now="2024-01-01 01:00:00").first()["id"] == b
    assert [(r["id"], r["observation_count"]) for r in engine.list_sessions().collect()] == [("s2", 1), ("s1", 2)]
    assert {r["section"] for r in engine.get_session_context(include_previous=True).collect()} == {"current", "previous"}
    assert engine.detect_staleness("2024-01-01 05:00:00") == {"stale": 1, "expired": 0, "compressed": 2}


def test_python_extraction():
    e = extract("python", "p/m.py", "import os\nMAX = 1\nclass A(B):\n    def f(self):\n        if 1:\n            self.g()\n        return os.getenv('HOME_X')\n@app.get('/i')\ndef h():\n    pass\n")
    assert [(n["kind"], n["name"]) for n in e.nodes] == [("import", "import os"), ("constant", "MAX"), ("class", "A"), ("method", "f"), ("function", "h"), ("api_endpoint", "GET /i"), ("env_var", "HOME_X")]
    assert ("self.g", "calls", "conditional") in [(r["target_name"], r["edge_kind"], r["context"]) for r in e.refs]
    assert ("B", "extends") in [(r["target_name"], r["edge_kind"]) for r in e.refs]
    assert extract("python", "x.py", "def (").nodes == [] and extract("cobol", "x", "y").nodes == []


def test_dotenv_and_html():
    e = extract("dotenv", ".env", "# c\nA=secret\n\nB_2=\nA=again\nbad key=1\nC=3\n")
    assert [(n["name"], n["line_start"]) for n in e.nodes] == [("A", 1), ("B_2", 3), ("C", 6)] and all("secret" not in n["signature"] for n in e.nodes)
    h = extract("html", "a.html", "<script src='a.js'></script><link href='b.css'><style>p{}</style><script>x</script>")
    assert [(n["kind"], n["name"]) for n in h.nodes] == [("import", "a.js"), ("import", "b.css"), ("module", "<style>")] and not h.edges


def test_rust_typescript_c():
    r = extract("rust", "a.rs", "#[derive(Debug)]\npub enum E { One, Two(i32) }\nimpl Shape for E { fn area(&self) -> f64 { go()?; 1.0 } }\n")
    assert ("enum_variant", "Two") in [(n["kind"], n["name"]) for n in r.nodes] and ("method", "area") in [(n["kind"], n["name"]) for n in r.nodes]
    assert {("Debug", "type_ref"), ("Shape", "implements"), ("go", "calls")} <= {(x["target_name"], x["edge_kind"]) for x in r.refs}
    t = extract("typescript", "a.ts", "import D, { x as y } from './m';\nexport class A extends B implements C { run() { this.go(); } }\nexport const f = () => 1;\n")
    assert [(n["kind"], n["name"], n["is_export"]) for n in t.nodes] == [("import", "import D, { x as y } from './m'", False), ("class", "A", True), ("method", "run", False), ("function", "f", True)]
    assert {("D", "imports"), ("x", "imports"), ("B", "extends"), ("C", "implements"), ("this.go", "calls")} == {(x["target_name"], x["edge_kind"]) for x in t.refs}
    c = extract("c", "a.c", "#include <stdio.h>\nstatic const int N = 2;\nint add(int a) { return sub(a); }\n")
    assert {("import", "#include <stdio.h>"), ("constant", "N"), ("function", "add")} == {(n["kind"], n["name"]) for n in c.nodes}


def test_skeletons():
    src = "# note\nclass A:\n    x = 1\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    assert skeleton(src, "python", "minimal") == "\nclass A: { ... }\n\ndef g(): { ... }\n"
    assert "def f(self):" in skeleton(src, "python", "standard") and skeleton(src, "python", "detailed") == src
    rust = skeleton(A, "rust", "standard")
    assert "pub fn new() -> Self" in rust and "beta(n)" not in rust and len(rust) <= len(A)
    assert skeleton("K=1", "dotenv", "minimal") == "K=1"
    with pytest.raises(ValueError):
        skeleton("", "python", "odd")


def test_config_and_roots(tmp_path):
    assert load(tmp_path / "none.toml") == Config()
    (tmp_path / "c.toml").write_text("token_budget = 5\nmax_file_size = 9\n")
    c = load(tmp_path / "c.toml")
    assert c.token_budget == 5 and c.exclude_patterns == () and c.max_file_size == 9
    with pytest.raises(ValueError):
        Config(pivot_budget_pct=95, bridge_budget_pct=10)
    (tmp_path / "Cargo.toml").write_text("")
    assert setup(tmp_path) == (["rust"], True) and setup(tmp_path) == (["rust"], False) and setup(tmp_path, True)[1]
    (tmp_path / "sub").mkdir()
    (tmp_path / ".gitmodules").write_text('[submodule "a"]\n\tpath = sub\n[submodule "b"]\n\tpath = none\n')
    assert workspace.submodules(tmp_path) == [str(tmp_path / "sub")]
    assert workspace.extra_roots(tmp_path / "sub", [tmp_path / "sub", "/usr"]) == ["/usr"]
    with pytest.raises(ValueError):
        workspace.inside(tmp_path, "../x")


def test_change_feed(spark, tmp_path):
    schema = "path string, mtime_ns long, deleted boolean, seq long"
    rows = [("a.py", 1, False, 1), ("a.py", 2, False, 2), ("b.py", 5, False, 3), (".env", 1, False, 4), ("node_modules/c.js", 1, False, 5), ("d.rs", None, True, 6), ("e.txt", 1, False, 7)]
    feed = spark.createDataFrame(rows, schema)
    files = spark.createDataFrame([("b.py", 5), ("d.rs", 1)], "path string, mtime_ns long")
    assert {(r["path"], r["status"]) for r in changes.changed(changes.relevant(feed), files).collect()} == {("a.py", "changed"), ("d.rs", "deleted")}
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"x{i}"))
    import shutil

    (tmp_path / "in").mkdir()
    for i in range(2):
        shutil.copy(next((tmp_path / f"x{i}").glob("*.parquet")), tmp_path / f"in/f{i}.parquet")
    got = changes.latest(spark, str(tmp_path / "in"), "f*.parquet", feed.schema, "path", ["seq"], ["path", "mtime_ns", "deleted", "seq"])
    assert {r["path"]: r["seq"] for r in got.collect()} == {"a.py": 2, "b.py": 3, ".env": 4, "node_modules/c.js": 5, "d.rs": 6, "e.txt": 7}
    seen = []
    q = changes.watch(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a.py", "b.py", "d.rs"]
