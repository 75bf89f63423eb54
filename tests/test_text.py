"""Exact values of the text functions."""

import time

import pytest
from pyspark.sql import functions as F

from ctxgraph.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()[0]


@pytest.mark.parametrize("given, want", [
    ("parseConfigFile", "parse config file parseconfigfile"), ("get_node_text", "get node text get_node_text"), ("HTMLParser", "html parser htmlparser"), ("", ""),
    ("GraphEngine", "graph engine graphengine"), ("crate::graph::Engine", "crate graph engine crate::graph::engine"), ("simple", "simple"), ("___", "___"), ("getHTTPResponse", "get http response gethttpresponse"),
])
def test_index_tokens(spark, given, want):
    assert one(spark, given, X.tokenize_identifier) == want


@pytest.mark.parametrize("query, want", [
    ("fix the crash in login", "debug"), ("what depends on this", "blast_radius"), ("add a new feature", "modify"), ("how does search work", "explore"), ("the address book", "modify"),
    ("change it", "modify"), ("", "explore"),
])
def test_intent(spark, query, want):
    assert one(spark, query, X.detect_intent) == X.intent_of(query) == want


def test_queries():
    assert X.parse_or("process_event").groups == (("process", "event"),)
    assert X.parse_or("dice game logic").groups == (("dice",), ("game",), ("logic",))
    assert X.parse_and("getNode text_node").groups == (("get", "node", "text"),) or X.parse_and("getNode text_node").groups == (("node", "text"),)
    assert X.parse_or("the of").groups == (("the", "of"),)
    assert X.parse_or("").groups == ()
    assert X.tokenize_query("parseConfig -x") == "parse config parseconfig x x"


def test_scores(spark):
    df = spark.createDataFrame([("parseFile", "fn parse(file)", "src/parse/file.rs")], "n string, s string, p string")
    r = df.select(X.overlap_score("parse the file", F.col("n"), F.col("s")), X.path_bonus("parse the thing", F.col("p"))).first()
    assert r[0] == pytest.approx(1.0) and r[1] == pytest.approx(0.5)


def test_trigrams_and_jaccard(spark):
    assert sorted(one(spark, "abcab", X.trigrams)) == ["abc", "bca", "cab"]
    assert one(spark, "Ab", X.trigrams) == ["ab"] and one(spark, None, X.trigrams) == [""]
    df = spark.createDataFrame([([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in df.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.3333]


def test_trigrams_of_a_long_text(spark):
    """One pass over the text; a pass for each triple would take minutes."""
    assert one(spark, "A😀bÉ\n", X.trigrams) == ["a😀b", "😀bé", "bé\n"] and one(spark, "", X.trigrams) == [""]
    text = "".join(f"Word{i} of é " for i in range(25000))
    low, begin = text.lower(), time.monotonic()
    df = spark.createDataFrame([(text, text[1000:])], "a string, b string")
    got = df.select(X.jaccard(X.trigrams(F.col("a")), X.trigrams(F.col("b")))).first()[0]
    a, b = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (low, low[1000:]))
    assert got == pytest.approx(len(a & b) / len(a | b)) and time.monotonic() - begin < 30


def test_headline_and_symbols(spark):
    assert one(spark, "x" * 100 + "\nmore", X.headline) == "x" * 77 + "..."
    assert one(spark, "See `GraphEngine` and get_node, crate::graph. The This fooBar Foo_Bar", X.symbol_candidates) == ["See", "GraphEngine", "get_node", "crate::graph", "Foo_Bar"]


@pytest.mark.parametrize("imp, path, want", [("./utils", "src/utils.ts", True), ("././utils", "src/utils.ts", True), ("utils", "src/utils.py", True), ("../utils", "src/utils.ts", False), ("", "src/a.py", False), (None, "a.py", False), ("other", "src/utils.ts", False)])
def test_import_paths(spark, imp, path, want):
    df = spark.createDataFrame([(imp, path)], "i string, p string")
    assert df.select(X.import_matches(F.col("i"), F.col("p"))).first()[0] is want


def test_penalty_lines_tokens(spark):
    df = spark.createDataFrame([(False, None, 1.0), (True, "consolidated", 0.3), (True, "linked file changed", 0.5), (True, None, 0.4)], "s boolean, r string, w double")
    assert all(r[0] == r[1] for r in df.select(X.staleness_penalty(F.col("s"), F.col("r")), "w").collect())
    assert one(spark, "a\nb\nc\nd", lambda c: X.lines(c, F.lit(2).cast("long"), F.lit(9).cast("long"))) == "b\nc\nd"
    assert one(spark, "é" * 2, X.token_estimate) == 2 and one(spark, None, X.token_estimate) == 0
