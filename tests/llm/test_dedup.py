import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxgraph.llm import simhash, suffix


def fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """(id, fp) -> {row: smallest id reachable}; by all pairs."""
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                group[root(i)] = root(j)
    low: dict = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return [low.get(root(i)) for i in range(len(fps))]


def test_simhash(spark, documents):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(120):
        ws = rng.choices(vocabulary, k=rng.randint(1, 80))
        rows.append((2 * i + 10, " ".join(ws)))
        if i % 4 == 0:
            ws[rng.randrange(len(ws))] = "other"
            rows.append((2 * i + 11, "  ".join(ws).upper()))
    rows += [(1, None), (3, ""), (4, " \t\n"), (5, "one two"), (6, "ONE  two"), (7, "é à"), (8, "x " * 20_000), (None, "one two"), (None, None), (5, "one two")]
    rows += [(1000 + i, "a copy of the same text over and over") for i in range(60)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(rows)).withColumn("fingerprint", simhash.hex16(F.col("fp"))).collect())
    fps = [(k, fingerprint(t)) for k, t in rows]
    want = sorted((k is None, k or 0, f"{fp:016x}", c) for (k, fp), c in zip(fps, components(fps)))
    assert got == want
    assert simhash.near_duplicates(documents([])).count() == 0


def test_links_find_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, np.uint64)
    near = [int(b) for b in base]
    for b in base[:80]:
        x = int(b)
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(bit)
        near.append(x)
    fps = sorted(set(near))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for n in (100, 10**9):  # segments for few and for many fingerprints
        links = simhash.links(df, n=n).collect()
        got = {frozenset((r["a"], r["b"])) for r in links}
        signed = [(None, f) for f in fps]
        low = components([(i, f) for i, (_, f) in enumerate(signed)])
        merged = len(fps) - len(set(low))
        assert all((np.int64(a).view(np.uint64) ^ np.int64(b).view(np.uint64)).item().bit_count() <= 4 for a, b in map(tuple, got))
        from ctxgraph.llm.common import forest

        a, b = np.array([r["a"] for r in links]), np.array([r["b"] for r in links])
        assert len(forest(a, b)[0]) == merged


def test_deduplicate(spark, documents):
    rows = [(3, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, "something else that is not alike at all"), (None, "alpha beta gamma delta epsilon"), (None, "a text without any id that stands alone here")]
    got = sorted((r["doc_id"] or 0, r["text"][:5]) for r in simhash.deduplicate(documents(rows)).collect())
    assert got == [(0, "a tex"), (1, "alpha"), (2, "somet")]
    twice = rows + [(1, "alpha beta gamma delta epsilon"), (3, "an id of two texts, this one on its own")]
    got = sorted((r["doc_id"] or 0, r["text"][:5]) for r in simhash.deduplicate(documents(twice)).collect())
    assert got == [(0, "a tex"), (1, "alpha"), (2, "somet"), (3, "an id")]  # the other text of id 3 goes with its group


def test_deduplicate_keeps_one_of_copies_without_ids(spark, documents):
    alone = "a text without any id that stands alone here"
    rows = [(None, alone), (None, alone), (None, alone.upper()), (None, "another one, quite different from it"), (1, "alpha beta gamma delta epsilon"), (None, "alpha beta gamma delta epsilon")]
    got = sorted((r["doc_id"] or 0, r["text"][:5].lower()) for r in simhash.deduplicate(documents(rows)).collect())
    assert got == [(0, "a tex"), (0, "anoth"), (1, "alpha")]


def check_suffix(spark, documents, rows, **how):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(documents(rows), digest=True, block_bytes=2000, **how).collect()}
    want = {i: (n, g, s, hashlib.sha256(k).hexdigest()) for i, (n, g, s, k) in suffix.brute([(i, (t or "").encode()) for i, t in rows]).items()}
    assert got == want


def test_suffix_dedup(spark, documents):
    rng = random.Random(2)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [piece(n) for n in (49, 50, 60, 75, 130, 400)]
    rows = []
    for i in range(60):
        parts = [piece(rng.randint(0, 120)) for _ in range(3)] + rng.choices(shared, k=rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i * 3 % 61, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "a" * 300), (104, "ab" * 200), (105, "ba" * 100), (106, rows[0][1]), (107, "x" + shared[5][:399] + "y"), (108, piece(20_000))]
    check_suffix(spark, documents, rows)
    check_suffix(spark, documents, rows, hot=1)  # anchors of two contexts in a block are hot
    check_suffix(spark, documents, rows, hot_all=2)
    assert suffix.dedup(documents([])).count() == 0
    plain = suffix.dedup(documents([(1, "k" * 60), (2, "é" + "k" * 60 + "z"), (2, "é" + "k" * 60 + "z"), (None, "k" * 60)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in plain) == [(0, ""), (1, "k" * 60), (2, "éz"), (2, "éz")] and set(plain[0].asDict()) >= {"lang", "source", "n_chars"}


def test_hot_anchors_lose_every_occurrence(spark, documents):
    rng = random.Random(8)
    piece = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = piece(70) + "\n", piece(200)
    rows = [(1, piece(30) + line + piece(30) + passage + piece(1900))]  # a block of its own
    rows += [(10 + i, piece(20) + line * 4 + piece(20) + (passage + "|") * 2 + line) for i in range(3)]
    rows += [(20, line * 5), (21, piece(1990) + line * 3)]
    for how in ({}, {"hot": 1}, {"hot_all": 1}, {"hot": 1, "hot_all": 1}):
        check_suffix(spark, documents, rows, **how)


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=400), st.integers(0, 3))
def test_sorting_orders_suffixes(text, seed):
    body = text.encode()
    n = max(0, len(body) - 49)
    starts = np.array(sorted(range(n), key=lambda i: hash((i, seed))), np.int64)
    order, joined = suffix.sort_suffixes(body, starts)
    keys = [body[s : s + 50] for s in starts[order]]
    assert keys == sorted(keys) and [bool(j) for j in joined] == [i > 0 and keys[i] == keys[i - 1] for i in range(len(keys))]


def similar(texts, words=5, least=0.8):
    """Groups (sets of places) of texts by links of Jaccard similarity; by all pairs."""
    def grams(t):
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split(" ")
        ws = [w for x in ws for w in x.split()]
        return frozenset(tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1)))

    sets = [grams(t) for t in texts]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [{j for j in range(len(sets)) if group[j] == g} for g in dict.fromkeys(group)]


def test_near_copies_of_similarity_are_one(spark, documents):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        ws = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 9, 60, 200, 2500]))]
        rows.append((10 * i + 5, " ".join(ws)))
        for k in range(rng.randint(0, 4)):  # edits that leave similarities on both sides of 0.8
            edited = list(ws)
            for _ in range(rng.randint(1, 2 + len(ws) // 40)):
                edited[rng.randrange(len(edited))] = f"e{rng.random()}"
            rows.append((10 * i + 6 + k, "  ".join(edited).upper() if k == 2 else " ".join(edited)))
    rows += [(1000 + i, "a hot passage that very many documents share word by word " * 3 + f"end {i // 40}") for i in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "x y"), (2004, "X  y"), (2005, "x " * 9000), (2006, "x " * 8000)]
    groups = similar([t for _, t in rows])
    want = sorted({min(rows[j][0] for j in g) for g in groups})
    docs = documents(rows).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("raw", F.lit(2)).withColumn("bands", F.lit(3))
    got = simhash.deduplicate(docs.repartition(5))
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted(r["doc_id"] for r in kept) == want and {(r["fp"], r["root"], r["raw"], r["bands"]) for r in kept} == {("clash", 1, 2, 3)}
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_length_bounds(spark, documents):
    rng = random.Random(3)
    piece = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = piece(300)
    rows = [(i, piece(90) + shared[i : i + 120] + piece(60)) for i in range(12)]
    for length in (32, 87):
        got = {r["doc_id"]: r["kept_sha256"] for r in suffix.dedup(documents(rows), length=length, digest=True, block_bytes=600).collect()}
        assert got == {i: hashlib.sha256(k).hexdigest() for i, (*_, k) in suffix.brute([(i, t.encode()) for i, t in rows], length).items()}
    for length in (31, 88, 100):
        with pytest.raises(ValueError):
            suffix.dedup(documents(rows), length=length)


def test_crowded_bands_lose_no_link(spark, documents):
    """Pairs of near copies in a crowd of texts like neither: some meet in crowded bands only."""
    rng = random.Random(5)
    word = lambda: f"w{rng.random()}"
    common = [word() for _ in range(240)]
    rows = []
    for i in range(300):
        own = list(common)
        for at in rng.sample(range(240), 5):
            own[at] = word()
        twin = list(own)
        for at in rng.sample(range(240), 5):
            twin[at] = word()
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(twin))]
    groups = similar([t for _, t in rows])
    assert len(groups) == 300
    got: dict = {}
    for r in simhash.similar_groups(documents(rows)).collect():
        got.setdefault(r["root"], set()).add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
