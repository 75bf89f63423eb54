import hashlib
import zlib

from pyspark.sql import functions as F

from ctxgraph.llm import license_scan, quality, sharding

MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"


def by_hand(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in license_scan.BASE:
        ps = phrase.split()
        hit = [i for i in range(len(words) - len(ps) + 1) if words[i : i + len(ps)] == ps]
        at += hit
        labels |= {label} if hit else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark, documents):
    texts = [None, "", "The MIT License, MIT\nlicense; and Apache-License x", "GNU General Public License general public license", "mit-license é mit licensé", MIT, MIT.replace("person", "human"), MIT.replace("granted", "given"), "MIT License " * 3000, "general public", "Licensed under the Apache License, Version 2.0", "ΜIT LICENSE"]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(list(enumerate(texts))).withColumn("labels", F.lit("clash")).select("doc_id", "text", "labels", "lang")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == by_hand(t), i
        assert 0 <= r["score"] <= 1
    assert got[5]["labels"] == "mit-grant" and got[5]["score"] == 1.0 and got[6]["labels"] == "mit-grant" and got[6]["score"] < 1
    assert got[7]["labels"] == "" and "apache-2.0" in got[10]["labels"] and got[2]["labels"].split(",")[:2] == ["apache", "mit"]
    assert license_scan.scan(documents([])).count() == 0


def test_no_python_in_the_scan(spark, documents):
    plan = license_scan.scan(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_interleave(spark, documents):
    rows = [(i, f"t{i}", "hot" if i % 3 else ("a" if i % 2 else None)) for i in range(500)] + [(7, "t7", "hot")] * 3 + [(None, None, None)] * 2
    got = sharding.interleave(documents(rows).withColumn("slot", F.lit("clash"))).collect()
    assert len(got) == 505
    shards: dict[int, list] = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(16)) and {len(s) for s in shards.values()} <= {31, 32}
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
        hot = sum(r["source"] == "hot" for r in s)
        assert abs(hot - len(s) * 337 / 505) <= 2  # the mixture
    assert sharding.interleave(documents([])).count() == 0
    order = lambda d: sorted((r["doc_id"], r["shard"], r["slot"]) for r in d.collect())
    once = documents([r for r in rows[:500]])
    assert order(sharding.interleave(once)) == order(sharding.interleave(once.repartition(7)))


def words(seed, n, bad):
    out = []
    for i in range(n):
        h = hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
        out.append(h[:6].upper() + "!!" if bad and i % 2 else ["the", "river", "stone", "quiet", "house", "green", "walks", "under"][int(h, 16) % 8])
    return " ".join(out)


def test_quality(spark, documents):
    rows = [(i, words(i, 60, i % 2)) for i in range(600)] + [(900, None), (901, ""), (902, "x" * 300_000)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(600)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in quality.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == 1 - i % 2 for i in held) / len(held) >= 0.95
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(5), quality.fit(docs.repartition(3), labels.where(~quality.held_out(F.col("doc_id"))))).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in again)
    none = quality.fit(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5} and quality.score(docs.limit(0), none).count() == 0


def test_quality_on_the_labelled_tables(spark):
    import numpy as np

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    assert model.curve[1] > 0
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(score[r["doc_id"]], r["quality"]) for r in labels.where(quality.held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).collect() if r["doc_id"] in score]
    good, bad = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2 >= 0.95
    assert (good >= 0.3).mean() >= 0.95


def test_interleave_by_brute_force(spark, documents):
    rng = __import__("random").Random(4)
    rows = [(i, "t", rng.choice(["hot", "hot", "hot", "a", None])) for i in range(333)]
    strata: dict = {}
    for k, _, source in rows:
        strata.setdefault(source, []).append(k)
    places = []
    for source, ids in strata.items():
        ranked = sorted(ids, key=lambda k: hashlib.md5(f"{sharding.SEED}:{k}".encode()).hexdigest())
        places += [((2 * r + 1) / (2 * len(ids)), hashlib.md5(f"{sharding.SEED}:{k}".encode()).hexdigest(), k) for r, k in enumerate(ranked)]
    want, slots = {}, [0] * 16
    for p, (_, _, k) in enumerate(sorted(places)):
        shard = p * 16 // len(rows)
        want[k] = (shard, slots[shard])
        slots[shard] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(documents(rows)).collect()} == want
