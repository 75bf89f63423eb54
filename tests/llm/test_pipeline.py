import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from ctxgraph.llm import quality, suffix  # noqa: E402
from ctxgraph.llm.common import read_table  # noqa: E402
from ctxgraph.llm.queries import quality_model  # noqa: E402

from .test_decontaminate_warc import brute as leaks  # noqa: E402
from .test_dedup import similar  # noqa: E402


def text(rng, n, bad=False):
    return " ".join(hashlib.md5(str(rng.random()).encode()).hexdigest()[:5].upper() + "#" if bad else rng.choice(["river", "stone", "quiet", "house", "green", "walks", "under", "light"]) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from .conftest import DOCS

    rng = random.Random(6)
    passage, items = text(rng, 30), [(i, text(rng, 25)) for i in range(8)]
    rows = [(i, text(rng, rng.randint(20, 120), i % 4 == 0)) for i in range(240)]
    good = [r for r in rows if r[0] % 4]
    rows += [(300 + i, t) for i, (_, t) in enumerate(good[:10])]  # copies
    rows += [(320 + i, t[:-3] + "end") for i, (_, t) in enumerate(good[10:20])]  # near copies
    rows += [(340 + i, text(rng, 40) + " " + passage + " " + text(rng, 40)) for i in range(8)]  # a passage in many
    rows += [(360 + i, text(rng, 40) + "\n" + t + "\n" + text(rng, 40)) for i, t in items]  # leaks
    rows += [(400, None), (401, ""), (402, good[0][1] + " " + text(rng, 9000)), (None, text(rng, 30)), (403, text(rng, 20)), (403, text(rng, 20))]
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs = read_table(spark, folder, "documents")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert n == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{n}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    pairs = lambda rows: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows))

    before, after = seen["quality"]
    base = read_table(spark, folder, "documents")
    scored = quality.score(base, quality_model(spark, base.select("doc_id", "text"), folder)).where("predicted = 1").collect()
    assert pairs(after) == pairs(scored)
    kept = {r["doc_id"] for r in after}
    assert sum(i in kept for i in range(240) if i % 4) >= 175 and sum(i in kept for i in range(0, 240, 4)) <= 4

    before, after = seen["near_duplicates"]  # five words, Jaccard similarity of 0.8 or more, by all pairs
    first = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5((r["text"] or "").encode()).digest())
    want = [min((before[i] for i in g), key=first) for g in similar([r["text"] for r in before])]
    assert pairs(after) == pairs(want) and len(after) < len(before)
    assert not {r["doc_id"] for r in after} & set(range(320, 330))  # the near copies

    before, after = seen["repeated_passages"]
    cut = suffix.brute([(r["doc_id"] if r["doc_id"] is not None else suffix.NO_ID, (r["text"] or "").encode()) for r in before if r["doc_id"] != 403])
    got = {r["doc_id"]: r for r in after}
    assert all(got[None if i == suffix.NO_ID else i]["text"].encode() == k for i, (_, _, _, k) in cut.items())
    assert all(r["n_chars"] == len(r["text"]) for r in after) and len(after) == len(before)

    before, after = seen["decontaminate"]
    items = [(r[0], r[1]) for r in read_table(spark, folder, "benchmark").collect()]
    dirty = {k for k, _ in leaks([(r["doc_id"], r["text"]) for r in before], items)}
    assert pairs(after) == pairs([r for r in before if r["doc_id"] not in dirty]) and len(dirty) >= 7

    before, after = seen["pack"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_stages_on_empty_tables_and_clashing_columns(spark, folder):
    docs = read_table(spark, folder, "documents").where("doc_id < 60 OR doc_id > 300")
    for c in ("score", "predicted", "fp", "root", "raw", "n_removed", "__digest", "sequence_id"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "pack":
            assert out.where("sequence_id LIKE 'own%'").count() == 0 and out.count() > 0
        else:
            assert out.columns == docs.columns
            assert {tuple(r)[5:] for r in out.collect()} == {tuple(r)[5:] for r in docs.limit(1).collect()}
        assert stage(spark, docs.limit(0), folder).count() == 0
