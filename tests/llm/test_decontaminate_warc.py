import base64
import hashlib
import io
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from ctxgraph.llm import decontaminate as D
from ctxgraph.llm import warc


def brute(docs, items, half=64, theta=0.5, overlap=0.5):
    """All pairs by the definition: every passage scored against every segment."""
    import math

    items = [(k, D.words_of(t)) for k, t in dict.fromkeys(items) if t is not None]
    segs = [(n, ws[a:b]) for n, (_, ws) in enumerate(items) for a, b in D.segments(len(ws), half)]
    avg = sum(len(w) for _, w in segs) / max(1, len(segs))
    idf = lambda t: math.log(1 + (len(segs) - sum(t in w for _, w in segs) + 0.5) / (sum(t in w for _, w in segs) + 0.5))
    weight = []
    for _, w in segs:
        norm = 1.2 * (0.25 + 0.75 * len(w) / avg)
        imp = {t: idf(t) * w.count(t) * 2.2 / (w.count(t) + norm) for t in w}
        weight.append({t: v / sum(imp.values()) for t, v in imp.items()})
    out = set()
    for k, text in docs:
        ws = D.words_of(text)
        places: dict = {}
        for lo in range(0, max(1, len(ws)), half):
            own = set(ws[lo : lo + 2 * half])
            for (n, _), w in zip(segs, weight):
                if sum(v for t, v in w.items() if t in own) >= theta - 1e-9:
                    places.setdefault(n, set()).add(lo)
        for n, los in places.items():
            iw, g = items[n][1], min(3, len(items[n][1]))
            cov = {j + x for lo in los for i in range(lo, min(lo + 2 * half, len(ws)) - g + 1) for j in range(len(iw) - g + 1) if iw[j : j + g] == ws[i : i + g] for x in range(g)}
            cut = len(iw) - (len(iw) // 4 if len(iw) >= 4 else len(iw))
            a = sum(j >= cut for j in cov) / (len(iw) - cut)
            q = sum(j < cut for j in cov) / cut if cut else a
            if q >= overlap and a >= overlap:
                out.add((k, items[n][0]))
    return out


def test_decontaminate(spark, documents):
    rng = random.Random(9)
    common, rare = ["the", "of", "and", "to"], ["r%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    items = [(i, text(rng.choice([3, 15, 40, 59, 64, 65, 150]))) for i in range(30)] + [(90, None), (91, ""), (92, "the"), (92, "the"), (None, text(30))]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 200))]
        if i % 3 == 0:
            leak = rng.choice(items[:30])[1].split()
            if i % 2:
                leak[len(leak) // 2] = "edited"
            parts += [" ".join(leak).upper() if i % 4 else ", ".join(leak), text(rng.randint(0, 200))]
        docs.append((i, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[4][1]), (103, " ".join(items[5][1].split()[: len(items[5][1].split()) // 2])), (104, text(30_000) + " " + items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find(documents(docs), bench).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    assert sum((r["doc_id"], r["item_id"]) == (102, 3) for r in got) == 2
    dirty = {k for k, _ in want}
    kept = D.clean(documents(docs), bench).collect()
    assert {r["doc_id"] for r in kept} == {k for k, _ in docs} - dirty
    small = D.find(documents(docs), bench, shard_words=300)  # several shards of the index
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} == want
    assert D.find(documents(docs), bench.limit(0)).count() == 0 and D.clean(documents([]), bench).count() == 0


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark):
    big = "<p>" + "long " * 60_000
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, "é\r\n\r\nWARC/1.1"), (4, "http://d", None), (5, "u", ""), (9, "u", big), (8, "u", big), (7, "u", "<p>x</p>"), (7, "u", "<p>x</p>"), (None, "u", "solo"), (None, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    got = warc.round_trip(pages).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        ids = [k for k, _, x in rows if (x or "").encode() == body and k is not None]
        last = max(ids, default=None)
        revisit = last is not None and i != last
        want.append((i, len(body), digest(body), "revisit" if revisit else "response", last if revisit else None))
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_addresses_cannot_bear_headers(spark):
    rows = [(1, "http://a\r\n\r\nx", "one"), (2, "http://b\r\nWARC-Record-ID: <urn:page:99>", "two"), (3, " \x00 \n", "three"), (4, "http://é/?a=b c%0D", "four")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["payload_digest"] for r in warc.round_trip(pages).collect()}
    assert got == {i: digest(h.encode()) for i, _, h in rows}
    assert warc.safe_uri(rows[3][1]) == rows[3][1] and "\n" not in warc.safe_uri(rows[1][1])
    with pytest.raises(ValueError):
        warc.round_trip(pages.withColumn("page_id", F.col("url")))


def test_items_of_other_keys(spark, documents):
    leak = " ".join(f"word{i}" for i in range(40))
    docs = documents([(1, "before " + leak + " after"), (2, "nothing of it here"), (3, None)])
    for kind, value in (("string", "i-7"), ("int", 7), ("date", __import__("datetime").date(2024, 1, 2))):
        items = spark.createDataFrame([(value, leak), (None, "some other words stand here alone")], f"item_id {kind}, text string")
        assert [(r["doc_id"], r["item_id"]) for r in D.find(docs.withColumn("score", F.lit("x")), items).collect()] == [(1, value)]
        assert sorted(r["doc_id"] for r in D.clean(docs, items).collect()) == [2, 3]


def test_reader_checks(spark, tmp_path):
    good = warc.record("urn:a", "http://a", b"payload", digest(b"payload"))
    whole = warc.gzip_member(good)
    assert [warc.parse(x)["payload"] for x in warc.members(io.BytesIO(whole * 3), chunk=7)] == [b"payload"] * 3
    cases = {
        "digest": warc.gzip_member(good.replace(b"payload\r\n", b"paylaod\r\n")), "length": warc.gzip_member(good.replace(b"Content-Length: ", b"Content-Length: 9", 1)), "header": warc.gzip_member(b"HTTP/1.1 200"),
        "none": warc.gzip_member(b"WARC/1.1\r\nX: y\r\n\r\n"), "cut": whole[:-9], "raw": b"not gzip at all",
    }
    for name, data in cases.items():
        with pytest.raises(warc.BadRecord):
            [warc.parse(x) for x in warc.members(io.BytesIO(data))]
        (tmp_path / f"{name}.warc.gz").write_bytes(whole + data)
    files = spark.createDataFrame([(str(tmp_path / f"{n}.warc.gz"),) for n in cases], "path string")
    rows = warc.read(spark, files, "file://" + str(tmp_path), on_error="mark").collect()
    assert sum(r["error"] is None for r in rows) == len(cases) and sum(r["error"] is not None for r in rows) == len(cases)
    with pytest.raises(Exception, match="record 1"):
        warc.read(spark, files, "file://" + str(tmp_path)).collect()


def test_files_are_closed_at_their_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 40) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    files = warc.write(pages, "file://" + str(tmp_path), file_bytes=4000)
    assert files.count() >= 4 and files.agg(F.sum("records")).first()[0] == 40
    assert len(fs.LocalFileSystem().get_file_info(fs.FileSelector(str(tmp_path)))) == files.count()
