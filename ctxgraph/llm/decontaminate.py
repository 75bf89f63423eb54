"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are cut into segments of at most ``half`` words; these are the
documents of an inverted index.  Every training text is cut into passages of
``2 * half`` words, one every ``half`` words, so each segment-long run lies in a
passage whole; each passage is a query of its distinct words.  Impacts are
divided by the segment's score against itself, so one threshold (the share of a
segment's weight that a passage must hold) serves all segments.

Retrieval is exact at the threshold.  A segment's commonest words, as many as
stay below half the threshold together (REST), cannot carry it alone; their
postings are left to scoring.  For all passages of a batch at once, block maxima of the other
postings and the bound of what was left out say which (passage, block) can reach
the threshold; block-max WAND then runs over the postings of those blocks.  A
retrieved item stands if the passage's word triples cover enough of its
question and of its answer (the last quarter of its words).

The index is built from one shard of items at a time (``shard_words`` words a
shard, counts over all items), so what is broadcast is bounded whatever the size
of the benchmark; texts are scanned once a shard and never shuffled.

Defined results: null or empty texts and items have no words and match nothing;
equal item rows count once; repeated documents are searched one by one and null
ids stay null; an item of fewer than four words is its own answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import tune

HALF, THETA, OVERLAP, GRAM, BLOCK, SHARD_WORDS = 64, 0.5, 0.5, 3, 4, 2_000_000
K1, B, REST = 1.2, 0.75, 0.5
_WORD = re.compile(r"[^\W_]+")
_EPS = 1e-9


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def segments(n: int, half: int) -> list[tuple[int, int]]:
    """Bounds of the even segments of ``n`` words."""
    k = -(-n // half)
    cuts = [-(-i * n // k) for i in range(k + 1)] if k else [0]
    return list(zip(cuts[:-1], cuts[1:]))


class Index:
    """Segments of a shard's items, postings with block maxima."""

    def __init__(self, items: list[tuple], df: dict[str, int], total: int, average: float, half: int = HALF, theta: float = THETA, overlap: float = OVERLAP, block: int = BLOCK):
        self.half, self.theta, self.overlap, self.block = half, theta, overlap, block
        self.items = [(key, words_of(text)) for key, text in items]
        self.grams = [self._grams(ws) for _, ws in self.items]
        self.vocab: dict[str, int] = {}
        rows, self.seg_item = [], []
        spare: list[float] = []
        for number, (_, ws) in enumerate(self.items):
            for lo, hi in segments(len(ws), half):
                tf, seg = Counter(ws[lo:hi]), len(self.seg_item)
                self.seg_item.append(number)
                norm = K1 * (1 - B + B * (hi - lo) / average)
                impact = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
                whole, below = sum(impact.values()), 0.0
                rest = True
                for t in sorted(impact, key=lambda t: (-df[t], t)):
                    share = impact[t] / whole
                    rest = rest and below + share < theta * REST
                    below += share * rest
                    rows.append((self.vocab.setdefault(t, len(self.vocab)), seg, share, not rest))
                spare.append(below)
        self.n_blocks = -(-len(self.seg_item) // block)
        self.spare = np.zeros(max(1, self.n_blocks))
        np.maximum.at(self.spare, np.arange(len(spare)) // block, spare)
        rows.sort()
        # Postings by term, then segment; block maxima beside them.
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.vocab]
        self.maxima: list[dict[int, float]] = [{} for _ in self.vocab]
        bound: dict[tuple[int, int], float] = {}
        for t, seg, share, essential in rows:
            self.postings[t][0].append(seg)
            self.postings[t][1].append(share)
            b = seg // block
            self.maxima[t][b] = max(self.maxima[t].get(b, 0.0), share)
            if essential:
                bound[t, b] = max(bound.get((t, b), 0.0), share)
        self.e_count = np.zeros(len(self.vocab) + 1, np.int64)  # the last is for words not in any item
        for t, _ in bound:
            self.e_count[t] += 1
        self.e_first = np.cumsum(self.e_count) - self.e_count
        by_term = sorted(bound)
        self.e_block = np.array([b for _, b in by_term], np.int64)
        self.e_max = np.array([bound[k] for k in by_term])

    @staticmethod
    def _grams(ws: list[str]) -> dict[tuple, list[int]]:
        n, out = min(GRAM, len(ws)), {}
        for i in range(len(ws) - n + 1 if n else 0):
            out.setdefault(tuple(ws[i : i + n]), []).append(i)
        return out

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Segments of the block that score the threshold or more, by WAND with
        the block's maxima as bounds."""
        lo, hi, need = block * self.block, (block + 1) * self.block, self.theta - _EPS
        lists = []
        for t in terms:
            if block in self.maxima[t]:
                segs, shares = self.postings[t]
                lists.append([bisect_left(segs, lo), segs, shares, self.maxima[t][block], bisect_left(segs, hi)])
        out = []
        while True:
            lists = [x for x in lists if x[0] < x[4]]
            lists.sort(key=lambda x: x[1][x[0]])
            bound = 0.0
            pivot = None
            for x in lists:
                bound += x[3]
                if bound >= need:
                    pivot = x[1][x[0]]
                    break
            if pivot is None:
                return out
            if lists[0][1][lists[0][0]] == pivot:
                score = 0.0
                for x in lists:
                    if x[1][x[0]] != pivot:
                        break
                    score += x[2][x[0]]
                    x[0] += 1
                if score >= need:
                    out.append((pivot, score))
            else:
                for x in lists:
                    if x[1][x[0]] >= pivot:
                        break
                    x[0] = bisect_left(x[1], pivot, x[0])

    def _bounded(self, ids: np.ndarray, starts: np.ndarray, chunks: np.ndarray, chunk_doc: np.ndarray) -> np.ndarray:
        """Keys (passage * n_blocks + block) whose bound reaches the threshold."""
        reps = self.e_count[ids]
        some = np.flatnonzero(reps)
        reps = reps[some]
        total = int(reps.sum())
        if not total:
            return np.empty(0, np.int64)
        at = np.repeat(self.e_first[ids[some]] - (np.cumsum(reps) - reps), reps) + np.arange(total)
        chunk = np.repeat(chunks[some], reps)
        key = chunk * self.n_blocks + self.e_block[at]
        value = self.e_max[at]
        # A chunk is the head of one passage and the tail of the one before.
        tail = (chunk > 0) & (chunk_doc[chunk] == chunk_doc[chunk - 1])
        key, value = np.concatenate([key, key[tail] - self.n_blocks]), np.concatenate([value, value[tail]])
        by = np.argsort(key, kind="stable")
        key, value = key[by], value[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums, key = np.add.reduceat(value, first), key[first]
        return key[sums + self.spare[key % self.n_blocks] >= self.theta - _EPS]

    def search(self, texts: list) -> list[list[tuple]]:
        """Of each text its hits (item number, score, question, answer)."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.n_blocks:
            return out
        get, none = self.vocab.get, len(self.vocab)
        docs = [words_of(t) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        ids = np.fromiter((get(w, none) for d in docs for w in d), np.int64, int(size.sum()))
        starts = np.cumsum(size) - size
        n_chunks = np.maximum(1, -(-size // self.half))
        base = np.cumsum(n_chunks) - n_chunks
        chunk_doc = np.repeat(np.arange(len(docs)), n_chunks)
        doc_of = np.repeat(np.arange(len(docs)), size)
        chunks = base[doc_of] + (np.arange(len(ids)) - starts[doc_of]) // self.half
        found: dict[tuple[int, int], list] = {}
        for key in self._bounded(ids, starts, chunks, chunk_doc).tolist():
            chunk, block = divmod(key, self.n_blocks)
            doc = int(chunk_doc[chunk])
            lo = (chunk - int(base[doc])) * self.half
            mine = ids[starts[doc] + lo : starts[doc] + min(lo + 2 * self.half, int(size[doc]))]
            terms = np.unique(mine[mine < none]).tolist()
            for seg, score in self.wand(terms, block):
                hit = found.setdefault((doc, self.seg_item[seg]), [0.0, set()])
                hit[0] = max(hit[0], score)
                hit[1].add(lo)
        for (doc, item), (score, places) in sorted(found.items()):
            question, answer = self.verify(item, docs[doc], places)
            if question >= self.overlap and answer >= self.overlap:
                out[doc].append((item, score, question, answer))
        return out

    def verify(self, item: int, words: list[str], places) -> tuple[float, float]:
        """Shares of the item's question and answer that word triples of the
        passages at ``places`` cover."""
        ws, grams = self.items[item][1], self.grams[item]
        n, covered = min(GRAM, len(ws)), set()
        for lo in places:
            hi = min(lo + 2 * self.half, len(words))
            for i in range(lo, hi - n + 1):
                for j in grams.get(tuple(words[i : i + n]), ()):
                    covered.update(range(j, j + n))
        cut = len(ws) - (len(ws) // 4 if len(ws) >= 4 else len(ws))
        answer = sum(1 for j in covered if j >= cut) / (len(ws) - cut)
        return (sum(1 for j in covered if j < cut) / cut if cut else answer), answer


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", half: int = HALF, theta: float = THETA, overlap: float = OVERLAP, shard_words: int = SHARD_WORDS):
    """The index of each shard of ``items``, one after the other."""
    spark = items.sparkSession
    items = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").distinct()

    def split(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ws = words_of(t)
                rows += [(t, hi - lo, sorted(set(ws[lo:hi]))) for lo, hi in segments(len(ws), half)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["t", "n", "terms"])

    cut = items.mapInArrow(split, "t string, n long, terms array<string>")
    total, length = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return
    shards = max(1, -(-length // shard_words))
    shard = F.pmod(F.xxhash64("t"), F.lit(shards))
    df = cut.select(F.explode("terms").alias("w")).groupBy("w").count()
    for s in range(shards):
        own = items.where(shard == s)
        words = cut.where(shard == s).select(F.explode("terms").alias("w")).distinct()
        counts = {r[0]: r[1] for r in df.join(words, "w", "left_semi").collect()}  # the shard's words at most
        rows = sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))
        yield Index(rows, counts, total, length / total, half, theta, overlap)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", **how) -> DataFrame:
    """Contaminated pairs: key, item key, score (share of the item segment's
    BM25 weight in the best passage), question and answer overlap."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], T.StructField(item_key, items.schema[item_key].dataType), *(T.StructField(n, T.DoubleType()) for n in ("score", "question", "answer"))])
    item_type = to_arrow_type(items.schema[item_key].dataType)
    out = spark.createDataFrame([], schema)
    for index in indexes(items, item_key, **how):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                where, rows = [], []
                for i, hits in enumerate(index.search(batch.column(1).to_pylist())):
                    where += [i] * len(hits)
                    rows += [(index.items[n][0], *(round(x, 4) for x in rest)) for n, *rest in hits]
                column = batch.column(0).take(pa.array(where, pa.int64()))
                yield pa.RecordBatch.from_arrays([column, pa.array([r[0] for r in rows], item_type), *(pa.array([r[j] for r in rows], pa.float64()) for j in (1, 2, 3))], names=schema.names)

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", **how) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    spark = docs.sparkSession
    tune(spark)
    at = docs.columns.index(text)
    for index in indexes(items, item_key, **how):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                hits = shared.value.search(batch.column(at).to_pylist())
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def oracle(half: int = HALF, theta: float = THETA, overlap: float = OVERLAP) -> str:
    """The pairs of ``find`` over documents and benchmark in DuckDB SQL."""
    split = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
WITH it AS (SELECT item_id, text, {split} AS ws, row_number() OVER (ORDER BY item_id NULLS LAST, text) AS no FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
iw AS (SELECT no, item_id, len(ws) AS n, CAST(ceil(len(ws) / {half}.0) AS BIGINT) AS k, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM it),
sw AS (SELECT no, item_id, n, w, p, (p * k) // n AS seg FROM iw),
sl AS (SELECT no, seg, count(*) AS len FROM sw GROUP BY ALL),
tot AS (SELECT count(*) AS big_n, sum(len) / count(*) AS avg_len FROM sl),
tf AS (SELECT no, seg, w, count(*) AS tf FROM sw GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
imp AS (SELECT no, seg, w, ln(1 + (big_n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / avg_len)) AS i FROM tf JOIN df USING (w) JOIN sl USING (no, seg), tot),
share AS (SELECT no, seg, w, i / sum(i) OVER (PARTITION BY no, seg) AS s FROM imp),
d AS (SELECT row_number() OVER () AS rid, doc_id, {split} AS ws FROM documents),
dw AS (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
q AS (SELECT DISTINCT rid, w, unnest(CASE WHEN p >= {half} THEN [p // {half}, p // {half} - 1] ELSE [0] END) AS c FROM dw WHERE w IN (SELECT w FROM df)),
got AS (SELECT q.rid, share.no, q.c, max(sum(s)) OVER (PARTITION BY q.rid, share.no) AS best FROM q JOIN share USING (w) GROUP BY q.rid, share.no, share.seg, q.c HAVING sum(s) >= {theta} - {_EPS}),
hit AS (SELECT DISTINCT rid, no, c, best FROM got),
ig AS (SELECT no, n, p, unnest(range(p, p + least({GRAM}, n))) AS ap, least({GRAM}, n) AS g, w AS w0,
  lead(w, 1) OVER (PARTITION BY no ORDER BY p) AS w1, lead(w, 2) OVER (PARTITION BY no ORDER BY p) AS w2 FROM iw QUALIFY p + least({GRAM}, n) <= n),
hd AS (SELECT rid, p, w AS w0, lead(w, 1) OVER (PARTITION BY rid ORDER BY p) AS w1, lead(w, 2) OVER (PARTITION BY rid ORDER BY p) AS w2 FROM dw WHERE rid IN (SELECT rid FROM hit)),
cov AS (SELECT DISTINCT h.rid, h.no, h.best, ig.n, ig.ap FROM hit h JOIN ig USING (no) JOIN hd ON hd.rid = h.rid AND hd.p >= h.c * {half} AND hd.p + ig.g <= (h.c + 2) * {half}
  AND hd.w0 = ig.w0 AND (ig.g < 2 OR hd.w1 = ig.w1) AND (ig.g < 3 OR hd.w2 = ig.w2)),
parts AS (SELECT rid, no, best, n, CASE WHEN n >= 4 THEN n - n // 4 ELSE 0 END AS cut, ap FROM cov),
ov AS (SELECT rid, no, best, count(*) FILTER (ap >= cut) / (n - cut) AS a, CASE WHEN cut > 0 THEN count(*) FILTER (ap < cut) / cut END AS qs FROM parts GROUP BY rid, no, best, n, cut)
SELECT d.doc_id, it.item_id, round(best, 4) AS score, round(coalesce(qs, a), 4) AS question, round(a, 4) AS answer
FROM ov JOIN d USING (rid) JOIN it USING (no) WHERE a >= {overlap} AND coalesce(qs, a) >= {overlap}
"""
