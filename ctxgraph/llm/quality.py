"""Compression classifier: zstandard dictionaries of good and bad text.

One dictionary is trained on texts labelled good, one on texts labelled bad.  A
text is compressed with each; the difference of the two sizes, divided by the
square root of the text's length (differences of sizes spread like it), is the
only input of a rising logistic curve.  The curve is fitted on labelled rows that
no dictionary saw and turns the difference into a probability of label 1.

Bounds of the fit (parameters of :func:`fit`): the dictionaries learn from at
most ``max_rows`` rows a label, whole texts of at most ``max_bytes`` bytes each
(96 MB at the driver at most); the curve learns from one number of at most
``max_rows`` further rows a label.  Scoring reads whole texts of all rows, in
batches.

Defined results: a null or empty text has its own score, the smoothed share of
label 1 among short labelled texts; null labels are ignored and a document
labelled twice counts by its smallest label; if a label has too few rows the
score is the (smoothed) share of label 1 everywhere.  Extra columns pass
through, columns named score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

THRESHOLD, DICT_BYTES, LEVEL, MAX_ROWS, MAX_BYTES = 0.3, 32_768, 3, 3000, 1 << 14


class Model:
    """Two dictionaries, the curve (centre, slope) and the score of an empty text."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, float] | None, empty: float):
        self.good, self.bad, self.curve, self.empty = good, bad, curve, empty

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            d = zs.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zs.ZstdCompressor(dict_data=d, write_checksum=False))
        return out


def difference(text: bytes, good, bad) -> float:
    """Size under the bad dictionary less that under the good one, normalised."""
    return (len(bad.compress(text)) - len(good.compress(text))) / len(text) ** 0.5


def _score(x: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[1] * (x - curve[0]), -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(centre, slope) of the logistic curve of y over x, by Newton steps; the
    slope is never negative: a larger difference never lowers the score."""
    mean, std = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([np.ones_like(x), (x - mean) / std], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(w[1]) / std, 1e-9)
    return mean - float(w[0]) / slope, slope


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled rows; the caller has left out held-out rows."""
    spark = docs.sparkSession
    order = F.md5(F.concat(F.lit("fit:"), F.col(key).cast("string")))
    labels = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("__y"))
    ids = []  # at most 4 * max_rows ids, in hash order
    for y in (0, 1):
        rows = labels.where(F.col("__y") == y).orderBy(order, key).limit(2 * max_rows).select(key).collect()
        ids += [(r[0], y, int(i >= len(rows) // 2)) for i, r in enumerate(rows)]
    picked = spark.createDataFrame(ids, T.StructType([docs.schema[key], T.StructField("__y", T.IntegerType()), T.StructField("__fold", T.IntegerType())]))
    body = F.coalesce(F.col(text), F.lit(""))
    joined = docs.select(key, body.alias("__t")).join(F.broadcast(picked), key)
    share = (sum(y for _, y, _ in ids) + 1) / (len(ids) + 2)
    sample = joined.where((F.col("__fold") == 0) & (F.octet_length("__t") <= max_bytes)).select("__y", "__t").collect()
    texts = [sorted(r[1].encode() for r in sample if r[0] == y and r[1]) for y in (0, 1)]
    try:
        bad, good = (zs.train_dictionary(DICT_BYTES, t).as_bytes() for t in texts)
    except zs.ZstdError:
        return Model(b"", b"", None, share)
    model = Model(good, bad, None, share)

    def numbers(batches):
        tools = model.compressors()
        for batch in batches:
            rows = [(difference(t.encode(), *tools), float(len(t.encode())), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(3)], names=list("dny"))

    rest = joined.where("__fold = 1").select("__t", F.col("__y").cast("double"))
    got = np.array([list(r) for r in rest.mapInArrow(numbers, "d double, n double, y double").collect()])
    if not len(got) or len(set(got[:, 2])) < 2:
        return model
    got = got[np.lexsort(got.T)]  # the same fit in whatever order rows arrive
    centre, slope = calibrate(got[:, 0], got[:, 2])
    # Rows of either label are sampled to the same bound; move the centre back to their true share.
    n1 = labels.agg(F.avg("__y")).first()[0] or 0.5
    s1 = got[:, 2].mean()
    if 0 < n1 < 1:
        centre -= float(np.log(n1 / (1 - n1)) - np.log(s1 / (1 - s1))) / slope
    model.curve = (centre, slope)
    short = got[got[:, 1] < 40]
    model.empty = float((short[:, 2].sum() + 1) / (len(short) + 4))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold)."""
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        tools = model.compressors() if model.curve else None
        for batch in batches:
            body = [t.encode() if t else b"" for t in batch.column(at).to_pylist()]
            s = np.full(len(body), model.empty)
            full = [i for i, t in enumerate(body) if t and tools]
            if full:
                s[full] = _score(np.array([difference(body[i], *tools) for i in full]), model.curve)
            s = np.round(s, 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(c):
    """True where crc32 of the id's text leaves no remainder by 5."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0
