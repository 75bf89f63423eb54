"""Packing of tokenised documents into fixed windows by length combinations.

A document's tokens are cut into full windows and a rest, and the rest into a
head of whole cells (a cell is a 32nd of the window) and a tail shorter than a
cell, so that heads have 31 lengths at most, whatever the corpus.  All shallow
combinations of up to eight such lengths that fill a window exactly are listed;
non-negative least squares over them finds how often to repeat each to use up
the histogram of heads (an active set, so as few combinations as lengths are in
use), and the counts are rounded.  What the rounding leaves is packed greedily
by deeper combinations; the few heads then left, and the tails, are laid end to
end, longest first, and cut where a window ends.

Ranks within a length come from range partitioning, so a length that a third
of all documents share spreads over many tasks.  Only the histogram and the
combination table, both bounded by the window, reach the driver.

Defined results: a null text is empty and has the end token alone; repeated
rows and null ids are packed like others; the last sequence may be short, all
others are full; an empty table gives an empty table; other columns of the
input are not kept, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, forest, global_rank, tune

WINDOW, END, CELLS, DEPTH, CACHE = 2048, 1, 32, 8, 200_000
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class Encoder:
    """Ids (little-endian unsigned 32 bits) of whole texts, as the ``tokenizers``
    library gives them with the vocabulary at ``path``.

    A text is cut before its single spaces; such pieces never share a token,
    and most have been met before, so their ids come from a bounded cache.
    Texts with a space before other white space are not cut.
    """

    def __init__(self, ranks: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _spaced(self, text: str) -> bytes:
        import re

        if text.endswith(" ") or re.search(r" [\s\x1c-\x1f\x85]", text):
            return self._plain(text)
        first, *rest = text.split(" ")
        out, cache, plain = [self._plain(first)], self.cache, self._plain
        for piece in rest:
            ids = cache.get(piece)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = plain(" " + piece)
                if len(piece) < 64:
                    cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        special = np.array([SPECIAL_ID], "<u4").tobytes()
        return special.join(self._spaced(part) if part else b"" for part in text.split(SPECIAL))


def partitions(total: int, depth: int, most: int):
    """All ways to write ``total`` as ``depth`` falling numbers or fewer, none
    above ``most``; those with the largest numbers first."""
    if total == 0:
        yield ()
    elif depth:
        for first in range(min(total, most), 0, -1):
            if first * depth < total:
                break
            for rest in partitions(total - first, depth - 1, first):
                yield (first, *rest)


def combinations(window: int = WINDOW, cells: int = CELLS, depth: int = DEPTH) -> np.ndarray:
    """Rows of lengths, zeros last, that fill the window: all ways with ``depth``
    lengths of whole cells or fewer, and all pairs of other lengths."""
    step = window // cells
    rows = [(window - a, a) for a in range(1, window // 2 + 1) if a % step]
    rows += [tuple(step * c for c in p) for p in partitions(cells, depth, cells - 1)]
    return np.array([(*r, *[0] * (depth - len(r))) for r in rows], np.int64)


def _active_set(a: np.ndarray, h: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that minimises |a x - h|: Lawson and Hanson's active set."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tiny = 1e-9 * max(1.0, float(np.abs(a.T @ h).max()))
    for _ in range(rounds):
        gain = np.where(passive, -np.inf, a.T @ (h - a @ x))
        best = int(gain.argmax())
        if gain[best] <= tiny:
            break
        passive[best] = True
        while True:
            own = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, own], h, rcond=None)[0]
            if z.min() > 0:
                break
            low = z <= 0
            t = (x[own][low] / np.maximum(x[own][low] - z[low], 1e-300)).min()
            moved = x[own] + t * (z - x[own])
            passive[own[low & (moved <= 1e-12)]] = False
            if passive.sum() == len(own):  # rounding left all a little above nought
                passive[own[low]] = False
            x[:] = 0
            x[own] = np.maximum(moved, 0.0)
            x[~passive] = 0
            if not passive.any():
                break
        x[:] = 0
        own = np.flatnonzero(passive)
        x[own] = np.linalg.lstsq(a[:, own], h, rcond=None)[0] if len(own) else 0
    return np.maximum(x, 0.0)


def nnls(combos: np.ndarray, histogram: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' use of each length
    nearest the histogram in least squares.  Combinations without a length in
    common do not touch each other and are solved apart."""
    first = combos[:, :1].repeat(combos.shape[1] - 1, 1)
    both = combos[:, 1:] > 0
    node, root = forest(first[both], combos[:, 1:][both])
    of = np.arange(len(histogram))
    of[node] = root
    group = of[combos[:, 0]]
    x = np.zeros(len(combos))
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        lengths = np.flatnonzero((of == g) & (np.bincount(combos[own].ravel(), minlength=len(histogram)) > 0))
        a = (combos[own][:, :, None] == lengths).sum(1).T.astype(np.float64)
        x[own] = _active_set(a, histogram[lengths].astype(np.float64), rounds)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past rank, first sequence, offset) slots: the pieces
    of a length with ranks in [first, past) go, one each, to sequences first
    sequence + (rank - first) at that offset."""
    left = histogram.astype(np.int64).copy()
    combos = combinations(window)
    combos = combos[(np.where(combos > 0, left[combos], 1) > 0).all(1)]
    slots, taken, base = [], np.zeros(len(left), np.int64), 0

    def fill(parts: list[int], most: int | None = None) -> None:
        nonlocal base
        n = min(int(left[v]) // parts.count(v) for v in set(parts))
        n = n if most is None else min(n, most)
        if n <= 0:
            return
        offset = 0
        for v in parts:
            slots.append((v, int(taken[v]), int(taken[v]) + n, base, offset))
            taken[v] += n
            left[v] -= n
            offset += v
        base += n

    if len(combos):
        counts = np.rint(nnls(combos, left)).astype(np.int64)
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] <= 0:
                break
            fill([int(v) for v in combos[i] if v], int(counts[i]))
    step = window // CELLS
    for p in partitions(CELLS, CELLS, CELLS - 1):  # what rounding left, longest first, by combinations of any depth
        if all(left[step * c] for c in p):
            fill([step * c for c in p])
    return slots


def tokenise(docs: DataFrame, ranks: str, pattern: str, key: str, text: str, window: int, end: int, ids: bool) -> DataFrame:
    """A row per piece: full windows, the rest's head of whole cells and its tail,
    with CRC; the ids of heads and tails (of all pieces with ``ids``); the task,
    and the full window's number in it."""
    step = window // CELLS
    i_key, i_text = docs.columns.index(key), docs.columns.index(text)
    kind = docs.schema[key].dataType
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "__task", "__nth")
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in numbers), T.StructField("ids", T.BinaryType())])
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, task, nth = Encoder(ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            where, rows = [], []
            for i, t in enumerate(batch.column(i_text)):
                body = encode(t.as_py()) + last
                n = len(body) // 4
                full = n - n % window
                for s, e in [*((s, s + window) for s in range(0, full, window)), (full, n - n % step), (n - n % step, n)]:
                    if s == e:
                        continue
                    piece = body[4 * s : 4 * e]
                    whole = e - s == window
                    where.append(i)
                    rows.append((s, len(piece) // 4, zlib.crc32(piece), n, task, nth, piece if ids or not whole else None))
                    nth += whole
            column = batch.column(i_key).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([column, *(pa.array([r[j] for r in rows], pa.int64()) for j in range(6)), pa.array([r[6] for r in rows], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _running(counts: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """``counts`` (a row a task or a length) with the sum of the rows before."""
    before = f"sum({amount}) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return counts.withColumn(out, F.coalesce(F.expr(before), F.lit(0)))


def pack(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """Pieces of ``docs``: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``ids`` their token ids (little-endian
    unsigned 32 bits).  Other columns of ``docs`` are not kept."""
    spark = docs.sparkSession
    tune(spark)
    if window % CELLS:
        raise ValueError(f"window must be a multiple of {CELLS}")
    scratch = Scratch(spark, "packing")
    pieces = tokenise(docs.select(key, text), ranks, pattern, key, text, window, end, ids)
    pieces = scratch.keep(pieces.withColumn("__uid", F.monotonically_increasing_id()), "zstd")
    out = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]

    # Full windows are sequences of their own, numbered by one count a task.
    full = pieces.where(F.col("length") == window)
    tasks = _running(full.groupBy(F.col("__task").alias("__t")).agg(F.count(F.lit(1)).alias("__n")), "__t", "__n", "__before")
    full = full.join(F.broadcast(tasks), F.col("__task") == F.col("__t"))
    full = full.withColumns({"sequence_id": F.col("__before") + F.col("__nth"), "offset": F.lit(0).cast("long")}).select(*out)

    # Heads: ranked within their length, then given the slot of that rank.
    step = window // CELLS
    rests = pieces.where(F.col("length") < window)
    heads = rests.where(F.col("length") % step == 0)
    histogram, n_full = np.zeros(window + 1, np.int64), 0
    for length, n in pieces.where(F.col("length") % step == 0).groupBy("length").count().collect():  # a row a length, 32 at most
        if length == window:
            n_full = n
        else:
            histogram[length] = n
    slots = plan(histogram, window)
    n_slots = max((s + hi - lo for _, lo, hi, s, _ in slots), default=0)
    table = spark.createDataFrame(slots, "__l long, __lo long, __hi long, __seq long, __off long")
    ranked = global_rank(heads.select("__uid", "length"), ["__uid"], scratch, group="length", out="__r")
    # A rank lies in one slot; the table has a few rows a combination, whatever the corpus.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("__l")) & (F.col("__r") >= F.col("__lo")) & (F.col("__r") < F.col("__hi")), "left")
    placed = scratch.keep(placed.select("__uid", F.col("length").alias("__len"), (F.col("__seq") + F.col("__r") - F.col("__lo") + n_full).alias("sequence_id"), F.col("__off").alias("offset")))
    whole = heads.join(placed.where("sequence_id is not null"), "__uid").select(*out)

    # Loose heads and all tails: one after the other, longest first, cut where a window ends.
    loose = placed.where("sequence_id is null").select("__uid", "__len").unionByName(rests.where(F.col("length") % step != 0).select("__uid", F.col("length").alias("__len")))
    loose = global_rank(loose.withColumn("__neg", -F.col("__len")), ["__neg", "__uid"], scratch, out="__r")
    # All pieces of a length lie side by side: places follow from one row a length.
    per = loose.groupBy(F.col("__len").alias("__l")).agg(F.min("__r").alias("__r0"), F.count(F.lit(1)).alias("__n"))
    per = _running(per, "__l DESC", "__l * __n", "__p0")
    loose = loose.join(F.broadcast(per), F.col("__len") == F.col("__l"))
    loose = loose.select("__uid", "__len", (F.col("__p0") + (F.col("__r") - F.col("__r0")) * F.col("__len")).alias("__p"))
    # Few heads are loose: a table of their own, so that its size decides how the long ids of heads meet it.
    few = scratch.keep(loose.where(F.col("__len") % step == 0).drop("__len"))
    tails = rests.where(F.col("length") % step != 0).join(loose.where(F.col("__len") % step != 0).drop("__len").hint("shuffle_hash"), "__uid")
    loose = heads.join(few, "__uid").unionByName(tails).select(key, "start", "length", "doc_tokens", "ids", "__p")
    first = n_full + n_slots
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = T.StructType([pieces.schema[key], *(T.StructField(c, T.LongType()) for c in names[1:-1]), T.StructField("ids", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            where, rows = [], []
            columns = [batch.column(c).to_pylist() for c in ("start", "length", "doc_tokens", "ids", "__p")]
            for i, (start, length, n, body, p) in enumerate(zip(*columns)):
                s = 0
                while s < length:
                    take = min(length - s, window - (p + s) % window)
                    piece = body[4 * s : 4 * (s + take)]
                    where.append(i)
                    rows.append((start + s, take, zlib.crc32(piece), n, first + (p + s) // window, (p + s) % window, piece if ids else None))
                    s += take
            column = batch.column(key).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([column, *(pa.array([r[j] for r in rows], pa.int64()) for j in range(6)), pa.array([r[6] for r in rows], pa.binary())], names=names)

    return full.unionByName(whole).unionByName(loose.mapInArrow(cut, schema).select(*out))
