"""Edited and cropped image copies by local descriptors.

Every image gets corners on a pyramid of scales (Harris response, local maxima),
an orientation per corner (intensity centroid) and 128 binary intensity tests
turned by it.  Images of equal bytes are one node from then on, so a crowd of
exact copies costs one description in the joins.

Candidates come from Hamming tables: each table reads its own 38 of the 128
bits, and descriptors that agree on them meet in a task.  In a bucket of at most
``CROWD`` descriptors all alike pairs count as votes for their images; in a larger
one each descriptor is compared with every head (a descriptor that is like no head
before it), so the votes of a bucket grow with its size and not with its square.
Image pairs with three votes or more are verified with all their descriptors:
mutual nearest neighbours must agree on one similarity transform (scale, turn,
shift).  Classes are the components of the verified pairs.

Two images that meet in crowded buckets only, head of neither, have no votes there.
So once the first classes are known, all pairs of all buckets are counted between
images of different classes, and what has three votes is verified too: the classes
are those of all pairs with three votes, as if no bucket were crowded.

Bounds: keypoints are as many as an image has corners, its area sets the limit;
what is sent per descriptor is 25 bytes a table, then 32 bytes a group of images.

Formats: binary PGM and PPM (P5, P6) of 8 bits; any other, JPEG and PNG too, is
undecodable.  An image under 23 pixels a side has no keypoints.

Defined results: a null or undecodable image has no keypoints; null images are
classes of their own, undecodable ones are alike only byte by byte; repeated
rows share a class; a null key takes part without giving a class its name;
extra columns are not kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, forest, sweep, tune

BITS, RADIUS, LEVELS, RATIO = 128, 6, 5, 1.25
TABLES, WIDTH, NEAR, FAR, VOTES, INLIERS = 9, 38, 16, 28, 3, 7
CROWD, PIXELS, SALTS = 16, 1 << 18, 64
GROUP = 240_000  # descriptors of a group of images that meets others
EDGE, TURNS, RESPONSE = 10, 64, 0.02  # quarter turns are whole steps
KEYPOINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("s", "<f4"), ("a", "<f4"), ("d", "<u8", 2)])


# Images


def pgm(pixels: np.ndarray) -> bytes:
    """A binary grey map of a 2-d array of bytes."""
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a binary PGM or PPM file, else None."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not m:
        return None
    depth, w, h = (3 if m[1] == b"6" else 1), int(m[2]), int(m[3])
    body = data[m.end() : m.end() + w * h * depth]
    if len(body) != w * h * depth or int(m[4]) > 255 or not body:
        return None
    a = np.frombuffer(body, np.uint8).reshape(h, w, depth)
    return a[:, :, 0] if depth == 1 else (a @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


@lru_cache(4)
def _fields(n: int, side: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    f = np.fft.fftfreq(side)
    low = np.exp(-((f[:, None] ** 2 + f[None] ** 2) * 2 * (np.pi * 1.6) ** 2))
    return np.fft.ifft2(np.fft.fft2(rng.standard_normal((n, side, side))) * low).real.reshape(n, -1)


def picture(vector, side: int = 64) -> np.ndarray:
    """A picture of a vector: like vectors have like pictures."""
    v = np.nan_to_num(np.array(vector, np.float64))
    field = (v @ _fields(len(v), side)).reshape(side, side) if len(v) and v.any() else np.zeros((side, side))
    spread = field.std()
    return np.clip(128 + 48 * (field - field.mean()) / (spread or 1.0), 0, 255).astype(np.uint8)


# Description


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1)-squares, edges repeated; last two axes."""
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r + 1, r)] * 2, mode="edge")
    c = p.cumsum(-1).cumsum(-2)
    k = 2 * r + 1
    return c[..., k:, k:] - c[..., :-k, k:] - c[..., k:, :-k] + c[..., :-k, :-k]


def _resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, on a smoothed image."""
    y, x = np.linspace(0, a.shape[-2] - 1, h), np.linspace(0, a.shape[-1] - 1, w)
    y0, x0 = np.minimum(y.astype(int), a.shape[-2] - 2), np.minimum(x.astype(int), a.shape[-1] - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = a[..., y0, :][..., x0] * (1 - fx) + a[..., y0, :][..., x0 + 1] * fx
    low = a[..., y0 + 1, :][..., x0] * (1 - fx) + a[..., y0 + 1, :][..., x0 + 1] * fx
    return top * (1 - fy) + low * fy


def corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of corners of a stack of smoothed images."""
    gy, gx = np.gradient(a, axis=(-2, -1))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    peak = r > np.maximum(1e-3, RESPONSE * r.max((-2, -1), keepdims=True))
    p = np.pad(r, [(0, 0), (2, 2), (2, 2)], constant_values=-np.inf)
    h, w = a.shape[-2:]
    for dy in range(5):
        for dx in range(5):
            if (dy, dx) != (2, 2):
                other = p[:, dy : dy + h, dx : dx + w]
                peak &= (r > other) if (dy, dx) < (2, 2) else (r >= other)
    peak[:, :EDGE] = peak[:, h - EDGE :] = peak[:, :, :EDGE] = peak[:, :, w - EDGE :] = False
    return np.nonzero(peak)


@lru_cache(1)
def _pattern():
    rng = np.random.default_rng(11)
    tests = np.clip(rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS, RADIUS)
    turn = np.arange(TURNS) * 2 * np.pi / TURNS
    rot = np.stack([np.stack([np.cos(turn), -np.sin(turn)], -1), np.stack([np.sin(turn), np.cos(turn)], -1)], -2)
    turned = np.rint(np.einsum("tij,bpj->tbpi", rot, tests)).astype(np.int64)  # turn, test, point, (x, y)
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = x * x + y * y <= RADIUS * RADIUS
    return turned, y[disc], x[disc]


def describe(stack: np.ndarray) -> list[np.ndarray]:
    """The keypoints of each image of a stack (n, h, w) of one size."""
    turned, dy, dx = _pattern()
    level, found = stack.astype(np.float64), []
    height, width = stack.shape[1:]
    for k in range(LEVELS):
        h, w = int(round(height / RATIO**k)), int(round(width / RATIO**k))
        if min(h, w) < 2 * EDGE + 3:
            break
        if k:
            level = _resize(_box(level, 1) / 9, h, w)
        smooth = _box(level, 1) / 9
        i, y, x = corners(smooth)
        if len(i):
            disc = smooth[i[:, None], y[:, None] + dy, x[:, None] + dx]
            disc = disc - disc.mean(1, keepdims=True)
            angle = np.arctan2(disc @ dy, disc @ dx)
            t = np.rint(angle * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
            at = turned[t]
            value = smooth[i[:, None, None], y[:, None, None] + at[..., 1], x[:, None, None] + at[..., 0]]
            out = np.zeros(len(i), KEYPOINT)
            out["x"], out["y"] = x * (width - 1) / (w - 1), y * (height - 1) / (h - 1)
            out["s"], out["a"] = RATIO**k, angle
            out["d"] = np.packbits(value[..., 0] < value[..., 1], axis=1).view("<u8")
            found.append((i, out))
    if not found:
        return [np.zeros(0, KEYPOINT)] * len(stack)
    image, every = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    by = np.argsort(image, kind="stable")
    return np.split(every[by], np.searchsorted(image[by], np.arange(1, len(stack))))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """Matches of two images that agree on the best similarity transform."""
    if not len(a) or not len(b):
        return 0
    d = _distance(a["d"][:, None], b["d"][None])
    j = d.argmin(1)
    i = np.arange(len(a))
    ok = (d[i, j] <= FAR) & (d.argmin(0)[j] == i)
    i, j = i[ok], j[ok]
    if len(i) < INLIERS:
        return 0
    scale = b["s"][j] / a["s"][i]
    turn = b["a"][j] - a["a"][i]
    pa_, pb = a["x"][i] + 1j * a["y"][i], b["x"][j] + 1j * b["y"][j]
    # Each pair of matches far enough apart fixes scale and turn better than one corner's orientation.
    step = scale * np.exp(1j * turn)
    apart = pa_ - pa_[:, None]
    far, k = np.abs(apart).argmax(1), np.arange(len(i))
    some = apart[k, far] != 0
    m = np.concatenate([step, (pb[far] - pb)[some] / apart[k, far][some]])
    k = np.concatenate([k, k[some]])
    size = np.abs(m)
    m, k, size = (x[(0.3 < size) & (size < 3.4)] for x in (m, k, size))
    if not len(m):
        return 0
    return int((np.abs(pb[k, None] + m[:, None] * apart[k] - pb) < 2.5 * np.maximum(1.0, size)[:, None]).sum(1).max())


# Joins


@lru_cache(1)
def _tables() -> list[np.ndarray]:
    rng = np.random.default_rng(13)
    return [np.sort(rng.permutation(BITS)[:WIDTH]) for _ in range(TABLES)]


def keys(d: np.ndarray, table: int | None = None) -> np.ndarray:
    """(tables, descriptors) of table keys, the table's number included; of one
    table if it is given."""
    own = [n for n in range(TABLES) if table in (None, n)]
    power, out = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64), np.empty((len(own), len(d)), np.uint64)
    for at in range(0, len(d), 8192):  # a bit takes eight bytes here: a slice at a time
        part = np.ascontiguousarray(d[at : at + 8192])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).astype(np.uint64)
        for row, n in enumerate(own):
            out[row, at : at + len(part)] = (bits[:, _tables()[n]] * power).sum(1, dtype=np.uint64) | np.uint64(n << WIDTH)
    return out


def bucket_links(key: np.ndarray, node: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller node, larger node) links of the descriptors of each bucket with
    every head that they resemble; a head is like no head before it."""
    by = np.lexsort((node, key))
    key, node, d = key[by], node[by], d[by]
    live, a, b = np.ones(len(key), bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(key):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        bucket = np.cumsum(new) - 1
        first = np.full(bucket[-1] + 1, len(key))
        np.minimum.at(first, bucket[live], np.flatnonzero(live))
        head = first[bucket]
        near = _distance(d, d[head]) <= NEAR
        hit = near & (node != node[head])
        a.append(np.minimum(node[head[hit]], node[hit]))
        b.append(np.maximum(node[head[hit]], node[hit]))
        live &= ~near
        # Buckets go on while a descriptor of theirs is like no head.
        left = np.zeros(len(first), bool)
        left[bucket[live]] = True
        on = left[bucket]
        key, node, d, live = key[on], node[on], d[on], live[on]
    return np.concatenate(a), np.concatenate(b)


def bucket_pairs(key: np.ndarray, node: np.ndarray, root: np.ndarray, d: np.ndarray, block: int = 1 << 17):
    """(smaller node, larger node) of all pairs of alike descriptors of a bucket
    whose images have different roots, in blocks."""
    by = np.lexsort((root, key))
    key, node, root, d = key[by], node[by], root[by], d[by]
    other = key[1:] != key[:-1]

    def ends(cut: np.ndarray) -> np.ndarray:
        end = np.append(np.flatnonzero(cut) + 1, len(key))
        return np.repeat(end, np.diff(np.append(0, end)))

    first, n = ends(other | (root[1:] != root[:-1])), ends(other)
    n = n - first
    row = np.flatnonzero(n)
    first, n = first[row], n[row]
    total, at = np.cumsum(n), 0
    while at < len(row):
        before = total[at] - n[at]
        end = max(at + 1, int(np.searchsorted(total, before + block, "right")))
        m = n[at:end]
        one = np.repeat(row[at:end], m)
        two = np.repeat(first[at:end] - (total[at:end] - m - before), m) + np.arange(m.sum())
        near = _distance(d[one], d[two]) <= NEAR
        a, b = node[one[near]], node[two[near]]
        yield np.minimum(a, b), np.maximum(a, b)
        at = end


def features(images: DataFrame, key: str, media: str, load=None) -> DataFrame:
    """key, digest (of the bytes), n_keypoints and points of every image.
    ``load`` makes file bytes (or None) of a value of ``media`` that is no file
    itself, in the same worker, so that no second one stands beside it."""
    tune(images.sparkSession)
    images = images.select(key, media)
    schema = T.StructType([images.schema[key], T.StructField("digest", T.BinaryType()), T.StructField("n_keypoints", T.LongType()), T.StructField("points", T.BinaryType())])

    def loaded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows if load else 0, 256):
                few = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([load(x) for x in few.column(1).to_pylist()], pa.binary())], names=[key, "media"])
            if not load:
                yield batch

    def run(batches):
        for whole in loaded(batches):
            at = 0
            while at < whole.num_rows:  # as many images at once as a bound of bytes allows, one at least
                held = end = 0
                while at + end < whole.num_rows and end < 256 and (not end or held + len(whole.column(1)[at + end].as_buffer() if whole.column(1)[at + end].is_valid else b"") <= PIXELS):
                    held += len(whole.column(1)[at + end].as_buffer() if whole.column(1)[at + end].is_valid else b"")
                    end += 1
                batch, at = whole.slice(at, end), at + end
                data = batch.column(1).to_pylist()
                points: list = [np.zeros(0, KEYPOINT)] * len(data)
                shapes: dict[tuple, list] = {}
                for i, x in enumerate(data):
                    pixels = decode(x)
                    if pixels is not None:
                        shapes.setdefault(pixels.shape, []).append((i, pixels))
                for group in shapes.values():
                    for (i, _), p in zip(group, describe(np.stack([g[1] for g in group]))):
                        points[i] = p
                digest = [None if x is None else hashlib.md5(x).digest() for x in data]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array([len(p) for p in points], pa.int64()), pa.array([p.tobytes() for p in points], pa.binary())], names=schema.names)

    return images.mapInArrow(run, schema)


def candidates(nodes: DataFrame) -> DataFrame:
    """``nodes(node, points)`` -> pairs (a, b) with VOTES alike descriptors or more."""
    parts = 8 * tune(nodes.sparkSession)  # a task holds its buckets whole

    def send(batches):
        for batch in batches:
            points = [np.frombuffer(x.as_buffer(), KEYPOINT) for x in batch.column("points")]
            size = np.array([len(p) for p in points])
            if not size.sum():
                continue
            every, owner = np.concatenate([p["d"] for p in points]), np.repeat(batch.column("node").to_numpy(zero_copy_only=False), size)
            for start in range(0, len(every), 1 << 15):  # what is sent at once stays small
                d, node = every[start : start + (1 << 15)], owner[start : start + (1 << 15)]
                row = np.tile(np.arange(len(d)), TABLES)
                k = keys(d).reshape(-1)
                to = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
                by = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[by], np.arange(parts + 1, dtype=np.uint64))
                rows = [(p, by[cut[p] : cut[p + 1]]) for p in range(parts) if cut[p + 1] > cut[p]]
                table = (k >> np.uint64(WIDTH)).astype(np.uint8)  # the rest of a key follows from the descriptor
                blobs = [[table[r].tobytes() for _, r in rows], *([x[row[r]].tobytes() for _, r in rows] for x in (node, d))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "k", "n", "d"])

    def votes(a: np.ndarray, b: np.ndarray):
        by = np.lexsort((b, a))
        pair = np.stack([a[by], b[by]], 1)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]).any(1)]))
        pair, n = pair[first], np.diff(np.append(first, len(pair)))
        for at in range(0, len(pair), 1 << 16):
            p = pair[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(n[at : at + (1 << 16)].astype(np.int64))], names=["a", "b", "votes"])

    def meet(batches):
        got: list[list] = [[], [], []]
        for batch in batches:
            for out, name in zip(got, "knd"):
                out += [x.as_buffer().to_pybytes() for x in batch.column(name)]
        if not got[0]:
            return
        t, n, d = (np.frombuffer(b"".join(x), t) for x, t in zip(got, (np.uint8, np.int64, np.uint64)))
        d, k = d.reshape(-1, 2), np.empty(len(n), np.uint64)
        for i in range(TABLES):
            k[t == i] = keys(d[t == i], i)[0]
        by = np.argsort(k, kind="stable")
        _, size = np.unique(k[by], return_counts=True)
        crowd = np.repeat(size > CROWD, size)
        few, many = by[~crowd], by[crowd]
        a, b = bucket_links(k[many], n[many], d[many])
        for at in range(0, len(a), 1 << 18):
            yield from votes(a[at : at + (1 << 18)], b[at : at + (1 << 18)])
        held, total = [], 0
        for pair in bucket_pairs(k[few], n[few], n[few], d[few]):
            held.append(pair)
            total += len(pair[0])
            if total > 1 << 18:  # what is held stays small: the counts are summed up afterwards
                yield from votes(*map(np.concatenate, zip(*held)))
                held, total = [], 0
        if held:
            yield from votes(*map(np.concatenate, zip(*held)))

    sent = nodes.select("node", "points").mapInArrow(send, "part int, k binary, n binary, d binary")
    met = sent.repartitionById(parts, F.col("part")).mapInArrow(meet, "a long, b long, votes long")
    return met.groupBy("a", "b").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= VOTES).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with INLIERS consistent matches or more; ``a`` may lead very many
    pairs, so its rows are salted."""
    parts = pairs.groupBy("a").agg(F.least(F.expr("count(1) div 256 + 1"), F.lit(SALTS)).alias("parts"))
    heads = nodes.join(parts.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), F.col("points").alias("pa"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("salt"))
    two = nodes.select(F.col("node").alias("b"), F.col("points").alias("pb"))
    salted = pairs.join(parts, "a").select("a", "b", F.expr("pmod(xxhash64(b), parts)").alias("salt"))
    joined = salted.join(two, "b").join(heads, ["a", "salt"]).select("a", "b", "pa", "pb")

    def run(batches):
        for batch in batches:
            keep = [consensus(np.frombuffer(x.as_buffer(), KEYPOINT), np.frombuffer(y.as_buffer(), KEYPOINT)) >= INLIERS for x, y in zip(batch.column("pa"), batch.column("pb"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _place(points: np.ndarray) -> np.ndarray:
    """(x, y, s, a) of keypoints, a row each."""
    return np.stack([points[f] for f in "xysa"])


class _Side:
    """The images of one side of a meeting: descriptors with their image's place and root."""

    def __init__(self, node: np.ndarray, root: np.ndarray, points: list[np.ndarray]):
        self.node, self.root, self.points = node, root, points
        self.size = np.array([len(p) for p in points])
        self.start = np.cumsum(self.size) - self.size
        self.all = np.concatenate(points)
        self.d = np.ascontiguousarray(self.all["d"])
        self.words = np.ascontiguousarray(self.d.T)
        self.place = _place(self.all)
        self.owner = np.repeat(np.arange(len(points)), self.size)

    def index(self, table: int):
        """Its buckets of a table: keys, (bucket, root) of each descriptor in order, and that order."""
        k, inverse = np.unique(keys(self.d, table)[0], return_inverse=True)
        place = (inverse << 32) | self.root[self.owner]
        by = np.argsort(place)
        return k, place[by], by


def bucket_votes(one: _Side, rows: slice, two: _Side, index: list, block: int = 1 << 18) -> np.ndarray:
    """Votes (images of ``one[rows]``, images of ``two``): alike descriptors of all buckets, of a root of
    their own left out; ``index`` has the buckets of ``two``."""
    votes = np.zeros((rows.stop - rows.start) * len(two.node), np.int64)
    begin, end = one.start[rows.start], one.start[rows.stop - 1] + one.size[rows.stop - 1]
    d, owner = one.d[begin:end], one.owner[begin:end]
    held, total = [], 0
    for table, (known, place, by) in enumerate(index):
        key = keys(d, table)[0]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        row = np.flatnonzero(known[at] == key)
        base = at[row] << 32
        cut = [np.searchsorted(place, x) for x in (base, base | one.root[owner[row]], (base | one.root[owner[row]]) + 1, base + (1 << 32))]
        row, first, n = np.tile(row, 2), np.concatenate([cut[0], cut[2]]), np.concatenate([cut[1] - cut[0], cut[3] - cut[2]])
        row, first, n = row[n > 0], first[n > 0], n[n > 0]
        sums, i = np.cumsum(n), 0
        while i < len(row):
            before = sums[i] - n[i]
            j = max(i + 1, int(np.searchsorted(sums, before + block, "right")))
            m = n[i:j]
            a = np.repeat(row[i:j], m)
            b = by[np.repeat(first[i:j] - (sums[i:j] - m - before), m) + np.arange(m.sum())]
            near = np.bitwise_count(d[a, 0] ^ two.d[b, 0]) + np.bitwise_count(d[a, 1] ^ two.d[b, 1]) <= NEAR
            held.append((owner[a[near]] - rows.start) * len(two.node) + two.owner[b[near]])
            total += len(held[-1])
            if total > 1 << 22:
                votes += np.bincount(np.concatenate(held), minlength=len(votes))
                held, total = [], 0
            i = j
    if held:
        votes += np.bincount(np.concatenate(held), minlength=len(votes))
    return votes.reshape(-1, len(two.node))


@lru_cache(1)
def _space(n: int, kind: type) -> tuple[np.ndarray, ...]:
    """Memory for ``n`` distances, made once: fresh memory for each block costs more than the distances."""
    return np.empty(n, np.uint64), *np.empty((2, n), np.uint8), *np.empty((2, n), kind)


def accepted(p: np.ndarray, node: int, two: _Side, others: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """Those of ``others`` (places in ``two``) with INLIERS in :func:`consensus` beside ``p``, the image of
    the smaller node first."""
    return np.sort(np.concatenate([b for _, b in linked([(0, p, node, others)], two, block)]))


def linked(rows, two: _Side, block: int = 1 << 19):
    """``rows`` of (place, keypoints, node, others) -> (places, others) as in :func:`accepted`, a share at a
    time: the transforms of many images are tried together."""
    held, pairs = [], 0
    for at, p, node, others in rows:
        for few, i, j, pair in _matches(p, two, others, block):
            held.append((np.full(len(few), at), few, two.node[few] < node, _place(p).take(i, 1), j, pair + pairs))
            pairs += len(few)
            if pairs >= 1 << 13:
                yield _agreeing(held, two)
                held, pairs = [], 0
    yield _agreeing(held, two) if held else (np.empty(0, np.int64), np.empty(0, np.int64))


def _agreeing(held: list, two: _Side) -> tuple[np.ndarray, np.ndarray]:
    at, few, swap, mine, j, pair = (np.concatenate(x, -1) for x in zip(*held))
    hit = _inliers(mine, two.place.take(j, 1), pair, len(few), swap[pair]) >= INLIERS
    return at[hit], few[hit]


def _matches(p: np.ndarray, two: _Side, others: np.ndarray, block: int):
    """(others, row of ``p``, column of ``two``, place in others) of the mutual nearest neighbours, for those
    with INLIERS of them; many at once, images of like size in a block whose last axis they are."""
    if not len(others):
        return
    others = others[np.argsort(two.size[others], kind="stable")]
    most = int(two.size[others[-1]])
    kind, shift = (np.uint16, 8) if max(len(p), most) <= 256 else (np.uint32, 24)
    row, mask = np.arange(len(p), dtype=kind)[:, None], kind((1 << shift) - 1)
    step = max(1, block // (len(p) * most))
    for few in np.array_split(others, -(-len(others) // step)):
        width, each = np.arange(two.size[few[-1]])[:, None], np.arange(len(few))
        column = two.start[few] + np.minimum(width, two.size[few] - 1)  # the last one again is never the first nearest
        apart, far, more, ranked, key = (x[: len(p) * column.size].reshape(len(p), -1) for x in _space(max(block, len(p) * column.size), kind))
        for word, count in enumerate((far, more)):
            np.bitwise_xor(p["d"][:, word, None], two.words[word].take(column.reshape(-1)), out=apart)
            np.bitwise_count(apart, out=count)
        far += more
        np.multiply(far, kind(1 << shift), out=ranked, dtype=kind)  # a distance, then its first row or column
        nearest = (np.bitwise_or(ranked, row, out=key).min(0) & mask).reshape(column.shape)
        ranked, key = (x.reshape(len(p), *column.shape) for x in (ranked, key))
        own = np.bitwise_or(ranked, width.astype(kind), out=key).min(1)
        partner = (own & mask).astype(np.int64)
        match = ((own >> kind(shift)) <= FAR) & (nearest[partner, each] == row)
        enough = np.flatnonzero(match.sum(0) >= INLIERS)
        pair, i = np.nonzero(match.T[enough])
        if len(enough):
            yield few[enough], i, column[partner[i, enough[pair]], enough[pair]], pair


def _inliers(a: np.ndarray, b: np.ndarray, pair: np.ndarray, pairs: int, swap: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Per pair of images the matches that agree on the best transform, as in :func:`consensus`: ``a`` and
    ``b`` are the places of the matched keypoints in order of ``pair``, the other way round where ``swap`` is
    set.  Pairs with about as many matches are tried together, one match of each at a time; what fills up a pair
    is NaN, which agrees with nothing."""
    best = np.zeros(pairs, np.int64)
    (ax, ay, asize, aturn), (bx, by, bsize, bturn) = np.where(swap, b, a), np.where(swap, a, b)
    size, turn = bsize / asize, bturn - aturn
    values = [ax, ay, bx, by, size * np.cos(turn), size * np.sin(turn)]
    count = np.bincount(pair, minlength=pairs)
    begin, order, at = np.cumsum(count) - count, np.argsort(count, kind="stable"), int((count < INLIERS).sum())
    while at < pairs:
        few = order[at : at + max(1, block // int(count[order[at]]))]
        at += len(few)
        place = np.arange(count[few[-1]])[:, None]
        real, index = place < count[few], begin[few] + np.minimum(place, count[few] - 1)
        x, y, u, v, *step = (np.where(real, value[index], np.float32(np.nan)) for value in values)
        most, far = np.zeros_like(x), np.zeros(x.shape, np.int64)
        for i in range(len(x)):
            wide = (x[i] - x) ** 2 + (y[i] - y) ** 2
            wider = wide > most
            np.copyto(most, wide, where=wider)
            np.copyto(far, i, where=wider)
        dx, dy, du, dv = (np.take_along_axis(z, far, 0) - z for z in (x, y, u, v))
        with np.errstate(divide="ignore", invalid="ignore"):
            re, im = np.stack([step[0], (du * dx + dv * dy) / most]), np.stack([step[1], (dv * dx - du * dy) / most])
            size = np.hypot(re, im)
            near = np.where((0.3 < size) & (size < 3.4), (2.5 * np.maximum(1, size)) ** 2, np.float32(np.nan))
            agree, off, also, by = np.zeros(re.shape, np.uint8 if len(x) < 256 else np.uint32), *np.empty((3, *re.shape), np.float32)
            for i in range(len(x)):
                dx, dy = x[i] - x, y[i] - y
                np.multiply(re, dx, out=off)
                off -= np.multiply(im, dy, out=by)
                off -= u[i] - u
                np.multiply(re, dy, out=also)
                also += np.multiply(im, dx, out=by)
                also -= v[i] - v
                off *= off
                also *= also
                off += also
                agree += (off < near).view(np.uint8)
        best[few] = agree.max((0, 1))
    return best


def remaining(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Verified links (a, b) that join images of different roots: all pairs with VOTES votes or more, every
    pair of every bucket counted, crowded or not.

    The images are dealt into groups and each pair of groups meets in a task, so that the votes of two images
    are counted in one place, some images at a time, and never written; a task returns a spanning forest."""
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "points")
    total = rooted.agg(F.sum(F.octet_length("points"))).first()[0] or 0
    groups = max(4, -(-total // (KEYPOINT.itemsize * GROUP)))
    dealt = rooted.withColumn("g", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumn("part", F.expr("cast(greatest(g, h) * (greatest(g, h) + 1) / 2 + least(g, h) as int)"))

    def meet(batches):
        got: list[list] = [[], [], [], [], []]
        for batch in batches:
            for out, name in zip(got[:4], ("node", "root", "g", "h")):
                out.append(batch.column(name).to_numpy(zero_copy_only=False))
            got[4] += [np.frombuffer(x.as_buffer().to_pybytes(), KEYPOINT) for x in batch.column("points")]
        if not got[4]:
            return
        node, root, g, h = map(np.concatenate, got[:4])
        _, root = np.unique(root, return_inverse=True)
        sides = [_Side(node[x], root[x], [got[4][i] for i in x]) for x in (np.flatnonzero(g <= h), np.flatnonzero(g >= h)) if len(x)]
        if len(sides) < 2:
            return
        one, two = sides
        index = [two.index(t) for t in range(TABLES)]
        step = max(1, (1 << 20) // len(two.node))

        def voted():
            for at in range(0, len(one.node), step):
                for i, row in enumerate(bucket_votes(one, slice(at, min(len(one.node), at + step)), two, index), at):
                    others = np.flatnonzero(row >= VOTES)
                    if g[0] == h[0]:
                        others = others[others > i]  # a group with itself: both sides have one order
                    if len(others):
                        yield i, one.points[i], one.node[i], others

        links_a, links_b = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in linked(voted(), two):
            if len(a):
                links_a, links_b = forest(np.append(links_a, one.node[a]), np.append(links_b, two.node[b]))
        yield pa.RecordBatch.from_arrays([pa.array(links_a), pa.array(links_b)], names=["a", "b"])

    return dealt.repartitionById(groups * (groups + 1) // 2, F.col("part")).select("node", "root", "g", "h", "points").mapInArrow(meet, "a long, b long")


def copies(images: DataFrame, key: str = "media_id", media: str = "media", load=None) -> DataFrame:
    """key, n_keypoints and class_id (the class's smallest key) of every row;
    ``load`` as in :func:`features`."""
    scratch = Scratch(images.sparkSession, "media")
    described = features(images, key, media, load) if load else features(images, key, media)
    rows = scratch.keep(described.withColumn("__uid", F.monotonically_increasing_id()))
    rows = rows.withColumn("__digest", F.coalesce("digest", F.col("__uid").cast("string").cast("binary")))
    groups = scratch.keep(rows.groupBy("__digest").agg(F.min("__uid").alias("node"), F.min(key).alias("low")))
    nodes = scratch.keep(rows.where("n_keypoints > 0").join(groups.select("node"), F.col("__uid") == F.col("node"), "left_semi").select(F.col("__uid").alias("node"), "points"))
    links = scratch.keep(verified(scratch.keep(candidates(nodes)), nodes))
    roots = scratch.keep(connected_components(links, scratch))
    sweep(images.sparkSession)
    more = scratch.keep(remaining(nodes, roots))
    if not more.isEmpty():
        roots = scratch.keep(connected_components(links.unionByName(more), scratch))
    name = groups.select("node", "low").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("low").alias("class_id"))
    named = groups.join(roots, "node", "left").select("__digest", F.coalesce("root", "node").alias("root")).join(name, "root").select(F.col("__digest").alias("__of"), "class_id")
    named = scratch.keep(named)  # a table of its own, so that a hot digest's rows can be split
    return rows.join(named, F.col("__digest") == F.col("__of"), "left").select(key, "n_keypoints", "class_id")


def drawn(vector) -> bytes | None:
    """The grey map of a vector, a null element as zero; null stays null."""
    return None if vector is None else pgm(picture([0.0 if x is None else x for x in vector]))
