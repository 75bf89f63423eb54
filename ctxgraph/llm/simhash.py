"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64-bit majority votes over word-shingle hashes.  To link all
fingerprints within ``radius`` bits, the 64 bits are cut into segments and, by
the pigeonhole principle, two fingerprints so close differ by at most r_i bits
in some segment i, where sum(r_i + 1) > radius.  Every fingerprint is stored
once per segment under the segment's value and looks up the Hamming ball of
radius r_i around its own value; of two values exactly one has the higher of
the differing bits set, so only flips whose highest bit is set are looked up
and each pair is met from one side.  Full distances decide.

Only distinct fingerprints are indexed.  Look-ups go to tasks by a hash of
(segment, value); each task verifies in blocks and returns a spanning forest
of its links, never the pairs of a group.  Components are joined up by star
contraction over shuffles.

``deduplicate`` groups by verified similarity of shingle sets instead, as
``similar_groups`` tells.

Defined results: null or empty text (no words) has fingerprint zero, linked
like any other; fewer words than a shingle make one shingle of all words;
rows repeating an id keep one row each; a null id takes part in links under no
name (its component is that of the smallest named member, else null).
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, forest, sweep, tune

WORDS, SEED, RADIUS = 4, 42, 4
#: Of the grouping by similarity: shingle words, least similarity, bits apart at most, bands and their minima.
STAGE_WORDS, SIMILARITY, STAGE_RADIUS, BANDS, ROWS = 5, 0.8, 24, 20, 4
#: Texts of a band that are compared all with all; parts of a crowded key.
CROWD, _SALTS = 16, 8
#: Texts from which the frequency of shingles is learned.
_SAMPLE = 4096
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each ``words``-word shingle, repeats included."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    length = np.fromiter(map(len, ws), np.int64, len(ws))
    end = np.cumsum(length + 1) - 1
    begin = (end - length)[: 1 - words].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[i:j], seed) for i, j in zip(begin, end[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        starts = np.arange(0, len(part), 255)
        for b in range(8):
            lanes = np.add.reduceat((part >> np.uint64(b)) & _LANES, starts)
            counts[b::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = np.nonzero(2 * counts > len(hashes))[0]
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long, for its text."""
    tune(docs.sparkSession)
    at = docs.columns.index(text)
    rest = [f for f in docs.schema.fields if f.name != text and f.name != "fp"]
    where = [docs.columns.index(f.name) for f in rest]
    schema = T.StructType([*rest, T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in batch.column(at)]
            fp = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in where), fp], names=schema.names)

    return docs.mapInArrow(run, schema)


def layout(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(low bit, width, ball radius) of each segment for ``n`` fingerprints:
    as many segments as leave a value about one fingerprint or fewer."""
    m = max(2, min(3, 64 // max(1, (max(n, 2) - 1).bit_length() - 3)))
    extra, out, low = radius - m + 1, [], 0
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        out.append((low, width, extra // m + (i < extra % m)))
        low += width
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def ball(fp: np.ndarray, low: int, width: int, r: int):
    """Blocks (row numbers, value) of the half ball around segment values."""
    value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
    rows = np.arange(len(fp))
    yield rows, value
    for k in range(1, r + 1):
        for bits in combinations(range(width), k):
            on = ((value >> np.uint64(bits[-1])) & np.uint64(1)).astype(bool)
            yield rows[on], value[on] ^ np.uint64(sum(1 << b for b in bits))


def _pairs(table: np.ndarray, t_key: np.ndarray, probe: np.ndarray, p_key: np.ndarray, radius: int, block: int = 1 << 20):
    """Verified links of look-ups with table rows of equal key, in blocks."""
    order = np.argsort(t_key, kind="stable")
    table, t_key = table[order], t_key[order]
    lo, hi = np.searchsorted(t_key, p_key, "left"), np.searchsorted(t_key, p_key, "right")
    some = hi > lo
    probe, lo, n = probe[some], lo[some], (hi - lo)[some]
    at, inside = 0, 0
    while at < len(probe):
        if n[at] > block:  # one look-up at a large value: a slice of it at a time
            part = table[lo[at] + inside : lo[at] + min(n[at], inside + block)]
            a, b = np.full(len(part), probe[at]), part
            inside += block
            if inside >= n[at]:
                at, inside = at + 1, 0
        else:
            end = at + max(1, int(np.searchsorted(np.cumsum(n[at : at + block]), block, "right")))
            reps = n[at:end]
            first = np.repeat(lo[at:end] - (np.cumsum(reps) - reps), reps)
            a, b = np.repeat(probe[at:end], reps), table[first + np.arange(reps.sum())]
            at = end
        near = (_popcount(a ^ b) <= radius) & (a != b)
        if near.any():
            yield a[near], b[near]


def links(fps: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """``fps(fp)``, distinct -> spanning links ``(a, b)`` of fingerprints within
    ``radius`` bits."""
    parts = tune(fps.sparkSession)
    segments = layout(fps.count() if n is None else n, radius)

    def look_up(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            out: dict[int, list] = {}
            for s, (low, width, r) in enumerate(segments):
                for probe, (rows, value) in enumerate(ball(fp, low, width, r)):
                    key = (value << np.uint64(2)) | np.uint64(s)
                    to = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
                    if probe == 0:
                        key = key | np.uint64(1 << 62)
                    order = np.argsort(to, kind="stable")
                    cut = np.flatnonzero(np.diff(to[order])) + 1
                    for chunk in np.split(order, cut):
                        if len(chunk):
                            out.setdefault(int(to[chunk[0]]), []).append((key[chunk], fp[rows[chunk]]))
            keys = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), *(pa.array([np.concatenate([x[i] for x in out[k]]).tobytes() for k in keys], pa.binary()) for i in (0, 1))], names=["part", "keys", "fps"]
            )

    def verify(batches):
        keys, fps = [], []
        for batch in batches:
            keys += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            fps += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
        if not keys:
            return
        key, fp = np.concatenate(keys), np.concatenate(fps)
        own = (key >> np.uint64(62)).astype(bool)
        bare = key & np.uint64((1 << 62) - 1)
        # A fingerprint's own value is both a table row and a look-up.
        got_a, got_b, held = [], [], 0
        for a, b in _pairs(fp[own], bare[own], fp, bare, radius):
            got_a.append(a)
            got_b.append(b)
            held += len(a)
            if held > 1 << 21:  # keep a forest, not the pairs
                a, b = forest(np.concatenate(got_a), np.concatenate(got_b))
                got_a, got_b, held = [a], [b], len(a)
        if got_a:
            a, b = forest(np.concatenate(got_a), np.concatenate(got_b))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = fps.select("fp").mapInArrow(look_up, "part int, keys binary, fps binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(verify, "a long, b long")


def components(marked: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``marked(key, fp, ...)`` with ``component_id``, the smallest key that
    links of at most ``radius`` bits reach, itself included, and ``root``, a
    fingerprint that stands for the component."""
    scratch = Scratch(marked.sparkSession, "simhash")
    marked = scratch.keep(marked.drop("component_id", "root"))
    # Equal fingerprints are one node; the node's name is its smallest key.
    nodes = scratch.keep(marked.groupBy("fp").agg(F.min(key).alias("__low")))
    found = links(nodes.select("fp"), radius, nodes.count())
    roots = scratch.keep(connected_components(found, scratch))
    named = roots.join(nodes, roots.node == nodes.fp).groupBy("root").agg(F.min("__low").alias("__id"))
    name = roots.join(named, "root").select(F.col("node").alias("__fp"), "__id", "root")
    name = nodes.join(name, nodes.fp == name["__fp"], "left").select(F.col("fp").alias("__fp"), F.coalesce("__id", "__low").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # A fingerprint that a third of all rows share (copies) is salted, so that no task gets all of them.
    salts = 16
    wide = name.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = marked.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return left.join(wide, (left.fp == wide["__fp"]) & (left["__salt"] == wide["__salt"])).select(*[left[c] for c in marked.columns], "component_id", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fp (signed long) and component_id of every row of ``docs``."""
    return components(fingerprints(docs.select(key, text), text), key, radius).drop("root")


def signature(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A number per band: the band's smallest hashes under ``rows`` orders, mixed
    with the band's number.  Sets of similarity s share a band with 1 - s**rows."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    n = bands * rows
    add, odd = np.random.default_rng(n).integers(0, 1 << 63, (2, n), np.uint64)
    odd |= np.uint64(1)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):  # memory stays bounded for long texts
        x = (hashes[at : at + 2048] ^ add[:, None]) * odd[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, x.min(1))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = (out ^ low[r::rows]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _marked(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, raw (digest of the text), same (digest of its words), fp, bands and
    the distinct shingles (32 bits of their hashes, sorted) of every row."""
    tune(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key), F.unhex(F.md5(body.cast("binary"))).alias("raw"), body.alias("t"))
    schema = T.StructType([docs.schema[0], T.StructField("raw", T.BinaryType()), T.StructField("same", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("shingles", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            same, fp, bands, shingles = [], [], [], []
            for t in batch.column(2).to_pylist():
                ws = t.encode().lower().split()
                same.append(hashlib.md5(b" ".join(ws)).digest())
                h = np.unique(shingle_hashes(t, words))
                fp.append(fingerprint(h))
                bands.append(signature(h).view(np.int64))
                shingles.append(np.unique(h.astype(np.uint32)).view(np.int32))
            lists = lambda xs, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs) if xs else [], kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), lists(bands, pa.int64()), lists(shingles, pa.int32())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _similar(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have that Jaccard similarity or more.

    ``a`` may be one node in very many pairs: its rows are salted."""
    heads = shingles.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    heads = heads.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("__salt"))
    own = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(own, "b").withColumn("__salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int")).join(heads, ["a", "__salt"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _prefix_pairs(nodes: DataFrame, shingles: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """``nodes(node, root)`` -> pairs (a, b) of different roots, all that have that similarity among them.

    A prefix join: with the shingles of every text in one order, two such texts share a shingle among
    the first ``n - similarity * n`` of each (and one), and what follows the first that they share is long
    enough for the overlap.  Any order is right; frequent shingles come last so that few texts meet.  How
    frequent they are is learned from ``_SAMPLE`` texts, all of them are indexed."""
    sample = shingles.join(nodes.orderBy(F.xxhash64("node")).limit(_SAMPLE).select("node"), "node", "left_semi")
    often = sample.select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(_SAMPLE * 16).collect()
    often = sorted((r["s"], r["count"]) for r in often)
    known, count = (np.array([x[i] for x in often], np.int64) for i in (0, 1))

    def prefixes(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for node, root, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = values.values.to_numpy(zero_copy_only=False).astype(np.int64)
                seen = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    seen = np.where(known[at] == s, count[at], 0)
                keep = len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1
                first = s[np.lexsort(((s * 0x9E3779B1) & 0xFFFFFFFF, seen))[:keep]]
                for x, v in zip(out, (np.full(len(first), node), np.full(len(first), root), np.full(len(first), len(s)), np.arange(len(first)), first)):
                    x.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["node", "root", "n", "pos", "s"])

    wanted = nodes.join(shingles, "node").select("node", "root", "shingles")
    postings = scratch.keep(wanted.mapInArrow(prefixes, "node long, root long, n long, pos long, s long"))
    # Only shingles of several classes go on, in parts where very many texts have them.
    lists = postings.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    met = scratch.keep(postings.join(lists.select("s", F.expr("least(m div 256 + 1, 64)").alias("parts")), "s"))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("root", "n", "pos")]
    left = met.select("s", F.expr("pmod(xxhash64(node), parts)").alias("salt"), F.col("node").alias("a"), *side("a"))
    right = met.select("s", F.explode(F.expr("sequence(0L, parts - 1)")).alias("salt"), F.col("node").alias("b"), *side("b"))
    least = similarity / (1 + similarity)
    enough = F.least(F.expr("a_n - a_pos"), F.expr("b_n - b_pos")) >= least * (F.col("a_n") + F.col("b_n")) - 1e-6
    return left.join(right, ["s", "salt"]).where((F.col("a_root") < F.col("b_root")) & enough).select("a", "b").distinct()


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = STAGE_WORDS, similarity: float = SIMILARITY, radius: int = STAGE_RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """key, raw (digest of the text) and root of every row: rows share a root if
    links of ``similarity`` or more between their sets of shingles join them.

    Radius tables alone cannot do this: at similarity 0.8 fingerprints lie about
    ten bits apart, and balls of that size outnumber the documents.  So texts meet
    where a band of their shingles' minima is equal (all but 3 in 100,000 pairs at
    just 0.8 do), fingerprints further apart than ``radius`` bits are passed over, and
    the shingles of what is left are compared in full.

    No group is compared all with all.  In each band every text is compared with the
    leader of another class, the one that shares the most bands with others (the text
    that a crowd was copied from shares more than the copies do), in rounds until no
    round finds a link.  What is left, bands of texts of several classes, is compared in
    full: all with all in bands of at most ``CROWD`` texts, and the texts of all larger
    bands by ``_prefix_pairs``, which loses no pair."""
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    marked = scratch.keep(_marked(docs, key, text, words).withColumn("uid", F.monotonically_increasing_id()), "zstd")
    # Rows of equal words are one node from here on, named by one of its rows.
    names = scratch.keep(marked.groupBy("same").agg(F.min("uid").alias("node")))
    rows = scratch.keep(marked.select(key, "raw", "same"))
    # The shingles, most of the bytes, are dealt anew once only, below.
    nodes = marked.select(F.col("uid").alias("node"), "fp", "bands").join(names.select("node"), "node", "left_semi")
    nodes = scratch.keep(nodes, "zstd")
    entries = nodes.select("node", "fp", F.explode("bands").alias("band"))
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    every = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")

    # Only bands that two nodes or more share go on, with each node's number of meetings.
    sizes = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "n", every)
    shared = scratch.keep(entries.withColumn("salt", salt).join(sizes, ["band", "salt"]).drop("salt"))
    meetings = shared.groupBy("node").agg(F.sum("n").alias("pop"))
    met_once, shared = shared, scratch.keep(shared.join(meetings, "node").drop("n"))
    scratch.release(met_once)
    scratch.release(nodes)
    meeting = scratch.keep(shared.select("node").distinct())
    shingles = scratch.keep(marked.select(F.col("uid").alias("node"), "shingles").join(meeting, "node", "left_semi"), "zstd")
    scratch.release(marked, meeting)
    sweep(docs.sparkSession)

    def components(edges: DataFrame) -> DataFrame:
        own = Scratch(docs.sparkSession, "similar-roots")
        out = scratch.keep(connected_components(edges, own))
        own.drop()
        return out

    # Tables are deleted as soon as those made of them are written.
    roots = links = tested = rooted = None
    while True:
        last = rooted
        rooted = shared.withColumn("root", F.col("node")) if roots is None else shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = scratch.keep(rooted)
        scratch.release(last)
        per = scratch.keep(rooted.groupBy("band", "root").agg(F.max(F.struct("pop", "node", "fp")).alias("h")))
        one = per.groupBy("band").agg(F.max(F.struct("h", "root")).alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", F.col("x.h").alias("h1"), F.col("x.root").alias("r1"))
        two = per.join(one.select("band", "r1"), "band").where("root <> r1").groupBy("band").agg(F.max("h").alias("h2"))
        leaders = one.join(two, "band").select("*", every)
        met = rooted.withColumn("salt", salt).join(leaders, ["band", "salt"]).withColumn("h", F.when(F.col("root") == F.col("r1"), F.col("h2")).otherwise(F.col("h1")))
        met = met.select(F.col("node").alias("b"), "fp", F.col("h.node").alias("a"), F.col("h.fp").alias("a_fp"), F.col("h.pop").alias("pop")).where(near("fp", "a_fp"))
        if roots is None:  # a crowd of copies gives a link a copy
            met = met.groupBy("b").agg(F.max(F.struct("pop", "a")).alias("x")).select("b", "x.a")
        else:
            met = met.select("b", "a").distinct().join(tested, ["b", "a"], "left_anti")
        met = scratch.keep(met.select("a", "b"))
        scratch.release(per)
        found = scratch.keep(_similar(met, shingles, similarity))
        tested = met if tested is None else tested.unionByName(met)
        first = links is None
        links = found if first else links.unionByName(found)
        if found.isEmpty() and not first:
            break
        before, roots = roots, components(links)
        scratch.release(before)
        sweep(docs.sparkSession)

    scratch.release(shared)
    sizes = scratch.keep(rooted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi"))
    left = scratch.keep(rooted.join(sizes.where(f"n <= {CROWD}"), "band", "left_semi").select("band", F.col("node").alias("b"), F.col("fp").alias("b_fp"), F.col("root").alias("b_root")))
    right = left.select("band", F.col("b").alias("a"), F.col("b_fp").alias("a_fp"), F.col("b_root").alias("a_root"))
    more = left.join(right, "band").where((F.col("a_root") < F.col("b_root")) & near("a_fp", "b_fp")).select("a", "b")
    crowded = scratch.keep(rooted.join(sizes.where(f"n > {CROWD}"), "band", "left_semi").select("node", "root").distinct())
    if not crowded.isEmpty():
        more = more.unionByName(_prefix_pairs(crowded, shingles, similarity, scratch))
    found = scratch.keep(_similar(scratch.keep(more.distinct().join(tested, ["a", "b"], "left_anti")), shingles, similarity))
    if not found.isEmpty():
        roots = components(links.unionByName(found))
    name = names.join(roots, "node", "left").select(F.col("same").alias("__same"), F.coalesce("root", "node").alias("root"))
    return rows.join(name, rows["same"] == name["__same"]).select(key, "raw", "root")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = STAGE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of ``similar_groups``: that of the smallest key, a
    null key last; of rows that repeat it, that of the smallest digest.  Texts
    without words are one group.  Columns pass through, whatever their names."""
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    tables = Scratch(docs.sparkSession, "similar")
    found = scratch.keep(similar_groups(docs, key, text, words, similarity, scratch=tables))
    tables.drop()
    best = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "raw")).alias("x"), F.count(F.lit(1)).alias("n"))
    best = scratch.keep(best.select(F.col("x.key").alias("__key"), F.col("x.raw").alias("__raw")))  # its size decides between broadcast and shuffle
    out = docs.join(best, docs[key].eqNullSafe(best["__key"]) & (F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))) == best["__raw"]), "left_semi")
    if found.groupBy(key, "raw").count().where("count > 1").isEmpty():
        return out
    # Rows alike in key and text are told apart by nothing: one of each stays.
    marks = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    out = out.select(*[docs[c].alias(m) for c, m in marks.items()]).withColumn("__raw", F.md5(F.coalesce(F.col(marks[text]), F.lit("")).cast("binary")))
    return out.dropDuplicates([marks[key], "__raw"]).select(*[F.col(m).alias(c) for c, m in marks.items()])


def hex16(fp):
    """A signed long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
