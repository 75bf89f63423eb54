"""Exact removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes covers it that also starts in a
document with a smaller id.  Which suffixes could be repeated is settled first,
with 8 bytes per candidate, so that only few reach a sort:

1. *Winnowing.*  In each ``length``-byte window the 24-byte gram of least hash
   is its anchor.  Equal windows have equal anchors at the same place.
2. *Anchors.*  Distinct anchor hashes go to tasks by hash; a bit per hash comes
   back: does another block of documents hold it?
3. *Contexts.*  For repeated anchors, a 128-bit hash of all bytes that windows
   around the anchor can reach.  Equal contexts are settled: all but the
   smallest id are covered.
4. *Suffixes.*  Where one anchor has several contexts, one copy of each is sent
   and the suffixes inside them are sorted: multikey quicksort on 8-byte digits
   to a shallow depth, then blind tries split the groups with long common
   prefixes at their branching bytes only.  Suffixes alike to ``length`` bytes
   form a class; members above the class's smallest id are covered.
5. *Hot anchors.*  An anchor with many contexts (a line that many documents share
   in different surroundings) would fill one task, so its windows are dealt out
   one by one, by their own hash: 24 bytes for each different window of a block.

Equal anchors, contexts and windows of a block are merged before they are sent,
so a passage in a third of all documents costs each task one row a block.  The
text itself is never shuffled: it lies in a table bucketed by block, and the
small answers are joined to it.

Defined results: null text is empty; a null id counts as larger than any and
equal ids never remove each other; other columns pass through.  Kept bytes that
no longer form a character are left out of the text (not of the digest).
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, tune

LENGTH, GRAM, SHALLOW, BLOCK = 50, 24, 24, 1 << 20
#: Contexts of one anchor in a block, or in all blocks, from which its windows are dealt out one by one.
HOT, HOT_ALL = 64, 2048
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)
_U = np.uint64
NO_ID, HOT_ID = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def words8(body: bytes, order: str = "<") -> np.ndarray:
    """The 8 bytes from each position as a number; zeros follow the end."""
    n = len(body)
    padded = body + bytes(16 + 8)
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        part = out[o::8]
        part[:] = np.frombuffer(padded, f"{order}u8", len(part), o)
    return out


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * _K[0] + b * _K[1] + c * _K[2]
    h ^= h >> _U(32)
    h *= _K[3]
    h ^= h >> _U(29)
    return h


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = f(x[: -(width - have)], x[width - have :])
    return x


def winnow(body: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Marks of anchor positions; windows lie within one document."""
    n, span = len(body), length - gram + 1
    marks = np.zeros(n, bool)
    if n < length:
        return marks
    w = words8(body)
    h = _mix(w[: n - 23], w[8 : n - 15], w[16 : n - 7]) | _U(1)
    low = _slide(h, span, np.minimum)  # one for each window
    begin = 0
    for e in ends.tolist():
        low[max(begin, e - length + 1) : e] = 0
        begin = e
    zeros = np.zeros(span - 1, np.uint64)
    top = _slide(np.concatenate([zeros, low, zeros]), span, np.maximum)
    marks[: len(h)] = top == h
    return marks


def sort_suffixes(body: bytes, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW):
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes (all
    are there), and marks of those equal to the one before.

    ``shallow`` is a multiple of 8 and at most ``depth`` - 8."""
    m = len(starts)
    order, joined = np.arange(m), np.ones(m, bool)
    if not m:
        return order, joined
    joined[0] = False
    word = words8(body, ">")

    def refine(live: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Sort the live places within their groups by key and cut them there."""
        group = np.cumsum(~joined[live])
        by = np.lexsort((key, group))
        order[live] = order[live][by]
        key, group = key[by], group[by]
        cut = np.empty(len(live), bool)
        cut[0] = True
        cut[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        joined[live[cut]] = False
        return cut

    def unsettled(live: np.ndarray) -> np.ndarray:
        """Those of the live places whose group has two members or more."""
        follows = np.zeros(len(live), bool)
        follows[:-1] = joined[live[1:]] & (live[1:] == live[:-1] + 1)
        return live[joined[live] | follows]

    live = np.arange(m)
    for at in range(0, shallow, 8):  # multikey quicksort, eight bytes a digit
        refine(live, word[starts[order[live]] + at])
        live = unsettled(live)
        if not len(live):
            return order, joined
    # Blind tries, all groups at once: a node tests the first byte in which its
    # group's members differ from its first, and skips all before it.
    places = [*range(shallow, depth - 7, 8)]
    if places[-1] != depth - 8:
        places.append(depth - 8)
    while len(live):
        first = np.flatnonzero(~joined[live])
        size = np.diff(np.append(first, len(live)))
        own = starts[order[live]]
        head = np.repeat(own[first], size)
        branch = np.full(len(live), depth)
        for at in reversed(places):
            x = word[own + at] ^ word[head + at]
            differ = np.flatnonzero(x)
            lead = 63 - np.floor(np.log2((x[differ] >> _U(11)).astype(np.float64) + 0.5)).astype(np.int64) - 11
            small = x[differ] < _U(1 << 11)
            lead[small] = 63 - np.floor(np.log2(x[differ][small].astype(np.float64))).astype(np.int64)
            branch[differ] = at + lead // 8
        node = np.minimum.reduceat(branch, first)
        open_ = np.repeat(node < depth, size)
        node = np.repeat(node, size)[open_]
        live = live[open_]
        if not len(live):
            break
        refine(live, word[starts[order[live]] + node] >> _U(56))
        live = unsettled(live)
    return order, joined


def covered_windows(body: bytes, starts: np.ndarray, docs: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Marks of the windows that also start in a document of smaller id."""
    out = np.zeros(len(starts), bool)
    order, joined = sort_suffixes(body, starts, depth)
    if len(order):
        first = np.flatnonzero(~joined)
        low = np.minimum.reduceat(docs[order], first)
        out[order] = docs[order] > np.repeat(low, np.diff(np.append(first, len(order))))
    return out


class Block:
    """Documents of one block with their anchors; all derived arrays come out
    alike each time they are derived."""

    def __init__(self, body: bytes, ids: bytes, ends: bytes, marks: bytes, length: int = LENGTH, gram: int = GRAM):
        self.body, self.length, self.gram = body, length, gram
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.pos = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(body)))
        self.word = words8(body)
        self.doc = np.searchsorted(self.ends, self.pos, "right")
        w, p = self.word, self.pos
        # Anchors are minima of hashes, so all are small; an odd factor spreads them over the parts.
        self.hash = _mix(w[p], w[p + 8], w[p + 16]) * _K[9] if len(p) else np.empty(0, np.uint64)
        self.distinct, self.which = np.unique(self.hash, return_inverse=True)

    def repeated(self, answers: dict, parts: int) -> "Block":
        """Keep the anchors that other documents hold, here or elsewhere."""
        mask = np.zeros(len(self.distinct), bool)
        cuts = self.cuts(self.distinct, parts)
        for part, data in answers.get(0, {}).items():
            lo, hi = cuts[part], cuts[part + 1]
            mask[lo:hi] = np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo)
        low, high = np.full(len(mask), NO_ID), np.full(len(mask), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.ids[self.doc])
        np.maximum.at(high, self.which, self.ids[self.doc])
        mask |= low < high
        keep = mask[self.which]
        self.pos, self.doc, self.hash = self.pos[keep], self.doc[keep], self.hash[keep]
        self.start = np.maximum(self.begins[self.doc], self.pos - (self.length - self.gram))
        self.stop = np.minimum(self.ends[self.doc], self.pos + self.length)
        # Two 64-bit hashes of each context, its extent and the anchor's place in it.
        size = self.stop - self.start
        c = [(size * 128 + self.pos - self.start).astype(np.uint64) * _K[i] for i in (4, 7)]
        full = _U(0xFFFFFFFFFFFFFFFF)
        for k in range((2 * self.length - self.gram + 7) // 8):
            left = np.clip(size - 8 * k, 0, 8)
            w = self.word[np.minimum(self.start + 8 * k, len(self.body) - 1)]
            w = np.where(left == 0, _U(0), w & (full >> ((8 - np.maximum(left, 1)) * 8).astype(np.uint64)))
            for i in (0, 1):
                x = (c[i] ^ w) * _K[(k + 5 * i) % 10]
                c[i] = x ^ (x >> _U(31 - 2 * i)) ^ (c[i] << _U(17 + 4 * i)) ^ (c[i] >> _U(47 - 4 * i))
        # One entry for each (anchor, context): the occurrence of smallest id.
        by = np.lexsort((self.pos, self.ids[self.doc], c[1], c[0], self.hash))
        h, c0, c1 = self.hash[by], c[0][by], c[1][by]
        new = np.ones(len(by), bool)
        new[1:] = (h[1:] != h[:-1]) | (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1])
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.first = by[new]
        self.e_hash, self.e_c = h[new], (c0[new], c1[new])
        self.e_id = self.ids[self.doc[self.first]]
        return self

    def sent(self, hot: int) -> np.ndarray:
        """The entries that are sent: all of an anchor, or of a hot one the first
        alone, which says so."""
        anchor = np.flatnonzero(np.concatenate([[True], self.e_hash[1:] != self.e_hash[:-1]])) if len(self.e_hash) else np.empty(0, np.int64)
        size = np.diff(np.append(anchor, len(self.e_hash)))
        self.hot = np.repeat(size > hot, size)
        keep = ~self.hot
        keep[anchor] = True
        return np.flatnonzero(keep)

    def status(self, answers: dict, parts: int, hot: int) -> np.ndarray:
        """Of each entry: 0 kept, 1 covered, 2 to be compared in its anchor's
        group, 3 to be compared window by window."""
        sent = self.sent(hot)
        got = np.zeros(len(sent), np.uint8)
        cuts = self.cuts(self.e_hash[sent], parts)
        for part, data in answers.get(1, {}).items():
            got[cuts[part] : cuts[part + 1]] = np.frombuffer(data, np.uint8)
        out = np.where(self.hot, np.uint8(3), np.uint8(0))
        out[sent] = np.where(self.hot[sent], np.uint8(3), got)
        return out

    def windows(self, pick: np.ndarray):
        """The windows of some entries: (entry, place in its context, id, group) of
        each, and the groups of equal ones, (hashes, smallest id), in order of the
        first hash."""
        at = self.first[pick]
        n = np.maximum(0, self.stop[at] - self.start[at] - self.length + 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(self.start[at], n) + nth
        ids = np.repeat(self.e_id[pick], n)
        a, b = np.full(len(pos), _K[4]), np.full(len(pos), _K[7])
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            w = self.word[pos + k]
            a = (a ^ w) * _K[0]
            a ^= a >> _U(31)
            b = (b ^ w) * _K[3]
            b ^= b >> _U(29)
        by = np.lexsort((ids, b, a))
        new = np.ones(len(by), bool)
        new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        rep = by[new]
        return np.repeat(pick, n), nth, ids, group, a[rep], b[rep], ids[rep]

    @staticmethod
    def cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
        """Bounds of each part's slice of sorted hashes."""
        part = ((hashes >> _U(32)) * _U(parts)) >> _U(32)
        return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _blobs(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [{"kind": pa.int32(), "part": pa.int32(), "block": pa.int64()}.get(n, pa.binary()) for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _answers(cell) -> dict:
    out: dict = {}
    for x in cell or []:
        out.setdefault(x["kind"], {})[x["part"]] = x["data"]
    return out


def _bytes(batch: pa.RecordBatch, name: str) -> list:
    return [x.as_buffer().to_pybytes() for x in batch.column(name)]


def _gather(batches, names: list[str]):
    """All rows of a task: parts, blocks and the blobs of each name."""
    part, block, blobs = [], [], [[] for _ in names]
    for batch in batches:
        part += batch.column("part").to_pylist()
        block += batch.column("block").to_pylist()
        for out, name in zip(blobs, names):
            out += _bytes(batch, name)
    return part, block, blobs


def _answer_anchors(batches):
    part, block, (data,) = _gather(batches, ["a"])
    if not part:
        return
    size = np.array([len(x) // 8 for x in data])
    every = np.frombuffer(b"".join(data), np.uint64)
    by = np.argsort(every, kind="stable")
    same = every[by][1:] == every[by][:-1]
    again = np.zeros(len(every), bool)
    again[by[1:][same]] = True
    again[by[:-1][same]] = True
    ends = np.cumsum(size)
    rows = [(p, b, np.packbits(again[e - s : e]).tobytes()) for p, b, e, s in zip(part, block, ends, size) if again[e - s : e].any()]
    yield _blobs(rows, ["part", "block", "data"])


def _answer_contexts(hot_all: int):
    return lambda batches: _contexts(batches, hot_all)


def _contexts(batches, hot_all: int):
    """Status of each entry; an entry of id HOT_ID says that its anchor is hot."""
    part, block, blobs = _gather(batches, ["a", "b", "c", "d"])
    if not part:
        return
    size = np.array([len(x) // 8 for x in blobs[0]])
    h, c0, c1 = (np.frombuffer(b"".join(x), np.uint64) for x in blobs[:3])
    ids = np.frombuffer(b"".join(blobs[3]), np.int64)
    by = np.lexsort((ids, c1, c0, h))
    h, c0, c1, sid = h[by], c0[by], c1[by], ids[by]
    other = np.ones(len(by), bool)
    other[1:] = h[1:] != h[:-1]
    new = other.copy()
    new[1:] |= (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1])
    first = np.flatnonzero(new)
    low = np.repeat(sid[first], np.diff(np.append(first, len(by))))
    anchors = np.flatnonzero(other)
    width = np.diff(np.append(anchors, len(by)))
    count = np.add.reduceat(new.astype(np.int64), anchors)
    many = np.repeat(count > 1, width)
    hot = np.repeat((count > hot_all) | (np.minimum.reduceat(sid, anchors) == HOT_ID), width)
    status = np.empty(len(by), np.uint8)
    # A hot anchor's contexts are settled by their windows alone: of equal ones in two blocks too.
    status[by] = np.where(hot, 3, np.where(sid > low, 1, np.where(many, 2, 0)))
    ends = np.cumsum(size)
    rows = [(p, b, status[e - s : e].tobytes()) for p, b, e, s in zip(part, block, ends, size) if status[e - s : e].any()]
    yield _blobs(rows, ["part", "block", "data"])


def _slices(h: np.ndarray, lens: np.ndarray, size: int) -> list[np.ndarray]:
    """Entries in slices of about ``size`` bytes; equal hashes stay together."""
    by = np.argsort(h, kind="stable")
    cum = np.cumsum(lens[by])
    starts = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    want = np.searchsorted(cum, np.arange(size, int(cum[-1]), size))
    at = np.searchsorted(starts, want)
    return np.split(by, np.unique(starts[at[at < len(starts)]]))


def _suffix_masks(data: list, length: int, slice_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of covered windows of each entry, and the number of entries a row."""
    hashes, own_ids, sizes, bodies = data
    size = np.array([len(x) for x in sizes])
    h, ids = np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(own_ids), np.int64)
    lens = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64)
    body = np.frombuffer(b"".join(bodies), np.uint8)
    begin, mask = np.cumsum(lens) - lens, np.zeros(len(lens), np.uint64)
    for own in _slices(h, lens, slice_bytes) if len(lens) else ():  # a few sorts, each of little memory
        n = lens[own]
        at, windows = np.cumsum(n) - n, n - length + 1
        text = body[np.repeat(begin[own] - at, n) + np.arange(n.sum())].tobytes()
        first = np.cumsum(windows) - windows
        nth = np.arange(windows.sum()) - np.repeat(first, windows)
        hit = covered_windows(text, np.repeat(at, windows) + nth, np.repeat(ids[own], windows), length)
        mask[own] = np.add.reduceat(np.where(hit, _U(1) << nth.astype(np.uint64), _U(0)), first)
    return mask, size


def _window_bits(data: list) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: does an equal one have a smaller id?"""
    size = np.array([len(x) // 8 for x in data[0]])
    a, b, ids = (np.frombuffer(b"".join(x), t) for x, t in zip(data, (np.uint64, np.uint64, np.int64)))
    by = np.lexsort((ids, b, a))
    new = np.ones(len(by), bool)
    new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    first = np.flatnonzero(new)
    low = np.repeat(ids[by][first], np.diff(np.append(first, len(by))))
    out = np.zeros(len(by), bool)
    out[by] = ids[by] > low
    return out, size


def _answer_suffixes(length: int, slice_bytes: int = 1 << 20):
    """Rows of kind 2 are contexts of anchors, rows of kind 3 windows."""

    def run(batches):
        rows: dict[int, list] = {2: [[], [], [], [], [], []], 3: [[], [], [], [], [], []]}
        for batch in batches:
            blobs = [_bytes(batch, c) for c in "habc"]
            for i, (kind, part, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "block")))):
                for out, x in zip(rows[kind], (part, block, *(c[i] for c in blobs))):
                    out.append(x)
        for kind, (part, block, *data) in rows.items():
            if part:
                got, size = _suffix_masks(data, length, slice_bytes) if kind == 2 else _window_bits(data[:3])
                pack = (lambda x: x.tobytes()) if kind == 2 else (lambda x: np.packbits(x).tobytes())
                ends = np.cumsum(size)
                yield _blobs([(kind, p, b, pack(got[e - n : e])) for p, b, e, n in zip(part, block, ends, size) if got[e - n : e].any()], ["kind", "part", "block", "data"])

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False, block_bytes: int = BLOCK, hot: int = HOT, hot_all: int = HOT_ALL) -> DataFrame:
    """``docs`` with repeated bytes removed from ``text``, and n_bytes,
    n_removed, n_spans.  With ``digest`` the text is replaced by kept_sha256."""
    spark, gram = docs.sparkSession, GRAM
    if not SHALLOW + 8 <= length <= gram + 63:  # an anchor's windows fit a 64-bit mask
        raise ValueError(f"length must be {SHALLOW + 8} to {gram + 63}")
    parts = tune(spark)
    scratch = Scratch(spark, "suffix")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "__block")
    names = docs.columns
    at_text, at_key = names.index(text), names.index(key)

    def build(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column(at_text)
            size = [len(x.as_buffer()) if x.is_valid else 0 for x in column]
            begin = 0
            while begin < len(size):
                end, total = begin + 1, size[begin]
                while end < len(size) and total + size[end] <= block_bytes:
                    total += size[end]
                    end += 1
                part = batch.slice(begin, end - begin)
                body = b"".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(at_text))
                ends = np.cumsum(np.array(size[begin:end], np.int64))
                ids = np.array([NO_ID if x is None else x for x in part.column(at_key).to_pylist()], np.int64)
                rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != at_text], names=[f"c{i}" for i in range(len(names) - 1)])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_batch(rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | seq], pa.int64()), *(pa.array([x], pa.binary()) for x in (body, ids.tobytes(), ends.tobytes(), np.packbits(winnow(body, ends, length, gram)).tobytes(), sink.getvalue().to_pybytes()))],
                    names=["block", "body", "ids", "ends", "marks", "rest"],
                )
                seq += 1
                begin = end

    table = f"suffix_{uuid.uuid4().hex}"
    blocks = docs.mapInArrow(build, "block long, body binary, ids binary, ends binary, marks binary, rest binary")
    blocks.write.bucketBy(parts, "block").option("path", f"{scratch.root}/blocks").option("compression", "zstd").saveAsTable(table)

    def with_answers(columns: list[str], *answers: DataFrame) -> DataFrame:
        source = spark.table(table).select("block", *columns)
        every = None
        for kind, a in enumerate(answers):
            kind = F.col("kind") if "kind" in a.columns else F.lit(kind)
            a = a.select("block", F.struct(kind.alias("kind"), "part", "data").alias("x"))
            every = a if every is None else every.unionByName(a)
        every = every.groupBy("block").agg(F.collect_list("x").alias("answers")).hint("shuffle_hash")
        return source.join(every, "block", "left")

    base = ["body", "ids", "ends", "marks"]

    def opened(batches, answered: bool = True):
        for batch in batches:
            cells = batch.column("answers").to_pylist() if answered else [None] * batch.num_rows
            columns = [_bytes(batch, c) for c in base]
            for i, (name, cell) in enumerate(zip(batch.column("block").to_pylist(), cells)):
                yield batch, i, name, Block(*(c[i] for c in columns), length, gram), _answers(cell)

    def send_anchors(batches):
        for _, _, name, b, _ in opened(batches, False):
            cuts = Block.cuts(b.distinct, parts)
            yield _blobs([(p, name, b.distinct[lo:hi].tobytes()) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo], ["part", "block", "a"])

    def send_contexts(batches):
        for _, _, name, b, got in opened(batches):
            b.repeated(got, parts)
            own = b.sent(hot)
            cuts = Block.cuts(b.e_hash[own], parts)
            ids = np.where(b.hot[own], HOT_ID, b.e_id[own])
            yield _blobs([(p, name, *(x[lo:hi].tobytes() for x in (b.e_hash[own], *(c[own] for c in b.e_c), ids))) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo], ["part", "block", "a", "b", "c", "d"])

    def send_suffixes(batches):
        for _, _, name, b, got in opened(batches):
            b.repeated(got, parts)
            status = b.status(got, parts, hot)
            *_, w0, w1, low = b.windows(np.flatnonzero(status == 3))
            cuts = Block.cuts(w0, parts)
            rows = [(3, p, name, w0[lo:hi].tobytes(), w1[lo:hi].tobytes(), low[lo:hi].tobytes(), b"") for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
            pick = np.flatnonzero(status == 2)
            cuts = Block.cuts(b.e_hash[pick], parts)
            for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if hi > lo:
                    at = b.first[pick[lo:hi]]
                    text_ = b"".join(b.body[s:e] for s, e in zip(b.start[at].tolist(), b.stop[at].tolist()))
                    rows.append((2, p, name, b.e_hash[pick[lo:hi]].tobytes(), b.e_id[pick[lo:hi]].tobytes(), (b.stop - b.start)[at].astype(np.uint8).tobytes(), text_))
            yield _blobs(rows, ["kind", "part", "block", "h", "a", "b", "c"])

    def apply(batches):
        for batch, i, _, b, got in opened(batches):
            b.repeated(got, parts)
            status, body = b.status(got, parts, hot), np.frombuffer(b.body, np.uint8)
            delta = np.zeros(len(body) + 1, np.int32)
            gone = (b.ids[b.doc] > b.e_id[b.entry]) | (status[b.entry] == 1)
            np.add.at(delta, b.start[gone], 1)
            np.add.at(delta, b.stop[gone], -1)
            pick = np.flatnonzero(status == 2)
            mask, cuts = np.zeros(len(status), np.uint64), Block.cuts(b.e_hash[pick], parts)
            for part, data in got.get(2, {}).items():
                mask[pick[cuts[part] : cuts[part + 1]]] = np.frombuffer(data, np.uint64)
            entry, nth, ids, group, w0, _, low = b.windows(np.flatnonzero(status == 3))
            bits, cuts = np.zeros(len(w0), bool), Block.cuts(w0, parts)
            for part, data in got.get(3, {}).items():
                lo, hi = cuts[part], cuts[part + 1]
                bits[lo:hi] = np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo)
            if len(entry):
                hit = (ids > low[group]) | bits[group]
                np.bitwise_or.at(mask, entry[hit], _U(1) << nth[hit].astype(np.uint64))
            some = np.flatnonzero(mask[b.entry])  # every occurrence, those in one document too
            for o in range(length - gram + 1):
                s = b.start[some[(mask[b.entry[some]] >> _U(o) & _U(1)).astype(bool)]] + o
                np.add.at(delta, s, 1)
                np.add.at(delta, s + length, -1)
            out = np.cumsum(delta[:-1]) > 0
            edge = out.copy()
            edge[1:] &= ~out[:-1]
            edge[b.begins[b.begins < len(out)]] = out[b.begins[b.begins < len(out)]]
            n_out, n_edge = (np.concatenate([[0], np.cumsum(x)]) for x in (out, edge))
            kept = [body[s:e][~out[s:e]].tobytes() if n_out[e] > n_out[s] else b.body[s:e] for s, e in zip(b.begins.tolist(), b.ends.tolist())]
            rest = pa.ipc.open_stream(batch.column("rest")[i].as_buffer()).read_all().combine_chunks()
            rest = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rest.columns]
            text_ = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode("utf-8", "ignore") for k in kept]
            rest.insert(at_text, pa.array(text_, pa.string()))
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x.astype(np.int64)) for x in (b.ends - b.begins, n_out[b.ends] - n_out[b.begins], n_edge[b.ends] - n_edge[b.begins]))], names=schema.names)

    fields = [T.StructField("kept_sha256" if digest and f.name == text else f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))])
    reply = "part int, block long, data binary"
    sent = spark.table(table).select("block", *base).mapInArrow(send_anchors, "part int, block long, a binary")
    one = scratch.keep(sent.repartitionById(parts, F.col("part")).mapInArrow(_answer_anchors, reply))
    sent = with_answers(base, one).mapInArrow(send_contexts, "part int, block long, a binary, b binary, c binary, d binary")
    two = scratch.keep(sent.repartitionById(parts, F.col("part")).mapInArrow(_answer_contexts(hot_all), reply))
    sent = with_answers(base, one, two).mapInArrow(send_suffixes, "kind int, part int, block long, h binary, a binary, b binary, c binary")
    three = scratch.keep(sent.repartitionById(parts, F.col("part")).mapInArrow(_answer_suffixes(length), f"kind int, {reply}"))
    return with_answers([*base, "rest"], one, two, three).mapInArrow(apply, schema)


def brute(rows: list[tuple], length: int = LENGTH) -> dict:
    """(id, bytes) -> {id: (n_bytes, n_removed, n_spans, kept)}, by definition."""
    low: dict[bytes, int] = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            low[s] = min(low.get(s, i), i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if low[t[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out[i] = (len(t), int(gone.sum()), spans, bytes(c for c, g in zip(t, gone) if not g))
    return out
