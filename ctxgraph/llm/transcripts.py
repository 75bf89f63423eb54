"""Transcript parsing: a hidden Markov model recovers who says each line.

A transcript comes as rows (key, order, text): chunks, each of one line or more.
A line shows a speaker marker of some style or none, its length, whether it
opens its chunk, and how many lines the chunk has.  The states are
{system, user, assistant} x {opens a turn, goes on}; Viterbi finds the best
sequence of a whole conversation, which is then cut into turns and rendered in
one canonical form.

A conversation may be as long as it likes.  Lines are range-partitioned by
(key, order), so one long conversation lies over many tasks; each task reduces
the conversations that cross its borders to a max-plus matrix (best score from
each state before to each state at the end), the driver chains those matrices
(two a task, of states x states numbers) and each task decodes its part between
known end states.  The result is the exact Viterbi path.

Parameters are counts over all labelled rows, smoothed by one.

Defined results: null text is one empty line; a null key is a conversation of
its own, null orders come first; rows equal in key and order follow the hash of
their text; extra columns are not kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, tune

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in range(3) for b in (1, 0)]  # role, opens a turn
#: Speaker names of common transcript styles.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "customer", "q", "question", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "model", "gpt"),
}
_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
_MARK = re.compile(r"\s*(?:<\|(\w{1,16})\|>|\[(\w{1,16})\]|#{1,4}\s*(\w{1,16}):?(?=\s|$)|\**(\w{1,16})\**\s*[:>](?=\s|$)\**)\s*")
#: Number of values of each line feature: marker, opens its chunk, length, lines of the chunk.
SIZES = (5, 2, 5, 3)


def marker(line: str) -> tuple[int, int]:
    """(0 none, 1 to 3 a role's name, 4 another name), and the marker's length."""
    m = _MARK.match(line)
    if not m:
        return 0, 0
    name = next(g for g in m.groups() if g is not None).lower()
    return (_ROLE_OF[name] + 1, m.end()) if name in _ROLE_OF else (4, 0)


def observe(text: str | None) -> list[tuple[int, int, int, int]]:
    """The features of each line of a chunk."""
    lines = (text or "").split("\n")
    many = 0 if len(lines) == 1 else 1 if len(lines) < 4 else 2
    return [(marker(x)[0], int(i == 0), sum(len(x) > k for k in (0, 60, 200, 600)), many) for i, x in enumerate(lines)]


def transcribe(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", bare: int = 3) -> DataFrame:
    """Transcripts in mixed styles from turns whose roles are known: a style per
    conversation; ``bare`` in ten turns, chosen by a hash, have no marker."""
    h = lambda *c: F.crc32(F.concat_ws(":", *c).cast("binary"))
    k, o = F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(order).cast("string"), F.lit(""))
    name = F.coalesce(F.col(role), F.lit("user"))
    pick = lambda i: F.when(name == "assistant", NAMES["assistant"][i]).when(name == "system", NAMES["system"][i]).otherwise(NAMES["user"][i])
    style = h(F.lit("style"), k) % 4
    mark = F.when(style == 0, F.concat(F.initcap(pick(0)), F.lit(": "))).when(style == 1, F.concat(F.lit("<|"), pick(0), F.lit("|> ")))
    mark = mark.when(style == 2, F.concat(F.lit("### "), F.initcap(pick(1)), F.lit(" "))).otherwise(F.concat(F.lit("["), F.upper(pick(2)), F.lit("] ")))
    marked = F.concat(F.when(h(F.lit("bare"), k, o) % 10 < bare, F.lit("")).otherwise(mark), F.coalesce(F.col(text), F.lit("")))
    return turns.select(key, order, role, marked.alias(text))


class Model:
    """Log-probabilities of first states, of transitions and of features."""

    def __init__(self, first: np.ndarray, step: np.ndarray, features: list[np.ndarray]):
        log = lambda x: np.log((x + 1.0) / (x + 1.0).sum(-1, keepdims=True))
        self.first, self.step, self.features = log(first), log(step), [log(f) for f in features]

    def emit(self, rows: list[tuple]) -> np.ndarray:
        x = np.array(rows, np.int64).reshape(-1, len(SIZES))
        return sum(f[:, x[:, i]].T for i, f in enumerate(self.features))


def viterbi(emit: np.ndarray, model: Model, before: int | None, after: int | None) -> list[int]:
    """The best states of a run of lines: after state ``before`` (None: the
    conversation begins), ending in ``after`` (None: in any)."""
    v = emit[0] + (model.first if before is None else model.step[before])
    back = []
    for e in emit[1:]:
        way = v[:, None] + model.step
        back.append(way.argmax(0))
        v = way.max(0) + e
    path = [int(v.argmax()) if after is None else after]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def transfer(emit: np.ndarray, model: Model) -> np.ndarray:
    """Best scores from each state before the run (the last row: from the
    conversation's beginning) to each state at its end."""
    m = np.vstack([model.step, model.first]) + emit[0]
    for e in emit[1:]:
        m = (m[:, :, None] + model.step[None]).max(1) + e
    return m


def _ordered(chunks: DataFrame, key: str, order: str, scratch: Scratch) -> DataFrame:
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, order, "__h"]
    chunks = chunks.withColumn("__h", F.xxhash64("__t")).repartitionByRange(n, *by).sortWithinPartitions(*by)
    return scratch.keep(chunks.withColumn("__row", F.monotonically_increasing_id()))


def _parts(rows: list[int], seen: dict[int, int]) -> list[int]:
    """Of each row the part it belongs to, named by the part's first row in this
    task: a file that is read by two tasks makes two parts, in order."""
    return [seen.setdefault(r >> 33, r) for r in rows]


def _runs(keys: list) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def fit(labelled: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over all rows whose role is one of ROLES."""
    spark = labelled.sparkSession
    tune(spark)
    scratch = Scratch(spark, "hmm")
    rows = labelled.where(F.col(role).isin(*ROLES)).select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.col(role).alias("__r"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = _ordered(rows, "__k", "__o", scratch)

    def count(batches):
        seen: dict[tuple, int] = {}
        add = lambda *k: seen.__setitem__(k, seen.get(k, 0) + 1)
        last: dict[int, tuple] = {}
        ends = []  # (part, key, role) of the first and the last row of each part
        named: dict[int, int] = {}
        for batch in batches:
            for k, r, t, p in zip(*(batch.column(c).to_pylist() for c in ("__k", "__r", "__t")), _parts(batch.column("__row").to_pylist(), named)):
                r = ROLES.index(r)
                if p not in last:
                    ends.append((p, 0, k, r))
                elif last[p][0] == k:
                    add("step", last[p][1], 2 * r)
                else:
                    add("first", 2 * r, 0)
                feats = observe(t)
                for i, f in enumerate(feats):
                    s = 2 * r + (i > 0)
                    if i:
                        add("step", 2 * r + (i > 1), s)
                    for j, x in enumerate(f):
                        add(f"f{j}", s, x)
                    if i == 0:  # a turn may as well begin within a chunk
                        add("f1", s, 0)
                last[p] = (k, 2 * r + (len(feats) > 1))
        ends += [(p, 1, k, s) for p, (k, s) in last.items()]
        out = [(n, a, b, c, None) for (n, a, b), c in seen.items()] + [("end", p, side, s, None if k is None else str(k)) for p, side, k, s in ends]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["what", "a", "b", "n", "k"])

    got = rows.mapInArrow(count, "what string, a long, b long, n long, k string")
    got = got.groupBy("what", "a", "b", "k").agg(F.sum("n").alias("n")).collect()  # features x states, and two rows a task
    first, step, feats = np.zeros(6), np.zeros((6, 6)), [np.zeros((6, n)) for n in SIZES]
    ends: dict[int, dict] = {}
    for r in got:
        if r["what"] == "step":
            step[r["a"], r["b"]] += r["n"]
        elif r["what"] == "first":
            first[r["a"]] += r["n"]
        elif r["what"] == "end":
            ends.setdefault(r["a"], {})[r["b"]] = (r["k"], r["n"])
        else:
            feats[int(r["what"][1:])][r["a"], r["b"]] += r["n"]
    before = None
    for p in sorted(ends):
        k, r = ends[p][0]
        if before is not None and before[0] == k:
            step[before[1], 2 * r] += 1
        else:
            first[2 * r] += 1
        before = ends[p][1]
    return Model(first, step, feats)


def chain(parts: list[tuple], model: Model) -> dict[int, dict]:
    """End states at the borders between parts.

    ``parts``: (part, first key, its matrix, last key, its matrix), in order;
    of a part with one conversation both are the same."""
    bounds: dict[int, dict] = {p[0]: {} for p in parts}
    i = 0
    while i < len(parts):
        # The conversation that ends part i and goes on in the next parts.
        j = i
        while j + 1 < len(parts) and parts[j + 1][1] == parts[i][3]:
            j += 1
            if parts[j][3] != parts[i][3]:
                break
        if j > i:
            pieces = [parts[i][4], *(parts[x][2] for x in range(i + 1, j + 1))]
            v, back = pieces[0][6], []
            for m in pieces[1:]:
                way = v[:, None] + m[:6]
                back.append(way.argmax(0))
                v = way.max(0)
            path = [int(v.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
            for x, part in enumerate(range(i, j + 1)):
                side = "last" if x == 0 else "first"
                bounds[parts[part][0]][side] = (path[x - 1] if x else None, path[x])
        i = max(j, i + 1)
    return bounds


def parse(chunks: DataFrame, model: Model, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """A row per piece: key, order, segment (in the chunk), role, starts (opens
    a turn), marker (its line has one), text (without the marker) and rendered."""
    spark = chunks.sparkSession
    tune(spark)
    scratch = Scratch(spark, "viterbi")
    kinds = [chunks.schema[key].dataType, chunks.schema[order].dataType]
    rows = chunks.select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = _ordered(rows, "__k", "__o", scratch)
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(order, kinds[1]), T.StructField("segment", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("starts", T.BooleanType()), T.StructField("marker", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("rendered", T.StringType())])

    def conversations(batches):
        """(part, key, batches' rows) of each run of a key, whole in its task
        except for what the run's length forces into memory: one conversation's
        part of one task."""
        held, at = [], None
        named: dict[int, int] = {}
        for batch in batches:
            cols = [_parts(batch.column("__row").to_pylist(), named), *(batch.column(c).to_pylist() for c in ("__k", "__o", "__t"))]
            for a, b in _runs(list(zip(cols[0], cols[1]))):
                here = (cols[0][a], cols[1][a])
                if held and here != at:
                    yield at[0], at[1], held
                    held = []
                at = here
                held += list(zip(cols[2][a:b], cols[3][a:b]))
        if held:
            yield at[0], at[1], held

    def borders(batches):
        first: dict[int, tuple] = {}
        last: dict[int, tuple] = {}
        held = None

        def close():
            part, k, chunks_ = held
            if part not in first or part in waiting:
                m = transfer(model.emit([f for _, t in chunks_ for f in observe(t)]), model)
                first.setdefault(part, (k, m))
                last[part] = (k, m)

        waiting: set[int] = set()
        for now in conversations(batches):
            if held is not None:
                if now[0] != held[0]:
                    waiting.add(held[0])  # the part's last run
                close()
            held = now
        if held is not None:
            waiting.add(held[0])
            close()
        out = [(p, s, None if k is None else str(k), m.tobytes()) for s, d in ((0, first), (1, last)) for p, (k, m) in d.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["part", "side", "k", "m"])

    got: dict[int, dict] = {}
    for r in rows.mapInArrow(borders, "part long, side long, k string, m binary").collect():  # two matrices a part
        got.setdefault(r["part"], {})[r["side"]] = (r["k"], np.frombuffer(bytes(r["m"])).reshape(7, 6))
    bounds = chain([(p, *got[p][0], *got[p][1]) for p in sorted(got)], model)
    edges = {p: (got[p][0][0], got[p][1][0]) for p in got}

    def decode(batches):
        out: list[tuple] = []
        seen: set[int] = set()

        def flush():
            nonlocal out
            kinds_ = [pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in out]) for i in (0, 1)] + [pa.array([r[i + 2] for r in out], t) for i, t in enumerate(kinds_)]
            batch = pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(cols, [*key_types, *kinds_])], names=schema.names)
            out = []
            return batch

        for part, k, chunks_ in conversations(batches):
            name = None if k is None else str(k)
            own = bounds[part]
            before = after = None
            if part not in seen and "first" in own and name == edges[part][0]:
                before, after = own["first"]
            elif "last" in own and name == edges[part][1]:
                before, after = own["last"]
            seen.add(part)
            feats = [observe(t) for _, t in chunks_]
            path = iter(viterbi(model.emit([f for fs in feats for f in fs]), model, before, after))
            for o, t in chunks_:
                pieces: list[list] = []
                for line in t.split("\n"):
                    role, opens = STATES[next(path)]
                    kind, cut = marker(line)
                    if not pieces or opens or role != pieces[-1][0]:
                        pieces.append([role, bool(opens), 0 < kind < 4, []])
                    pieces[-1][3].append(line[cut:] if opens and 0 < kind < 4 else line)
                for s, (role, opens, marked, lines) in enumerate(pieces):
                    body = "\n".join(lines)
                    out.append((k, o, s, ROLES[role], opens, marked, body, render(ROLES[role], opens, body)))
            if len(out) > 2000:
                yield flush()
        yield flush()

    key_types = [f.type for f in pa.schema([pa.field(str(i), _arrow(t)) for i, t in enumerate(kinds)])]
    return rows.mapInArrow(decode, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def render(role: str, opens: bool, body: str) -> str:
    """Canonical form: a header line per turn; lines of the text that look like
    one are escaped by a backslash."""
    body = re.sub(r"(?m)^(\\*<\|(?:system|user|assistant)\|>)$", r"\\\1", body)
    return f"<|{role}|>\n{body}" if opens else body


def in_training(c: Column) -> Column:
    """Rows that the model is fitted on in the query: four in five keys."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 != 0
