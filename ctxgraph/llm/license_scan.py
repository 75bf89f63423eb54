"""License scan over a positional rare-token index; DataFrame functions only.

A template is a word sequence with a label and mandatory key phrases.  The
index holds, for the highest-IDF words of each template (IDF over the
templates), their postings (template, position).  A file's occurrences of those
words are looked up, each posting gives the offset at which the template would
lie, offsets that enough rare words agree on are compared word by word, and a
label stands if the coverage reaches ``min_cover`` and every key phrase is
there in full.  The plan is a projection: no shuffle, no join, no Python.

Defined results: null or empty text has no words and no labels; other columns
of the input pass through ``scan`` untouched unless they bear one of its output
names, which are replaced; repeated rows are scored one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing: for counting only.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, template, mandatory key phrases); short notices of public licences.
TEMPLATES = (
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("licensed under cc by nc 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("licensed under cc by sa 4",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("licensed under cc by 4",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)
RARE, MIN_RARE, MIN_COVER = 3, 2, 0.8
_SHIFT = 1 << 40


def index(templates=TEMPLATES, rare: int = RARE) -> list[tuple[str, int, int]]:
    """Postings (word, template number, position) of each template's ``rare``
    words of highest IDF; ties go to the longer, then the earlier word."""
    words = [t.split() for _, t, _ in templates]
    df: dict[str, int] = {}
    for ws in words:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = []
    for t, ws in enumerate(words):
        first = {w: i for i, w in reversed(list(enumerate(ws)))}
        best = sorted(first, key=lambda w: (-math.log(len(words) / df[w]), -len(w), first[w]))[:rare]
        out += [(w, t, i) for i, w in enumerate(ws) if w in best]
    return out


def key_positions(template: str, phrases) -> list[int]:
    """Positions of a template that its key phrases cover."""
    ws, need = template.split(), set()
    for p in phrases:
        ps = p.split()
        at = next(i for i in range(len(ws)) if ws[i : i + len(ps)] == ps)
        need |= set(range(at, at + len(ps)))
    return sorted(need)


def gates(templates=TEMPLATES, base=BASE) -> list[str]:
    """Words of which a text has one if any template or base phrase can stand:
    the longest mandatory word of each, without those that hold another."""
    longest = {max((t.split()[i] for i in key_positions(t, p)), key=len) for _, t, p in templates} | {max(p.split(), key=len) for p, _ in base}
    return sorted(w for w in longest if not any(v != w and v in w for v in longest))


def _candidates(words: Column, postings, need: dict[int, int]) -> Column:
    """Distinct template * 2**40 + offset (shifted by 2**20) that at least
    ``need[template]`` rare words agree on."""
    by_word: dict[str, list[tuple[int, int]]] = {}
    for w, t, q in postings:
        by_word.setdefault(w, []).append((t, q))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda x: x["w"].isin(list(by_word)))

    def place(x: Column) -> Column:
        out = F.array().cast("array<bigint>")
        for w, tq in by_word.items():
            keys = F.array(*[F.lit(t * _SHIFT + (1 << 20) - q) + x["i"] for t, q in tq])
            out = F.when(x["w"] == w, keys).otherwise(out)
        return out

    # Sorted, equal keys lie side by side: key k agrees n times if the key n-1 places on is k too.
    keys = F.array_sort(F.flatten(F.transform(hits, place)))

    def agree(k: Column, i: Column) -> Column:
        far = F.lit(max(need.values()) - 1)
        for t, n in need.items():
            far = F.when(F.shiftright(k, 40) == t, F.lit(n - 1)).otherwise(far)
        return F.get(keys, (i + far).cast("int")) == k

    return F.array_distinct(F.filter(keys, agree))


def _phrase_starts(words: Column, phrase: list[str]) -> Column:
    """All places where the phrase's words stand consecutively."""
    back = len(phrase) - 1

    def stands(i: Column) -> Column:
        ok = i >= 0
        for j, w in enumerate(phrase[:-1]):
            ok = ok & (F.get(words, F.greatest(i + j, F.lit(0)).cast("int")) == w)
        return ok

    ends = F.transform(words, lambda w, i: F.when(w == phrase[-1], i.cast("long") - back))
    return F.filter(ends, stands)


def _verify(words: Column, number: int, label: str, template: str, must: set[int]):
    """A candidate's (label, cover) if the template's key words all match."""
    ws = template.split()

    def verified(c: Column) -> Column:
        off = c - F.lit(number * _SHIFT + (1 << 20))

        def same(j: int) -> Column:
            at = F.get(words, F.greatest(off + j, F.lit(-1)).cast("int"))
            return F.coalesce(at == ws[j], F.lit(False))

        n = sum((same(j).cast("int") for j in range(1, len(ws))), same(0).cast("int"))
        ok = F.lit(True)
        for j in sorted(must):
            ok = ok & same(j)
        return F.when(ok, F.struct(F.lit(label).alias("label"), F.round(n / F.lit(float(len(ws))), 6).alias("cover")))

    return verified


def _is_template(number: int):
    return lambda c: F.shiftright(c, 40) == number


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, base=BASE, rare: int = RARE, min_rare: int = MIN_RARE, min_cover: float = MIN_COVER) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels
    and score (the best coverage of a verified template, 1.0 for a base phrase,
    else 0.0)."""
    postings = index(templates, rare)
    need = {t: min(min_rare, sum(1 for p in postings if p[1] == t)) for t in range(len(templates))}
    raw = F.coalesce(F.col(text), F.lit(""))
    # Only texts that hold a gate word are split into words; lower() may match more, never less.
    gate = F.lit(False)
    for g in gates(templates, base):
        gate = gate | F.col("__low").contains(g)
    words = F.when(gate, F.regexp_extract_all(lower_ascii(raw), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    own = [c for c in df.columns if c not in {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}]
    df = df.withColumn("__low", F.lower(raw))  # a step of its own: lowered once, not once a gate
    df = df.select(*[F.col(f"`{c}`") for c in own], F.regexp_count(raw, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), words.alias("__w"))

    w = F.col("__w")
    starts, names = [], []
    for phrase, label in base:
        ps = phrase.split()
        starts.append(F.struct(F.lit(label).alias("label"), _phrase_starts(w, ps).alias("at")))
        names.append(label)
    df = df.withColumn("__base", F.array(*starts)).withColumn("__cand", _candidates(w, postings, need))

    for t, (label, template, phrases) in reversed(list(enumerate(templates))):
        own_keys = F.filter("__cand", _is_template(t))
        checked = F.transform(own_keys, _verify(w, t, label, template, set(key_positions(template, phrases))))
        df = df.withColumn(f"__t{t}", F.filter(checked, lambda x: x["cover"] >= min_cover))
    found = F.flatten(F.array(*[F.col(f"__t{t}") for t in range(len(templates))]))
    df = df.withColumn("__found", found)
    all_at = F.flatten(F.transform("__base", lambda b: b["at"]))
    base_labels = F.transform(F.filter("__base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    return df.select(
        *[F.col(f"`{c}`") for c in own], "n_words",
        F.size(all_at).cast("long").alias("n_base"),
        F.array_min(all_at).alias("first_word"), F.array_max(all_at).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("__found", lambda x: x["label"])))), ",").alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__found", lambda x: x["cover"])), F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, base=BASE, rare: int = RARE, min_rare: int = MIN_RARE, min_cover: float = MIN_COVER) -> str:
    """The same scan of ``documents`` in DuckDB SQL, by joins over all words."""
    postings = index(templates, rare)
    need = {t: min(min_rare, sum(1 for p in postings if p[1] == t)) for t in range(len(templates))}
    vals = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    tw, tmpl = [], []
    for t, (label, text, phrases) in enumerate(templates):
        must = set(key_positions(text, phrases))
        ws = text.split()
        tw += [(t, j, w, int(j in must)) for j, w in enumerate(ws)]
        tmpl.append((t, label, len(ws), len(must), need[t]))
    bw = [(label, k, j, w) for k, (p, label) in enumerate(base) for j, w in enumerate(p.split())]
    bl = [(k, len(p.split())) for k, (p, _) in enumerate(base)]
    return f"""
WITH words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents)),
bw(label, k, j, w) AS (VALUES {vals(bw)}), bl(k, n) AS (VALUES {vals(bl)}),
basehit AS (SELECT x.doc_id, bw.label, x.i - bw.j AS s FROM words x JOIN bw USING (w) JOIN bl USING (k)
  GROUP BY x.doc_id, bw.label, bw.k, x.i - bw.j, bl.n HAVING count(*) = bl.n),
post(w, t, q) AS (VALUES {vals(postings)}),
tw(t, j, w, must) AS (VALUES {vals(tw)}),
tmpl(t, label, n, n_must, need) AS (VALUES {vals(tmpl)}),
cand AS (SELECT x.doc_id, p.t, x.i - p.q AS off FROM words x JOIN post p USING (w) GROUP BY 1, 2, 3
  HAVING count(*) >= (SELECT need FROM tmpl WHERE tmpl.t = p.t)),
found AS (SELECT c.doc_id, m.label, round(count(*) / CAST(m.n AS DOUBLE), 6) AS cover
  FROM cand c JOIN tmpl m USING (t) JOIN tw USING (t) JOIN words x ON x.doc_id = c.doc_id AND x.i = c.off + tw.j AND x.w = tw.w
  GROUP BY c.doc_id, c.t, c.off, m.label, m.n, m.n_must HAVING sum(must) = m.n_must AND round(count(*) / CAST(m.n AS DOUBLE), 6) >= {min_cover}),
nw AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM basehit GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM basehit UNION ALL SELECT doc_id, label FROM found) GROUP BY 1),
f AS (SELECT doc_id, max(cover) AS cover FROM found GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(nw.n, 0) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
  CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(f.cover, 0.0) END AS score
FROM documents d LEFT JOIN nw USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id)
"""
