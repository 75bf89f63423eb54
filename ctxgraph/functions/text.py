"""Text functions: identifier tokenizers, query parsing, trigrams, headlines.

What applies to a column is a Column expression (whole-stage codegen or
higher-order functions, no Python worker); what applies to one query string is
plain Python on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query leaves out.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall to "
    "of in for on with at by from it this that these those i me my we our you your he she they them what which "
    "who when where why how not no nor and or but if then"
).split()
# Words about code in general.
CODE_STOP_WORDS = (
    "implementation function method class struct code file module type interface trait find show get search look where works work use used using codebase project repository"
).split()
# Capitalised words that are no symbols.
COMMON_WORDS = (
    "The This That These Those When Where Which What With Without About After Before Between During From Into Through Under Until Upon Also Both Each Every "
    "Some None Many Much Most Other Such Than Then Only Just Even Still Already Always Never Often Sometimes However Therefore Because Although Whether While "
    "Since Though Unless Once Here There Note Todo Fixme Hack Warning Error"
).split()
# Keywords of each intent, found anywhere in the lower-cased query.
DEBUG_WORDS = ["bug", "fix", "error", "crash", "fail", "broken", "issue", "debug", "wrong", "undefined", "null", "exception", "panic", "stack trace", "backtrace", "not working"]
BLAST_WORDS = ["impact", "affect", "depend", "change", "refactor", "rename", "delete", "remove", "deprecate", "breaking", "blast radius", "who uses", "what calls", "what depends"]
MODIFY_WORDS = ["add", "implement", "create", "update", "modify", "extend", "feature", "enhancement", "new", "build", "write", "change"]
# Weights (bm25, overlap, centrality, confidence) of each intent.
INTENT_WEIGHTS = {"debug": (0.45, 0.25, 0.15, 0.15), "blast_radius": (0.15, 0.15, 0.45, 0.25), "modify": (0.30, 0.30, 0.20, 0.20), "explore": (0.30, 0.30, 0.25, 0.15)}

CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


# Columns


def _pieces(c: Column, separators: str) -> Column:
    """Lower-case parts of identifiers: cut at separators and camel humps."""
    cut = F.regexp_replace(F.regexp_replace(c, separators, " "), CAMEL, " ")
    return F.filter(F.split(F.lower(cut), r"\s+"), lambda w: w != "")


def tokenize_identifier(c: Column) -> Column:
    """Index side (X01): parts joined by spaces, then the whole name in lower
    case unless the joined parts contain it; the name itself if it has no part."""
    low, cut = F.lower(c), F.regexp_replace(F.regexp_replace(c, r"[:.\-/_]+", "\x01"), CAMEL, "\x01")
    joined = F.array_join(F.filter(F.split(F.lower(cut), "\x01"), lambda w: w != ""), " ")
    return F.when(joined == "", low).when(F.contains(joined, low), joined).otherwise(F.concat_ws(" ", joined, low))


def score_words(c: Column) -> Column:
    """Scoring side (X05): parts of two bytes or more, as an array."""
    return F.filter(_pieces(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 1)


def index_words(c: Column) -> Column:
    """Terms of the inverted index: runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def contains_any(c: Column, words: list[str]) -> Column:
    """How many of the words the column contains."""
    low = F.lower(c)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int"))


def detect_intent(c: Column) -> Column:
    """Most keywords wins, ties modify, debug, blast_radius; none: explore."""
    d, b, m = (F.coalesce(contains_any(c, w), F.lit(0)) for w in (DEBUG_WORDS, BLAST_WORDS, MODIFY_WORDS))
    top = F.greatest(d, b, m)
    return F.when(top == 0, "explore").when(m == top, "modify").when(d == top, "debug").otherwise("blast_radius")


def overlap_score(query: str, name: Column, signature: Column) -> Column:
    """2 for a query word among the name's parts, 1 among the signature's."""
    terms = [w for w in query.lower().split() if len(w.encode()) > 1 and w not in STOP_WORDS]
    if not terms:
        return F.lit(0.0)
    n, s = score_words(name), score_words(signature)
    hits = sum((F.array_contains(n, t).cast("int") * 2 + F.array_contains(s, t).cast("int") for t in terms), F.lit(0))
    return F.least(hits / F.lit(3.0 * len(terms)), F.lit(1.0))


def path_bonus(query: str, path: Column) -> Column:
    """Share of the query's content words that the path holds."""
    terms = content_words(query)
    if not terms:
        return F.lit(0.0)
    low = F.lower(path)  # a part of the path is also a substring of it
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: the variable of a lambda
    holds it, where a plain column would be computed for each element of an
    array that the body walks over."""
    return F.transform(F.array(value), body)[0]


def trigrams(c: Column) -> Column:
    """Distinct character triples of the lower-cased text; the text itself
    if it is shorter.  One pass: a substring would count from the start again."""
    def triples(chars: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(chars) - 2), lambda i: F.concat(F.get(chars, i - 1), F.get(chars, i), F.get(chars, i + 1)))
        return F.when(F.size(chars) < 3, F.array(F.array_join(chars, ""))).otherwise(F.array_distinct(each))

    return _let(F.split(F.lower(F.coalesce(c, F.lit(""))), ""), triples)


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike."""
    def share(pair: Column) -> Column:
        union = F.size(F.array_union(pair[0], pair[1]))
        return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(pair[0], pair[1])) / union)

    return _let(F.array(a, b), share)


def headline(c: Column, most: int = 80) -> Column:
    """The first line, cut to ``most`` characters with dots."""
    return _cut(F.substring_index(F.coalesce(c, F.lit("")), "\n", 1), most)


def summary(c: Column, most: int = 200) -> Column:
    return _cut(F.coalesce(c, F.lit("")), most)


def _cut(c: Column, most: int) -> Column:
    """By characters; for ASCII that is by bytes."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def symbol_candidates(c: Column) -> Column:
    """Words of prose that look like symbols, in order, once each."""
    words = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\s,()\[\]{}]+"), lambda w: F.regexp_replace(w, r"""^["'`.:;]+|["'`.:;]+$""", ""))
    pascal = lambda w: w.rlike(r"^\p{Lu}[\p{L}\p{N}_]*$") & w.rlike(r"\p{Ll}")
    joined = lambda w: w.rlike(r"^[\p{L}\p{N}_:]+$") & w.rlike("_|::")
    looks = lambda w: (F.octet_length(w) >= 3) & (pascal(w) | joined(w)) & ~w.isin(COMMON_WORDS)
    return F.array_distinct(F.filter(words, looks))


def token_estimate(c: Column) -> Column:
    """A third of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(c, F.lit(""))) / 3.0).cast("long")


def token_count(c: Column) -> Column:
    """X18 without a vocabulary: a quarter of the bytes."""
    return F.floor(F.octet_length(F.coalesce(c, F.lit(""))) / 4.0).cast("long")


def import_matches(import_path: Column, file_path: Column) -> Column:
    """The file's path without its extension ends in the import path."""
    bare = import_bare(import_path)
    return (bare != "") & F.coalesce(F.endswith(path_stem(file_path), bare), F.lit(False))


def import_bare(import_path: Column) -> Column:
    """The import path without "./" in front; empty for null."""
    return F.regexp_replace(F.coalesce(import_path, F.lit("")), r"^(\./)+", "")


def path_stem(file_path: Column) -> Column:
    return F.regexp_replace(file_path, r"\.[^./]*$", "")


def recency(age_days: Column) -> Column:
    """Halves every week."""
    return F.pow(F.lit(2.0), -age_days / 7.0)


def staleness_penalty(is_stale: Column, reason: Column) -> Column:
    """X13."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(~F.coalesce(is_stale, F.lit(False)), 1.0).when(F.contains(low, F.lit("consolidated")), 0.3).when(F.contains(low, F.lit("linked file changed")), 0.5).otherwise(0.4)


def lines(content: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 1."""
    every = F.split(content, "\n")
    top = F.greatest(first, F.lit(1))
    count = F.least(last, F.size(every).cast("long")) - top + 1
    return F.when(count > 0, F.array_join(F.slice(every, top.cast("int"), F.greatest(count, F.lit(1)).cast("int")), "\n")).otherwise("")


# One query string


def split_camel(word: str) -> list[str]:
    out, last = [], 0
    for i in range(1, len(word)):
        a, b = word[i - 1], word[i]
        if (a.islower() and b.isupper()) or (a.isupper() and b.isupper() and word[i + 1 : i + 2].islower()):
            out.append(word[last:i])
            last = i
    return [*out, word[last:]] if word else []


def content_words(query: str) -> list[str]:
    """Lower-case words in neither list, two bytes or more."""
    return [w for w in query.lower().split() if len(w.encode()) > 1 and w not in STOP_WORDS and w not in CODE_STOP_WORDS]


@dataclass(frozen=True)
class Query:
    """Groups joined by OR; the terms of a group must all be there."""

    groups: tuple[tuple[str, ...], ...]

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(t for g in self.groups for t in g))


def _word_terms(word: str) -> list[str]:
    out: list[str] = []
    for piece in re.split(r"[-/:._]", word):
        clean = "".join(ch for ch in piece if ch.isalnum())
        for part in split_camel(clean):
            low = part.lower()
            if len(low.encode()) > 1 and low not in STOP_WORDS and low not in CODE_STOP_WORDS and low not in out:
                out.append(low)
    return out


def _bare(query: str) -> tuple[tuple[str, ...], ...]:
    words = "".join(ch for ch in query if ch.isalnum() or ch.isspace() or ch == "_").lower().replace("_", " ").split()
    return (tuple(words),) if words else ()


def parse_or(query: str) -> Query:
    """A word's parts belong together, words are alternatives; if nothing
    is left, all words of the bare query are wanted."""
    groups = tuple(tuple(t) for t in map(_word_terms, query.split()) if t)
    return Query(groups or _bare(query))


def parse_and(query: str) -> Query:
    """All parts of all words are wanted."""
    terms = tuple(dict.fromkeys(t for w in query.split() for t in _word_terms(w)))
    return Query((terms,) if terms else _bare(query))


def intent_of(query: str) -> str:
    """detect_intent for one string."""
    low = query.lower()
    d, b, m = (sum(w in low for w in words) for words in (DEBUG_WORDS, BLAST_WORDS, MODIFY_WORDS))
    top = max(d, b, m)
    return "explore" if not top else "modify" if m == top else "debug" if d == top else "blast_radius"


def tokenize_query(query: str) -> str:
    """The index tokenizer for each word of a query."""
    out = []
    for word in query.split():
        parts = [p.lower() for piece in re.split(r"[:.\-/_]", word) for p in split_camel(piece)]
        joined, low = " ".join(parts), word.lower()
        text = low if not parts else joined if low in joined else f"{joined} {low}"
        out.append("".join(ch for ch in text if ch.isalnum() or ch.isspace() or ch == "_"))
    return " ".join(w for w in out if w)
