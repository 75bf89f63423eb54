"""Skeletons: a file with its function bodies folded away.

minimal: the signature and ``{ ... }``, comments gone; standard: the first line
of each declaration in the body; detailed: the source as it is.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.scratch import deal
from .extract.braces import Source

LEVELS = ("minimal", "standard", "detailed")
_CONTROL = re.compile(r"^\s*(?:\}\s*)?(?:if|for|while|switch|catch|else|do|try|match|loop|with|return|finally)\b")
_BODY = {
    "typescript": re.compile(r"\bfunction\b|=>\s*$|\)\s*(?::[^=;]+)?$"),
    "rust": re.compile(r"\bfn\s+\w+|\bimpl\b"),
    "c": re.compile(r"\)\s*$"),
    "cpp": re.compile(r"\)\s*(?:(?:const|noexcept|override|final)\s*)*(?:->[^{;]+|:[^{;]+)?$|\bnamespace\b"),
}
_BODY["javascript"] = _BODY["typescript"]
_DECLARATION = {
    "typescript": re.compile(r"(?:export|async|function|class|interface|type|enum|const|let|var|abstract)\b|(?:public|private|protected|static|readonly|get|set)?\s*[\w$]+\s*\([^)]*\)\s*(?::[^{]+)?\{"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe)\s+)*(?:fn|struct|enum|trait|impl|type|const|static|use|mod)\b"),
    "c": re.compile(r"#\s*include|typedef\b|struct\b|enum\b|(?!return\b|goto\b|else\b|delete\b|throw\b)(?:const\s+|static\s+|unsigned\s+)*[A-Za-z_]\w*[\s*&]+\w+\s*(?:=|;|\[|,)"),
}
_DECLARATION["javascript"] = _DECLARATION["typescript"]
_DECLARATION["cpp"] = re.compile(_DECLARATION["c"].pattern + r"|class\b|template\b|namespace\b|using\b|[\w:<>~*& ]+\([^)]*\)[^;{]*\{")


def _fold(signature: str, stubs: list[str], level: str) -> str:
    if level == "minimal" or not stubs:
        return signature.rstrip() + " { ... }"
    return signature + "{\n" + "\n".join("    " + x for x in stubs) + "\n}"


def _assemble(source: str, folds: list[tuple[int, int, int, list[str]]], comments: list[tuple[int, int]], level: str) -> str:
    """``folds``: (signature start, body start, body end, stubs), outermost only."""
    out, at = [], 0
    drop = comments if level == "minimal" else []

    def plain(a: int, b: int) -> str:
        part, last = [], a
        for x, y in drop:
            if a <= x and y <= b:
                part.append(source[last:x])
                last = y
        return "".join(part) + source[last:b]

    for sig, start, end, stubs in folds:
        out.append(plain(at, sig))
        out.append(_fold(source[sig:start], stubs, level))
        at = end
    return "".join(out) + plain(at, len(source))


def _braces(source: str, language: str, level: str) -> str:
    s = Source(source, language)
    folds, last = [], -1
    for a, b in s.blocks:
        if a < last:
            continue
        begin = max(s.bare.rfind(c, 0, a) for c in ";{}") + 1
        head = s.bare[begin:a]
        if _CONTROL.match(head) or not _BODY[language].search(head.rstrip()):
            continue
        stubs, at = [], a + 1
        while at < b:
            if s.bare[at].isspace():
                at += 1
                continue
            m = _DECLARATION[language].match(s.bare, at, b)
            if m:
                stubs.append(source[at : source.find("\n", at) if "\n" in source[at:b] else b].rstrip())
            while at < b and s.bare[at] not in ";\n{":
                at = s.close.get(at, at) + 1 if s.bare[at] in "([" else at + 1
            at = s.close.get(at, at) + 1 if at < b and s.bare[at] == "{" else at + 1
        sig = begin + len(head) - len(head.lstrip())
        folds.append((sig, a, b + 1, stubs))
        last = b
    return _assemble(source, folds, s.comments, level)


def _python(source: str, level: str) -> str:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return source
    lines = source.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    place = lambda row, col: starts[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))
    folds: list[tuple[int, int, int, list[str]]] = []

    def walk(body: list) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                stubs = []
                for x in s.body:
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Assign, ast.AnnAssign, ast.Import, ast.ImportFrom)):
                        deco = getattr(x, "decorator_list", [])
                        row = deco[0].lineno if deco else x.lineno
                        stubs.append(lines[row - 1].strip())
                first = s.body[0]
                folds.append((place(s.lineno, s.col_offset), place(first.lineno, first.col_offset), place(s.end_lineno, s.end_col_offset), stubs))
            else:
                for name in ("body", "orelse", "finalbody"):
                    if isinstance(getattr(s, name, None), list):
                        walk(getattr(s, name))

    walk(tree.body)
    comments = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                comments.append((starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]))
    except (tokenize.TokenError, IndentationError):
        comments = []
    return _assemble(source, folds, comments, level)


def _html(source: str, level: str) -> str:
    out = re.sub(r"(?is)(<(script|style)\b[^>]*>)(.*?)(</\2\s*>)", lambda m: m[1] + (" { ... } " if m[3].strip() else m[3]) + m[4], source)
    return re.sub(r"(?s)<!--.*?-->", "", out) if level == "minimal" else out


def skeleton(source: str, language: str, level: str = "standard") -> str:
    """E40 for one file."""
    if level not in LEVELS:
        raise ValueError(level)
    if level == "detailed" or language == "dotenv":
        return source
    if language == "python":
        return _python(source, level)
    if language == "html":
        return _html(source, level)
    return _braces(source, language, level) if language in _BODY else source


def skeletons(files: DataFrame, levels=LEVELS) -> DataFrame:
    """(path, level, skeleton, tokens) of every file and level."""
    levels = list(levels)

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for level in levels:
                    text = skeleton(content or "", language, level)
                    rows.append((path, level, text, -(-len(text.encode()) // 3)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "level", "skeleton", "tokens"])

    return deal(files.select("path", "language", "content")).mapInArrow(run, "path string, level string, skeleton string, tokens long")
