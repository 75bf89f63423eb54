"""A lexer for languages with braces: blanked text, blocks, comments, calls."""

from __future__ import annotations

import bisect
import re

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n]){1,12}'", re.S)
_RUST_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|r#*\"(?:.*?)\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S)
_JS_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'", re.S)
_NAME = r"[A-Za-z_$][\w$]*+(?:::<[^>()]*>)?"
_CALL = re.compile(rf"(?<![\w$])({_NAME}(?:\s*+(?:\.|::|->|\?\.)\s*+{_NAME})*+)\s*+\(")
WORDS = set("if for while switch catch return sizeof match loop fn function else do new typeof await in of case throw unsafe defined alignof decltype static_assert".split())


class Source:
    """A file with comments and strings blanked (``bare``), and its blocks."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.comments: list[tuple[int, int]] = []
        skip = _RUST_SKIP if language == "rust" else _JS_SKIP if language in ("typescript", "javascript") else _SKIP

        def blank(m: re.Match) -> str:
            s = m.group()
            if s.startswith(("//", "/*")):
                self.comments.append(m.span())
                return re.sub(r"[^\n]", " ", s)
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s

        self.bare = skip.sub(blank, text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        self.blocks: list[tuple[int, int]] = []
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[{}()\[\]]", self.bare):
            c = m.group()
            if c in "{([":
                stack.append((c, m.start()))
            else:
                want = {"}": "{", ")": "(", "]": "["}[c]
                while stack:
                    o, at = stack.pop()
                    if o == want:
                        self.close[at] = m.start()
                        if o == "{":
                            self.blocks.append((at, m.start()))
                        break
        self.blocks.sort()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def end_of_statement(self, at: int) -> int:
        """The next ; or line end outside brackets."""
        while at < len(self.bare):
            c = self.bare[at]
            if c in "([{":
                at = self.close.get(at, len(self.bare) - 1)
            elif c == ";":
                return at
            at += 1
        return len(self.bare) - 1

    def body(self, at: int) -> tuple[int, int] | None:
        """The block that opens a declaration's body after ``at``, before a ;."""
        while at < len(self.bare):
            c = self.bare[at]
            if c in "([":
                at = self.close.get(at, len(self.bare) - 1)
            elif c == "{":
                return (at, self.close.get(at, len(self.bare) - 1))
            elif c == ";":
                return None
            at += 1
        return None

    def comment_before(self, at: int) -> str | None:
        """The comment lines that end right above the line of ``at``."""
        line, out = self.line(at), []
        for a, b in reversed(self.comments):
            if b <= at and self.line(b - 1) == line - 1:
                out.append(self.text[a:b])
                line = self.line(a)
        return "\n".join(reversed(out)) or None

    def signature(self, start: int, body: int) -> str:
        return re.sub(r"\s+", " ", self.text[start:body]).strip()

    def calls(self, start: int, end: int, inner: list[tuple[int, int]] = ()):
        """(callee, position) of calls between two positions, those in inner
        functions left out."""
        for m in _CALL.finditer(self.bare, start, end):
            at, name = m.start(), re.sub(r"\s+", "", m.group(1))
            if name.split(".")[-1].split("::")[-1] in WORDS or any(a < at < b for a, b in inner):
                continue
            yield name, at

    def context(self, start: int, at: int, table: list[tuple[str, str]]) -> str | None:
        """The kind of the innermost block around ``at`` that says one."""
        for a, b in sorted(((a, b) for a, b in self.blocks if start < a < at < b), reverse=True):
            head = self.bare[max(start, self.bare.rfind("\n", start, a)) : a]
            for word, kind in table:
                if re.search(rf"\b{word}\b", head):
                    return kind
        return None
