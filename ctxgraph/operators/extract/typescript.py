"""TypeScript and JavaScript files."""

from __future__ import annotations

import re

from .braces import Source
from .records import Extracted, env_reads, routes

CONTEXT = [("catch", "error_handler"), ("try", "error_handler"), ("if", "conditional"), ("else", "conditional"), ("switch", "conditional"), ("for", "loop"), ("while", "loop"), ("do", "loop")]
_DECL = re.compile(
    r"(?P<export>\bexport\s+(?:default\s+)?)?(?:\bdeclare\s+)?(?:(?:async\s+)?\bfunction\s*\*?\s*(?P<fn>[\w$]+)|(?:abstract\s+)?\bclass\s+(?P<cls>[\w$]+)|\binterface\s+(?P<iface>[\w$]+)|\btype\s+(?P<type>[\w$]+)\s*(?:<[^=]*>)?\s*=|(?:const\s+)?\benum\s+(?P<enum>[\w$]+)|\b(?P<var>const|let|var)\s+(?P<name>[\w$]+))"
)
_METHOD = re.compile(r"(?m)(?:^|(?<=[{;}]))[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?P<name>[\w$#]+)\s*(?:<[^>(]*>)?\(")
_IMPORT = re.compile(r"(?m)^[ \t]*import\s+(?:type\s+)?(?P<what>[^;'\"]*?)(?:\s*from\s*)?['\"](?P<path>[^'\"]+)['\"]")


def extract(path: str, source: str, language: str = "typescript") -> Extracted:
    out, s = Extracted(path), Source(source, language)
    owners: list[tuple[int, int, int]] = []  # (begin, end, node) of functions
    for m in _IMPORT.finditer(source):
        if s.bare[m.start("path") - 1] not in "'\"":
            continue
        at = out.node("import", m.group().split("\n")[0].strip(), s.line(m.start()), s.line(m.end()))
        what = m.group("what")
        names = [n.split(" as ")[0].strip() for n in re.sub(r"[{}]", ",", what).split(",")]
        for name in names:
            if name and not name.startswith("*"):
                out.ref(at, name.removeprefix("type "), "imports", m.group("path"))
    for m in _DECL.finditer(s.bare):
        export = bool(m.group("export"))
        kind = next((k for k in ("fn", "cls", "iface", "type", "enum", "var") if m.group(k)), None)
        parent = next((n for a, b, n in reversed(owners) if a < m.start() < b), None)
        common = {"is_export": export, "visibility": "public" if export else None}
        if kind == "fn":
            body = s.body(m.end())
            if body:
                at = out.node("function", m["fn"], s.line(m.start()), s.line(body[1]), parent, signature=s.signature(m.start(), body[0]), docstring=s.comment_before(m.start()), **common)
                owners.append((*body, at))
        elif kind in ("cls", "iface", "enum"):
            body = s.body(m.end())
            if not body:
                continue
            at = out.node({"cls": "class", "iface": "interface", "enum": "enum"}[kind], m[kind], s.line(m.start()), s.line(body[1]), parent, signature=s.signature(m.start(), body[0]), docstring=s.comment_before(m.start()), **common)
            head = s.bare[m.end() : body[0]]
            for word, edge in (("extends", "extends"), ("implements", "implements")):
                h = re.search(rf"\b{word}\s+([\w$.<>,\s]+?)(?=\bimplements\b|$)", head)
                for name in re.sub(r"<.*?>", "", h.group(1)).split(",") if h else ():
                    if name.strip():
                        out.ref(at, name.strip(), edge)
            if kind == "cls":
                for f in _METHOD.finditer(s.bare, body[0] + 1, body[1]):
                    inside = s.body(s.close.get(f.end() - 1, body[1]))
                    nested = any(body[0] < a < f.start("name") < b for a, b in s.blocks if (a, b) != body)
                    if nested or f["name"] in ("if", "for", "while", "switch", "catch", "return", "function", "new") or not inside or inside[1] > body[1]:
                        continue
                    access = re.search(r"\b(private|protected|public)\b", f.group())
                    node = out.node("method", f["name"], s.line(f.start("name")), s.line(inside[1]), at, signature=s.signature(f.start(), inside[0]), visibility=access.group(1) if access else None)
                    owners.append((*inside, node))
        elif kind == "type":
            end = s.end_of_statement(m.end())
            out.node("type_alias", m["type"], s.line(m.start()), s.line(end), parent, signature=s.signature(m.start(), end), **common)
        elif kind == "var" and not any(a < m.start() < b for a, b, _ in owners):
            arrow = re.compile(r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>\s*").match(s.bare, m.end())
            body = s.body(arrow.end()) if arrow and s.bare[arrow.end() : arrow.end() + 1] == "{" else None
            if arrow:
                end = body[1] if body else s.end_of_statement(arrow.end())
                at = out.node("function", m["name"], s.line(m.start()), s.line(end), signature=s.signature(m.start(), arrow.end()), **common)
                owners.append((arrow.end() - 1, end, at))
            else:
                end = s.end_of_statement(m.end())
                out.node("constant" if m["var"] == "const" else "variable", m["name"], s.line(m.start()), s.line(end), signature=s.signature(m.start(), end)[:200], **common)
    for a, b, node in owners:
        inner = [(x, y) for x, y, _ in owners if a < x and y < b]
        for name, at in s.calls(a, b, inner):
            out.ref(node, name, "calls", context=s.context(a, at, CONTEXT))
    routes(out, source, language)
    env_reads(out, source, language)
    return out
