"""C and C++ files.  Symbols have no visibility, so they are no candidates of
cross-file resolution."""

from __future__ import annotations

import re

from .braces import Source
from .records import Extracted, env_reads

_INCLUDE = re.compile(r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"\n]+[>\"])")
_FUNCTION = re.compile(r"(?<!\w)(?P<name>(?:\w++::)*+(?:~?\w+|operator\s*[^\s(]+))\s*\(")
_TYPE = re.compile(r"\b(?P<typedef>typedef\s+)?(?P<kind>struct|union|enum(?:\s+class)?|class|namespace)\s+(?P<name>\w+)?(?P<bases>[^;{()=]*)\{")
_ALIAS = re.compile(r"\busing\s+(?P<alias>\w+)\s*=\s*[^;]+;|\busing\s+(?P<using>[^;=]+);|\btypedef\s+(?P<what>[^;{]+?)\s*\**(?P<old>\w+)\s*(?:\[[^\]]*\])?;")
_GLOBAL = re.compile(r"(?m)^(?:(?:static|extern|const|constexpr|volatile|unsigned|signed|inline)\s+){0,6}+[\w:<>,*& ]{1,200}?[\s*&](?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^;{]*|=\s*\{[^;]*)?;")
_NOT = {"if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "else", "do", "case"}


def extract(path: str, source: str, language: str = "c") -> Extracted:
    out, s = Extracted(path), Source(source, language)
    cpp = language == "cpp"
    owners: list[tuple[int, int, int]] = []
    types: list[tuple[int, int, int]] = []
    for m in _INCLUDE.finditer(source):
        name = m.group(1)[1:-1]
        at = out.node("import", m.group().strip(), s.line(m.start(1)), s.line(m.start(1)))
        out.ref(at, name.split("/")[-1].rsplit(".", 1)[0], "imports", name)
    for m in _TYPE.finditer(s.bare):
        kind = m["kind"].split()[0]
        if kind in ("class", "namespace") and not cpp:
            continue
        brace = m.end() - 1
        end = s.close.get(brace, len(s.bare) - 1)
        tail = re.match(r"\s*(\w+)\s*;", s.bare[end + 1 :]) if m["typedef"] else None
        name = m["name"] or (tail.group(1) if tail else None)
        if not name:
            continue
        parent = next((n for a, b, n in reversed(types) if a < m.start() < b), None)
        node_kind = {"struct": "struct", "union": "struct", "enum": "enum", "class": "class", "namespace": "module"}[kind]
        at = out.node(node_kind, name, s.line(m.start()), s.line(end), parent, signature=s.signature(m.start(), brace), docstring=s.comment_before(m.start()))
        if tail and tail.group(1) != name:
            out.node("type_alias", tail.group(1), s.line(m.start()), s.line(end), parent)
        bases = m["bases"].partition(":")[2] if cpp and kind in ("class", "struct") else ""
        for base in bases.split(","):
            base = re.sub(r"\b(public|private|protected|virtual)\b|<.*", "", base).strip()
            if base:
                out.ref(at, base, "extends")
        types.append((brace, end, at))
    for m in _FUNCTION.finditer(s.bare):
        name = re.sub(r"\s+", " ", m["name"])
        if name.split("::")[-1] in _NOT or any(a < m.start() < b for a, b, _ in owners):
            continue
        after = s.close.get(m.end() - 1)
        if after is None:
            continue
        rest = re.match(r"\s*(?:const|noexcept|override|final|->\s*[\w:<>&* ]+|:\s*[^{;]*)*\s*\{", s.bare[after + 1 :])
        head = s.bare[max(s.bare.rfind(c, 0, m.start()) for c in ";}{") + 1 : m.start()]
        if not rest or (not head.strip() and not cpp) or "=" in head or ")" in head or head.strip().startswith("#define"):
            continue
        brace = after + 1 + rest.end() - 1
        end = s.close.get(brace, len(s.bare) - 1)
        start = m.start() - len(head.lstrip())
        parent = next((n for a, b, n in reversed(types) if a < m.start() < b), None)
        in_class = parent is not None and out.nodes[parent]["kind"] in ("class", "struct")
        at = out.node("method" if in_class or "::" in name else "function", name, s.line(start), s.line(end), parent, signature=s.signature(start, brace), docstring=s.comment_before(start))
        owners.append((brace, end, at))
    free = lambda p: not any(a < p < b for a, b, _ in owners)
    for m in _ALIAS.finditer(s.bare):
        if not free(m.start()):
            continue
        start, end = s.line(m.start()), s.line(m.end())
        if m["old"]:
            out.node("type_alias", m["old"], start, end, signature=s.signature(m.start(), m.end()))
        elif cpp and m["alias"]:
            out.node("type_alias", m["alias"], start, end, signature=s.signature(m.start(), m.end()))
        elif cpp:
            at = out.node("import", m.group(), start, end)
            out.ref(at, m["using"].replace("namespace", "").strip().split("::")[-1], "imports", m["using"].strip())
    for m in _GLOBAL.finditer(s.bare):
        text = m.group().strip()
        if free(m.start("name")) and not any(a < m.start("name") < b for a, b, n in types if out.nodes[n]["kind"] != "module") and not re.match(r"(typedef|using|return|struct\s+\w+\s*;|#|extern\s+\"C\")", text) and "(" not in text:
            out.node("constant" if re.match(r"(?:static\s+)?const(?:expr)? ", text) else "variable", m["name"], s.line(m.start("name")), s.line(m.end() - 1), signature=s.signature(m.start(), m.end())[:200])
    for a, b, node in owners:
        for name, _ in s.calls(a, b):
            out.ref(node, name, "calls")
    env_reads(out, source, language)
    return out
