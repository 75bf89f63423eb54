"""Rust files."""

from __future__ import annotations

import re

from .braces import Source
from .records import Extracted, env_reads

_ITEM = re.compile(
    r"(?P<vis>\bpub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*"
    r"(?:\bfn\s+(?P<fn>\w+)|\bstruct\s+(?P<struct>\w+)|\benum\s+(?P<enum>\w+)|\btrait\s+(?P<trait>\w+)|\bimpl\b(?P<impl>[^{;]*)|\btype\s+(?P<type>\w+)|\bmod\s+(?P<mod>\w+)|\buse\s+(?P<use>[^;]+);|(?:\bconst|\bstatic(?:\s+mut)?)\s+(?P<const>\w+)\s*:)"
)


def _last_name(text: str) -> str:
    return re.sub(r"<.*", "", text.strip(), flags=re.S).split("::")[-1].strip("& \n")


def extract(path: str, source: str) -> Extracted:
    out, s = Extracted(path), Source(source, "rust")
    owners: list[tuple[int, int, int]] = []
    outer: list[tuple[int, int, int, str]] = []  # impl, trait and mod blocks
    for m in _ITEM.finditer(s.bare):
        kind = next((k for k in ("fn", "struct", "enum", "trait", "impl", "type", "mod", "use", "const") if m[k] is not None), None)
        if kind is None:
            continue
        start = m.start()
        around = next(((a, b, n, k) for a, b, n, k in reversed(outer) if a < start < b), None)
        parent = around[2] if around else None
        vis = re.sub(r"\s+", "", m["vis"]) if m["vis"] else None
        attributes = " ".join(re.findall(r"#\[[^\n]*\]", "\n".join(_above(source, s.line(start)))))
        meta: dict = {}
        if d := re.findall(r"derive\(([^)]*)\)", attributes):
            meta["derive"] = ", ".join(x.strip() for y in d for x in y.split(","))
        if c := re.findall(r"cfg\((.*?)\)\]", attributes):
            meta["cfg"] = c[0]
        common = {"visibility": vis or "private", "is_export": vis == "pub", "docstring": s.comment_before(start)}
        if kind == "fn":
            body = s.body(m.end())
            end = body[1] if body else s.end_of_statement(m.end())
            params = s.bare[s.bare.find("(", m.end()) : s.close.get(s.bare.find("(", m.end()), m.end())]
            is_method = bool(re.match(r"\(\s*(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self\b", params)) and around is not None
            if is_method:
                meta["receiver"] = around[3]
            at = out.node("method" if is_method else "function", m["fn"], s.line(start), s.line(end), parent, signature=s.signature(start, body[0] if body else end), metadata=meta or None, **common)
            _bounds(out, at, s.bare[m.end() : body[0] if body else end])
            if body:
                owners.append((*body, at))
        elif kind in ("struct", "enum", "trait", "mod"):
            body = s.body(m.end())
            end = body[1] if body else s.end_of_statement(m.end())
            name = m[kind]
            if kind == "mod" and not body:
                out.node("module", name, s.line(start), s.line(end), parent, **common)
                continue
            signature = s.signature(start, body[0] if body else end)
            if kind == "struct" and body:
                fields = re.findall(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:", s.bare[body[0] : body[1]])
                signature += " { " + ", ".join(fields[:5]) + (", ..." if len(fields) > 5 else "") + " }" if fields else ""
            at = out.node("module" if kind == "mod" else kind, name, s.line(start), s.line(end), parent, signature=signature, metadata=meta or None, **common)
            if kind in ("struct", "enum"):
                for d in (meta.get("derive") or "").split(","):
                    if d.strip():
                        out.ref(at, _last_name(d), "type_ref")
            _bounds(out, at, s.bare[m.end() : body[0] if body else end])
            if kind == "enum" and body:
                for name_, at_pos in _variants(s, *body):
                    out.node("enum_variant", name_, s.line(at_pos), s.line(at_pos), at, qualified=f"{path}::{name}::{name_}")
            if kind in ("trait", "mod") and body:
                outer.append((*body, at, name))
        elif kind == "impl":
            body = s.body(m.end())
            if not body:
                continue
            head = re.sub(r"^\s*<[^>]*>", "", m["impl"])
            trait, word, target = head.partition(" for ")
            target = _last_name(re.sub(r"\bwhere\b.*", "", target if word else head, flags=re.S))
            at = out.node("impl", f"impl {target}", s.line(start), s.line(body[1]), parent, qualified=f"{path}::impl_{target}", signature=s.signature(start, body[0]))
            if word:
                out.ref(at, _last_name(trait), "implements")
            outer.append((*body, at, target))
        elif kind == "type":
            end = s.end_of_statement(m.end())
            out.node("type_alias", m["type"], s.line(start), s.line(end), parent, signature=s.signature(start, end), **common)
        elif kind == "const":
            end = s.end_of_statement(m.end())
            out.node("constant", m["const"], s.line(start), s.line(end), parent, signature=s.signature(start, end)[:200], **common)
        elif kind == "use":
            text = re.sub(r"\s+", " ", m["use"])
            at = out.node("import", f"use {text};", s.line(start), s.line(m.end()), visibility=vis)
            for name in re.findall(r"(\w+)\s*(?:as\s+\w+\s*)?(?=[,}]|$)", text):
                if name not in ("self", "super", "crate"):
                    out.ref(at, name, "imports", text.split("{")[0].rstrip(":"))
    for a, b, node in owners:
        inner = [(x, y) for x, y, _ in owners if a < x and y < b]
        for name, at in s.calls(a, b, inner):
            after = s.close.get(s.bare.find("(", at), at)
            spread = s.bare[after + 1 : after + 2] == "?"
            out.ref(node, name, "calls", context="error_propagation" if spread else s.context(a, at, [("if", "conditional"), ("match", "conditional"), ("else", "conditional"), ("for", "loop"), ("while", "loop"), ("loop", "loop")]))
    env_reads(out, source, "rust")
    return out


def _variants(s: Source, start: int, end: int):
    """(name, position) of an enum's variants: what follows its brace or a comma
    outside brackets."""
    at, fresh = start + 1, True
    while at < end:
        c = s.bare[at]
        if c in "([{":
            at = s.close.get(at, end)
        elif c == ",":
            fresh = True
        elif c == "#":
            at = s.close.get(s.bare.find("[", at), at)
        elif fresh and (c.isalpha() or c == "_"):
            name = re.match(r"\w+", s.bare[at:end]).group()
            yield name, at
            at, fresh = at + len(name) - 1, False
        at += 1


def _above(source: str, line: int) -> list[str]:
    """Attribute lines directly above a line, and the line itself."""
    lines, at = source.split("\n"), line - 1
    out = [lines[at]] if at < len(lines) else []
    while at > 0 and re.match(r"\s*(#\[|///)", lines[at - 1]):
        at -= 1
        out.append(lines[at])
    return out


def _bounds(out: Extracted, at: int, head: str) -> None:
    """Traits that bound type parameters."""
    names: list[str] = []
    for part in re.findall(r"\w+\s*:\s*([\w:]+(?:\s*<[^>]*>)?(?:\s*\+\s*[\w:']+)*)", " ".join(re.findall(r"^\s*<([^()]*?)>", head) + re.findall(r"\bwhere\b(.*)", head, re.S))):
        names += [_last_name(p) for p in part.split("+") if not p.strip().startswith("'")]
    for name in dict.fromkeys(n for n in names if n):
        out.ref(at, name, "type_ref")
