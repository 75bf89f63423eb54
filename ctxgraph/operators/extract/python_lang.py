"""Python files by the standard parser; files it rejects give nothing."""

from __future__ import annotations

import ast

from .records import Extracted, env_reads, routes


def _visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


def _doc(body: list) -> str | None:
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        return body[0].value.value.strip("\"' \n")
    return None


class _Visitor:
    def __init__(self, out: Extracted, source: str):
        self.out, self.source, self.lines = out, source, source.split("\n")

    def text(self, node) -> str:
        return ast.get_source_segment(self.source, node) or ""

    def body(self, body: list, parent: int | None, in_class: bool, top: bool) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s, parent, in_class)
            elif isinstance(s, ast.ClassDef):
                self.klass(s, parent)
            elif isinstance(s, (ast.Import, ast.ImportFrom)):
                self.imports(s)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)) and top:
                self.constant(s)
            else:
                for name in ("body", "orelse", "finalbody"):
                    inner = getattr(s, name, None)
                    if isinstance(inner, list):
                        self.body(inner, parent, in_class, False)
                for h in getattr(s, "handlers", []):
                    self.body(h.body, parent, in_class, False)

    def function(self, s, parent: int | None, in_class: bool) -> None:
        returns = f" -> {self.text(s.returns)}" if s.returns else ""
        at = self.out.node("method" if in_class else "function", s.name, s.lineno, s.end_lineno, parent, signature=f"def {s.name}({ast.unparse(s.args)}){returns}", docstring=_doc(s.body), visibility=_visibility(s.name))
        for inner in s.body:
            self.calls(inner, at, None)
        self.body(s.body, at, False, False)

    def klass(self, s: ast.ClassDef, parent: int | None) -> None:
        bases = ", ".join(self.text(b) for b in s.bases)
        at = self.out.node("class", s.name, s.lineno, s.end_lineno, parent, signature=f"class {s.name}({bases})" if bases else f"class {s.name}", docstring=_doc(s.body), visibility=_visibility(s.name))
        for b in s.bases:
            if isinstance(b, ast.Name):
                self.out.ref(at, b.id, "extends")
        self.body(s.body, at, True, False)

    def imports(self, s) -> None:
        at = self.out.node("import", self.text(s).split("\n")[0], s.lineno, s.end_lineno)
        names = [a.name for a in s.names]
        path = ("." * s.level + (s.module or "")) if isinstance(s, ast.ImportFrom) else names[0]
        dotted = ([s.module] if isinstance(s, ast.ImportFrom) and s.module else []) + names
        for name in dict.fromkeys(d.split(".")[0] for d in dotted if d != "*"):
            self.out.ref(at, name, "imports", path)

    def constant(self, s) -> None:
        for target in s.targets if isinstance(s, ast.Assign) else [s.target]:
            if isinstance(target, ast.Name) and target.id.replace("_", "").isalpha() and target.id.isupper():
                self.out.node("constant", target.id, s.lineno, s.end_lineno, signature=self.text(s).split("\n")[0], visibility=_visibility(target.id))

    def calls(self, node, owner: int, context: str | None) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            return
        if isinstance(node, ast.Call):
            self.out.ref(owner, self.text(node.func), "calls", context=context)
        inner = "conditional" if isinstance(node, (ast.If, ast.IfExp, ast.Match)) else "loop" if isinstance(node, (ast.For, ast.While, ast.AsyncFor)) else "error_handler" if isinstance(node, ast.Try) else context
        for child in ast.iter_child_nodes(node):
            self.calls(child, owner, inner)


def extract(path: str, source: str) -> Extracted:
    out = Extracted(path)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return out
    _Visitor(out, source).body(tree.body, None, False, True)
    routes(out, source, "python")
    env_reads(out, source, "python")
    return out
