"""What an extractor returns: nodes, edges by local number, unresolved refs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Extracted:
    path: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)

    def node(self, kind: str, name: str, start: int, end: int, parent: int | None = None, qualified: str | None = None, **more) -> int:
        """Add a node (lines from 1) and a ``contains`` edge from its parent."""
        base = {"signature": None, "docstring": None, "visibility": None, "is_export": False, "metadata": None}
        self.nodes.append(base | {"kind": kind, "name": name, "qualified_name": qualified or f"{self.path}::{name}", "line_start": start, "line_end": end} | more)
        at = len(self.nodes) - 1
        if parent is not None:
            self.edge(parent, at, "contains", 1.0)
        return at

    def edge(self, source: int, target: int, kind: str, confidence: float, context: str | None = None) -> None:
        self.edges.append({"source": source, "target": target, "kind": kind, "confidence": confidence, "context": context})

    def ref(self, source: int, name: str, kind: str, import_path: str | None = None, context: str | None = None) -> None:
        self.refs.append({"source": source, "target_name": name, "edge_kind": kind, "import_path": import_path, "context": context})

    def functions(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n["kind"] in ("function", "method")]


# How a program reads its environment, by language.
ENV = {
    "typescript": [r"process\.env\.([A-Z_][A-Z0-9_]*)", r"import\.meta\.env\.([A-Z_][A-Z0-9_]*)", r"process\.env\[['\"]([A-Z_][A-Z0-9_]*)['\"]\]"],
    "python": [r"os\.environ\[['\"]([A-Z_][A-Z0-9_]*)['\"]\]", r"os\.environ\.get\(\s*['\"]([A-Z_][A-Z0-9_]*)['\"]", r"os\.getenv\(\s*['\"]([A-Z_][A-Z0-9_]*)['\"]"],
    "rust": [r"(?:std::)?env::var\(\s*\"([A-Z_][A-Z0-9_]*)\"", r"env!\(\s*\"([A-Z_][A-Z0-9_]*)\"", r"option_env!\(\s*\"([A-Z_][A-Z0-9_]*)\""],
    "c": [r"getenv\(\s*\"([A-Z_][A-Z0-9_]*)\"\s*\)"],
}
ENV["javascript"], ENV["cpp"] = ENV["typescript"], ENV["c"]
# How routes are declared, (method, path) in two groups.
ROUTES = {
    "typescript": [r"@(Get|Post|Put|Delete|Patch|Head|Options|All)\(\s*['\"]([^'\"]*)['\"]\s*\)", r"(?:app|router)\.(get|post|put|delete|patch|all|head|options)\(\s*['\"]([^'\"]*)['\"]\s*,"],
    "python": [r"@(?:app|router|bp|blueprint)\.(route|get|post|put|delete|patch|head|options)\(\s*['\"]([^'\"]*)['\"]\s*"],
}
ROUTES["javascript"] = ROUTES["typescript"]
DJANGO = r"path\(\s*['\"]([^'\"]*)['\"]\s*,"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


def env_reads(out: Extracted, source: str, language: str) -> None:
    """A node per variable, read by the file's first function."""
    seen = set()
    first = next(iter(out.functions()), None)
    for pattern in ENV.get(language, ()):
        for name in re.findall(pattern, source):
            if name not in seen:
                seen.add(name)
                at = out.node("env_var", name, 0, 0, qualified=f"env::{name}")
                if first is not None:
                    out.edge(first, at, "reads_env", 0.9)


def routes(out: Extracted, source: str, language: str) -> None:
    """A node per (method, path), defined by the file's last function;
    handlers named after a method in a route file get metadata."""
    seen = set()
    last = next(reversed(out.functions()), None)

    def add(method: str, path: str, linked: bool) -> None:
        if (method, path) in seen:
            return
        seen.add((method, path))
        at = out.node("api_endpoint", f"{method} {path}", 0, 0, qualified=f"{out.path}::api::{path}", metadata={"api_method": method, "api_path": path})
        if linked and last is not None:
            out.edge(last, at, "defines_api", 0.9)

    for pattern in ROUTES.get(language, ()):
        for method, path in re.findall(pattern, source):
            add("GET" if method == "route" else method.upper(), path, True)
    if language == "python" and out.path.endswith("urls.py"):
        for path in re.findall(DJANGO, source):
            add("GET", path, False)
    if language in ("typescript", "javascript") and ("pages/api/" in out.path or out.path.endswith(("/route.ts", "/route.js"))):
        for n in out.nodes:
            if n["kind"] == "function" and n["name"] in METHODS:
                n["metadata"] = (n["metadata"] or {}) | {"api_method": n["name"], "api_path": "/" + re.sub(r"^.*?(?:pages|app)/|/route\.[jt]s$|\.[jt]sx?$", "", out.path)}
