"""HTML files and dotenv files."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .records import Extracted


class _Page(HTMLParser):
    def __init__(self, out: Extracted):
        super().__init__()
        self.out, self.style = out, None

    def handle_starttag(self, tag, attrs):
        own, line = dict(attrs), self.getpos()[0]
        link = own.get("src") if tag == "script" else own.get("href") if tag == "link" else None
        if link:
            at = self.out.node("import", link, line, line + self.get_starttag_text().count("\n"))
            self.out.ref(at, link, "imports", link)
        if tag == "style":
            self.style = line

    def handle_endtag(self, tag):
        if tag == "style" and self.style is not None:
            self.out.node("module", "<style>", self.style, self.getpos()[0])
            self.style = None


def extract_html(path: str, source: str) -> Extracted:
    """Scripts and links are imports, style blocks modules; no edges."""
    out = Extracted(path)
    page = _Page(out)
    page.feed(source)
    page.close()
    return out


def extract_dotenv(path: str, source: str) -> Extracted:
    """A variable per key; lines from 0; the value is not kept."""
    out, seen = Extracted(path), set()
    for i, line in enumerate(source.split("\n")):
        key, sign, _ = line.strip().removeprefix("export ").partition("=")
        key = key.strip()
        if sign and not line.strip().startswith("#") and re.fullmatch(r"\w+", key, re.A) and key not in seen:
            seen.add(key)
            out.node("env_var", key, i, i, qualified=f"env::{key}", signature=f"{key}=", is_export=True, metadata={"defined_in": path})
    return out
