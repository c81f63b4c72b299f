"""Text of HTML pages and fragments with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that hold no content, and those that hold the main content, best first.
NOISE = frozenset({"script", "style", "nav", "footer", "header", "aside"})
MAIN = ("main", "article", "body")
_void = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


class _Collector(HTMLParser):
    """Text nodes with the stack of elements they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.nodes: list[tuple[frozenset[str], int, str]] = []
        self.opened = {m: 0 for m in MAIN}
        self.inside: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        if tag in _void:
            return
        self.stack.append(tag)
        if tag in MAIN:
            self.opened[tag] += 1
            if self.stack.count(tag) == 1:
                self.inside[tag] = self.opened[tag]

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if tag in MAIN and tag not in self.stack:
                self.inside.pop(tag, None)

    def handle_data(self, data):
        first = frozenset(m for m in MAIN if self.inside.get(m) == 1)
        self.nodes.append((frozenset(self.stack) | {"*" + m for m in first}, len(self.stack), data))


def page_text(html: str | None) -> str:
    """Text nodes of the first main, article or body element, joined by line ends, without noise elements."""
    if not html:
        return ""
    c = _Collector()
    c.feed(html)
    c.close()
    kept = [(around, data) for around, _, data in c.nodes if not around & NOISE]
    within = next((m for m in MAIN if c.opened[m]), None)
    return "\n".join(data for around, data in kept if within is None or "*" + within in around)


def fragment_text(html: str | None) -> str:
    """All text nodes of a fragment, at most one blank line in a row, stripped."""
    if not html:
        return ""
    c = _Collector()
    c.feed(html)
    c.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(data for _, _, data in c.nodes)).strip()


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text)


@F.pandas_udf(T.StringType())
def body_text(fragments: pd.Series) -> pd.Series:
    return fragments.map(fragment_text)
