"""HTML to text: all text of a page in order, with entities decoded."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import strip


class _TextOnly(HTMLParser):
    """Text tokens only; script and style bodies are text too, comments and declarations are not."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


_REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*;))?")


def page_text(html: str, bare: bool = True) -> str:
    """The text of a page. References of the old names are decoded without their semicolon too, as browsers do; with ``bare=False``
    such ones stay as they are."""
    mark = ""
    if not bare and "&" in html:
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)
        html = _REFERENCE.sub(lambda m: m[0] if len(m[0]) > 1 and (m[1] is None or m[1] in html5) else mark + m[0][1:], html)
    parser = _TextOnly()
    parser.feed(html)
    parser.close()
    text = "".join(parser.parts)
    return text.replace(mark, "&") if mark else text


def html_text(html: Column, bare: bool = True) -> Column:
    """Text of an HTML column, trimmed; null stays null."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([None if (html := p.as_py()) is None else page_text(html, bare) for p in pages], pa.string())  # one page at a time

    return strip(texts(html))
