"""Pages from markup: title, headings, links, images, metadata, embedded data, main text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset({"script", "style", "template", "noscript"})
_BLOCK = frozenset("p div li ul ol table tr section article header footer nav aside h1 h2 h3 h4 h5 h6 blockquote pre br form main figure".split())
# Class and id words of page parts around the content.
_NOISE = re.compile(r"nav|menu|footer|sidebar|cookie|banner|breadcrumb|share|social|comment|related|promo|newsletter|popup|modal|consent", re.I)
_BLANK = re.compile(r"[ \t\r\n\f]+")  # white space of markup, which the no-break space is not
_PIXEL = re.compile(r"pixel|track|1x1|spacer|blank|clear\.gif|analytics|badge", re.I)

PAGE = "title string, description string, published string, h1 array<string>, h2 array<string>, h3 array<string>, links array<struct<url string, text string>>, images array<struct<src string, alt string>>, text string, main_text string, data array<string>"


class _Parser(HTMLParser):
    """One pass over the markup; unclosed and stray tags are taken as they come."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.meta = base, [], {}
        self.heads: dict[str, list[str]] = {"h1": [], "h2": [], "h3": []}
        self.links, self.images, self.text, self.data = [], [], [], []
        self.stack: list[tuple[str, bool]] = []
        self.catch: tuple[str, list[str]] | None = None
        self.anchor: tuple[str, list[str]] | None = None
        self.blocks: list[list] = []  # [tag, noise, paragraphs, link chars, parts]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta[(a.get("property") or a.get("name") or "").lower()] = a.get("content", "")
        elif tag == "img":
            src = a.get("src") or a.get("data-src") or ""
            if src and not _PIXEL.search(src) and a.get("width") not in ("1", "2") and a.get("height") not in ("1", "2"):
                self.images.append((urljoin(self.base, src), a.get("alt", "")))
        elif tag == "a" and a.get("href"):
            self.anchor = (urljoin(self.base, a["href"]), [])
        elif tag in self.heads or tag == "title":
            self.catch = (tag, [])
        elif tag == "script" and "json" in a.get("type", ""):
            self.catch = ("script", [])
        if tag in _BLOCK:
            self.text.append("\n")
        if tag not in _VOID:
            self.stack.append((tag, bool(_NOISE.search(f"{a.get('class', '')} {a.get('id', '')}")) or tag in ("nav", "footer", "aside", "header")))
            if tag in ("div", "article", "section", "main", "td", "body"):
                self.blocks.append([tag, self.stack[-1][1], 0, 0, [], len(self.stack)])
            elif tag == "p":
                for b in self.blocks[-3:]:
                    b[2] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], _BLANK.sub(" ", "".join(self.anchor[1])).strip(" ")))
            self.anchor = None
        if self.catch and self.catch[0] == tag:
            body = _BLANK.sub(" ", "".join(self.catch[1])).strip(" ") if tag != "script" else "".join(self.catch[1]).strip()
            (self.title if tag == "title" else self.data if tag == "script" else self.heads[tag]).append(body)
            self.catch = None
        if tag in _BLOCK:
            self.text.append("\n")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.catch:
            self.catch[1].append(data)
        if self.anchor:
            self.anchor[1].append(data)
        if any(t in _SILENT or t in ("title", "head") for t, _ in self.stack):
            return
        self.text.append(data)
        noisy = any(n for _, n in self.stack)
        for b in self.blocks:
            if b[5] <= len(self.stack):
                if self.anchor:
                    b[3] += len(data)
                if not noisy or b[1]:
                    b[4].append(data)

    def main_text(self) -> str:
        """The container that reads most like an article: long, of paragraphs, with few links."""
        best, top = "", 0.0
        for tag, noise, paragraphs, linked, parts, _ in self.blocks:
            body = " ".join(" ".join(parts).split())
            if len(body) < 200:
                continue
            score = len(body) + 50 * paragraphs - 100 * linked / max(len(body) / 100, 1) + {"article": 200, "main": 150, "section": 50}.get(tag, 0) - 500 * noise
            if score > top:
                best, top = body, score
        return best


def parse_page(html: str | None, base: str = "") -> dict | None:
    """The fields of PAGE; null markup gives null, broken markup what can be read of it."""
    if html is None:
        return None
    p = _Parser(base or "")
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError):
        pass
    distinct = lambda rows: list(dict.fromkeys(rows))
    text = "\n".join(filter(None, (" ".join(x.split()) for x in "".join(p.text).split("\n"))))
    good = [d for d in p.data if _json(d)]
    return {
        "title": (p.title or [None])[0], "description": p.meta.get("description") or p.meta.get("og:description"), "published": p.meta.get("article:published_time") or p.meta.get("date"), **p.heads,
        "links": [{"url": u, "text": t} for u, t in distinct(p.links) if u.startswith(("http", "//"))], "images": [{"src": s, "alt": a} for s, a in distinct(p.images)], "text": text, "main_text": p.main_text() or text, "data": good,
    }


def _json(text: str) -> bool:
    try:
        json.loads(unescape(text))
    except ValueError:
        return False
    return True


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("url", pa.string()), ("text", pa.string())]), pa.struct([("src", pa.string()), ("alt", pa.string())])
    s, many = pa.string(), pa.list_(pa.string())
    types = {"title": s, "description": s, "published": s, "h1": many, "h2": many, "h3": many, "links": pa.list_(struct[0]), "images": pa.list_(struct[1]), "text": s, "main_text": s, "data": many}
    for batch in batches:
        rows = [parse_page(h, u) or {} for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([r.get(k) for r in rows], t) for k, t in types.items())], names=["id", *types])


def extract_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, fields of PAGE) of every page; the wide markup goes no further."""
    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(_pages, "id long, " + PAGE)
