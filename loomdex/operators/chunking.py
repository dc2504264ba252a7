"""Structure-aware chunks of documents, and cleaning of HTML pages.

Both are state machines over one document, so they run as Arrow-batched maps; documents are independent.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
SENTENCE = re.compile(r"(?<=[.!?।])\s+")
CHUNKS = "doc_id long, chunk_index int, chunk_id string, heading string, text string"


def is_heading(line: str) -> bool:
    """A short line without closing punctuation, or one that ends in a colon."""
    words = line.split()
    return 0 < len(words) <= 10 and (line.endswith(":") or (line[-1] not in ".,;!?" and sum(w[0].isupper() for w in words) * 2 > len(words)))


def units(text: str, most: int) -> list[tuple[str, str]]:
    """(heading, unit): list items together, prose by sentences, long sentences by words, each under its heading."""
    out: list[tuple[str, str]] = []
    heading, items = "", []

    def flush() -> None:
        if items:
            out.extend((heading, x) for x in pieces("\n".join(items), most))
            items.clear()

    for line in (x.strip() for x in text.split("\n")):
        if not line:
            flush()
        elif LIST_ITEM.match(line):
            items.append(line)
        elif is_heading(line):
            flush()
            heading = line
        else:
            flush()
            for s in SENTENCE.split(line):
                out.extend((heading, x) for x in pieces(s, most))
    flush()
    return out


def pieces(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    out, now = [], ""
    for w in text.split():
        while len(w) > most:
            if now:
                out.append(now)
                now = ""
            out.append(w[:most])
            w = w[most:]
        if now and len(now) + 1 + len(w) > most:
            out.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return [*out, now] if now else out


def chunks_of(text: str, most: int = 1200, overlap: int = 150, least: int = 100) -> list[tuple[str, str]]:
    """(heading, chunk): units packed greedily up to `most` characters; a chunk begins with the last units of the one before
    it under the same heading, up to `overlap`; one below `least` joins the one before it if both fit."""
    out: list[tuple[str, list[str]]] = []
    for heading, unit in units(text, most):
        if out and out[-1][0] == heading and len("\n".join([*out[-1][1], unit])) <= most:
            out[-1][1].append(unit)
            continue
        lead: list[str] = []
        if out and out[-1][0] == heading:
            for u in reversed(out[-1][1]):
                if len("\n".join([u, *lead])) > overlap or len("\n".join([u, *lead, unit])) > most:
                    break
                lead.insert(0, u)
        out.append((heading, [*lead, unit]))
    done: list[tuple[str, str]] = []
    for heading, us in out:
        chunk = "\n".join(us)
        if done and len(chunk) < least and len(done[-1][1]) + 1 + len(chunk) <= most:
            done[-1] = (done[-1][0], f"{done[-1][1]}\n{chunk}")
        else:
            done.append((heading, chunk))
    return done


def chunk(docs: DataFrame, most: int = 1200, overlap: int = 150, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: doc_id, chunk_index, chunk_id, heading, text. Null and blank texts have none."""
    if not 0 <= overlap < most or least > most:
        raise ValueError("overlap and least have to be below the size of a chunk")

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text in pdf.itertuples(index=False):
                for i, (heading, body) in enumerate(chunks_of(text or "", most, overlap, least)):
                    key = hashlib.sha256("\x1f".join([str(doc), str(i), body]).encode()).hexdigest()[:24]
                    rows.append((doc, i, f"chunk-{key}", heading, body))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_id", "heading", "text"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, CHUNKS)


def table_chunks(tables: DataFrame) -> DataFrame:
    """doc_id, row, text: one chunk per table row, `header: value` joined by ` | `. tables: doc_id, headers, rows."""
    rows = tables.select("doc_id", "headers", F.posexplode("rows").alias("row", "cells"))
    pairs = F.zip_with("headers", "cells", lambda h, c: F.concat_ws(": ", h, F.coalesce(c, F.lit(""))))
    return rows.select("doc_id", "row", F.array_join(pairs, " | ").alias("text"))


SKIP = {"script", "style", "nav", "footer", "noscript", "template", "svg", "form", "iframe", "header", "aside"}
BLOCK = {"p", "div", "section", "article", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "main", "blockquote", "pre"}
CHROME = re.compile(r"\b(ad|ads|advert|banner|cookie|breadcrumb|sidebar|menu)\b", re.I)
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}


class Page(HTMLParser):
    """Title, text without page chrome, links and tables of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.links, self.tables = "", [], [], []
        self.skip: list[str] = []
        self.in_title, self.cell = False, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag == "title":
            self.in_title = True
        elif tag in SKIP or CHROME.search(f"{a.get('class') or ''} {a.get('id') or ''}"):
            if tag not in VOID:
                self.skip.append(tag)
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
        if tag in BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if tag == "title":
            self.in_title = False
        elif tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag in BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            (self.cell if self.cell is not None else self.parts).append(data)


def reliable(table: list[list[str]]) -> bool:
    """Two rows and columns at least, rectangular, filled headers, two filled cells in each row."""
    return len(table) >= 2 and len(table[0]) >= 2 and all(len(r) == len(table[0]) for r in table) and all(table[0]) and all(sum(bool(c) for c in r) >= 2 for r in table)


def clean_page(html: str) -> tuple[str, str, list[str], list[list[list[str]]]]:
    page = Page()
    page.feed(html or "")
    page.close()
    lines = [" ".join(x.split()) for x in unicodedata.normalize("NFKC", "".join(page.parts)).split("\n")]
    return " ".join(page.title.split()), "\n".join(x for x in lines if x), page.links, [t for t in page.tables if reliable(t)]


def clean_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, text, links, tables (headers, rows), removed_percent."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, html in pdf.itertuples(index=False):
                title, text, links, tables = clean_page(html)
                before = len(html or "")
                rows.append((i, title, text, links, [{"headers": t[0], "rows": t[1:]} for t in tables], round(max(0, before - len(text)) / before * 100, 2) if before else 0.0))
            yield pd.DataFrame(rows, columns=["page_id", "title", "text", "links", "tables", "removed_percent"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, title string, text string, links array<string>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, removed_percent double")


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """The column in NFKC with case folded."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return df.withColumn(column, fold(column))
