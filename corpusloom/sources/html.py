"""HTML, notebooks and record formats as native expressions."""

from __future__ import annotations

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that hold no text of a page.
BOILERPLATE = ("nav", "header", "footer", "aside", "script", "style", "form", "noscript", "iframe", "svg")


def title(h: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def text(h: Column) -> Column:
    """Boilerplate dropped, the main element preferred, blocks joined by newlines."""
    for t in BOILERPLATE:
        h = F.regexp_replace(h, rf"(?is)<{t}[ >].*?</{t}>", " ")
    main = F.regexp_extract(h, r"(?is)<main[^>]*>(.*)</main>", 1)
    body = F.when(main != "", main).otherwise(F.regexp_replace(h, r"(?is)<head[ >].*?</head>", " "))
    flat = unescape(F.regexp_replace(body, r"(?s)<[^>]+>", "\n"))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def links(h: Column) -> Column:
    """Array of (href, anchor text) of absolute links."""
    m = F.regexp_extract_all(h, F.lit(r"""(?is)<a [^>]*href="http[^"]+"[^>]*>.*?</a>"""), F.lit(0))
    return F.transform(m, lambda a: F.struct(F.regexp_extract(a, 'href="([^"]+)"', 1).alias("href"), F.trim(F.regexp_replace(a, "<[^>]+>", "")).alias("anchor")))


def tables(h: Column) -> Column:
    """Array of tables, each an array of rows of cells; empty cells dropped with their rows."""
    tags = lambda x, t: F.regexp_extract_all(x, F.lit(rf"(?is)<{t}[ >].*?</{t}>"), F.lit(0))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: F.trim(unescape(F.regexp_replace(c, "<[^>]+>", ""))))
    rows = lambda t: F.filter(F.transform(tags(t, "tr"), cells), lambda r: F.exists(r, lambda c: c != ""))
    return F.transform(tags(h, "table"), rows)


def images(h: Column, base: Column) -> Column:
    """Array of image addresses, resolved against the base unless absolute or data."""
    src = F.regexp_extract_all(h, F.lit(r"""(?is)<img [^>]*src="([^"]+)\""""), F.lit(1))
    return F.transform(src, lambda s: F.when(s.rlike("^(https?:|data:)"), s).otherwise(F.concat(F.regexp_extract(base, "^(https?://[^/]+)", 1), F.lit("/"), F.regexp_replace(s, "^/+", ""))))


NOTEBOOK = "cells array<struct<cell_type:string,source:array<string>>>"


def notebook_text(j: Column) -> Column:
    """Markdown and code cells in order, code fenced."""
    cells = F.from_json(j, NOTEBOOK)["cells"]
    return F.array_join(F.transform(cells, lambda c: F.when(c["cell_type"] == "code", F.concat(F.lit("```\n"), F.array_join(c["source"], ""), F.lit("\n```"))).otherwise(F.array_join(c["source"], ""))), "\n\n")


def notebook_summary(j: Column) -> Column:
    """title (first heading), number of code cells, imported modules."""
    cells = F.from_json(j, NOTEBOOK)["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    prose = F.array_join(F.transform(F.filter(cells, lambda c: c["cell_type"] == "markdown"), lambda c: F.array_join(c["source"], "")), "\n")
    src = F.array_join(F.transform(code, lambda c: F.array_join(c["source"], "")), "\n")
    modules = F.array_distinct(F.regexp_extract_all(src, F.lit(r"(?m)^(?:import|from) ([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    return F.struct(F.nullif(F.regexp_extract(prose, r"(?m)^# +(.*)$", 1), F.lit("")).alias("title"), F.size(code).alias("code_cells"), F.array_join(F.array_sort(modules), ",").alias("modules"))


class _Page(HTMLParser):
    """Title, meta fields, text, tables, links and images of a page, whatever is left open."""

    BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article blockquote pre td th main body".split())

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.skip, self.title, self.in_title = base, [], None, False
        self.meta, self.parts, self.links, self.images = {}, [], [], []
        self.tables, self.open_tables, self.link = [], [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in BOILERPLATE:
            self.skip.append(tag)
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        elif tag == "meta" and a.get("name") and "content" in a:
            self.meta.setdefault(a["name"].lower(), a["content"])
        elif tag == "img" and a.get("src"):
            self.images.append(a["src"] if a["src"].startswith("data:") else urljoin(self.base, a["src"]))
        elif tag == "a" and a.get("href"):
            self.link = [urljoin(self.base, a["href"]), ""]
        elif tag == "table":
            self.open_tables.append([])
            self.tables.append(self.open_tables[-1])
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1].append([])
        elif tag in ("td", "th") and self.open_tables:
            if not self.open_tables[-1]:
                self.open_tables[-1].append([])
            self.open_tables[-1][-1].append("")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False
        elif tag == "a" and self.link:
            if self.link[0].startswith("http"):
                self.links.append((self.link[0], " ".join(self.link[1].split())))
            self.link = None
        elif tag == "table" and self.open_tables:
            self.open_tables.pop()
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(data)
            if self.link:
                self.link[1] += data
            if self.open_tables and self.open_tables[-1] and self.open_tables[-1][-1]:
                self.open_tables[-1][-1][-1] += data


PAGE = "title string, meta map<string,string>, text string, tables array<array<array<string>>>, links array<struct<href:string,anchor:string>>, images array<string>"


def parse_page(h: str | None, base: str) -> dict:
    if h is None:
        return {"title": None, "meta": {}, "text": None, "tables": [], "links": [], "images": []}
    p = _Page(base)
    p.feed(h)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    tables = [[r for r in ([" ".join(c.split()) for c in row] for row in t) if any(r)] for t in p.tables]
    title = " ".join(p.title.split()) if p.title else ""
    links = [{"href": x, "anchor": y} for x, y in p.links]
    return {"title": title or None, "meta": p.meta, "text": "\n".join(x for x in lines if x), "tables": [t for t in tables if t], "links": links, "images": p.images}


def page(col: str, base: Column) -> Column:
    """All parts of a page by a tolerant parser, in one Arrow pass; null for null."""

    @F.pandas_udf(PAGE)
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in PAGE.split(", ")]
        rows = [parse_page(h, b or "") for h, b in zip(pages, bases, strict=True)]
        return pd.DataFrame([[r[n] for n in names] for r in rows], columns=names)

    return run(col, base)


PAPERS = "array<struct<id:string,title:string,published:string,summary:string,authors:array<string>>>"


def papers(xml: Column) -> Column:
    """Entries of an Atom feed or a bare entry, with or without namespaces; what is no XML has none."""
    from xml.etree import ElementTree

    def entries(x: str | None) -> list[dict]:
        if not x:
            return []
        try:
            root = ElementTree.fromstring(x)
        except ElementTree.ParseError:
            return []
        name = lambda e: e.tag.rsplit("}", 1)[-1]
        out = []
        for e in root.iter():
            if name(e) == "entry":
                first = {}
                for c in e:
                    first.setdefault(name(c), " ".join((c.text or "").split()) or None)
                authors = [" ".join((n.text or "").split()) for c in e if name(c) == "author" for n in c if name(n) == "name"]
                out.append({k: first.get(k) for k in ("id", "title", "published", "summary")} | {"authors": authors})
        return out

    @F.pandas_udf(PAPERS)
    def run(x: pd.Series) -> pd.Series:
        return x.map(entries)

    return run(xml)


SERIES = "series_id string, observations array<struct<date:string,value:string>>"


def observations(j: Column) -> Column:
    """Array of (date, value); values that are no numbers are null."""
    return F.transform(F.from_json(j, SERIES)["observations"], lambda o: F.struct(F.try_to_timestamp(o["date"], F.lit("yyyy-MM-dd")).cast("date").alias("date"), o["value"].try_cast("double").alias("value")))
