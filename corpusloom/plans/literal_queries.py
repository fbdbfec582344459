"""Queries on small literal inputs, and over the whole tables where one has the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import activity as A
from corpusloom.operators import extract as E
from corpusloom.operators import near
from corpusloom.sources import html as H
from corpusloom.sources.tables import table

from ._registry import Registry

R = Registry()


def given(name, cols, rows, query, sql):
    """A query over rows given as VALUES to both engines."""
    body = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)

    def run(s, d):
        return query(s.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} {t}" for c, t in cols)))

    R.add(name, run, f"WITH v AS (SELECT * FROM (VALUES {body}) t({', '.join(c for c, _ in cols)})) {sql}" if sql else None)


ID = ("id", "long")
SIZES = [(1, "12.5 MB"), (2, "1 GB, PDF"), (3, "512 KB"), (4, "900 B"), (5, "unknown"), (6, None)]
given("parse_size_mb", [ID, ("s", "string")], SIZES, lambda v: v.select("id", F.round(X.parse_size_mb(F.col("s")), 6).alias("value")), r"""SELECT id::BIGINT AS id, round(CASE upper(regexp_extract(s, '(?i)(GB|MB|KB|B)\b', 1)) WHEN 'GB' THEN n * 1024 WHEN 'MB' THEN n WHEN 'KB' THEN n / 1024 WHEN 'B' THEN n / 1048576 END, 6) AS value FROM (SELECT id, s, try_cast(nullif(regexp_extract(s, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS n FROM v)""")
given("pdf_date", [ID, ("s", "string")], [(1, "D:20240131120000Z"), (2, "D:20241340000000"), (3, "last week"), (4, None)], lambda v: v.select("id", X.pdf_date(F.col("s")).alias("value")), "SELECT id::BIGINT AS id, coalesce(strftime(try_strptime(regexp_extract(s, '^D:([0-9]{14})', 1), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%S'), s) AS value FROM v")
MD = [(1, "# Title\nSome `code` and [a link](http://x.y)\n![pic](a.png)\n```\nblock\n```\n**bold** end"), (2, ""), (3, None)]
given("markdown_strip", [ID, ("s", "string")], MD, lambda v: v.select("id", X.markdown_strip(F.col("s")).alias("value")), r"""SELECT id::BIGINT AS id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?s)```.*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '(?m)^#{1,6} +', '', 'g'), '[*]{1,3}', '', 'g'), ' ') AS value FROM v""")
PAIRS = [(1, "kitten", "sitten"), (2, "", ""), (3, "abc", "abcdef"), (4, "same words here", "here same word")]
given("char_similarity", [ID, ("a", "string"), ("b", "string")], PAIRS, lambda v: v.select("id", F.round(X.char_similarity(F.col("a"), F.col("b")), 6).alias("value")), "SELECT id::BIGINT AS id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] = b[i]))::DOUBLE / greatest(length(a), length(b)) END, 6) AS value FROM v")
given("jaccard_pairs", [ID, ("a", "string"), ("b", "string")], PAIRS, lambda v: v.select("id", F.round(X.word_jaccard(F.col("a"), F.col("b")), 6).alias("value")), "SELECT id::BIGINT AS id, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS value FROM (SELECT id, list_distinct(regexp_extract_all(lower(a), '[a-z0-9_]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9_]+')) AS y FROM v)")
FORMS = [(1, "\\frac{a}{b} + c^2"), (2, "x = y"), (3, "{{{a}}}"), (4, "")]
given("formula_complexity", [ID, ("f", "string")], FORMS, lambda v: v.select("id", E.complexity(F.col("f")).alias("value")), None)
HTML = [
    (1, "<html><head><title>One &amp; two</title></head><body><nav>menu</nav><main><h1>Head</h1><p>Body text</p><a href=\"http://a.b/c\">Go <b>there</b></a></main></body></html>"),
    (2, "<body><p>No title</p><a href=\"/rel\">rel</a><a href=\"https://x.y\">X</a><img alt=\"i\" src=\"/p.png\"><img src=\"data:abc\"></body>"),
    (3, "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td></td><td></td></tr></table>"),
    (4, None),
]
given("html_title", [ID, ("h", "string")], HTML, lambda v: v.select("id", H.title(F.col("h")).alias("value")), "SELECT id::BIGINT AS id, nullif(trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), '') AS value FROM v")
given("html_text", [ID, ("h", "string")], HTML, lambda v: v.select("id", H.text(F.col("h")).alias("value")), None)
given("html_links", [ID, ("h", "string")], HTML, lambda v: v.select("id", F.explode(H.links(F.col("h"))).alias("l")).select("id", "l.href", "l.anchor"), """SELECT id::BIGINT AS id, regexp_extract(a, 'href="([^"]+)"', 1) AS href, trim(regexp_replace(a, '<[^>]+>', '', 'g'), ' ') AS anchor FROM (SELECT id, unnest(regexp_extract_all(h, '(?is)<a [^>]*href="http[^"]+"[^>]*>.*?</a>')) AS a FROM v)""")
given("html_tables", [ID, ("h", "string")], HTML, lambda v: v.select("id", F.explode(H.tables(F.col("h"))).alias("t")).select("id", F.size("t").alias("rows"), F.array_join(F.flatten("t"), "|").alias("cells")), None)
given("html_images", [ID, ("h", "string")], HTML, lambda v: v.select("id", F.explode(H.images(F.col("h"), F.lit("https://base.org/dir/page"))).alias("src")), None)
given("notebook_text", [ID, ("j", "string")], [(1, '{"cells": [{"cell_type": "markdown", "source": ["# H\\n", "text"]}, {"cell_type": "code", "source": ["x = 1"]}]}'), (2, "broken"), (3, None)], lambda v: v.select("id", H.notebook_text(F.col("j")).alias("value")), None)
given("arxiv_parse", [ID, ("x", "string")], [(1, "<entry><id>p1</id><title>T</title><published>2024-01-01</published><summary>S</summary><author><name>A</name></author><author><name>B</name></author></entry>")], lambda v: v.select("id", F.explode(H.papers(F.col("x"))).alias("p")).select("id", "p.title", F.array_join("p.authors", ";").alias("authors")), "SELECT id::BIGINT AS id, regexp_extract(x, '<title>(.*?)</title>', 1) AS title, array_to_string(regexp_extract_all(x, '<name>(.*?)</name>', 1), ';') AS authors FROM v")
given("series_observations", [ID, ("j", "string")], [(1, '{"series_id": "S1", "observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-02-01", "value": "."}]}')], lambda v: v.select("id", F.explode(H.observations(F.col("j"))).alias("o")).select("id", "o.date", "o.value"), "SELECT id::BIGINT AS id, try_cast(o->>'date' AS DATE) AS date, try_cast(o->>'value' AS DOUBLE) AS value FROM (SELECT id, unnest(CAST(j->'observations' AS JSON[])) AS o FROM v)")
LINES = [("[2024-01-02 03:04:05] INFO collector - started",), ("2024-01-02 03:04:05,123 - app.core - ERROR - failed hard",), ("WARNING:root:careful",), ("free text",)]
PA, PB, PC = A.LINE_FORMATS
given(
    "log_parse", [("line", "string")], LINES, lambda v: A.parse_lines(v, "line"),
    f"""SELECT line, CASE WHEN regexp_matches(line, '{PA}') THEN regexp_extract(line, '{PA}', 1) WHEN regexp_matches(line, '{PB}') THEN regexp_extract(line, '{PB}', 1) END AS time,
      CASE WHEN regexp_matches(line, '{PA}') THEN regexp_extract(line, '{PA}', 2) WHEN regexp_matches(line, '{PB}') THEN regexp_extract(line, '{PB}', 3) WHEN regexp_matches(line, '{PC}') THEN regexp_extract(line, '{PC}', 1) ELSE 'INFO' END AS level,
      CASE WHEN regexp_matches(line, '{PA}') THEN regexp_extract(line, '{PA}', 3) WHEN regexp_matches(line, '{PB}') THEN regexp_extract(line, '{PB}', 2) WHEN regexp_matches(line, '{PC}') THEN regexp_extract(line, '{PC}', 2) ELSE 'Unknown' END AS component,
      trim(CASE WHEN regexp_matches(line, '{PA}') THEN regexp_extract(line, '{PA}', 4) WHEN regexp_matches(line, '{PB}') THEN regexp_extract(line, '{PB}', 4) WHEN regexp_matches(line, '{PC}') THEN regexp_extract(line, '{PC}', 3) ELSE line END, ' ') AS message FROM v""",
)
given("table_clean", [("a", "string"), ("b", "string")], [(" x ", "1"), ("x", "1"), (None, None), ("y", None)], lambda v: v.dropna("all").select(F.trim("a").alias("a"), F.trim("b").alias("b")).dropDuplicates(), "SELECT DISTINCT trim(a, ' ') AS a, trim(b, ' ') AS b FROM v WHERE a IS NOT NULL OR b IS NOT NULL")
given("chart_type_rules", [ID, ("t", "string")], [(1, "Bar chart of income"), (2, "scatter of x and y"), (3, "a line over time"), (4, "photo")], lambda v: v.select("id", X.cascade(F.col("t"), [("bar", ["bar"]), ("scatter", ["scatter"]), ("line", ["line", "trend"])], "unknown").alias("value")), "SELECT id::BIGINT AS id, CASE WHEN contains(lower(t), 'bar') THEN 'bar' WHEN contains(lower(t), 'scatter') THEN 'scatter' WHEN contains(lower(t), 'line') OR contains(lower(t), 'trend') THEN 'line' ELSE 'unknown' END AS value FROM v")
CANDS = [(1, "q1", "pdf", 12.0, 2021), (2, "q1", "epub", 3.0, 2023), (3, "q2", "pdf", 700.0, 1990), (4, "q2", "pdf", 5.0, 1995), (5, "q3", "txt", None, None)]


def rank(v):
    score = F.when(F.col("format") == "pdf", 10).when(F.col("format") == "epub", 5).otherwise(0) + F.when(F.col("mb").between(1, 50), 5).otherwise(0) + F.when(F.col("year") >= 2020, 3).otherwise(0)
    return E.best_of(v, "query", score, "id")


given("rank_candidates", [ID, ("query", "string"), ("format", "string"), ("mb", "double"), ("year", "int")], CANDS, rank, """SELECT query, id::BIGINT AS id, s AS score FROM (SELECT *, CASE format WHEN 'pdf' THEN 10 WHEN 'epub' THEN 5 ELSE 0 END + CASE WHEN mb BETWEEN 1 AND 50 THEN 5 ELSE 0 END + CASE WHEN "year" >= 2020 THEN 3 ELSE 0 END AS s FROM v) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) = 1""")

CODE = [(1, "symbol = 'BTC/USD'\nx = 'AAA/BBB'\npair: \"ETH/EUR\", 'BTC/USD'"), (2, ""), (3, None)]
given(
    "code_pairs", [ID, ("c", "string")], CODE,
    lambda v: v.select("id", F.explode(F.filter(F.split("c", "\n"), lambda x: F.lower(x).rlike("symbol|pair|ticker"))).alias("l")).select("id", F.explode(F.regexp_extract_all("l", F.lit("['\"]([A-Z]{2,6}/[A-Z]{2,6})['\"]"), F.lit(1))).alias("pair")).distinct(),
    "SELECT DISTINCT id::BIGINT AS id, pair FROM (SELECT id, unnest(regexp_extract_all(l, '[''\"]([A-Z]{2,6}/[A-Z]{2,6})[''\"]', 1)) AS pair FROM (SELECT id, unnest(string_split(c, chr(10))) AS l FROM v) WHERE regexp_matches(lower(l), 'symbol|pair|ticker'))",
)
given("notebook_summary", [ID, ("j", "string")], [(1, '{"cells": [{"cell_type": "markdown", "source": ["# Head\\n", "text"]}, {"cell_type": "code", "source": ["import numpy\\n", "x = 1"]}]}'), (2, "broken")], lambda v: v.select("id", H.notebook_summary(F.col("j")).alias("s")).select("id", "s.title", "s.code_cells", "s.modules"), None)


def docs(s, d):
    return table(s, d, "documents")


def near_texts(s, d):
    """(i, j, a, b): the near-duplicate pairs with their texts."""
    return near.linked_texts(docs(s, d), "doc_id", "text")


# the same operators over whole tables
R.add("jaccard_pairs_documents", lambda s, d: near_texts(s, d).select("i", "j", F.round(X.word_jaccard(F.col("a"), F.col("b")), 6).alias("value")))
R.add("char_similarity_documents", lambda s, d: near_texts(s, d).select("i", "j", F.round(X.char_similarity(F.col("a"), F.col("b")), 6).alias("value")))
R.add("markdown_strip_documents", lambda s, d: docs(s, d).select("doc_id", X.markdown_strip(F.col("text")).alias("value")), r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '(?m)^#{1,6} +', '', 'g'), '[*]{1,3}', '', 'g'), ' ') AS value FROM documents""")
R.add("formula_complexity_documents", lambda s, d: E.formulas(docs(s, d), "doc_id", "text").select("doc_id", "type", "formula", E.complexity(F.col("formula")).alias("value")))
R.add("log_parse_activity", lambda s, d: A.parse_lines(table(s, d, "activity_log").select(F.col("message").alias("line")), "line"))

QUERIES, SQL = R.queries, R.sql
