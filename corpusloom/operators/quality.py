"""Text-quality signals as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as X

SECTIONS = ("abstract", "introduction", "method", "results", "discussion", "conclusion", "references", "appendix", "table", "figure", "sample", "model")


def quality_flag(tokens: Column, low: int = 100, flagged: int = 500) -> Column:
    return F.when(tokens < low, "low_quality").when(tokens < flagged, "flagged").otherwise("ok")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\n\r\f]+", " "))), lambda s: s != "")


def corruption_score(c: Column, non_printable: Column, symbols: Column, diversity: Column, markers: Column) -> Column:
    """0, 40, 60 or 80: the worst breached check of non-printable characters and corruption markers (their characters
    together, as a share of the text), symbol share and word diversity."""
    n = F.greatest(F.length(c), F.lit(1))
    marked = F.aggregate(F.coalesce(markers, F.array().cast("array<string>")), F.lit(0), lambda a, m: a + F.length(c) - F.length(F.replace(c, m, F.lit(""))))
    bad = (F.size(F.regexp_extract_all(c, F.lit("[\u0000-\u0008\u000e-\u001f]"), F.lit(0))) + marked) / n
    sym = F.size(F.regexp_extract_all(c, F.lit(r"[^\p{L}\p{N}\p{Z} \t\n\r\f]"), F.lit(0))) / n
    w = X.words(c)
    div = F.when(F.size(w) == 0, 1.0).otherwise(F.size(F.array_distinct(w)) / F.size(w))
    return F.when(c.isNull(), None).otherwise(F.greatest(F.when(bad > non_printable, 80).otherwise(0), F.when(sym > symbols, 60).otherwise(0), F.when(div < diversity, 40).otherwise(0)))


def academic(c: Column) -> tuple[Column, Column, Column]:
    """(score, confidence, flag): section terms, and 2 more for over five bracketed citations."""
    cites = F.size(F.regexp_extract_all(c, F.lit(r"\[[0-9]+\]"), F.lit(0)))
    score = F.size(X.keyword_hits(c, list(SECTIONS))) + F.when(cites > 5, 2).otherwise(0)
    conf = F.least(F.lit(1.0), score / 15)
    return score.cast("long"), F.round(conf, 6), (score >= 3) & (conf > 0.3)
