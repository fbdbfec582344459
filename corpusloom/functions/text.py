"""Column functions over text; all native expressions that stay inside generated code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[^ \t\n\r\f]+"
# Words left out of titles that are compared.
TITLE_STOP = ("a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def ngrams(arr: Column, n: int) -> Column:
    """Array of the n-grams of an array of words, joined by blanks; empty for fewer words.

    The shifted copies are zipped, so that the words are computed n times and not once per n-gram.
    """
    count = F.greatest(F.size(arr) - (n - 1), F.lit(0))
    z = F.arrays_zip(*[F.slice(arr, F.lit(k + 1), count).alias(f"g{k}") for k in range(n)])
    return F.transform(z, lambda x: F.concat_ws(" ", *[x[f"g{k}"] for k in range(n)]))


def token_count(c: Column) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0)).cast("long")


def normalize_text(c: Column) -> Column:
    """Lower case, white space collapsed, then everything but word characters and blanks dropped, then trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[ \t\n\r\f]+", " "), r"[^\p{L}\p{N}_ ]", ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the word sets of two normalised texts; 0 for an empty union."""
    x, y = F.array_distinct(words(normalize_text(a))), F.array_distinct(words(normalize_text(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def title_norm_simple(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ ]", ""))


def title_norm(c: Column) -> Column:
    kept = F.filter(F.split(title_norm_simple(c), " +"), lambda w: ~w.isin(*TITLE_STOP) & (w != ""))
    return F.array_join(kept, " ")


def safe_filename(c: Column, limit: int = 128) -> Column:
    kept = F.regexp_replace(c, r"[^\p{L}\p{N} ._-]", "")
    return F.substring(F.regexp_replace(F.trim(kept), r"[ _]+", "_"), 1, limit)


def markdown_strip(c: Column) -> Column:
    """Code fences first, then images, links, inline code, headings and emphasis marks."""
    c = F.regexp_replace(c, r"(?s)```.*?```", " ")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"`([^`]*)`", "$1")
    c = F.regexp_replace(c, r"(?m)^#{1,6} +", "")
    return F.trim(F.regexp_replace(c, r"[*]{1,3}", ""))


def file_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext.isin("py", "js", "java"), "code").when(ext == "ipynb", "notebook").when(ext.isin("md", "markdown"), "markdown")
        .when(ext.isin("html", "htm"), "html").when(ext.isin("json", "jsonl"), "json").when(ext.isin("csv", "tsv"), "table")
        .when(ext == "pdf", "pdf").when(ext == "txt", "text")
    )


def format_size(c: Column) -> Column:
    x = c.cast("double")
    out = F.format_string("%.2f PB", x / 1024.0**5)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(x < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", x / 1024.0**k)).otherwise(out)
    return out


def parse_size_mb(c: Column) -> Column:
    n = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1)
    v = F.when(n != "", n).cast("double")
    u = F.upper(F.regexp_extract(c, r"(?i)(GB|MB|KB|B)\b", 1))
    return F.when(u == "GB", v * 1024).when(u == "MB", v).when(u == "KB", v / 1024).when(u == "B", v / 1048576)


def extract_date(c: Column) -> Column:
    """First of: ISO date, slash date, four-digit year."""
    found = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(found(r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), found(r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"), found(r"\b((?:19|20)[0-9]{2})\b"))


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDhhmmss to a timestamp text; what does not parse comes back as it is."""
    t = F.try_to_timestamp(F.regexp_extract(c, r"^D:([0-9]{14})", 1), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), c)


def keyword_hits(c: Column, terms: list[str]) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(t) for t in sorted(terms)]), lambda t: F.contains(low, t))


def char_similarity(a: Column, b: Column) -> Column:
    """Equal characters at the same place over the longer length."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda v: F.coalesce(v, F.lit(False))))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(same / longest)


def cascade(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule with a keyword that occurs in the lower-case text."""
    low = F.lower(c)
    out = None
    for label, keys in rules:
        cond = F.lit(False)
        for k in keys:
            cond |= F.contains(low, F.lit(k))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def chunk_limits(text: str, size: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``size`` characters that end behind the last sentence mark inside, where there is
    one beyond the overlap; the next chunk begins ``overlap`` characters before the end of the last."""
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            for mark in (". ", "! ", "? ", "\n\n"):
                at = text.rfind(mark, start, end)
                if at + len(mark) > start + overlap:
                    end = at + len(mark)
                    break
        out.append((start, end))
        if end >= len(text):
            return out
        start = end - overlap


def sentence_chunks(col: str, size: int = 1000, overlap: int = 100) -> Column:
    """Array of (chunk_no, start, n_chars); an Arrow pass, as each chunk depends on the one before."""
    @F.pandas_udf("array<struct<chunk_no:long,start:long,n_chars:long>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"chunk_no": k, "start": a, "n_chars": b - a} for k, (a, b) in enumerate(chunk_limits(t, size, overlap))] if t else [])

    return run(col)
