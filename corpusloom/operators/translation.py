"""Likely machine translation: seven heuristics measured in one Arrow pass, decided in native expressions.

Words are Unicode word runs; n-grams take white-space tokens. A text with a line that looks like code, and a text of an
excluded domain, is never flagged. Null texts have no measures, score 0 and no flag.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases, word lists and thresholds that the results depend on.
DISCLAIMERS = (
    "translated by", "machine translation", "automatic translation", "originally written in", "this document was automatically translated", "translation provided by", "translated from", "google translate",
)
FUNCTION_WORDS = (
    "the a an in on at by for with to from of and or but as if than then when while where after before above below over under again further once about against between into through during without within along across behind beyond plus except up down off out around near"
).split()
COMMON_WORDS = "the be to of and a in that have i it for not on with he as you do at".split()
EXCLUDED_DOMAINS = ("blockchain", "cryptocurrency", "API", "function", "parameter")
GRAMS, GRAMS_CODE, RARE, RARE_CODE, FUNCTION, ARTICLE, TENSE = 4, 6, 0.15, 0.25, 0.7, 0.08, 0.12
POINTS = {"disclaimer": 50, "phrase": 30, "minor": 10}

# Patterns of sentence ends, code and list lines.
_WORD = re.compile(r"\w+")
_RUNS = re.compile(r"\w+|\W+")
_SENTENCE = re.compile(r"[.!?\n]")
_CODE = re.compile(r"(def |class |[a-zA-Z_][a-zA-Z0-9_]* ?=)")
_LISTS = (re.compile(r"[0-9]+\. "), re.compile(r"[-*] "))
_DISCLAIMER = re.compile("|".join(DISCLAIMERS), re.IGNORECASE)
_ARTICLE = re.compile(r"(the|a|an)\b")
_FUNCTION, _COMMON = frozenset(FUNCTION_WORDS), frozenset(COMMON_WORDS)
_BE = frozenset(("am", "is", "are", "was", "were"))

MEASURES = "words int, distinct int, disclaimer boolean, run int, gram int, listed boolean, code boolean, func_ratio double, article_ratio double, tense_ratio double, rare_ratio double"


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of MEASURES."""
    if text is None:
        return (None,) * 11
    original = _WORD.findall(text)
    words = [w.lower() for w in original]
    n = len(words)
    lines = [x for x in (y.strip() for y in text.splitlines()) if x]
    run = best = 0
    last = None
    missing = total = 0
    for s in _SENTENCE.split(text):
        s = s.strip()
        if not s:
            continue
        run = run + 1 if s == last else 1
        last, best = s, max(best, run)
        if len(s.split()) >= 5:
            total += 1
            missing += not _ARTICLE.match(s.lower())
    tokens = text.split()
    gram = max(Counter(zip(tokens, tokens[1:], tokens[2:])).values(), default=0)
    function = sum(w in _FUNCTION for w in words)
    forms = sum(len(w) > 2 and w.endswith("ed") or len(w) > 3 and w.endswith("ing") for w in original)
    odd = 0
    if forms:
        runs = _RUNS.findall(text)
        for k in range(len(runs) - 2):
            a = runs[k]
            if a in _BE and runs[k + 2].endswith("ing") and len(runs[k + 2]) > 3 or a == "had" and runs[k + 2].endswith("ed") and len(runs[k + 2]) > 2:
                odd += runs[k + 1].isspace()
    return (
        n, len(set(words)), bool(_DISCLAIMER.search(text)), best, gram, any(all(p.match(x) for x in lines) for p in _LISTS), any(_CODE.match(x) for x in lines),
        function / (n - function) if n > function else 0.0, missing / total if total else 0.0, odd / forms if forms else 0.0, sum(w not in _COMMON for w in words) / n if n else 0.0,
    )


def measures(text_col: str) -> Column:
    """Struct of the measures; one Arrow pass."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=names, dtype=object)

    return run(text_col)


def detect(df: DataFrame, id_col: str, text_col: str, domain: Column | None = None, code_file: Column | None = None) -> DataFrame:
    """(id, score, confidence, flag, severity). ``code_file`` marks rows from source files, which get looser thresholds."""
    is_code = F.coalesce(code_file, F.lit(False)) if code_file is not None else F.lit(False)
    excluded = F.coalesce(domain.isin(*EXCLUDED_DOMAINS), F.lit(False)) if domain is not None else F.lit(False)
    d = df.select(id_col, is_code.alias("c"), excluded.alias("x"), measures(text_col).alias("m")).select(id_col, "c", "x", "m.*")
    col = F.col
    short = col("words") < 200
    need = F.when(col("c"), GRAMS_CODE).otherwise(GRAMS) - F.when(short, 1).otherwise(0)
    gram = F.when((col("gram") >= need) & ~col("listed"), 10 + 5 * F.greatest(col("gram") - 2, F.lit(0))).otherwise(0)
    disclaimer, phrase = col("disclaimer"), col("run") >= 3
    func = (col("words") >= 100) & (col("func_ratio") > F.when(col("words") > 500, FUNCTION * 0.9).otherwise(FUNCTION))
    article = (col("words") >= 25) & (col("article_ratio") > ARTICLE)
    tense = col("tense_ratio") > TENSE
    rare = (col("distinct") >= 50) & (col("rare_ratio") > F.when(col("c"), RARE_CODE).otherwise(RARE))
    d = d.select(id_col, (col("x") | col("code") | col("words").isNull()).alias("exempt"), short.alias("short"), (col("words") < 100).alias("tiny"), gram.alias("g"), *[c.alias(n) for c, n in ((disclaimer, "d"), (phrase, "p"), (func, "f"), (article, "a"), (tense, "t"), (rare, "r"))])
    minor = sum((col(n).cast("int") for n in "fatr"), F.lit(0))
    weight = F.when(col("d"), 1.0).otherwise(0.0) + F.when(col("p"), 0.9).otherwise(0.0) + F.when(col("g") >= 20, 0.9).when(col("g") > 0, 0.7).otherwise(0.0)
    weight = weight + 0.5 * (minor - col("a").cast("int")) + F.when(col("a"), F.when(col("tiny"), 0.25).otherwise(0.5)).otherwise(0.0)
    score = F.least(F.lit(100), F.when(col("d"), POINTS["disclaimer"]).otherwise(0) + F.when(col("p"), POINTS["phrase"]).otherwise(0) + col("g") + POINTS["minor"] * minor)
    d = d.select(id_col, "exempt", "short", "g", minor.alias("n"), ((col("d") | col("p")) | (col("g") > 0)).alias("major"), ((col("d") | col("p")) & (col("g") == 0) & (minor == 0)).alias("only_major"), score.alias("s"), F.least(F.lit(1.0), weight).alias("w"))
    free = col("exempt") | (col("short") & (col("n") < 2) & ~col("major"))
    few = col("short") & (col("n") >= 2)
    heavy = col("g") >= 20
    flag = F.when(free, False).when(few | heavy | (col("g") > 0), True).otherwise(((col("s") >= 30) | col("only_major")) & (col("w") > 0.5))
    confidence = F.when(free, 0.0).when(few, F.least(F.lit(0.8), 0.4 * col("n"))).when(heavy, 0.9).otherwise(col("w"))
    severity = F.when(free, "ok").when(few, "warning").when(heavy | (col("s") >= 50), "critical").when(col("s") >= 30, "warning").otherwise("ok")
    return d.select(id_col, F.when(col("exempt"), 0).otherwise(col("s")).cast("long").alias("score"), F.round(confidence, 4).alias("confidence"), flag.alias("flag"), severity.alias("severity"))
