"""Queries over the texts: scalar functions, quality signals, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import extract as E
from corpusloom.operators import quality as Q
from corpusloom.operators import translation as MT
from corpusloom.sources.tables import table

from ._registry import Registry

R = Registry()
W = r"[\p{L}\p{N}_]+"
TOK = r"[^ \t\n\r\f]+"


def docs(s, d):
    return table(s, d, "documents")


def each(name, col, sql_expr, more=""):
    """doc_id and one value of each document."""
    R.add(name, lambda s, d: docs(s, d).select("doc_id", col().alias("value")), f"SELECT doc_id, {sql_expr} AS value FROM documents {more}")


N_TOK = f"coalesce(len(regexp_extract_all(text, '{TOK}')), 0)"
NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'), '[^\p{L}\p{N}_ ]', '', 'g'), ' ')"
SENT = r"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f]+', ' ', 'g'), ' ')), lambda s: s <> '')"
WORDS = f"regexp_extract_all(lower(text), '{W}')"

each("token_count", lambda: X.token_count(F.col("text")), N_TOK)
each("quality_flag", lambda: Q.quality_flag(X.token_count(F.col("text"))), f"CASE WHEN {N_TOK} < 100 THEN 'low_quality' WHEN {N_TOK} < 500 THEN 'flagged' ELSE 'ok' END")
each("normalize_text", lambda: X.normalize_text(F.col("text")), NORM)
each("content_hash", lambda: F.concat_ws(":", F.md5(F.col("text")), F.sha2(F.col("text"), 256), F.sha1(F.col("text"))), "concat_ws(':', md5(text), sha256(text), sha1(text))")
each("title_norm_simple", lambda: X.title_norm_simple(F.col("title")), r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}_ ]', '', 'g'), ' ')")
STOPS = "('" + "','".join(X.TITLE_STOP) + "', '')"
TITLE = rf"array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ' '), ' +'), lambda w: w NOT IN {STOPS}), ' ')"
each("title_norm", lambda: X.title_norm(F.col("title")), TITLE)
each("safe_filename", lambda: X.safe_filename(F.col("title")), r"substring(regexp_replace(trim(regexp_replace(title, '[^\p{L}\p{N} ._-]', '', 'g'), ' '), '[ _]+', '_', 'g'), 1, 128)")
each("text_integrity", lambda: F.coalesce((F.octet_length(F.col("text")) >= 100) & (F.trim(F.col("text")) != ""), F.lit(False)), "coalesce(octet_length(encode(text)) >= 100 AND trim(text, ' ') <> '', false)")
each("extract_date", lambda: X.extract_date(F.col("text")), r"coalesce(nullif(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), nullif(regexp_extract(text, '([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 1), ''), nullif(regexp_extract(text, '\b((?:19|20)[0-9]{2})\b', 1), ''))")
R.add("min_length_gate", lambda s, d: docs(s, d).where(F.length(F.trim(F.col("text"))) >= 1000).select("doc_id", F.length(F.trim(F.col("text"))).cast("long").alias("n")), "SELECT doc_id, length(trim(text, ' '))::BIGINT AS n FROM documents WHERE length(trim(text, ' ')) >= 1000")
KEYS = ["latency", "volatility", "liquidity", "risk"]
R.add("keyword_filter", lambda s, d: docs(s, d).where(F.size(X.keyword_hits(F.col("text"), KEYS)) > 0).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'latency') OR contains(lower(text), 'volatility') OR contains(lower(text), 'liquidity') OR contains(lower(text), 'risk')")
R.add(
    "keyword_tags",
    lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.array_join(X.keyword_hits(F.col("text"), KEYS), ",").alias("tags")),
    "SELECT doc_id, array_to_string(list_filter(['latency', 'liquidity', 'risk', 'volatility'], lambda k: contains(lower(text), k)), ',') AS tags FROM documents WHERE text IS NOT NULL",
)
RULES = [("risk", ["risk", "margin"]), ("markets", ["order book", "spread"]), ("tokens", ["token", "pool"])]
each(
    "route_by_rules", lambda: F.when(F.col("text").isNull(), "general").otherwise(X.cascade(F.col("text"), RULES, "general")),
    "CASE WHEN contains(lower(text), 'risk') OR contains(lower(text), 'margin') THEN 'risk' WHEN contains(lower(text), 'order book') OR contains(lower(text), 'spread') THEN 'markets' WHEN contains(lower(text), 'token') OR contains(lower(text), 'pool') THEN 'tokens' ELSE 'general' END",
)
R.add(
    "quality_limits",
    lambda s, d: docs(s, d).select("doc_id", X.token_count(F.col("text")).between(50, 100_000).alias("tokens_ok"), F.coalesce((F.length(F.regexp_replace(F.col("text"), r"[ \t\n\r\f]+", "")) / F.nullif(X.token_count(F.col("text")), F.lit(0))).between(3.0, 12.0), F.lit(False)).alias("word_length_ok")),
    rf"SELECT doc_id, {N_TOK} BETWEEN 50 AND 100000 AS tokens_ok, coalesce(length(regexp_replace(text, '[ \t\n\r\f]+', '', 'g')) / nullif({N_TOK}, 0) BETWEEN 3.0 AND 12.0, false) AS word_length_ok FROM documents",
)
# machine translation: the rules once more in SQL, by lists
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _in(words):
    return "('" + "','".join(words) + "')"


MT_LISTS = rf"""SELECT doc_id, domain, text, regexp_extract_all(text, '{W}') AS o, regexp_extract_all(lower(text), '{W}') AS w,
    list_filter(list_transform(string_split_regex(text, '[.!?\n]'), lambda x: {_strip('x')}), lambda x: x <> '') AS s, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS t,
    list_filter(list_transform(string_split_regex(text, '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_strip('x')}), lambda x: x <> '') AS l,
    regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS r FROM documents"""
MT_SQL = rf"""WITH l0 AS ({MT_LISTS}),
  l1 AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: i = 1 OR s[i] <> s[i - 1]) AS b, list_filter(s, lambda x: len(list_filter(string_split_regex(x, '{WS}+'), lambda y: y <> '')) >= 5) AS long,
    len(list_filter(w, lambda x: x IN {_in(MT.FUNCTION_WORDS)})) AS fn, len(list_filter(o, lambda x: regexp_matches(x, '.(ed)$') OR regexp_matches(x, '.(ing)$'))) AS forms,
    len(list_filter(range(1, len(r) - 1), lambda i: regexp_full_match(r[i + 1], '{WS}+') AND ((r[i] IN ('am','is','are','was','were') AND regexp_matches(r[i + 2], '.ing$')) OR (r[i] = 'had' AND regexp_matches(r[i + 2], '.ed$'))))) AS odd FROM l0),
  m AS (SELECT doc_id, domain, text, len(w)::INT AS words, len(list_distinct(w))::INT AS "distinct", regexp_matches(text, '(?i){"|".join(MT.DISCLAIMERS)}') AS disclaimer,
    coalesce(list_max(list_transform(range(1, len(b) + 1), lambda k: coalesce(b[k + 1], len(s) + 1) - b[k])), 0)::INT AS run,
    coalesce(list_max(map_values(list_aggregate(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' ')), 'histogram'))), 0)::INT AS gram,
    len(list_filter(l, lambda x: NOT regexp_matches(x, '^[0-9]+\. '))) = 0 OR len(list_filter(l, lambda x: NOT regexp_matches(x, '^[-*] '))) = 0 AS listed,
    len(list_filter(l, lambda x: regexp_matches(x, '^(def |class |[a-zA-Z_][a-zA-Z0-9_]* ?=)'))) > 0 AS code,
    CASE WHEN len(w) > fn THEN fn::DOUBLE / (len(w) - fn) ELSE 0.0 END AS func_ratio,
    CASE WHEN len(long) > 0 THEN len(list_filter(long, lambda x: NOT regexp_matches(lower(x), '^(the|a|an)($|[^\p{{L}}\p{{N}}_])')))::DOUBLE / len(long) ELSE 0.0 END AS article_ratio,
    CASE WHEN forms > 0 THEN odd::DOUBLE / forms ELSE 0.0 END AS tense_ratio,
    CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x NOT IN {_in(MT.COMMON_WORDS)}))::DOUBLE / len(w) ELSE 0.0 END AS rare_ratio FROM l1)"""
for _name, _field in (("mt_disclaimer", "disclaimer"), ("mt_func_ratio", "func_ratio"), ("mt_missing_article", "article_ratio"), ("mt_verb_tense", "tense_ratio"), ("mt_rare_word", "rare_ratio"), ("mt_ngram", "gram"), ("mt_repeated_phrase", "run")):
    R.add(
        _name, lambda s, d, f=_field: docs(s, d).select("doc_id", MT.measures("text").getField(f).alias("value")).select("doc_id", F.round("value", 6).alias("value") if f.endswith("ratio") else "value"),
        f"{MT_SQL} SELECT doc_id, CASE WHEN text IS NOT NULL THEN {f'round({_field}, 6)' if _field.endswith('ratio') else _field} END AS value FROM m",
    )
R.add(
    "mt_detect", lambda s, d: MT.detect(docs(s, d), "doc_id", "text", F.col("domain")),
    rf"""{MT_SQL},
      h AS (SELECT doc_id, text IS NULL OR code OR coalesce(domain IN {_in(MT.EXCLUDED_DOMAINS)}, false) AS exempt, words < 200 AS short, words < 100 AS tiny, disclaimer AS d, run >= 3 AS p,
        CASE WHEN gram >= CASE WHEN words < 200 THEN 3 ELSE 4 END AND NOT listed THEN 10 + 5 * greatest(gram - 2, 0) ELSE 0 END AS g,
        words >= 100 AND func_ratio > CASE WHEN words > 500 THEN 0.7::DOUBLE * 0.9::DOUBLE ELSE 0.7::DOUBLE END AS f, words >= 25 AND article_ratio > 0.08 AS a, tense_ratio > 0.12 AS t, "distinct" >= 50 AND rare_ratio > 0.15 AS r FROM m),
      n AS (SELECT *, f::INT + a::INT + t::INT + r::INT AS n, d OR p OR g > 0 AS major FROM h),
      q AS (SELECT *, least(100, 50 * d::INT + 30 * p::INT + g + 10 * n) AS s, (d OR p) AND g = 0 AND n = 0 AS alone,
        least(1.0::DOUBLE, d::INT + 0.9::DOUBLE * p::INT + CASE WHEN g >= 20 THEN 0.9::DOUBLE WHEN g > 0 THEN 0.7::DOUBLE ELSE 0 END + 0.5::DOUBLE * (n - a::INT) + CASE WHEN a THEN CASE WHEN tiny THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END ELSE 0 END) AS w FROM n)
      SELECT doc_id, CASE WHEN exempt THEN 0 ELSE s END::BIGINT AS score,
        round(CASE WHEN exempt OR (short AND n < 2 AND NOT major) THEN 0.0::DOUBLE WHEN short AND n >= 2 THEN least(0.8::DOUBLE, 0.4::DOUBLE * n) WHEN g >= 20 THEN 0.9::DOUBLE ELSE w END, 4) AS confidence,
        CASE WHEN exempt OR (short AND n < 2 AND NOT major) THEN false WHEN short AND n >= 2 THEN true WHEN g > 0 THEN true ELSE (s >= 30 OR alone) AND w > 0.5 END AS flag,
        CASE WHEN exempt OR (short AND n < 2 AND NOT major) THEN 'ok' WHEN short AND n >= 2 THEN 'warning' WHEN g >= 20 OR s >= 50 THEN 'critical' WHEN s >= 30 THEN 'warning' ELSE 'ok' END AS severity FROM q""",
)


def corruption(s, d):
    c = table(s, d, "quality_config").where("active").limit(1).select("non_printable_ratio_threshold", "symbol_ratio_threshold", "word_diversity_threshold", "known_corruption_markers")
    j = docs(s, d).select("doc_id", "text").join(F.broadcast(c))  # one row
    return j.select("doc_id", Q.corruption_score(F.col("text"), F.col("non_printable_ratio_threshold"), F.col("symbol_ratio_threshold"), F.col("word_diversity_threshold"), F.col("known_corruption_markers")).alias("score"))


CORRUPT = rf"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE greatest(
  CASE WHEN (len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1f]')) + coalesce(list_sum(list_transform(known_corruption_markers, lambda m: length(text) - length(replace(text, m, '')))), 0))::DOUBLE / greatest(length(text), 1) > non_printable_ratio_threshold THEN 80 ELSE 0 END,
  CASE WHEN len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\p{{Z}} \t\n\r\f]'))::DOUBLE / greatest(length(text), 1) > symbol_ratio_threshold THEN 60 ELSE 0 END,
  CASE WHEN (CASE WHEN len({WORDS}) = 0 THEN 1.0 ELSE len(list_distinct({WORDS}))::DOUBLE / len({WORDS}) END) < word_diversity_threshold THEN 40 ELSE 0 END) END::INT AS score
  FROM documents, (SELECT * FROM quality_config WHERE active LIMIT 1)"""
R.add("corruption_score", corruption, CORRUPT)


def quality_score(s, d):
    """0.3 translation, 0.3 language (confidence recorded with the extraction record, 0 without), 0.4 corruption, each as goodness."""
    mt = R.queries["mt_detect"](s, d).select("doc_id", (1 - F.col("score") / 100).alias("a"))
    cor = corruption(s, d).select("doc_id", (1 - F.coalesce("score", F.lit(100)) / 100).alias("b"))
    lang = table(s, d, "extraction_results").groupBy("result_id").agg(F.max("language_confidence").alias("c"))
    lang = docs(s, d).select("doc_id", "result_id").join(lang, "result_id", "left").select("doc_id", F.coalesce("c", F.lit(0.0)).alias("c"))
    total = 0.3 * F.col("a") + 0.3 * F.col("c") + 0.4 * F.col("b")
    return mt.join(cor, "doc_id").join(lang, "doc_id").select("doc_id", F.round(total, 6).alias("score"), (F.round(total, 9) >= 0.7).alias("good"))


R.add(
    "quality_score", quality_score,
    f"""SELECT doc_id, round(0.3::DOUBLE * a + 0.3::DOUBLE * c + 0.4::DOUBLE * b, 6) AS score, round(0.3::DOUBLE * a + 0.3::DOUBLE * c + 0.4::DOUBLE * b, 9) >= 0.7::DOUBLE AS good FROM
      (SELECT doc_id, 1 - score / 100.0::DOUBLE AS a FROM ({R.sql['mt_detect']})) JOIN (SELECT doc_id, 1 - coalesce(score, 100) / 100.0::DOUBLE AS b FROM ({CORRUPT})) USING (doc_id)
      JOIN (SELECT d.doc_id, coalesce(l.c, 0.0) AS c FROM documents d LEFT JOIN (SELECT result_id, max(language_confidence) AS c FROM extraction_results GROUP BY 1) l USING (result_id)) USING (doc_id)""",
)
SECT = "['" + "','".join(sorted(Q.SECTIONS)) + "']"
ACAD = rf"(len(list_filter({SECT}, lambda k: contains(lower(text), k))) + CASE WHEN len(regexp_extract_all(text, '\[[0-9]+\]')) > 5 THEN 2 ELSE 0 END)"
R.add(
    "academic_detect", lambda s, d: docs(s, d).where("text is not null").select("doc_id", *[c.alias(n) for c, n in zip(Q.academic(F.col("text")), ("score", "confidence", "flag"))]),
    f"SELECT doc_id, {ACAD} AS score, round(least(1.0::DOUBLE, {ACAD} / 15.0::DOUBLE), 6) AS confidence, {ACAD} >= 3 AND {ACAD} / 15.0::DOUBLE > 0.3::DOUBLE AS flag FROM documents WHERE text IS NOT NULL",
)
R.add(
    "academic_validate", lambda s, d: docs(s, d).where("text is not null").select("doc_id", (X.token_count(F.col("text")) >= 200).alias("long_enough"), F.round(1000 * F.size(F.regexp_extract_all(F.col("text"), F.lit(r"\[[0-9]+\]"), F.lit(0))) / F.greatest(X.token_count(F.col("text")), F.lit(1)), 4).alias("reference_density"), (F.size(X.keyword_hits(F.col("text"), list(Q.SECTIONS))) >= 3).alias("sections_ok")),
    rf"SELECT doc_id, {N_TOK} >= 200 AS long_enough, round(1000 * len(regexp_extract_all(text, '\[[0-9]+\]'))::DOUBLE / greatest({N_TOK}, 1), 4) AS reference_density, len(list_filter({SECT}, lambda k: contains(lower(text), k))) >= 3 AS sections_ok FROM documents WHERE text IS NOT NULL",
)
each("scientific_paper", lambda: F.coalesce((F.size(X.keyword_hits(F.col("text"), list(Q.SECTIONS))) >= 3) | (F.col("text").rlike("(?i)we model|hypothes") & F.col("text").rlike(r"\[[0-9]+\]")), F.lit(False)), rf"coalesce(len(list_filter({SECT}, lambda k: contains(lower(text), k))) >= 3 OR (regexp_matches(text, '(?i)we model|hypothes') AND regexp_matches(text, '\[[0-9]+\]')), false)")


def _sym(k):
    p = E.SYMBOL_PATTERNS[k][0].replace("(?![A-Za-z0-9_])", r"\b")
    hits = f"regexp_extract_all(text, '{chr(92)}b{p}{chr(92)}b')" if k in E.WHOLE else f"regexp_extract_all(text, '{p}')"
    return f"list_filter({hits}, lambda w: w NOT IN {E.NO_TICKERS})" if k == "stock_ticker" else hits


SYM = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest({_sym(k)}) AS symbol FROM documents" for k in E.SYMBOL_PATTERNS)
SYMS = f"SELECT doc_id, type, symbol, count(*) AS n FROM ({SYM}) GROUP BY ALL"
R.add("symbols", lambda s, d: E.symbols(docs(s, d), "doc_id", "text"), SYMS)
R.add("symbol_positions", lambda s, d: E.symbol_positions(docs(s, d), "doc_id", "text"))
PRIOR = " ".join(f"WHEN '{k}' THEN {v}" for k, (_, v) in E.SYMBOL_PATTERNS.items())
V_DICT = "('ETH', 'coin'), ('BTC', 'coin'), ('USD', 'currency'), ('EUR', 'currency'), ('NYSE', 'venue')"


def classified(s, d):
    known = s.sql(f"SELECT * FROM VALUES {V_DICT} AS t(symbol, meaning)")
    prior = F.lit(None).cast("double")
    for k, (_, v) in E.SYMBOL_PATTERNS.items():
        prior = F.when(F.col("type") == k, v).otherwise(prior)
    j = E.symbols(docs(s, d), "doc_id", "text").join(F.broadcast(known), "symbol", "left")  # five rows
    return j.select("doc_id", "type", "symbol", F.coalesce("meaning", "type").alias("class"), F.when(F.col("meaning").isNotNull(), 1.0).otherwise(prior).alias("confidence"), "n")


CLASSED = f"SELECT doc_id, type, symbol, coalesce(meaning, type) AS class, CASE WHEN meaning IS NOT NULL THEN 1.0::DOUBLE ELSE (CASE type {PRIOR} END)::DOUBLE END AS confidence, n FROM ({SYMS}) LEFT JOIN (VALUES {V_DICT}) t(symbol, meaning) USING (symbol)"
R.add("symbol_classify", classified, CLASSED)
R.add("symbol_validate", lambda s, d: classified(s, d).where("type = 'stock_ticker'").groupBy("symbol").agg(F.sum("n").alias("n"), F.max(F.col("confidence") == 1.0).alias("known")), f"SELECT symbol, sum(n)::BIGINT AS n, max(confidence = 1.0) AS known FROM ({CLASSED}) WHERE type = 'stock_ticker' GROUP BY symbol")
R.add(
    "symbol_stats",
    lambda s, d: E.symbols(docs(s, d), "doc_id", "text").groupBy("doc_id").agg(F.sum("n").alias("total"), F.count_distinct("symbol").alias("unique")).join(docs(s, d).select("doc_id", F.length("text").alias("len")), "doc_id").select("doc_id", "total", "unique", F.round(F.col("total") / (F.col("len") / 1000), 6).alias("density")),
    f"SELECT doc_id, total, uniq AS unique, round(total / (length(text) / 1000.0::DOUBLE), 6) AS density FROM (SELECT doc_id, sum(n)::BIGINT AS total, count(DISTINCT symbol) AS uniq FROM ({SYMS}) GROUP BY doc_id) JOIN documents USING (doc_id)",
)
R.add("symbol_glossary", lambda s, d: E.symbols(docs(s, d), "doc_id", "text").groupBy("symbol", "type").agg(F.sum("n").alias("occurrences"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")), f"SELECT symbol, type, sum(n)::BIGINT AS occurrences, count(*) AS docs, min(doc_id) AS first_doc FROM ({SYMS}) GROUP BY ALL")


def _form(k):
    f = f"list_distinct(regexp_extract_all(text, '{E.FORMULA_PATTERNS[k]}', 1))"
    braces = " AND length(replace(f, '{', '')) = length(replace(f, '}', ''))" if "latex" in k else ""
    return rf"list_filter({f}, lambda f: length(f) BETWEEN 3 AND 1000 AND NOT regexp_matches(trim(f, ' '), '^([0-9]+|[a-zA-Z]+|[ \t\n\r\f]*)\z'){braces})"


FORM = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest({_form(k)}) AS formula FROM documents" for k in E.FORMULA_PATTERNS)
R.add("formulas", lambda s, d: E.formulas(docs(s, d), "doc_id", "text"), FORM)
LIGHT = ("inline_latex", "display_latex", "fractions", "percentage")
R.add("formulas_light", lambda s, d: E.formulas(docs(s, d), "doc_id", "text").where(F.col("type").isin(*LIGHT)).select("doc_id", "formula").distinct(), f"SELECT DISTINCT doc_id, formula FROM ({FORM}) WHERE type IN {LIGHT}")
DEPTH = "greatest(coalesce(list_max(list_transform(range(1, length(formula) + 1), lambda i: (length(replace(formula[1:i], '}', '')) - length(replace(formula[1:i], '{', ''))))), 0), 0)"
COMPLEX = rf"least(1.0::DOUBLE, 0.2::DOUBLE * {DEPTH} + 0.1::DOUBLE * len(regexp_extract_all(formula, '\\[a-zA-Z]+')) + 0.05::DOUBLE * len(regexp_extract_all(formula, '[-+*/=<>≤≥≠∈∉⊂⊃∩∪]')))"
R.add("formula_stats", lambda s, d: E.formulas(docs(s, d), "doc_id", "text").select("type", E.complexity(F.col("formula")).alias("c")).groupBy("type", F.when(F.col("c") < 0.3, "simple").when(F.col("c") < 0.7, "medium").otherwise("complex").alias("bucket")).agg(F.count("*").alias("n")), f"SELECT type, CASE WHEN round({COMPLEX}, 4) < 0.3 THEN 'simple' WHEN round({COMPLEX}, 4) < 0.7 THEN 'medium' ELSE 'complex' END AS bucket, count(*) AS n FROM ({FORM}) GROUP BY ALL")
MARKS = " + ".join(f"contains(formula, '{m}')::INT" for m in (chr(92), "^", "_", "{", "}", "sum", "int", "frac", "sqrt"))
R.add(
    "formula_details", lambda s, d: E.formulas(docs(s, d), "doc_id", "text").select("doc_id", "type", "formula", E.formula_confidence(F.col("formula"), F.col("type")).alias("confidence"), E.complexity(F.col("formula")).alias("complexity"), *E.formula_metadata(F.col("formula"))),
    rf"""SELECT doc_id, type, formula, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN contains(type, 'env') THEN 0.3::DOUBLE WHEN contains(type, 'latex') THEN 0.2::DOUBLE ELSE 0 END
        + least(0.3::DOUBLE, 0.05::DOUBLE * ({MARKS})) - CASE WHEN length(formula) < 5 THEN 0.2::DOUBLE ELSE 0 END)), 4) AS confidence, round({COMPLEX}, 4) AS complexity, length(formula)::INT AS length,
      regexp_matches(formula, '\\[a-zA-Z]+') AS has_commands, contains(formula, '^') AS has_superscript, contains(formula, '_') AS has_subscript, regexp_matches(formula, 'frac|/') AS has_fractions,
      regexp_matches(formula, '\\int|∫') AS has_integrals, regexp_matches(formula, '\\sum|Σ') AS has_summations FROM ({FORM})""",
)


def enhancement_score(s, d):
    """.5; .1 with formulas, .15 with charts named, .1 with more than ten symbols, .15 of academic form and .1 if also valid; at most 1."""
    base = docs(s, d).where("text is not null").select("doc_id", "text")
    n_f = E.formulas(base, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("nf"))
    n_s = E.symbols(base, "doc_id", "text").groupBy("doc_id").agg(F.sum("n").alias("ns"))
    valid = R.queries["academic_validate"](s, d).select("doc_id", (F.col("long_enough") & F.col("sections_ok")).alias("v"))
    j = base.select("doc_id", Q.academic(F.col("text"))[2].alias("a"), F.col("text").rlike("(?i)(chart|figure) [0-9]").alias("c")).join(n_f, "doc_id", "left").join(n_s, "doc_id", "left").join(valid, "doc_id")
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    total = 0.5 + add(F.col("nf") > 0, 0.1) + add(F.col("c"), 0.15) + add(F.col("ns") > 10, 0.1) + add(F.col("a"), 0.15) + add(F.col("a") & F.col("v"), 0.1)
    return j.select("doc_id", F.round(F.least(F.lit(1.0), total), 4).alias("score"))


R.add(
    "enhancement_score", enhancement_score,
    rf"""SELECT d.doc_id, round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN nf > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)(chart|figure) [0-9]') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN ns > 10 THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN {ACAD} >= 3 AND {ACAD} / 15.0::DOUBLE > 0.3::DOUBLE THEN CASE WHEN {N_TOK} >= 200 THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END ELSE 0 END), 4) AS score
      FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS nf FROM ({FORM}) GROUP BY 1) f USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n) AS ns FROM ({SYMS}) GROUP BY 1) s USING (doc_id) WHERE text IS NOT NULL""",
)


def domain_classify(s, d):
    return E.classify(docs(s, d), table(s, d, "domain_config"), "doc_id", "text", "title")


RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
CLASSIFY = rf"""WITH c AS (SELECT doc_id, repeat(lower(coalesce(title, '')) || ' ', 3) || lower(coalesce(text, '')) AS c FROM documents),
  t AS (SELECT doc_id, c, regexp_extract_all(c, '{RUNS}') AS t, greatest(1, len(list_filter(string_split_regex(c, '{WS}+'), lambda x: x <> ''))) AS n FROM c),
  w AS (SELECT DISTINCT domain, k FROM (SELECT domain, unnest(string_split(lower(array_to_string(search_terms, ' ')), ' ')) AS k FROM domain_config) WHERE length(k) > 3 AND k NOT IN {E.KEYWORD_STOPS}),
  nk AS (SELECT domain, count(k) AS nk FROM domain_config LEFT JOIN w USING (domain) GROUP BY domain),
  one AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(t) AS k FROM t) GROUP BY ALL),
  many AS (SELECT doc_id, k, len(list_filter(range(1, len(t) - len(ks) + 2), lambda i: t[i] = ks[1] AND t[i:i + len(ks) - 1] = ks)) AS n
    FROM t, (SELECT DISTINCT k, regexp_extract_all(k, '{RUNS}') AS ks FROM w WHERE NOT regexp_full_match(k, '{W}')) WHERE contains(c, k)),
  h AS (SELECT doc_id, domain, sum(n) AS hits, count(*) AS found FROM (SELECT * FROM one UNION ALL SELECT * FROM many WHERE n > 0) JOIN w USING (k) GROUP BY ALL),
  s AS (SELECT t.doc_id, nk.domain, CASE WHEN nk = 0 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE * coalesce(found, 0) / nk + 0.3::DOUBLE * coalesce(hits, 0) / (n / 20.0::DOUBLE) END AS s
    FROM t CROSS JOIN nk LEFT JOIN h ON h.doc_id = t.doc_id AND h.domain = nk.domain),
  r AS (SELECT doc_id, domain, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, domain) AS r, lead(s) OVER (PARTITION BY doc_id ORDER BY s DESC, domain) AS s2 FROM s)
  SELECT doc_id, CASE WHEN s > 0 THEN domain ELSE 'unknown' END AS domain, round(s, 6) AS score, round(CASE WHEN s <= 0 OR s2 IS NULL OR s2 <= 0 THEN 0.0::DOUBLE ELSE (s - s2) / s END, 6) AS confidence FROM r WHERE r = 1"""
R.add("domain_classify", domain_classify, CLASSIFY)
R.add("relevance", lambda s, d: domain_classify(s, d).select("doc_id", F.round(F.least(F.lit(100.0), F.col("score") * 100), 2).alias("relevance"), F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.3, "medium").otherwise("low").alias("band")), f"SELECT doc_id, round(least(100.0::DOUBLE, score * 100), 2) AS relevance, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM ({CLASSIFY})")
LANGW = {"de": ["der", "die", "das", "und", "nicht"], "en": ["the", "and", "of", "that", "was"], "es": ["el", "los", "las", "una", "con"], "fr": ["le", "les", "des", "une", "dans"]}


def _known(g):
    return F.size(F.filter(X.words(F.col("s")), lambda w: w.isin(*LANGW[g]))).alias(g)


R.add(
    "lang_segments",
    lambda s, d: docs(s, d).select("doc_id", F.explode(Q.sentences(F.col("text"))).alias("s")).select("doc_id", *[_known(g) for g in LANGW])
    .select("doc_id", F.when(F.greatest(*LANGW) == 0, "unknown").otherwise(F.when(F.col("de") == F.greatest(*LANGW), "de").when(F.col("en") == F.greatest(*LANGW), "en").when(F.col("es") == F.greatest(*LANGW), "es").otherwise("fr")).alias("lang")).groupBy("doc_id", "lang").agg(F.count("*").alias("segments")),
    f"""WITH s AS (SELECT doc_id, unnest({SENT}) AS s FROM documents), n AS (SELECT doc_id, {", ".join(f"len(list_filter(regexp_extract_all(lower(s), '{W}'), lambda w: w IN {tuple(v)})) AS {g}" for g, v in LANGW.items())} FROM s),
      b AS (SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'unknown' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS lang FROM n)
      SELECT doc_id, lang, count(*) AS segments FROM b GROUP BY ALL""",
)

def lang_mixed(s, d):
    g = R.queries["lang_segments"](s, d)
    t = g.groupBy("doc_id").agg(F.sum("segments").alias("t"))
    big = g.join(t, "doc_id").where((F.col("segments") > 0.15 * F.col("t")) & (F.col("lang") != "unknown"))
    return big.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n")).select("doc_id", "langs", (F.col("n") > 1).alias("mixed"))


R.add(
    "lang_mixed", lang_mixed,
    f"SELECT doc_id, string_agg(lang, ',' ORDER BY lang) AS langs, count(*) > 1 AS mixed FROM (SELECT *, sum(segments) OVER (PARTITION BY doc_id) AS t FROM ({R.sql['lang_segments']})) WHERE segments > 0.15 * t AND lang <> 'unknown' GROUP BY doc_id",
)
R.add(
    "chunk_chars", lambda s, d: docs(s, d).where("length(text) > 0").select("doc_id", F.col("text"), F.explode(F.expr("sequence(1, greatest(1, length(text) - 100), 900)")).alias("i")).select("doc_id", ((F.col("i") - 1) / 900).cast("int").cast("long").alias("chunk_no"), F.length(F.expr("substring(text, i, 1000)")).cast("long").alias("n_chars")),
    "SELECT doc_id, ((i - 1) // 900)::BIGINT AS chunk_no, length(substring(text, i, 1000)) AS n_chars FROM (SELECT doc_id, text, unnest(range(1, greatest(1, length(text) - 100) + 1, 900)) AS i FROM documents WHERE length(text) > 0)",
)


def chunk_headers(s, d):
    """Chunks that begin at Markdown header lines; a text without any stays whole."""
    lines = F.split(F.col("text"), "\n")
    start = F.transform(lines, lambda x: F.trim(x).startswith("#"))
    cut = F.aggregate(
        F.arrays_zip(lines.alias("l"), start.alias("h")), F.array().cast("array<array<string>>"),
        lambda a, x: F.when(x["h"] | (F.size(a) == 0), F.concat(a, F.array(F.array(x["l"])))).otherwise(F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.array(x["l"]))))),
    )
    return docs(s, d).where("text is not null").select("doc_id", F.posexplode(cut).alias("chunk_no", "c")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length(F.array_join("c", "\n")).cast("long").alias("n_chars"))


R.add(
    "chunk_headers", chunk_headers,
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
      c AS (SELECT *, sum(CASE WHEN i > 1 AND starts_with(trim(x, ' '), '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS chunk_no FROM l)
      SELECT doc_id, chunk_no::BIGINT AS chunk_no, (sum(length(x)) + count(*) - 1)::BIGINT AS n_chars FROM c GROUP BY ALL""",
)
R.add("chunk_sentences", lambda s, d: docs(s, d).where("length(text) > 0").select("doc_id", F.explode(X.sentence_chunks("text")).alias("c")).select("doc_id", "c.*"))
R.add(
    "chunk_lines",
    lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.expr("""aggregate(split(text, '\\n'), named_struct('done', cast(array() as array<array<string>>), 'cur', cast(array() as array<string>), 'n', 0),
        (a, l) -> if(a.n + size(split(l, ' ')) > 100 and size(a.cur) > 0,
            named_struct('done', concat(a.done, array(a.cur)), 'cur', array(element_at(a.cur, -1), l), 'n', size(split(element_at(a.cur, -1), ' ')) + size(split(l, ' '))),
            named_struct('done', a.done, 'cur', concat(a.cur, array(l)), 'n', a.n + size(split(l, ' ')))),
        a -> if(size(a.cur) > 0, concat(a.done, array(a.cur)), a.done))""").alias("chunks")).select("doc_id", F.posexplode("chunks").alias("chunk_no", "lines")).select("doc_id", "chunk_no", F.length(F.array_join("lines", "\n")).alias("n_chars")),
)
R.add("mask_restore", lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.regexp_extract_all(F.col("text"), F.lit(r"[0-9][0-9,.]*"), F.lit(0)).alias("h"), F.split(F.col("text"), r"[0-9][0-9,.]*").alias("p")).select("doc_id", F.expr("concat_ws('', zip_with(p, h, (a, b) -> concat(a, coalesce(b, ''))))").alias("text")), "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")

QUERIES, SQL = R.queries, R.sql
