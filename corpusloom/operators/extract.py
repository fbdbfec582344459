"""One-to-many extraction: symbols, formulas, keyword classification, ranking."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X

# Patterns of symbols, by type, with the confidence of a symbol that no dictionary has.
SYMBOL_PATTERNS = {
    "stock_ticker": (r"[A-Z]{1,5}(?:\.[A-Z]{1,2})?", 0.7),
    "crypto_symbol": (r"[A-Z]{2,10}", 0.6),
    "currency_amount": (r"(?:[$€£¥₹₽₩₪₦₡][ \t\n\r\f]*[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?|[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?[ \t\n\r\f]*(?:USD|EUR|GBP|JPY|CHF|CAD|AUD|NZD|CNY|INR|BRL|RUB|KRW|SGD|HKD|NOK|SEK))", 0.9),
    "greek_letter": (r"[αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ]", 1.0),
    "mathematical_symbol": (r"[∞∂∇∑∏∫√±≤≥≠≈∈∉⊂⊃∩∪∅ℝℕℤℚ→←↑↓⇒⇔]", 1.0),
    "financial_ratio": (r"(?:P/E|P/B|ROE|ROA|EBITDA|WACC|CAPM|VaR|CVaR|PnL|P&L|NAV|AUM|IRR|NPV|CAGR|YTD|QoQ|YoY|MoM|ATH|ATL|RSI|MACD|SMA|EMA|BB|ADX|CCI|MFI|OBV)", 1.0),
    "defi_term": (r"(?:DeFi|DAO|NFT|DEX|CEX|LP|AMM|TVL|APY|APR|IL|MEV|PoS|PoW|TPS)", 1.0),
    "percentage": (r"(?:[0-9]+(?:\.[0-9]+)?%|[0-9]+(?:\.[0-9]+)?[ \t\n\r\f]*bps?(?![A-Za-z0-9_]))", 1.0),
    "scientific_notation": (r"[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+", 1.0),
}
# Capitals that look like tickers and are none.
NO_TICKERS = ("AI", "VS", "JDK")
#: Types whose symbols stand between characters that are no ASCII word characters.
WHOLE = ("stock_ticker", "crypto_symbol", "financial_ratio", "defi_term", "scientific_notation")


def _hits(c: Column, kind: str) -> Column:
    p = SYMBOL_PATTERNS[kind][0]
    if kind in WHOLE:
        p = rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"
    hits = F.regexp_extract_all(c, F.lit(p), F.lit(0))
    return F.filter(hits, lambda s: ~s.isin(*NO_TICKERS)) if kind == "stock_ticker" else hits


def _tag(arr: Column, kind: str, name: str) -> Column:
    return F.transform(arr, lambda s: F.struct(F.lit(kind).alias("type"), s.alias(name)))

# Patterns of formulas, by type.
FORMULA_PATTERNS = {
    "inline_latex": r"\$([^$]+)\$",
    "display_latex": r"\$\$([^$]+)\$\$",
    "equation_env": r"(?s)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}",
    "align_env": r"(?s)\\begin\{align\*?\}(.*?)\\end\{align\*?\}",
    "eqnarray_env": r"(?s)\\begin\{eqnarray\*?\}(.*?)\\end\{eqnarray\*?\}",
    "math_env": r"(?s)\\begin\{math\}(.*?)\\end\{math\}",
    "displaymath_env": r"(?s)\\begin\{displaymath\}(.*?)\\end\{displaymath\}",
    "bracket_inline": r"\\\(([^)]+)\\\)",
    "bracket_display": r"\\\[([^\]]+)\\\]",
    "percentage": r"\b([0-9]+(?:\.[0-9]+)?%)",
    "currency": r"([$€£¥][ \t\n\r\f]*[0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?)",
    "scientific_notation": r"\b([0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+)\b",
    "ratios": r"\b([0-9]+(?:\.[0-9]+)?:[0-9]+(?:\.[0-9]+)?)\b",
    "fractions": r"\b([0-9]+/[0-9]+)\b",
    "greek_letters": r"(\\(?:alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|omicron|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega))\b",
    "probability": r"(P\([^)]+\))",
    "expectation": r"(E\[[^\]]+\])",
    "variance": r"(Var\([^)]+\))",
    "correlation": r"(Corr\([^)]+\))",
    "volatility": r"(σ[ \t\n\r\f]*[²₂]?)",
    "returns": r"(R_[{A-Za-z0-9_}]+)",
    "derivatives": r"(d[A-Z]/d[A-Z])",
}
#: Length limits of a formula.
FORMULA_LENGTH = (3, 1000)


def symbols(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, type, symbol, n): hits of all patterns, overlapping ones included. One pass over the text, one explode."""
    hits = [_tag(_hits(F.col(text_col), k), k, "symbol") for k in SYMBOL_PATTERNS]
    h = df.select(id_col, F.explode(F.concat(*hits)).alias("h"))
    return h.groupBy(id_col, F.col("h.type").alias("type"), F.col("h.symbol").alias("symbol")).agg(F.count("*").alias("n"))


def symbol_positions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, type, symbol, start, context): with offsets, which need Python; sorted by place within each row."""
    import re

    import pandas as pd

    pats = {k: re.compile(rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])" if k in WHOLE else p) for k, (p, _) in SYMBOL_PATTERNS.items()}

    @F.pandas_udf("array<struct<type:string,symbol:string,start:int,context:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def hits(t):  # noqa: ANN001, ANN202
            if not t:
                return []
            out = [x for x in _found(t) if x["type"] != "stock_ticker" or x["symbol"] not in NO_TICKERS]
            return sorted(out, key=lambda h: (h["start"], h["type"]))

        def _found(t):  # noqa: ANN001, ANN202
            return [{"type": k, "symbol": m.group(), "start": m.start(), "context": t[max(0, m.start() - 30) : m.end() + 30]} for k, p in pats.items() for m in p.finditer(t)]

        return texts.map(hits)

    return df.select(id_col, F.explode(run(text_col)).alias("h")).select(id_col, "h.*")


def _ascii(p: str) -> str:
    """A pattern whose word limits at either end are those of ASCII words, as in SQL."""
    if p.startswith(r"\b"):
        p = "(?<![A-Za-z0-9_])" + p[2:]
    return p[:-2] + "(?![A-Za-z0-9_])" if p.endswith(r"\b") else p


def valid_formula(f: Column, kind: str) -> Column:
    """Within the length limits; not only digits, letters or white space; of LaTeX, with balanced braces."""
    ok = F.length(f).between(*FORMULA_LENGTH) & ~F.trim(f).rlike(r"^([0-9]+|[a-zA-Z]+|[ \t\n\r\f]*)\z")
    if "latex" in kind:
        ok &= F.length(F.translate(f, "{", "")) == F.length(F.translate(f, "}", ""))
    return ok


def formulas(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, type, formula): distinct valid formulas of a text by type, without their delimiters."""
    all_of = lambda p: F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(_ascii(p)), F.lit(1)))
    valid = lambda k: lambda f: valid_formula(f, k)
    hits = [_tag(F.filter(all_of(p), valid(k)), k, "formula") for k, p in FORMULA_PATTERNS.items()]
    return df.select(id_col, F.explode(F.concat(*hits)).alias("h")).select(id_col, "h.*")


def formula_confidence(f: Column, kind: Column) -> Column:
    """.5, and .3 for an environment or .2 for LaTeX, .05 for each mathematical mark up to .3, less .2 below five characters."""
    marks = sum((F.contains(f, F.lit(m)).cast("int") for m in ("\\", "^", "_", "{", "}", "sum", "int", "frac", "sqrt")), F.lit(0))
    c = 0.5 + F.when(F.contains(kind, F.lit("env")), 0.3).when(F.contains(kind, F.lit("latex")), 0.2).otherwise(0.0) + F.least(F.lit(0.3), 0.05 * marks)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c - F.when(F.length(f) < 5, 0.2).otherwise(0.0))), 4)


def formula_metadata(f: Column) -> list[Column]:
    """Length and what a formula holds."""
    has = lambda p: f.rlike(p)
    return [
        F.length(f).alias("length"), has(r"\\[a-zA-Z]+").alias("has_commands"), F.contains(f, F.lit("^")).alias("has_superscript"), F.contains(f, F.lit("_")).alias("has_subscript"),
        has("frac|/").alias("has_fractions"), has(r"\\int|∫").alias("has_integrals"), has(r"\\sum|Σ").alias("has_summations"),
    ]


def complexity(f: Column) -> Column:
    """.2 per nesting level, .1 per command, .05 per operator; at most 1."""
    depth = F.aggregate(
        F.split(f, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda a, ch: F.struct(
            (a["d"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("d"),
            F.greatest(a["m"], a["d"] + F.when(ch == "{", 1).otherwise(0)).alias("m"),
        ), lambda a: a["m"],
    )
    commands = F.size(F.regexp_extract_all(f, F.lit(r"\\[a-zA-Z]+"), F.lit(0)))
    operators = F.size(F.regexp_extract_all(f, F.lit(r"[-+*/=<>≤≥≠∈∉⊂⊃∩∪]"), F.lit(0)))
    return F.round(F.least(F.lit(1.0), 0.2 * depth + 0.1 * commands + 0.05 * operators), 4)


def classify(df: DataFrame, config: DataFrame, id_col: str, text_col: str, title_col: str) -> DataFrame:
    """(id, domain, score, confidence): weighted keyword score by domain; unknown when no keyword occurs.

    Keywords are the distinct words of a domain's search terms longer than three letters, without KEYWORD_STOPS. Whole
    words count (runs of letters, digits and underscores; a keyword with a hyphen needs the same hyphen); the title
    counts three times. Score: 0.7 of the share of keywords that occur and 0.3 of their hits by twenty tokens.
    Confidence: the lead over the second score as a share of the first; 0 where the second is 0. Ties go to the name.
    The configuration goes along with the function; one Arrow pass over the texts, no pairs are shuffled.
    """
    import re
    from collections import Counter

    import pandas as pd

    table = {r["domain"]: keywords_of(r["search_terms"] or []) for r in config.orderBy("domain").collect()}  # configuration
    plain = {k: re.fullmatch(r"\w+", k) is not None for ks in table.values() for k in ks}
    word = re.compile(r"\w+")

    @F.pandas_udf("domain string, score double, confidence double")
    def run(texts: pd.Series, titles: pd.Series) -> pd.DataFrame:
        rows = []
        for text, title in zip(texts, titles, strict=True):
            c = ((title or "").lower() + " ") * 3 + (text or "").lower()
            seen = Counter(word.findall(c))
            tokens = max(1, len(c.split()))
            count = {k: seen[k] if p else len(re.findall(rf"(?<!\w){re.escape(k)}(?!\w)", c)) if k in c else 0 for k, p in plain.items()}
            scored = []
            for d, ks in table.items():
                hits = [count[k] for k in ks]
                scored.append((-(0.7 * sum(h > 0 for h in hits) / len(ks) + 0.3 * sum(hits) / (tokens / 20)) if ks else 0.0, d))
            scored.sort()
            s1, s2 = (-scored[0][0], -scored[1][0]) if len(scored) > 1 else (-scored[0][0] if scored else 0.0, 0.0)
            rows.append((scored[0][1], s1, (s1 - s2) / s1 if s2 > 0 else 0.0) if s1 > 0 else ("unknown", 0.0, 0.0))
        return pd.DataFrame(rows, columns=["domain", "score", "confidence"])

    d = df.select(id_col, run(F.col(text_col), F.col(title_col)).alias("r"))
    return d.select(id_col, "r.domain", F.round("r.score", 6).alias("score"), F.round("r.confidence", 6).alias("confidence"))


# Fixed value: words that are no keywords.
KEYWORD_STOPS = ("and", "the", "for", "with")


def keywords_of(terms: list[str]) -> list[str]:
    return sorted({w for t in terms for w in t.lower().split() if len(w) > 3 and w not in KEYWORD_STOPS})


def best_of(df: DataFrame, group: str, score: Column, tie: str) -> DataFrame:
    """The best candidate of each group; partial aggregation, no sort of a group."""
    return df.groupBy(group).agg(F.min(F.struct((-score).alias("s"), F.col(tie).alias("t"))).alias("b")).select(group, F.col("b.t").alias(tie), (-F.col("b.s")).alias("score"))
