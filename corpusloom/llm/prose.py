"""Problem 7: quality statistics of each text, and natural prose told from lists, tables and junk.

One Arrow pass computes the statistics of all texts of a batch by array operations. Per language, medians and median
absolute deviations over all records are aggregated natively; records inside a wide box around the medians give mean
and covariance (sums and products, aggregated natively: one row of fixed width per language reaches the driver). The
squared Mahalanobis distance of every record to the prose of its language decides: beyond ``CUT`` it is no prose. Each
statistic's contribution (they sum to the distance) decides the kind: a table where the cells of its lines contribute
half of ``CUT``, junk where what speaks for junk contributes ``MARGIN`` more than what speaks for a list, else a list.

Garbled text is measured as it was written (problem 2), so a wrong encoding does not turn prose into junk; a text whose
letters are lost (``LOST`` of it replacement characters) has no distance, as nothing says what it was.

Defined results: null and blank texts have null statistics and no kind; texts without words are junk; repeated deliveries
count once (they carry the same text); languages with fewer than ``MIN_ROWS`` typical records, and texts of no known
language, use the fit of all languages together; of fewer than ``MIN_ROWS`` typical records in all, nothing can be said
and only texts without words have a kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpoint

from . import bulk, garble
from . import langmodel as lm

#: Statistics that enter the distance, in this order.
DIMS = (
    "log_words", "word_length", "symbol_ratio", "word_diversity", "line_end_punct", "common_words", "digit_ratio", "sentence_ends", "triple_diversity", "cell_lines", "marked_lines", "item_words",
)
#: Least spread of each statistic, so that a constant one does not make every difference infinite.
FLOOR = (0.5, 1.0, 0.03, 0.04, 0.6, 0.04, 0.03, 0.03, 0.06, 0.15, 0.3, 0.3)
#: What speaks for each kind, and on which side of the mean of prose.
SPEAKS = {
    "table": {"cell_lines": 1},
    "list": {"marked_lines": 1, "item_words": -1},
    "junk": {"word_length": 1, "symbol_ratio": 1, "digit_ratio": 1, "word_diversity": -1, "triple_diversity": -1, "item_words": 1},
}
BOX = 6.0
#: Far beyond the 0.999 quantile of chi-squared with 12 degrees of freedom (32.9): prose has longer tails.
CUT = 80.0
MARGIN = 10.0
MIN_ROWS = 30
LOST = 0.02
#: Share of function words of a language from which a text has a language.
LEAST_WORDS = 0.05

_BULLETS = "-*+•·–—o»>"
_ENDS = ".!?。！？…"
_CLOSERS = "\"'”’»)）」"
_HANZI = (0x3400, 0x9FFF)


#: Sets of characters that the statistics look for; one bit each.
SETS = {
    "end": _ENDS, "closer": _CLOSERS, "digit": "0123456789", "function": "".join(sorted(lm.ZH_CHARS)), "zh_mark": "。，", "bar": "|", "rule": "-+|=: ", "loose": ",;", "title": ":>»=/", "dash": "-–—",
    "inner": "|•/·>»", "bullet": _BULLETS, "mark": ".):-", "point": ".)", "comma": ",",
}
_BIT = {name: np.uint16(1 << k) for k, name in enumerate(SETS)}


@cache
def _flags() -> np.ndarray:
    """Bits of the sets of each code point."""
    out = np.zeros(bulk.TOP + 1, np.uint16)
    for name, chars in SETS.items():
        for c in chars:
            out[ord(c)] |= _BIT[name]
    return out


@cache
def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words, and their weight by language."""
    names = sorted(lm.WEIGHTS)
    h = bulk.words([" ".join(names)]).hash
    order = np.argsort(h)
    return h[order], np.array([lm.WEIGHTS[w] for w in names])[order]


def word_weights(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word is a function word, its row in the table of weights)."""
    keys, _ = _function_words()
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return keys[at] == hashes, at


def measure(texts: list[str | None], sound: bool = False) -> pd.DataFrame:
    """Statistics of each text; all null for null and blank texts. ``sound`` says that garbled text is restored already."""
    parts = [_measure(texts[a:b] if sound else garble.sound(texts[a:b])) for a, b in bulk.chunks(texts)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in NAMES})


def _measure(fixed: list[str | None]) -> pd.DataFrame:
    k = len(fixed)
    w = bulk.words(fixed)
    t = bulk.text(fixed)
    n = np.diff(w.first).astype(float)
    some = np.maximum(n, 1.0)
    blank = bulk.between(np.flatnonzero(t.kind != bulk.SPACE), t.start[:-1], t.start[1:]) == 0

    # words
    letters = bulk.sums(w.doc, w.length, k)
    known, row = word_weights(w.hash)
    common = bulk.sums(w.doc[known], np.ones(int(known.sum())), k) / some
    weights = np.zeros((k, len(lm.LANGS)))
    np.add.at(weights, w.doc[known], _function_words()[1][row[known]])
    distinct = np.diff(bulk.distinct(w.hash, w.first)[1]).astype(float)
    triples = np.where(n > 2, np.diff(bulk.distinct(*bulk.grams(w, 3))[1]) / np.maximum(1.0, n - 2), 1.0)

    # characters
    flags = _flags()[np.minimum(t.codes, np.uint32(bulk.TOP))]
    is_ = lambda name, f=flags: (f & _BIT[name]) != 0
    where = lambda mask: bulk.between(np.flatnonzero(mask), t.start[:-1], t.start[1:]).astype(float)
    solid = np.maximum(1.0, where(t.kind != bulk.SPACE))
    digits = where(is_("digit"))
    ends = where(is_("end"))
    lost = where(t.codes == 0xFFFD) / solid
    # Chinese has no spaces: function characters and sentence marks among the hanzi stand for function words
    hanzi_at = (t.codes >= _HANZI[0]) & (t.codes <= _HANZI[1])
    hanzi = where(hanzi_at)
    cyrillic = where((t.codes >= 0x400) & (t.codes <= 0x4FF))
    chinese = 2 * hanzi >= 0.3 * (letters - hanzi)
    chinese &= hanzi > 0
    if chinese.any():
        function = where(is_("function"))
        marks = where(is_("zh_mark"))
        common = np.where(chinese, np.minimum(1.0, 2.0 * function / np.maximum(1.0, hanzi) + 3.0 * marks / np.maximum(1.0, hanzi)), common)
    russian = ~chinese & (cyrillic >= 0.3 * (letters - cyrillic)) & (cyrillic > 0)
    weights[:, lm.LANGS.index("zh")] += np.where(chinese, 1e6, 0)
    weights[:, lm.LANGS.index("ru")] += np.where(russian, 1e6, 0)
    # a stray word of another language is no evidence
    weights[weights.max(axis=1) < LEAST_WORDS * 2.2 * some] = 0.0
    lang = np.where(weights.max(axis=1) > 0, np.array(lm.LANGS, dtype=object)[weights.argmax(axis=1)], "none")

    # lines
    ln = bulk.lines(t)
    after, width = ln.last + 1, len(t.codes)
    in_line = lambda mask: bulk.between(np.flatnonzero(mask), ln.first, after)
    nxt = np.append(t.codes[1:], 10)
    space = t.kind == bulk.SPACE
    next_space, last_space = np.append(space[1:], True), np.concatenate([[True], space[:-1]])
    bars = is_("bar")
    n_bars = in_line(bars) - bars[ln.first] - (bars[ln.last] & (ln.last > ln.first))
    tabs = in_line(t.codes == 9)
    gaps = in_line(space & ~last_space & (next_space | (t.codes == 9)))
    semis = in_line(t.codes == 59)
    loose = in_line(is_("loose") & next_space)
    tight = in_line(is_("comma") & ~next_space & ~((nxt >= 48) & (nxt <= 57)))
    rules = in_line(~is_("rule")) == 0
    cells = np.maximum.reduce([n_bars, tabs, gaps, np.where(loose == 0, semis, 0), np.where(loose == 0, tight, 0)]) + 1
    n_lines = np.maximum(1.0, bulk.sums(ln.doc, np.ones(len(ln.doc)), k))
    rows = bulk.sums(ln.doc, (cells >= 3) | rules, k)
    cell_lines = np.where(n_lines >= 2, rows / n_lines, 0.0)
    closed = np.flatnonzero(~space & ~is_("closer"))
    if len(closed):
        at = closed[np.maximum(np.searchsorted(closed, after) - 1, 0)]
        ended = (at >= ln.first) & (at < after) & is_("end")[at]
    else:
        ended = np.zeros(len(ln.doc), bool)
    line_end = bulk.sums(ln.doc, ended, k) / n_lines
    # a bullet, a number or a letter with a mark, then white space; or a title and a mark before the rest
    near = [np.minimum(ln.first + j, width - 1) for j in range(5)]
    f = [flags[x] for x in near]
    s = [space[x] for x in near]
    digit, mark = [is_("digit", x) for x in f], [is_("mark", x) for x in f]
    bullet = (is_("bullet", f[0]) & s[1]) | (digit[0] & mark[1] & s[2]) | (digit[0] & digit[1] & mark[2] & s[3]) | (digit[0] & digit[1] & digit[2] & mark[3] & s[4])
    bullet |= digit[0] & s[1] & mark[2] & s[3] | digit[0] & digit[1] & s[2] & mark[3] & s[4]
    letter = (t.codes[near[0]] | 32) - 97 < 26
    bullet |= letter & is_("point", f[1]) & s[2]
    titled = (in_line(is_("title") & next_space) + in_line(is_("dash") & next_space & last_space) + in_line((t.codes == 46) & (nxt == 46))) > 0
    marked = bulk.sums(ln.doc, (bullet | (titled & ~ended)) & ~rules, k) / n_lines
    inner = in_line((is_("inner") & next_space & last_space) | (is_("loose") & next_space))
    items = n_lines + bulk.sums(ln.doc, inner, k)
    sizes = np.diff(t.start) - 1

    out = pd.DataFrame({
        "lang": lang, "word_count": n, "log_words": np.log1p(n), "word_length": letters / some, "symbol_ratio": np.maximum(0.0, (solid - letters) / solid),
        "word_diversity": np.where(n > 1, np.log1p(distinct) / np.log1p(some), 1.0), "line_end_punct": line_end, "common_words": common, "digit_ratio": digits / solid,
        "sentence_ends": np.minimum(1.0, ends / some), "triple_diversity": triples, "cell_lines": cell_lines, "marked_lines": marked, "item_words": np.log(np.maximum(1.0, n) / items),
        "distinct_share": distinct / some, "lost": (lost > LOST) & (sizes > 0),
    })
    # Chinese runs of letters are no words, so what counts words says nothing there
    for d in ("word_length", "sentence_ends", "item_words", "log_words"):
        out.loc[chinese, d] = 0.0
    for d in ("word_diversity", "triple_diversity"):
        out.loc[chinese, d] = 1.0
    out["word_count"] = out["word_count"].astype("Int64")
    out["lost"] = out["lost"].astype(object)
    out.loc[blank] = None
    return out[NAMES]


NAMES = ["lang", "word_count", *DIMS, "distinct_share", "lost"]
SCHEMA = "lang string, word_count long, " + ", ".join(f"{d} double" for d in DIMS) + ", distinct_share double, lost boolean"


def as_frame(texts: list[str | None], sound: bool = False) -> pd.DataFrame:
    """``measure`` with the types of SCHEMA."""
    out = measure(texts, sound)
    return out.astype({d: "float64" for d in (*DIMS, "distinct_share")})


def statistics(records: DataFrame, id_col: str = "result_id", text_col: str = "text") -> DataFrame:
    """(id, statistics...): one row per input row; map-only."""

    @F.pandas_udf(SCHEMA)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield as_frame(part.tolist())

    return records.select(id_col, run(F.col(text_col)).alias("_s")).select(id_col, "_s.*")


def fit(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language -> (mean, inverse covariance) of its typical records; key '*' pools all languages."""
    seen = stats.where((F.col("word_count") > 0) & ~F.col("lost") & (F.col("lang") != "none"))
    med = seen.groupBy("lang").agg(*[F.percentile_approx(d, 0.5, 1000).alias(f"m_{d}") for d in DIMS])
    near = seen.join(F.broadcast(med), "lang")  # one row per language
    mad = near.groupBy("lang").agg(*[F.percentile_approx(F.abs(F.col(d) - F.col(f"m_{d}")), 0.5, 1000).alias(f"d_{d}") for d in DIMS])
    near = near.join(F.broadcast(mad), "lang")
    inside = F.lit(True)
    for d, floor in zip(DIMS, FLOOR, strict=True):
        inside &= F.abs(F.col(d) - F.col(f"m_{d}")) <= BOX * F.greatest(1.4826 * F.col(f"d_{d}"), F.lit(floor))
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(DIMS)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(DIMS) for j, b in enumerate(DIMS) if i <= j]
    rows = near.where(inside).groupBy("lang").agg(F.count("*").alias("n"), *sums, *products).collect()  # one row per language

    def solve(n: float, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s / n
        cov = p / n - np.outer(mean, mean) + np.diag(np.square(FLOOR) / 4)
        return mean, np.linalg.inv(cov)

    k = len(DIMS)
    parts = {}
    for r in rows:
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        parts[r["lang"]] = (r["n"], np.array([r[f"s{i}"] for i in range(k)]), p)
    if sum(v[0] for v in parts.values()) < MIN_ROWS:
        return {}
    model = {"*": solve(*(sum(v[i] for v in parts.values()) for i in range(3)))}
    return model | {g: solve(*v) for g, v in parts.items() if v[0] >= MIN_ROWS}


def contributions(x: np.ndarray, lang: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(contribution of each statistic, difference from the mean of prose) of each row."""
    c, diff = np.zeros_like(x), np.zeros_like(x)
    for g in set(lang.tolist()):
        mean, inv = model.get(g) or model["*"]
        rows = lang == g
        diff[rows] = x[rows] - mean
        c[rows] = diff[rows] * (diff[rows] @ inv)
    return c, diff


def kinds_of(c: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """Kind of each row beyond CUT, by the contributions; None for prose."""

    def voice(kind: str) -> np.ndarray:
        return sum(np.where(diff[:, j] * side > 0, np.maximum(c[:, j], 0.0), 0.0) for d, side in SPEAKS[kind].items() if (j := DIMS.index(d)) >= 0)

    items, junk = voice("list"), voice("junk")
    kind = np.where(voice("table") > CUT / 2, "table", np.where((items <= 0) | (junk > items + MARGIN), "junk", "list")).astype(object)
    kind[c.sum(axis=1) <= CUT] = None
    return kind


def score(stats: DataFrame, model: dict, id_col: str = "result_id") -> DataFrame:
    """Adds ``distance`` (squared), ``contributions`` (they sum to it), ``outlier`` and ``kind``."""

    @F.pandas_udf("distance double, contributions array<double>, kind string")
    def run(lang: pd.Series, count: pd.Series, lost: pd.Series, x: pd.Series) -> pd.DataFrame:
        lost = lost.eq(True).to_numpy()
        n = count.fillna(-1).to_numpy()
        distance, shares = np.full(len(lang), np.nan), [None] * len(lang)
        kind = np.where((n == 0) & ~lost, "junk", None)
        rows = np.flatnonzero((n > 0) & ~lost) if model else np.zeros(0, int)
        if len(rows):
            c, diff = contributions(np.stack(x.iloc[rows].to_list()).astype(float), lang.iloc[rows].to_numpy(), model)
            distance[rows], kind[rows] = c.sum(axis=1), kinds_of(c, diff)
            for k, v in zip(rows.tolist(), c.round(6).tolist(), strict=True):
                shares[k] = v
        return pd.DataFrame({"distance": distance, "contributions": shares, "kind": kind})

    d = stats.withColumn("_d", run("lang", "word_count", "lost", F.array(*DIMS)))
    distance = F.when(~F.isnan("_d.distance"), F.col("_d.distance"))
    kept = [c for c in stats.columns if c != "lost"]
    return d.select(*kept, distance.alias("distance"), "_d.contributions", F.coalesce(distance > CUT, F.lit(False)).alias("outlier"), "_d.kind")


def assess(records: DataFrame) -> DataFrame:
    """Statistics, distance, contributions and kind of every delivery.

    The statistics (a few numbers per record, no text) are checkpointed, as fit and score both read them.
    """
    stats = checkpoint(statistics(records))
    return score(stats, fit(stats))


def kinds(assessed: DataFrame) -> DataFrame:
    """(result_id, kind) of the records whose text is not prose."""
    return assessed.where("kind is not null").select("result_id", "kind").distinct()


def found(records: DataFrame) -> DataFrame:
    """(result_id, kind) of the records whose text is not prose."""
    return kinds(assess(records))
