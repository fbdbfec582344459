"""Problem 6: damage of scanning and page layout, and its repair into continuous paragraphs.

Pass 1 counts the distinct texts that hold each word (one dictionary per Arrow partition, summed natively), so
copies and repeated deliveries say no more than one text, and notes words divided at line ends. A corpus of fewer
than ``RATIO`` texts can't tell by them; there the occurrences in all rows count. In SQL, rare words are joined with frequent ones by the difference of their anagram hashes:
replacing 'e' by 'c' changes the hash of any word by the same amount, so all variants under a list of
confusions are found by equi-joins on hash plus difference, and confirmed by one replacement in place.
Ranked by frequency, the best variant is the correction. Hyphen evidence compares how often the joined
and the hyphenated form occur elsewhere.
Pass 2 removes page furniture at page edges, joins divided words and lines, and applies corrections.

Corrections and hyphen decisions are tables over the vocabulary. They are handed to the workers only
when their counted size is below ``MAX_LOCAL``; beyond it, the words of each text are joined with them.

A text is damaged if it has page furniture, a divided word, or ``MIN_MISREAD`` misread words. Non-prose
(problem 7) is no case. Null and blank texts come back as they are and are no case; rows are kept one to
one; a text only broken into lines is no case but its lines are joined in the repaired text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpoint

from . import bulk, prose

#: (as printed, as misread)
CONFUSIONS = (("e", "c"), ("o", "0"), ("d", "cl"), ("l", "1"), ("u", "ii"), ("h", "b"), ("m", "rn"), ("w", "vv"), ("g", "9"), ("i", "l"), ("i", "1"), ("ri", "n"), ("s", "5"), ("b", "8"), ("b", "6"), ("z", "2"), ("l", "i"), ("c", "e"), ("b", "h"), ("m", "nn"), ("m", "in"), ("h", "li"), ("n", "ri"))
#: A correction must be this many times as frequent as the word it replaces. Words have 3 to 40 characters.
RATIO = 20
LEAST, LONGEST = 3, 40
MIN_MISREAD = 2
MAX_LOCAL = 300_000
#: Dictionary entries of one partition before they are handed on.
FLUSH = 500_000

MARKS = "-¬­‐"
_WORD = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W_]+-[^\W_]+")
_DIVIDED = re.compile(rf"([^\W\d_]+)([{MARKS}])[ \t]*\n[ \t]*(?=[^\W\d_])([^\W_]+)")
_MARKED_END = re.compile(rf"[{MARKS}][ \t]*\n")
_PAGE = re.compile(
    r"^\s*(?:[\[—–\-(]*\s*(?:p\.|pp\.|page|pag\.|pág\.|s\.|seite|стр\.|第)?\s*\d{1,4}\s*(?:(?:of|/|de|von|sur|из)\s*\d{1,4})?\s*[\])—–\-页]*)\s*$"
    r"|^.*\S\s{3,}\d{1,4}\s*$|^\s*\d{1,4}\s+\|\s+\S.*$|^.*\S\s+\|\s+\d{1,4}\s*$",
    re.IGNORECASE,
)
_DIGITS = re.compile(r"\d+")
_END = re.compile(r"[.!?。！？:;][\"'”»’)）]*$")


def anagram(word: str) -> int:
    """Order-free hash: sum of fifth powers of the code points (fits 63 bits for words below 4,000 letters)."""
    return sum(ord(c) ** 5 for c in word) & 0x3FFFFFFFFFFFFFFF


DELTAS = tuple((seen, true, anagram(true) - anagram(seen)) for true, seen in CONFUSIONS)


def tokens(text: str) -> list[str]:
    """Lower-case words of a text with at least three letters or digits, divided words joined."""
    joined = _DIVIDED.sub(r"\1\3", text) if _MARKED_END.search(text) else text
    return [w for w in _WORD.findall(joined.lower()) if LEAST <= len(w) <= LONGEST and not w.isdigit()]


def runs(low: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts joined, first and length of each run of letters and digits, its hash, its text)."""
    t = bulk.text(low)
    solid = t.kind == bulk.ALNUM
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(~solid & before)
    doc = np.searchsorted(t.start, starts, side="right") - 1
    return "\n".join(low) + "\n", starts, ends - starts, bulk.hash_runs(t.codes, starts, solid), doc


def count_words(texts: list[str], by_text: bool) -> Iterator[tuple[str, int]]:
    """(word, texts that hold it or occurrences) for the words of a piece of texts; as ``tokens`` gives them."""
    for a, b in bulk.chunks(texts):
        low = [(_DIVIDED.sub(r"\1\3", t) if _MARKED_END.search(t) else t).lower() for t in texts[a:b]]
        joined, start, size, h, doc = runs(low)
        keep = np.flatnonzero((size >= LEAST) & (size <= LONGEST))
        start, size, h, doc = start[keep], size[keep], h[keep], doc[keep]
        if by_text:
            order = np.lexsort((h, doc))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            keep = order[new]
            start, size, h = start[keep], size[keep], h[keep]
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        for x, m, c in zip(start[first].tolist(), size[first].tolist(), n.tolist(), strict=True):
            w = joined[x : x + m]
            if not w.isdigit():
                yield w, c


def vocabulary(records: DataFrame, by_text: bool = True) -> DataFrame:
    """(kind, word, n, h): counts of words 'w', hyphenated forms 'c' and line-end divisions 'd'; texts 't'.

    Counted are the distinct texts that hold them, or all their occurrences in all rows.
    """
    once = set if by_text else list

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {"w": Counter(), "c": Counter(), "d": Counter(), "t": Counter()}

        def out() -> pd.DataFrame:
            rows = [(k, w, n, anagram(w) if k == "w" else 0) for k, c in counts.items() for w, n in c.items()]
            for c in counts.values():
                c.clear()
            return pd.DataFrame(rows, columns=["kind", "word", "n", "h"]).astype({"n": "int64", "h": "int64"})

        for part in parts:
            texts = part["text"].tolist()
            counts["t"][""] += len(texts)
            for w, n in count_words(texts, by_text):
                counts["w"][w] += n
            for t in texts:
                if "-" in t:
                    counts["c"].update(once(c for piece in t.lower().split() if "-" in piece for c in _COMPOUND.findall(piece)))
                    if _MARKED_END.search(t):
                        counts["d"].update(once(f"{a}-{b}" for a, mark, b in _DIVIDED.findall(t.lower()) if mark == "-"))
            if len(counts["w"]) > FLUSH:
                yield out()
        yield out()

    src = records.where("text is not null").select("text")
    part = (src.distinct() if by_text else src).mapInPandas(run, "kind string, word string, n long, h long")
    return part.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.first("h").alias("h"))


def corrections(vocab: DataFrame) -> DataFrame:
    """(word, correct): misread words with the most frequent word that one confusion explains."""
    words = vocab.where("kind = 'w'").select("word", "n", "h")
    frequent = words.where(F.col("n") >= RATIO).select(F.col("word").alias("correct"), F.col("n").alias("m"), F.col("h").alias("key"))
    deltas = F.array(*[F.struct(F.lit(s).alias("seen"), F.lit(t).alias("true"), F.lit(d).alias("delta")) for s, t, d in DELTAS])
    tried = words.select("word", "n", "h", F.explode(deltas).alias("x")).where(F.col("word").contains(F.col("x.seen")))
    tried = tried.select("word", "n", "x.seen", "x.true", (F.col("h") + F.col("x.delta")).alias("key"))
    pairs = tried.join(frequent, "key").where(F.col("m") >= RATIO * F.col("n"))
    in_place = F.expr("exists(sequence(1, length(word)), i -> substr(word, i, length(seen)) = seen and concat(substr(word, 1, i - 1), `true`, substr(word, i + length(seen))) = correct)")
    return pairs.where(in_place).groupBy("word").agg(F.max(F.struct("m", "correct")).alias("b")).select("word", F.col("b.correct").alias("correct"))


def divisions(vocab: DataFrame) -> DataFrame:
    """(word, divided): line-end divisions a-b; divided unless the hyphenated form is the more frequent one."""
    d = vocab.where("kind = 'd'").select("word", F.translate("word", "-", "").alias("joined"))
    w = vocab.where("kind = 'w'").select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    c = vocab.where("kind = 'c'").select("word", F.col("n").alias("n_hyphen"))
    return d.join(w, "joined", "left").join(c, "word", "left").select("word", (F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_hyphen", F.lit(0))).alias("divided"))


def _is_title(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= 60 and not _END.search(s) and (s.isupper() or all(w[:1].isupper() or w[:1].isdigit() or not w[:1].isalnum() for w in s.split()))


def furniture(lines: list[str]) -> set[int]:
    """Numbers of the lines that are page numbers or running heads beside them."""
    pages = {k for k, x in enumerate(lines) if x and len(x) <= 90 and x.strip() and (x.strip()[-1] in "0123456789])—–-页" or "|" in x or x.strip()[0].isdigit()) and _PAGE.match(x)}
    if not pages:
        return set()
    stems = Counter(_DIGITS.sub("#", x.strip()) for x in lines if x.strip())
    out = set(pages)
    for k in pages:
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(lines) and not lines[j].strip("\x0c \t"):
                j += step
            if 0 <= j < len(lines) and j not in out and (_is_title(lines[j].strip("\x0c")) or stems[_DIGITS.sub("#", lines[j].strip())] > 1 and len(lines[j]) <= 60):
                out.add(j)
    return out


def mend(text: str, wrong: dict[str, str], divided: dict[str, bool]) -> tuple[str, int, int, int]:
    """(repaired text, furniture lines, divided words, misread words)."""
    n_page = n_div = 0
    if "\n" in text or "\x0c" in text:
        lines = text.split("\n")
        gone = furniture(lines) if len(lines) > 2 else set()
        n_page = len(gone)
        if gone or "\x0c" in text:
            kept = []
            for k, x in enumerate(lines):
                if k not in gone:
                    kept.append(x.replace("\x0c", ""))
            lines = kept
        body = "\n".join(lines)

        def join(m: re.Match) -> str:
            nonlocal n_div
            a, mark, b = m.groups()
            if mark != "-" or divided.get(f"{a}-{b}".lower(), True):
                n_div += 1
                return a + b
            return f"{a}-{b}"

        if _MARKED_END.search(body):
            body = _DIVIDED.sub(join, body)
        paragraphs: list[str] = []
        for block in re.split(r"\n\s*\n", body):
            flat = " ".join(x.strip() for x in block.split("\n") if x.strip())
            if not flat:
                continue
            if paragraphs and n_page and not _END.search(paragraphs[-1]) and flat[:1].islower():
                paragraphs[-1] += " " + flat  # a page break inside a sentence
            else:
                paragraphs.append(flat)
        text = "\n\n".join(paragraphs)
    bad = not wrong.keys().isdisjoint(_WORD.findall(text.lower()))
    n_bad = 0
    if bad:

        def fix(m: re.Match) -> str:
            nonlocal n_bad
            w = m.group()
            c = wrong.get(w.lower())
            if c is None:
                return w
            n_bad += 1
            return c.upper() if w.isupper() and len(w) > 1 and any(x.isalpha() for x in w) else c.capitalize() if w[:1].isupper() else c

        text = _WORD.sub(fix, text)
    return text, n_page, n_div, n_bad


class _Asked(dict):
    """Remembers the divisions that are looked up, and answers all of them alike."""

    def __init__(self, divided: bool):
        self.keys_, self.divided = set(), divided

    def get(self, key: str, default: bool = True) -> bool:
        self.keys_.add(key)
        return self.divided


def asked(text: str) -> set[str]:
    """All words and divisions that ``mend`` may look up in a text, whatever the decisions on its divisions are."""
    out: set[str] = set()
    for divided in (True, False):
        seen = _Asked(divided)
        out.update(_WORD.findall(mend(text, {}, seen)[0].lower()))
        out |= seen.keys_
    return out


def repair(records: DataFrame, id_col: str = "result_id", text_col: str = "text") -> DataFrame:
    """(id, text, furniture, divided, misread, damaged): one row per input row."""
    src = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vocab = checkpoint(vocabulary(src))  # a table over the vocabulary
    if (vocab.where("kind = 't'").agg(F.sum("n")).first()[0] or 0) < RATIO:
        vocab = checkpoint(vocabulary(src, by_text=False))  # no word can be in RATIO times as many texts as another
    wrong, parts = corrections(vocab), divisions(vocab)
    changes = checkpoint(wrong.select(F.lit("w").alias("kind"), "word", "correct").unionByName(parts.where("not divided").select(F.lit("d").alias("kind"), "word", F.lit("").alias("correct"))))
    schema = "text string, furniture int, divided int, misread int"
    names = ["text", "furniture", "divided", "misread"]

    if changes.limit(MAX_LOCAL + 1).count() <= MAX_LOCAL:
        rows = changes.collect()  # size just counted
        fixes = {r["word"]: r["correct"] for r in rows if r["kind"] == "w"}
        keep = {r["word"]: False for r in rows if r["kind"] == "d"}

        wrong_words = sorted(fixes)
        wrong_hashes = np.sort(runs([" ".join(wrong_words)])[3]) if wrong_words else np.zeros(1, np.uint64)

        @F.pandas_udf(schema)
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for part in texts:
                ts = part.tolist()
                rows = []
                for a, b in bulk.chunks(ts):
                    # a text of one line without a misread word stays as it is
                    some = [t.lower() if t else "" for t in ts[a:b]]
                    _, _, _, h, doc = runs(some)
                    bad = np.zeros(b - a, bool)
                    bad[doc[wrong_hashes[np.minimum(np.searchsorted(wrong_hashes, h), len(wrong_hashes) - 1)] == h]] = True
                    rows += [mend(t, fixes, keep) if t and (x or "\n" in t or "\x0c" in t) else (t, 0, 0, 0) for t, x in zip(ts[a:b], bad.tolist(), strict=True)]
                yield pd.DataFrame(rows, columns=names)

        out = src.select("id", run("text").alias("_m"))
    else:

        @F.pandas_udf("array<string>")
        def words(texts: pd.Series) -> pd.Series:
            return pd.Series([sorted(asked(t)) if t else [] for t in texts])

        hits = src.where("text is not null").select("text", F.explode(words("text")).alias("word")).select(F.xxhash64("text").alias("key"), "word").distinct()
        local = hits.join(changes, "word").groupBy("key").agg(F.collect_list(F.struct("kind", "word", "correct")).alias("changes"))  # bounded by the words of one text

        @F.pandas_udf(schema)
        def run_with(texts: pd.Series, changes: pd.Series) -> pd.DataFrame:
            rows = []
            for t, cs in zip(texts, changes, strict=True):
                cs = [] if cs is None else list(cs)
                fixes = {c["word"]: c["correct"] for c in cs if c["kind"] == "w"}
                keep = {c["word"]: False for c in cs if c["kind"] == "d"}
                rows.append(mend(t, fixes, keep) if t else (t, 0, 0, 0))
            return pd.DataFrame(rows, columns=names)

        keyed = src.withColumn("key", F.xxhash64("text")).join(local, "key", "left")
        out = keyed.select("id", run_with("text", "changes").alias("_m"))
    m = "_m."
    damaged = (F.col(m + "furniture") > 0) | (F.col(m + "divided") > 0) | (F.col(m + "misread") >= MIN_MISREAD)
    return out.select(F.col("id").alias(id_col), m + "text", m + "furniture", m + "divided", m + "misread", damaged.alias("damaged"))


def found(records: DataFrame) -> DataFrame:
    """Ids of the records with scanning damage, without non-prose."""
    hit = repair(records).where("damaged").select("result_id").distinct()
    return hit.join(prose.found(records).select("result_id"), "result_id", "left_anti")
