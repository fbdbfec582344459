"""Problem 10: bring text that looks alike into one form.

Properties of all code points (built by rule from the Unicode database) say which are unstable: those whose
normalization quick check for NFC is "no" or "maybe" (singletons such as the Kelvin sign, combining marks, vowel and
final jamo), full-width letters and digits, half-width kana and jamo, Latin ligatures, invisible characters and white space
other than the ordinary space, tab and line breaks. Pure ASCII never leaves the JVM; of the rest, array look-ups find
the texts with an unstable character or a word of two scripts. In those, an unstable segment is a maximal run of unstable
characters with the starter before it, which it may combine with. Only these segments are normalised, and spliced back;
everything between them stays untouched. Words that mix scripts are rewritten to the script of their majority
through a table of look-alikes; in a text without any real Cyrillic letter, so are words wholly of look-alikes.

Not unstable: CJK and full-width punctuation, plain Cyrillic or Greek words, quotation marks, dashes, single symbols.
Kept: marks that no composed letter has (they stay behind their letter), joiners and variation selectors inside emoji and
between letters of joining scripts (Arabic, Indic and others).

Defined results: null and empty texts come back unchanged with ``changed`` false and no kinds; rows are kept one to
one (repeated ids stay repeated); ``kinds`` names what a text has even where nothing can be changed (a mark without a
composed letter). Normalising twice gives the same text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk

# Cyrillic and Greek letters drawn like a Latin letter, in alphabetical order of the first.
_CYRILLIC = "АВЕКМНОРСТУХЅІЈԌԚԜҮаеорсухѕіјһԁԛԝӏүк"
_LATIN_OF_CYRILLIC = "ABEKMHOPCTYXSIJGQWYaeopcyxsijhdqwlyk"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϲϳκ"
_LATIN_OF_GREEK = "ABEZHIKMNOPTYXaivopucjk"

TO_LATIN = {a: b for a, b in zip(_CYRILLIC + _GREEK, _LATIN_OF_CYRILLIC + _LATIN_OF_GREEK)}
TO_CYRILLIC = {b: a for a, b in zip(reversed(_CYRILLIC), reversed(_LATIN_OF_CYRILLIC))}
ZERO_WIDTH = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
SPACES = "\u000b\u000c\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Full-width ASCII letters and digits are unstable; full-width punctuation is ordinary in CJK text.
WIDE = "０-９Ａ-Ｚａ-ｚ"
#: Marks that any script may carry; those of one script are part of its spelling.
MARKS = "\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
#: Kinds that make a text a case (TESTDATA.md); the others are changed but are no cases.
CASES = ("full_width", "combining", "zero_width", "space", "mixed_script")

_LAT = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = "\u0370-\u03ff\u0400-\u052f"
_STABLE, _UNSTABLE, _LATIN, _SECOND = range(4)
_IS_ZERO, _IS_SPACE, _IS_WIDE, _IS_MARK = (re.compile(f"[{x}]") for x in (ZERO_WIDTH, SPACES, WIDE, MARKS))
_MIXED = re.compile(f"[{_LAT}{_OTHER}{MARKS}]*(?:[{_LAT}][{MARKS}]*[{_OTHER}]|[{_OTHER}][{MARKS}]*[{_LAT}])[{_LAT}{_OTHER}{MARKS}]*")
_LOOKALIKE_WORD = re.compile(f"(?<![{_LAT}{_OTHER}])[{_CYRILLIC}]{{2,}}(?![{_LAT}{_OTHER}])")
_REAL_CYRILLIC = re.compile(f"(?![{_CYRILLIC}])[\u0400-\u052f]")
_ASCII_SPACES = "[\\x0b\\x0c\\x1c-\\x1f]"


def _compatible(c: str) -> bool:
    """Half-width kana and jamo, and Latin ligatures: other forms of ordinary letters."""
    return "\uff65" <= c <= "\uffdc" or "\ufb00" <= c <= "\ufb06"


@cache
def _properties() -> tuple[np.ndarray, re.Pattern]:
    """(class of each code point, pattern of a segment)."""
    out = np.zeros(bulk.TOP + 1, np.uint8)
    special = re.compile(f"[{ZERO_WIDTH}{SPACES}{WIDE}{MARKS}]")
    for k in range(bulk.TOP):
        c = chr(k)
        if k in range(0xD800, 0xE000):
            continue
        maybe = unicodedata.combining(c) or 0x1161 <= k <= 0x11C2
        # quick check for NFC: "no" where the character is not its own normal form, "maybe" where it may join what precedes
        if maybe or special.match(c) or _compatible(c) or (k > 0x7F and not (0xAC00 <= k <= 0xD7A3) and unicodedata.normalize("NFC", c) != c):
            out[k] = _UNSTABLE
    for scripts, what in ((_LAT, _LATIN), (_OTHER, _SECOND)):
        letter = re.compile(f"[{scripts}]")
        for k in range(0x530):
            if out[k] == _STABLE and letter.match(chr(k)):
                out[k] = what
    places = np.flatnonzero(out == _UNSTABLE)
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    runs = "".join(f"\\U{x[0]:08x}-\\U{x[-1]:08x}" for x in np.split(places, cut))
    return out, re.compile(f"[^{runs}]?[{runs}]+", re.DOTALL)


def suspects(texts: list[str | None]) -> np.ndarray:
    """Whether each text has an unstable character, or letters of two scripts side by side."""
    some = np.flatnonzero(np.array([bool(t) for t in texts], bool))
    out = np.zeros(len(texts), bool)
    if not len(some):
        return out
    t = bulk.text([texts[k] for k in some.tolist()])
    c = _properties()[0][np.minimum(t.codes, np.uint32(bulk.TOP))]
    hit = c == _UNSTABLE
    hit[:-1] |= (c[:-1] ^ c[1:] == _LATIN ^ _SECOND) & (c[:-1] >= _LATIN)
    hit |= (t.codes >= 0x400) & (t.codes <= 0x52F) & _alone(t, c)
    out[some] = bulk.between(np.flatnonzero(hit), t.start[:-1], t.start[1:]) > 0
    return out


def _alone(t: bulk.Text, c: np.ndarray) -> np.ndarray:
    """Places in texts that have Cyrillic letters, but only look-alikes."""
    cyrillic = (t.codes >= 0x400) & (t.codes <= 0x52F)
    if not cyrillic.any():
        return cyrillic
    real = cyrillic & ~np.isin(t.codes, [ord(x) for x in _CYRILLIC])
    only = bulk.between(np.flatnonzero(real), t.start[:-1], t.start[1:]) == 0
    return only[np.clip(np.searchsorted(t.start, np.arange(len(t.codes)), side="right") - 1, 0, len(only) - 1)]


def _joins(text: str, at: int) -> bool:
    """Whether an invisible character belongs where it is: in an emoji, or between letters of a joining script."""
    c = text[at]
    before = text[at - 1] if at else ""
    after = text[at + 1] if at + 1 < len(text) else ""
    pictures = ("So", "Sk")
    if c == "\ufe0f" or c == "\ufe0e":
        return before != "" and (unicodedata.category(before) in pictures or before in "#*0123456789" or before in "\u203c\u2049\u2194-\u2199")
    if c not in "\u200c\u200d" or not before or not after:
        return False
    if c == "\u200d" and (unicodedata.category(before) in pictures or before == "\ufe0f") and unicodedata.category(after) in pictures:
        return True
    joining = lambda x: "\u0600" <= x <= "\u0dff" or "\u0f00" <= x <= "\u109f" or "\u1780" <= x <= "\u18af"
    return joining(before) and joining(after)


def _unmix(m: re.Match) -> str:
    """A mixed word in the script of its majority, if look-alikes explain the others; else unchanged."""
    word = m.group()
    latin = [c for c in word if c.isalpha() and ("LATIN" in unicodedata.name(c, ""))]
    other = [c for c in word if c.isalpha() and ("LATIN" not in unicodedata.name(c, ""))]
    to_latin = all(c in TO_LATIN for c in other)
    to_other = all(c in TO_CYRILLIC for c in latin) and all("CYRILLIC" in unicodedata.name(c, "") for c in other)
    if to_latin and (len(latin) >= len(other) or not to_other):
        return "".join(TO_LATIN.get(c, c) for c in word)
    if to_other:
        return "".join(TO_CYRILLIC.get(c, c) for c in word)
    if any(c in TO_LATIN for c in other) and len(latin) > len(other):
        return "".join(TO_LATIN.get(c, c) for c in word)
    return word


def unify_text(text: str) -> tuple[str, list[str]]:
    """The text in one form and which kinds of unstable segments it has."""
    kinds: set[str] = set()

    def canonical(m: re.Match) -> str:
        out, whole, start = [], m.string, m.start()
        for k, c in enumerate(m.group()):
            if _IS_ZERO.match(c):
                if _joins(whole, start + k):
                    out.append(c)
                else:
                    kinds.add("zero_width")
            elif _IS_SPACE.match(c):
                kinds.add("space")
                out.append(" ")
            elif _IS_WIDE.match(c):
                kinds.add("full_width")
                out.append(unicodedata.normalize("NFKC", c))
            elif _compatible(c):
                kinds.add("compatibility")
                out.append(unicodedata.normalize("NFKC", c))
            else:
                if _IS_MARK.match(c):
                    kinds.add("combining")
                out.append(c)
        segment = "".join(out)
        normal = unicodedata.normalize("NFC", segment)
        if normal != segment and not kinds & {"combining"}:
            kinds.add("canonical")
        return normal

    fixed = _properties()[1].sub(canonical, text)
    if not fixed.isascii():
        one = _MIXED.sub(_unmix, fixed)
        if one != fixed:
            kinds.add("mixed_script")
            fixed = one
        if not _REAL_CYRILLIC.search(fixed):
            one = _LOOKALIKE_WORD.sub(lambda m: "".join(TO_LATIN[c] for c in m.group()), fixed)
            if one != fixed:
                kinds.add("lookalike_word")
                fixed = one
    return fixed, sorted(kinds)


def unify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, changed, kinds): every row, in one form. Map-only; pure ASCII never leaves the JVM."""

    @F.pandas_udf("text string, kinds array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ts = part.tolist()
            rows: list[tuple] = [(None, None)] * len(ts)  # sound texts come back from the JVM's side
            for a, b in bulk.chunks(ts):
                for k in np.flatnonzero(suspects(ts[a:b])).tolist():
                    rows[a + k] = unify_text(ts[a + k])
            yield pd.DataFrame(rows, columns=["text", "kinds"])

    src = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    look = (F.octet_length("_t") > F.char_length("_t")) | F.col("_t").rlike(_ASCII_SPACES)
    out = src.withColumn("_u", run(F.when(look, F.col("_t"))))
    text = F.coalesce(F.col("_u.text"), F.col("_t"))
    return out.select(id_col, text.alias("text"), F.coalesce(text != F.col("_t"), F.lit(False)).alias("changed"), F.coalesce(F.col("_u.kinds"), F.array().cast("array<string>")).alias("kinds"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the texts that are cases."""
    return unify(docs, id_col, text_col).where(F.arrays_overlap("kinds", F.array(*[F.lit(x) for x in CASES]))).select(id_col).distinct()
