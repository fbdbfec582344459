"""Problem 2: find text read with the wrong character encoding and restore it.

For every pair (written as A, read as B) the sequences that sound characters turn into are computed
once per Python worker and put into one multi-pattern automaton (Aho-Corasick). One pass over a text
gives all hits; only matched spans are replaced, sound text around them stays untouched.

Families of patterns:
* UTF-8 read as a single-byte encoding (also twice over): each sound character of the European alphabets, GB2312, kana
  and Hangul becomes two to six characters; a hit is replaced by its original, and once a pair is proved, so are
  well-formed UTF-8 runs of rarer characters.
* Cyrillic and Greek single-byte encodings read as one another or as a Western one: single letters tell nothing,
  so frequent letter triples are the patterns; in a sentence with enough hits every pair that has hits there is tried, and
  its words are decoded but for those that look more sound as they are.
* Western, Central European and Turkish single-byte encodings read as another Western one: frequent words are the
  patterns; two different ones prove the pair, and words of the sentences with hits are decoded.
* GB2312, Big5, EUC-KR, Shift-JIS and EUC-JP: runs of double bytes are decoded where the share of the language's frequent
  characters proves it; without proof nothing is replaced.
Western single-byte text read as Cyrillic shows as Cyrillic letters inside Latin words; text read as
UTF-8 shows U+FFFD, which holds no information, so only context (apostrophe, quotation mark, dash,
currency sign) can bring characters back and the others stay.

Patterns made of characters that sound text also uses are weak: they count only in numbers.

Defined results: null, empty and pure ASCII texts are sound; every row is kept; ``hits`` counts spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk

#: Encodings that UTF-8 bytes are taken for.
READ_AS = ("cp1252", "latin1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "koi8_r", "cp866", "cp1257", "iso8859_15", "mac_cyrillic")
CYRILLIC_ENCODINGS = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
CYRILLIC_READ_AS = (*CYRILLIC_ENCODINGS, "cp1252", "latin1", "mac_roman", "cp850", "cp437")
#: Frequent letter triples of Russian.
TRIPLES = "ени ост ого ств про пре ние ова ать ста при ест нов кот раз ции тор ред вер ель ани пос ном сти тел ров ком рез льн ска рас ван ски сто под пол над нос зна общ каж год сле пер тов ков ров ный ной ных ает ени ует или ере сра чив оце нка ряд цен пор руп вае выш риск рын лот вкл сум меж раб кни фон бир ежд ива сво".split()
#: Frequent letter triples of Greek, and the encodings it is written in and read as.
GREEK_TRIPLES = "και του την της των ται στη στο από για που τον τις ναι ουν ατο ότι μεν ικο ματ αντ ειν είν τικ ους εις νος ρισ".split()
GREEK_ENCODINGS, GREEK_READ_AS = ("cp1253", "iso8859_7"), ("cp1252", "latin1", "mac_roman", "cp850", "cp1251")
#: Frequent words with letters outside ASCII, by the encodings they are written in; what these are read as.
WORDS_OF = (
    (("cp1252", "mac_roman", "cp850"), ("cp1252", "mac_roman", "cp850", "cp437", "cp1250"), "für über können müssen größe während später möglich dafür würde également été même après très déjà où à être première está según también más año después información están não são também já até então você situação preço"),
    (("cp1250", "iso8859_2"), ("cp1252", "latin1", "mac_roman"), "się że są też być już może będzie także które został więcej przez można łódź před při být také může však další které když něco jsou není že"),
    (("cp1254",), ("cp1252", "latin1", "mac_roman"), "için değil olduğu olduğunu şey çünkü şimdi şekilde başka göre yılı kadın diğer değer aynı"),
)
#: Multi-byte encodings, what they are read as, and frequent characters with the least share that proves them.
LEGACY_READ_AS = ("cp1252", "latin1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251")
LEGACY = {
    "gb2312": ("的一是了在和有不这中人为以及到个上地我们国要用时而于家可对就也与之其大会出年来说分成行生过能市价量交", 0.12),
    "big5": ("的一是了在和有不這中人為以及到個上地我們國要用時而於家可對就也與之其大會出年來說分成行生過能市價量交", 0.12),
    "euc_kr": ("이다는의에을를가고하지로은한도사서기시어대나자아리그인정일수해들부스보만주과상제전", 0.2),
    "shift_jis": ("のにはをたがでてとしれさるいもなかこらりっうくすまよけきせあそやめつえんスルトンーリクア、。", 0.35),
    "euc_jp": ("のにはをたがでてとしれさるいもなかこらりっうくすまよけきせあそやめつえんスルトンーリクア、。", 0.35),
}
_LATIN_SOUND = [chr(c) for c in range(0xA0, 0x100)] + list("ŒœŠšŽžŸ")
#: Central European, Baltic, Turkish and Greek letters.
_MORE_LETTERS = [chr(c) for c in range(0x100, 0x180) if chr(c) not in _LATIN_SOUND] + [chr(c) for c in range(0x384, 0x3CF)] + list("ȘșȚț")
_PUNCT = list("–—‘’‚“”„†‡•…‰‹›€™−≥≤≠√№")
_CYR = [chr(c) for c in range(0x410, 0x450)] + ["Ё", "ё"]
_CJK_PUNCT = list("。，、（）：；！？《》「」")

_STATE: dict = {}


def _bytes_as(b: bytes, enc: str) -> str | None:
    out = []
    for x in b:
        try:
            out.append(bytes([x]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(x))  # bytes without a meaning often pass through as control characters
    return "".join(out)


def _hanzi() -> list[str]:
    """The characters of GB2312 by rule: rows 16 to 87."""
    out = []
    for row in range(0xB0, 0xF8):
        for cell in range(0xA1, 0xFF):
            try:
                out.append(bytes([row, cell]).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return out


def _double_bytes(enc: str, rows: range) -> list[str]:
    """The characters of a double-byte encoding by rule."""
    out = []
    for row in rows:
        for cell in range(0xA1, 0xFF):
            try:
                out.append(bytes([row, cell]).decode(enc))
            except UnicodeDecodeError:
                pass
    return out


def patterns() -> dict[str, list[tuple[str, str | None, bool]]]:
    """pattern -> [(pair, original or None, weak)]."""
    out: dict[str, list[tuple[str, str | None, bool]]] = {}

    def add(pattern: str, pair: str, original: str | None, weak: bool) -> None:
        if not pattern.isascii() and pattern != original and len(pattern) > 1:
            out.setdefault(pattern, []).append((pair, original, weak))

    hanzi = _hanzi()
    asian = _double_bytes("euc_kr", range(0xB0, 0xC9)) + [chr(c) for c in range(0x3041, 0x30FF)]
    for enc in READ_AS:
        cyrillic = enc in CYRILLIC_ENCODINGS
        for c in _MORE_LETTERS:
            add(_bytes_as(c.encode(), enc), f"utf8>{enc}", c, True)
        for c in _LATIN_SOUND + _PUNCT:
            one = _bytes_as(c.encode(), enc)
            add(one, f"utf8>{enc}", c, cyrillic and len(one) == 2)
            if enc in ("cp1252", "latin1"):
                add(_bytes_as(one.encode(), enc), f"utf8>{enc}x2", c, False)
        for c in _CYR:
            one = _bytes_as(c.encode(), enc)
            add(one, f"utf8>{enc}", c, True)
            if enc in ("cp1252", "latin1"):
                add(_bytes_as(one.encode(), enc), f"utf8>{enc}x2", c, False)
        for c in hanzi + _CJK_PUNCT + asian:
            one = _bytes_as(c.encode(), enc)
            if not (cyrillic and sum("\u0400" <= x <= "\u04ff" for x in one) == len(one)):  # else it may be a sound word
                add(one, f"utf8>{enc}", c, True)
    for written, read, triples in ((CYRILLIC_ENCODINGS, CYRILLIC_READ_AS, TRIPLES), (GREEK_ENCODINGS, GREEK_READ_AS, GREEK_TRIPLES)):
        for a in written:
            for b in read:
                if a != b:
                    for t in triples:
                        for word in (t, t.capitalize()):
                            seen = _bytes_as(word.encode(a), b)
                            if seen.lower() not in triples:
                                add(seen, f"{a}>{b}", None, True)
    for a, b, words in word_pairs():
        for word in words:
            add(word, f"word:{a}>{b}", None, True)
    for c in [h for h in hanzi if h.encode("gb2312")[0] <= 0xD7] + ["。", "，", "（", "）", "、"]:  # level 1, the common ones
        add(_bytes_as(c.encode("gb2312"), "cp1252"), "gb2312>cp1252", None, True)
    return out


def word_pairs() -> Iterator[tuple[str, str, dict[str, str]]]:
    """(written as, read as, garbled form -> word) of the frequent words; forms that are words themselves are left out."""
    sound = {w for _, _, words in WORDS_OF for w in words.split()}
    for written, read, words in WORDS_OF:
        for a in written:
            for b in read:
                forms = {}
                for w in words.split():
                    for word in (w, w.capitalize()):
                        try:
                            seen = _bytes_as(word.encode(a), b)
                        except UnicodeEncodeError:
                            continue
                        if seen != word and seen.lower() not in sound and len(seen) > 1:
                            forms[seen] = word
                if a != b:
                    yield a, b, forms


def _state() -> dict:
    if not _STATE:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p, what in patterns().items():
            machine.add_word(p, (len(p), what))
        machine.make_automaton()
        _STATE["machine"] = machine
        _STATE["back"] = {}
        western = {}
        for c in _LATIN_SOUND:
            try:
                w, b = bytes([c.encode("cp1252")[0]]).decode("cp1251"), c
            except UnicodeError:
                continue
            if "\u0400" <= w <= "\u04ff":
                western[w] = b
        western["\u0402"] = "€"
        _STATE["western"] = western
    return _STATE


_CYR_IN_LATIN = re.compile("(?<=[A-Za-zÀ-ɏ])[\u0400-\u04ff]+|[\u0400-\u04ff]+(?=[a-zß-ɏ])|\u0402(?=\\d)")
_SENTENCES = re.compile(r"[^.!?。\n]+[.!?。\n]*")
_LOST = re.compile("\ufffd")
_INNER_CAPITAL = re.compile("[\u0430-\u044f][\u0410-\u042f]")
_UTF8 = re.compile(b"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_UTF8_RUN = re.compile(b"(?:" + _UTF8.pattern + b")+")
_HIGH_RUN = re.compile(r"[^\x00-\x7f\u0400-\u04ff\u2e80-\uffff]{3}")
_CJK = re.compile("[\u4e00-\u9fff]")


# Classes of characters for the quick check.
_PLAIN, _LOWER, _UPPER, _LOW_LATIN, _UP_LATIN, _LOW_CYR, _UP_CYR, _EURO, _FINE, _BAD = range(10)


@cache
def _quick() -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, whether a pair of classes is suspect: 16 * first + second)."""
    of = np.full(bulk.TOP + 1, _BAD, np.uint8)
    for what, low, high in (
        (_PLAIN, 0, 0x7F), (_LOWER, 0x61, 0x7A), (_UPPER, 0x41, 0x5A), (_LOW_LATIN, 0xDF, 0xF6), (_LOW_LATIN, 0xF8, 0xFF), (_UP_LATIN, 0xC0, 0xD6), (_UP_LATIN, 0xD8, 0xDE),
        (_LOW_CYR, 0x430, 0x44F), (_UP_CYR, 0x410, 0x42F), (_FINE, 0x4E00, 0x9FFF), (_EURO, 0x20AC, 0x20AC),
    ):
        of[low : high + 1] = what
    for c in "ŒœŠšŽž–—‘’“”。（），、：；！？":
        of[ord(c)] = _FINE
    of[ord("Š")] = of[ord("š")] = of[ord("Ž")] = of[ord("ž")] = _BAD
    for c in "ðþÐÞ":
        of[ord(c)] = _BAD
    of[0x451], of[0x401] = _LOW_CYR, _UP_CYR
    pair = np.zeros(256, bool)
    latin, cyrillic, outside = (_LOWER, _UPPER, _LOW_LATIN, _UP_LATIN), (_LOW_CYR, _UP_CYR), range(_LOW_LATIN, _BAD + 1)
    for x, y in [(_LOW_LATIN, _EURO), *((_UP_LATIN, y) for y in outside), (_LOWER, _UP_LATIN), (_LOW_LATIN, _UP_LATIN), *((x, y) for x in latin for y in cyrillic), *((x, y) for x in cyrillic for y in latin)]:
        pair[16 * x + y] = True
    return of, pair


def suspects(texts: list[str | None]) -> np.ndarray:
    """Whether each text has something that no sound text of the covered languages has.

    It may say yes for sound text (single symbols, capital headings), never no for text with hits.
    """
    out = np.array([bool(t) and not t.isascii() for t in texts], bool)
    some = np.flatnonzero(out)
    if not len(some):
        return out
    mine = [texts[k] for k in some.tolist()]
    codes = bulk.codes_of("\n".join(mine) + "\n")
    of, pair = _quick()
    c = of[np.minimum(codes, np.uint32(bulk.TOP))]
    hit = c == _BAD
    hit[:-1] |= pair[c[:-1] * np.uint8(16) + c[1:]]
    three = (c[:-2] == _LOW_LATIN) & (c[1:-1] == _LOW_LATIN) & (c[2:] == _LOW_LATIN)
    three |= (c[:-2] == _LOW_CYR) & (c[1:-1] == _UP_CYR) & (c[2:] == _UP_CYR)
    hit[:-2] |= three
    ends = np.cumsum([len(t) + 1 for t in mine])
    out[some] = bulk.between(np.flatnonzero(hit), np.concatenate([[0], ends[:-1]]), ends) > 0
    return out


def suspect(text: str) -> bool:
    return bool(suspects([text])[0])


def sound(texts: list[str | None]) -> list[str | None]:
    """The texts, those with garbled characters restored."""
    out = list(texts)
    for k in np.flatnonzero(suspects(out)).tolist():
        out[k] = _repair(out[k])[0]
    return out


def _decode_chars(s: str, pair: str) -> str:
    """Undo 'written as a, read as b' for the characters that b can express; others stay."""
    back = _STATE["back"].get(pair)
    if back is None:
        a, b = pair.split(">")
        back = {}
        for x in range(0x80, 0x100):
            try:
                back[_bytes_as(bytes([x]), b)] = bytes([x]).decode(a)
            except UnicodeDecodeError:
                pass
        _STATE["back"][pair] = back
    return "".join(back.get(c, c) for c in s)


def _rank(pair: str) -> int:
    return READ_AS.index(pair.removeprefix("utf8>").removesuffix("x2"))


def _triples(s: str, pair: str = "") -> int:
    low = s.lower()
    n = sum(low.count(t) for t in (GREEK_TRIPLES if pair.startswith(GREEK_ENCODINGS) else TRIPLES))
    return n - len(_INNER_CAPITAL.findall(s)) if n else n


def _to_bytes(enc: str) -> dict[str, int]:
    """Character -> byte of an encoding; bytes without a meaning pass through as control characters."""
    table = _STATE["back"].get("bytes:" + enc)
    if table is None:
        table = _STATE["back"]["bytes:" + enc] = {_bytes_as(bytes([x]), enc): x for x in range(256)}
    return table


def _raw(text: str, enc: str) -> bytes:
    """One byte for each character: that of the encoding, or 0."""
    table = _to_bytes(enc)
    return bytes([table.get(c, 0) for c in text])


#: Runs that may be double bytes: of high bytes, or of high bytes with any byte behind.
_DOUBLE = re.compile(b"[\x80-\xff]{2,}")
_DOUBLE_TRAIL = re.compile(b"(?:[\x80-\xff][\x40-\x7e\x80-\xff])+")


def _legacy_runs(raw: bytes, enc: str, least: int) -> Iterator[tuple[bytes, int, int]]:
    for m in (_DOUBLE_TRAIL if enc in ("big5", "shift_jis") else _DOUBLE).finditer(raw):
        if m.end() - m.start() >= least:
            yield m.group(), m.start(), m.end()


def _legacy(text: str) -> tuple[str, int, str | None]:
    """(text with the runs of a multi-byte encoding decoded, runs, pair), where frequent characters prove it."""
    best: tuple[float, str, bytes, str] | None = None
    for b in LEGACY_READ_AS:
        raw = _raw(text, b)
        for a, (frequent, least) in LEGACY.items():
            good = shown = length = 0
            for run, _, _ in _legacy_runs(raw, a, 4):
                length += len(run)
                try:
                    d = run.decode(a)
                except UnicodeDecodeError:
                    continue
                wide = [c for c in d if c > "\u2e7f"]
                if len(wide) < 2 or len(wide) < 0.9 * (len(d) - d.count(" ")) and len(wide) < 0.9 * sum(c > "\x7f" for c in d):
                    continue
                shown += len(wide)
                good += sum(c in frequent for c in wide)
            if shown >= 6 and 2.4 * shown >= length and good >= least * shown and (best is None or good / shown / least > best[0]):
                best = (good / shown / least, a, raw, b)
    if best is None:
        return text, 0, None
    _, a, raw, b = best
    n, parts, at = 0, [], 0
    for run, x, y in _legacy_runs(raw, a, 2):
        try:
            d = run.decode(a)
        except UnicodeDecodeError:
            continue
        if any(c > "\u2e7f" for c in d):
            parts += [text[at:x], d]
            at, n = y, n + 1
    return "".join(parts) + text[at:], n, f"{a}>{b}"


def _rest(text: str, enc: str) -> str:
    """Runs of high bytes of an encoding that are well-formed UTF-8, decoded."""
    parts, at = [], 0
    for m in _DOUBLE.finditer(_raw(text, enc)):
        if _UTF8_RUN.fullmatch(m.group()):
            parts += [text[at : m.start()], m.group().decode("utf-8", "ignore")]
            at = m.end()
    return "".join(parts) + text[at:]


def _words_of(text: str, hits: list, weak: Counter) -> tuple[str, int, str | None]:
    """Single-byte text read as another Western encoding, sentence by sentence; two different frequent words prove a pair."""
    pairs = [p for p in weak if p.startswith("word:")]
    seen: dict[str, list[tuple[int, str]]] = {p: [] for p in pairs}
    for end, (n, what) in hits:
        a, b = end - n + 1, end + 1
        if (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha()):
            continue
        for p, _, _ in what:
            if p in seen:
                seen[p].append((a, text[a:b]))
    pair = max(pairs, key=lambda p: (len({w for _, w in seen[p]}), len(seen[p]), p))
    if len({w for _, w in seen[pair]}) < 2:
        return text, 0, None
    places = [a for a, _ in seen[pair]]
    parts, at, n = [], 0, 0
    for m in _SENTENCES.finditer(text):
        if any(m.start() <= a < m.end() for a in places):
            fixed = re.sub(r"\S*[^\x00-\x7f]\S*", lambda w: _decode_chars(w.group(), pair[5:]), m.group())
            n += fixed != m.group()
            parts += [text[at : m.start()], fixed]
            at = m.end()
    return "".join(parts) + text[at:], n, pair[5:]


def _gb_run(run: str) -> str | None:
    b = bytearray()
    for c in run:
        try:
            b += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 0xFF:
                return None
            b.append(ord(c))
    try:
        return b.decode("gb2312")
    except UnicodeDecodeError:
        return None


_GB_RUN = re.compile("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{2,}")


def _recover_lost(text: str) -> str:
    t = re.sub("(?<=[A-Za-zÀ-ɏ])\ufffd(?=(?:s|t|re|ve|ll|d|m)\\b)", "\u2019", text)
    t = re.sub("\ufffd(?=\\d)", "€", t)
    t = re.sub("(?<=\\s)\ufffd(?=\\s)", "\u2014", t)
    t = re.sub("(?<![^\\s])\ufffd(?=[A-Z][a-z])", "\u201c", t)
    return re.sub("(?<=[,.])\ufffd(?=\\s|$)", "\u201d", t)


def repair_text(text: str) -> tuple[str, int, str | None]:
    """(restored text, garbled spans, most frequent pair)."""
    return _repair(text) if suspect(text) else (text, 0, None)


def _repair(text: str) -> tuple[str, int, str | None]:
    state = _state()
    hits = list(state["machine"].iter(text))
    lost = len(_LOST.findall(text))
    strong: Counter = Counter()
    weak: Counter = Counter()
    cover: Counter = Counter()
    for _, (n, what) in hits:
        for pair, _, w in what:
            (weak if w else strong)[pair] += 1
            cover[pair] += n
    most = max(cover.values(), default=0)
    spans, best = lost, "lost" if lost else None
    out = text

    # text of a Western encoding read as a Cyrillic one
    mixed = [m for m in _CYR_IN_LATIN.finditer(text) if all(c in state["western"] for c in m.group())]

    # double-byte text, where chance hits of UTF-8 patterns are few
    if max(strong.values(), default=0) < 5 and _HIGH_RUN.search(text):
        out, n, pair = _legacy(text)
        if n:
            return out, spans + n, pair

    # UTF-8 read as something else: replace the hits of the pairs that are proved
    proved = {p for p in strong if p.startswith("utf8")}
    for p, n in weak.items():
        if p.startswith("utf8") and n + 2 * strong[p] >= 3 and (strong[p] or cover[p] >= 0.6 * most):
            proved.add(p)
    if cover["gb2312>cp1252"] >= 1.5 * max((cover[p] for p in proved), default=0):
        if any(len(r) >= 6 and (d := _gb_run(r)) and len(_CJK.findall(d)) >= 3 for r in _GB_RUN.findall(text)):
            proved = set()
    if proved:
        order = {p: (strong[p] + weak[p], -i) for i, p in enumerate(sorted(proved, key=_rank))}
        chosen: list[tuple[int, int, str]] = []
        for end, (n, what) in hits:
            use = [(order[p], o) for p, o, _ in what if p in proved and o is not None]
            if use:
                chosen.append((end - n + 1, end + 1, max(use)[1]))
        chosen.sort(key=lambda x: (x[0], -(x[1] - x[0])))
        parts, at, n_rep = [], 0, 0
        for a, b, o in chosen:
            if a >= at:
                parts += [text[at:a], o]
                at = b
                n_rep += 1
        out = "".join(parts) + text[at:]
        if n_rep:
            spans += n_rep
            best = max(proved, key=lambda p: order[p])
            mixed = []
            if not best.endswith("x2") and best[5:] not in CYRILLIC_ENCODINGS:
                out = _rest(out, best[5:])  # rare characters of a proved pair
            if n_rep >= 2 and any(0x80 <= ord(c) for c in out):
                again, more, _ = repair_text(out) if out != text else (out, 0, None)
                out, spans = again, spans + more
            return out, spans, best

    # Cyrillic single-byte pairs, sentence by sentence
    pairs = {p for p, n in weak.items() if not p.startswith(("utf8", "gb2312", "word:")) and n >= 3}
    if pairs:
        parts = []
        near = sorted((end, n, [p for p, _, _ in what if p in pairs]) for end, (n, what) in hits)
        at_hit = 0
        for m in _SENTENCES.finditer(out):
            s = m.group()
            here: Counter = Counter()
            while at_hit < len(near) and near[at_hit][0] < m.end():  # places hold as long as nothing was replaced
                here.update(near[at_hit][2])
                at_hit += 1
            base, pick, garbled = 0, None, s
            for p in sorted(here, key=lambda p: (-here[p], -weak[p], p)):
                before, d = _triples(garbled, p), _decode_chars(garbled, p)
                n = _triples(d, p)
                if n >= max(base, before) + (1 if best == p else 2):
                    base, pick, s = n, p, d
            if pick:  # words that look sound as they are stay
                s = "".join(x if _triples(x, pick) > _triples(y, pick) else y for x, y in zip(re.split(r"(\s+)", garbled), re.split(r"(\s+)", s))) if len(re.split(r"(\s+)", garbled)) == len(re.split(r"(\s+)", s)) else s
            parts.append(s)
            if pick:
                spans += 1
                best = pick
        if best and best != "lost":
            # keep what the sentence pattern skipped
            rebuilt, at = [], 0
            for m, s in zip(_SENTENCES.finditer(out), parts):
                rebuilt += [out[at : m.start()], s]
                at = m.end()
            out = "".join(rebuilt) + out[at:]
            mixed = []

    # GB2312 read as a Western encoding
    if weak["gb2312>cp1252"] >= 3 and cover["gb2312>cp1252"] >= 0.6 * most:

        def undo(m: re.Match) -> str:
            d = _gb_run(m.group())
            return d if d is not None and (len(_CJK.findall(d)) >= 2 or len(d) <= 3) else m.group()

        runs = [m.group() for m in _GB_RUN.finditer(out)]
        good = [r for r in runs if len(r) >= 6 and (d := _gb_run(r)) and len(_CJK.findall(d)) >= 3]
        shown = "".join(_gb_run(r) for r in good)
        # frequent characters or marks prove it; other double-byte text would come out as rare ones
        if good and (sum(c in LEGACY["gb2312"][0] for c in shown) >= 0.08 * len(_CJK.findall(shown)) or re.search("[，。]", shown)):
            out = _GB_RUN.sub(undo, out)
            spans += len(good)
            best = best or "gb2312>cp1252"
    if best in (None, "lost") and any(p.startswith("word:") for p in weak):
        out, n, pair = _words_of(out, hits, weak)
        spans, best = spans + n, pair or best

    if mixed:
        out = _CYR_IN_LATIN.sub(lambda m: "".join(state["western"].get(c, c) for c in m.group()), out)
        spans += len(mixed)
        best = best or "cp1252>cp1251"
    if lost:
        out = _recover_lost(out)
    return out, spans, best


def repair(records: DataFrame, id_col: str = "result_id", text_col: str = "text") -> DataFrame:
    """(id, text, hits, pair): one row per input row; map-only, so no text is shuffled."""
    src = records.select(F.col(id_col), F.col(text_col).alias("_t"))

    @F.pandas_udf("text string, hits int, pair string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            ts = part.tolist()
            rows: list[tuple] = [(None, 0, None)] * len(ts)  # sound texts stay in the JVM
            for a, b in bulk.chunks(ts):
                for k in np.flatnonzero(suspects(ts[a:b])).tolist():
                    rows[a + k] = _repair(ts[a + k])
            yield pd.DataFrame(rows, columns=["text", "hits", "pair"])

    # pure ASCII needs no look
    fixed = src.withColumn("_r", run(F.when(F.octet_length("_t") > F.char_length("_t"), F.col("_t"))))
    return fixed.select(id_col, F.coalesce("_r.text", "_t").alias("text"), F.coalesce("_r.hits", F.lit(0)).alias("hits"), F.col("_r.pair").alias("pair"))


def found(records: DataFrame) -> DataFrame:
    """Ids of records with garbled text; repeated deliveries are merged on ids alone."""
    return repair(records).where("hits > 0").select("result_id").distinct()
