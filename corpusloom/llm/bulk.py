"""Words of many texts at once, as arrays: no Python object per word.

The texts of a batch become one array of code points; classes of characters, word limits and word hashes are
array operations over it. A word is a piece between white space, lower case, with everything but letters and
digits removed; empty pieces are dropped (TESTDATA.md). Null texts have no words. Hashes are 64-bit sums of
code points times powers of an odd number by place, mixed; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: No letter, digit or white space lies beyond this code point.
TOP = 0x323B0
OTHER, ALNUM, SPACE = 0, 1, 2
#: Characters of one piece of work: bounds the arrays, whatever the batch.
CHUNK = 150_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PLACES = 4096


@cache
def classes() -> np.ndarray:
    """Class of each code point up to TOP."""
    return np.array([ALNUM if c.isalnum() else SPACE if c.isspace() else OTHER for c in map(chr, range(TOP))] + [OTHER], np.uint8)


@cache
def _powers() -> np.ndarray:
    out = np.ones(_PLACES, np.uint64)
    for k in range(1, _PLACES):
        out[k : k + 1] = out[k - 1 : k] * _M1  # as arrays, whose overflow is defined
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def codes_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def class_of(codes: np.ndarray) -> np.ndarray:
    return classes()[np.minimum(codes, np.uint32(TOP))]


@dataclass
class Words:
    """Words of a list of texts: ``hash`` and ``length`` of each, ``doc`` (number of its text), ``first`` (number of the
    first word of each text, with one more entry at the end), ``place`` of its first letter or digit among the code points
    of the lower-case texts, each with a line break behind."""

    hash: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    place: np.ndarray


def hash_runs(codes: np.ndarray, starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Hash of the counted code points from each start to the next; the first start is 0 or what lies before is not counted."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes, counted = codes[starts[0] :], counted[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    value = (codes.astype(np.uint64) + np.uint64(1)) * _powers()[place & (_PLACES - 1)]
    value *= counted
    return mix(np.add.reduceat(value, starts))


def words(texts: Iterable[str | None]) -> Words:
    lowered = [t.lower() if t else "" for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    codes = codes_of("\n".join(lowered) + "\n") if lowered else np.zeros(0, np.uint32)
    kind = class_of(codes)
    keep = np.flatnonzero(kind)
    codes, space = codes[keep], kind[keep] == SPACE
    before = np.empty_like(space)
    before[:1] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    lengths = ends - starts
    edges = np.searchsorted(keep, np.cumsum(sizes) - 1)  # the line break after each text
    first = np.concatenate([[0], np.searchsorted(starts, edges)]).astype(np.int64)
    doc = np.repeat(np.arange(len(lowered)), np.diff(first))
    return Words(hash_runs(codes, starts, ~space), lengths, doc, first, keep[starts])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of a list with at most CHUNK characters, one text at least."""
    a = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK:
            yield a, k
            a, size = k, 0
        size += n + 1
    if a < len(texts):
        yield a, len(texts)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of all sequences of n words that lie within one text; ``first`` as in Words."""
    m = len(w.hash) - n + 1
    sizes = np.maximum(0, np.diff(w.first) - n + 1)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if m <= 0:
        return np.zeros(0, np.uint64), first
    inside = w.doc[:m] == w.doc[n - 1 :]
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h + w.hash[k : k + m]) * _M1
        h ^= h >> np.uint64(29)
    return mix(h[inside]), first


@dataclass
class Text:
    """Texts as they are, one after the other with a line break behind each: code points, classes, first places."""

    codes: np.ndarray
    kind: np.ndarray
    start: np.ndarray  # of each text, with one more entry at the end


def text(texts: Iterable[str | None]) -> Text:
    texts = [t or "" for t in texts]
    codes = codes_of("\n".join(texts) + "\n") if texts else np.zeros(0, np.uint32)
    return Text(codes, class_of(codes), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64))


def between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of the rising places lie in low <= place < high, for each range."""
    return np.searchsorted(places, high) - np.searchsorted(places, low)


@dataclass
class Lines:
    """Lines that are not blank: text of each, first and last place that is no white space."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


def lines(t: Text) -> Lines:
    ends = np.flatnonzero(t.codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    solid = np.flatnonzero(t.kind != SPACE)
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    a, b = a[some], b[some]
    doc = np.searchsorted(t.start, starts[some], side="right") - 1
    return Lines(doc, solid[a] if len(solid) else a, solid[b - 1] if len(solid) else b)


def sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each text."""
    return np.bincount(doc, weights=values, minlength=n)


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first place of each group) of the distinct sorted values of each group; ``first`` has one more entry."""
    h = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][np.diff(first) > 0]] = True  # groups of one value each begin anew
    return h[new], np.concatenate([[0], np.cumsum(new)])[first]
