"""Problem 9: passages of held-out test items inside a corpus.

Both sides are brought to words (lower case, letters and digits) joined by single spaces. For a block of items an index of
their character q-grams is built once on the driver and broadcast (``BLOCK`` bounds it); the corpus is read in one
map-only pass per block. In a document every q-gram found in the index is a hit on a diagonal (place in the document
minus place in the item).

1. Hits are counted in overlapping diagonal bands, as wide as the item's edit budget can shift. A band is a region if it
   has as many hits as the cheapest five-word sequence brings, or as the q-gram lemma demands of a third of the item within
   the budget of ``BUDGET`` edits a character. A pair stays if the places hit in its regions are as many as the cheapest third
   of the item's sequences covers together, or if one region meets the edit-budget bound.
2. The hits of a region fall into pieces without large gaps, and every piece is verified by banded alignment. Along its hits
   a piece aligns with no more edits than it has characters outside hits, and one for each step between diagonals; so
   length less edits plus steps is never below the characters in hits. Pairs whose pieces together stay below what a third
   of the sequences covers, and which have no passage within the edit budget, are dropped.
3. The exact share of five-word sequences is taken for what the alignment has kept; ``found`` needs a third of them.

Both bounds lose nothing. ``leaks`` also reports pairs whose alignment alone shows a passage within the budget (edits
spread over a passage leave few whole sequences), with all passages.

Defined results: null, empty and blank texts leak nothing; items with fewer than five words count when
the document holds the item's whole word sequence; copies of documents and items each get their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk

Q = 8
WORDS = 5
SHARE = 1 / 3
#: Edits a character of a passage, at most; least width of a diagonal band in characters, bands overlap by half.
BUDGET, BAND = 0.05, 64
#: Items of one pass.
BLOCK = 20_000
#: A q-gram of more places than this is common; an item whose own q-grams bound below ENOUGH uses all.
RARE, ENOUGH = 8, 24
#: Largest gap and step of a piece, in characters.
GAP, STEP = 16, 8
#: Items of more sequences than this get a simpler bound.
LONG_ITEM = 400
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def plain_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words of all texts, joined by spaces, a line break behind each text; start of each text and the end)."""
    t = bulk.text([x.lower() if x else "" for x in texts])
    space = t.kind == bulk.SPACE
    edge = np.zeros(len(t.codes), bool)
    edge[t.start[1:] - 1] = True
    keep = np.flatnonzero((t.kind == bulk.ALNUM) | space)
    codes, space, edge = t.codes[keep], space[keep], edge[keep]
    # one space between words, none at either end of a text
    before = np.ones(len(codes), bool)
    before[1:] = space[:-1]
    drop = space & before & ~edge
    drop[:-1] |= space[:-1] & ~edge[:-1] & edge[1:]  # a space before the end of a text
    out = np.where(edge, np.uint32(10), np.where(space, np.uint32(32), codes))[~drop]
    return out, np.concatenate([[0], np.flatnonzero(edge[~drop]) + 1]).astype(np.int64)


def plain(text: str) -> str:
    codes, _ = plain_codes([text])
    return text_of(codes[:-1])


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def sequences(words: list[str]) -> set[str]:
    if len(words) < WORDS:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)}


def qgrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams (eight code points) of an array of code points."""
    h = codes.astype(np.uint64)
    for step, shift in ((1, 31), (2, 29), (4, 32)):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * _MULT + h[step:]
        h ^= h >> np.uint64(shift)
    return h * _MULT


def fewest_places(windows: list[tuple[int, int]], need: int, counted: np.ndarray) -> int:
    """Fewest counted places that any ``need`` of the windows (start, places; by start) cover together.

    Consecutive chosen windows share what overlaps, so a window adds what lies before the next chosen one
    or all its places, whichever is less; the cheapest choice is a shortest path of ``need`` steps. Of very many windows,
    the counted starts: each chosen window has one of its own.
    """
    start, places = np.array(windows, dtype=np.int64).T
    cum = np.concatenate([[0], np.cumsum(counted)])
    last = len(cum) - 1
    at = cum[np.minimum(start, last)]
    if len(start) > LONG_ITEM:
        first = cum[np.minimum(start + 1, last)] - at
        return max(0, int(need - (first == 0).sum()))
    own = cum[np.minimum(start + places, last)] - at
    cost = np.minimum(at[None, :] - at[:, None], own[:, None]).astype(float)
    cost[np.tril_indices(len(start))] = np.inf
    f = np.zeros(len(start))
    for _ in range(need - 1):
        f = (f[:, None] + cost).min(axis=0)
    return int((f + own).min())


class Index:
    """q-gram places of a block of items, and the bounds of each item."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE):
        self.share = share
        self.codes: list[np.ndarray] = []
        self.ids, self.texts, self.seqs, self.few = [], [], [], []
        windows, keys = [], []
        for i, text in items:
            p = plain(text or "")
            words = p.split(" ") if p else []
            if not words:
                continue
            # sequence -> (start, q-grams inside it), at its first occurrence
            first: dict[str, tuple[int, int]] = {}
            start = 0
            for k in range(max(1, len(words) - WORDS + 1)):
                s = " ".join(words[k : k + WORDS])
                first.setdefault(s, (start, max(0, len(s) - Q + 1)))
                start += len(words[k]) + 1
            self.ids.append(i)
            self.texts.append(p)
            self.codes.append(bulk.codes_of(p))
            self.seqs.append(sequences(words))
            self.few.append(len(words) < WORDS)
            windows.append(list(first.values()))
            keys.append(qgrams(bulk.codes_of(p)))
        n = len(keys)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        every, back, n_every = np.unique(key, return_inverse=True, return_counts=True)
        rare = (n_every <= RARE)[back] if len(key) else np.zeros(0, bool)
        ends = np.cumsum([len(h) for h in keys]).tolist()
        kept = np.zeros(len(key), bool)
        self.bound, self.cover, self.region, self.edits, self.band = (np.ones(n, np.int64) for _ in range(5))
        for k, end in enumerate(ends):
            part = slice(end - len(keys[k]), end)
            need = max(1, math.ceil(share * len(self.seqs[k]) - 1e-9))
            counted = rare[part]
            # q-grams that many items share say little; an item is told by its own ones where they suffice
            bound = fewest_places(windows[k], need, counted)
            if bound < ENOUGH:
                counted = np.ones(len(keys[k]), bool)
                bound = fewest_places(windows[k], need, counted)
            kept[part] = counted
            cum = np.concatenate([[0], np.cumsum(counted)])
            # characters in kept q-grams
            chars = np.convolve(counted, np.ones(Q, int))[: len(self.texts[k])] > 0 if len(counted) else np.zeros(0, bool)
            self.bound[k] = bound
            self.cover[k] = fewest_places([(a, m + Q - 1) for a, m in windows[k]], need, chars) if len(chars) else 0
            own = [int(cum[min(a + m, len(cum) - 1)] - cum[min(a, len(cum) - 1)]) for a, m in windows[k]]
            self.region[k] = max(1, min([x for x in own if x] or [1]))
            # q-gram lemma: a third of the item with the budget's edits keeps so many of its kept q-grams
            length = max(Q, math.ceil(share * len(self.texts[k])))
            budget = math.floor(BUDGET * length)
            inside = cum[length - Q + 1 :] - cum[: len(cum) - (length - Q + 1)] if len(cum) > length - Q + 1 else cum[-1:]
            lemma = int(inside.min()) - budget * Q
            self.edits[k] = lemma if lemma >= ENOUGH else 1 << 30  # too few q-grams to tell: whole sequences must
            self.band[k] = max(BAND, 2 * math.ceil(BUDGET * len(self.texts[k])))
        self.short = [k for k, b in enumerate(self.bound.tolist()) if b < 1]
        item = np.repeat(np.arange(n, dtype=np.int32), [len(h) for h in keys])
        place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in keys]) if keys else np.zeros(0, np.int32)
        key, item, place = key[kept], item[kept], place[kept]
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.uniq, self.from_, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.quick = np.zeros(1 << _BITS, bool)
        self.quick[(self.uniq >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hits (pair, place in the item, place in the text) in the regions of the pairs within the bounds, by pair and
        place. A pair is document * items + item."""
        none = (np.zeros(0, np.int64),) * 3
        h = qgrams(codes)
        at = np.flatnonzero(self.quick[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.uniq):
            return none
        slot = np.minimum(np.searchsorted(self.uniq, h[at]), len(self.uniq) - 1)
        ok = self.uniq[slot] == h[at]
        at, slot = at[ok], slot[ok]
        n = self.count[slot]
        total = int(n.sum())
        if not total:
            return none
        rep = np.repeat(np.arange(len(at)), n)
        entry = np.arange(total) + np.repeat(self.from_[slot] - (np.cumsum(n) - n), n)
        doc = (np.searchsorted(starts, at, side="right") - 1)[rep]
        item = self.item[entry].astype(np.int64)
        pair = doc * len(self.ids) + item
        # hits with repeats are at least as many as places: a cheap first cut
        seen, back, often = np.unique(pair, return_inverse=True, return_counts=True)
        least = np.minimum(np.maximum(1, self.bound), self.edits)[seen % len(self.ids)]
        near = (often >= least)[back]
        pair, item, place, where = pair[near], item[near], self.place[entry][near].astype(np.int64), at[rep][near]
        if not len(pair):
            return none
        where = where - starts[pair // len(self.ids)]
        shift = where - place + (1 << 30)
        # hits of each pair in each of the overlapping bands
        in_region, met = np.zeros(len(pair), bool), np.zeros(len(pair), bool)
        for half in (0, 1):
            width = self.band[item]
            band = (shift + half * (width // 2)) // width
            _, back, c = np.unique(pair * (1 << 31) + band, return_inverse=True, return_counts=True)
            in_region |= c[back] >= np.minimum(self.region, self.edits)[item]
            met |= c[back] >= self.edits[item]
        pair, item, place, where, met = pair[in_region], item[in_region], place[in_region], where[in_region], met[in_region]
        # distinct places of the item hit in regions
        order = np.lexsort((where - place, place, pair))
        pair, place, where, met = pair[order], place[order], where[order], met[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
        seen, back = np.unique(pair, return_inverse=True)
        places = np.bincount(back, weights=new, minlength=len(seen))
        good = (places >= np.maximum(1, self.bound)[seen % len(self.ids)]) | (np.bincount(back, weights=met, minlength=len(seen)) > 0)
        keep = good[back]
        return pair[keep], place[keep], where[keep]


def align(doc: np.ndarray, item: np.ndarray, width: int) -> int:
    """Edits of the best banded alignment of the whole item piece with the whole document piece; no more than ``width``
    places off the diagonals between their starts and their ends."""
    n, m = len(item), len(doc)
    width = max(width, abs(n - m)) + 1
    w = 2 * width + 1
    pad = np.full(n + w + 1, np.uint32(0xFFFFFFFF))
    pad[width : width + min(m, n + width + 1)] = doc[: n + width + 1]
    step = np.arange(w)
    d = np.abs(step - width)  # before the first letter of the item: letters of the document only
    d[step < width] = 1 << 20
    for i in range(n):
        same = pad[i : i + w] != item[i]
        row = np.minimum(d + same, np.append(d[1:], 1 << 20) + 1)
        d = np.minimum.accumulate(row - step) + step
    return int(d[width + m - n])


def pieces(place: np.ndarray, where: np.ndarray) -> list[tuple[int, int, int, int, int, bool]]:
    """(item from, item to, document from, document to, steps, without any gap) of the pieces of one pair's hits.

    Hits are walked by diagonal neighbourhood and place; a piece has no gap above GAP and no step above STEP.
    """
    diag = where - place
    order = np.lexsort((place, diag))
    place, where, diag = place[order], where[order], diag[order]
    out = []
    # runs on one diagonal first, then runs that follow each other with a small step are one piece
    cut = np.flatnonzero((np.diff(diag) != 0) | (np.diff(place) > GAP)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
    runs = sorted(zip(place[begin].tolist(), place[end].tolist(), diag[begin].tolist(), (end - begin + 1).tolist()))
    for a, b, d, n in runs:
        for k in range(len(out) - 1, max(-1, len(out) - 9), -1):
            x = out[k]
            if 0 < a - x[1] <= GAP + Q and b > x[1] and 0 < abs(d - x[3]) <= STEP and a + d > x[1] + x[3]:
                out[k] = (x[0], b, x[2], d, x[4] + abs(d - x[3]), 0)
                break
        else:
            out.append((a, b, d, d, 0, n))
    return [(a, b + Q, a + d, b + e + Q, steps, n == b - a + 1) for a, b, d, e, steps, n in out]


PASSAGES = "array<struct<start:int,end:int,item_start:int,item_end:int,similarity:double>>"


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, shared, share, similarity, passages): one row per leaking pair; places count in the words of the
    text joined by single spaces; similarity is that of the longest passage."""
    n = items.count()
    out = None
    numbered = items.select("item_id", "text")
    blocks = max(1, math.ceil(n / BLOCK))
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found_ = _pass(docs, [(r["item_id"], r["text"]) for r in part.collect()], share)  # one bounded block
        out = found_ if out is None else out.unionByName(found_)
    return out


def _pass(docs: DataFrame, items: list[tuple[int, str]], share: float) -> DataFrame:
    names = ["doc_id", "item_id", "shared", "share", "similarity", "passages"]
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, share))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for part in parts:
            ids, texts = part["doc_id"].tolist(), part["text"].tolist()
            for a, b in bulk.chunks(texts):
                rows = [(ids[a + d], *rest) for d, *rest in verified(index, texts[a:b])]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    schema = f"doc_id long, item_id long, shared int, share double, similarity double, passages {PASSAGES}"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def verified(index: Index, texts: list[str | None]) -> list[tuple]:
    """(document number, item id, shared, share, similarity, passages) of the pairs that alignment verifies."""
    codes, starts = plain_codes(texts)
    pair, place, where = index.regions(codes, starts)
    out, seqs = [], {}
    cuts = np.flatnonzero(np.diff(pair)) + 1
    todo = [(int(p[0]) // len(index.ids), int(p[0]) % len(index.ids), x, y) for p, x, y in zip(np.split(pair, cuts), np.split(place, cuts), np.split(where, cuts)) if len(p)]
    body = lambda d: codes[starts[d] : starts[d + 1] - 1]
    for d, k, x, y in todo:
        doc, item = body(d), index.codes[k]
        passages, covered, within = [], 0, False
        found_ = pieces(x, y)
        # no alignment covers more than the pieces are long
        if sum(b - a + steps for a, b, _, _, steps, _ in found_) < index.cover[k] and max(b - a for a, b, *_ in found_) < SHARE * len(item):
            continue
        for a, b, s, e, steps, whole in found_:
            # on one diagonal the band is one place wide
            edits = 0 if whole else int((doc[s:e] != item[a:b]).sum()) if not steps else align(doc[s:e], item[a:b], steps + STEP)
            covered += b - a - edits + steps
            similarity = 1.0 - edits / (b - a)
            within |= similarity >= 1.0 - BUDGET and b - a >= SHARE * len(item)
            passages.append((s, e, a, b, round(max(0.0, similarity), 4)))
        if covered < index.cover[k] and not within:
            continue
        if d not in seqs:
            seqs[d] = sequences(text_of(doc).split(" "))
        want = index.seqs[k]
        both = len(want & seqs[d]) if not index.few[k] else int(f" {index.texts[k]} " in f" {text_of(doc)} ")
        if both >= index.share * len(want) - 1e-9 and both or within and not index.few[k]:
            longest = max(passages, key=lambda p: p[3] - p[2])
            out.append((d, index.ids[k], both, round(both / len(want), 6), longest[4], [dict(zip(("start", "end", "item_start", "item_end", "similarity"), p)) for p in sorted(passages)]))
    seen = {(d, k) for d, k, *_ in todo}
    for k in index.short:  # items too short for a q-gram
        for d in range(len(texts)):
            at = f" {text_of(body(d))} ".find(f" {index.texts[k]} ") if (d, k) not in seen else -1
            if at >= 0:
                n = len(index.texts[k])
                out.append((d, index.ids[k], 1, 1.0, 1.0, [{"start": at, "end": at + n, "item_start": 0, "item_end": n, "similarity": 1.0}]))
    return out


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the pairs with a third of the item's five-word sequences in the document."""
    return leaks(docs, items).where(F.col("share") >= SHARE - 1e-9).select("doc_id", "item_id").distinct()
