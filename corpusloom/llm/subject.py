"""Problem 5: the subjects that each document treats.

1. One Arrow pass turns each text into the hashed content terms (words and word pairs without names,
   numbers and function words) of its sentences, checkpointed as integers. Later steps read only those.
2. Document vectors (term frequencies by squared inverse document frequency, length 1) are clustered by bisecting
   k-means, fitted on all distinct documents: copies and repeated deliveries are one document in steps 2 to 4.
3. Every document goes to its nearest leaf; terms are counted by leaf over all distinct documents. A leaf is labelled with
   the subject whose required keywords its terms favour most (log-odds against the other leaves); with none where no
   subject is favoured; a leaf that favours two subjects alike (within ``GAP``) is left out.
4. Discriminative terms (``RATIO`` times as frequent under some label as in the mean) weigh by their log-ratios by leaf. Each
   document is a mixture of leaves: posteriors of its sentences and the mixture are found together in ``STEPS`` rounds;
   a sentence without ``ENOUGH`` evidence belongs to no leaf. The share of a subject is that of the sentences whose
   leaves have its label. Subjects with at least ``SHARE`` are assigned; a document may have several or none.

Keywords only label leaves; they have no weight of their own in a document.

Defined results: only texts wholly in English that are prose (problem 7) get subjects; null and blank texts
get none; repeated deliveries count once; an empty keyword table or corpus gives no rows. Stretches of more than twice
``LONG`` words without sentence marks are taken as sentences of ``LONG`` words, shorter ones than three words as none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpoint

from . import bulk, language, prose
from . import langmodel as lm

LEAVES = 32
DIMS = 1024
SHARE = 0.2
LONG = 24
TERM_BITS = 17
#: Evidence a sentence needs and the most that one term can add, in nats; frequency in a leaf against the mean leaf.
ENOUGH, MOST, RATIO = 3.0, 4.0, 3.0
#: Odds of a leaf's subject: the least, and the least distance to the second.
ODDS, GAP = 0.5, 1.0
#: Pseudo-counts of the corpus in a leaf; pseudo-sentences of all leaves in a document; rounds of the mixture.
LEAN, EVEN, STEPS = 500.0, 2.0, 2

_BROKEN = re.compile(r"[-¬­]\n(?=\w)")
_ENGLISH = frozenset(lm.FUNCTION_WORDS["en"].split()) | frozenset("also about again all any both during early few first further here just last late much near next non off often own same second since still third too two until up via very well within without yet three".split())
_FOREIGN = frozenset(w for g in lm.LANGS if g != "en" for w in lm.FUNCTION_WORDS[g].split() if len(w) > 1) - _ENGLISH - frozenset("me per no on so an as am do die was had men ten been over dat".split())

_TERM_SHIFT = np.uint64(64 - TERM_BITS)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@cache
def _stops() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of English function words and of other languages' ones."""
    return tuple(np.sort(bulk.words([" ".join(sorted(x))]).hash) for x in (_ENGLISH, _FOREIGN))


def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def _lower(text: str) -> str:
    """Lower case, character by character where the length would change."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def pair_terms(h: np.ndarray) -> np.ndarray:
    """Terms of neighbouring words."""
    return bulk.mix(h[:-1] * _PAIR + h[1:]) >> _TERM_SHIFT


def sentence_terms(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(terms, ends of the sentences among them) of each text that is wholly in English; else None."""
    texts = [(_BROKEN.sub("", t) if "\n" in t else t) if t else "" for t in texts]
    low = [_lower(t) for t in texts]
    t, w = bulk.text(texts), bulk.words(low)
    k = len(texts)
    english, foreign = (_among(w.hash, x) for x in _stops())
    n = np.diff(w.first)
    e, f = bulk.sums(w.doc, english, k), bulk.sums(w.doc, foreign, k)
    script = (t.codes >= 0x400) & (t.codes <= 0x4FF) | (t.codes >= 0x3400) & (t.codes <= 0x9FFF)
    other = bulk.between(np.flatnonzero(script), t.start[:-1], t.start[1:])
    mine = (e > 0.12 * n) & (f <= 0.12 * e) & (other <= 0.05 * np.diff(t.start)) & (n > 0)
    out: list = [None] * k
    if not mine.any():
        return out
    starts = language.sentences(t)
    sentence = np.searchsorted(starts, w.place, side="right") - 1
    size = np.bincount(sentence, minlength=len(starts))
    begin = np.searchsorted(sentence, np.arange(len(starts)))
    nth = np.arange(len(sentence)) - begin[sentence]
    # long stretches count as several sentences
    part = np.where(size[sentence] > 2 * LONG, nth // LONG, 0)
    new = np.ones(len(sentence), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (part[1:] != part[:-1])
    of = np.cumsum(new) - 1
    size = np.bincount(of)
    low_codes = bulk.codes_of("\n".join(low) + "\n")
    first = t.codes[w.place]
    name = (first != low_codes[w.place]) & (nth > 0)
    content = ~english & ~name & (w.length > 2) & ~((first >= 48) & (first <= 57)) & (size[of] > 2)
    pair = content[1:] & content[:-1] & (of[1:] == of[:-1])
    single = (w.hash >> _TERM_SHIFT)[content]
    double = pair_terms(w.hash)[pair] if len(w.hash) > 1 else np.zeros(0, np.uint64)
    terms = np.concatenate([single, double]).astype(np.int32)
    where = np.concatenate([of[content], of[1:][pair]])
    order = np.argsort(where, kind="stable")
    terms, where = terms[order], where[order]
    doc_of = w.doc[np.flatnonzero(new)]
    real = size > 2
    ends = np.searchsorted(where, np.arange(len(size)), side="right")
    cut = np.searchsorted(doc_of, np.arange(k + 1))
    for d in np.flatnonzero(mine).tolist():
        a, b = cut[d], cut[d + 1]
        low_end = ends[a - 1] if a else 0
        stop = ends[b - 1] if b > a else low_end
        out[d] = (terms[low_end:stop], (ends[a:b][real[a:b]] - low_end).astype(np.int32))
    return out


def gather(records: DataFrame) -> DataFrame:
    """(result_id, terms, ends, stats): hashed terms of the sentences of English texts, and statistics of all."""

    @F.pandas_udf(f"terms array<int>, ends array<int>, {prose.SCHEMA}")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            ts = part.tolist()
            # garbled characters are few in English texts, and other texts get no subjects: nothing is restored here
            stats = prose.as_frame(ts, sound=True)
            english = [t if lang == "en" else None for t, lang in zip(ts, stats["lang"].tolist(), strict=True)]
            rows: list[tuple] = []
            for a, b in bulk.chunks(english):
                rows += [x or (None, None) for x in sentence_terms(english[a:b])]
            yield pd.concat([pd.DataFrame(rows, columns=["terms", "ends"]), stats], axis=1)

    e = records.select("result_id", run(F.col("text")).alias("e"))
    e = e.select("result_id", "e.terms", "e.ends", F.struct(*[f"e.{c}" for c in prose.NAMES]).alias("stats"))
    return checkpoint(e)


def _batches(part: pd.DataFrame, step: int = 500) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a in range(0, len(part), step):
        yield a, [np.asarray(t, dtype=np.int64) for t in part["terms"].iloc[a : a + step]]


def leaves_of(docs: DataFrame, leaves: int) -> DataFrame:
    """(terms, leaf): bisecting k-means over the vectors of all given documents; native, on sparse vectors."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    v = HashingTF(inputCol="terms", outputCol="tf", numFeatures=DIMS).transform(docs)
    idf = IDF(inputCol="tf", outputCol="once").fit(v)
    v = idf.transform(v)
    v = idf.copy().setInputCol("once").setOutputCol("twice").transform(v)
    v = Normalizer(inputCol="twice", outputCol="features").transform(v)
    model = BisectingKMeans(k=leaves, maxIter=4, seed=11, minDivisibleClusterSize=8.0, predictionCol="leaf").fit(v.select("features"))
    return model.transform(v).select("terms", "leaf")


def leaf_counts(docs: DataFrame, k: int) -> np.ndarray:
    """(leaves x terms) counts over the documents (terms, leaf); of fixed size whatever the input."""
    width = 1 << TERM_BITS
    schema = "leaf int, counts binary"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(k * width, np.int32)
        for part in parts:
            for a, terms in _batches(part):
                leaf = part["leaf"].to_numpy(np.int64)[a : a + len(terms)]
                np.add.at(acc, np.repeat(leaf * width, [len(t) for t in terms]) + np.concatenate(terms), 1)
        rows = acc.reshape(k, width)
        yield pd.DataFrame({"leaf": np.arange(k), "counts": [zlib.compress(r.tobytes(), 1) for r in rows]})

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:  # streamed: only the sums are held
            for leaf, c in zip(part["leaf"], part["counts"], strict=True):
                x = np.frombuffer(zlib.decompress(c), np.int32)
                total[leaf] = total[leaf] + x if leaf in total else x.astype(np.int64)
        yield pd.DataFrame({"leaf": list(total), "counts": [zlib.compress(x.astype(np.float32).tobytes(), 1) for x in total.values()]})

    out = np.zeros((k, width), np.float32)
    for r in docs.mapInPandas(run, schema).repartition(k, "leaf").mapInPandas(merge, schema).collect():  # fixed size
        out[r["leaf"]] = np.frombuffer(zlib.decompress(r["counts"]), np.float32)
    return out


def keyword_terms(keyword: str) -> list[int]:
    """Terms of a keyword: its pairs of neighbouring content words, else its content words."""
    h = bulk.words([keyword]).hash
    content = ~_among(h, _stops()[0]) if len(h) else np.zeros(0, bool)
    pair = content[1:] & content[:-1]
    return (pair_terms(h)[pair] if pair.any() else (h >> _TERM_SHIFT)[content]).astype(np.int64).tolist()


def leaf_labels(counts: np.ndarray, keys: list[list[int]]) -> np.ndarray:
    """Number of the subject of each leaf; the number of subjects for none, -1 for a leaf of two subjects."""
    size = counts.sum(axis=1)
    live = size > 0
    rate = (np.stack([counts[:, ks].sum(axis=1) for ks in keys], axis=1) + 0.5) / (size[:, None] + 1.0)
    odds = np.log(rate / rate[live].mean(axis=0))
    label = np.where(odds.max(axis=1) > ODDS, odds.argmax(axis=1), len(keys))
    if len(keys) > 1:
        two = np.sort(odds, axis=1)
        label = np.where((label < len(keys)) & (two[:, -1] - two[:, -2] < GAP), -1, label)
    return np.where(live, label, -1)


def _rates(counts: np.ndarray, back: np.ndarray) -> np.ndarray:
    return (counts + np.float32(LEAN) * back + np.float32(0.01)) / (counts.sum(axis=1, keepdims=True) + np.float32(LEAN + 0.01 * counts.shape[1]))


def weights_of(counts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(terms x leaves) log-ratios of terms that tell the labels apart, 0 for others.

    A term of a single leaf among many of its label is the style of that leaf, not its subject.
    """
    back = counts.sum(axis=0) / max(1.0, counts.sum())
    groups = _rates(np.stack([counts[label == g].sum(axis=0) for g in sorted(set(label.tolist()))]), back)
    tells = groups.max(axis=0) >= RATIO * groups.mean(axis=0) if len(groups) > 1 else np.ones(counts.shape[1], bool)
    p = _rates(counts, back)
    out = np.clip(np.log(p / p.mean(axis=0)), -MOST, MOST)
    out[:, ~tells] = 0.0
    return np.ascontiguousarray(out.T, dtype=np.float32)


def leaf_mixtures(terms: list[np.ndarray], ends: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior by leaf of each sentence, all zero for none; document of each sentence)."""
    k = weights.shape[1]
    size = np.array([len(t) for t in terms])
    shift = np.cumsum(size) - size
    every = np.concatenate(terms)
    tells = weights.any(axis=1)[every]
    end = np.concatenate([e + s for e, s in zip(ends, shift.tolist(), strict=True)])
    end = np.concatenate([[0], np.cumsum(tells)])[end]
    doc = np.repeat(np.arange(len(terms)), [len(e) for e in ends])
    start = np.concatenate([[0], end[:-1]])[: len(end)]
    ll = np.zeros((len(end), k), np.float32)
    some = np.flatnonzero(end > start)
    if len(some):
        # stretches between kept sentences hold no terms, so each runs from the end before
        ll[some] = np.add.reduceat(weights[every[tells]], start[some], axis=0)
    told = ll.max(axis=1) >= ENOUGH
    mix = np.full((len(terms), k), 1.0 / k)
    post = np.zeros_like(ll)
    like = np.exp(ll - ll.max(axis=1, keepdims=True)) * told[:, None]
    for _ in range(STEPS):
        post = like * mix[doc]
        post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-30)
        got = np.stack([np.bincount(doc, weights=post[:, j], minlength=len(terms)) for j in range(k)], axis=1)
        mix = (got + EVEN / k) / (got.sum(axis=1, keepdims=True) + EVEN)
    return post, doc


def subjects(records: DataFrame, keywords: DataFrame, share: float = SHARE, leaves: int = LEAVES) -> DataFrame:
    """(result_id, domain, share, sentences): subjects of each English prose record with their share."""
    spark = records.sparkSession
    schema = "result_id long, domain string, share double, sentences int"
    kw = [(r["domain"], [x for k in (r["required_keywords"] or []) for x in keyword_terms(k)]) for r in keywords.orderBy("domain").collect()]  # configuration
    kw = [(d, ks) for d, ks in kw if ks]
    empty = spark.createDataFrame([], schema)
    if not kw:
        return empty
    e = gather(records)
    stats = e.select("result_id", "stats.*")
    other = prose.kinds(prose.score(stats, prose.fit(stats))).select("result_id")
    docs = e.where("size(terms) > 0 and size(ends) > 0").select("result_id", "terms", "ends")
    each = checkpoint(docs.select("terms").distinct())  # copies and repeated deliveries are one document

    if not each.limit(1).count():
        return empty
    counts = leaf_counts(leaves_of(each, leaves), leaves)
    label = leaf_labels(counts, [ks for _, ks in kw])
    kept = np.flatnonzero(label >= 0)
    if not len(kept):
        return empty
    names = [d for d, _ in kw]
    to_subject = np.zeros((len(kept), len(kw) + 1), np.float32)
    to_subject[np.arange(len(kept)), label[kept]] = 1.0
    shared = spark.sparkContext.broadcast(weights_of(counts[kept], label[kept]))  # fixed size

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for part in parts:
            for a, terms in _batches(part):
                some = part.iloc[a : a + len(terms)]
                ends = [np.asarray(x, dtype=np.int64) for x in some["ends"]]
                post, doc = leaf_mixtures(terms, ends, weights)
                by = post @ to_subject
                cls = np.where(by.sum(axis=1) > 0, by.argmax(axis=1), len(kw))
                n = np.zeros((len(some), len(kw) + 1))
                np.add.at(n, (doc, cls), 1)
                total = n.sum(axis=1)
                d, c = np.nonzero((n[:, :-1] > 0) & (n[:, :-1] >= share * total[:, None] - 1e-9))
                if len(d):
                    yield pd.DataFrame({"result_id": some["result_id"].to_numpy()[d], "domain": [names[x] for x in c], "share": (n[d, c] / total[d]).round(6), "sentences": total[d].astype(np.int32)})

    out = docs.mapInPandas(run, schema).distinct()
    return out.join(other, "result_id", "left_anti")


def found(records: DataFrame, keywords: DataFrame) -> DataFrame:
    return subjects(records, keywords).select("result_id", "domain").distinct()


def composition(records: DataFrame, keywords: DataFrame) -> DataFrame:
    """(domain, records, weight): how many records treat each subject, and their summed shares."""
    return subjects(records, keywords).groupBy("domain").agg(F.countDistinct("result_id").alias("records"), F.round(F.sum("share"), 4).alias("weight"))
