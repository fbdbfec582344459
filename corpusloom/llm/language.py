"""Problem 3: a language and a confidence for every record and every stretch in another language.

Evidence is fused by Bayes' rule:
* text: likelihood of each sentence under each language and a class for all others (``langmodel``). The model is fitted
  on about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id, in two rounds: counts by label, then counts of the
  rows whose label the first model agrees with, so wrong labels drop out. Function words are pseudo-counts;
* declared markup language: P(label | language), counted over all records and smoothed; a missing label says nothing;
* address: host priors P(language | host), smoothed towards the prior of the host's kind and that
  towards the prior of all records; a country suffix in an address column adds a fixed bonus.
The counts of labels and hosts come from grouped aggregation with partial sums over all records; the tables are joined
back on their keys, so a hot host is a row of a small table, never a group of records in one task.

A record's sentences are a mixture of languages whose prior is label and host (``PRIOR_SENTENCES`` strong): its shares
and the posteriors of its sentences are found together in ``STEPS`` rounds. The priors decide what the text leaves open:
short texts, names, lost letters. Sentences without letters are left out of the shares. A record is mixed when two or
more allowed languages each have the threshold's share of the characters.

Text with a wrong encoding is read as it was written (problem 2); non-prose (problem 7) and blank texts
get no case. Null and blank texts have null language and confidence 0. A text in none of the known languages is "und"
and no case. Labels are compared as two-letter codes, so another spelling of the right label is no case. Repeated
deliveries count once in the cases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpoint

from . import bulk, garble, prose
from . import langmodel as lm

LANGS = lm.LANGS
# Names and three-letter codes of languages, by two-letter code.
LABELS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español castellano", "pt": "pt por portuguese português",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский", "zh": "zh zho chi chinese cmn 中文",
}
PLACEHOLDERS = ("", "und", "unknown", "unk", "n/a", "na", "none", "null", "xx", "mul", "zxx", "-", "?")
#: Pseudo-counts with which a host leans on its kind, and a kind on all records.
LEAN = 20.0
#: Weight of label and host against the text; sentences that they stand for in the mixture of a record.
PRIOR_WEIGHT, PRIOR_SENTENCES = 1.0, 0.2
SUFFIX_BONUS = 2.0
#: Labelled rows that the model is fitted on, about; rounds of the mixture; tenths of nats of a sentence that are kept.
TRAIN_ROWS, STEPS, RANGE = 10_000, 3, 25.0


def label_code(label: Column) -> Column:
    """Two-letter code of a declared language; null when missing or a placeholder; else its first part."""
    plain = F.lower(F.trim(label))
    base = F.regexp_extract(plain, r"^([^-_ ]+)", 1)
    code = F.coalesce(*[F.when(base.isin(*names.split()), F.lit(c)) for c, names in LABELS.items()], base)
    return F.when(label.isNull() | plain.isin(*PLACEHOLDERS), None).otherwise(code)


def sentences(t: bulk.Text) -> np.ndarray:
    """First places of the sentences of all texts: after an end mark and white space, a Chinese end mark, an empty line."""
    c, space = t.codes, t.kind == bulk.SPACE
    if not len(c):
        return np.zeros(0, np.int64)
    mark = (c == 46) | (c == 33) | (c == 63)
    closer = np.zeros(len(c), bool)
    for x in "\"”»’)":
        closer |= c == ord(x)
    nxt = np.append(space[1:], True)
    ends = mark & nxt
    ends[1:] |= mark[:-1] & closer[1:] & nxt[1:]
    ends |= (c == 0x3002) | (c == 0xFF01) | (c == 0xFF1F)
    ends[1:] |= (c[1:] == 10) & (c[:-1] == 10)
    return np.unique(np.concatenate([t.start[:-1], np.flatnonzero(ends)[:-1] + 1 if ends[-1:].all() else np.flatnonzero(ends) + 1]))


def text_evidence(texts: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first characters, characters, log-likelihoods by class, best class or -1) of the sentences of each sound text."""
    k = len(lm.CLASSES)
    for a, b in bulk.chunks(texts):
        t = lm.lowered(texts[a:b])
        starts = sentences(t)
        ll, letters = lm.likelihoods(t, model, starts)
        solid = np.flatnonzero(t.kind != bulk.SPACE)
        n = np.diff(np.append(np.searchsorted(solid, starts), len(solid)))
        has = letters > 0
        starts, ll, n = starts[has], ll[has], n[has]
        doc = np.searchsorted(t.start, starts, side="right") - 1
        cut = np.searchsorted(doc, np.arange(b - a + 1))
        total = np.zeros((b - a, k))
        np.add.at(total, doc, ll)
        top = np.where(np.diff(cut) > 0, total.argmax(axis=1), -1)
        at = (starts - t.start[doc]).astype(np.int32)
        for d in range(b - a):
            x, y = cut[d], cut[d + 1]
            yield at[x:y], n[x:y].astype(np.int32), ll[x:y], int(top[d])


def train(records: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the language model from the labelled rows, in two rounds."""
    known = records.where(F.col("label").isin(*LANGS) & F.col("text").isNotNull()).select("result_id", "label", "text")
    n = known.select("label").count()
    part = min(1.0, TRAIN_ROWS / max(1, n))
    some = known.where(F.pmod(F.xxhash64("result_id"), F.lit(1_000_000)) < int(1_000_000 * part)).select("label", "text")

    def counts(model: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = [np.zeros((len(LANGS), lm.RUNS), np.int64), np.zeros((len(LANGS), lm.SINGLES), np.int64)]
            for part in parts:
                texts, label = part["text"].tolist(), np.array([LANGS.index(g) for g in part["label"]])
                for a, b in bulk.chunks(texts):
                    t = lm.lowered(garble.sound(texts[a:b]))
                    at, run, single = lm.features(t)
                    doc = np.searchsorted(t.start, at, side="right") - 1
                    mine = label[a:b]
                    if model is not None:
                        ll, _ = lm.likelihoods(t, model, t.start[:-1])
                        mine = np.where(ll.argmax(axis=1) == mine, mine, -1)
                    ok = mine[doc] >= 0
                    g = mine[doc[ok]]
                    for x, bucket in zip(acc, (run, single)):
                        x += np.bincount(g * x.shape[1] + bucket[ok], minlength=x.size).reshape(x.shape)
            if acc[0].any():
                yield pd.DataFrame({"runs": [zlib.compress(acc[0].tobytes(), 1)], "singles": [zlib.compress(acc[1].tobytes(), 1)]})

        def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for part in parts:  # streamed: one sum is held
                for r, s in zip(part["runs"], part["singles"], strict=True):
                    x = [np.frombuffer(zlib.decompress(v), np.int64) for v in (r, s)]
                    total = x if total is None else [u + v for u, v in zip(total, x)]
            if total:
                yield pd.DataFrame({"runs": [zlib.compress(total[0].tobytes(), 1)], "singles": [zlib.compress(total[1].tobytes(), 1)]})

        rows = some.mapInPandas(run, "runs binary, singles binary").repartition(1).mapInPandas(merge, "runs binary, singles binary").collect()  # fixed size
        shapes = ((len(LANGS), lm.RUNS), (len(LANGS), lm.SINGLES))
        out = [np.zeros(x, np.int64) for x in shapes]
        for r in rows:
            out = [o + np.frombuffer(zlib.decompress(v), np.int64).reshape(x) for o, v, x in zip(out, r, shapes)]
        return out[0], out[1]

    return lm.tables(counts(lm.tables(counts(None))))


_PACKED = "starts binary, chars binary, ll binary, top int"


def evidence(records: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Adds packed arrays ``starts``, ``chars``, ``ll`` (one byte by sentence and class), ``top`` and the
    statistics of problem 7 in ``stats``, so that each text is read once. Map-only."""
    shared = records.sparkSession.sparkContext.broadcast(model)  # fixed size

    @F.pandas_udf(f"{_PACKED}, {prose.SCHEMA.replace('lang string', 'text_lang string')}")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in texts:
            ts = garble.sound(part.tolist())
            rows = []
            for at, n, ll, top in text_evidence(ts, model):
                near = np.minimum((ll.max(axis=1, keepdims=True) - ll) * (255 / RANGE), 255).astype(np.uint8) if len(ll) else np.zeros(0, np.uint8)
                rows.append((at.astype("<i4").tobytes(), n.astype("<i4").tobytes(), near.tobytes(), top))
            out = pd.DataFrame(rows, columns=["starts", "chars", "ll", "top"])
            yield pd.concat([out, prose.as_frame(ts, sound=True).rename(columns={"lang": "text_lang"})], axis=1)

    e = records.withColumn("_e", run(F.col("text"))).select(*[c for c in records.columns if c != "text"], "_e.*")
    stats = F.struct(F.col("text_lang").alias("lang"), *prose.NAMES[1:])
    return e.select(*[c for c in records.columns if c != "text"], "starts", "chars", "ll", F.when(F.col("top") >= 0, F.col("top")).alias("top"), stats.alias("stats"))


_RESULT = "lang string, confidence double, shares map<string,double>, stretches array<struct<start:int,chars:int,lang:string,confidence:double>>"


def mixture(ll: np.ndarray, n: np.ndarray, doc: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior of each sentence; the shares of its record are the mixture of its sentences with the record's prior."""
    rows, k = prior.shape
    prior = np.exp(prior - prior.max(axis=1, keepdims=True))
    prior /= prior.sum(axis=1, keepdims=True)
    like = np.exp(ll - ll.max(axis=1, keepdims=True)) if len(ll) else ll
    mix = prior
    count = np.maximum(np.bincount(doc, minlength=rows), 1)[:, None]
    weight = n / np.maximum(np.bincount(doc, weights=n, minlength=rows), 1.0)[doc]  # characters, as shares are
    post = like
    for _ in range(STEPS):
        post = like * mix[doc]
        post /= post.sum(axis=1, keepdims=True)
        got = np.stack([np.bincount(doc, weights=post[:, j] * weight, minlength=rows) for j in range(k)], axis=1)
        mix = (count * got + PRIOR_SENTENCES * prior) / (count + PRIOR_SENTENCES)
    return post


def _fuse(starts: pd.Series, chars: pd.Series, ll: pd.Series, prior: pd.Series) -> pd.DataFrame:
    """Language, confidence, shares and stretches of each record from the posteriors of its sentences."""
    k, rows = len(lm.CLASSES), len(starts)
    join = lambda col, kind: np.frombuffer(b"".join(x if x is not None else b"" for x in col), kind)
    at, n = join(starts, "<i4"), join(chars, "<i4")
    far = join(ll, np.uint8).reshape(-1, k).astype(float) * (-RANGE / 255)
    size = np.array([0 if x is None else len(x) // 4 for x in chars])
    doc = np.repeat(np.arange(rows), size)
    post = mixture(far, n.astype(float), doc, np.stack([np.asarray(p, dtype=float) for p in prior]) if rows else np.zeros((0, k)))
    g, sure = post.argmax(axis=1) if len(post) else np.zeros(0, int), post.max(axis=1) if len(post) else np.zeros(0)
    amount = np.zeros((rows, k))
    np.add.at(amount, (doc, g), n)
    held = np.zeros((rows, k))
    np.add.at(held, (doc, g), n * sure)
    first = amount.argmax(axis=1) if rows else np.zeros(0, int)
    total = np.maximum(1.0, amount.sum(axis=1))
    # one stretch for each run of sentences in one language
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.add.reduceat(n, begin) if len(begin) else n
    trust = np.add.reduceat(n * sure, begin) / np.maximum(1, length) if len(begin) else sure
    parts: list[list] = [[] for _ in range(rows)]
    for d, a, c, j, q in zip(doc[begin].tolist(), at[begin].tolist(), length.tolist(), g[begin].tolist(), trust.round(4).tolist(), strict=True):
        parts[d].append({"start": a, "chars": c, "lang": lm.CLASSES[j], "confidence": q})
    shares = [{lm.CLASSES[j]: round(v / t, 6) for j, v in enumerate(x) if v > 0} for x, t in zip(amount.tolist(), total.tolist(), strict=True)]
    confidence = np.where(size > 0, held[np.arange(rows), first] / np.maximum(1.0, amount[np.arange(rows), first]), 0.0).round(4)
    return pd.DataFrame({"lang": [lm.CLASSES[j] if s else None for j, s in zip(first.tolist(), size.tolist(), strict=True)], "confidence": confidence, "shares": shares, "stretches": parts})


def priors(seen: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log-prior arrays: per host, per label, and for all records (one row). ``seen``: host, label, top."""
    k = len(lm.CLASSES)
    counts = seen.groupBy("host", "label").agg(*[F.sum((F.col("top") == i).cast("long")).alias(f"n{i}") for i in range(k)])
    n = [F.col(f"n{i}") for i in range(k)]
    sums = lambda: [F.sum(c).alias(f"n{i}") for i, c in enumerate(n)]
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"a{i}") for i, c in enumerate(n)])
    a_sum = sum((F.col(f"a{i}") for i in range(k)), F.lit(0)) + k
    base = total.select(*[((F.col(f"a{i}") + 1) / a_sum).alias(f"b{i}") for i in range(k)], *[f"a{i}" for i in range(k)])
    hosts = counts.groupBy("host").agg(*sums()).join(kinds, "host", "left").withColumn("kind", F.coalesce("kind", F.lit("")))
    per_kind = hosts.groupBy("kind").agg(*[F.sum(c).alias(f"k{i}") for i, c in enumerate(n)])
    k_sum = sum((F.col(f"k{i}") for i in range(k)), F.lit(0)) + LEAN
    n_sum = sum(n, F.lit(0)) + LEAN
    per_host = (
        hosts.join(per_kind, "kind")
        .join(F.broadcast(base))  # one row
        .select("host", F.array(*[F.log((F.col(f"n{i}") + LEAN * (F.col(f"k{i}") + LEAN * F.col(f"b{i}")) / k_sum) / n_sum) for i in range(k)]).alias("host_prior"))
    )
    labels = counts.groupBy("label").agg(*sums())
    n_labels = len(LABELS) + 2
    per_label = labels.join(F.broadcast(base)).select("label", F.array(*[F.log((F.col(f"n{i}") + 1.0) / (F.col(f"a{i}") + n_labels)) for i in range(k)]).alias("label_prior"))
    return per_host, per_label, base


def classify(records: DataFrame, hosts: DataFrame, host_col: str = "source", address_col: str = "file_path") -> DataFrame:
    """Per delivery: language, confidence, label, shares by language, and stretches with language and confidence."""
    return fuse(gather(records, host_col, address_col), hosts)


def gather(records: DataFrame, host_col: str = "source", address_col: str = "file_path") -> DataFrame:
    """Evidence of every delivery, checkpointed: numbers only, read by the priors, the fusion and problem 7's fit."""
    src = records.select("result_id", F.lower(F.col(host_col)).alias("host"), F.coalesce(label_code(F.col("language")), F.lit("")).alias("label"), F.col(address_col).alias("address"), "text")
    return checkpoint(evidence(src, train(src)))


def fuse(e: DataFrame, hosts: DataFrame) -> DataFrame:
    """Evidence with priors and labels; see ``classify``."""
    k = len(lm.CLASSES)
    per_host, per_label, _ = priors(e.where("top is not null").select("host", "label", "top"), hosts)
    suffix = F.regexp_extract(F.col("address"), r"^[a-z]+://[^/:]+\.([a-z]{2})(?:[/:]|$)", 1)
    bonus = F.array(*[F.when(suffix == g, F.lit(SUFFIX_BONUS)).otherwise(0.0) for g in lm.CLASSES])
    e = e.join(per_host, "host", "left").join(per_label, "label", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    prior = F.zip_with(F.zip_with(F.coalesce("host_prior", zero), F.when(F.col("label") == "", zero).otherwise(F.coalesce("label_prior", zero)), lambda x, y: x + y), bonus, lambda x, y: (x + y) * PRIOR_WEIGHT)
    e = e.withColumn("_f", F.pandas_udf(_fuse, _RESULT)("starts", "chars", "ll", prior))
    return e.select("result_id", F.nullif("label", F.lit("")).alias("label"), "_f.lang", F.coalesce("_f.confidence", F.lit(0.0)).alias("confidence"), "_f.shares", "_f.stretches")


def active_profile(config: DataFrame) -> DataFrame:
    """One row: allowed languages and mixed-language threshold of the active profile."""
    return config.where("active").select("allowed_languages", F.col("mixed_language_threshold").alias("threshold")).orderBy("threshold").limit(1)


def found(records: DataFrame, hosts: DataFrame, config: DataFrame) -> DataFrame:
    """(result_id, lang): texts with a missing or wrong label, and every language of mixed texts."""
    e = gather(records)
    c = fuse(e, hosts).where("lang is not null").join(F.broadcast(active_profile(config)))  # one row
    major = F.expr("filter(map_entries(shares), x -> x.value >= threshold and array_contains(allowed_languages, x.key)).key")
    c = c.withColumn("major", major)
    mixed = F.size("major") >= 2
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    langs = F.when(mixed, F.col("major")).when(wrong & (F.col("lang") != "und"), F.array("lang"))
    cases = c.select("result_id", F.explode(langs).alias("lang")).distinct()
    stats = e.select("result_id", "stats.*")
    other = prose.kinds(prose.score(stats, prose.fit(stats))).select("result_id")
    return cases.join(other, "result_id", "left_anti")
