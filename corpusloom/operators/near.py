"""Near-duplicates by exact Jaccard of word shingles.

Copies of one text are one class, known by the hash of the text. Shingles are ordered by document frequency (rare first,
ties by hash); two texts at or above the threshold share one in their first ``n - ceil(t * n) + 1`` shingles, so only
these prefixes are joined, within the bounds of lengths and places, and the pairs are verified on the whole sets.

Words are cut by native expressions; their shingles are arrays over Arrow batches, which takes a tenth of the time of native
arrays of strings. No shingle but those of prefixes is stored: frequencies come from a sketch of bounded size (any order
gives a right result; what is counted once joins nothing), and each text is one row (``prefixes``). A candidate pair must pass
a parity bitmap, whose Hamming distance never exceeds the true number of differing shingles, before its sets are made.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpoint

WORDS, THRESHOLD = 5, 0.8
#: Similarities are rounded to six places before they are compared.
SLACK = 6e-7
#: Bytes of text worked on at once, one text at least; bits of a block of the sketch; keys up to this number are broadcast.
CHUNK, BLOCK_BITS, MAX_LOCAL = 200_000, 16, 200_000
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rep): the smallest id with the same text; texts that are null or blank have no class."""
    t = df.where(F.trim(text_col) != "").select(F.col(id_col).alias("id"), F.md5(text_col).alias("h"))
    return t.join(t.groupBy("h").agg(F.min("id").alias("rep")).hint("merge"), "h").select("id", "rep")  # as many rows as texts: never broadcast


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of the texts that are not blank."""
    return df.where(F.trim(text_col) != "").select(F.unhex(F.md5(text_col)).alias("key"), F.col(text_col).alias("text"))


def spaced(text: str) -> Column:
    """The lower-case words of a text, each with one blank before it."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and their inverses modulo 2**64."""
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(size - 1, x, np.uint64)])) for x in (_M1, pow(_M1, -1, 1 << 64)))


def grams(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of all shingles of spaced texts, given as bytes one after the other with the end of each.

    A shingle is a stretch of bytes, and its hash comes from the sums of bytes times powers up to its two ends.
    """
    data = np.append(data, np.uint8(32))
    up, down = _powers(1 << max(18, (len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    blank = data == 32
    start = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    doc = np.searchsorted(ends, start, side="right")
    if len(start) < words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = doc[: len(doc) - words + 1] == doc[words - 1 :]
    a, b = start[: len(start) - words + 1][inside], end[words - 1 :][inside]
    h = (total[b] - total[a]) * down[a]
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31)), doc[: len(doc) - words + 1][inside]


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, end of each text) of pieces of a column of texts without nulls."""
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a + 1 : b + 1] - off[a]
        a = b


def firsts(keys: pa.Array) -> np.ndarray:
    """Whether the key of each row is the first of its kind in a batch."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys.to_numpy(zero_copy_only=False).astype("V16"), return_index=True)[1]] = True
    return out


def sketch_bits(texts: int) -> int:
    """Counters of the sketch, as a power of two; 64 M at most. Beyond that the order gets coarser, not the result."""
    return min(26, max(18, math.ceil(math.log2(max(1, 128 * texts)))))


def level(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale that is exact up to 16."""
    c = np.maximum(counts.astype(np.float64), 1.0)
    return np.where(c < 16, c, np.minimum(255, 16 + np.floor(8 * np.log2(c / 16)))).astype(np.uint8)


def sketch(texts: DataFrame, bits: int, words: int) -> np.ndarray:
    """Levels of the counts of hashed shingles; ``2**bits`` bytes whatever the input."""
    blocks = 1 << (bits - BLOCK_BITS)
    shift = np.uint64(64 - bits)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(1 << bits, np.uint16)
        for part in parts:
            first = firsts(part.column(0))  # copies would look like frequent shingles
            for a, _, data, ends in chunks(part.column(1)):
                h, doc = grams(data, ends, words)
                at, n = np.unique((h >> shift)[first[a + doc]], return_counts=True)
                at = at.astype(np.int64)
                acc[at] = np.minimum(acc[at] + n, 65_535)
        grid = acc.reshape(blocks, -1)
        some = np.flatnonzero(grid.any(axis=1))
        yield pa.record_batch({"block": pa.array(some.astype(np.int32)), "counts": pa.array([zlib.compress(grid[k].tobytes(), 1) for k in some], pa.binary())})

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:  # streamed: only the sums are held
            for k, c in zip(part["block"], part["counts"], strict=True):
                x = np.frombuffer(zlib.decompress(c), np.uint16)
                total[k] = total[k] + x if k in total else x.astype(np.uint32)
        yield pd.DataFrame({"block": list(total), "counts": [zlib.compress(level(x).tobytes(), 1) for x in total.values()]})

    schema = "block int, counts binary"
    out = np.ones((blocks, 1 << BLOCK_BITS), np.uint8)
    for r in texts.mapInArrow(count, schema).repartition(min(blocks, 64), "block").mapInPandas(merge, schema).collect():  # fixed size
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out.reshape(-1)


def parity_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the parity bitmap of a set of n: powers of two, so that a wider one folds onto a narrower."""
    return 1 << np.ceil(np.log2(np.clip(2 * n, 64, 4096) / 64)).astype(np.int64)


def prefixes(texts: DataFrame, levels: np.ndarray, bits: int, words: int, low: float) -> DataFrame:
    """(key, n, pos, g, parity): for each text with a shared shingle in its prefix, these (g) with the place of the first, the
    number of all and their parity bitmap; a text has one row for each batch it is in, all of them equal."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)  # 2**bits bytes
    shift = np.uint64(64 - bits)

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for part in parts:
            first = firsts(part.column(0))
            for a, b, data, ends in chunks(part.column(1)):
                h, doc = grams(data, ends, words)
                mine = first[a + doc]
                h, doc = h[mine], doc[mine]
                lv = levels[(h >> shift).astype(np.int64)]
                o = np.lexsort((h, doc * 256 + lv))
                h, doc, lv = h[o], doc[o], lv[o]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc, lv = h[new], doc[new], lv[new]
                n = np.bincount(doc, minlength=b - a)
                once = np.bincount(doc[lv <= 1], minlength=b - a)  # these come first and join nothing
                place = np.arange(len(h)) - (np.cumsum(n) - n)[doc]
                kept = (lv > 1) & (place < (n - np.ceil(low * n).astype(np.int64) + 1)[doc])
                size = np.bincount(doc[kept], minlength=b - a)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                cells = parity_words(n[some])
                at = np.zeros(b - a, np.int64)
                at[some] = np.cumsum(cells) - cells
                wide = np.zeros(b - a, np.int64)
                wide[some] = cells
                inside = size[doc] > 0
                d, x = doc[inside], h[inside]
                cell = at[d] * 64 + (x & (wide[d] * 64 - 1).astype(np.uint64)).astype(np.int64)
                odd = (np.bincount(cell, minlength=int(cells.sum()) * 64) & 1).astype(np.uint8)
                yield pa.record_batch({
                    "key": part.column(0).take(pa.array(a + some)), "n": pa.array(n[some].astype(np.int32)), "pos": pa.array(once[some].astype(np.int32)),
                    "g": lists(h[kept], size[some]), "parity": lists(np.packbits(odd).view(np.uint64), cells),
                })

    return texts.mapInArrow(run, "key binary, n int, pos int, g array<long>, parity array<long>")


def distance(x: Column, y: Column) -> Column:
    """Hamming distance of two parity bitmaps, folded to the narrower one (lengths differ by two at most)."""

    def fold(a: Column, m: Column) -> Column:
        return F.when(F.size(a) > m, F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, m + 1, m), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    m = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(fold(x, m), fold(y, m), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def candidates(rows: DataFrame, low: float) -> DataFrame:
    """(a, b): numbers of the texts of the pairs that share a shingle of their prefixes within all bounds, each once.

    Spark's estimate takes an array for one entry and an exploded row for one row, so it would broadcast through the driver ten
    times what its threshold allows. The hints rule that out.
    """
    each = rows.select("u", "n", "pos", F.posexplode("g").alias("k", "g")).select("g", "u", "n", (F.col("pos") + F.col("k")).alias("p"))
    a, b = each.alias("a"), each.alias("b")
    least = F.ceil(low / (1 + low) * (F.col("a.n") + F.col("b.n")))
    # what stands before the shared shingle can be shared too, up to the shorter stretch
    most = F.least("a.p", "b.p") + F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p"))
    ok = (F.col("a.u") < F.col("b.u")) & (F.least("a.n", "b.n") >= low * F.greatest("a.n", "b.n")) & (most >= least)
    cand = a.join(b.hint("merge"), (F.col("a.g") == F.col("b.g")) & ok).select(F.col("a.u").alias("a"), F.col("b.u").alias("b")).distinct()
    x, y = (rows.select(F.col("u").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")).hint("merge") for k in "ab")
    room = F.col("na") + F.col("nb") - 2 * F.ceil(low / (1 + low) * (F.col("na") + F.col("nb")))
    return cand.join(x, "a").join(y, "b").where(distance(F.col("pa"), F.col("pb")) <= room).select("a", "b")


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys, one row each."""
    small = wanted.limit(MAX_LOCAL + 1).count() <= MAX_LOCAL
    keys = wanted.select("key")
    return texts.join(F.broadcast(keys) if small else keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def linked(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(i, j, a, b, jaccard) of pairs of classes by representative, i < j, with the keys of their texts."""
    low = threshold - SLACK
    texts = keyed(df, text_col)
    cut = texts.select("key", spaced("text").alias("text"))
    bits = sketch_bits(texts.count())
    rows = prefixes(cut, sketch(cut, bits, words), bits, words, low).dropDuplicates(["key"])
    rows = checkpoint(rows.withColumn("u", F.monotonically_increasing_id()))  # shorter than keys; fixed by the checkpoint
    pairs = checkpoint(candidates(rows, low))
    wanted = checkpoint(rows.select("u", "key").join(pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct(), "u", "left_semi"))

    @F.pandas_udf("array<long>")
    def sets(t: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for _, _, data, ends in chunks(pa.array(t, pa.large_string())):
            h, doc = grams(data, ends, words)
            at = np.searchsorted(doc, np.arange(len(ends) + 1))
            out += [np.unique(h[x:y]).view(np.int64) for x, y in zip(at, at[1:])]
        return pd.Series(out)

    rep = df.where(F.trim(text_col) != "").select(F.unhex(F.md5(text_col)).alias("key"), F.col(id_col).alias("id")).join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
    s = checkpoint(texts_of(texts, wanted).select("key", sets(spaced("text")).alias("s")).join(rep, "key").join(wanted, "key"))
    x, y = (s.select(F.col("u").alias(k), F.col("key").alias(f"k{k}"), F.col("id").alias(f"i{k}"), F.col("s").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    v = pairs.join(x, "a").join(y, "b").select("ka", "kb", "ia", "ib", F.round(both / (F.size("sa") + F.size("sb") - both), 6).alias("jaccard")).where((F.col("jaccard") >= threshold) & (F.col("ia") != F.col("ib")))
    turned = F.col("ia") > F.col("ib")
    return v.select(*(F.when(turned, F.col(q)).otherwise(F.col(p)).alias(c) for c, p, q in (("i", "ia", "ib"), ("j", "ib", "ia"), ("a", "ka", "kb"), ("b", "kb", "ka"))), "jaccard")


def linked_texts(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(i, j, a, b): the pairs with their texts, which are not broadcast however well the files compress them."""
    v = checkpoint(linked(df, id_col, text_col, threshold).select("i", "j", "a", "b"))
    wanted = checkpoint(v.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    t = checkpoint(texts_of(keyed(df, text_col), wanted))
    x, y = (t.select(F.col("key").alias(k), F.col("text").alias(f"t{k}")).hint("merge") for k in "ab")
    return v.join(x, "a").join(y, "b").select("i", "j", F.col("ta").alias("a"), F.col("tb").alias("b"))


def pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(i, j, jaccard) of class representatives, i < j."""
    return linked(df, id_col, text_col, threshold).select("i", "j", "jaccard")


def edges(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(u, v): the pairs of class representatives, each in both directions."""
    p = pairs(df, id_col, text_col, threshold).select(F.col("i").alias("u"), F.col("j").alias("v"))
    return checkpoint(p.union(p.select("v", "u")))


def unestimated(df: DataFrame) -> DataFrame:
    """The same rows without Spark's estimate of their size, which a checkpoint keeps. That of a join is a product, so in a loop
    it has twice as many digits after each round, until they fill the driver's memory."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def components(e: DataFrame) -> DataFrame:
    """(u, l): the smallest number connected with each, by minimum labels with pointer jumps."""
    label = unestimated(checkpoint(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l"))))
    while True:
        seen = e.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(seen, "u").select("u", "l", F.least("l", "m").alias("k"))
        step = unestimated(checkpoint(step.join(label.select(F.col("u").alias("k"), F.col("l").alias("j")), "k", "left").select("u", "l", F.least("k", F.coalesce("j", "k")).alias("k"))))
        label = step.select("u", F.col("k").alias("l"))
        if not step.where("l <> k").limit(1).count():
            return label


def linked_classes(df: DataFrame, id_col: str, text_col: str, e: DataFrame) -> DataFrame:
    """(id, rep, links): the class of each text and the number of its pairs."""
    degree = e.groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("links"))
    return classes(df, id_col, text_col).join(degree, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"))


def links(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links): the number of pairs of each text's class, which needs no components."""
    return linked_classes(df, id_col, text_col, edges(df, id_col, text_col, threshold)).select(F.col("id").alias(id_col), "links")


def clusters(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, cluster, links): connected components over the pairs."""
    e = edges(df, id_col, text_col, threshold)
    out = linked_classes(df, id_col, text_col, e).join(components(e).withColumnRenamed("u", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("l", "rep").alias("cluster"), "links")
