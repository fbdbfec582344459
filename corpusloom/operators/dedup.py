"""Duplicates by content and title, what to keep, and the tokens lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.tables import checkpoint


def exact_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(hash, n_docs, first_doc) of contents that occur more than once; partial counts before the shuffle."""
    return df.where(key.isNotNull()).groupBy(key.alias("hash")).agg(F.count("*").alias("n_docs"), F.min(id_col).alias("first_doc")).where("n_docs > 1")


def title_groups(df: DataFrame, title: Column, content: Column) -> DataFrame:
    """Titles that stand over different contents."""
    t = df.select(X.title_norm(title).alias("title"), F.md5(content).alias("h")).where("title <> ''")
    return t.groupBy("title").agg(F.count("*").alias("n_docs"), F.countDistinct("h").alias("n_hashes")).where("n_hashes > 1")


def keep(df: DataFrame, id_col: str, text_col: str, policy: str = "first") -> DataFrame:
    """(id, group_md5, kept): one record of each content is kept; texts that are null group by nothing and stay.

    The winner of a group is found by a minimum over (tokens, id) with partial aggregation, not by sorting the
    group in one task, so a content with very many copies costs no more than any other.
    """
    src = df.select(F.col(id_col).alias("id"), F.md5(text_col).alias("group_md5"), X.token_count(F.col(text_col)).alias("tokens"))
    rank = F.struct((-F.col("tokens")).alias("t"), "id") if policy == "largest" else F.struct("id")
    best = src.where("group_md5 is not null").groupBy("group_md5").agg(F.min(rank).getField("id").alias("best"))
    j = src.join(best, "group_md5", "left")
    return j.select(F.col("id").alias(id_col), "group_md5", (F.col("best").isNull() | (F.col("best") == F.col("id"))).alias("kept"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds ``no``, 1 and up in the order of a column without ties: ranges are sorted apart from each other, and the
    sizes of the ranges before are added. No task sees more than one range."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_k", F.monotonically_increasing_id())
    ranged = checkpoint(ranged.withColumn("_p", F.shiftright("_k", 33)).withColumn("_i", F.col("_k").bitwiseAND((1 << 33) - 1)))
    size = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = size.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each range
    return ranged.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("no", F.col("_b") + F.col("_i") + 1).drop("_k", "_p", "_i", "_b")


def annotate(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Group number, kept flag, duplicate-of and token loss of the members of duplicate groups."""
    src = df.select(F.col(id_col).alias("id"), F.md5(text_col).alias("h"), X.token_count(F.col(text_col)).alias("tokens")).where("h is not null")
    g = src.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("kept_id")).where("n > 1")
    j = src.join(numbered(g, "kept_id"), "h")
    dup = F.col("id") != F.col("kept_id")
    return j.select(
        F.col("id").alias(id_col), F.format_string("dg-%03d", "no").alias("group_id"), (~dup).alias("kept"),
        F.when(dup, F.col("kept_id")).alias("duplicate_of"), F.when(dup, F.col("tokens")).otherwise(F.lit(0).cast("long")).alias("token_loss"),
    )


def token_loss(df: DataFrame, class_col: str, id_col: str, text_col: str) -> DataFrame:
    """Tokens before and after removing exact copies, by class and TOTAL."""
    k = keep(df, id_col, text_col)
    t = df.select(id_col, F.coalesce(class_col, F.lit("unknown")).alias("class"), X.token_count(F.col(text_col)).alias("tokens")).join(k, id_col)
    r = t.rollup("class").agg(F.grouping("class").alias("g"), F.sum("tokens").alias("before"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(F.lit(0))).alias("after"))
    lost = F.col("before") - F.col("after")
    return r.select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("class")).alias("class"), "before", "after", lost.alias("lost"),
        F.round(F.when(F.col("before") == 0, 0.0).otherwise(100.0 * lost / F.col("before")), 4).alias("pct"),
    )


def unseen(df: DataFrame, seen: DataFrame, key: Column, seen_key: Column) -> DataFrame:
    """Rows whose key is not among the seen ones."""
    return df.withColumn("_k", key).join(seen.select(seen_key.alias("_k")).where("_k is not null").distinct(), "_k", "left_anti").drop("_k")
