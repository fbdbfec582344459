"""Problem 1: mix sources to target weights by capped water-filling.

Per-record work is one pass: records are reduced to (result_id, domain, characters) before the only
large shuffle, which keeps one delivery per record, and then summed per domain with partial sums. The
water level is found on the table of domains (a configuration table, one row per domain), with running
sums over the domains in the order in which they saturate; no loop and no collect.

A domain saturates when its characters times its repeat limit fall short of its share of what the
domains before it in that order left over; the excess is spread over the others by weight until
nothing changes. Whole repeats are given to every record, the fraction to records drawn by a seeded
hash of the id, so the same seed always gives the same mix.

Defined results: records with null or blank text, or with a domain that is no configured one, are not
usable; repeated deliveries count once (the latest ``ingested_at``); a domain with weight null or 0
gets nothing, with ``max_repeats`` null it counts as 1; with no usable record every share is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 7
NOT_BLANK = r"[^\s\p{Z}\x0B\x85]"


def plain_domain(c: Column) -> Column:
    """Spelling of a domain without case, outer spaces, and with underscores for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")


def usable_records(records: DataFrame, config: DataFrame) -> DataFrame:
    """(result_id, domain, chars): one row per usable record, domain as configured."""
    light = records.select(
        "result_id",
        F.struct(
            F.col("ingested_at").alias("at"),
            plain_domain(F.col("domain")).alias("domain"),
            F.when(F.col("text").rlike(NOT_BLANK), F.length("text")).cast("long").alias("chars"),
        ).alias("r"),
    )
    last = light.groupBy("result_id").agg(F.max("r").alias("r")).select("result_id", F.col("r.domain").alias("key"), F.col("r.chars").alias("chars"))
    names = config.select("domain", plain_domain(F.col("domain")).alias("key"))
    return last.where("chars is not null").join(F.broadcast(names), "key").select("result_id", "domain", "chars")


def allocate(records: DataFrame, config: DataFrame) -> DataFrame:
    """One row per configured domain: weight, cap, allocation by water-filling, and repeats per record."""
    sums = usable_records(records, config).groupBy("domain").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    d = (
        config.select("domain", F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .join(sums, "domain", "left")
        .select("domain", "w", "max_repeats", F.coalesce("n", F.lit(0)).alias("records"), F.coalesce("c", F.lit(0)).alias("chars"))
    )
    everything = Window.partitionBy(F.lit(1))  # the table of domains, not data
    d = d.select(
        "*",
        (F.col("chars") * F.col("max_repeats")).cast("double").alias("cap"),
        F.sum("w").over(everything).alias("w_all"),
        F.sum("chars").over(everything).cast("double").alias("total"),
    )
    before = Window.partitionBy(F.lit(1)).orderBy((F.col("w") == 0), (F.col("cap") / F.nullif("w", F.lit(0.0))), "domain").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    left, w_left = F.col("total") - F.col("cap_before"), F.col("w_all") - F.col("w_before")
    d = d.withColumn("full", (F.col("w") > 0) & (F.col("cap") * w_left < F.col("w") * left))
    d = d.select(
        "*",
        F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything).alias("cap_full"),
        F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(everything).alias("w_full"),
    )
    level = (F.col("total") - F.col("cap_full")) / F.nullif(F.col("w_all") - F.col("w_full"), F.lit(0.0))
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(F.col("w") * level, F.lit(0.0)))
    return d.select(
        "domain",
        "records",
        "chars",
        "max_repeats",
        "cap",
        "total",
        (F.col("w") / F.nullif("w_all", F.lit(0.0))).alias("target_share"),
        (F.col("cap") < F.col("w") * F.col("total") / F.nullif("w_all", F.lit(0.0))).alias("short"),
        F.least(given, F.col("cap")).alias("given"),
    ).withColumn("epochs", F.coalesce(F.col("given") / F.nullif(F.col("chars").cast("double"), F.lit(0.0)), F.lit(0.0)))


def draw(records: DataFrame, config: DataFrame, seed: int = SEED) -> DataFrame:
    """(result_id, domain, chars, repeats): how often each usable record is used; 0 when never."""
    plan = F.broadcast(allocate(records, config).select("domain", "epochs"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("result_id").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    whole = F.floor("epochs")
    return usable_records(records, config).join(plan, "domain").select("result_id", "domain", "chars", (whole + (u < F.col("epochs") - whole).cast("int")).cast("int").alias("repeats"))


def report(records: DataFrame, config: DataFrame, seed: int = SEED) -> DataFrame:
    """Per domain: target share, planned characters and repeats, the share it really gets, whether its share is out of
    reach (``short``) and whether it has fewer records than ``min_documents`` (``too_few``)."""
    got = draw(records, config, seed).groupBy("domain").agg(F.sum(F.col("chars") * F.col("repeats")).alias("mixed_chars"))
    everything = Window.partitionBy(F.lit(1))
    mixed = F.coalesce("mixed_chars", F.lit(0))
    return (
        allocate(records, config)
        .join(got, "domain", "left")
        .join(F.broadcast(config.groupBy("domain").agg(F.max("min_documents").alias("least"))), "domain", "left")  # configuration
        .select(
            "domain",
            "records",
            "chars",
            F.round("target_share", 6).alias("target_share"),
            F.round("given", 4).alias("planned_chars"),
            F.round("epochs", 6).alias("epochs"),
            mixed.cast("long").alias("mixed_chars"),
            F.round(mixed / F.nullif(F.sum(mixed).over(everything), F.lit(0)), 6).alias("actual_share"),
            F.coalesce("short", F.lit(False)).alias("short"),
            (F.col("records") < F.coalesce("least", F.lit(0))).alias("too_few"),
        )
    )


def found(records: DataFrame, config: DataFrame) -> DataFrame:
    """Configured domains that cannot reach their share."""
    return allocate(records, config).where("short").select("domain")
