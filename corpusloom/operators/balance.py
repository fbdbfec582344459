"""Balance of a corpus over classes: distribution metrics, rules, and plans to rebalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTROPY_MIN, GINI_MAX, RATIO_MAX, MIN_SAMPLES, LOW_QUALITY_MAX, DOMINANCE_MAX = 2.0, 0.7, 10.0, 30, 0.3, 5.0


def counts(df: DataFrame, c: Column) -> DataFrame:
    return df.groupBy(F.coalesce(c, F.lit("unknown")).alias("class")).agg(F.count("*").alias("n"))


def metrics(df: DataFrame, c: Column, configured: int | None = None) -> DataFrame:
    """One row: entropy, balance ratio, Gini, dominance and max ratio of the class counts.

    Windows run over the table of class counts, which is small whatever the corpus.
    """
    k = counts(df, c)
    w = Window.orderBy("n", "class").rowsBetween(Window.unboundedPreceding, 0)
    d = Window.orderBy(F.desc("n"), "class")
    total = Window.partitionBy(F.lit(1))
    k = k.select("class", "n", F.sum("n").over(total).alias("t"), F.sum("n").over(w).cast("double").alias("cum"), F.row_number().over(d).alias("r"))
    p = F.col("n") / F.col("t")
    a = k.agg(
        F.count("*").alias("classes"), F.sum("n").alias("total"), (-F.sum(p * F.log2(p))).alias("entropy"), F.sum("cum").alias("cums"),
        F.max(F.when(F.col("r") == 1, F.col("n"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("n"))).alias("second"), F.min("n").alias("least"),
    )
    m = F.lit(configured) if configured else F.col("classes")
    return a.select(
        "classes", "total", F.round("entropy", 6).alias("entropy"),
        F.round(F.when(m <= 1, 1.0).otherwise(F.col("entropy") / F.log2(m.cast("double"))), 6).alias("balance_ratio"),
        F.round((F.col("classes") + 1 - 2 * F.col("cums") / F.col("total")) / F.col("classes"), 6).alias("gini"),
        F.round(F.when(F.col("second").isNull(), F.lit(float("inf"))).otherwise(F.col("top") / F.col("second")), 6).alias("dominance"),
        F.round(F.col("top") / F.col("least"), 6).alias("max_ratio"),
    )


def imbalances(df: DataFrame, c: Column) -> DataFrame:
    """(severity, rule, value) of the broken rules."""
    m = metrics(df, c)
    small = counts(df, c).where(F.col("n") < MIN_SAMPLES).agg(F.count("*").cast("double").alias("value")).where("value > 0")
    rule = lambda cond, sev, name, v: m.where(cond).select(F.lit(sev).alias("severity"), F.lit(name).alias("rule"), F.col(v).cast("double").alias("value"))
    return (
        rule(F.col("entropy") < ENTROPY_MIN, "critical", "low_entropy", "entropy")
        .unionByName(rule(F.col("dominance") > RATIO_MAX, "warning", "dominant_class", "dominance"))
        .unionByName(rule(F.col("gini") > GINI_MAX, "info", "high_gini", "gini"))
        .unionByName(small.select(F.lit("warning").alias("severity"), F.lit("small_classes").alias("rule"), "value"))
    )


def rebalance_plan(df: DataFrame, c: Column, config: DataFrame) -> DataFrame:
    """Current and target count of each configured class and what to do."""
    key = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    have = df.where(key.isNotNull()).groupBy(key.alias("domain")).agg(F.count("*").alias("n"))
    j = config.select("domain").join(have, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("current"))
    w = Window.partitionBy(F.lit(1))
    j = j.withColumn("target", F.floor(F.sum("current").over(w) / F.count("*").over(w)))
    act = F.when(F.col("current") == 0, "collect").when(F.col("current") * 2 < F.col("target"), "upsample").when(F.col("current") > F.col("target") * 2, "downsample").otherwise("keep")
    return j.select("domain", "current", "target", act.alias("action"), (F.col("target") - F.col("current")).alias("delta"))


def downsample(df: DataFrame, class_col: str, score: Column, id_col: str, n: int) -> DataFrame:
    """The n best of each class. Row numbers with a limit below let Spark keep only n rows a task before the shuffle."""
    w = Window.partitionBy("class").orderBy(F.desc("score"), F.col(id_col))
    s = df.select(F.coalesce(class_col, F.lit("unknown")).alias("class"), id_col, score.alias("score"))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("class", id_col, "rank")


def upsample(df: DataFrame, class_col: str, id_col: str) -> DataFrame:
    """(class, id, copies): whole repeats that bring each class up to the largest one."""
    k = df.select(F.coalesce(class_col, F.lit("unknown")).alias("class"), id_col)
    n = k.groupBy("class").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    times = n.select("class", F.floor(F.max("n").over(w) / F.col("n")).alias("copies"))
    return k.join(F.broadcast(times), "class").select("class", id_col, "copies")  # one row per class


def quality_rules(df: DataFrame, domain: Column, flag: Column, kind: Column, plan: DataFrame) -> DataFrame:
    """(severity, action, subject, value): what to do about missing and crowded classes, poor quality and one file type.

    Missing classes are high; a first class more than DOMINANCE_MAX times the second, more than a fifth of low quality
    (above LOW_QUALITY_MAX critical) and more than four fifths of one file type are medium.
    """
    rows = lambda d, sev, act, subject, value: d.select(F.lit(sev).alias("severity") if isinstance(sev, str) else sev.alias("severity"), F.lit(act).alias("action"), subject.alias("subject"), F.round(value, 6).alias("value"))
    k = counts(df, domain)
    # the two largest classes by a maximum of pairs: no sort of the corpus
    two = k.agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "class")), asc=False), 1, 2).alias("t"))  # one row per class
    lead = F.col("t")[0]["n"] / F.try_element_at("t", F.lit(2))["n"]
    total = df.agg(F.avg(F.coalesce((flag == "low_quality").cast("double"), F.lit(0.0))).alias("low"))
    kinds = counts(df, kind)
    share = kinds.join(F.broadcast(kinds.agg(F.sum("n").alias("t")))).select("class", (F.col("n") / F.col("t")).alias("s"))
    return (
        rows(plan.where("current = 0"), "high", "collect", F.col("domain"), F.lit(0.0))
        .unionByName(rows(two.where(lead > DOMINANCE_MAX), "medium", "downsample", F.col("t")[0]["class"], lead))
        .unionByName(rows(total.where("low > 0.2"), F.when(F.col("low") > LOW_QUALITY_MAX, "critical").otherwise("medium"), "review_quality", F.lit("low_quality"), F.col("low")))
        .unionByName(rows(share.where("s > 0.8"), "medium", "diversify_types", F.col("class"), F.col("s")))
    )


def config_check(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(check, key, a, b) of two configurations (key, weight): missing, extra, mismatch, duplicate, and a sum that is not 1."""
    one = lambda d: d.groupBy("key").agg(F.max("weight").alias("w"), F.count("*").alias("n"))
    j = one(a).select("key", F.col("w").alias("a"), F.col("n").alias("na")).join(one(b).select("key", F.col("w").alias("b"), F.col("n").alias("nb")), "key", "full_outer")
    pick = lambda cond, name: j.where(cond).select(F.lit(name).alias("check"), "key", "a", "b")
    total = lambda d, name: d.agg(F.round(F.sum("weight"), 9).alias("s")).where(F.abs(F.coalesce("s", F.lit(0.0)) - 1) > tolerance).select(F.lit("sum").alias("check"), F.lit(name).alias("key"), *[(F.col("s") if name == x else F.lit(None).cast("double")).alias(x) for x in "ab"])
    return (
        pick("nb is null", "missing").unionByName(pick("na is null", "extra")).unionByName(pick(F.abs(F.col("a") - F.col("b")) > tolerance, "mismatch"))
        .unionByName(pick("na > 1 or nb > 1", "duplicate")).unionByName(total(a, "a")).unionByName(total(b, "b"))
    )


def config_sync(a: DataFrame, b: DataFrame, force: bool = False) -> DataFrame:
    """(key, weight) of a brought up to date from b: keys that only b has are added; weights of a stay unless forced."""
    x, y = a.select("key", F.col("weight").alias("x"), F.lit(True).alias("in_a")), b.select("key", F.col("weight").alias("y"))
    first, second = ("y", "x") if force else ("x", "y")
    return x.join(y, "key", "full_outer").select("key", F.coalesce(first, second).alias("weight"))


def weighted_quality(tokens: Column, flag: Column, language: Column, corruption: Column) -> Column:
    """0.3 tokens (full at 1,000), 0.4 flag, 0.2 language confidence, 0.1 corruption score; each from 0 to 1."""
    good = F.when(flag == "ok", 1.0).when(flag == "flagged", 0.5).otherwise(0.0)
    size = F.least(F.lit(1.0), F.coalesce(tokens, F.lit(0)) / 1000.0)
    return F.round(0.3 * size + 0.4 * good + 0.2 * F.coalesce(language, F.lit(0.0)) + 0.1 * F.coalesce(corruption, F.lit(100.0)) / 100, 6)


def report_markdown(df: DataFrame, c: Column, title: str) -> str:
    """The balance of a corpus as a Markdown page; only class counts and one row of metrics reach the driver."""
    m = metrics(df, c).first()
    rows = counts(df, c).orderBy(F.desc("n"), "class").collect()  # one row per class
    total = sum(r["n"] for r in rows) or 1
    lines = [f"# {title}", "", "| measure | value |", "|---|---|", *[f"| {k} | {m[k]} |" for k in ("classes", "total", "entropy", "balance_ratio", "gini", "dominance")]]
    lines += ["", "| class | records | share |", "|---|---|---|", *[f"| {r['class']} | {r['n']} | {100 * r['n'] / total:.1f} % |" for r in rows]]
    issues = imbalances(df, c).orderBy("severity", "rule").collect()
    return "\n".join([*lines, "", *[f"- **{r['severity']}** {r['rule']}: {r['value']:.4g}" for r in issues]]) + "\n"


def term_shift(config: DataFrame, plan: DataFrame) -> DataFrame:
    """(domain, terms, factor): search terms of under-filled domains, to be searched by the factor more."""
    j = config.select("domain", "search_terms").join(plan.where("current < target"), "domain")
    return j.select("domain", F.array_join(F.sort_array("search_terms"), "; ").alias("terms"), F.round(F.least(F.lit(3.0), (F.col("target") + 1) / (F.col("current") + 1)), 4).alias("factor"))
