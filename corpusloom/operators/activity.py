"""Logs, activity and task history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_FORMATS = (
    r"^\[([0-9-]+ [0-9:,.]+)\] \[?([A-Z]+)\]? ?\[?([A-Za-z_.]+)\]? - (.*)$",
    r"^([0-9-]+ [0-9:,.]+) - ([A-Za-z_.]+) - ([A-Z]+) - (.*)$",
    r"^([A-Z]+):([A-Za-z_.]+):(.*)$",
)


def parse_lines(df: DataFrame, line: str) -> DataFrame:
    """time, level, component, message of each line: three formats in order, else INFO / Unknown without a time."""
    a, b, c = LINE_FORMATS
    x = F.col(line)
    g = lambda p, k: F.regexp_extract(x, p, k)
    pick = lambda i, j, k, other: F.when(x.rlike(a), i).when(x.rlike(b), j).when(x.rlike(c), k).otherwise(other)
    return df.select(
        line, pick(g(a, 1), g(b, 1), F.lit(None), F.lit(None)).alias("time"), pick(g(a, 2), g(b, 3), g(c, 1), F.lit("INFO")).alias("level"),
        pick(g(a, 3), g(b, 2), g(c, 2), F.lit("Unknown")).alias("component"), F.trim(pick(g(a, 4), g(b, 4), g(c, 3), x)).alias("message"),
    )


def last_delivery(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key: the latest delivery. A maximum with partial aggregation instead of a sorted window."""
    others = [c for c in df.columns if c not in (key, at)]
    m = df.groupBy(key).agg(F.max(F.struct(at, *others)).alias("m"))
    return m.select(key, "m.*")


def flatten(df: DataFrame) -> DataFrame:
    """Activity events once each, with the fields of their JSON details and defaults."""
    d = df.select("event_id", "ingested_at", F.col("ts"), F.lower("source").alias("source"), "task_id", "message", "details")
    d = last_delivery(d, "event_id", "ingested_at")
    d = d.withColumn("v", F.try_parse_json("details"))  # cut JSON gives null
    j = lambda k, kind="string": F.try_variant_get("v", f"$.{k}", kind)
    return d.select(
        "event_id", "ts", F.coalesce("source", F.lit("unknown")).alias("source"), "task_id", F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce(j("status"), F.lit("unknown")).alias("status"), j("files", "bigint").alias("files"),
        j("duration_seconds", "double").alias("seconds"), j("domain").alias("domain"),
    )


def status_of(c: Column) -> Column:
    """Spellings of a task status in one form."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    return (
        F.when(s.isin("success", "succeeded", "completed", "complete", "done", "ok", "finished"), "success").when(s.isin("failed", "failure", "error", "fail"), "failed")
        .when(s.isin("running", "in_progress", "started"), "running").when(s.isin("cancelled", "canceled", "aborted"), "cancelled").when(s.isNull() | (s == ""), "unknown").otherwise(s)
    )


def split_details(message: Column) -> tuple[Column, Column]:
    """(message, details) of a line written as 'message | details'; details are null without a bar."""
    parts = F.split(message, r" \| ", 2)
    return F.trim(parts[0]), F.trim(F.try_element_at(parts, F.lit(2)))


def filter_lines(df: DataFrame, level: str | None = None, component: str | None = None, text: str | None = None, day: Column | None = None) -> DataFrame:
    """Parsed lines by level, component, a text in any case, and the day of their time."""
    out = df
    if level:
        out = out.where(F.upper("level") == level.upper())
    if component:
        out = out.where(F.col("component") == component)
    if text:
        out = out.where(F.contains(F.lower("message"), F.lit(text.lower())))
    return out.where(F.to_date(F.substring("time", 1, 10)) == day) if day is not None else out


def log_kind(name: Column) -> Column:
    """What a log file holds, by its name."""
    low = F.lower(name)
    kind = None
    for k, label in (("error", "error"), ("collect", "collector"), ("process", "processor"), ("balanc", "balancer"), ("gui", "interface"), ("ui", "interface")):
        kind = F.when(F.contains(low, F.lit(k)), label) if kind is None else kind.when(F.contains(low, F.lit(k)), label)
    return kind.otherwise("general")
