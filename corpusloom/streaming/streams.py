"""The polling loops of a corpus monitor as Structured Streaming plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import activity, balance


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of log files, parsed; the checkpoint of the query keeps the place."""
    return activity.parse_lines(spark.readStream.text(path), "value")


def events(spark: SparkSession, path: str, like: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events as a stream with a watermark; NTZ times are read as UTC."""
    s = spark.readStream.schema(like.schema).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def daily_counts(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def unseen(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not delivered before; state is kept within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def auto_balance(stream: DataFrame, class_col: str, act: Callable[[DataFrame, int], None], corpus: Callable[[], DataFrame] | None = None, trigger: str = "15 minutes"):
    """Runs the imbalance rules whenever a batch arrives and hands the actions on; it never deletes or moves anything.

    The rules see the whole corpus as ``corpus`` reads it at that moment; without it, the batch alone.
    """

    def batch(df: DataFrame, k: int) -> None:
        act(balance.imbalances(corpus() if corpus else df, F.col(class_col)), k)

    return stream.writeStream.foreachBatch(batch).trigger(processingTime=trigger)


MILESTONES = (25, 50, 75, 100)


def passed(before: int, now: int, expected: int) -> list[int]:
    """Milestones in percent of the expected number that lie between two counts."""
    return [m for m in MILESTONES if expected > 0 and 100 * before < m * expected <= 100 * now]


def monitor(stream: DataFrame, text_col: str, expected: int, report: Callable[[dict, list[int]], None], trigger: str = "5 minutes"):
    """Running totals of files, empty and damaged texts (replacement characters beyond 2 %) after every batch, with the
    milestones passed since the last; one row of totals reaches the driver. After a restart the totals go on from the checkpoint."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lost = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    totals = stream.select((F.trim(text) == "").cast("long").alias("empty"), (lost > 0.02 * F.length(text)).cast("long").alias("damaged")).agg(F.count("*").alias("files"), F.sum("empty").alias("empty"), F.sum("damaged").alias("damaged"))
    last = {"files": 0}

    def batch(df: DataFrame, k: int) -> None:
        for r in df.collect():  # one row
            now = {c: r[c] or 0 for c in ("files", "empty", "damaged")}
            report(now | {"percent": round(100 * now["files"] / expected, 2) if expected else 0.0}, passed(last["files"], now["files"], expected))
            last["files"] = now["files"]

    return totals.writeStream.outputMode("complete").foreachBatch(batch).trigger(processingTime=trigger)
