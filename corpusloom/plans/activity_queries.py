"""Queries on activity, tasks and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import activity as A
from corpusloom.sources.tables import table

from ._registry import Registry

R = Registry()


def log(s, d):
    return A.flatten(table(s, d, "activity_log"))


def tasks(s, d):
    t = table(s, d, "task_history").distinct()
    minutes = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 60e6
    ok = F.col("end_time") >= F.col("start_time")
    return t.select("task_id", "task_name", "source", A.status_of(F.col("status")).alias("status"), F.least(F.greatest(F.coalesce("progress", F.lit(0)), F.lit(0)), F.lit(100)).alias("progress"), "start_time", F.when(ok, minutes).alias("minutes"))


def health(s, d):
    """100 less twice the population variance of the percents of documents by domain, and its band at 80 and 60."""
    k = table(s, d, "documents").groupBy("domain").agg(F.count("*").alias("n"))
    p = k.join(F.broadcast(k.agg(F.sum("n").alias("t")))).select((100.0 * F.col("n") / F.col("t")).alias("p"))  # one row
    h = p.agg(F.round(F.greatest(F.lit(0.0), 100 - 2 * F.var_pop("p")), 4).alias("health"))
    return h.select("health", F.when(F.col("health") >= 80, "good").when(F.col("health") >= 60, "fair").otherwise("poor").alias("band"))


LAST = "SELECT * FROM activity_log QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC, ts DESC, lower(source) DESC, task_id DESC, message DESC, details DESC) = 1"
FLAT = f"""SELECT event_id, ts, coalesce(lower(source), 'unknown') AS source, task_id, coalesce(message, '') AS message,
  coalesce(CASE WHEN json_valid(details) THEN json_extract_string(details, '$.status') END, 'unknown') AS status, CASE WHEN json_valid(details) THEN try_cast(json_extract_string(details, '$.files') AS BIGINT) END AS files,
  CASE WHEN json_valid(details) THEN try_cast(json_extract_string(details, '$.duration_seconds') AS DOUBLE) END AS seconds, CASE WHEN json_valid(details) THEN json_extract_string(details, '$.domain') END AS domain FROM ({LAST})"""
ST = "regexp_replace(lower(trim(status, ' ')), '[ -]', '_', 'g')"
TASKS = f"""SELECT task_id, task_name, source, CASE WHEN {ST} IN ('success', 'succeeded', 'completed', 'complete', 'done', 'ok', 'finished') THEN 'success' WHEN {ST} IN ('failed', 'failure', 'error', 'fail') THEN 'failed'
  WHEN {ST} IN ('running', 'in_progress', 'started') THEN 'running' WHEN {ST} IN ('cancelled', 'canceled', 'aborted') THEN 'cancelled' WHEN status IS NULL OR {ST} = '' THEN 'unknown' ELSE {ST} END AS status,
  least(greatest(coalesce(progress, 0), 0), 100) AS progress, start_time, CASE WHEN end_time >= start_time THEN (epoch_us(end_time) - epoch_us(start_time)) / 60e6::DOUBLE END AS minutes FROM (SELECT DISTINCT * FROM task_history)"""
R.add("activity_flatten", log, FLAT)
R.add(
    "activity_metrics", lambda s, d: log(s, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "success").cast("double")), 6).alias("success_rate"), F.sum((F.col("status") == "running").cast("long")).alias("running"), F.round(F.avg("seconds"), 6).alias("mean_seconds")),
    f"SELECT source, count(*) AS n, round(avg((status = 'success')::INT::DOUBLE), 6) AS success_rate, sum((status = 'running')::INT)::BIGINT AS running, round(avg(seconds), 6) AS mean_seconds FROM ({FLAT}) GROUP BY source",
)
R.add("log_filter", lambda s, d: log(s, d).where(F.contains(F.lower("message"), F.lit("failed")) & (F.col("status") == "error")).select("event_id", "source", "message"), f"SELECT event_id, source, message FROM ({FLAT}) WHERE contains(lower(message), 'failed') AND status = 'error'")
R.add(
    "log_details", lambda s, d: log(s, d).select("event_id", *[c.alias(n) for c, n in zip(A.split_details(F.col("message")), ("message", "details"))]),
    f"SELECT event_id, trim(CASE WHEN contains(message, ' | ') THEN substr(message, 1, position(' | ' IN message) - 1) ELSE message END, ' ') AS message, CASE WHEN contains(message, ' | ') THEN trim(substr(message, position(' | ' IN message) + 3), ' ') END AS details FROM ({FLAT})",
)
R.add(
    "log_lines_filter",
    lambda s, d: A.filter_lines(A.parse_lines(log(s, d).select(F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.translate("source", "0123456789", ""), F.when(F.col("status") == "error", "ERROR").otherwise("INFO"), "message").alias("line")), "line"), level="error", text="FAILED").select("time", "component", "message"),
    f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, translate(source, '0123456789', '') AS component, trim(message, ' ') AS message FROM ({FLAT}) WHERE status = 'error' AND contains(lower(message), 'failed')",
)
R.add("log_kinds", lambda s, d: table(s, d, "collectors").select("source", A.log_kind(F.concat("source", F.lit(".log"))).alias("value")), "SELECT source, CASE WHEN contains(lower(source), 'error') THEN 'error' WHEN contains(lower(source), 'collect') THEN 'collector' WHEN contains(lower(source), 'process') THEN 'processor' WHEN contains(lower(source), 'balanc') THEN 'balancer' WHEN contains(lower(source), 'gui') OR contains(lower(source), 'ui') THEN 'interface' ELSE 'general' END AS value FROM collectors")
R.add("log_components", lambda s, d: log(s, d).select("source").distinct(), f"SELECT DISTINCT source FROM ({FLAT})")
R.add(
    "task_rates", lambda s, d: tasks(s, d).groupBy("task_name").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "success").cast("double")), 6).alias("success_rate"), F.round(F.avg((F.col("status") == "failed").cast("double")), 6).alias("failure_rate"), F.round(F.avg("progress"), 4).alias("progress")),
    f"SELECT task_name, count(*) AS n, round(avg((status = 'success')::INT::DOUBLE), 6) AS success_rate, round(avg((status = 'failed')::INT::DOUBLE), 6) AS failure_rate, round(avg(progress), 4) AS progress FROM ({TASKS}) GROUP BY 1",
)
R.add("task_summary", lambda s, d: tasks(s, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("minutes"), 4).alias("mean_minutes")), f"SELECT status, count(*) AS n, round(avg(minutes), 4) AS mean_minutes FROM ({TASKS}) GROUP BY 1")
R.add("runtime_hist", lambda s, d: tasks(s, d).where("minutes is not null").groupBy(F.when(F.col("minutes") < 5, "<5").when(F.col("minutes") < 15, "5-15").when(F.col("minutes") < 30, "15-30").otherwise("30+").alias("bucket")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN minutes < 5 THEN '<5' WHEN minutes < 15 THEN '5-15' WHEN minutes < 30 THEN '15-30' ELSE '30+' END AS bucket, count(*) AS n FROM ({TASKS}) WHERE minutes IS NOT NULL GROUP BY 1")
R.add(
    "tasks_recent", lambda s, d: tasks(s, d).join(F.broadcast(tasks(s, d).agg(F.to_date(F.max("start_time")).alias("last")))).where(F.to_date("start_time") > F.date_sub("last", 30)).groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("n")),
    f"WITH t AS ({TASKS}) SELECT start_time::DATE AS day, count(*) AS n FROM t WHERE start_time::DATE > (SELECT max(start_time)::DATE - 30 FROM t) GROUP BY 1",
)
R.add("recent_tasks", lambda s, d: tasks(s, d).orderBy(F.desc("start_time"), "task_id").limit(20).select("task_id", "status", "start_time"), f"SELECT task_id, status, start_time FROM ({TASKS}) ORDER BY start_time DESC, task_id LIMIT 20")
R.add(
    "corpus_health", health,
    """WITH k AS (SELECT coalesce(domain, 'unknown') AS class, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT 100.0::DOUBLE * n / sum(n) OVER () AS p FROM k), h AS (SELECT round(greatest(0.0, 100 - 2 * var_pop(p)), 4) AS health FROM p)
      SELECT health, CASE WHEN health >= 80 THEN 'good' WHEN health >= 60 THEN 'fair' ELSE 'poor' END AS band FROM h""",
)
R.add("activity_by_task", lambda s, d: log(s, d).join(tasks(s, d).select("task_id", "task_name").distinct(), "task_id").groupBy("task_name").agg(F.count("*").alias("n"), F.sum("files").alias("files")), f"SELECT task_name, count(*) AS n, sum(files)::BIGINT AS files FROM ({FLAT}) JOIN (SELECT DISTINCT task_id, task_name FROM task_history) USING (task_id) GROUP BY 1")
R.add("late_events", lambda s, d: log(s, d).select("event_id").join(table(s, d, "activity_log").groupBy("event_id").agg(F.min("ingested_at").alias("i"), F.min("ts").alias("t")).where("i > t + interval 7 days"), "event_id").select("event_id"), "SELECT event_id FROM activity_log GROUP BY 1 HAVING min(ingested_at) > min(ts) + INTERVAL 7 DAYS")
EV = "events"
R.add("events_tumbling", lambda s, d: table(s, d, EV).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "n", "value"), "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
R.add("events_sliding", lambda s, d: table(s, d, EV).groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n"), "SELECT day, count(*) AS n FROM (SELECT unnest([ts::DATE, (ts::DATE - INTERVAL 1 DAY)::DATE]) AS day FROM events) GROUP BY 1")
R.add(
    "events_session", lambda s, d: table(s, d, EV).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n"),
    "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k",
)

QUERIES, SQL = R.queries, R.sql
