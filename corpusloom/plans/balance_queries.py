"""Queries on counts, balance, targets and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import balance as B
from corpusloom.operators import dedup as D
from corpusloom.operators import quality as Q
from corpusloom.sources.tables import table

from ._registry import Registry
from .text_queries import N_TOK

R = Registry()


def docs(s, d):
    return table(s, d, "documents")


def results(s, d):
    return table(s, d, "extraction_results")


LANG = "coalesce(lang, 'unknown')"


def overview(s, d):
    """Exact duplicates removed, tokens and flag by language, share and entropy of what is left."""
    x = docs(s, d)
    kept = D.keep(x, "doc_id", "text").where("kept").select("doc_id")
    t = x.join(kept, "doc_id").select(F.coalesce("lang", F.lit("unknown")).alias("lang"), X.token_count(F.col("text")).alias("tokens"))
    g = t.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum((Q.quality_flag(F.col("tokens")) == "low_quality").cast("long")).alias("low_quality"))
    w = Window.partitionBy(F.lit(1))  # one row per language
    p = F.col("docs") / F.sum("docs").over(w)
    return g.select("lang", "docs", "tokens", "low_quality", F.round(p, 6).alias("share"), F.round(-p * F.log2(p), 6).alias("entropy_part"))


R.add(
    "corpus_overview", overview,
    f"""WITH k AS (SELECT {LANG} AS lang, {N_TOK} AS tokens FROM documents QUALIFY text IS NULL OR row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1),
      g AS (SELECT lang, count(*) AS docs, sum(tokens)::BIGINT AS tokens, sum((tokens < 100)::INT)::BIGINT AS low_quality FROM k GROUP BY lang)
      SELECT *, round(docs / sum(docs) OVER (), 6) AS share, round(-(docs / sum(docs) OVER ()) * log2(docs / sum(docs) OVER ()), 6) AS entropy_part FROM g""",
)
R.add(
    "corpus_report",
    lambda s, d: results(s, d).groupingSets([["domain"], ["file_type"], ["quality_flag"], ["language"]], "domain", "file_type", "quality_flag", "language").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(F.when(F.col("g") == 7, "domain").when(F.col("g") == 11, "file_type").when(F.col("g") == 13, "quality_flag").otherwise("language").alias("dimension"), F.coalesce("domain", "file_type", "quality_flag", "language").alias("value"), "n"),
    "SELECT CASE WHEN g = 7 THEN 'domain' WHEN g = 11 THEN 'file_type' WHEN g = 13 THEN 'quality_flag' ELSE 'language' END AS dimension, coalesce(domain, file_type, quality_flag, language) AS value, n FROM (SELECT domain, file_type, quality_flag, language, grouping(domain, file_type, quality_flag, language) AS g, count(*) AS n FROM extraction_results GROUP BY GROUPING SETS ((domain), (file_type), (quality_flag), (language)))",
)
METRICS = f"""WITH k AS (SELECT {LANG} AS class, count(*) AS n FROM documents GROUP BY 1),
  w AS (SELECT class, n, sum(n) OVER () AS t, sum(n) OVER (ORDER BY n, class ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, row_number() OVER (ORDER BY n DESC, class) AS r FROM k),
  a AS (SELECT count(*) AS classes, sum(n)::BIGINT AS total, -sum(n / t * log2(n / t)) AS e, sum(cum)::DOUBLE AS cums, max(CASE WHEN r = 1 THEN n END) AS top, max(CASE WHEN r = 2 THEN n END) AS second, min(n) AS least FROM w)"""
R.add("balance_metrics", lambda s, d: B.metrics(docs(s, d), F.col("lang")), METRICS + " SELECT classes, total, round(e, 6) AS entropy, round(CASE WHEN classes <= 1 THEN 1.0 ELSE e / log2(classes) END, 6) AS balance_ratio, round((classes + 1 - 2 * cums / total) / classes, 6) AS gini, round(top / second, 6) AS dominance, round(top / least, 6) AS max_ratio FROM a")
for name, expr, sql in (
    ("entropy", "entropy", "round(e, 6)"), ("balance_ratio", "balance_ratio", "round(CASE WHEN classes <= 1 THEN 1.0 ELSE e / log2(classes) END, 6)"),
    ("gini", "gini", "round((classes + 1 - 2 * cums / total) / classes, 6)"), ("dominance", "dominance", "round(top / second, 6)"),
):
    R.add(name, lambda s, d, e=expr: B.metrics(docs(s, d), F.col("lang")).select(F.col(e).alias("value")), f"{METRICS} SELECT {sql} AS value FROM a")
R.add(
    "imbalances", lambda s, d: B.imbalances(docs(s, d), F.col("lang")).select("severity", "rule", F.round("value", 6).alias("value")),
    f"""{METRICS}, r AS (SELECT 'critical' AS severity, 'low_entropy' AS rule, e AS value FROM a WHERE round(e, 6) < 2.0 UNION ALL SELECT 'warning', 'dominant_class', round(top / second, 6) FROM a WHERE round(top / second, 6) > 10
      UNION ALL SELECT 'info', 'high_gini', round((classes + 1 - 2 * cums / total) / classes, 6) FROM a WHERE round((classes + 1 - 2 * cums / total) / classes, 6) > 0.7
      UNION ALL SELECT 'warning', 'small_classes', count(*)::DOUBLE FROM k WHERE n < 30 HAVING count(*) > 0) SELECT severity, rule, round(value, 6) AS value FROM r""",
)
KEY = "regexp_replace(lower(trim(domain, ' ')), '[ -]', '_', 'g')"
PLAN = f"""WITH h AS (SELECT {KEY} AS domain, count(*) AS n FROM extraction_results WHERE domain IS NOT NULL GROUP BY 1), j AS (SELECT c.domain, coalesce(h.n, 0) AS current FROM domain_config c LEFT JOIN h USING (domain)),
  t AS (SELECT *, floor(sum(current) OVER () / count(*) OVER ())::BIGINT AS target FROM j)
  SELECT domain, current, target, CASE WHEN current = 0 THEN 'collect' WHEN current * 2 < target THEN 'upsample' WHEN current > target * 2 THEN 'downsample' ELSE 'keep' END AS action, target - current AS delta FROM t"""


def plan(s, d):
    return B.rebalance_plan(results(s, d), F.col("domain"), table(s, d, "domain_config"))


R.add("rebalance_plan", plan, PLAN)
R.add("should_rebalance", lambda s, d: plan(s, d).agg(F.max((F.col("action") != "keep")).alias("value")), f"SELECT max(action <> 'keep') AS value FROM ({PLAN})")
R.add("missing_domains", lambda s, d: plan(s, d).where("current = 0").select("domain"), f"SELECT domain FROM ({PLAN}) WHERE current = 0")
R.add(
    "balance_ratio_configured",  # over the configured domains, whether they occur or not
    lambda s, d: B.metrics(results(s, d), F.regexp_replace(F.lower(F.trim("domain")), "[ -]", "_"), table(s, d, "domain_config").count()).select(F.col("balance_ratio").alias("value")),
    f"""WITH k AS (SELECT coalesce({KEY}, 'unknown') AS c, count(*)::DOUBLE AS n FROM extraction_results GROUP BY 1), t AS (SELECT sum(n) AS t FROM k)
      SELECT round(-sum(n / t * log2(n / t)) / log2((SELECT count(*) FROM domain_config)), 6) AS value FROM k, t""",
)
R.add(
    "recommendations", lambda s, d: B.quality_rules(results(s, d), F.regexp_replace(F.lower(F.trim("domain")), "[ -]", "_"), F.col("quality_flag"), F.col("file_type"), plan(s, d)),
    f"""WITH k AS (SELECT coalesce({KEY}, 'unknown') AS class, count(*) AS n FROM extraction_results GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, class DESC) AS r, lead(n) OVER (ORDER BY n DESC, class DESC) AS n2 FROM k),
      l AS (SELECT avg(coalesce((quality_flag = 'low_quality')::INT::DOUBLE, 0)) AS low FROM extraction_results), f AS (SELECT coalesce(file_type, 'unknown') AS class, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM extraction_results GROUP BY 1)
      SELECT 'high' AS severity, 'collect' AS action, domain AS subject, 0.0::DOUBLE AS value FROM ({PLAN}) WHERE current = 0
      UNION ALL SELECT 'medium', 'downsample', class, round(n::DOUBLE / n2, 6) FROM o WHERE r = 1 AND n::DOUBLE / n2 > 5
      UNION ALL SELECT CASE WHEN low > 0.3 THEN 'critical' ELSE 'medium' END, 'review_quality', 'low_quality', round(low, 6) FROM l WHERE low > 0.2
      UNION ALL SELECT 'medium', 'diversify_types', class, round(s, 6) FROM f WHERE s > 0.8""",
)
R.add("term_shift", lambda s, d: B.term_shift(table(s, d, "domain_config"), plan(s, d)), f"SELECT domain, array_to_string(list_sort(search_terms), '; ') AS terms, round(least(3.0::DOUBLE, (target + 1)::DOUBLE / (current + 1)), 4) AS factor FROM domain_config JOIN ({PLAN}) USING (domain) WHERE current < target")


def gap(s, d):
    w = Window.partitionBy(F.lit(1))  # configured domains only
    j = plan(s, d).select("domain", "current").join(table(s, d, "domain_config").select("domain", "target_weight"), "domain")
    share = 100 * F.col("current") / F.nullif(F.sum("current").over(w), F.lit(0))
    target = 100 * F.col("target_weight") / F.sum("target_weight").over(w)
    return j.select("domain", "current", F.round(share, 6).alias("share"), F.round(target, 6).alias("target"), F.when(F.abs(share - target) <= 1, "balanced").when(F.abs(share - target) <= 3, "near").otherwise("off").alias("status"), F.greatest(F.lit(0), F.ceil((target - share) / 100 * F.sum("current").over(w))).alias("needed"))


GAP = f"""WITH p AS ({PLAN}), j AS (SELECT p.domain, p.current, 100.0::DOUBLE * current / nullif(sum(current) OVER (), 0) AS share, 100.0::DOUBLE * target_weight / sum(target_weight) OVER () AS target, sum(current) OVER () AS t FROM p JOIN domain_config c USING (domain))
  SELECT domain, current, round(share, 6) AS share, round(target, 6) AS target, CASE WHEN abs(share - target) <= 1 THEN 'balanced' WHEN abs(share - target) <= 3 THEN 'near' ELSE 'off' END AS status, greatest(0, ceil((target - share) / 100 * t))::BIGINT AS needed FROM j"""
R.add("domain_gap", gap, GAP)
R.add("balance_score", lambda s, d: gap(s, d).agg(F.round(100 - F.avg(F.abs(F.col("share") - F.col("target"))), 4).alias("value")), f"SELECT round(100 - avg(abs(share - target)), 4) AS value FROM ({GAP})")
R.add(
    "allocation", lambda s, d: table(s, d, "domain_config").select("domain", F.floor(1000 * F.col("allocation")).alias("n"), F.row_number().over(Window.orderBy("domain")).alias("r")).select("domain", "r", "n", (1000 - F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("rest")).select("domain", (F.col("n") + F.when((F.col("r") == 1) & (F.col("rest") > 0), F.col("rest")).otherwise(0)).alias("n")),
    "WITH a AS (SELECT domain, floor(1000 * allocation)::BIGINT AS n, row_number() OVER (ORDER BY domain) AS r FROM domain_config), b AS (SELECT *, (1000 - sum(n) OVER ())::BIGINT AS rest FROM a) SELECT domain, n + CASE WHEN r = 1 AND rest > 0 THEN rest ELSE 0 END AS n FROM b",
)


def configs(s, d):
    """The domain table and the keyword table as two configurations with their weights."""
    return table(s, d, "domain_config").select(F.col("domain").alias("key"), F.col("target_weight").alias("weight")), table(s, d, "domain_keywords").select(F.col("domain").alias("key"), F.col("min_confidence").alias("weight"))


R.add(
    "config_diff", lambda s, d: B.config_check(*configs(s, d)),
    """WITH a AS (SELECT domain AS key, max(target_weight) AS a, count(*) AS na FROM domain_config GROUP BY 1), b AS (SELECT domain AS key, max(min_confidence) AS b, count(*) AS nb FROM domain_keywords GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (key))
      SELECT 'missing' AS check, key, a, b FROM j WHERE nb IS NULL UNION ALL SELECT 'extra', key, a, b FROM j WHERE na IS NULL UNION ALL SELECT 'mismatch', key, a, b FROM j WHERE abs(a - b) > 1e-6
      UNION ALL SELECT 'duplicate', key, a, b FROM j WHERE na > 1 OR nb > 1 UNION ALL SELECT 'sum', 'a', s, NULL FROM (SELECT round(sum(target_weight), 9) AS s FROM domain_config) WHERE abs(coalesce(s, 0) - 1) > 1e-6
      UNION ALL SELECT 'sum', 'b', NULL, s FROM (SELECT round(sum(min_confidence), 9) AS s FROM domain_keywords) WHERE abs(coalesce(s, 0) - 1) > 1e-6""",
)
for _force in (False, True):
    R.add(
        "config_sync_force" if _force else "config_sync", lambda s, d, f=_force: B.config_sync(*configs(s, d), force=f),
        f"SELECT domain AS key, {'coalesce(min_confidence, target_weight)' if _force else 'coalesce(target_weight, min_confidence)'} AS weight FROM domain_config FULL JOIN domain_keywords USING (domain)",
    )
R.add(
    "weighted_quality",
    lambda s, d: results(s, d).select("result_id", B.weighted_quality(F.col("token_count"), F.col("quality_flag"), F.col("language_confidence"), F.col(SC)).alias("q")).groupBy("result_id").agg(F.max("q").alias("quality")),
    f"""SELECT result_id, max(round(0.3::DOUBLE * least(1.0::DOUBLE, coalesce(token_count, 0) / 1000.0::DOUBLE) + 0.4::DOUBLE * CASE WHEN quality_flag = 'ok' THEN 1.0::DOUBLE WHEN quality_flag = 'flagged' THEN 0.5::DOUBLE ELSE 0.0 END
      + 0.2::DOUBLE * coalesce(language_confidence, 0.0) + 0.1::DOUBLE * coalesce({{SC}}, 100.0) / 100, 6)) AS quality FROM extraction_results GROUP BY 1""".replace("{SC}", "quality_metrics.corruption.corruption_score_normalized"),
)
R.add(
    "token_stats", lambda s, d: docs(s, d).select(X.token_count(F.col("text")).alias("t")).agg(F.round(F.avg("t"), 6).alias("mean"), F.expr("percentile(t, 0.5)").alias("median"), F.round(F.stddev_samp("t"), 6).alias("std"), F.min("t").alias("min"), F.max("t").alias("max"), F.expr("percentile(t, 0.25)").alias("q25"), F.expr("percentile(t, 0.75)").alias("q75")),
    f"SELECT round(avg(t), 6) AS mean, quantile_cont(t, 0.5) AS median, round(stddev_samp(t), 6) AS std, min(t) AS min, max(t) AS max, quantile_cont(t, 0.25) AS q25, quantile_cont(t, 0.75) AS q75 FROM (SELECT {N_TOK} AS t FROM documents)",
)
SC = "quality_metrics.corruption.corruption_score_normalized"
R.add("quality_ratios", lambda s, d: results(s, d).select(F.coalesce(SC, F.lit(100.0)).alias("c")).agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.avg((F.col("c") >= 80).cast("double")), 6).alias("high"), F.round(F.avg((F.col("c") < 50).cast("double")), 6).alias("low")), f"SELECT round(avg(c), 6) AS mean, round(avg((c >= 80)::INT::DOUBLE), 6) AS high, round(avg((c < 50)::INT::DOUBLE), 6) AS low FROM (SELECT coalesce({SC}, 100.0) AS c FROM extraction_results)")
R.add(
    "temporal", lambda s, d: docs(s, d).where("collected_at is not null").groupBy(F.to_date("collected_at").alias("day")).agg(F.count("*").alias("n")).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("span"), F.count("*").alias("active_days"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("min"), F.max("n").alias("max")),
    "SELECT min(day) AS first, max(day) AS last, (max(day) - min(day))::BIGINT AS span, count(*) AS active_days, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max FROM (SELECT collected_at::DATE AS day, count(*) AS n FROM documents WHERE collected_at IS NOT NULL GROUP BY 1)",
)
R.add("docs_per_day", lambda s, d: docs(s, d).where("collected_at is not null").groupBy(F.to_date("collected_at").alias("day")).agg(F.count("*").alias("n")), "SELECT collected_at::DATE AS day, count(*) AS n FROM documents WHERE collected_at IS NOT NULL GROUP BY 1")
R.add("docs_by_day_range", lambda s, d: docs(s, d).where("collected_at >= timestamp_ntz'2024-06-01' and collected_at < timestamp_ntz'2024-09-01'").groupBy(F.to_date("collected_at").alias("day"), F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n")), "SELECT collected_at::DATE AS day, coalesce(domain, 'unknown') AS domain, count(*) AS n FROM documents WHERE collected_at >= '2024-06-01' AND collected_at < '2024-09-01' GROUP BY ALL")
R.add("language_counts", lambda s, d: docs(s, d).groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n")), f"SELECT {LANG} AS lang, count(*) AS n FROM documents GROUP BY 1")
R.add("domain_distribution", lambda s, d: B.counts(docs(s, d), F.col("domain")).select(F.col("class").alias("domain"), "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2).alias("pct")), "SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY 1")
R.add(
    "domain_stats", lambda s, d: results(s, d).rollup("directory", "file_type").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.grouping_id().alias("level")).select("directory", "file_type", "level", "files", "bytes"),
    "SELECT directory, file_type, grouping(directory, file_type) AS level, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM extraction_results GROUP BY ROLLUP (directory, file_type)",
)
R.add("top_domains", lambda s, d: B.counts(docs(s, d), F.col("domain")).orderBy(F.desc("n"), "class").limit(5), "SELECT coalesce(domain, 'unknown') AS class, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, class LIMIT 5")
HASH = "('0x' || substr(md5('s:' || doc_id), 1, 13))::BIGINT"
R.add("stratified_sample", lambda s, d: docs(s, d).select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang")).where(F.conv(F.substring(F.md5(F.concat(F.lit("s:"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52)) < F.when(F.col("lang") == "en", 0.1).otherwise(0.3)), f"SELECT doc_id, {LANG} AS lang FROM documents WHERE {HASH} / 4503599627370496.0 < CASE WHEN coalesce(lang, 'unknown') = 'en' THEN 0.1 ELSE 0.3 END")
R.add("downsample_topk", lambda s, d: B.downsample(docs(s, d), "lang", X.token_count(F.col("text")), "doc_id", 50).select("class", "doc_id", F.col("rank").cast("long").alias("rank")), f"SELECT {LANG} AS class, doc_id, row_number() OVER (PARTITION BY {LANG} ORDER BY {N_TOK} DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50")
R.add("upsample_rank", lambda s, d: B.upsample(docs(s, d), "lang", "doc_id"), f"WITH k AS (SELECT {LANG} AS class, doc_id FROM documents), n AS (SELECT class, floor(max(count(*)) OVER () / count(*))::BIGINT AS copies FROM k GROUP BY class) SELECT class, doc_id, copies FROM k JOIN n USING (class)")
R.add("monitor_snapshot", lambda s, d: results(s, d).groupBy("directory").agg(F.count("*").alias("files"), F.sum((F.coalesce(F.trim("text"), F.lit("")) == "").cast("long")).alias("empty"), F.sum((F.coalesce(SC, F.lit(0.0)) >= 80).cast("long")).alias("corrupted")).withColumn("pct_sound", F.round(100 * (F.col("files") - F.col("empty") - F.col("corrupted")) / F.col("files"), 4)), f"SELECT directory, files, empty, corrupted, round(100.0::DOUBLE * (files - empty - corrupted) / files, 4) AS pct_sound FROM (SELECT directory, count(*) AS files, sum((coalesce(trim(text, ' '), '') = '')::INT)::BIGINT AS empty, sum((coalesce({SC}, 0.0) >= 80)::INT)::BIGINT AS corrupted FROM extraction_results GROUP BY 1)")
R.add("history_pivot", lambda s, d: docs(s, d).where("collected_at is not null").groupBy(F.trunc("collected_at", "month").alias("month")).pivot("lang", ["de", "en", "fr"]).agg(F.count(F.lit(1))).na.fill(0), "SELECT date_trunc('month', collected_at)::DATE AS month, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr FROM documents WHERE collected_at IS NOT NULL GROUP BY 1")

def history_classes(d, column, month="collected_at"):
    """(month, class, n): documents by month and class, all values and a row for unknown ones."""
    return d.where(F.col(month).isNotNull()).groupBy(F.trunc(month, "month").alias("month"), F.coalesce(column, F.lit("unknown")).alias("class")).agg(F.count("*").alias("n"))


# history_pivot has the three columns of its SQL; these two have every class
R.add("history_languages", lambda s, d: history_classes(docs(s, d), "lang"), f"SELECT date_trunc('month', collected_at)::DATE AS month, {LANG} AS class, count(*) AS n FROM documents WHERE collected_at IS NOT NULL GROUP BY ALL")
R.add("history_domains", lambda s, d: history_classes(docs(s, d), "domain"), "SELECT date_trunc('month', collected_at)::DATE AS month, coalesce(domain, 'unknown') AS class, count(*) AS n FROM documents WHERE collected_at IS NOT NULL GROUP BY ALL")

QUERIES, SQL = R.queries, R.sql
