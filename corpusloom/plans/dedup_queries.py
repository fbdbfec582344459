"""Queries on duplicates, set operations, profiles and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import dedup as D
from corpusloom.operators import near
from corpusloom.operators.activity import last_delivery
from corpusloom.sources.tables import table

from ._registry import Registry
from .text_queries import N_TOK, TITLE

R = Registry()
NAME = "coalesce(lang, 'unknown')"


def docs(s, d):
    return table(s, d, "documents")


def results(s, d):
    return table(s, d, "extraction_results")


R.add("dedup_exact", lambda s, d: D.exact_groups(docs(s, d), F.md5("text"), "doc_id"), "SELECT md5(text) AS hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
R.add("dedup_sha256", lambda s, d: D.exact_groups(results(s, d), F.col("sha256"), "result_id"), "SELECT sha256 AS hash, count(*) AS n_docs, min(result_id) AS first_doc FROM extraction_results WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
R.add("dedup_title", lambda s, d: D.title_groups(docs(s, d), F.col("title"), F.col("text")), f"SELECT title, count(*) AS n_docs, count(DISTINCT h) AS n_hashes FROM (SELECT {TITLE} AS title, md5(text) AS h FROM documents) WHERE title <> '' GROUP BY title HAVING count(DISTINCT h) > 1")
for policy, order in (("first", "doc_id"), ("largest", "tokens DESC, doc_id")):
    R.add(
        f"dedup_keep_{policy}", lambda s, d, p=policy: D.keep(docs(s, d), "doc_id", "text", p),
        f"SELECT doc_id, md5(text) AS group_md5, text IS NULL OR row_number() OVER (PARTITION BY md5(text) ORDER BY {order}) = 1 AS kept FROM (SELECT *, {N_TOK} AS tokens FROM documents)",
    )
R.add(
    "dedup_annotate", lambda s, d: D.annotate(docs(s, d), "doc_id", "text"),
    f"""WITH t AS (SELECT doc_id, md5(text) AS h, {N_TOK} AS tokens FROM documents WHERE text IS NOT NULL), g AS (SELECT h, min(doc_id) AS k FROM t GROUP BY h HAVING count(*) > 1),
      n AS (SELECT *, row_number() OVER (ORDER BY k) AS no FROM g)
      SELECT doc_id, printf('dg-%03d', no) AS group_id, doc_id = k AS kept, CASE WHEN doc_id <> k THEN k END AS duplicate_of, CASE WHEN doc_id <> k THEN tokens ELSE 0 END AS token_loss FROM t JOIN n USING (h)""",
)
R.add(
    "token_loss", lambda s, d: D.token_loss(docs(s, d), "lang", "doc_id", "text"),
    f"""WITH t AS (SELECT {NAME} AS class, {N_TOK} AS tokens, text IS NULL OR row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS kept FROM documents),
      r AS (SELECT grouping(class) AS g, class, sum(tokens)::BIGINT AS before, sum(CASE WHEN kept THEN tokens ELSE 0 END)::BIGINT AS after FROM t GROUP BY ROLLUP (class))
      SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE class END AS class, before, after, before - after AS lost, round(CASE WHEN before = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (before - after) / before END, 4) AS pct FROM r""",
)
R.add("dedup_confirm", lambda s, d: results(s, d).where("content_hash is not null").groupBy("content_hash").agg(F.countDistinct(F.md5("text")).alias("contents"), F.countDistinct("result_id").alias("records")).where("records > 1"), "SELECT content_hash, count(DISTINCT md5(text)) AS contents, count(DISTINCT result_id) AS records FROM extraction_results WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT result_id) > 1")
R.add("ingest_antijoin", lambda s, d: D.unseen(docs(s, d).where("text is not null"), results(s, d), F.md5("text"), F.md5("text")).select("doc_id"), "SELECT doc_id FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM extraction_results WHERE text IS NOT NULL)")
R.add("title_antijoin", lambda s, d: D.unseen(docs(s, d).where("title is not null"), results(s, d), X.title_norm_simple(F.col("title")), X.title_norm_simple(F.col("title"))).select("doc_id"), r"SELECT doc_id FROM documents WHERE title IS NOT NULL AND trim(regexp_replace(lower(title), '[^\p{L}\p{N}_ ]', '', 'g'), ' ') NOT IN (SELECT trim(regexp_replace(lower(title), '[^\p{L}\p{N}_ ]', '', 'g'), ' ') FROM extraction_results WHERE title IS NOT NULL)")
R.add("title_cache", lambda s, d: table(s, d, "sidecars").where("title is not null").select(F.trim(F.regexp_replace("title", " +", " ")).alias("title")).distinct(), "SELECT DISTINCT trim(regexp_replace(title, ' +', ' ', 'g'), ' ') AS title FROM sidecars WHERE title IS NOT NULL")


def profile(s, d, part):
    return docs(s, d).where(F.pmod("doc_id", F.lit(2)) == part)


def by_lang(df):
    return df.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"), F.sum(X.token_count(F.col("text"))).alias("tokens"), F.countDistinct(F.md5("text")).alias("hashes"))


P = f"SELECT {NAME} AS lang, count(*) AS n, sum({N_TOK})::BIGINT AS tokens, count(DISTINCT md5(text)) AS hashes FROM documents"
R.add("profile", lambda s, d: by_lang(docs(s, d)), f"{P} GROUP BY 1")
# two snapshots of one corpus: even and odd ids stand for the versions, as the tables hold one snapshot only
R.add(
    "profile_diff",
    lambda s, d: by_lang(profile(s, d, 0)).alias("a").join(by_lang(profile(s, d, 1)).alias("b"), "lang", "full_outer").select("lang", F.coalesce("a.n", F.lit(0)).alias("v1"), F.coalesce("b.n", F.lit(0)).alias("v2"), (F.coalesce("b.n", F.lit(0)) - F.coalesce("a.n", F.lit(0))).alias("delta"), (F.coalesce("b.tokens", F.lit(0)) - F.coalesce("a.tokens", F.lit(0))).alias("token_delta")),
    f"SELECT lang, coalesce(a.n, 0) AS v1, coalesce(b.n, 0) AS v2, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, coalesce(b.tokens, 0) - coalesce(a.tokens, 0) AS token_delta FROM ({P} WHERE doc_id % 2 = 0 GROUP BY 1) a FULL JOIN ({P} WHERE doc_id % 2 = 1 GROUP BY 1) b USING (lang)",
)
for name, a, b in (("hashes_added", 1, 0), ("hashes_removed", 0, 1)):
    R.add(name, lambda s, d, a=a, b=b: profile(s, d, a).select(F.md5("text").alias("hash")).where("hash is not null").subtract(profile(s, d, b).select(F.md5("text").alias("hash"))), f"SELECT md5(text) AS hash FROM documents WHERE doc_id % 2 = {a} AND text IS NOT NULL EXCEPT SELECT md5(text) FROM documents WHERE doc_id % 2 = {b}")
R.add("hashes_common", lambda s, d: profile(s, d, 0).select(F.md5("text").alias("hash")).where("hash is not null").intersect(profile(s, d, 1).select(F.md5("text").alias("hash"))), "SELECT md5(text) AS hash FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL INTERSECT SELECT md5(text) FROM documents WHERE doc_id % 2 = 1")
R.add(
    "manifest", lambda s, d: docs(s, d).groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("files"), F.sum(X.token_count(F.col("text"))).alias("tokens"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")),
    f"SELECT coalesce(domain, 'unknown') AS domain, count(*) AS files, sum({N_TOK})::BIGINT AS tokens, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY 1",
)

# metadata of the deliveries: top level, else nested, else default
Q = "quality_metrics"
R.add(
    "metadata_normalize",
    lambda s, d: last_delivery(results(s, d).select("result_id", "ingested_at", F.coalesce("language", f"{Q}.language_confidence.language", F.lit("unknown")).alias("language"), F.coalesce("language_confidence", f"{Q}.language_confidence.language_confidence", F.lit(0.0)).alias("language_confidence"), F.coalesce(F.nullif("token_count", F.lit(0)), f"{Q}.extraction_quality.token_count", F.lit(0)).alias("token_count"), F.coalesce("quality_flag", f"{Q}.extraction_quality.quality_flag", F.lit("unknown")).alias("quality_flag"), F.coalesce(f"{Q}.corruption.corruption_score_normalized", F.lit(100.0)).alias("corruption")), "result_id", "ingested_at").drop("ingested_at"),
    f"""WITH n AS (SELECT result_id, ingested_at, coalesce(language, {Q}.language_confidence.language, 'unknown') AS language, coalesce(language_confidence, {Q}.language_confidence.language_confidence, 0.0) AS language_confidence,
      coalesce(nullif(token_count, 0), {Q}.extraction_quality.token_count, 0) AS token_count, coalesce(quality_flag, {Q}.extraction_quality.quality_flag, 'unknown') AS quality_flag, coalesce({Q}.corruption.corruption_score_normalized, 100.0) AS corruption FROM extraction_results)
      SELECT * EXCLUDE (ingested_at) FROM n QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST, language DESC, language_confidence DESC, token_count DESC, quality_flag DESC, corruption DESC) = 1""",
)
FIELDS = ("title", "language", "domain", "quality_flag", "token_count", "extraction_date")
R.add(
    "metadata_audit", lambda s, d: results(s, d).select(F.explode(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS])).alias("field")).where("field is not null").groupBy("field").agg(F.count("*").alias("missing")),
    " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS missing FROM extraction_results WHERE {f} IS NULL HAVING count(*) > 0" for f in FIELDS),
)
R.add("required_fields", lambda s, d: table(s, d, "sidecars").select("filename", F.array_join(F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in ("domain", "author", "year")])), ",").alias("missing")).where("missing <> ''"), "SELECT filename, missing FROM (SELECT filename, concat_ws(',', CASE WHEN domain IS NULL THEN 'domain' END, CASE WHEN author IS NULL THEN 'author' END, CASE WHEN year IS NULL THEN 'year' END) AS missing FROM sidecars) WHERE missing <> ''")
SIDE = "SELECT lower(filename) AS f, min(title) AS title, max(year) AS year, count(*) AS copies FROM sidecars WHERE filename IS NOT NULL GROUP BY 1"
R.add(
    "sidecar_lookup",
    lambda s, d: results(s, d).select("result_id", F.lower(F.element_at(F.split("file_path", "/"), -1)).alias("f")).distinct().join(table(s, d, "sidecars").where("filename is not null").groupBy(F.lower("filename").alias("f")).agg(F.min("title").alias("title"), F.max("year").alias("year"), F.count("*").alias("copies")), "f", "left").select("result_id", "title", "year", F.coalesce("copies", F.lit(0)).alias("copies")),
    f"SELECT result_id, title, year, coalesce(copies, 0) AS copies FROM (SELECT DISTINCT result_id, lower(string_split(file_path, '/')[-1]) AS f FROM extraction_results) LEFT JOIN ({SIDE}) USING (f)",
)
R.add("metadata_upsert", lambda s, d: docs(s, d).select("doc_id", "result_id", F.nullif("title", F.lit("")).alias("t")).join(results(s, d).groupBy("result_id").agg(F.max("title").alias("new")), "result_id", "left").select("doc_id", F.coalesce("t", "new").alias("title")), "SELECT doc_id, coalesce(nullif(d.title, ''), r.new) AS title FROM documents d LEFT JOIN (SELECT result_id, max(title) AS new FROM extraction_results GROUP BY 1) r USING (result_id)")
R.add("missing_extractions", lambda s, d: table(s, d, "sidecars").where("filename is not null").select(F.lower("filename").alias("f")).distinct().join(results(s, d).select(F.lower(F.element_at(F.split("file_path", "/"), -1)).alias("f")).where("f is not null").distinct(), "f", "left_anti"), "SELECT DISTINCT lower(filename) AS f FROM sidecars WHERE filename IS NOT NULL AND lower(filename) NOT IN (SELECT lower(string_split(file_path, '/')[-1]) FROM extraction_results WHERE file_path IS NOT NULL)")
R.add("token_count_fallback", lambda s, d: results(s, d).groupBy("result_id").agg(F.max(F.coalesce(F.nullif("token_count", F.lit(0)), f"{Q}.extraction_quality.token_count", f"{Q}.word_count", F.lit(0))).alias("tokens")), f"SELECT result_id, max(coalesce(nullif(token_count, 0), {Q}.extraction_quality.token_count, {Q}.word_count, 0)) AS tokens FROM extraction_results GROUP BY 1")
R.add("file_type_detect", lambda s, d: results(s, d).select("result_id", X.file_type(F.col("file_path")).alias("value")).distinct(), r"""SELECT DISTINCT result_id, CASE WHEN e IN ('py', 'js', 'java') THEN 'code' WHEN e = 'ipynb' THEN 'notebook' WHEN e IN ('md', 'markdown') THEN 'markdown' WHEN e IN ('html', 'htm') THEN 'html' WHEN e IN ('json', 'jsonl') THEN 'json' WHEN e IN ('csv', 'tsv') THEN 'table' WHEN e = 'pdf' THEN 'pdf' WHEN e = 'txt' THEN 'text' END AS value
  FROM (SELECT result_id, lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1)) AS e FROM extraction_results)""")
R.add("file_type_filter", lambda s, d: results(s, d).where(F.lower("file_path").rlike(r"\.(md|txt|html)$")).select("result_id").distinct(), r"SELECT DISTINCT result_id FROM extraction_results WHERE regexp_matches(lower(file_path), '\.(md|txt|html)$')")
R.add("format_size", lambda s, d: results(s, d).where("file_size is not null").select("result_id", "file_size", X.format_size(F.col("file_size")).alias("value")).distinct(), "SELECT DISTINCT result_id, file_size, CASE WHEN file_size < 1024 THEN printf('%.2f B', file_size::DOUBLE) WHEN file_size < 1048576 THEN printf('%.2f KB', file_size / 1024.0::DOUBLE) WHEN file_size < 1073741824 THEN printf('%.2f MB', file_size / 1048576.0::DOUBLE) ELSE printf('%.2f GB', file_size / 1073741824.0::DOUBLE) END AS value FROM extraction_results WHERE file_size IS NOT NULL")
R.add("best_extraction", lambda s, d: results(s, d).where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias("n"), "result_id")).getField("result_id").alias("result_id")), "SELECT content_hash, result_id FROM extraction_results WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY coalesce(length(text), 0) DESC, result_id) = 1")
R.add("domain_from_path", lambda s, d: results(s, d).select("result_id", F.coalesce(F.nullif(F.regexp_extract("file_path", "^/corpus/([a-z_]+)/", 1), F.lit("")), F.nullif("directory", F.lit("")), F.lit("unknown")).alias("value")).distinct(), "SELECT DISTINCT result_id, coalesce(nullif(regexp_extract(file_path, '^/corpus/([a-z_]+)/', 1), ''), nullif(directory, ''), 'unknown') AS value FROM extraction_results")
R.add("url_doc_type", lambda s, d: table(s, d, "collectors").select("source", X.cascade(F.col("source"), [("feed", ["feed"]), ("crawl", ["crawl", "scan"]), ("pull", ["pull"])], "other").alias("value")), "SELECT source, CASE WHEN contains(lower(source), 'feed') THEN 'feed' WHEN contains(lower(source), 'crawl') OR contains(lower(source), 'scan') THEN 'crawl' WHEN contains(lower(source), 'pull') THEN 'pull' ELSE 'other' END AS value FROM collectors")
R.add("name_category", lambda s, d: table(s, d, "collectors").groupBy("kind", F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"), F.sum(F.col("enabled").cast("int")).alias("enabled")), "SELECT kind, coalesce(domain, 'unknown') AS domain, count(*) AS n, sum(enabled::INT)::BIGINT AS enabled FROM collectors GROUP BY ALL")
W5 = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
NEAR = f"""WITH r AS (SELECT min(doc_id) AS id, {W5} AS w FROM documents WHERE trim(text, ' ') <> '' GROUP BY text),
  g AS (SELECT DISTINCT id, array_to_string(w[k:k+4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS k FROM r WHERE len(w) >= 5)),
  n AS (SELECT id, count(*) AS n FROM g GROUP BY id), b AS (SELECT a.id AS i, b.id AS j, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
  SELECT i, j, round(c::DOUBLE / (x.n + y.n - c), 6) AS jaccard FROM b JOIN n x ON x.id = i JOIN n y ON y.id = j WHERE round(c::DOUBLE / (x.n + y.n - c), 6) >= 0.8"""
CLASS = "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE trim(text, ' ') <> ''"
R.add("dedup_near_exact", lambda s, d: near.pairs(docs(s, d), "doc_id", "text"), NEAR)
R.add(
    "dedup_near", lambda s, d: near.links(docs(s, d), "doc_id", "text"),
    f"SELECT doc_id, coalesce(links, 0) AS links FROM ({CLASS}) LEFT JOIN (SELECT rep, count(*) AS links FROM (SELECT i AS rep FROM ({NEAR}) UNION ALL SELECT j FROM ({NEAR})) GROUP BY 1) USING (rep)",
)
R.add(
    "dedup_clusters", lambda s, d: near.clusters(docs(s, d), "doc_id", "text").select("doc_id", "cluster"),
    f"""WITH RECURSIVE e AS (SELECT i AS u, j AS v FROM ({NEAR}) UNION SELECT j, i FROM ({NEAR})), c AS (SELECT u AS a, u AS l FROM e UNION SELECT e.u, c.l FROM c JOIN e ON e.v = c.a), m AS (SELECT a AS rep, min(l) AS l FROM c GROUP BY a)
      SELECT doc_id, coalesce(l, rep) AS cluster FROM ({CLASS}) LEFT JOIN m USING (rep)""",
)
R.add("domains_import", lambda s, d: table(s, d, "domain_config").select("domain", "priority").unionByName(table(s, d, "domain_keywords").select("domain", F.lit(None).cast("string").alias("priority")).join(table(s, d, "domain_config").select("domain"), "domain", "left_anti")), "SELECT domain, priority FROM domain_config UNION ALL SELECT domain, NULL FROM domain_keywords WHERE domain NOT IN (SELECT domain FROM domain_config)")

QUERIES, SQL = R.queries, R.sql
