"""Queries pN_... of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import table

from . import dup, garble, language, leak, mix, prose, scan, subject, tokenize, unify

Query = Callable[[SparkSession, str], DataFrame]


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "collectors").groupBy(F.lower("source").alias("host")).agg(F.max("kind").alias("kind"))


def queries() -> dict[str, Query]:
    t = table
    return {
        "p1_found": lambda s, d: mix.found(t(s, d, "extraction_results"), t(s, d, "domain_config")),
        "p1_mix": lambda s, d: mix.report(t(s, d, "extraction_results"), t(s, d, "domain_config")),
        "p1_draw": lambda s, d: mix.draw(t(s, d, "extraction_results"), t(s, d, "domain_config")),
        "p2_found": lambda s, d: garble.found(t(s, d, "extraction_results")),
        "p2_repair": lambda s, d: garble.repair(t(s, d, "extraction_results")),
        "p3_found": lambda s, d: language.found(t(s, d, "extraction_results"), _hosts(s, d), t(s, d, "quality_config")),
        "p3_languages": lambda s, d: language.classify(t(s, d, "extraction_results"), _hosts(s, d)),
        "p4_found": lambda s, d: dup.found(t(s, d, "extraction_results")),
        "p4_groups": lambda s, d: dup.groups(t(s, d, "extraction_results")),
        "p5_found": lambda s, d: subject.found(t(s, d, "extraction_results"), t(s, d, "domain_keywords")),
        "p5_composition": lambda s, d: subject.composition(t(s, d, "extraction_results"), t(s, d, "domain_keywords")),
        "p6_found": lambda s, d: scan.found(t(s, d, "extraction_results")),
        "p6_repair": lambda s, d: scan.repair(t(s, d, "extraction_results")),
        "p7_found": lambda s, d: prose.found(t(s, d, "extraction_results")),
        "p7_statistics": lambda s, d: prose.assess(t(s, d, "extraction_results")),
        "p8_ids": lambda s, d: tokenize.encode_corpus(t(s, d, "documents")),
        "p8_roundtrip": lambda s, d: tokenize.decode_corpus(tokenize.encode_corpus(t(s, d, "documents"))),
        "p9_found": lambda s, d: leak.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_leaks": lambda s, d: leak.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p10_found": lambda s, d: unify.found(t(s, d, "documents")),
        "p10_unify": lambda s, d: unify.unify(t(s, d, "documents")),
    }


_USABLE = r"""
light AS (
  SELECT result_id, ingested_at, regexp_replace(lower(trim(domain, ' ')), '[ -]', '_', 'g') AS key,
         CASE WHEN regexp_matches(text, '[^\s\p{Z}\x0B\x{85}]') THEN length(text) END AS chars
  FROM extraction_results),
lastrow AS (
  SELECT result_id, key, chars FROM light
  QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST, key DESC NULLS LAST, chars DESC NULLS LAST) = 1),
cfg AS (
  SELECT domain, regexp_replace(lower(trim(domain, ' ')), '[ -]', '_', 'g') AS key,
         coalesce(target_weight, 0.0)::DOUBLE AS w, coalesce(max_repeats, 1) AS max_repeats FROM domain_config),
usable AS (SELECT l.result_id, c.domain, l.chars FROM lastrow l JOIN cfg c USING (key) WHERE l.chars IS NOT NULL),
sums AS (
  SELECT c.domain, c.w, c.max_repeats, count(u.result_id) AS records, coalesce(sum(u.chars), 0)::BIGINT AS chars
  FROM cfg c LEFT JOIN usable u USING (domain) GROUP BY ALL),
caps AS (
  SELECT *, (chars * max_repeats)::DOUBLE AS cap, sum(w) OVER () AS w_all, (sum(chars) OVER ())::DOUBLE AS total FROM sums),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER o, 0.0) AS cap_before, coalesce(sum(w) OVER o, 0.0) AS w_before FROM caps
  WINDOW o AS (ORDER BY (w = 0), cap / nullif(w, 0), domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, (w > 0 AND cap * (w_all - w_before) < w * (total - cap_before)) AS full_ FROM ordered),
levels AS (
  SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0.0 END) OVER () AS cap_full, sum(CASE WHEN full_ THEN w ELSE 0.0 END) OVER () AS w_full FROM filled),
plan AS (
  SELECT *, w / nullif(w_all, 0) AS target_share, cap < w * total / nullif(w_all, 0) AS short,
         least(cap, CASE WHEN full_ THEN cap ELSE coalesce(w * (total - cap_full) / nullif(w_all - w_full, 0), 0.0) END) AS given FROM levels),
epochs AS (SELECT *, coalesce(given / nullif(chars::DOUBLE, 0), 0.0) AS epochs FROM plan),
draws AS (
  SELECT u.result_id, u.domain, u.chars,
         (floor(e.epochs) + CASE WHEN ('0x' || substr(md5('7:' || u.result_id), 1, 13))::BIGINT / 4503599627370496.0 < e.epochs - floor(e.epochs) THEN 1 ELSE 0 END)::INT AS repeats
  FROM usable u JOIN epochs e USING (domain))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_USABLE} SELECT domain FROM plan WHERE short",
        "p1_draw": f"WITH {_USABLE} SELECT result_id, domain, chars, repeats FROM draws",
        "p1_mix": f"""WITH {_USABLE}, got AS (SELECT domain, sum(chars * repeats) AS m FROM draws GROUP BY domain)
            SELECT e.domain, e.records, e.chars, round(target_share, 6) AS target_share, round(given, 4) AS planned_chars, round(epochs, 6) AS epochs,
              coalesce(m, 0)::BIGINT AS mixed_chars, round(coalesce(m, 0)::DOUBLE / nullif(sum(coalesce(m, 0)) OVER (), 0), 6) AS actual_share,
              coalesce(short, false) AS short, e.records < coalesce((SELECT max(min_documents) FROM domain_config c WHERE c.domain = e.domain), 0) AS too_few
            FROM epochs e LEFT JOIN got USING (domain)""",
        "p9_found": r"""
            WITH w AS (SELECT 'd' AS k, doc_id AS id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\pL\pN\s]', '', 'g'), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
              UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\pL\pN\s]', '', 'g'), '\s+'), lambda x: x <> '') FROM eval_items WHERE text IS NOT NULL),
            g AS (SELECT DISTINCT k, id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT k, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
            n AS (SELECT id, count(*) AS n FROM g WHERE k = 'i' GROUP BY id)
            SELECT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.s = i.s AND d.k = 'd' AND i.k = 'i' JOIN n ON n.id = i.id
            GROUP BY d.id, i.id, n.n HAVING count(*) * 3 >= n.n""",
        "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
