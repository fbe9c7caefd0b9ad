"""The queries and SQL of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, divergence, fingerprints, license_scan, mixing, neighbours, ngram_join, packing, pii, quality_classifier, token_counts, tool_calls
from .common import table
from .quality_rules import quality_rules


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.license_scan(table(spark, sf_dir, "documents")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.chat_calls(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scans, op2_chat_formatting, op3_packing, op4_ngram_join, op5_token_counts, op6_mixing, op7_quality_rules, op8_quality_classifier, op9_nearest_neighbours, op10_pii, op11_collocations, op12_source_divergence, op13_fingerprints)
}

ORACLE_SQL: dict[str, str] = {
    "op11_collocations": collocations.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_fingerprints": fingerprints.SQL,
    "op2_chat_formatting": r"""
WITH RECURSIVE asks AS (
  SELECT conv_id, turn, role = 'user' AS is_user, text, (((conv_id % 20) * 7 + turn % 20) % 20 + 20) % 20 AS kind, coalesce(to_json(text)::VARCHAR, 'null') AS said
  FROM conversations WHERE role IN ('user', 'system') AND turn IS NOT NULL AND conv_id IS NOT NULL
), made AS (
  SELECT *, CASE WHEN is_user THEN 'answer' ELSE 'configure' END AS name,
    CASE WHEN kind = 6 THEN 'not JSON: ' || coalesce(text, '') WHEN is_user THEN '{' || CASE kind WHEN 0 THEN '' WHEN 1 THEN '"turn":"' || turn || '",' WHEN 5 THEN '"turn":' || turn || '.0,' ELSE '"turn":' || turn || ',' END
      || '"prompt":' || said || CASE kind WHEN 2 THEN ',"mood":true}' ELSE '}' END
      ELSE CASE kind WHEN 0 THEN '{}' WHEN 1 THEN '{"rules":' || turn || '}' WHEN 2 THEN '{"rules":' || said || ',"mood":true}' ELSE '{"rules":' || said || '}' END END AS arguments,
    CASE WHEN kind = 6 THEN 'null' WHEN is_user THEN '{' || CASE kind WHEN 2 THEN '"mood":true,' ELSE '' END || '"prompt":' || said || CASE kind WHEN 0 THEN '}' WHEN 1 THEN ',"turn":"' || turn || '"}' ELSE ',"turn":' || turn || '}' END
      ELSE CASE kind WHEN 0 THEN '{}' WHEN 1 THEN '{"rules":' || turn || '}' WHEN 2 THEN '{"mood":true,"rules":' || said || '}' ELSE '{"rules":' || said || '}' END END AS canonical
  FROM asks
), numbered AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n_copies, row_number() OVER (PARTITION BY conv_id, turn ORDER BY name, arguments) AS k FROM made
), calls AS (
  SELECT conv_id, turn, name, text, kind, canonical, n_copies FROM numbered WHERE k = 1
), needs AS (
  SELECT a.conv_id, a.turn, b.turn AS needed FROM calls a JOIN calls b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)
), blocked AS (
  SELECT conv_id, turn FROM calls WHERE kind IN (3, 4)
  UNION
  SELECT n.conv_id, n.turn FROM blocked x JOIN needs n ON n.conv_id = x.conv_id AND n.needed = x.turn
), walks AS (
  SELECT conv_id, turn, 0 AS level FROM calls
  UNION
  SELECT n.conv_id, n.turn, w.level + 1 FROM walks w JOIN needs n ON n.conv_id = w.conv_id AND n.needed = w.turn
), leveled AS (
  SELECT conv_id, turn, max(level)::BIGINT AS level FROM walks ANTI JOIN blocked USING (conv_id, turn) GROUP BY conv_id, turn
), placed AS (
  SELECT c.conv_id, c.turn, l.level, row_number() OVER (PARTITION BY c.conv_id ORDER BY l.level, c.turn) - 1 AS place FROM calls c JOIN leveled l USING (conv_id, turn)
), ids AS (
  SELECT conv_id, turn, 'call_' || needed AS id FROM needs
  UNION SELECT conv_id, turn, 'call_missing' FROM calls WHERE kind = 3
  UNION SELECT conv_id, turn, 'call_' || turn FROM calls WHERE kind = 4
), lists AS (
  SELECT conv_id, turn, string_agg('"' || id || '"', ',' ORDER BY id) AS l FROM ids GROUP BY conv_id, turn
), answered AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM conversations
  WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id, turn - 1
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'call_' || coalesce(c.turn, r.turn) AS call_id,
  CASE WHEN c.turn IS NULL THEN 'orphan_result' WHEN r.turn IS NULL THEN 'no_result' WHEN p.level IS NULL THEN 'blocked' ELSE 'linked' END AS status,
  p.level AS level, p.place AS place,
  CASE WHEN c.turn IS NOT NULL THEN CASE WHEN kind IN (0, 1, 2, 6) THEN false ELSE c.text IS NOT NULL END END AS valid,
  coalesce(c.n_copies, 0)::BIGINT AS n_copies, coalesce(r.n_results, 0)::BIGINT AS n_results,
  CASE WHEN c.turn IS NOT NULL THEN '{"arguments":' || c.canonical || ',"depends_on":[' || coalesce(x.l, '') || '],"id":"call_' || c.turn || '","name":"' || c.name || '","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' END AS line
FROM calls c FULL JOIN answered r ON c.conv_id = r.conv_id AND c.turn = r.turn
LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN lists x ON x.conv_id = c.conv_id AND x.turn = c.turn
UNION ALL
SELECT conv_id, 'turn_' || turn, 'not_a_call', NULL, NULL, NULL, count(*)::BIGINT, 0::BIGINT, NULL FROM conversations
WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND coalesce(role NOT IN ('user', 'system', 'assistant'), true) GROUP BY conv_id, turn
""",
    "op4_ngram_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split
), distinct_sets AS (
  SELECT min(doc_id) AS sid, count(*) AS copies, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), tokens AS (
  SELECT sid, len(s) AS n, unnest(s) AS t FROM distinct_sets
), common AS (
  SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.sid != b.sid GROUP BY a.sid, b.sid
), links AS (
  SELECT a, b FROM common WHERE i * 10 >= 8 * (na + nb - i)
), reached AS (
  SELECT sid AS node, sid AS root FROM distinct_sets
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node
), classes AS (
  SELECT node AS sid, min(root) AS class_id FROM reached GROUP BY node
), counted AS (
  SELECT d.sid, d.copies - 1 + coalesce(sum(o.copies), 0) AS n_links
  FROM distinct_sets d LEFT JOIN links l ON l.a = d.sid LEFT JOIN distinct_sets o ON o.sid = l.b GROUP BY d.sid, d.copies
)
SELECT x.doc_id, coalesce(c.class_id, x.doc_id) AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM sets x LEFT JOIN distinct_sets d ON list_sort(x.s) = d.s LEFT JOIN classes c ON c.sid = d.sid LEFT JOIN counted k ON k.sid = d.sid
""",
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', 'mix', doc_id::VARCHAR, md5(text))) AS h FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM by_source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS n FROM weighted
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - coalesce(sum(2 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT, 0))
    / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), chosen AS (
  SELECT *, (SELECT level FROM levels WHERE level <= 2 * source_size / weight ORDER BY n LIMIT 1) AS found FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN found IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, found * weight) END AS target FROM chosen
), served AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(greatest(floor(target)::BIGINT - (upto - size), 0), size) + least(greatest(floor(target)::BIGINT - source_size - (upto - size), 0), size))::BIGINT AS taken
FROM served
""",
}
