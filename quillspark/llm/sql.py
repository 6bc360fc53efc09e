"""DuckDB SQL for the pN_ queries that SQL can express over whole tables."""

_TOP = """
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank_no, chunk_id, score
FROM (SELECT question_id, f.chunk_id AS chunk_id, max(f.rrf_score) AS score
      FROM (SELECT question_id, unnest(fused) AS f FROM retrieval_results WHERE question_id IS NOT NULL)
      WHERE f.chunk_id IS NOT NULL AND f.rrf_score IS NOT NULL AND NOT isnan(f.rrf_score)
      GROUP BY 1, 2)
QUALIFY rank_no <= 5
"""

SQL = {
    "p2_found": f"SELECT question_id, rank_no, chunk_id FROM ({_TOP})",
    "p2_top_chunks": f"""
WITH top AS ({_TOP}),
said AS (SELECT question_id, run_at, unnest(contexts) AS c FROM retrieval_results WHERE question_id IS NOT NULL),
ctx AS (
  SELECT question_id, c.chunk_id AS chunk_id, c.document_id AS document_id, c.article_number AS article_number, c.text AS context_text,
         row_number() OVER (PARTITION BY question_id, c.chunk_id ORDER BY run_at DESC NULLS LAST, c.text DESC NULLS LAST, c.article_number DESC NULLS LAST, c.document_id DESC NULLS LAST) AS k
  FROM said WHERE c.chunk_id IS NOT NULL)
SELECT question_id, rank_no, chunk_id, score, document_id, article_number, context_text
FROM top LEFT JOIN (SELECT * EXCLUDE (k) FROM ctx WHERE k = 1) USING (question_id, chunk_id)
""",
    "p7_kept": r"""
WITH d AS (SELECT lower(regexp_replace(source, '^[\s\x{85}\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{85}\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g')) AS source FROM documents),
n AS (SELECT source, count(*) AS n FROM d WHERE source <> '' GROUP BY 1)
SELECT coalesce(n.source, t.source) AS source, coalesce(n, 0) AS n_documents, true AS within_limit, true AS meets_plan, coalesce(target_share, 0) > 0 AS has_target
FROM n FULL JOIN (SELECT lower(trim(source)) AS source, target_share FROM mix_targets) t ON t.source = n.source
""",
    "p3_found": r"""
SELECT DISTINCT chunk_id FROM legal_chunks
WHERE length(text) > 1200
   OR (length(text) > 500 AND length(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 250)
""",
}
