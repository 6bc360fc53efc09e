"""DuckDB SQL of the queries for sources, sinks, state and audits. Every statement runs over whole tables."""

from quillspark.sql import _ANSWERED, _CANDIDATES, _CHUNKS, _FUSED, _HITS, _PROMPT, _SUBSTRING, _WS_JAVA, SQL as _CORE, _norm

_VISIBLE = f"'[^' || substr('{_WS_JAVA}', 2)"
_BLANK = lambda x: f"({x} IS NULL OR NOT regexp_matches({x}, {_VISIBLE}))"
_WORDS = lambda x: f"len(regexp_extract_all({x}, {_VISIBLE} || '+'))"
_PLAN = "SELECT question_id AS query, row_number() OVER (ORDER BY question_id) - 1 AS position FROM (SELECT DISTINCT question_id FROM training_records WHERE question_id IS NOT NULL)"
_RECORDS = "SELECT question_id AS query, CASE WHEN count(*) > 40 THEN 'oom' WHEN count(*) > 6 THEN 'length' ELSE 'eos' END AS finish_reason FROM retrieval_results WHERE question_id IS NOT NULL GROUP BY 1"
_CONTEXTS = """
SELECT CAST(result_id AS VARCHAR) AS row_id, min(question_id) AS question, arg_min(list_transform(contexts, lambda x: coalesce(x.text, '')), ingested_at) AS c
FROM retrieval_results WHERE question_id IS NOT NULL AND len(contexts) > 0 GROUP BY result_id HAVING c IS NOT NULL
"""


def _greedy(budget: int) -> str:
    """Contexts kept whole: a fold over their words; the frame has four words and the question's, each context one for its number."""
    return f"""
    SELECT row_id, question, c, frame, list_reduce(list_prepend({{'used': frame, 'kept': CAST([] AS VARCHAR[]), 'i': 0::BIGINT, 'w': 0::BIGINT}},
        list_transform(c, lambda x, i: {{'used': 0::BIGINT, 'kept': CAST([] AS VARCHAR[]), 'i': i::BIGINT, 'w': ({_WORDS('x')} + 1)::BIGINT}})),
        lambda a, b: CASE WHEN a.used + b.w <= {budget} THEN {{'used': a.used + b.w, 'kept': list_append(a.kept, CAST(b.i - 1 AS VARCHAR)), 'i': b.i, 'w': b.w}} ELSE {{'used': a.used, 'kept': a.kept, 'i': b.i, 'w': b.w}} END) AS r
    FROM (SELECT row_id, question, c, (4 + {_WORDS('question')})::BIGINT AS frame FROM ({_CONTEXTS}))"""


_RANKINGS = f"""
SELECT branch AS system, query, id, rank FROM ({_HITS}) UNION ALL SELECT 'fused', query, id, rank FROM ({_FUSED}) WHERE rank <= 10
"""
_DONE = f"SELECT p.query, p.position, r.finish_reason FROM ({_PLAN}) p LEFT JOIN ({_RECORDS}) r USING (query)"

SQL: dict[str, str] = {
    "sk03_json_lines": "SELECT doc_id, source_title, lang, sha256(text) AS text_sha256 FROM documents",
    "sc07_chunk_lines": f"SELECT chunk_id, document_id, article_number, array_to_string(clause_numbers, ',') AS clauses, chunk_index, start_char, sha256(text) AS text_sha256 FROM ({_CHUNKS})",
    "sc06_questions": f"SELECT CAST(record_id AS VARCHAR) AS question_id, sha256(question) AS question_sha256, sha256(answer) AS answer_sha256 FROM ({_ANSWERED}) WHERE NOT {_BLANK('question')}",
    "sc01_archives": r"SELECT document_id, nullif(trim(source_title), '') AS source_title, trim(source_url) AS source_url, sha256(text) AS text_sha256, 'context_' || document_id || '.json' AS source_name FROM documents WHERE text IS NOT NULL AND regexp_matches(source_url, '^(?i:https)://[^/?#\s]+')",
    "ss06_upsert": "SELECT event_id, event_type, round(value, 6) AS value FROM events",
    "ss06_stream_windows": _CORE["ss_event_windows"],
    "sc12_registry": "SELECT DISTINCT regexp_replace(trim(source_url), '/+$', '') AS url FROM documents WHERE source_url IS NOT NULL",
    "sc13_vectors": "SELECT vec_id, len(embedding)::INTEGER AS n, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
    "sc08_selected": """
        SELECT document_id, source_title, n_chars FROM documents WHERE document_id IN (
          SELECT c.document_id FROM (SELECT question_id, unnest(contexts) AS c FROM retrieval_results) WHERE question_id IN (SELECT question_id FROM training_records WHERE lang = 'en'))""",
    "sc09_chunks_by_document": f"""
        SELECT document_id, count(*)::INTEGER AS n_chunks, sha256(string_agg(chunk_id, chr(10) ORDER BY chunk_index, chunk_id)) AS ids_sha256
        FROM ({_CHUNKS}) WHERE document_id IN (SELECT document_id FROM documents WHERE lang = 'en') GROUP BY 1""",
    "sc14_fetch_ordered": f"SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS rank, length(text)::INTEGER AS n_chars FROM ({_CHUNKS})",
    "sc05_file_hashes": "SELECT n_nationkey, length(n_name) + 1 AS length, sha256(n_name || chr(10)) AS sha256 FROM nation",
    "sc15_artifacts": "SELECT n_name AS name, sha256(n_name || chr(10)) AS sha256, n_nationkey FROM nation WHERE n_regionkey < 3",
    "sk10_bundle": "SELECT 'nations/' || n_nationkey || '.txt' AS name, n_name AS content FROM nation",
    "sk04_published": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "sk06_split_manifest": "SELECT split, count(*) AS n, count(DISTINCT record_id) AS n_ids FROM training_records WHERE split IS NOT NULL GROUP BY 1",
    "sk01_stored_index": _CORE["jn01_bm25_postings"],
    "sk02_trigram_search": _SUBSTRING,
    "rt22_training_gates": "SELECT " + ", ".join(f"true AS {g}" for g in "count unique_queries ordered_ids within_budget labels_align mask_aligns prompt_ignored answer_kept answer_not_empty answer_complete input_is_prompt_and_answer no_reference_fields exact_provenance seeds_as_retrieved answer_blind prompt_hashes_hold hashes_hold records_as_stored has_evidence seeds_kept mean_prompt retention settings_agree passed".split()),
    "rt14_kept": f"SELECT query AS question_id, CAST(count(*) AS INTEGER) AS n_hits, true AS fits FROM ({_CANDIDATES}) JOIN documents USING (document_id) WHERE rank <= 12 GROUP BY 1",
    "sk07_submission": f"SELECT CAST(record_id AS VARCHAR) AS question_id, sha256(answer) AS answer_sha256 FROM ({_ANSWERED}) WHERE NOT {_BLANK('answer')}",
    "sk05_encoded": f"SELECT chunk_id, round(a / sqrt(a * a + b * b), 6) AS a, round(b / sqrt(a * a + b * b), 6) AS b FROM (SELECT chunk_id, length(text)::DOUBLE AS a, len(string_split(text, ' '))::DOUBLE AS b FROM ({_CHUNKS}) WHERE text IS NOT NULL)",
    "ss02_resumed_run": "SELECT item_id AS query, length(upper(text))::INTEGER AS n_chars, CASE WHEN length(text) < 200 THEN 'eos' ELSE 'length' END AS finish_reason FROM eval_items WHERE text IS NOT NULL",
    "ss03_deadline": "SELECT least(count(*), 7) AS n, least(count(*), 7) AS n_queries, count(*) <= 7 AS complete FROM eval_items WHERE text IS NOT NULL",
    "ss01_contiguous": f"SELECT * FROM ({_DONE}) WHERE position < coalesce((SELECT min(position) FROM ({_DONE}) WHERE finish_reason IS NULL), 1000000000000)",
    "ss04_worker_status": f"""
        WITH w AS (SELECT CAST(position % 4 AS INTEGER) AS worker, count(*) AS assigned, count(finish_reason) AS done, count(*) FILTER (WHERE finish_reason = 'oom') AS oom FROM ({_DONE}) GROUP BY 1)
        SELECT worker, assigned, done - oom AS completed, CASE WHEN oom > 0 THEN 'oom' WHEN done = assigned THEN 'complete' ELSE 'stopped' END AS status, oom AS rerouted FROM w""",
    "ss05_second_pass": f"SELECT query, query AS prompt FROM ({_DONE}) WHERE finish_reason IN ('length', 'oom') AND position % 2 = 0",
    "ss07_imported": f"SELECT query, CASE WHEN finish_reason = 'eos' THEN 'done' ELSE 'left' END AS state FROM ({_DONE})",
    "pf07_route": f"SELECT item_id, {_WORDS('text')}::INTEGER AS n, CASE WHEN {_WORDS('text')} <= 100 THEN 'short' ELSE 'long' END AS route FROM eval_items",
    "rt09_reranked": f"""
        WITH h AS (SELECT f.query, f.id, f.rank, length(c.text) AS n FROM ({_FUSED}) f JOIN ({_CHUNKS}) c ON c.chunk_id = f.id WHERE f.rank <= 20 AND c.text IS NOT NULL)
        SELECT query AS question_id, id AS chunk_id, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS old_rank, CAST(row_number() OVER (PARTITION BY query ORDER BY n, rank, id) AS INTEGER) AS new_rank FROM h QUALIFY new_rank <= 12""",
    "rt08_compared": f"""
        WITH rel AS (SELECT DISTINCT question_id AS query, c.chunk_id AS id FROM (SELECT question_id, unnest(contexts) AS c FROM retrieval_results WHERE question_id IS NOT NULL) WHERE c.chunk_id IS NOT NULL),
        n AS (SELECT query, count(*) AS n FROM rel GROUP BY 1), r AS ({_RANKINGS}),
        p AS (SELECT system, query, count(DISTINCT id) AS found, min(rank) AS best FROM r JOIN rel USING (query, id) WHERE rank <= 10 GROUP BY 1, 2)
        SELECT s.system, count(*) AS n_queries, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS hit_rate, round(avg(coalesce(found / n.n::DOUBLE, 0)), 9) AS recall, round(avg(coalesce(1.0::DOUBLE / best, 0)), 9) AS reciprocal_rank
        FROM n CROSS JOIN (SELECT DISTINCT system FROM r) s LEFT JOIN p ON p.system = s.system AND p.query = n.query GROUP BY 1""",
    "ag28_order_changes": """
        WITH f AS (SELECT list_transform(fused, lambda x: x.chunk_id) AS b, list_transform(list_sort(list_transform(fused, lambda x: {'s': -x.rrf_score, 'id': x.chunk_id})), lambda x: x.id) AS a
                   FROM retrieval_results WHERE len(fused) > 0 AND len(list_filter(fused, lambda x: x IS NULL OR x.chunk_id IS NULL OR x.rrf_score IS NULL OR isnan(x.rrf_score))) = 0)
        SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS n_changed, count(*) FILTER (WHERE a[1] <> b[1]) AS n_top_changed, round(avg((a <> b)::INTEGER), 9) AS rate_changed FROM f""",
    "rt15_whole_contexts": f"SELECT row_id, CAST(r.used AS INTEGER) AS n_tokens, array_to_string(r.kept, ',') AS kept, {_PROMPT('list_transform(r.kept, lambda k: c[k::INTEGER + 1])', 'question')} AS prompt_sha256 FROM ({_greedy(300)})",
    "rt31_context_prefix": f"SELECT row_id, array_to_string(r.kept, ',') AS kept, CASE WHEN len(r.kept) > 0 THEN r.used ELSE frame END <= 60 AS fits, len(r.kept) = 0 AND frame + 1 < 60 AND length(c[1]) > 0 AS is_cut FROM ({_greedy(60)})",
    "st05_merged_shards": "SELECT question_id, CAST((row_number() OVER (ORDER BY question_id) - 1) % 3 AS INTEGER) AS shard, n FROM (SELECT question_id, count(*) AS n FROM training_records WHERE split = 'public' AND question_id IS NOT NULL GROUP BY 1)",
    "st06_differences": """
        SELECT coalesce(d.source, t.source) AS source, CASE WHEN t.source IS NULL THEN 'left' ELSE 'right' END AS side
        FROM (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE source <> '') d FULL JOIN (SELECT DISTINCT lower(trim(source)) AS source FROM mix_targets WHERE source IS NOT NULL) t ON d.source = t.source
        WHERE d.source IS NULL OR t.source IS NULL""",
    "dq02_manifest": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, {n} AS n_columns, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k, n in (("documents", "doc_id", 15), ("training_records", "record_id", 8), ("retrieval_results", "result_id", 8), ("eval_items", "item_id", 5), ("legal_chunks", "chunk_id", 16))),
    "dq02_violations": """
        WITH o AS (SELECT count(*) AS n, count(DISTINCT record_id) AS k FROM training_records WHERE split IS NULL OR split <> 'dev'), f AS (SELECT count(*) AS n, count(DISTINCT record_id) AS k FROM training_records)
        SELECT 'records' AS name, 'n_rows' AS field, CAST(o.n AS VARCHAR) AS stored, CAST(f.n AS VARCHAR) AS found FROM o, f UNION ALL SELECT 'records', 'n_keys', CAST(o.k AS VARCHAR), CAST(f.k AS VARCHAR) FROM o, f
        UNION ALL SELECT 'records', 'sha256', NULL, NULL UNION ALL SELECT 'gone', 'sha256', NULL, NULL UNION ALL SELECT 'gone', 'n_columns', '8', NULL
        UNION ALL SELECT 'gone', 'n_rows', CAST(n AS VARCHAR), NULL FROM f UNION ALL SELECT 'gone', 'n_keys', CAST(k AS VARCHAR), NULL FROM f""",
    "dq03_submission": f"SELECT record_id, CAST(length(min(answer)) AS INTEGER) AS n_chars FROM ({_ANSWERED}) WHERE NOT {_BLANK('answer')} GROUP BY 1",
    "dq01_identity": "SELECT count(*) AS members, true AS hashed FROM documents",
    "pf10_forbidden_fields": "SELECT unnest(['fused.chunk_id', 'contexts.chunk_id', 'contexts.text']) AS path",
    "ag05_group_members": f"""
        WITH r AS (SELECT {_norm('question')} AS "group", record_id AS key, {_norm('answer')} AS a FROM ({_ANSWERED})),
        g AS (SELECT "group", count(*) AS n_rows, count(DISTINCT a) AS n_values FROM r WHERE "group" IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        SELECT "group", CAST(row_number() OVER (PARTITION BY "group" ORDER BY key) AS INTEGER) AS position, key, n_rows, n_values FROM r JOIN g USING ("group")""",
    "jn08_triggered": f"""
        SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN 'question' ELSE 'evidence' END AS origin FROM ({_CHUNKS}) c WHERE start_char IS NOT NULL AND end_char IS NOT NULL
          AND (chunk_index % 2 = 0 OR (start_char >= 0 AND end_char <= 2000 AND document_id IN (SELECT document_id FROM documents WHERE lang = 'vi')))""",
    "jn11_positions": f"""
        WITH a AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS expected FROM (SELECT DISTINCT question_id FROM training_records WHERE question_id IS NOT NULL)),
        b AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS found FROM (SELECT DISTINCT question_id FROM ({_ANSWERED}) WHERE question_id IS NOT NULL))
        SELECT question_id, expected, found FROM a FULL JOIN b USING (question_id) WHERE expected IS DISTINCT FROM found""",
    "jn15_binding": "SELECT record_id FROM training_records WHERE question IS NOT NULL AND split IN ('dev', 'public')",
    "ag13_rollup": f"""
        SELECT source, count(*) AS n, round(avg(length(answer)), 6) AS chars, round(avg(length(question)), 6) AS asked, count(*) FILTER (WHERE contains(answer, 'Điều')) AS n_cites, round(avg(contains(answer, 'Điều')::INTEGER), 9) AS cites_rate
        FROM ({_ANSWERED}) GROUP BY 1""",
    "ag21_budget": """
        SELECT CAST(n_regionkey AS VARCHAR) AS stack, sum(CASE WHEN n_nationkey <> 7 THEN n_nationkey * 1.5::DOUBLE END) AS parameters, count(*) FILTER (WHERE n_nationkey <> 7) AS n_known,
          count(*) FILTER (WHERE n_nationkey <> 7) = count(*) AND sum(CASE WHEN n_nationkey <> 7 THEN n_nationkey * 1.5::DOUBLE END) <= 90 AS valid FROM nation GROUP BY 1""",
    "ag24_record_hashes": """
        SELECT record_id, sha256('{"record_id":' || record_id || ',"source":' || coalesce('"' || source || '"', 'null') || ',"split":' || coalesce('"' || split || '"', 'null') || '}') AS record_sha256 FROM training_records""",
    "ag29_lengths": f"SELECT count(*) AS n, round(avg(w), 6) AS mean_length, min(w)::INTEGER AS min_length, max(w)::INTEGER AS max_length FROM (SELECT {_WORDS('answer')} AS w FROM ({_ANSWERED}))",
    "tx23_upper_headings": r"""
        SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(cleaned_text, chr(10))) AS line FROM documents)
        WHERE len(regexp_extract_all(line, '\p{L}')) >= 12 AND len(regexp_extract_all(line, '\p{Lu}')) >= 0.9 * len(regexp_extract_all(line, '\p{L}')) GROUP BY 1""",
    "tx41_finish_reasons": f"SELECT record_id, CASE WHEN ends_with(answer, '.') THEN 'eos' WHEN {_WORDS('answer')} >= 20 THEN 'length' ELSE 'other' END AS reason FROM ({_ANSWERED})",
    "tx42_label_masks": f"""
        SELECT record_id, array_to_string(list_concat(list_transform(list_filter(string_split(question, ' '), lambda x: x <> ''), lambda x: '-100'),
          list_transform(list_filter(string_split(answer, ' '), lambda x: x <> ''), lambda x: CAST(length(x) AS VARCHAR))), ' ') AS labels FROM ({_ANSWERED}) WHERE question IS NOT NULL""",
    "tx43_https": r"SELECT doc_id, coalesce(regexp_matches(source_url, '^(?i:https)://[^/?#\s]+'), false) AS is_https FROM documents",
    "rt30_variants": f"""
        WITH a AS (SELECT record_id, answer FROM ({_ANSWERED})), v AS (SELECT 'as_is' AS variant, record_id, answer, answer AS d FROM a UNION ALL SELECT 'first_line', record_id, answer, string_split(answer, chr(10))[1] FROM a UNION ALL SELECT 'bare', record_id, answer, trim(answer, ' ') FROM a)
        SELECT variant, record_id, d IS DISTINCT FROM answer AS changed, CAST(length(d) AS INTEGER) AS n_chars FROM v""",
    "sc10_extracted_numbers": f"""
        WITH n AS (SELECT document_id, source_number AS number FROM ({_CORE['tx14_source_numbers']}) JOIN documents USING (doc_id) WHERE source_number IS NOT NULL)
        SELECT number, count(*) AS n_documents, min(document_id) AS first_document, count(*) = 1 AS resolved FROM n GROUP BY 1""",
    "rt_chunk_cover": f"SELECT document_id, true AS exact, true AS fits, true AS covered FROM documents WHERE NOT {_BLANK('cleaned_text')}",
    "rt29_model_chunks": f"SELECT document_id, true AS exact, true AS fits, true AS covered FROM documents WHERE NOT {_BLANK('cleaned_text')}",
}
