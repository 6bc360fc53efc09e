"""DuckDB SQL of the core queries that SQL can express. Every statement runs over whole tables."""

_CHUNKS = "SELECT * FROM legal_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_index) = 1"
_PLACED = f"SELECT * FROM ({_CHUNKS}) WHERE end_char - start_char = length(text)"
_ANSWERED = "SELECT * FROM training_records WHERE coalesce(split, '') NOT IN ('public', 'private') AND answer IS NOT NULL"
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS_JAVA = r"[\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS_JAVA}+', ' ', 'g'))"


def _norm(x: str) -> str:
    # NFC, case folded (DuckDB has no full folding; of what differs from lower case only ß occurs in questions), blanks as Unicode has them
    return f"trim(regexp_replace(replace(lower(nfc_normalize({x})), 'ß', 'ss'), '{_WS}+', ' ', 'g'))"


# Marks that take room stay where accents go: they are moved out of the way meanwhile.
_SPACING_MARKS = "".join(chr(i) for i in (0x903, 0x93B, *range(0x93E, 0x941), *range(0x949, 0x94D), 0x94E, 0x94F))
_ASIDE = "".join(chr(0xE000 + i) for i in range(len(_SPACING_MARKS)))


def _fold(x: str) -> str:
    """NFC, lower case, no accents, d for đ, blanks squeezed."""
    bare = f"translate(strip_accents(translate(lower(nfc_normalize({x})), '{_SPACING_MARKS}', '{_ASIDE}')), '{_ASIDE}', '{_SPACING_MARKS}')"
    return f"trim(regexp_replace(replace({bare}, 'đ', 'd'), '{_WS}+', ' ', 'g'))"


_HITS = """
SELECT query, branch, id, min(rank) AS rank FROM (
  SELECT query, f.chunk_id AS id, unnest(map_keys(f.branch_ranks)) AS branch, unnest(map_values(f.branch_ranks)) AS rank
  FROM (SELECT question_id AS query, unnest(fused) AS f FROM retrieval_results WHERE question_id IS NOT NULL))
WHERE id IS NOT NULL AND rank IS NOT NULL GROUP BY ALL
"""


def _part(branch: str, weight: float) -> str:
    return f"sum(CASE WHEN branch = '{branch}' THEN {weight}::DOUBLE / (60.0::DOUBLE + rank) ELSE 0.0::DOUBLE END)"


def _rrf(sparse: float = 0.5, dense: float = 0.5) -> str:
    return f"round({_part('sparse', sparse)} + {_part('dense', dense)}, 12)"


_FUSED = f"SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT query, id, {_rrf()} AS score FROM ({_HITS}) GROUP BY 1, 2)"

_BM25 = rf"""
WITH d AS (SELECT chunk_id AS id, regexp_extract_all(lower(search_text), '[\p{{L}}\p{{N}}]+') AS t FROM ({_CHUNKS})),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY 1, 2),
n AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM d),
len AS (SELECT id, coalesce(len(t), 0) AS dl FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM eval_items),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM df, n),
s AS (SELECT item_id, id AS chunk_id, round(sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
      FROM q JOIN post USING (term) JOIN idf USING (term) JOIN len USING (id), n GROUP BY 1, 2)
SELECT item_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
"""

_BLOCKS = f"""
SELECT *, first_value(chunk_id) OVER b AS block_id, row_number() OVER b AS block_pos FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS island FROM (
    SELECT *, CASE WHEN article_number IS NOT NULL AND article_number IS NOT DISTINCT FROM lag(article_number) OVER w
                    AND article_title IS NOT DISTINCT FROM lag(article_title) OVER w AND chunk_index = lag(chunk_index) OVER w + 1 THEN 0 ELSE 1 END AS fresh
    FROM ({_PLACED}) WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id)))
WINDOW b AS (PARTITION BY document_id, island ORDER BY chunk_index, chunk_id)
"""


def _frame(kind: str, at: int, frame: str) -> str:
    return f"SELECT document_id, chunk_id, start_char, end_char, {at} AS position, '{kind}' AS kind, min(start_char) OVER f AS start, max(end_char) OVER f AS \"end\", CAST(count(*) OVER f AS INTEGER) AS n_chunks FROM b WHERE article_number IS NOT NULL WINDOW f AS (PARTITION BY document_id, block_id ORDER BY block_pos ROWS BETWEEN {frame})"


_EXPANSIONS = f"""
WITH b AS ({_BLOCKS}), x AS (
  {_frame('whole_article', 0, 'UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')} UNION ALL {_frame('both_neighbors', 1, '1 PRECEDING AND 1 FOLLOWING')}
  UNION ALL {_frame('previous_neighbor', 2, '1 PRECEDING AND CURRENT ROW')} UNION ALL {_frame('next_neighbor', 3, 'CURRENT ROW AND 1 FOLLOWING')})
SELECT chunk_id, kind, start, "end", n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id, start, "end" ORDER BY position) AS k FROM x)
WHERE k = 1 AND NOT (start = start_char AND "end" = end_char) AND "end" - start <= 6000
"""

_RUNS = """
SELECT question_id, max(CASE WHEN sample_index % 2 = 0 THEN s END) AS even, max(CASE WHEN sample_index % 2 <> 0 THEN s END) AS odd
FROM (SELECT question_id, sample_index, unnest(fused).rrf_score AS s FROM retrieval_results WHERE question_id IS NOT NULL) WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1
"""
_DELTAS = f"SELECT question_id, even - odd AS d FROM ({_RUNS}) WHERE even IS NOT NULL AND odd IS NOT NULL"


def _percentile(p: float) -> str:
    return f"min(CASE WHEN upto > round_even((n - 1) * {p}::DOUBLE, 0) THEN v END) AS p{round(100 * p)}"


_WINDOWS = "SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM ({}) GROUP BY 1, 2, 3"

_BM25_FOLDED = _BM25.replace("lower(search_text)", _fold("search_text")).replace("lower(text)", _fold("text"))

# Query terms: the eight longest folded words of three letters or more, earlier ones first among equals.
_TERMS = rf"""
SELECT item_id, w AS term, count(*) OVER (PARTITION BY item_id) AS n_terms FROM (
  SELECT item_id, w FROM (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT item_id, regexp_extract_all({_fold("text")}, '[\p{{L}}\p{{N}}]+') AS t FROM eval_items)) GROUP BY 1, 2)
  WHERE length(w) >= 3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) <= 8)
"""
# Occurrences that overlap are counted one by one only for words that can overlap themselves.
_SUBSTRING = f"""
WITH q AS ({_TERMS}), d AS (SELECT chunk_id AS id, coalesce({_fold("search_text")}, '') AS t FROM ({_CHUNKS})),
n AS (SELECT count(*) AS n, avg(greatest(0, length(t) - 2)) AS avgdl FROM d),
w AS (SELECT term, len(list_filter(range(1, length(term)), lambda k: left(term, k) = right(term, k))) > 0 AS bordered FROM (SELECT DISTINCT term FROM q)),
tf AS (SELECT term, id, greatest(0, length(t) - 2) AS dl,
         CASE WHEN bordered THEN len(list_filter(range(1, length(t) - length(term) + 2), lambda k: substr(t, k, length(term)) = term)) ELSE len(string_split(t, term)) - 1 END AS tf FROM w JOIN d ON contains(t, term)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM df, n),
s AS (SELECT item_id, id AS chunk_id, round(sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
      FROM q JOIN tf USING (term) JOIN idf USING (term), n GROUP BY 1, 2 HAVING count(*) >= least(2, max(n_terms)))
SELECT item_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
"""

_ASKED = "SELECT question_id AS query, min(question) AS question FROM training_records WHERE question IS NOT NULL GROUP BY 1"
_CANDIDATES = f"SELECT f.query, f.id, f.rank, c.document_id, c.article_number, c.text, a.question FROM ({_FUSED}) f JOIN ({_CHUNKS}) c ON c.chunk_id = f.id JOIN ({_ASKED}) a ON a.query = f.query WHERE f.rank <= 20"

# As in the operators.
_STOPWORDS = "ai bao bi cac can co cua duoc gi hay hien khi la lam mot nao nhung phai quy ra sau the thi theo trong tren truoc tu va ve voi"
_NUMBERS = r"\b[0-9]{1,4}/[0-9]{4}/[a-z0-9]+(?:-[a-z0-9]+)*\b"
_ARTICLES = r"\bdieu\s+([0-9]+[a-z]?)\b"
_CLAUSES = r"\bkhoan\s+([0-9]+[a-z]?)\b"
_CITATIONS = f"""
WITH r AS (SELECT query, id, rank - 1 AS rank, {_fold("question")} AS q, {_fold("concat(coalesce(document_id, ''), ' ', coalesce(article_number, ''), ' ', coalesce(text, ''))")} AS c, {_fold("coalesce(article_number, '')")} AS a FROM ({_CANDIDATES}) WHERE rank <= 12),
t AS (SELECT *, list_distinct(regexp_extract_all(q, '{_NUMBERS}')) AS d, list_distinct(regexp_extract_all(q, '{_ARTICLES}', 1)) AS ar, list_distinct(regexp_extract_all(q, '{_CLAUSES}', 1)) AS cl,
        list_filter(regexp_extract_all(q, '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(string_split('{_STOPWORDS}', ' '), w)) AS t,
        regexp_extract_all(c, '{_ARTICLES}', 1) AS car, regexp_extract_all(c, '{_CLAUSES}', 1) AS ccl, regexp_extract_all(c, '[a-z0-9]+') AS ct FROM r),
h AS (SELECT query, id, rank, len(list_filter(d, lambda x: contains(c, x))) AS document_hits, len(list_filter(ar, lambda x: list_contains(car, x) OR a = x)) AS article_hits, len(list_filter(cl, lambda x: list_contains(ccl, x))) AS clause_hits,
        len(list_intersect(list_distinct(t), ct)) AS token_hits, len(list_filter(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), lambda x: contains(c, x))) AS bigram_hits,
        len(d) + len(ar) + len(cl) > 0 AS has_reference FROM t),
s AS (SELECT *, document_hits * 1000 + article_hits * 500 + clause_hits * 100 + token_hits + bigram_hits * 4 + (12 - rank) * 1.5::DOUBLE AS score, bool_or(has_reference) OVER (PARTITION BY query) OR rank < 6 AS inside FROM h)
SELECT query AS question_id, id AS chunk_id, CAST(rank AS INTEGER) AS rank, document_hits::INTEGER AS document_hits, article_hits::INTEGER AS article_hits, clause_hits::INTEGER AS clause_hits, token_hits::INTEGER AS token_hits, bigram_hits::INTEGER AS bigram_hits, score::DOUBLE AS score,
  CAST(row_number() OVER (PARTITION BY query ORDER BY inside DESC, CASE WHEN inside THEN -score END, rank) AS INTEGER) AS position FROM s
"""

_PAIRS = f"SELECT record_id, source, r, answer AS p FROM (SELECT * FROM ({_ANSWERED}) WHERE question_id IS NOT NULL) JOIN (SELECT question_id, min(answer) AS r FROM ({_ANSWERED}) WHERE question_id IS NOT NULL GROUP BY 1) USING (question_id)"
_SCORES = rf"""
WITH RECURSIVE pairs AS (SELECT record_id, regexp_extract_all(lower(r), '[a-z0-9]+') AS a, regexp_extract_all(lower(p), '[a-z0-9]+') AS b, regexp_extract_all(lower(r), '[^' || substr('{_WS}', 2) || '+') AS x, regexp_extract_all(lower(p), '[^' || substr('{_WS}', 2) || '+') AS y FROM ({_PAIRS})),
-- longest common subsequences, a word of the candidate at a time; equal lists need none
steps AS (
  SELECT record_id, a, b, 0 AS i, list_transform(a, lambda w: 0) AS best FROM pairs WHERE a <> b AND len(a) > 0 AND len(b) > 0
  UNION ALL
  SELECT record_id, a, b, i + 1, list_transform(best, lambda v, j: greatest(v, coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: a[k] = b[i + 1]), lambda k: (CASE WHEN k = 1 THEN 0 ELSE best[k - 1] END) + 1)), 0))) FROM steps WHERE i < len(b)),
common AS (SELECT record_id, best[len(a)] AS n FROM steps WHERE i = len(b) UNION ALL SELECT record_id, CASE WHEN a = b THEN len(a) ELSE 0 END FROM pairs WHERE a = b OR len(a) = 0 OR len(b) = 0),
-- words of the candidate from its end, each to the last free place of the reference
ref AS (SELECT *, row_number() OVER (PARTITION BY record_id, w ORDER BY j DESC) AS k FROM (SELECT record_id, unnest(x) AS w, generate_subscripts(x, 1) AS j FROM pairs)),
cand AS (SELECT *, row_number() OVER (PARTITION BY record_id, w ORDER BY i DESC) AS k FROM (SELECT record_id, unnest(y) AS w, generate_subscripts(y, 1) AS i FROM pairs)),
met AS (SELECT record_id, i, j, CASE WHEN i = lag(i) OVER o + 1 AND j = lag(j) OVER o + 1 THEN 0 ELSE 1 END AS fresh FROM ref JOIN cand USING (record_id, w, k) WINDOW o AS (PARTITION BY record_id ORDER BY i)),
m AS (SELECT record_id, count(*)::DOUBLE AS m, sum(fresh)::DOUBLE AS chunks FROM met GROUP BY 1)
SELECT record_id, round(CASE WHEN n > 0 THEN 2.0::DOUBLE * n / (len(a) + len(b)) ELSE 0 END, 9) AS rouge_l,
  round(coalesce((m / len(y)) * (m / len(x)) / (0.9::DOUBLE * (m / len(y)) + 0.1::DOUBLE * (m / len(x))) * (1 - 0.5::DOUBLE * pow(chunks / m, 3)), 0), 9) AS meteor_exact
FROM pairs JOIN common USING (record_id) LEFT JOIN m USING (record_id)
"""

_VISIBLE_WORDS = lambda x: f"len(regexp_extract_all({x}, '[^' || substr('{_WS}', 2) || '+'))"
_LINE_WORDS = lambda label, x, n: f"CASE WHEN coalesce({x}, '') <> '' THEN {n} + {_VISIBLE_WORDS(x)} ELSE 0 END"
# The text of a prompt, from its contexts and question.
_PROMPT = lambda texts, question: f"sha256('Ngữ cảnh:' || chr(10) || array_to_string(list_transform({texts}, lambda x, i: '[' || i || '] ' || x), chr(10) || chr(10)) || chr(10) || chr(10) || 'Câu hỏi: ' || {question})"
# Words of each unit's context: its number, source, article, "Nội dung:" and text; then a greedy walk in rank order.
_SEEDS = f"""
WITH u AS (SELECT c.query, c.question, c.rank, 1 + 2 + {_LINE_WORDS("Tên nguồn:", "d.source_title", 2)} + {_LINE_WORDS("Số văn bản:", "d.document_number", 3)}
             + CASE WHEN coalesce(k.article_number, '') <> '' THEN 1 + {_VISIBLE_WORDS("k.article_number")} ELSE 2 END + CASE WHEN coalesce(k.article_title, '') <> '' THEN {_VISIBLE_WORDS("k.article_title")} ELSE 0 END + {_VISIBLE_WORDS("c.text")} AS n,
             concat_ws(chr(10), CASE WHEN coalesce(d.source_title, '') <> '' THEN 'Tên nguồn: ' || regexp_replace(d.source_title, '^{_WS}+|{_WS}+$', '', 'g') END, CASE WHEN coalesce(d.document_number, '') <> '' THEN 'Số văn bản: ' || regexp_replace(d.document_number, '^{_WS}+|{_WS}+$', '', 'g') END,
               CASE WHEN coalesce(k.article_number, '') <> '' THEN 'Điều ' || k.article_number ELSE 'Trích đoạn' END || CASE WHEN coalesce(k.article_title, '') <> '' THEN ': ' || k.article_title ELSE '' END, 'Nội dung:', c.text) AS t
           FROM ({_CANDIDATES}) c JOIN ({_CHUNKS}) k ON k.chunk_id = c.id JOIN documents d ON d.document_id = c.document_id WHERE c.rank <= 12),
q AS (SELECT query, min(question) AS question, 4 + {_VISIBLE_WORDS("min(question)")} AS frame, list({{'used': n::BIGINT, 'texts': [t]}} ORDER BY rank) AS own FROM u GROUP BY 1),
w AS (SELECT query, question, list_reduce(list_prepend({{'used': frame::BIGINT, 'texts': CAST([] AS VARCHAR[])}}, own), lambda a, b: CASE WHEN a.used + b.used <= 600 THEN {{'used': a.used + b.used, 'texts': list_concat(a.texts, b.texts)}} ELSE a END) AS r FROM q)
SELECT query AS question_id, CAST(r.used AS INTEGER) AS n_tokens, len(r.texts)::INTEGER AS n_units, {_PROMPT("r.texts", "question")} AS prompt_sha256 FROM w
"""

_VECTOR = lambda x: f"[length({x})::DOUBLE / 1000, len(string_split({x}, ' '))::DOUBLE / 100, len(string_split({x}, 'a'))::DOUBLE / 50]"
_RETRIEVED = f"""
WITH sparse AS (SELECT item_id AS query, chunk_id AS id, rank FROM ({_BM25.replace("rank <= 10", "rank <= 40")})),
dense AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM (
  SELECT i.item_id AS query, c.chunk_id AS id, round(list_inner_product({_VECTOR("i.text")}, {_VECTOR("c.text")}), 9) AS s FROM eval_items i, ({_CHUNKS}) c WHERE c.text IS NOT NULL AND i.text IS NOT NULL) QUALIFY rank <= 40),
h AS (SELECT 'sparse' AS branch, * FROM sparse UNION ALL SELECT 'dense', * FROM dense),
f AS (SELECT query, id, {_rrf()} AS score FROM h GROUP BY 1, 2)
SELECT query AS item_id, id AS chunk_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 12
"""

_NUMBER_KEY = lambda x: f"regexp_replace({_fold(x)}, '[^a-z0-9]+', '', 'g')"
_WORD_LINE = lambda x: f"array_to_string(regexp_extract_all({_fold(x)}, '[a-z0-9]+'), ' ')"
_SOURCES = f"""
WITH pool AS (SELECT c.query, c.id, c.rank, c.document_id, c.question, d.document_number AS number, d.source_title AS title FROM ({_CANDIDATES}) c JOIN documents d USING (document_id)),
d AS (SELECT query, document_id, any_value(question) AS question, any_value(number) AS number, any_value(title) AS title FROM pool GROUP BY 1, 2),
w AS (SELECT *, coalesce(list_contains(list_transform(regexp_extract_all({_fold("question")}, '{_NUMBERS}'), lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')), {_NUMBER_KEY("number")}), false) AS by_number, {_WORD_LINE("question")} AS q, {_WORD_LINE("coalesce(title, '')")} AS t FROM d),
x AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) >= 2 AND NOT list_contains(string_split('cac cho cua duoc so theo trong va ve', ' '), x))) AS words FROM w),
y AS (SELECT *, list_intersect(words, string_split(q, ' ')) AS shared, len(words) AS n FROM x),
k AS (SELECT *, CASE WHEN n > 0 AND len(shared) >= 2 AND len(shared) >= 0.5 * n AND list_has_any(shared, ['bo', 'luat', 'nghi', 'dinh', 'thong', 'tu', 'quyet', 'phap', 'lenh'])
        THEN {{'phrase': contains(q, t)::INTEGER, 'overlap': len(shared), 'share': floor(len(shared) * 10000.0 / n), 'n': n}} END AS key FROM y),
b AS (SELECT *, coalesce(key = max(key) OVER (PARTITION BY query), false) AS is_best FROM k),
r AS (SELECT query, CASE WHEN count(*) FILTER (WHERE by_number) = 1 THEN max(document_id) FILTER (WHERE by_number) WHEN count(*) FILTER (WHERE by_number) = 0 AND count(*) FILTER (WHERE is_best) = 1 THEN max(document_id) FILTER (WHERE is_best) END AS want FROM b GROUP BY 1),
m AS (SELECT query, id, rank, document_id, coalesce(document_id = want, false) AS mine, rank <= 12 AS head FROM pool JOIN r USING (query)),
t AS (SELECT *, NOT head AND mine AND row_number() OVER (PARTITION BY query, mine, head ORDER BY rank) <= 2 AS tail, row_number() OVER (PARTITION BY query, mine, head ORDER BY rank DESC) AS from_end FROM m),
n AS (SELECT *, count(*) FILTER (WHERE tail) OVER (PARTITION BY query) AS tails, count(*) FILTER (WHERE head AND NOT mine) OVER (PARTITION BY query) AS free FROM t),
c AS (SELECT *, CASE WHEN free >= tails THEN tails ELSE 0 END AS moved FROM n),
s AS (SELECT * FROM c WHERE head AND NOT (NOT mine AND from_end <= moved) OR tail AND moved > 0),
p AS (SELECT *, CASE WHEN tail THEN coalesce(max(CASE WHEN head AND mine THEN rank END) OVER (PARTITION BY query), 0) + 0.5 ELSE rank END AS place FROM s)
SELECT query AS question_id, id AS chunk_id, rank, CAST(row_number() OVER (PARTITION BY query ORDER BY place, rank) AS INTEGER) AS position, tail AS promoted FROM p
"""

# A reference begins after what is no letter, digit or underscore and ends before it; the text before it is taken as short as can be.
_CORE = rf"(?:khoản{_WS}+(?:\p{{Nd}}+[a-zđ]?){_WS}*,?{_WS}*(?:của{_WS}+)?)?điều{_WS}+\p{{Nd}}+[a-zđ]?"
_FIRST = rf"(?is)^((?:.*?[^\p{{L}}\p{{N}}_])??)({_CORE})(?:[^\p{{L}}\p{{N}}_].*)?$"
_KINDS = "bo luat|luat|nghi dinh|thong tu|quyet dinh|nghi quyet|phap lenh"
_REFERENCES = rf"""
WITH RECURSIVE m AS (
  SELECT record_id, question, 0 AS upto, CAST(NULL AS VARCHAR) AS found FROM training_records WHERE question IS NOT NULL
  UNION ALL
  SELECT record_id, question, upto + length(regexp_extract(rest, '{_FIRST}', 1)) + length(regexp_extract(rest, '{_FIRST}', 2)), regexp_extract(rest, '{_FIRST}', 2)
  FROM (SELECT *, substr(question, upto + 1) AS rest FROM m) WHERE regexp_matches(rest, '{_FIRST}')),
r AS (SELECT record_id, found, upto - length(found) AS start, upto AS "end", list_distinct(regexp_extract_all({_fold("question")}, '{_NUMBERS}')) AS everywhere,
        list_distinct(regexp_extract_all({_fold("substr(question, greatest(upto - length(found) - 120, 0) + 1, upto + 180 - greatest(upto - length(found) - 120, 0))")}, '{_NUMBERS}')) AS close, {_fold("substr(question, upto + 1, 100)")} AS after FROM m WHERE found IS NOT NULL),
n AS (SELECT *, CASE WHEN len(close) > 0 THEN close ELSE everywhere END AS near FROM r)
SELECT CAST(record_id AS VARCHAR) AS record_id, lower(regexp_extract(found, '(?i)điều{_WS}+(\p{{Nd}}+[a-zđ]?)$', 1)) AS article_number, nullif(lower(regexp_extract(found, '(?i)^khoản{_WS}+(\p{{Nd}}+[a-zđ]?)', 1)), '') AS clause_number,
  CASE WHEN len(near) = 1 THEN near[1] END AS document_number,
  CASE WHEN len(near) > 1 THEN 'ambiguous_document_numbers' WHEN len(near) = 1 THEN 'exact_document_number'
       WHEN regexp_matches(after, '\b(?:{_KINDS})\b') AND NOT regexp_matches(after, '\b(?:van ban|{_KINDS})\s+nay\b') THEN 'unresolved_external_document' ELSE 'question_without_exact_document_number' END AS resolution,
  CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM n
"""

# The same in chunks: a number must stand near, and what points nowhere else means the chunk's own document.
_CROSS = rf"""
WITH RECURSIVE c AS ({_CHUNKS}), m AS (
  SELECT chunk_id, document_id, text, 0 AS upto, CAST(NULL AS VARCHAR) AS found FROM c WHERE text IS NOT NULL
  UNION ALL
  SELECT chunk_id, document_id, text, upto + length(regexp_extract(rest, '{_FIRST}', 1)) + length(regexp_extract(rest, '{_FIRST}', 2)), regexp_extract(rest, '{_FIRST}', 2)
  FROM (SELECT *, substr(text, upto + 1) AS rest FROM m) WHERE regexp_matches(rest, '{_FIRST}')),
r AS (SELECT document_id, found, list_distinct(regexp_extract_all({_fold("substr(text, greatest(upto - length(found) - 120, 0) + 1, upto + 180 - greatest(upto - length(found) - 120, 0))")}, '{_NUMBERS}')) AS near, {_fold("substr(text, upto + 1, 100)")} AS after FROM m WHERE found IS NOT NULL),
k AS (SELECT document_id, lower(regexp_extract(found, '(?i)điều{_WS}+(\p{{Nd}}+[a-zđ]?)$', 1)) AS article_number, CASE WHEN len(near) = 1 THEN regexp_replace(near[1], '[^a-z0-9]+', '', 'g') END AS key,
        CASE WHEN len(near) > 1 THEN 'ambiguous_document_numbers' WHEN len(near) = 1 THEN 'exact_document_number'
             WHEN regexp_matches(after, '\b(?:{_KINDS})\b') AND NOT regexp_matches(after, '\b(?:van ban|{_KINDS})\s+nay\b') THEN 'unresolved_external_document' ELSE 'same_document' END AS resolution FROM r),
d AS (SELECT key, max(document_id) AS only FROM (SELECT DISTINCT {_NUMBER_KEY("document_number")} AS key, document_id FROM documents WHERE document_number IS NOT NULL) WHERE key <> '' GROUP BY 1 HAVING count(*) = 1),
t AS (SELECT k.*, CASE WHEN resolution = 'same_document' THEN k.document_id WHEN resolution = 'exact_document_number' THEN d.only END AS target FROM k LEFT JOIN d ON d.key = k.key),
b AS (SELECT document_id, article_number, count(DISTINCT block_id) AS n FROM ({_BLOCKS.replace(_PLACED, _CHUNKS)}) WHERE article_number IS NOT NULL GROUP BY 1, 2),
a AS (SELECT document_id, lower(article_number) AS number FROM b GROUP BY 1, 2 HAVING sum(n) = 1)
SELECT resolution, count(*) AS n, count(target) AS n_document, count(a.number) AS n_article FROM t LEFT JOIN a ON a.document_id = t.target AND a.number = t.article_number GROUP BY 1
"""

# As in the operator. Of entities the tables hold only the non-breaking space.
_HINT = r"(?i)<\s*/?\s*(?:br|p|div|span|table|thead|tbody|tr|td|th|strong|em|b|i|img|script|style)\b"
_CODE = r"(?is)<\s*script\b[^>]*>.*?<\s*/\s*script\s*>|<\s*style\b[^>]*>.*?<\s*/\s*style\s*>"
_BLOCK = r"(?i)<\s*/?\s*(?:br|p|div|li|table|thead|tbody|tr|h[1-6])\b[^>]*>"
_INLINE = r"(?i)<\s*/?\s*(?:span|td|th|strong|em|b|i|u|font|a)\b[^>]*>"
_PORTAL = r"(?i)Bạn\s+phải\s+đăng\s+nhập\s+hoặc\s+đăng\s+ký\s+Thành\s+Viên\s+TVPL\s+Pro\s+để\s+sử\s+dụng\s+được\s+đầy\s+đủ\s+các\s+tiện\s+ích\s+gia\s+tăng\s+liên\s+quan\s+đến\s+nội\s+dung\s+TCVN\.\s*Mọi\s+chi\s+tiết\s+xin\s+liên\s+hệ:\s*ĐT:\s*\(028\)\s*3930\s*3279\s*DĐ:\s*0906\s*22\s*99\s*66"
_CLEANED = rf"""
WITH a AS (SELECT doc_id, text, regexp_replace(regexp_replace(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '[\x{{feff}}\x{{200b}}-\x{{200d}}\x{{2060}}]', '', 'g'), '[\x{{a0}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g') AS t FROM documents),
h AS (SELECT *, regexp_matches(t, '{_HINT}') AS hint FROM a),
b AS (SELECT *, CASE WHEN hint THEN regexp_replace(t, '{_CODE}', '', 'g') ELSE t END AS t1, CASE WHEN hint THEN len(regexp_extract_all(t, '{_CODE}')) ELSE 0 END AS n1 FROM h),
c AS (SELECT *, CASE WHEN hint THEN regexp_replace(t1, '{_BLOCK}', chr(10), 'g') ELSE t1 END AS t2, CASE WHEN hint THEN len(regexp_extract_all(t1, '{_BLOCK}')) ELSE 0 END AS n2 FROM b),
d AS (SELECT *, CASE WHEN hint THEN regexp_replace(t2, '{_INLINE}', '', 'g') ELSE t2 END AS t3, CASE WHEN hint THEN len(regexp_extract_all(t2, '{_INLINE}')) ELSE 0 END AS n3 FROM c),
e AS (SELECT *, regexp_replace(t3, '{_PORTAL}', chr(10), 'g') AS t4, len(regexp_extract_all(t3, '{_PORTAL}')) AS k FROM d),
f AS (SELECT *, array_to_string(list_transform(string_split(t4, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')), chr(10)) AS t5 FROM e)
SELECT doc_id, replace(regexp_replace(regexp_replace(t5, '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g'), '&nbsp;', chr(160)) AS cleaned_text,
  CAST(CASE WHEN text IS NOT NULL THEN n1 + n2 + n3 END AS INTEGER) AS markup_removed, CAST(CASE WHEN text IS NOT NULL THEN k END AS INTEGER) AS notices_removed, text <> nfc_normalize(text) AS was_not_nfc, contains(text, chr(13)) AS had_cr FROM f
"""

SQL: dict[str, str] = {
    "rt01_bm25_word": _BM25,
    "jn01_bm25_postings": _BM25.replace("FROM eval_items)", "FROM (SELECT doc_id AS item_id, source_title AS text FROM documents WHERE doc_id % 50 = 0))").replace("SELECT item_id, chunk_id, score, CAST", "SELECT item_id AS doc_id, chunk_id, score, CAST"),
    "rt02_bm25_folded": _BM25_FOLDED,
    "rt03_bm25_substring": _SUBSTRING,
    "rt04_fused_sparse": f"""
        WITH h AS (SELECT 'word' AS branch, * FROM ({_BM25}) UNION ALL SELECT 'folded', * FROM ({_BM25_FOLDED}) UNION ALL SELECT 'substring', * FROM ({_SUBSTRING})),
        f AS (SELECT item_id, chunk_id, round({_part('word', 0.5)} + {_part('folded', 0.3)} + {_part('substring', 0.2)}, 12) AS score, min(rank) AS best_rank FROM h GROUP BY 1, 2)
        SELECT item_id, chunk_id, score, best_rank, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, best_rank, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""",
    "rt06_retrieved": _RETRIEVED,
    "rt11_citation_order": _CITATIONS,
    "rt12_source_aware": _SOURCES,
    "rt19_cross_references": _CROSS,
    "tx06_cleaned": _CLEANED,
    "tx17_references": _REFERENCES,
    "rt16_seeds": _SEEDS,
    "rt26_scores": _SCORES,
    "tk11_lowest_scores": f"SELECT record_id, meteor_exact FROM ({_SCORES}) ORDER BY meteor_exact, record_id LIMIT 40",
    "rt24_group_holdout": f"""
        WITH g AS (SELECT {_norm("question")} AS g, count(*) AS n FROM ({_ANSWERED}) WHERE split = 'train' AND question IS NOT NULL GROUP BY 1),
        o AS (SELECT list({{'left': n::BIGINT, 'took': [g]}} ORDER BY sha256('holdout-1' || g), g) AS o FROM g WHERE n <= 50),
        r AS (SELECT list_reduce(list_prepend({{'left': 50::BIGINT, 'took': CAST([] AS VARCHAR[])}}, o), lambda a, b: CASE WHEN b."left" <= a."left" THEN {{'left': a."left" - b."left", 'took': list_concat(a.took, b.took)}} ELSE a END).took AS took FROM o),
        t AS (SELECT unnest(took) AS g, generate_subscripts(took, 1) - 1 AS position FROM r)
        SELECT g AS "group", n AS n_rows, CAST(position AS INTEGER) AS position FROM t JOIN g USING (g)""",
    "tx02_folded_titles": f"SELECT doc_id, {_fold('source_title')} AS folded_title FROM documents",
    "tx24_answer_evidence": rf"""
        WITH a AS (SELECT question_id AS query, min(answer) AS answer FROM ({_ANSWERED}) WHERE question_id IS NOT NULL GROUP BY 1),
        t AS (SELECT query, list_distinct(regexp_extract_all({_fold('answer')}, '[\p{{L}}\p{{N}}]+')) AS a, list_distinct(regexp_extract_all({_fold('text')}, '[\p{{L}}\p{{N}}]+')) AS c,
                list_distinct(regexp_extract_all({_fold('answer')}, '{_ARTICLES}', 1)) AS ra, list_distinct(regexp_extract_all({_fold('text')}, '{_ARTICLES}', 1)) AS rc FROM a JOIN ({_CANDIDATES}) USING (query) WHERE rank = 1)
        SELECT query AS question_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a)::DOUBLE END AS token_coverage, CASE WHEN len(ra) > 0 THEN len(list_intersect(ra, rc)) > 0 END AS any_reference,
          CASE WHEN len(ra) > 0 THEN len(list_intersect(ra, rc)) = len(ra) END AS all_references FROM t""",
    "rt05_dense_exact": """
        SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s
            FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
    "tx40_vector_norms": "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS squared_norm, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "rt06_hybrid": f"SELECT query AS question_id, id AS chunk_id, score, rank FROM ({_FUSED}) WHERE rank <= 12",
    "rt07_weight_grid": " UNION ALL ".join(f"SELECT * FROM (SELECT 's{s}_d{d}' AS variant, query AS question_id, id AS chunk_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT query, id, round({d / 10}::DOUBLE * sum(CASE WHEN branch = 'dense' THEN 1.0::DOUBLE / (60.0::DOUBLE + rank) ELSE 0.0::DOUBLE END) + {s / 10}::DOUBLE * sum(CASE WHEN branch = 'sparse' THEN 1.0::DOUBLE / (60.0::DOUBLE + rank) ELSE 0.0::DOUBLE END), 12) AS score FROM ({_HITS}) GROUP BY 1, 2)) WHERE rank <= 5" for s, d in ((6, 4), (5, 5), (4, 6))),
    "ag09_rrf_trace": f"""
        SELECT query AS question_id, id AS chunk_id, score, best_rank, sparse_rank, dense_rank, rank FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, best_rank, id) AS INTEGER) AS rank FROM (
            SELECT query, id, {_rrf()} AS score, min(rank) AS best_rank, min(CASE WHEN branch = 'sparse' THEN rank END) AS sparse_rank, min(CASE WHEN branch = 'dense' THEN rank END) AS dense_rank
            FROM ({_HITS}) GROUP BY 1, 2)) WHERE rank <= 10""",
    "ag11_articles": f"""
        WITH h AS (SELECT h.*, c.document_id, coalesce(c.article_number, c.chunk_id) AS block_id FROM ({_HITS}) h JOIN ({_CHUNKS}) c ON c.chunk_id = h.id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query, document_id, block_id, branch ORDER BY rank, id) AS n FROM h),
        c AS (SELECT query, document_id, block_id, id, {_part('sparse', 0.5)} AS s, {_part('dense', 0.5)} AS d, min(rank) AS best FROM k WHERE n <= 3 GROUP BY 1, 2, 3, 4),
        r AS (SELECT *, round(s + d, 12) AS own, row_number() OVER (PARTITION BY query, document_id, block_id ORDER BY round(s + d, 12) DESC, best, id) AS k FROM c),
        a AS (SELECT query, document_id, block_id, round(sum(s) + sum(d), 12) AS score, max(CASE WHEN k = 1 THEN id END) AS representative, max(CASE WHEN k = 1 THEN own END) AS representative_score, count(*) AS n_chunks FROM r GROUP BY 1, 2, 3)
        SELECT query AS question_id, document_id, block_id, score, representative, representative_score, n_chunks,
          CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, representative_score DESC, document_id, block_id) AS INTEGER) AS rank FROM a QUALIFY rank <= 8""",
    "wn02_diverse_order": f"""
        WITH h AS (SELECT f.*, c.document_id, c.article_number FROM (SELECT * FROM ({_FUSED}) WHERE rank <= 20) f JOIN ({_CHUNKS}) c ON c.chunk_id = f.id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query, document_id, article_number ORDER BY rank, id) > 1 AS again FROM h)
        SELECT query AS question_id, id AS chunk_id, rank, CAST(row_number() OVER (PARTITION BY query ORDER BY again, rank, id) AS INTEGER) AS position FROM k QUALIFY position <= 12""",
    "rt32_context_variants": f"""
        WITH h AS (SELECT f.*, c.document_id, coalesce(c.article_number, '~') AS a FROM (SELECT * FROM ({_FUSED}) WHERE rank <= 20) f JOIN ({_CHUNKS}) c ON c.chunk_id = f.id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query, document_id, a ORDER BY rank, id) > 1 AS again FROM h),
        v AS (SELECT 'top20' AS variant, query, document_id, a FROM h UNION ALL SELECT 'top12', query, document_id, a FROM h WHERE rank <= 12
              UNION ALL SELECT 'diverse12', query, document_id, a FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY again, rank, id) AS p FROM k) WHERE p <= 12)
        SELECT variant, round(avg(d), 9) AS documents, round(avg(u), 9) AS units FROM (SELECT variant, query, count(DISTINCT document_id) AS d, count(DISTINCT (document_id, a)) AS u FROM v GROUP BY 1, 2) GROUP BY 1""",
    "ag19_branch_overlap": f"""
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY query, branch ORDER BY rank, id) AS r FROM ({_HITS})),
        p AS (SELECT query, id, max(branch = 'sparse')::INT + max(branch = 'dense')::INT AS b FROM t WHERE r <= 5 AND branch IN ('sparse', 'dense') GROUP BY 1, 2)
        SELECT query AS question_id, round(sum(CASE WHEN b = 2 THEN 1 ELSE 0 END) / count(*), 9) AS jaccard FROM p GROUP BY 1""",
    "wn03_article_blocks": f"SELECT chunk_id, block_id, CAST(block_pos AS INTEGER) AS block_pos FROM ({_BLOCKS})",
    "wn04_expansions": _EXPANSIONS,
    "wn04_run_expansions": _EXPANSIONS.replace(_PLACED, f"SELECT * REPLACE ('run' AS article_number, CAST(NULL AS VARCHAR) AS article_title) FROM ({_PLACED}) WHERE article_number IS NOT NULL"),
    "wn05_merged_spans": f"""
        WITH s AS (SELECT *, CASE WHEN start_char <= max(end_char) OVER (PARTITION BY document_id ORDER BY start_char, end_char, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({_PLACED})),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY start_char, end_char, chunk_index ROWS UNBOUNDED PRECEDING) AS island FROM s)
        SELECT document_id, min(start_char) AS start, max(end_char) AS "end", min(chunk_index) AS rank, CAST(count(DISTINCT chunk_id) AS INTEGER) AS n_chunks FROM i GROUP BY document_id, island""",
    "jn07_enclosing_articles": f"""
        WITH b AS ({_BLOCKS.replace(_PLACED, f"SELECT * FROM ({_PLACED}) WHERE article_number IS NOT NULL")}),
        a AS (SELECT document_id, block_id, article_number, min(start_char) AS s, max(end_char) AS e FROM b GROUP BY 1, 2, 3)
        SELECT b.document_id, count(*) AS n_pairs, count(a.s) AS n_enclosed FROM b LEFT JOIN a ON a.document_id = b.document_id AND a.article_number = b.article_number AND b.start_char >= a.s AND b.end_char <= a.e GROUP BY 1""",
    "dq04_provenance": f"SELECT c.chunk_id, c.document_id FROM ({_CHUNKS}) c LEFT JOIN documents d USING (document_id) WHERE coalesce(start_char < 0 OR end_char < start_char OR substring(d.cleaned_text, start_char + 1, end_char - start_char) <> c.text, true)",
    "wn06_fixed_windows": f"""
        WITH t AS (SELECT doc_id, string_split({_squeeze('cleaned_text')}, ' ') AS t FROM documents WHERE regexp_matches(cleaned_text, '[^' || substr('{_WS_JAVA}', 2))),
        w AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - 64) / 48.0)) AS BIGINT) + 1)) AS window_no FROM t)
        SELECT doc_id, CAST(window_no AS INTEGER) AS window_no, sha256(array_to_string(t[window_no * 48 + 1 : window_no * 48 + 64], ' ')) AS text_sha256 FROM w""",
    "ag01_corpus_audit": f"""
        SELECT count(*) AS n_documents, sum(length(text))::BIGINT AS total_chars, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars,
          count(*) FILTER (WHERE text IS NULL OR NOT regexp_matches(text, '[^' || substr('{_WS_JAVA}', 2))) AS n_blank, count(*) FILTER (WHERE regexp_matches(text, '<[a-z/]')) AS n_markup,
          count(*) FILTER (WHERE contains(text, chr(13))) AS n_cr, count(*) FILTER (WHERE raw_character_count IS DISTINCT FROM length(text)) AS n_stale_count, count(*) FILTER (WHERE source_title IS NULL) AS n_untitled FROM documents""",
    "ag02_percentiles": f"""
        WITH h AS (SELECT lower(trim(source)) AS src, length(text) AS v, count(*) AS c FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, sum(c) OVER (PARTITION BY src ORDER BY v) AS upto, sum(c) OVER (PARTITION BY src) AS n FROM h)
        SELECT src, CAST(p50 AS INTEGER) AS p50, CAST(p90 AS INTEGER) AS p90, CAST(p99 AS INTEGER) AS p99 FROM (SELECT src, {_percentile(0.5)}, {_percentile(0.9)}, {_percentile(0.99)} FROM r GROUP BY 1)""",
    "ag03_exact_duplicates": "SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_key, count(*) - 1 AS extra FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "tk10_longest": "SELECT CAST(doc_id AS VARCHAR) AS key, CAST(length(text) AS INTEGER) AS length FROM documents WHERE text IS NOT NULL ORDER BY 2 DESC, 1 DESC LIMIT 20",
    "ag04_chunk_counters": f"""
        SELECT section_kind, split_method, count(*) AS n, count(article_number) AS n_numbered,
          sum(CASE WHEN whitespace_token_count IS DISTINCT FROM len(regexp_extract_all(text, '[^' || substr('{_WS_JAVA}', 2) || '+')) THEN 1 ELSE 0 END)::BIGINT AS n_stale, sum(length(text))::BIGINT AS chars FROM ({_CHUNKS}) GROUP BY 1, 2""",
    "ag20_token_audit": f"""
        SELECT count(*) AS n, CAST(max(w) AS INTEGER) AS longest, count(*) FILTER (WHERE w > 64) AS over_64, count(*) FILTER (WHERE w > 128) AS over_128, count(*) FILTER (WHERE w > 256) AS over_256, count(*) FILTER (WHERE w > 512) AS over_512
        FROM (SELECT len(regexp_extract_all(text, '[^' || substr('{_WS_JAVA}', 2) || '+')) AS w FROM ({_CHUNKS}))""",
    "ag25_metadata_coverage": "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE trim({c}) <> '') AS n_{c}" for c in ("source_title", "document_number", "source", "lang", "source_name")) + " FROM documents",
    "rt27_failure_audit": f"""
        SELECT question_id, metric, coalesce(n, 0) AS n_contexts FROM (SELECT question_id, min(meteor_exact) AS metric FROM ({_SCORES}) JOIN training_records USING (record_id) GROUP BY 1 ORDER BY metric, question_id LIMIT 50)
        LEFT JOIN (SELECT question_id, count(*) AS n FROM retrieval_results WHERE question_id IS NOT NULL GROUP BY 1) USING (question_id)""",
    "tx25_answer_diagnostics": rf"""
        WITH a AS (SELECT record_id, answer,
            list_filter(list_transform(string_split(answer, chr(10)), lambda x: {_squeeze('lower(x)')}), lambda x: length(x) >= 8) AS l,
            list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_squeeze('lower(x)')}), lambda x: length(x) >= 20) AS s FROM ({_ANSWERED}))
        SELECT record_id, len(l) <> len(list_distinct(l)) AS duplicate_line, len(s) <> len(list_distinct(s)) AS duplicate_sentence, regexp_matches(answer, '(?:-[A-ZĐ]{{2,10}}){{10,}}') AS abbreviation_loop,
          NOT regexp_matches(answer, '[.!?…:;)\]”"]' || '{_WS_JAVA}*$') AS non_sentence_ending FROM a""",
    "tx14_source_numbers": r"""
        WITH h AS (SELECT doc_id, CASE WHEN regexp_matches(cleaned_text, '(?im)^\s*Điều\s+[0-9]+[a-zđ]?') THEN substr(cleaned_text, 1, strpos(cleaned_text, regexp_extract(cleaned_text, '(?im)^\s*Điều\s+[0-9]+[a-zđ]?')) - 1) ELSE substring(cleaned_text, 1, 600) END AS head FROM documents),
        n AS (SELECT doc_id, list_distinct(regexp_extract_all(head, '(?i)\b([0-9]{1,4}/[0-9]{4}/[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)', 1)) AS found FROM h)
        SELECT doc_id, CASE WHEN len(found) = 1 THEN found[1] END AS source_number FROM n""",
    "ag06_conflicting_answers": f'SELECT {_norm("question")} AS "group", count(*) AS n_rows, count(DISTINCT {_norm("answer")}) AS n_answers FROM ({_ANSWERED}) WHERE question IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT {_norm("answer")}) > 1',
    "ag07_split_overlap": f"""
        WITH q AS (SELECT {_norm("question")} AS q, bool_or(split = 'train') AS l, bool_or(split <> 'train') AS r FROM training_records WHERE question IS NOT NULL GROUP BY 1)
        SELECT count(*) FILTER (WHERE l) AS n_left, count(*) FILTER (WHERE r) AS n_right, count(*) FILTER (WHERE l AND r) AS n_both, count(*) FILTER (WHERE l AND NOT r) AS n_left_only, count(*) FILTER (WHERE r AND NOT l) AS n_right_only FROM q""",
    "dq05_leaking_groups": f"SELECT {_norm('question')} AS q, count(DISTINCT split) AS n_splits FROM training_records WHERE question IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "ag23_ordered_ids": "SELECT DISTINCT result_id, sha256(array_to_string(list_filter(list_transform(fused, lambda f: f.chunk_id), lambda x: x IS NOT NULL), chr(10))) AS ids_sha256 FROM retrieval_results",
    "sc10_document_numbers": "SELECT document_number, count(*) AS n_documents, min(document_id) AS first_document, count(*) = 1 AS resolved FROM documents WHERE document_number IS NOT NULL GROUP BY 1",
    "tx39_hash_buckets": "SELECT record_id, CAST(('0x' || substr(sha256('quill' || chr(0) || question_id), 1, 16))::UBIGINT % 100 AS INTEGER) AS bucket FROM training_records",
    "tk08_hash_sample": "SELECT question_id, CAST(row_number() OVER (ORDER BY h, question_id) AS INTEGER) AS position FROM (SELECT DISTINCT question_id, sha256('dev-7' || chr(0) || question_id) AS h FROM training_records WHERE split = 'dev' AND question_id IS NOT NULL) QUALIFY position <= 200",
    "rt23_split_roles": f"""
        WITH r AS (SELECT record_id, {_norm("question")} AS g, answer, coalesce(split IN ('public', 'private'), false) AS p FROM training_records),
        g AS (SELECT g, bool_or(p) AS hp, count(DISTINCT CASE WHEN NOT p THEN answer END) AS a FROM r GROUP BY 1)
        SELECT record_id, CASE WHEN p THEN 'protected' WHEN r.g IS NULL THEN 'invalid' WHEN hp THEN 'quarantined' WHEN a > 1 THEN 'conflicting'
          WHEN ('0x' || substr(sha256('quill' || chr(0) || r.g), 1, 16))::UBIGINT % 100 < 10 THEN 'holdout' ELSE 'train' END AS role
        FROM r JOIN g ON r.g IS NOT DISTINCT FROM g.g""",
    "rt25_shards": "SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS position, CAST((row_number() OVER (ORDER BY question_id) - 1) % 4 AS INTEGER) AS shard FROM (SELECT DISTINCT question_id FROM training_records WHERE split = 'private' AND question_id IS NOT NULL)",
    "jn12_warmup_alias": f"""
        WITH r AS (SELECT *, {_norm("question")} AS g FROM ({_ANSWERED}))
        SELECT a.record_id AS warmup_id, b.record_id AS train_id, a.answer IS NOT DISTINCT FROM b.answer AS agrees FROM r a JOIN r b USING (g) WHERE a.source = 'warmup' AND b.source <> 'warmup'""",
    "tk13_numeric_order": """
        WITH o AS (SELECT DISTINCT question_id, CASE WHEN regexp_full_match(question_id, '[0-9]+') THEN 0 ELSE 1 END AS k, CASE WHEN regexp_full_match(question_id, '[0-9]+') THEN question_id::HUGEINT END AS n FROM training_records WHERE question_id IS NOT NULL)
        SELECT question_id, row_number() OVER (ORDER BY k, n, question_id) - 1 AS position FROM o""",
    "tx01_normalized_questions": f"SELECT record_id, {_norm('question')} AS normalized FROM training_records",
    "tx03_query_tokens": r"""
        WITH t AS (SELECT record_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(question), '[\p{L}\p{N}]+'), 1) AS i FROM training_records),
        f AS (SELECT record_id, w, min(i) AS i FROM t GROUP BY 1, 2), a AS (SELECT record_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS s FROM f GROUP BY 1)
        SELECT r.record_id, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens, coalesce(s, '') AS tokens FROM training_records r LEFT JOIN a USING (record_id)""",
    "tx05_longest_terms": r"""
        WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM eval_items),
        f AS (SELECT item_id, w, min(i) AS i FROM t GROUP BY 1, 2 HAVING length(w) >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS k FROM f)
        SELECT e.item_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM eval_items e LEFT JOIN (SELECT * FROM k WHERE k <= 8) USING (item_id) GROUP BY 1""",
    "tx12_chunk_ids": f"SELECT chunk_id, 'ctx-' || document_id || '::' || lpad(chunk_index::VARCHAR, 5, '0') || '::' || substr(sha256(text), 1, 12) AS expected_id FROM ({_CHUNKS})",
    "tx13_word_counts": f"SELECT chunk_id, CAST(len(regexp_extract_all(text, '[^' || substr('{_WS_JAVA}', 2) || '+')) AS INTEGER) AS n_words FROM ({_CHUNKS})",
    "tx15_enriched": f"""
        SELECT chunk_id, sha256(concat_ws(chr(10), CASE WHEN trim(c.source_title) <> '' THEN 'Tên nguồn: ' || trim(c.source_title) END, CASE WHEN trim(d.document_number) <> '' THEN 'Số văn bản: ' || trim(d.document_number) END,
          CASE WHEN trim(c.article_title) <> '' THEN 'Tiêu đề Điều: ' || trim(c.article_title) END, 'Nội dung:', c.text)) AS enriched_sha256 FROM ({_CHUNKS}) c LEFT JOIN documents d USING (document_id)""",
    "tx26_rouge_tokens": f"SELECT record_id, array_to_string(regexp_extract_all(lower(answer), '[a-z0-9]+'), ' ') AS tokens FROM ({_ANSWERED})",
    "ag14_paired_deltas": f"SELECT count(*) AS n, round(avg(d), 9) AS mean_delta, round(min(d), 9) AS min_delta, round(max(d), 9) AS max_delta, count(*) FILTER (WHERE d > 1e-6) AS improved, count(*) FILTER (WHERE d < -1e-6) AS worsened, count(*) FILTER (WHERE abs(d) <= 1e-6) AS tied FROM ({_DELTAS})",
    "ag17_gate": f"SELECT count(*) AS n, avg(d) > -0.01 AS mean_ok, count(*) FILTER (WHERE d > 1e-6) >= count(*) FILTER (WHERE d < -1e-6) AS more_better, avg(d) > -0.01 AND count(*) FILTER (WHERE d > 1e-6) >= count(*) FILTER (WHERE d < -1e-6) AS accepted FROM ({_DELTAS})",
    "ag12_optional_means": "SELECT split, round(avg(length(answer)), 6) AS answer_chars, round(avg(CASE WHEN lang = 'vi' THEN length(question) END), 6) AS question_chars, count(*) FILTER (WHERE answer IS NOT NULL) AS n_answer_chars, count(*) FILTER (WHERE lang = 'vi') AS n_question_chars FROM training_records WHERE split IS NOT NULL GROUP BY 1",
    "jn14_second_pass": f"""
        WITH r AS (SELECT * FROM ({_ANSWERED}) WHERE question_id IS NOT NULL), f AS (SELECT question_id, arg_min(answer, record_id) AS a FROM r GROUP BY 1), s AS (SELECT question_id, arg_max(answer, record_id) AS b FROM r WHERE source = 'official' GROUP BY 1)
        SELECT question_id, coalesce(b, a) AS answer, CASE WHEN b IS NOT NULL THEN 'second' ELSE 'first' END AS used_pass FROM f LEFT JOIN s USING (question_id)""",
    "ag18_best_variant": f"SELECT source AS best FROM (SELECT source, count(*) AS n, max(length(answer)) AS m FROM ({_ANSWERED}) WHERE source IS NOT NULL GROUP BY 1) ORDER BY n DESC, m DESC LIMIT 1",
    "ss01_remaining": "SELECT question_id FROM retrieval_results WHERE question_id IS NOT NULL GROUP BY 1 HAVING NOT coalesce(bool_or(sample_index > 1), false)",
    "ss_event_windows": _WINDOWS.format("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, * FROM events WHERE ts IS NOT NULL"),
    "ss_event_sliding": _WINDOWS.format("SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE AS window_start, e.* FROM events e, (VALUES (0), (1)) v(k) WHERE ts IS NOT NULL"),
    "ss_event_sessions": """
        WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM i GROUP BY user_id, k""",
}
