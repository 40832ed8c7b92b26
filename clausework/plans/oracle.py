"""SQL fragments shared by the oracle queries (common table expressions)."""

DOCS = """docs AS (
  SELECT d.doc_id AS document_id, d.lang AS corpus, d.source AS document_type, 'internal' AS visibility,
         CASE WHEN l.toxic IS NULL THEN 'unverified' WHEN l.toxic = 1 THEN 'repealed' ELSE 'current' END AS effective_status,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'approved_for_service' ELSE 'pending_review' END AS review_status,
         d.text, d.n_chars, string_split(d.text, chr(10))[1] AS title
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

LINES = """lines AS (
  SELECT doc_id AS document_id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS unit_order, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) s)"""


def norm(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '[ \\t\\r\\n]+', ' ', 'g'))"


def compact(col: str) -> str:
    return f"regexp_replace(lower({col}), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"


UNITS = f"""units AS (
  SELECT document_id, unit_order, {norm('line')} AS search_text, {norm("lang || ' ' || source")} AS heading_text, {norm('title')} AS document_text
  FROM (SELECT doc_id AS document_id, lang, source, ls[1] AS title, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS unit_order, unnest(ls) AS line
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents) s) t)"""

TERMS = f"""chunks AS (SELECT item_id AS query_id, unnest(regexp_extract_all({norm('text')}, '[a-z]+(?:[/.-][a-z0-9]+)*|[0-9]+(?:[.][0-9]+)?')) AS term FROM benchmark),
terms AS (SELECT query_id, term, 2.5::DOUBLE AS weight, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS ordinal
  FROM (SELECT DISTINCT query_id, term FROM chunks WHERE length(term) >= 2) d QUALIFY ordinal <= 80),
tok_all AS (SELECT query_id, ordinal, CAST(unnest(range(1, len(ts) + 1)) AS BIGINT) AS pos, unnest(ts) AS token FROM (SELECT query_id, ordinal, regexp_extract_all(term, '[a-z0-9]+') AS ts FROM terms) s),
tok_first AS (SELECT query_id, token, min((ordinal, pos)) AS place FROM tok_all WHERE length(token) >= 2 GROUP BY 1, 2),
tokens AS (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY place, token) AS token_no FROM tok_first QUALIFY token_no <= 64),
unit_tokens AS (SELECT DISTINCT document_id, unit_order, token FROM (SELECT document_id, unit_order,
   unnest(regexp_extract_all(document_text || ' ' || heading_text || ' ' || search_text, '[a-z0-9]+')) AS token FROM units) s WHERE length(token) >= 2),
cands AS (SELECT DISTINCT query_id, document_id, unit_order FROM tokens JOIN unit_tokens USING (token)),
term_n AS (SELECT query_id, count(*) AS term_count FROM terms GROUP BY 1)"""


def occurrences(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {term}, ''))) // length({term}))"


def scored(name: str, scope: str) -> str:
    """CTEs that score every unit of ``scope`` (query_id, document_id, unit_order) as one scanned set."""
    tf = f"{occurrences('search_text', 'term')} + 1.35::DOUBLE * {occurrences('heading_text', 'term')} + 0.62::DOUBLE * {occurrences('document_text', 'term')}"
    return f"""{name}_set AS (SELECT s.query_id, u.*, greatest(length(search_text), 1) AS len FROM {scope} s JOIN units u USING (document_id, unit_order)),
{name}_n AS (SELECT query_id, count(*) AS n, avg(len) AS avg_len FROM {name}_set GROUP BY 1),
{name}_tf AS (SELECT query_id, document_id, unit_order, len, term, weight, {tf} AS tf FROM {name}_set JOIN terms USING (query_id)
   WHERE contains(search_text, term) OR contains(heading_text, term) OR contains(document_text, term)),
{name}_df AS (SELECT query_id, term, count(*) AS df FROM {name}_tf GROUP BY 1, 2),
{name} AS (SELECT query_id, document_id, unit_order, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) * weight)
   + 0.18::DOUBLE * count(*) / any_value(term_count), 9) AS score, count(*) AS matched_terms
   FROM {name}_tf JOIN {name}_df USING (query_id, term) JOIN {name}_n USING (query_id) JOIN term_n USING (query_id) GROUP BY 1, 2, 3)"""


RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched_terms DESC, document_id, unit_order)"
FIRST_STAGE = f"{UNITS}, {TERMS}, {scored('first', 'cands')}"
TWO_STAGE = f"""{FIRST_STAGE},
first_rank AS (SELECT *, {RANK} AS r FROM first),
doc_rank AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS document_rank FROM first_rank GROUP BY 1, 2),
scope AS (SELECT query_id, document_id, unit_order FROM doc_rank JOIN units USING (document_id) WHERE document_rank <= 30),
{scored('second', 'scope')},
lexical AS (SELECT query_id, document_id, unit_order, score, matched_terms, {RANK} AS rank FROM second QUALIFY rank <= 50)"""
