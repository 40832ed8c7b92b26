"""Independent SQL (DuckDB) of the queries that SQL can express, over the same table."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PASSAGES = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
  s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w),
  dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(array_to_string(ws[s:s + 19], ' ')) ORDER BY doc_id, s) AS nth FROM s) n WHERE nth > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM dup),
  each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS s FROM w WHERE len(ws) > 0),
  sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS g FROM s),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
  ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN ways ON x = other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id"""

MIXING = f"""WITH sizes AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
  own AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sizes GROUP BY 1),
  capped AS (SELECT *, CASE source_rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM own),
  filled AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY most / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
  lowest AS (SELECT level FROM filled WHERE level * weight <= most ORDER BY most / weight, source_rank LIMIT 1),
  targets AS (SELECT source, source_rank, source_size, least(most, coalesce((SELECT level FROM lowest) * weight, most)) AS target FROM filled),
  queue AS (SELECT doc_id, s.source, source_rank, size, source_size, target, md5('9:' || doc_id) AS turn,
    CAST(sum(size) OVER (PARTITION BY source_rank ORDER BY md5('9:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
  copies AS (SELECT doc_id, source_rank, turn, size, (before + size + round * source_size) / target AS finish FROM queue, (VALUES (0), (1)) r(round) WHERE size > 0),
  ordered AS (SELECT finish, sum(size) OVER (ORDER BY finish, source_rank, turn ROWS UNBOUNDED PRECEDING) AS total FROM copies),
  cut AS (SELECT max(finish) AS cut FROM ordered WHERE total <= (SELECT sum(target) FROM targets) * (1 + 1e-12::DOUBLE)),
  taken AS (SELECT doc_id, count(*) * any_value(size) AS taken FROM copies, cut WHERE finish <= cut GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM queue LEFT JOIN taken USING (doc_id)"""

# Quality rules: the statistics, the cells, and three concentration steps, each a group of common table expressions.

_DIMS = range(4)
_FLOORS = (350.0, 150.0, 400.0, 400.0)
_TRIANGLE = [(i, j) for i in _DIMS for j in range(i + 1)]


def _distance() -> str:
    ys = []
    for i in _DIMS:
        rest = f"x{i} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(i))
        ys.append(f"({rest}) / l{i}{i} AS y{i}")
    return ", ".join(ys) + ", y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3 AS distance"


def _least_bin(rows: str, keys: str, share: str, name: str) -> str:
    return f"""SELECT {keys}, min(bin) AS {name} FROM (SELECT {keys}, bin, sum(k) OVER (PARTITION BY {keys} ORDER BY bin) AS c, sum(k) OVER (PARTITION BY {keys}) AS n
      FROM (SELECT {keys}, bin, count(*) AS k FROM {rows} GROUP BY ALL) counts) sums WHERE c >= {share}::DOUBLE * n GROUP BY ALL"""


def _step(number: int) -> str:
    moments = ", ".join([f"sum(x{i})::DOUBLE AS s{i}" for i in _DIMS] + [f"sum(x{i} * x{j})::DOUBLE AS p{i}{j}" for i, j in _TRIANGLE])
    factors = [f"s{i} / n AS m{i}" for i in _DIMS]
    for i, j in _TRIANGLE:
        value = f"1.49::DOUBLE * (p{i}{j} / n - m{i} * m{j})" + (f" + {_FLOORS[i]**2}::DOUBLE" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        factors.append(f"sqrt({value}) AS l{i}{j}" if i == j else f"({value}) / l{j}{j} AS l{i}{j}")
    return f"""near{number} AS (SELECT cell, x0, x1, x2, x3, floor(ln(1 + distance) * 1000) AS bin FROM (SELECT *, {_distance()} FROM points JOIN est{number} USING (cell)) d),
  border{number} AS ({_least_bin(f"near{number}", "cell", "0.75", "border")}),
  moments{number} AS (SELECT cell, count(*)::DOUBLE AS n, {moments} FROM near{number} JOIN border{number} USING (cell) WHERE bin <= border GROUP BY 1),
  est{number + 1} AS (SELECT cell, {", ".join(factors)} FROM moments{number})"""


QUALITY = f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
  g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w) s),
  again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) c WHERE k > 1) r GROUP BY 1),
  stats AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN again USING (doc_id)),
  base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CAST(round(ln(1 + 100 * n_symbols / (word_chars + 50)::DOUBLE) * 1000) AS BIGINT) AS x0, CAST(round(ln((word_chars + 100) / (n_words + 20)::DOUBLE) * 1000) AS BIGINT) AS x1,
    CAST(round(ln(1 + 100 * n_repeat_words / (n_words + 20)::DOUBLE) * 1000) AS BIGINT) AS x2, CAST(round(ln(1 + 100 * n_dup_lines / (n_lines + 5)::DOUBLE) * 1000) AS BIGINT) AS x3 FROM stats),
  pairs AS (SELECT lang, source, count(*) AS n FROM base WHERE NOT base_failed GROUP BY 1, 2),
  pooled AS (SELECT *, sum(CASE WHEN n < 50 THEN n ELSE 0 END) OVER (PARTITION BY lang) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_all FROM pairs),
  rest AS (SELECT *, sum(CASE WHEN n < 50 AND lang_n < 50 THEN n ELSE 0 END) OVER () AS rest_n, sum(n) OVER () AS all_n, bool_or(n < 50 AND lang_n < 50 AND lang_all < 50) OVER () AS far, coalesce(lang, chr(1)) AS l FROM pooled),
  named AS (SELECT *, CASE WHEN n >= 50 THEN '1:' || l || chr(0) || coalesce(source, chr(1)) WHEN lang_n >= 50 THEN '2:' || l WHEN rest_n >= 50 THEN '3' WHEN lang_all >= 50 THEN '4:' || l WHEN all_n >= 50 THEN '5' END AS cell FROM rest),
  cells AS (SELECT lang, source, cell, list_distinct([cell, CASE WHEN rest_n < 50 AND lang_all >= 50 AND lang_n BETWEEN 1 AND 49 THEN '4:' || l END, CASE WHEN rest_n < 50 AND far AND all_n >= 50 THEN '5' END]) AS of_cells FROM named),
  tagged AS (SELECT b.*, cell, of_cells FROM base b LEFT JOIN cells c ON b.lang IS NOT DISTINCT FROM c.lang AND b.source IS NOT DISTINCT FROM c.source),
  points AS (SELECT cell, x0, x1, x2, x3 FROM (SELECT unnest(of_cells) AS cell, x0, x1, x2, x3 FROM tagged WHERE NOT base_failed) p WHERE cell IS NOT NULL),
  dims AS (SELECT cell, 0 AS dim, x0 AS bin FROM points UNION ALL SELECT cell, 1, x1 FROM points UNION ALL SELECT cell, 2, x2 FROM points UNION ALL SELECT cell, 3, x3 FROM points),
  medians AS ({_least_bin("dims", "cell, dim", "0.5", "median")}),
  est0 AS (SELECT cell, {", ".join(f"max(median) FILTER (WHERE dim = {i})::DOUBLE AS m{i}" for i in _DIMS)}, {", ".join(f"{_FLOORS[i] if i == j else 0.0}::DOUBLE AS l{i}{j}" for i, j in _TRIANGLE)} FROM medians GROUP BY 1),
  {_step(0)},
  {_step(1)},
  {_step(2)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(distance, 0) <= 25 AS kept
FROM (SELECT t.* EXCLUDE (of_cells), {_distance()} FROM tagged t LEFT JOIN est3 ON t.cell = est3.cell) d"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM lists GROUP BY 1),
runs AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM lists, range(1, 6) t(m)) s),
grams AS (SELECT lang, m, phrase, count(*) AS times FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 100),
parts AS (SELECT lang, m, phrase, times, string_split(phrase, ' ') AS ws FROM grams),
inner_runs AS (
  SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, times
  FROM (SELECT lang, ws, times, k, unnest(range(1, m - k + 2)) AS i FROM parts, range(2, 5) t(k) WHERE k < m) s),
dropped AS (SELECT DISTINCT g.lang, g.phrase FROM grams g JOIN inner_runs i ON g.lang = i.lang AND g.phrase = i.phrase AND 100 * i.times >= 100 * g.times),
cuts AS (
  SELECT lang, phrase, times AS a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM parts WHERE m > 1) s),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.times AS l, r.times AS r, n, (1000::HUGEINT * c.a * n) // (l.times::HUGEINT * r.times) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.head JOIN grams r ON r.lang = c.lang AND r.phrase = c.tail JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM weakest ANTI JOIN dropped USING (lang, phrase) QUALIFY rank <= 2000
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS w
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
