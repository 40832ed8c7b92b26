"""Text, hash, number and date columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from clausework import tables
from clausework.functions import ids, spans, text as T
from clausework.plans.oracle import DOCS, LINES, compact
from clausework.plans.registry import query

CLEAN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'),"
    " '\\x{{3000}}', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),"
    " '^[ \\n]+|[ \\n]+$', '', 'g')"
)


@query(
    "clean_display_text",
    f"""SELECT doc_id AS document_id, sha256({CLEAN_SQL.format('text')}) AS clean_hash,
        CAST(length({CLEAN_SQL.format('text')}) AS BIGINT) AS clean_length,
        {CLEAN_SQL.format('text')} <> text AS changed FROM documents""",
)
def clean_display_text(spark, sf):
    clean = T.clean_display("text")
    return tables.load(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        ids.sha256(clean).alias("clean_hash"),
        F.char_length(clean).cast("long").alias("clean_length"),
        (clean != F.col("text")).alias("changed"),
    )


@query(
    "remove_page_artifacts",
    """WITH d AS (SELECT page_id, string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM pages
          UNION ALL SELECT -1 - doc_id, string_split(text, chr(10)) FROM documents),
       f AS (SELECT page_id, len(ls) AS n, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
       m AS (SELECT *, (i <= 2 OR i > n - 2) AND (regexp_matches(trim(line), '^[-—–― ]*[0-9]{1,4}[-—–― ]*$')
            OR trim(line) IN ('一','二','三','四','五','六','七','八','九','十')) AS gone FROM f)
       SELECT page_id,
         sha256(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''), '^[ \\n]+|[ \\n]+$', '', 'g')) AS clean_hash,
         coalesce(string_agg(trim(line), '|' ORDER BY i) FILTER (WHERE gone), '') AS removed
       FROM m GROUP BY page_id""",
)
def remove_page_artifacts(spark, sf):
    web = tables.load(spark, sf, "pages").select(
        "page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text")
    )
    docs = tables.load(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("page_id"), "text")
    page = web.unionByName(docs).select("page_id", T.page_artifacts("text").alias("p"))
    return page.select(
        "page_id", ids.sha256("p.clean").alias("clean_hash"), F.array_join("p.removed", "|").alias("removed")
    )


NUMBER_TEXT = "p_brand || ' （' || p_size || '） — ' || lower(p_type)"


@query(
    "normalize_number",
    f"""SELECT p_partkey, upper(regexp_replace(translate({NUMBER_TEXT}, '（）—', '〔〕-'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Z}}]+', '', 'g')) AS number
        FROM part""",
)
def normalize_number(spark, sf):
    raw = F.concat(F.col("p_brand"), F.lit(" （"), F.col("p_size").cast("string"), F.lit("） — "), F.lower("p_type"))
    return tables.load(spark, sf, "part").select("p_partkey", T.normalize_number(raw).alias("number"))


@query(
    "normalize_title",
    f"""WITH {DOCS} SELECT document_id, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS title_key,
        {compact('title')} AS compact_key FROM docs""",
)
def normalize_title(spark, sf):
    return tables.documents(spark, sf).select(
        "document_id", T.normalize_title("title").alias("title_key"), T.compact("title").alias("compact_key")
    )


@query(
    "stable_id",
    f"""WITH {LINES} SELECT document_id, unit_order,
        'unit-' || substr(sha1(document_id || chr(10) || unit_order || chr(10) || text || chr(10)), 1, 16) AS unit_id FROM lines""",
)
def stable_id(spark, sf):
    return tables.line_units(spark, sf).select(
        "document_id",
        "unit_order",
        ids.stable_id("unit", "document_id", "unit_order", "text", F.lit(None)).alias("unit_id"),
    )


@query(
    "content_hashes",
    f"""SELECT doc_id AS document_id, sha256(text) AS content_hash,
        sha256(text) <> sha256({CLEAN_SQL.format('text')}) AS changed_since FROM documents""",
)
def content_hashes(spark, sf):
    return tables.load(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        ids.sha256("text").alias("content_hash"),
        (ids.sha256("text") != ids.sha256(T.clean_display("text"))).alias("changed_since"),
    )


SPAN_PATTERN = "[0-9]+(?:[.][0-9]+)?"
SPAN_CTE = f"""seg AS (SELECT doc_id, regexp_extract_all(text, '{SPAN_PATTERN}') AS found,
        string_split_regex(text, '{SPAN_PATTERN}') AS gaps FROM documents),
   spans AS (SELECT doc_id AS document_id, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM seg),
   placed AS (SELECT document_id, i, found[i] AS raw_value,
        list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0) AS char_start
        FROM spans)"""


@query(
    "digit_spans",
    f"""WITH {SPAN_CTE} SELECT document_id, CAST(char_start AS BIGINT) AS char_start,
        CAST(char_start + length(raw_value) AS BIGINT) AS char_end, raw_value FROM placed""",
)
def digit_spans(spark, sf):
    docs = tables.load(spark, sf, "documents")
    found = docs.select(F.col("doc_id").alias("document_id"), F.explode(spans.spans("text", SPAN_PATTERN)).alias("s"))
    return found.select(
        "document_id",
        F.col("s.char_start").cast("long").alias("char_start"),
        F.col("s.char_end").cast("long").alias("char_end"),
        F.col("s.raw").alias("raw_value"),
    )


#: Texts with units from line items: metres, kilometres, tonnes, millimetres, and a concentration that is none of them.
MEASURED_SQL = """m AS (SELECT l_orderkey * 100 + l_linenumber AS document_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS copy, 'bore ' AS g0, CAST(l_quantity AS BIGINT) || '.5' AS n0, ' along ' AS g1, l_partkey::VARCHAR AS n1,
     '，core ' AS g2, l_linenumber::VARCHAR AS n2, '; wall ' AS g3, l_suppkey::VARCHAR AS n3 FROM lineitem),
   parts AS (SELECT *, unnest([1, 2, 3, 4]) AS i FROM m),
   measured AS (SELECT document_id, copy, i, CASE i WHEN 1 THEN length(g0) WHEN 2 THEN length(g0 || n0 || ' m' || g1) WHEN 3 THEN length(g0 || n0 || ' m' || g1 || n1 || 'km' || g2) ELSE length(g0 || n0 || ' m' || g1 || n1 || 'km' || g2 || n2 || '吨' || g3) END AS char_start,
     CASE i WHEN 1 THEN n0 WHEN 2 THEN n1 WHEN 3 THEN n2 ELSE n3 END AS raw_value, CASE i WHEN 1 THEN ' m' WHEN 2 THEN 'km' WHEN 3 THEN '吨' ELSE ' 毫米' END AS unit, CASE i WHEN 1 THEN 'length_metre' WHEN 2 THEN 'length_kilometre' WHEN 3 THEN 'mass_tonne' ELSE 'length_millimetre' END AS unit_key,
     CASE i WHEN 1 THEN '米' WHEN 2 THEN '千米' WHEN 3 THEN '吨' ELSE '毫米' END AS label FROM parts)"""


def measured_texts(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    whole = lambda c: F.col(c).cast("long").cast("string")
    text = F.concat(F.lit("bore "), whole("l_quantity"), F.lit(".5 m along "), whole("l_partkey"), F.lit("km，core "), whole("l_linenumber"), F.lit("吨; wall "), whole("l_suppkey"), F.lit(" 毫米, 5 mg/L"))
    return line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("document_id"), copy.cast("long").alias("copy"), text.alias("text"))


@query(
    "extract_measurements",
    f"""WITH {MEASURED_SQL} SELECT document_id, copy, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(raw_value || unit) AS BIGINT) AS char_end, raw_value || unit AS raw_text, raw_value, trim(unit) AS raw_unit, unit_key, raw_value || label AS canonical_text FROM measured""",
)
def extract_measurements(spark, sf):
    found = measured_texts(spark, sf).select("document_id", "copy", F.inline(spans.measurements("text")))
    return found.select("document_id", "copy", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "raw_text", "raw_value", "raw_unit", "unit_key", "canonical_text")


CLAUSE_SQL = """coalesce(nullif(regexp_extract(t, '^((?:[0-9]+|[A-Z])(?:[.．][0-9A-Z]+){0,6})(?:[ \\t]|[\\x{4e00}-\\x{9fff}（(])', 1), ''),
   nullif(regexp_extract(substr(t, 1, 100), '(?:^|[ \\t。；;，,])((?:[1-9][0-9]?|[A-Z])(?:[.．][0-9A-Z]+){1,6})[ \\t]*[\\x{4e00}-\\x{9fff}（(]', 1), ''))"""


@query(
    "infer_clause_no",
    f"""WITH {LINES}, s AS (SELECT document_id, unit_order, trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS t FROM lines)
        SELECT document_id, unit_order, coalesce({CLAUSE_SQL}, '') AS clause_no FROM s""",
)
def infer_clause_no(spark, sf):
    return tables.line_units(spark, sf).select(
        "document_id", "unit_order", F.coalesce(T.infer_clause_no("text"), F.lit("")).alias("clause_no")
    )


@query(
    "parent_clause",
    """WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)+')) AS clause FROM documents
          UNION SELECT l_orderkey || '.' || l_suppkey || '.' || l_linenumber FROM lineitem)
       SELECT clause, CASE WHEN regexp_matches(clause, '^[0-9]+([.][0-9]+){2,}$') THEN regexp_replace(clause, '[.][0-9]+$', '') ELSE '' END AS parent,
         TRY_CAST(regexp_extract(clause, '[0-9]+$') AS BIGINT) AS final_number FROM r""",
)
def parent_clause(spark, sf):
    found = tables.load(spark, sf, "documents").select(
        F.explode(spans.matches("text", T.DOTTED_REF)).alias("clause")
    )
    keyed = tables.load(spark, sf, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_suppkey", "l_linenumber").alias("clause")
    )
    return found.unionByName(keyed).distinct().select(
        "clause",
        F.coalesce(T.parent_clause("clause"), F.lit("")).alias("parent"),
        T.final_number("clause").alias("final_number"),
    )


@query(
    "clause_refs",
    """WITH catalog AS (SELECT DISTINCT doc_id AS owner, unnest(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)+')) AS clause FROM documents),
       refs AS (SELECT DISTINCT clause AS ref FROM catalog UNION
                SELECT DISTINCT regexp_extract(clause, '^[0-9]+[.][0-9]+') FROM catalog)
       SELECT ref, owner AS document_id, count(*) AS clauses FROM refs JOIN catalog ON clause = ref OR starts_with(clause, ref || '.')
       GROUP BY ref, owner""",
)
def clause_refs(spark, sf):
    from clausework.operators import joins

    docs = tables.load(spark, sf, "documents")
    catalog = docs.select(
        F.col("doc_id").alias("document_id"), F.explode(F.array_distinct(spans.matches("text", T.DOTTED_REF))).alias("clause")
    )
    stems = catalog.select(F.regexp_extract("clause", "^[0-9]+[.][0-9]+", 0).alias("ref"))
    refs = catalog.select(F.col("clause").alias("ref")).unionByName(stems).distinct()
    hits = joins.clause_prefix_join(refs, catalog)
    return hits.groupBy("ref", "document_id").agg(F.count("*").alias("clauses"))


DATE_SQL = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y年%-m月%-d日') WHEN 1 THEN strftime(o_orderdate, 'on %Y-%m-%d')
   WHEN 2 THEN strftime(o_orderdate, '%Y.%-d.%-m') ELSE o_orderstatus END"""


@query(
    "parse_loose_date",
    f"""WITH s AS (SELECT o_orderkey, {DATE_SQL} AS raw FROM orders),
       p AS (SELECT *, regexp_extract(raw, '([0-9]{{4}})[ ]*(?:年|[-/.])[ ]*([0-9]{{1,2}})[ ]*(?:月|[-/.])[ ]*([0-9]{{1,2}})', ['y', 'm', 'd']) AS g FROM s)
       SELECT o_orderkey, raw, coalesce(CAST(TRY_CAST(g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') AS DATE) AS VARCHAR), '') AS day FROM p""",
)
def parse_loose_date(spark, sf):
    ts, key = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = (
        F.when(key == 0, F.date_format(ts.cast("timestamp"), "yyyy年M月d日"))
        .when(key == 1, F.date_format(ts.cast("timestamp"), "'on' yyyy-MM-dd"))
        .when(key == 2, F.date_format(ts.cast("timestamp"), "yyyy.d.M"))
        .otherwise(F.col("o_orderstatus"))
    )
    return tables.load(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn(
        "day", F.coalesce(T.loose_date("raw").cast("string"), F.lit(""))
    )


@query(
    "table_references",
    """WITH o AS (SELECT l_orderkey, min(l_suppkey % 30) AS lo, max(l_suppkey % 30) AS hi, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
       wide AS (SELECT l_orderkey, 'A.' || unnest(range(lo, hi + 1)) AS label FROM o WHERE hi - lo <= 20),
       one AS (SELECT l_orderkey, unnest(['A.' || lo, 'A.' || hi, 'B.' || n]) AS label FROM o)
       SELECT l_orderkey, label FROM wide UNION SELECT l_orderkey, label FROM one""",
)
def table_references(spark, sf):
    per_order = tables.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.col("l_suppkey") % 30).alias("lo"), F.max(F.col("l_suppkey") % 30).alias("hi"), F.max("l_linenumber").alias("n")
    )
    sentence = F.format_string("见表 A.%d ~ 表 a.%d 和表B.%d", "lo", "hi", "n")
    return per_order.select("l_orderkey", F.explode(T.table_references(sentence)).alias("label"))


SENTENCES_SQL = """clean AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents),
   cut AS (SELECT doc_id, t,
      list_filter(list_transform(string_split(regexp_replace(t, '([。！？；;.!?])[ ]*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ends,
      list_filter(list_transform(string_split(regexp_replace(t, '([，,、])[ ]*', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS commas FROM clean),
   picked AS (SELECT doc_id AS document_id, CASE WHEN len(ends) <= 1 AND length(t) > 120 THEN commas ELSE ends END AS ss FROM cut),
   sentences AS (SELECT document_id, CAST(unnest(range(1, len(ss) + 1)) AS BIGINT) AS sentence_no, unnest(ss) AS sentence FROM picked)"""


@query("split_sentences", f"WITH {SENTENCES_SQL} SELECT document_id, sentence_no, sentence FROM sentences")
def split_sentences(spark, sf):
    return sentence_rows(tables.load(spark, sf, "documents"))


def sentence_rows(docs):
    return docs.select(
        F.col("doc_id").alias("document_id"), F.posexplode(T.split_sentences("text")).alias("pos", "sentence")
    ).select("document_id", (F.col("pos") + 1).cast("long").alias("sentence_no"), "sentence")


# Rule table used by the anchor queries: alternatives of anchor groups.
ANCHOR_ALTERNATIVES = (("the", "tion", "and"), ("les", "eau"), ("licen", "version"))


@query(
    "anchor_group_contains",
    f"""WITH {LINES}, s AS (SELECT document_id, unit_order, lower(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g')) AS t FROM lines)
       SELECT document_id, unit_order, {' OR '.join('(' + ' AND '.join(f"contains(t, '{a}')" for a in g) + ')' for g in ANCHOR_ALTERNATIVES)} AS matched FROM s""",
)
def anchor_group_contains(spark, sf):
    alternatives = F.array(*[F.array(*[F.lit(a) for a in g]) for g in ANCHOR_ALTERNATIVES])
    return tables.line_units(spark, sf).select(
        "document_id", "unit_order", T.any_alternative_match("text", alternatives).alias("matched")
    )


# Fixed rule table of this query: spelling variants rewritten before matching.
REWRITES = (("the", "le"), ("tion", "cion"), ("  ", " "))


@query(
    "query_normalize",
    """SELECT item_id AS query_id, replace(replace(replace(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), 'the', 'le'), 'tion', 'cion'), '  ', ' ') AS question
       FROM benchmark
       UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, replace(replace(replace(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), 'the', 'le'), 'tion', 'cion'), '  ', ' ')
       FROM conversations WHERE role = 'user'""",
)
def query_normalize(spark, sf):
    asked = tables.queries(spark, sf)
    turns = tables.load(spark, sf, "conversations").where("role = 'user'").select(
        (F.lit(1000000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )
    out = T.normalize("question")
    for old, new in REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return asked.unionByName(turns).select("query_id", out.alias("question"))


IDENTIFIERS = "[A-Z]+-[0-9]+|[A-Za-z]+[ ]License|[0-9]+(?:[.][0-9]+)+"


@query(
    "extract_identifiers",
    f"""WITH m AS (SELECT doc_id, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS identifier
          FROM (SELECT doc_id, regexp_extract_all(text, '{IDENTIFIERS}') AS ids FROM documents) s),
        f AS (SELECT doc_id, identifier, min(pos) AS pos FROM m GROUP BY 1, 2)
        SELECT doc_id AS document_id, identifier, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS ordinal FROM f""",
)
def extract_identifiers(spark, sf):
    found = F.array_distinct(spans.matches("text", IDENTIFIERS))
    return tables.load(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.posexplode(found).alias("pos", "identifier")
    ).select("document_id", "identifier", (F.col("pos") + 1).cast("long").alias("ordinal"))


@query(
    "contextualize_followup",
    """WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user')
       SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND (length(text) < 60 OR regexp_matches(lower(text), '^(and|et|und|y|it|that|this)[ ,]'))
         THEN prev || chr(10) || text ELSE text END AS question FROM u""",
)
def contextualize_followup(spark, sf):
    from clausework.operators import ranking

    user = tables.load(spark, sf, "conversations").where("role = 'user'")
    marker = (F.char_length("text") < 60) | F.lower("text").rlike("^(and|et|und|y|it|that|this)[ ,]")
    return ranking.with_previous_turn(user, "conv_id", "turn", "text", marker).select("conv_id", "turn", "question")


@query(
    "length_band",
    f"""WITH {LINES} SELECT document_id, unit_order, CASE WHEN length(text) < 20 THEN '<20' WHEN length(text) < 50 THEN '20-49'
        WHEN length(text) < 150 THEN '50-149' WHEN length(text) < 300 THEN '150-299' WHEN length(text) < 600 THEN '300-599'
        WHEN length(text) < 1200 THEN '600-1199' ELSE '>=1200' END AS band FROM lines""",
)
def length_band(spark, sf):
    return tables.line_units(spark, sf).select(
        "document_id", "unit_order", T.length_band(F.char_length("text")).alias("band")
    )


@query(
    "page_class",
    """WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t,
          length(regexp_replace(html, '<[^>]*>', '', 'g')) / CAST(length(html) AS DOUBLE) AS ink FROM pages
        UNION ALL SELECT -1 - doc_id, trim(regexp_replace(regexp_replace(text, '[\\p{L} .,:;!?|]+', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), n_chars % 100 / 2000.0::DOUBLE FROM documents)
       SELECT page_id, CASE WHEN t = '' AND ink < 0.01::DOUBLE THEN 'blank_page' WHEN t = '' THEN 'scan_artifact_only' ELSE 'substantive_content' END AS class FROM p""",
)
def page_class(spark, sf):
    bare = F.regexp_replace("html", "<[^>]*>", " ")
    web = tables.load(spark, sf, "pages").select(
        "page_id",
        bare.alias("text"),
        (F.char_length(F.regexp_replace("html", "<[^>]*>", "")) / F.char_length("html")).alias("ink"),
    )
    # The layer of a document without words: blank for most pages, which gives the blank and artifact classes.
    scans = tables.load(spark, sf, "documents").select(
        (-1 - F.col("doc_id")).alias("page_id"),
        F.regexp_replace("text", "[\\p{L} .,:;!?|]+", "").alias("text"),
        (F.col("n_chars") % 100 / 2000.0).alias("ink"),
    )
    return web.unionByName(scans).select("page_id", T.page_class("text", "ink").alias("class"))


@query(
    "identity_present",
    f"""WITH {DOCS}, n AS (SELECT document_id, regexp_replace(upper(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS body, title,
          regexp_replace(upper(corpus || document_type), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS code FROM docs),
        w AS (SELECT *, regexp_replace(upper(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS whole,
          list_filter(list_transform(string_split_regex(title, '[、，,：: \\t\\r\\n]+'), lambda s: regexp_replace(upper(s), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda s: length(s) >= 4) AS terms FROM n)
        SELECT document_id, (code <> '' AND contains(body, code)) OR (whole <> '' AND contains(body, whole))
          OR (len(terms) > 0 AND len(list_filter(terms, lambda s: contains(body, s))) >= least(2, len(terms))) AS present FROM w""",
)
def identity_present(spark, sf):
    docs = tables.documents(spark, sf)
    number = F.concat("corpus", "document_type")
    return docs.select("document_id", T.identity_present("text", number, "title").alias("present"))


@query(
    "unstructured_table_flag",
    f"""WITH {LINES}, s AS (SELECT document_id, trim(text) AS t FROM lines WHERE trim(text) <> ''),
       g AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(t, '^[-+<≥≤~～—./0-9%°℃mMkKgGtTPa]+$')) AS numeric_lines,
         count(*) FILTER (WHERE length({compact('t')}) <= 6) AS short_lines, bool_or(regexp_matches(t, '^(?:表|续表)[ \\t]*[A-Za-z0-9]')) AS caption FROM s GROUP BY 1)
       SELECT doc_id AS document_id, coalesce(caption OR (n >= 30 AND (numeric_lines / n::DOUBLE >= 0.20::DOUBLE OR short_lines / n::DOUBLE >= 0.55::DOUBLE)), false) AS table_like,
         contains(substr(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g'), 1, 500), '目录') AND (length(text) - length(replace(text, '......', ''))) / 6 >= 3 AS front_matter
       FROM documents LEFT JOIN g ON g.document_id = doc_id""",
)
def unstructured_table_flag(spark, sf):
    return tables.load(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        T.unstructured_table_flag("text").alias("table_like"),
        T.front_matter_flag("text").alias("front_matter"),
    )


VALUES_SQL = """list_distinct(list_concat(list_concat(regexp_extract_all({0}, '[0-9]+(?:[.][0-9]+)?(?:%|％|万元|元|米|年|日|天)?'),
   regexp_extract_all({0}, '[0-9]+/[0-9]+')), regexp_extract_all({0}, '[0-9]{{4}}[-/.年][0-9]{{1,2}}[-/.月][0-9]{{1,2}}')))"""
GROUND_SQL = "upper(regexp_replace(replace({0}, 'ß', 'SS'), '[ \\t\\r\\n\\-－—~～,，。；;:：()（）\\[\\]【】]', '', 'g'))"


@query(
    "concrete_values",
    f"""SELECT doc_id AS document_id, array_to_string(list_sort({VALUES_SQL.format('text')}), '|') AS concrete,
        sha256({GROUND_SQL.format('text')}) AS grounding_hash FROM documents""",
)
def concrete_values(spark, sf):
    return tables.load(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.array_join(F.sort_array(T.concrete_values("text")), "|").alias("concrete"),
        ids.sha256(T.grounding_norm("text")).alias("grounding_hash"),
    )


@query(
    "vector_normalize",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
       SELECT vec_id, CAST(unnest(range(0, len(v))) AS BIGINT) AS dim, round(unnest(list_transform(v, lambda x: x / norm)), 6) AS w FROM n WHERE norm > 0 AND len(v) = 64""",
)
def vector_normalize(spark, sf):
    from clausework.functions import vectors as V

    unit = tables.load(spark, sf, "embeddings").select("vec_id", V.l2_normalize("embedding", 64).alias("v"))
    return unit.where("v is not null").select("vec_id", F.posexplode("v").alias("dim", "w")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), F.round("w", 6).alias("w")
    )
