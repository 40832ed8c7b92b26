"""Segmentation and leaf derivation over document lines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from clausework import tables
from clausework.functions import ids, spans, text as T
from clausework.operators import leaves as V, segment as S
from clausework.plans.oracle import DOCS, LINES, compact
from clausework.plans.registry import query
from clausework.plans.text_queries import MEASURED_SQL, measured_texts


def docs(spark, sf):
    return tables.load(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")


SHORT_LINE, SECTION_LINE = 60, 30
UNITS_SQL = f"""{LINES}, l AS (SELECT document_id, trim(text) AS t, row_number() OVER (PARTITION BY document_id ORDER BY unit_order) AS i FROM lines WHERE trim(text) <> ''),
  f AS (SELECT *, i = 1 OR length(t) < {SHORT_LINE} AS starts, CASE WHEN length(t) < {SECTION_LINE} THEN t END AS head FROM l),
  u AS (SELECT *, sum(starts::INT) OVER (PARTITION BY document_id ORDER BY i) AS unit_order, last_value(head IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM f),
  cut AS (SELECT document_id, CAST(unit_order AS BIGINT) AS unit_order, string_agg(t, chr(10) ORDER BY i) AS unit_text, min(i) AS line_start, max(i) AS line_end, arg_min(coalesce(section, ''), i) AS section_path FROM u GROUP BY 1, 2)"""


def short_line_units(spark, sf):
    return S.structural_units(docs(spark, sf), lambda s: F.char_length(s) < SHORT_LINE, lambda s: F.char_length(s) < SECTION_LINE)


@query("structural_units", f"WITH {UNITS_SQL} SELECT document_id, unit_order, sha256(unit_text) AS text_hash, line_start, line_end, section_path FROM cut")
def structural_units(spark, sf):
    return short_line_units(spark, sf).select(
        "document_id", "unit_order", ids.sha256("unit_text").alias("text_hash"), "line_start", "line_end", F.coalesce("section_path", F.lit("")).alias("section_path")
    )


@query("clause_chunks")
def clause_chunks(spark, sf):
    return S.clause_chunks(docs(spark, sf), 1800).select("document_id", "unit_order", "piece", "chunk_no", ids.sha256("chunk_text").alias("text_hash"))


PACK_TARGET, PACK_LIMIT = 600, 900


@query(
    "greedy_pack",
    f"""WITH RECURSIVE {LINES}, p AS (SELECT document_id, text, row_number() OVER (PARTITION BY document_id ORDER BY unit_order) AS i FROM lines WHERE trim(text) <> ''),
      r AS (SELECT document_id, i, text AS open, 1::BIGINT AS chunk FROM p WHERE i = 1
        UNION ALL SELECT p.document_id, p.i, CASE WHEN length(r.open) >= {PACK_TARGET} OR length(r.open) + 1 + length(p.text) > {PACK_LIMIT} THEN p.text ELSE r.open || chr(10) || p.text END,
          r.chunk + (length(r.open) >= {PACK_TARGET} OR length(r.open) + 1 + length(p.text) > {PACK_LIMIT})::INT FROM r JOIN p ON p.document_id = r.document_id AND p.i = r.i + 1)
      SELECT document_id, chunk AS chunk_no, sha256(arg_max(open, i)) AS text_hash, CAST(max(length(open)) AS BIGINT) AS chars FROM r GROUP BY 1, 2""",
)
def greedy_pack(spark, sf):
    parts = F.filter(T.lines("text"), lambda s: F.trim(s) != "")
    rows = docs(spark, sf).select("document_id", F.posexplode(S.greedy_pack(parts, PACK_TARGET, PACK_LIMIT)).alias("pos", "chunk"))
    return rows.select("document_id", (F.col("pos") + 1).cast("long").alias("chunk_no"), ids.sha256("chunk").alias("text_hash"), F.char_length("chunk").cast("long").alias("chars"))


@query(
    "measurement_rows",
    f"""WITH {MEASURED_SQL} SELECT document_id, copy, CAST(char_start AS BIGINT) AS char_start, raw_value || unit AS raw_text,
       'measurement-' || substr(sha1(document_id || chr(10) || copy || chr(10) || char_start || chr(10) || raw_value || unit), 1, 16) AS measurement_id FROM measured""",
)
def measurement_rows(spark, sf):
    """Numbers with units, one identified row each."""
    return S.measurement_rows(measured_texts(spark, sf), ["document_id", "copy"], "text", spans.measure_pattern())


LEAF_SQL = f"""leaf AS (SELECT document_id, unit_order, text, length(text) >= 1200 AS is_long,
   CASE WHEN unit_order = 1 THEN 'front_matter' ELSE 'clause' END AS unit_type, length({compact('text')}) >= 8 AS enough FROM lines),
  leaves AS (SELECT *, CASE WHEN NOT is_long THEN 'source_unit_with_context' WHEN unit_type = 'front_matter' THEN 'long_front_matter_context_only' ELSE 'long_atomic_unit_retained' END AS derivation_method,
   unit_type <> 'front_matter' AS search_eligible,
   CASE WHEN is_long AND unit_type = 'front_matter' THEN 'context_only' WHEN is_long THEN 'review_required' WHEN unit_type <> 'front_matter' AND enough THEN 'pass' ELSE 'context_only' END AS review_status FROM leaf)"""


def leaf_rows(spark, sf):
    units = tables.line_units(spark, sf).withColumn("unit_type", F.when(F.col("unit_order") == 1, "front_matter").otherwise("clause"))
    return V.derive_leaves(units)


@query(
    "leaf_derivation",
    f"""WITH {LINES}, {LEAF_SQL} SELECT document_id, unit_order, derivation_method, search_eligible, review_status, review_status = 'pass' AS citation_eligible,
      'runit-' || substr(sha1(document_id || chr(10) || derivation_method || chr(10) || unit_order || chr(10) || text), 1, 16) AS leaf_id FROM leaves""",
)
def leaf_derivation(spark, sf):
    return leaf_rows(spark, sf).select("document_id", "unit_order", "derivation_method", "search_eligible", "review_status", "citation_eligible", "leaf_id")


@query(
    "parent_nodes",
    f"""WITH {UNITS_SQL}, n AS (SELECT document_id, unit_order, section_path, length(unit_text) >= 1200 AS is_long,
        'rparent-' || substr(sha1(document_id || chr(10) || 'document_parent'), 1, 16) AS d, 'rparent-' || substr(sha1(document_id || chr(10) || 'section_parent' || chr(10) || section_path), 1, 16) AS s FROM cut)
      SELECT DISTINCT d AS parent_id, 'document_parent' AS node_type, '' AS parent_ref, document_id FROM n
      UNION ALL SELECT DISTINCT s, 'section_parent', d, document_id FROM n WHERE section_path <> ''
      UNION ALL SELECT 'rparent-' || substr(sha1(document_id || chr(10) || 'long_source_parent' || chr(10) || unit_order), 1, 16), 'long_source_parent', CASE WHEN section_path = '' THEN d ELSE s END, document_id FROM n WHERE is_long""",
)
def parent_nodes(spark, sf):
    return V.parent_nodes(section_leaves(spark, sf))


def section_leaves(spark, sf):
    units = short_line_units(spark, sf)
    return units.select("document_id", "unit_order", F.coalesce("section_path", F.lit("")).alias("section_path"), (F.char_length("unit_text") >= V.LONG_LIMIT).alias("is_long"))


@query(
    "neighbor_context",
    f"""WITH {LINES}, s AS (SELECT *, (unit_order + 4) // 5 AS page FROM lines),
      n AS (SELECT document_id, unit_order, text, page, lag(text) OVER w AS p, lag(page) OVER w AS pp, lead(text) OVER w AS q, lead(page) OVER w AS qp FROM s WINDOW w AS (PARTITION BY document_id ORDER BY unit_order))
      SELECT document_id, unit_order, CASE WHEN length(text) >= 50 THEN '' ELSE concat_ws(chr(10), CASE WHEN pp = page THEN '前文：' || substr(trim(regexp_replace(p, '[ \\t\\r\\n]+', ' ', 'g')), 1, 180) END,
        CASE WHEN qp = page THEN '后文：' || substr(trim(regexp_replace(q, '[ \\t\\r\\n]+', ' ', 'g')), 1, 180) END) END AS context FROM n""",
)
def neighbor_context(spark, sf):
    units = tables.line_units(spark, sf).withColumn("page_start", F.ceil(F.col("unit_order") / 5)).withColumn("section_path", F.lit(None).cast("string"))
    return V.neighbor_context(units).select("document_id", "unit_order", F.col("neighbor_context").alias("context"))


@query(
    "context_header",
    f"""WITH {UNITS_SQL}, {DOCS} SELECT c.document_id, unit_order, concat_ws(chr(10), '文件：' || title, '标准号：' || corpus || '/' || document_type, CASE WHEN section_path <> '' THEN '章节：' || section_path END) AS header
      FROM cut c JOIN docs d ON d.document_id = c.document_id""",
)
def context_header(spark, sf):
    meta = tables.documents(spark, sf).select("document_id", "title", F.concat_ws("/", "corpus", "document_type").alias("number"))
    joined = short_line_units(spark, sf).join(meta, "document_id")
    header = V.context_header(F.col("title"), F.col("number"), F.col("section_path"), F.lit(None).cast("string"))
    return joined.select("document_id", "unit_order", header.alias("header"))


@query(
    "source_leaf_map",
    f"""WITH {LINES}, {LEAF_SQL} SELECT document_id || ':' || unit_order AS unit_id, CASE WHEN review_status = 'review_required' THEN 0 ELSE 1 END::BIGINT AS leaves,
      CASE WHEN review_status = 'review_required' THEN '' ELSE derivation_method END AS actions, review_status <> 'review_required' AS covered FROM leaves""",
)
def source_leaf_map(spark, sf):
    rows = leaf_rows(spark, sf).withColumn("unit_id", F.concat_ws(":", "document_id", "unit_order"))
    kept = rows.where("review_status <> 'review_required'").withColumn("source_unit_ids", F.array("unit_id"))
    return V.source_leaf_map(kept, rows.select("unit_id"))


@query(
    "cross_page_stitch",
    f"""WITH {UNITS_SQL}, w AS (SELECT document_id, unit_order, unnest(range((line_start + 4) // 5, (line_end + 4) // 5 + 1)) AS page_no FROM cut WHERE (line_end + 4) // 5 > (line_start + 4) // 5),
      p AS (SELECT document_id, (i + 4) // 5 AS page_no, sum(length(t)) > 400 AS ok FROM l GROUP BY 1, 2),
      c AS (SELECT w.document_id, unit_order, count(*) AS pages, count(*) FILTER (WHERE ok) AS with_text FROM w LEFT JOIN p USING (document_id, page_no) GROUP BY 1, 2)
      SELECT document_id || ':' || unit_order AS unit_id, pages, with_text, CASE WHEN pages = with_text THEN 'complete' WHEN with_text = 0 THEN 'missing' ELSE 'partial' END AS status FROM c""",
)
def cross_page_stitch(spark, sf):
    units = short_line_units(spark, sf).select(
        F.concat_ws(":", "document_id", "unit_order").alias("unit_id"), "document_id", F.ceil(F.col("line_start") / 5).alias("page_start"), F.ceil(F.col("line_end") / 5).alias("page_end")
    )
    filled = F.filter(F.transform(T.lines("text"), lambda s: F.trim(s)), lambda s: s != "")
    pages = docs(spark, sf).select("document_id", F.posexplode(filled).alias("i", "t")).groupBy("document_id", F.ceil((F.col("i") + 1) / 5).alias("page_no")).agg((F.sum(F.char_length("t")) > 400).alias("has_text"))
    return V.cross_page_status(units, pages)


@query(
    "dedup_pages_best",
    f"""WITH s AS (SELECT n_chars AS label, doc_id AS source_ref, text, (doc_id * 37) % 100 / 100.0::DOUBLE AS score, length({compact('text')}) AS n FROM documents),
      b AS (SELECT label, first(source_ref ORDER BY n DESC, score DESC, source_ref) AS source_ref, CAST(max(n) AS BIGINT) AS chars, count(*) AS candidates FROM s GROUP BY 1)
      SELECT * FROM b""",
)
def dedup_pages_best(spark, sf):
    segments = docs(spark, sf).select(F.col("n_chars").alias("label"), F.col("document_id").alias("source_ref"), "text", ((F.col("document_id") * 37) % 100 / 100.0).alias("score"))
    return V.best_page_per_label(segments, ["label"])


@query(
    "marker_views",
    """SELECT o_orderkey, application_type, o_orderpriority = required AS required FROM orders
       CROSS JOIN (VALUES ('new', '1-URGENT'), ('renewal', '2-HIGH'), ('transfer', '5-LOW')) v(application_type, required)""",
)
def marker_views(spark, sf):
    mark = lambda p: F.when(F.col("o_orderpriority") == p, "▲").otherwise("△")
    wide = tables.load(spark, sf, "orders").select("o_orderkey", mark("1-URGENT").alias("new"), mark("2-HIGH").alias("renewal"), mark("5-LOW").alias("transfer"))
    return V.marker_views(wide, ["o_orderkey"], ["new", "renewal", "transfer"])


def page_tables(spark, sf):
    """Line items of an order as a matrix with merged supplier-nation cells."""
    line = tables.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("items"))
    body = line.select("l_orderkey", F.transform("items", lambda x: F.array(x["l_returnflag"], x["l_linestatus"], x["l_linenumber"].cast("string"))).alias("body"))
    return body.select(
        F.col("l_orderkey").alias("table_id"), F.concat(F.lit("order "), F.col("l_orderkey")).alias("caption"),
        F.concat(F.array(F.array(F.lit("flag"), F.lit("status"), F.lit("line"))), "body").alias("matrix"),
    )


@query(
    "table_row_leaves",
    """SELECT l_orderkey AS table_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS BIGINT) AS row_no,
       'order ' || l_orderkey || chr(10) || 'flag：' || l_returnflag || '；status：' || l_linestatus || '；line：' || l_linenumber AS leaf_text FROM lineitem""",
)
def table_row_leaves(spark, sf):
    return V.table_row_leaves(page_tables(spark, sf)).withColumn("row_no", F.col("row_no").cast("long"))


@query("match_derived_sources")
def match_derived_sources(spark, sf):
    from clausework.operators import joins

    derived = tables.load(spark, sf, "benchmark").select(F.col("item_id").alias("derived_id"), F.col("text").alias("derived_text"))
    refs = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("derived_text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("ref")
    sources = tables.line_units(spark, sf)
    source_refs = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("ref")
    return joins.match_sources(derived.select("derived_id", "derived_text", refs), sources.select("document_id", "unit_order", F.col("text").alias("source_text"), source_refs))


PAD = "grade and depth of the ore body along the line " * 9
#: Units of every kind from line items: twelve neighbouring orders are the units of one document.
BRANCH_UNITS = f"""li AS (SELECT l_orderkey // 12 AS document_id, l_orderkey % 12 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i,
     'part ' || l_partkey || ' from supplier ' || l_suppkey AS line, l_returnflag, l_linestatus, l_linenumber FROM lineitem),
  pre AS (SELECT *, CASE WHEN kind IN (1, 4, 5) THEN i || '. ' WHEN kind = 3 THEN CASE WHEN i % 3 = 1 THEN '一、' ELSE '（' || i || '）' END WHEN kind = 2 THEN 'also '
     WHEN kind = 10 THEN CASE i WHEN 1 THEN '中华人民共和国标准发布 ' WHEN 2 THEN '前言 ' ELSE '' END WHEN kind = 11 AND i = 1 THEN '表 1 ' ELSE '' END || line || CASE WHEN kind IN (1, 2, 3, 4, 5, 10, 11) THEN ' {PAD.strip()}' ELSE '' END AS t FROM li),
  units AS (SELECT document_id, kind, kind + 1 AS unit_order, string_agg(t, chr(10) ORDER BY i) AS text, count(*) AS n,
     CASE WHEN document_id % 50 = 0 THEN true ELSE false END AS wide, CASE document_id % 3 WHEN 0 THEN 'governed_source' WHEN 1 THEN 'parsed_from_ocr' ELSE 'manually_curated_table' END AS validation,
     CASE WHEN kind IN (6, 7, 8) THEN 'table' WHEN kind = 9 THEN 'application_material_row' WHEN kind IN (4, 5) THEN 'front_matter' WHEN kind = 3 THEN 'policy_clause' ELSE 'clause' END AS unit_type,
     CASE kind WHEN 8 THEN 'S8 > 申请资料表' WHEN 9 THEN 'S8 > 材料 1 form' WHEN 0 THEN '' ELSE 'S' || kind END AS section_path, CASE WHEN kind % 2 = 1 THEN '5.' || kind ELSE '' END AS clause_no FROM pre GROUP BY 1, 2)"""


def branch_units(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    # An order is one unit, so that its short columns are dealt out once and the text is made inside its row.
    items = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = line.select("l_orderkey", items.alias("item")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    orders = orders.select((F.floor(F.col("l_orderkey") / 12)).alias("document_id"), (F.col("l_orderkey") % 12).alias("kind"), "items")
    kind = F.col("kind")

    def rendered(x, n):
        pos = (n + 1).cast("string")
        prefix = (
            F.when(kind.isin(1, 4, 5), F.concat(pos, F.lit(". ")))
            .when(kind == 3, F.when(n % 3 == 0, "一、").otherwise(F.concat(F.lit("（"), pos, F.lit("）"))))
            .when(kind == 2, "also ")
            .when(kind == 10, F.when(n == 0, "中华人民共和国标准发布 ").when(n == 1, "前言 ").otherwise(""))
            .when((kind == 11) & (n == 0), "表 1 ")
            .otherwise("")
        )
        line = F.concat_ws("", F.lit("part "), x["l_partkey"], F.lit(" from supplier "), x["l_suppkey"])
        return F.concat(prefix, line, F.when(kind.isin(1, 2, 3, 4, 5, 10, 11), F.lit(" " + PAD.strip())).otherwise(""))

    cells = lambda x: F.array(x["l_returnflag"], F.when(x["l_linestatus"] == "O", "").otherwise(x["l_linestatus"]), x["l_linenumber"].cast("string"))
    units = orders.select("document_id", "kind", F.transform("items", rendered).alias("lines"), F.when(kind.isin(6, 8), F.transform("items", cells)).alias("cells"))
    doc = F.col("document_id")
    return units.select(
        "document_id", (kind + 1).alias("unit_order"), "kind",
        F.when(kind.isin(6, 7, 8), "table").when(kind == 9, "application_material_row").when(kind.isin(4, 5), "front_matter").when(kind == 3, "policy_clause").otherwise("clause").alias("unit_type"),
        F.when(kind == 5, "第1号修改单").otherwise("standard").alias("title"),
        F.when(kind == 8, "S8 > 申请资料表").when(kind == 9, "S8 > 材料 1 form").when(kind == 0, "").otherwise(F.concat(F.lit("S"), kind.cast("string"))).alias("section_path"),
        F.when(kind % 2 == 1, F.concat(F.lit("5."), kind.cast("string"))).otherwise("").alias("clause_no"),
        F.when(doc % 3 == 0, "governed_source").when(doc % 3 == 1, "parsed_from_ocr").otherwise("manually_curated_table").alias("validation_status"),
        (doc % 50 == 0).alias("wide_layout"),
        F.array_join("lines", "\n").alias("text"),
        F.lit("").alias("caption"),
        F.when(kind.isin(6, 8), F.concat(F.array(F.array(F.lit("flag"), F.lit(""), F.lit("line"))), "cells")).alias("matrix"),
    )


BRANCHES = f"""{BRANCH_UNITS}, flags AS (SELECT *, length(text) >= 1200 AS long, kind = 4 AS front, unit_type <> 'table' AND wide AS replaced,
     kind = 10 AND n >= 2 AS stream, EXISTS (SELECT 1 FROM units r WHERE r.document_id = units.document_id AND r.kind = 9) AS has_rows, EXISTS (SELECT 1 FROM units r WHERE r.document_id = units.document_id AND r.kind = 8) AS has_table FROM units),
  cut_lines AS (SELECT p.document_id, p.kind, p.i, p.t, f.n, p.i = 1 OR p.kind IN (1, 3, 5) AS starts, CASE WHEN p.kind = 3 AND p.i % 3 = 1 THEN p.t END AS head
     FROM pre p JOIN flags f ON f.document_id = p.document_id AND f.kind = p.kind WHERE long AND NOT replaced AND p.kind IN (1, 3, 5)),
  blocks AS (SELECT document_id, kind, i AS piece, t AS citation_text, coalesce(substr(last_value(head IGNORE NULLS) OVER (PARTITION BY document_id, kind ORDER BY i), 1, 160), '') AS local_heading, n FROM cut_lines),
  rows_of AS (SELECT p.document_id, p.kind, p.i AS piece, 'S' || p.kind || chr(10) || 'flag：' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN '' ELSE chr(10) || '列2：' || l_linestatus END || chr(10) || 'line：' || l_linenumber AS citation_text
     FROM pre p WHERE p.kind = 6),
  out AS (
    SELECT f.document_id, f.unit_order, f.kind, 'explicit_numbered_subclause_split' AS derivation_method, b.piece, CASE WHEN clause_no = '' THEN 'part' ELSE clause_no END || '#' || b.piece AS clause_no, b.citation_text, b.local_heading, true AS search_eligible,
      true AS citation_eligible, 'pass' AS review_status FROM flags f JOIN blocks b ON b.document_id = f.document_id AND b.kind = f.kind
    UNION ALL SELECT f.document_id, f.unit_order, f.kind, 'structured_table_row', r.piece, 'row-' || r.piece, r.citation_text, '', true, validation <> 'parsed_from_ocr', CASE WHEN validation <> 'parsed_from_ocr' THEN 'pass' ELSE 'review_required' END FROM flags f JOIN rows_of r ON r.document_id = f.document_id AND r.kind = f.kind
    UNION ALL SELECT document_id, unit_order, kind, 'structured_table_row', u.i, 'row-' || u.i, section_path || chr(10) || 'flag：' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN '' ELSE chr(10) || '列2：' || l_linestatus END || chr(10) || 'line：' || l_linenumber, '', true, validation <> 'parsed_from_ocr', CASE WHEN validation <> 'parsed_from_ocr' THEN 'pass' ELSE 'review_required' END
      FROM flags JOIN pre u USING (document_id, kind) WHERE kind = 8 AND NOT has_rows
    UNION ALL SELECT document_id, unit_order, kind, CASE WHEN kind = 7 THEN 'table_without_structured_rows_retained' WHEN replaced THEN 'wide_layout_legacy_fallback' WHEN kind = 9 THEN 'application_material_row_linked' WHEN NOT long THEN 'source_unit_with_context'
        WHEN front THEN 'long_front_matter_context_only' WHEN stream THEN 'long_ocr_front_matter_context_only' WHEN kind = 11 THEN 'unstructured_table_like_unit_retained' ELSE 'long_atomic_unit_retained' END,
      0, clause_no, text, '', CASE WHEN kind IN (7, 9) THEN NOT replaced ELSE NOT replaced AND NOT front AND NOT (long AND stream) END,
      CASE WHEN kind = 7 OR replaced THEN false WHEN kind = 9 THEN true ELSE NOT long AND NOT front END,
      CASE WHEN kind = 7 THEN 'review_required' WHEN replaced THEN 'replaced_by_layout_reconstruction' WHEN kind = 9 THEN 'pass' WHEN NOT long THEN CASE WHEN front THEN 'context_only' ELSE 'pass' END WHEN front OR stream THEN 'context_only' ELSE 'review_required' END
      FROM flags WHERE kind NOT IN (6, 8) AND (replaced OR NOT (long AND kind IN (1, 3, 5)))),
  parents AS (SELECT f.document_id, f.kind, CASE WHEN unit_type = 'table' THEN 'table_parent' || chr(10) || unit_order WHEN kind = 9 AND NOT replaced THEN CASE WHEN has_table THEN 'table_parent' || chr(10) || 9 ELSE 'section_parent' || chr(10) || 'S8' END
      WHEN long AND NOT replaced AND kind IN (1, 3, 5) THEN 'long_source_parent' || chr(10) || unit_order WHEN section_path = '' THEN 'document_parent' ELSE 'section_parent' || chr(10) || section_path END AS node FROM flags f)"""


@query(
    "leaf_branches",
    f"""WITH {BRANCHES} SELECT o.document_id, unit_order, 'rparent-' || substr(sha1(o.document_id || chr(10) || node), 1, 16) AS parent_id, derivation_method, CAST(piece AS INTEGER) AS piece, clause_no, sha256(citation_text) AS text_hash, local_heading,
       search_eligible, citation_eligible, review_status, 'runit-' || substr(sha1(o.document_id || chr(10) || derivation_method || chr(10) || unit_order || chr(10) || piece || chr(10) || citation_text), 1, 16) AS leaf_id
     FROM out o JOIN parents p ON p.document_id = o.document_id AND p.kind = o.kind""",
)
def leaf_branches(spark, sf):
    """Leaves of every branch: cut clauses, table rows, linked material rows, front matter, streams and replaced layouts."""
    rows = V.branch_leaves(V.leaf_branches(branch_units(spark, sf)))
    return rows.withColumn("text_hash", ids.sha256("citation_text")).drop("citation_text")


@query(
    "leaf_actions",
    f"""WITH {BRANCHES}, made AS (SELECT document_id, kind, count(*) AS leaves FROM out GROUP BY 1, 2)
     SELECT f.document_id, f.unit_order, CASE WHEN f.kind = 8 AND has_rows THEN 'existing_application_rows_linked' WHEN f.kind IN (6, 8) THEN 'structured_table_rows_emitted:' || leaves WHEN f.kind = 7 THEN CASE WHEN long THEN 'long_table_retained_for_review' ELSE 'table_parent_created' END
       WHEN replaced THEN 'wide_layout_reconstructed' WHEN f.kind = 9 THEN 'application_row_retained' WHEN NOT long THEN '' WHEN f.kind IN (1, 3, 5) THEN 'split_at_explicit_boundaries:' || leaves
       WHEN front THEN 'front_matter_retained_as_context_only' WHEN stream THEN 'ocr_front_matter_retained_as_context_only' WHEN f.kind = 11 THEN 'table_like_source_retained_for_review' ELSE 'retained_no_safe_explicit_boundary' END AS action
     FROM flags f LEFT JOIN made m ON m.document_id = f.document_id AND m.kind = f.kind""",
)
def leaf_actions(spark, sf):
    return V.leaf_branches(branch_units(spark, sf)).select("document_id", "unit_order", "action")


@query(
    "explicit_block_split",
    f"""WITH {BRANCH_UNITS}, marked AS (SELECT document_id, kind, i, t, i = 1 OR kind IN (1, 3, 4, 5) AS starts, CASE WHEN kind = 3 AND i % 3 = 1 THEN t END AS head FROM pre),
       placed AS (SELECT document_id, kind, t, i, sum(starts::INT) OVER (PARTITION BY document_id, kind ORDER BY i) AS block_no, last_value(head IGNORE NULLS) OVER (PARTITION BY document_id, kind ORDER BY i) AS h FROM marked),
       cut AS (SELECT document_id, kind, block_no, string_agg(t, chr(10) ORDER BY i) AS block_text, substr(coalesce(arg_max(h, i), ''), 1, 160) AS local_heading, count(*) OVER (PARTITION BY document_id, kind) AS n FROM placed GROUP BY 1, 2, 3)
     SELECT document_id, kind + 1 AS unit_order, CAST(block_no AS INTEGER) AS block_no, sha256(block_text) AS text_hash, local_heading FROM cut WHERE n >= 2 AND n <= 50""",
)
def explicit_block_split(spark, sf):
    """Numbered units of every length, cut at their numbering."""
    units = branch_units(spark, sf)
    return S.explicit_blocks(units, "text", ["document_id", "unit_order"], F.col("unit_type") == "policy_clause").withColumn("text_hash", ids.sha256("block_text")).drop("block_text")
