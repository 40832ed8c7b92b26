"""Scans of stored web pages and rule tables, and the remaining text extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework import tables
from clausework.functions import ids, similarity, spans, text as T
from clausework.operators import evidence as V, leaves as Lv
from clausework.plans.join_queries import REGISTRY_SQL, registry_best
from clausework.plans.oracle import LINES
from clausework.plans.registry import query
from clausework.plans.text_queries import MEASURED_SQL, measured_texts
from clausework.sources import readers

HTML_TEXT = "regexp_replace(regexp_replace(regexp_replace({0}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:p|div|br|li|ul|tr|h[1-6]|article|nav|table)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"


def _text_sql(col: str) -> str:
    out = _STRIPPED.format(col)
    for entity, char in readers.ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return HTML_TEXT.format(out)


@query(
    "scan_html_pages",
    f"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, sha256({_text_sql('html')}) AS text_hash,
       sha256({_text_sql("coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''), html)")}) AS main_hash,
       CAST(len(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""",
)
def scan_html_pages(spark, sf):
    pages = tables.load(spark, sf, "pages")
    links = readers.html_links(pages).groupBy("page_id").agg(F.count("*").alias("links"))
    out = readers.html_pages(pages).join(links, "page_id", "left")
    return out.select("page_id", "title", ids.sha256("text").alias("text_hash"), ids.sha256("main_text").alias("main_hash"), F.coalesce("links", F.lit(0)).alias("links"))


@query("html_links", """SELECT page_id, CAST(unnest(range(0, len(ls))) AS BIGINT) AS pos, unnest(ls) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1) AS ls FROM pages) s""")
def html_links(spark, sf):
    return readers.html_links(tables.load(spark, sf, "pages")).withColumn("pos", F.col("pos").cast("long"))


@query(
    "scan_registry_pages",
    "SELECT s_suppkey AS page_id, upper(regexp_replace(s_name, '[\\p{Cc}\\p{Cf}\\p{Z}]+', '', 'g')) AS number, n_name AS title, CASE WHEN s_acctbal > 0 THEN '现行' ELSE '废止' END AS status, '/detail/' || s_suppkey AS detail_path FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def scan_registry_pages(spark, sf):
    """Supplier rows rendered as saved result pages, then read back."""
    sup = tables.load(spark, sf, "supplier").join(tables.load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    html = F.concat(
        F.lit("<table><tr><td>1</td><td>"), "s_name", F.lit("</td>\n<td><a href=\"/detail/"), F.col("s_suppkey").cast("string"), F.lit("\">"), "n_name",
        F.lit("</a></td><td>2020-01-01</td><td>2020-06-01</td><td>"), F.when(F.col("s_acctbal") > 0, "现行").otherwise("废止"), F.lit("</td></tr></table>"),
    )
    return readers.registry_rows(sup.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))).select("page_id", "number", "title", "status", "detail_path")


@query("title_similarity")
def title_similarity(spark, sf):
    best = registry_best(spark, sf).where("registry_id is not null")
    a, b = T.normalize_title("title"), T.normalize_title("official_title")
    return best.select("document_id", F.round(similarity.block_ratio(a, b), 6).alias("ratio"), F.round(similarity.edit_ratio(a, b), 6).alias("edit_ratio"))


@query(
    "normalized_search_text",
    f"""WITH {MEASURED_SQL} SELECT document_id, copy, sha256(g0 || n0 || '米' || g1 || n1 || '千米' || g2 || n2 || '吨' || g3 || n3 || '毫米, 5 mg/L') AS text_hash, 4 AS measurements FROM m""",
)
def normalized_search_text(spark, sf):
    """Every measurement in canonical form, all else unchanged."""
    texts = measured_texts(spark, sf)
    return texts.select("document_id", "copy", ids.sha256(spans.canonical_text("text")).alias("text_hash"), F.size(spans.matches("text", spans.measure_pattern())).alias("measurements"))


@query(
    "definition_slot",
    f"WITH {LINES} SELECT document_id, unit_order, trim(coalesce(nullif(regexp_extract(text, '([0-9]+(?:[.][0-9]+)+[ \\n]*thanin[^\\n]*)', 1), ''), nullif(regexp_extract(text, '([0-9]+(?:[.][0-9]+)+[ \\n]*the[^\\n]*)', 1), ''))) AS definition FROM lines WHERE regexp_matches(text, '[0-9]+(?:[.][0-9]+)+[ \\n]*(?:thanin|the)')",
)
def definition_slot(spark, sf):
    return V.definition_slots(tables.line_units(spark, sf), ["the", "thanin"]).where("definition is not null").select("document_id", "unit_order", "definition")


@query("table_row_select", "SELECT l_orderkey AS table_id, 'flag：' || l_returnflag || '；status：' || l_linestatus || '；line：' || l_linenumber AS rendered FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def table_row_select(spark, sf):
    from clausework.plans.segment_queries import page_tables

    targets = spark.createDataFrame([("A",), ("R",)], "target string")
    return V.table_row_select(Lv.table_rows(page_tables(spark, sf)), targets, 200).select("table_id", "rendered")


@query(
    "scan_matrix_tables",
    "SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS row_no, concat_ws('|', l_returnflag, l_linestatus, l_linenumber) AS cells FROM lineitem",
)
def scan_matrix_tables(spark, sf):
    from clausework.plans.segment_queries import page_tables

    rows = Lv.table_rows(page_tables(spark, sf))
    return rows.select("table_id", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "|").alias("cells"))


@query(
    "reference_follow",
    """WITH c AS (SELECT l_orderkey AS document_id, 'A.' || l_linenumber AS label, l_partkey FROM lineitem), r AS (SELECT DISTINCT o_orderkey AS document_id, 'A.' || unnest(range(1, CAST(o_custkey % 4 AS BIGINT) + 2)) AS label FROM orders)
       SELECT document_id, label, l_partkey AS unit_id FROM r JOIN c USING (document_id, label)""",
)
def reference_follow(spark, sf):
    from clausework.operators import joins

    text = F.format_string("见表A.1～表A.%d", (F.col("o_custkey") % 4 + 1))
    candidates = tables.load(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), text.alias("text"))
    chunks = tables.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("A."), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_partkey").alias("unit_id"))
    return joins.reference_follow(candidates, chunks)


@query(
    "spacing_matrix",
    """SELECT l_orderkey AS document_id, CASE l_linenumber % 3 WHEN 0 THEN 'Ⅰ' WHEN 1 THEN 'Ⅱ' ELSE 'Ⅲ' END AS type, i AS column_no, CASE i WHEN 0 THEN l_linenumber || '~' || (l_linenumber + 100) ELSE ((l_partkey % 50) * i)::VARCHAR END AS spacing FROM lineitem, range(0, 4) r(i) WHERE l_returnflag = 'A'""",
)
def spacing_matrix(spark, sf):
    """Lines that state four ranges for a deposit type, from line items; others state nothing."""
    line = tables.load(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Ⅰ").when(F.col("l_linenumber") % 3 == 1, "Ⅱ").otherwise("Ⅲ")
    part = lambda i: ((F.col("l_partkey") % 50) * i).cast("string")
    stated = F.concat(kind, F.lit("类型 "), F.col("l_linenumber").cast("string"), F.lit("~"), (F.col("l_linenumber") + 100).cast("string"), *[x for i in (1, 2, 3) for x in (F.lit(" m，"), part(i))], F.lit(" m。"))
    rows = line.select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", stated).otherwise(F.lit("no ranges here")).alias("text"))
    return V.spacing_matrix(rows).select("document_id", "type", F.col("column_no").cast("long").alias("column_no"), "spacing")


@query(
    "projection_fact",
    """SELECT l_orderkey AS document_id, CASE l_linenumber % 3 WHEN 0 THEN 'finite' WHEN 1 THEN 'infinite' ELSE 'unspecified' END AS kind, '1/' || (l_partkey % 7 + 2) AS ratio, CASE WHEN l_linenumber % 2 = 0 THEN '平推' ELSE '尖推' END AS action,
       CASE l_linenumber % 3 WHEN 0 THEN '实际工程间距' WHEN 1 THEN '经验工程间距' ELSE '' END AS basis, CASE l_linenumber % 3 WHEN 0 THEN '有限外推按实际工程间距的' WHEN 1 THEN '无限外推取经验工程间距的' ELSE '推断取' END || '1/' || (l_partkey % 7 + 2) || CASE WHEN l_linenumber % 2 = 0 THEN '平推' ELSE '尖推' END || '。' AS segment FROM lineitem""",
)
def projection_fact(spark, sf):
    """Projection statements among other sentences, from line items."""
    way, number = F.col("l_linenumber") % 3, F.col("l_linenumber")
    head = F.when(way == 0, "有限外推按实际工程间距的").when(way == 1, "无限外推取经验工程间距的").otherwise("推断取")
    text = F.concat(F.lit("矿体长3米。"), head, F.lit("1/"), (F.col("l_partkey") % 7 + 2).cast("string"), F.when(number % 2 == 0, "平推").otherwise("尖推"), F.lit("。其余不计。"))
    return V.projection_facts(tables.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), text.alias("text")))


@query("publish_active_rules", "SELECT p_partkey AS lexicon_id, p_name AS expression, CAST(p_size AS BIGINT) AS priority FROM part WHERE p_size > 10")
def publish_active_rules(spark, sf):
    from clausework import scratch
    from clausework.sources import sinks

    status = F.when(F.col("p_size") > 10, "active").otherwise("draft")
    entries = tables.load(spark, sf, "part").select(F.col("p_partkey").alias("lexicon_id"), F.col("p_name").alias("expression"), F.col("p_size").cast("long").alias("priority"), status.alias("status"))
    path = f"{scratch.shared_folder(spark)}/rules-{scratch.unique()}"
    sinks.active_rules(entries.limit(0), path, 1)
    sinks.active_rules(entries, path, 2)
    return sinks.current_rules(spark, path).select("lexicon_id", "expression", "priority")


@query(
    "sink_jsonl",
    f"WITH {LINES} SELECT document_id, count(*) AS units, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY 1",
)
def sink_jsonl(spark, sf):
    from clausework import scratch
    from clausework.sources import sinks

    path = f"{scratch.shared_folder(spark)}/jsonl-{scratch.unique()}"
    sinks.jsonl(tables.line_units(spark, sf), path)
    back = readers.jsonl_log(spark, path, "document_id long, unit_order long, text string")
    return back.groupBy("document_id").agg(F.count("*").alias("units"), F.sum(F.char_length("text")).alias("chars"))
