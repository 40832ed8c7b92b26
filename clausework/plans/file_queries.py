"""Files written from the given tables into the shared folder and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework import scratch, tables
from clausework.operators import leaves
from clausework.plans.oracle import LINES
from clausework.plans.registry import query
from clausework.sources import readers, sinks


def _folder(spark, name):
    return f"{scratch.shared_folder(spark)}/{name}-{scratch.unique()}"


@query(
    "scan_jsonl_units",
    f"""WITH {LINES}, u AS (SELECT document_id || '-' || unit_order AS retrieval_unit_id, document_id::VARCHAR AS document_id, unit_order, text, unit_order % 3 <> 0 AS eligible FROM lines)
       SELECT document_id, count(*) AS units, CAST(sum(length(text)) AS BIGINT) AS chars, min(retrieval_unit_id) AS first_unit, 0::BIGINT AS violations FROM u WHERE eligible GROUP BY 1""",
)
def scan_jsonl_units(spark, sf):
    path = _folder(spark, "units")
    lines = tables.line_units(spark, sf)
    unit_id = F.concat_ws("-", "document_id", "unit_order")
    sinks.jsonl(lines.select(unit_id.alias("retrieval_unit_id"), F.col("document_id").cast("string").alias("document_id"), F.col("text").alias("citation_text"), (F.col("unit_order") % 3 != 0).alias("search_eligible")), path)
    units = readers.jsonl_units(spark, path)
    violations = readers.unit_violations(units).agg(F.count("*").alias("violations"))
    per_document = units.groupBy("document_id").agg(F.count("*").alias("units"), F.sum(F.char_length("citation_text")).alias("chars"), F.min("retrieval_unit_id").alias("first_unit"))
    return per_document.crossJoin(violations)  # one row of a global count


@query("scan_jsonl_log", "SELECT event_type, count(*) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def scan_jsonl_log(spark, sf):
    path = _folder(spark, "log")
    k = F.get_json_object("props", "$.k").cast("long")
    line = F.to_json(F.struct("event_id", "event_type", k.alias("k")))
    broken = F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line)  # a torn write
    tables.load(spark, sf, "events").select(broken.alias("value")).write.text(path)
    back = readers.jsonl_log(spark, path, "event_id long, event_type string, k long")
    return back.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("k").alias("k_sum"))


@query("sink_inventory", "SELECT doc_id AS document_id, lang, source, n_chars, FALSE AS holds_text, TRUE AS same FROM documents")
def sink_inventory(spark, sf):
    path = _folder(spark, "inventory")
    sinks.inventory(tables.load(spark, sf, "documents").withColumnRenamed("doc_id", "document_id"), path)
    schema = "document_id long, lang string, source string, n_chars long, text string"
    as_json = spark.read.schema(schema).json(f"{path}/json")
    as_csv = spark.read.schema("document_id long, lang string, source string, n_chars long").csv(f"{path}/csv", header=True, enforceSchema=False)
    same = F.hash("j.lang", "j.source", "j.n_chars") == F.hash("c.lang", "c.source", "c.n_chars")
    both = as_json.alias("j").join(as_csv.alias("c"), F.col("j.document_id") == F.col("c.document_id"))
    return both.select("j.document_id", "j.lang", "j.source", "j.n_chars", F.col("j.text").isNotNull().alias("holds_text"), same.alias("same"))


@query(
    "wide_page_split",
    """WITH l AS (SELECT l_orderkey AS document_id, 1 AS page_no, CAST(l_quantity * 10 AS INTEGER) AS x1, CAST(l_quantity * 10 AS INTEGER) + 50 AS x2, CAST(l_partkey % 1000 AS INTEGER) AS y1,
        CASE WHEN l_linenumber % 2 = 0 THEN '- ' || l_suppkey || ' -' ELSE 'line ' || l_partkey END AS text, l_linenumber::DOUBLE AS score FROM lineitem),
       s AS (SELECT *, CASE WHEN x1 + x2 < max(x2) OVER (PARTITION BY document_id, page_no) THEN 'left' ELSE 'right' END AS side FROM l),
       b AS (SELECT document_id, page_no, side, list(text ORDER BY y1, x1, text) AS ts, avg(score) AS score FROM s GROUP BY 1, 2, 3),
       m AS (SELECT *, CASE WHEN starts_with(ts[-1], '- ') THEN regexp_extract(ts[-1], '[0-9]+') END AS page_label FROM b)
       SELECT document_id, page_no, side, page_label, array_to_string(CASE WHEN page_label IS NULL THEN ts ELSE ts[:-2] END, chr(10)) AS text, round(score, 6) AS score FROM m""",
)
def wide_page_split(spark, sf):
    x1 = (F.col("l_quantity") * 10).cast("int")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("- "), F.col("l_suppkey"), F.lit(" -"))).otherwise(F.concat(F.lit("line "), F.col("l_partkey")))
    lines = tables.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_no"), x1.alias("x1"), (x1 + 50).alias("x2"), (F.col("l_partkey") % 1000).cast("int").alias("y1"), text.alias("text"), F.col("l_linenumber").cast("double").alias("score")
    )
    return leaves.wide_page_split(lines).withColumn("score", F.round("score", 6))


#: Records of one JSON file.
PER_FILE = 50


def _json_files(rows, bucket, path):
    """One JSON array per bucket of at most ``PER_FILE`` keys, each in a file of its own."""
    whole = rows.groupBy(bucket.alias("bucket")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("document_id", *[c for c in rows.columns if c != "document_id"])))).alias("value"))
    whole.repartition("bucket").write.partitionBy("bucket").text(path)
    return f"{path}/*"


@query(
    "scan_json_documents",
    f"""WITH {LINES}, p AS (SELECT document_id, unit_order AS page_no, sha256(text) AS text_hash, document_id || '#' || unit_order AS source_ref, (unit_order % 10) / 10.0::DOUBLE AS avg_score FROM lines)
       SELECT p.document_id::VARCHAR AS document_id, CAST(page_no AS INTEGER) AS page_no, text_hash, source_ref, avg_score, lang || '-' || p.document_id AS standard_no, source AS caption, lang || '|' || source AS header FROM p JOIN documents ON doc_id = p.document_id""",
)
def scan_json_documents(spark, sf):
    """Documents with nested pages and tables, written as JSON files and read back as three tables."""
    docs = tables.load(spark, sf, "documents")
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct(
        F.when(i % 2 == 0, (i + 1).cast("int")).alias("page_no"), t.alias("text"), F.concat(F.col("doc_id").cast("string"), F.lit("#"), (i + 1).cast("string")).alias("source_ref"), F.struct((((i + 1) % 10) / 10).alias("avg_score")).alias("quality")
    ))
    table = F.struct(F.col("source").alias("caption"), F.array(F.array("lang", "source"), F.array(F.lit("1"), F.lit("2"))).alias("matrix"))
    rows = docs.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", F.concat_ws("-", "lang", "doc_id").alias("standard_no"), pages.alias("pages"), F.array(table).alias("tables"))
    back = readers.json_documents(spark, _json_files(rows, F.floor(F.col("doc_id") / PER_FILE), _folder(spark, "documents")))
    documents, pages, matrices = back
    headers = matrices.select("document_id", "caption", F.array_join(F.get("matrix", 0), "|").alias("header"))
    return pages.join(documents.select("document_id", "standard_no"), "document_id").join(headers, "document_id").select(
        "document_id", "page_no", F.sha2("raw_text", 256).alias("text_hash"), "source_ref", "avg_score", "standard_no", "caption", "header"
    )


@query(
    "scan_ocr_pages",
    """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, 'part ' || l_partkey AS text, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount END AS score, CAST(l_quantity AS INTEGER) AS x1 FROM lineitem)
       SELECT l_orderkey::VARCHAR AS document_id, string_agg(text, chr(10) ORDER BY i) AS text, round(coalesce(avg(score), -1), 6) AS avg_score, count(*) AS lines, CAST(max(x1) AS INTEGER) AS right_most FROM l GROUP BY 1""",
)
def scan_ocr_pages(spark, sf):
    """Recognised lines with boxes and scores, written as JSON files and read back as pages with their confidence."""
    line = tables.load(spark, sf, "lineitem")
    x1 = F.col("l_quantity").cast("int")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.struct(F.concat(F.lit("part "), F.col("l_partkey")).alias("text"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount")).alias("score"), F.array(x1, F.lit(0), x1 + 9, F.lit(5)).alias("box")).alias("line"))
    rows = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["line"]).alias("lines"))
    pages = rows.select(F.col("l_orderkey").cast("string").alias("document_id"), "l_orderkey", F.lit(1).alias("page_no"), "lines")
    lines, pages = readers.ocr_pages(spark, _json_files(pages, F.floor(F.col("l_orderkey") / (20 * PER_FILE)), _folder(spark, "ocr")))
    counted = lines.groupBy("document_id").agg(F.count("*").alias("lines"), F.max("x1").alias("right_most"))
    return pages.join(counted, "document_id").select("document_id", "text", F.round(F.coalesce("avg_score", F.lit(-1.0)), 6).alias("avg_score"), "lines", "right_most")


def _folder_of(col):
    return F.regexp_extract(col, "source=([^/]*)/", 1)


@query(
    "scan_markdown_guides",
    """WITH c AS (SELECT source, lang, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY 1, 2), s AS (SELECT source, lang, docs, chars, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS section_no, sum(docs) OVER (PARTITION BY source) AS everything FROM c)
       SELECT source, 'Guide of ' || source AS title, CAST(everything AS BIGINT) AS declared, CAST(section_no AS BIGINT) AS section_no, 'Texts in ' || lang AS name, 'docs|' || docs AS first_row, 'chars|' || CAST(chars AS BIGINT) AS last_row, 'https://example.org/' || source AS link FROM s""",
)
def scan_markdown_guides(spark, sf):
    """One guide per source with front matter, a section per language, a link and a table; written as text and read back."""
    counts = tables.load(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    table = F.concat_ws("\n", F.lit("| what | n |"), F.lit("|---|---|"), F.concat(F.lit("| docs | "), "docs", F.lit(" |")), F.concat(F.lit("| chars | "), F.col("chars").cast("string"), F.lit(" |")))
    section = F.concat(F.lit("## Texts in "), "lang", F.lit("\n\nSee [all](https://example.org/"), "source", F.lit(").\n\n"), table)
    guide = counts.groupBy("source").agg(F.sum("docs").alias("docs"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lang", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("body"))
    text = F.concat(F.lit("---\nsource: "), "source", F.lit("\ndocs: '"), F.col("docs").cast("string"), F.lit("'\n---\n# Guide of "), "source", F.lit("\n\n"), "body")
    path = _folder(spark, "guides")
    guide.select("source", text.alias("value")).repartition("source").write.partitionBy("source").text(path)
    guides, sections, rows = readers.markdown_guides(spark, f"{path}/*")
    cells = rows.groupBy("path", "section_no").agg(F.min_by(F.array_join("cells", "|"), F.when(F.col("row_no") > 0, F.col("row_no"))).alias("first_row"), F.max_by(F.array_join("cells", "|"), "row_no").alias("last_row"))
    joined = guides.join(sections, "path").join(cells, ["path", "section_no"])
    return joined.select(
        _folder_of("path").alias("source"), "title", F.col("metadata")["docs"].cast("long").alias("declared"), F.col("section_no").cast("long").alias("section_no"), "name", "first_row", "last_row", F.get("links", 0).alias("link")
    )


@query(
    "scan_binary_inventory",
    """WITH a AS (SELECT source, 'texts=' || count(*) || ';chars=' || CAST(sum(n_chars) AS BIGINT) AS body FROM documents GROUP BY 1)
       SELECT source, true AS present, CAST(length(body) + 1 AS BIGINT) AS bytes, sha256(body || chr(10)) AS sha256 FROM a UNION ALL SELECT 'lost-' || source, false, 0, '' FROM a""",
)
def scan_binary_inventory(spark, sf):
    """Artifacts that exist, with size and digest, beside declared ones that do not."""
    body = F.concat(F.lit("texts="), F.count("*").cast("string"), F.lit(";chars="), F.sum("n_chars").cast("string"))
    path = _folder(spark, "artifacts")
    tables.load(spark, sf, "documents").groupBy("source").agg(body.alias("value")).repartition("source").write.partitionBy("source").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    lost = files.select(F.regexp_replace("path", "source=", "source=lost-").alias("path"))
    found = readers.binary_inventory(spark, path, files.unionByName(lost).unionByName(files))
    return found.select(_folder_of("path").alias("source"), F.col("exists").alias("present"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("sha256", F.lit("")).alias("sha256"))
