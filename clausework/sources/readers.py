"""Readers: files and saved pages into the logical tables. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from clausework.functions import ids, text as T

DOCUMENT_SCHEMA = (
    "document_id string, standard_no string, title string, status string, review_status string, "
    "pages array<struct<page_no:int, text:string, source_ref:string, quality:struct<avg_score:double>>>, "
    "tables array<struct<caption:string, matrix:array<array<string>>>>"
)
UNIT_SCHEMA = (
    "retrieval_unit_id string, document_id string, corpus string, title string, standard_no string, unit_type string, section_path string, "
    "clause_no string, page_start int, citation_text string, search_text string, search_eligible boolean, citation_eligible boolean"
)
OCR_SCHEMA = "document_id string, page_no int, lines array<struct<text:string, score:double, box:array<int>>>"


def json_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One JSON document per file: (documents, pages, tables)."""
    raw = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    pages = raw.select("document_id", F.posexplode("pages").alias("pos", "p")).select(
        "document_id", F.coalesce("p.page_no", F.col("pos") + 1).alias("page_no"), F.col("p.text").alias("raw_text"), "p.source_ref", F.col("p.quality.avg_score").alias("avg_score")
    )
    tables = raw.select("document_id", F.posexplode("tables").alias("table_no", "t")).select("document_id", "table_no", "t.caption", "t.matrix")
    return raw.drop("pages", "tables"), pages, tables


def jsonl_units(spark: SparkSession, path: str) -> DataFrame:
    """Search-eligible leaves."""
    return spark.read.schema(UNIT_SCHEMA).json(path).where("search_eligible")


def unit_violations(units: DataFrame) -> DataFrame:
    """Repeated unit ids, and one row where the set is empty."""
    repeated = units.groupBy("retrieval_unit_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("violation"), F.col("retrieval_unit_id").alias("detail"))
    empty = units.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_set").alias("violation"), F.lit("").alias("detail"))
    return repeated.unionByName(empty)


def jsonl_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append log; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def markdown_guides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text files with front matter: (guides, sections, table rows)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    head = F.regexp_extract("value", "(?s)^---\n(.*?)\n---", 1)
    body = F.regexp_replace("value", "(?s)^---\n.*?\n---\n?", "")
    pairs = F.transform(
        F.filter(F.split(head, "\n"), lambda s: s.rlike("^[A-Za-z0-9_]+:")),
        lambda s: F.struct(F.regexp_extract(s, "^([A-Za-z0-9_]+):", 1).alias("key"), F.regexp_replace(F.regexp_extract(s, "^[A-Za-z0-9_]+:[ ]*(.*?)[ ]*$", 1), "^[\"']|[\"']$", "").alias("value")),
    )
    guides = raw.select(
        "path", F.map_from_entries(pairs).alias("metadata"), F.regexp_extract(body, "(?m)^#[ ]+(.+?)[ ]*$", 1).alias("title"), body.alias("body"),
        F.regexp_extract_all(body, F.lit("\\[[^\\]]*\\]\\(([^)]+)\\)"), F.lit(1)).alias("links"),
    )
    parts = guides.select("path", F.posexplode(F.slice(F.split("body", "(?m)^##[ ]+"), 2, F.char_length("body") + 1)).alias("section_no", "part"))
    sections = parts.select("path", "section_no", F.trim(F.element_at(F.split("part", "\n"), 1)).alias("name"), F.trim(F.regexp_replace("part", "^[^\n]*\n?", "")).alias("text"))
    row = F.filter(F.split("text", "\n"), lambda s: s.rlike("^[ ]*[|].*[|][ ]*$") & ~s.rlike("^[ |:-]+$"))
    cells = sections.select("path", "section_no", "name", F.posexplode(row).alias("row_no", "line"))
    strip = F.regexp_replace("line", "^[ ]*[|]|[|][ ]*$", "")
    return guides.drop("body"), sections, cells.select("path", "section_no", "name", "row_no", F.transform(F.split(strip, "[|]"), lambda c: F.trim(c)).alias("cells"))


# Named entities that matter in page text, decoded in this order (the ampersand last).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, block ends as line ends, entities decoded."""
    out = F.regexp_replace(html, "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, "(?i)</?(?:p|div|br|li|ul|tr|h[1-6]|article|nav|table)[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[ \\t\\r]+", " "), " ?\n[ \n]*", "\n"), "^[ \n]+|[ \n]+$", "")


def html_pages(pages: DataFrame) -> DataFrame:
    """Title, main body text and visible text of each page. ``pages``: page_id, html."""
    main = F.coalesce(F.nullif(F.regexp_extract("html", "(?is)<article[^>]*>(.*?)</article>", 1), F.lit("")), F.col("html"))
    return pages.select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), html_text(F.col("html")).alias("text"), html_text(main).alias("main_text"))


def html_links(pages: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("(?i)<a[^>]*href=\"([^\"]*)\""), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def registry_rows(pages: DataFrame) -> DataFrame:
    """Rows of saved search result pages: number, title, status, detail link. ``pages``: page_id, html."""
    row = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "row"))
    cells = F.regexp_extract_all("row", F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    shaped = row.withColumn("cells", cells).withColumn("at", F.array_position(F.transform("cells", lambda c: c.rlike("(?i)<a[^>]*href=")), F.lit(True)).cast("int"))
    cell = lambda i: F.trim(F.regexp_replace(F.regexp_replace(F.get("cells", F.col("at") - 1 + i), "<[^>]*>", ""), "[ \\t\\r\\n]+", " "))
    return shaped.where((F.col("at") >= 2) & (F.size("cells") >= F.col("at") + 3)).select(
        "page_id", "row_no", T.normalize_number(cell(-1)).alias("number"), cell(0).alias("title"), cell(1).alias("published"), cell(2).alias("effective"), cell(3).alias("status"),
        F.regexp_extract(F.get("cells", F.col("at") - 1), "(?i)href=\"([^\"]*)\"", 1).alias("detail_path"),
        cell(0).contains("修改单").alias("is_amendment"),
    )


def binary_inventory(spark: SparkSession, path: str, declared: DataFrame) -> DataFrame:
    """Declared paths with size, digest and whether the file exists; one row per path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    return declared.select("path").distinct().join(files, "path", "left").withColumn("exists", F.col("sha256").isNotNull())


def ocr_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """OCR JSON: (lines with box and score, pages with joined text and mean confidence)."""
    raw = spark.read.schema(OCR_SCHEMA).option("multiLine", True).json(path)
    lines = raw.select("document_id", "page_no", F.posexplode("lines").alias("line_no", "l")).select(
        "document_id", "page_no", "line_no", "l.text", "l.score", *[F.get("l.box", i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    )
    scores = F.filter(F.transform("lines", lambda s: s["score"]), lambda s: s.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.nullif(F.size(scores), F.lit(0))
    pages = raw.select("document_id", "page_no", F.array_join(F.transform("lines", lambda s: s["text"]), "\n").alias("text"), mean.alias("avg_score"))
    return lines, pages
