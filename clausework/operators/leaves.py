"""Retrieval leaves, parents, context and source maps derived from units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausework.functions import ids, text as T
from clausework.functions.spans import bound

#: Rows of a matrix that are filled together.
CARRY_BLOCK = 64
# Length limits of the derivation rules.
SHORT_LIMIT, LONG_LIMIT, MIN_CITABLE, EXCERPT = 50, 1200, 8, 180


def citation_flags(units: DataFrame, text: str) -> DataFrame:
    """Long units need review and are never citable; others need eight compact characters."""
    long, enough = F.char_length(text) >= LONG_LIMIT, T.holds_compact(text, MIN_CITABLE)
    status = F.when(long, "review_required").when(enough, "pass").otherwise("context_only")
    return units.withColumn("review_status", status).withColumn("citation_eligible", ~long & enough)


def derive_leaves(units: DataFrame) -> DataFrame:
    """Decision table of leaf derivation for (document_id, unit_order, unit_type, text) rows."""
    long = F.char_length("text") >= LONG_LIMIT
    front = F.col("unit_type") == "front_matter"
    stream, table = T.front_matter_flag("text"), T.unstructured_table_flag("text")
    method = (
        F.when(F.col("unit_type") == "application_material_row", "application_material_row_linked")
        .when(~long, "source_unit_with_context")
        .when(front, "long_front_matter_context_only")
        .when(stream, "long_ocr_front_matter_context_only")
        .when(table, "unstructured_table_like_unit_retained")
        .otherwise("long_atomic_unit_retained")
    )
    out = units.withColumn("derivation_method", method)
    enough = T.holds_compact("text", MIN_CITABLE)
    search = ~front & (F.col("derivation_method") != "long_ocr_front_matter_context_only")
    status = (
        F.when(long & (front | (F.col("derivation_method") == "long_ocr_front_matter_context_only")), "context_only")
        .when(long, "review_required")
        .when(search & enough, "pass")
        .otherwise("context_only")
    )
    return (
        out.withColumn("search_eligible", search)
        .withColumn("review_status", status)
        .withColumn("citation_eligible", F.col("review_status") == "pass")
        .withColumn("leaf_id", ids.stable_id("runit", "document_id", "derivation_method", "unit_order", "text"))
    )


LEAF = "struct<derivation_method:string,piece:int,clause_no:string,citation_text:string,local_heading:string,search_eligible:boolean,citation_eligible:boolean,review_status:string>"


def table_scope(section: Column) -> Column:
    """Section a table or material row belongs to, without the parts that name the table or the material."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(section, F.lit(""))), "\\s*>\\s*申请资料表$", ""), "\\s*>\\s*材料\\s*[0-9]+.*$", "")


def leaf_branches(units: DataFrame) -> DataFrame:
    """Every unit with its ``leaves`` (array), its ``parent_id`` and what was done to it (``action``).

    Units: document_id, unit_order, unit_type, title, section_path, clause_no, validation_status, wide_layout, text, caption, matrix
    (rows of cells, header first; null without structure). Tables give one leaf per row, or none where material rows of the same
    scope stand for them; those rows hang below the scope's last table. Long units are cut at visible numbering into ``clause#n``;
    front matter, merged cover pages and unmarked table streams are kept whole. Apart from the two joins on (document, scope) a unit is handled
    inside its row.
    """
    from clausework.operators.segment import block_list

    scoped = units.withColumn("scope", table_scope(F.col("section_path")))
    tables = scoped.where("unit_type = 'table'").groupBy("document_id", "scope").agg(F.max("unit_order").alias("table_order"))
    rows = scoped.where("unit_type = 'application_material_row'").select("document_id", "scope", F.lit(True).alias("has_rows")).distinct()
    # Only tables and material rows ask what stands beside them; all other units, with their texts, stay where they are.
    asking = F.coalesce(F.col("unit_type").isin("table", "application_material_row"), F.lit(False))
    joined = scoped.where(asking).join(tables, ["document_id", "scope"], "left").join(rows, ["document_id", "scope"], "left")
    scoped = joined.unionByName(scoped.where(~asking), allowMissingColumns=True)

    kind, text = F.col("unit_type"), F.col("text")
    long = F.char_length("text") >= LONG_LIMIT
    amendment = (kind == "front_matter") & F.coalesce(F.col("title").contains("修改单"), F.lit(False))
    front = (kind == "front_matter") & ~amendment
    enough = T.holds_compact("text", MIN_CITABLE)

    def leaf(method, search, citation, status, piece=None, clause=None, body=None, heading=None):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            lit(method).alias("derivation_method"), (F.lit(0) if piece is None else piece).cast("int").alias("piece"), (F.col("clause_no") if clause is None else clause).alias("clause_no"),
            (text if body is None else body).alias("citation_text"), (F.lit("") if heading is None else heading).alias("local_heading"), lit(search).alias("search_eligible"),
            (lit(citation) & (lit(status) != "review_required")).alias("citation_eligible"), lit(status).alias("review_status"),
        )

    one = lambda *args: F.array(leaf(*args)).cast(f"array<{LEAF}>")
    none = F.array().cast(f"array<{LEAF}>")

    header = F.transform(F.get("matrix", 0), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    caption = F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.nullif(F.col("section_path"), F.lit("")), F.lit("表格"))
    curated = F.col("validation_status").isin("manually_curated_table", "governed_source")

    def row_leaf(cells, i):
        filled = F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))
        named = F.transform(filled, lambda c, j: F.when(c != "", F.concat(F.coalesce(F.nullif(F.get(header, j), F.lit("")), F.concat(F.lit("列"), (j + 1).cast("string"))), F.lit("："), c)))
        status = F.when(curated, "pass").otherwise("review_required")
        return leaf("structured_table_row", True, curated, status, i + 1, F.concat(F.lit("row-"), (i + 1).cast("string")), F.array_join(F.concat(F.array(caption), F.array_compact(named)), "\n"))

    structured = F.coalesce(F.size("matrix") >= 2, F.lit(False))
    table_rows_ = F.filter(F.transform(F.slice("matrix", 2, F.greatest(F.size("matrix"), F.lit(1))), row_leaf), lambda x: x["citation_text"] != caption)
    table = F.when(F.coalesce("has_rows", F.lit(False)), none).when(structured, table_rows_.cast(f"array<{LEAF}>")).otherwise(one("table_without_structured_rows_retained", True, F.col("validation_status") != "parsed_from_ocr", "review_required"))

    # Named columns, so that a text is read once for all that is decided on it; only long texts can be cut.
    scoped = scoped.withColumn("_blocks", F.when(long, block_list("text", kind == "policy_clause"))).withColumn("_stream", F.when(long, T.front_matter_flag("text")).otherwise(False)).withColumn("_like_table", F.when(long, T.unstructured_table_flag("text")).otherwise(False))
    blocks, stream, like_table = F.col("_blocks"), F.col("_stream"), F.col("_like_table")
    safe_cut = ~front & ~stream & ~like_table & F.coalesce(F.size(blocks) > 0, F.lit(False))
    size_ok = lambda b: F.char_length(b["block_text"]) < LONG_LIMIT
    pieces = F.transform(
        blocks,
        lambda b, j: leaf(
            "explicit_numbered_subclause_split", True, size_ok(b) & ~front, F.when(size_ok(b), "pass").otherwise("review_required"), j + 1,
            F.concat(F.coalesce(F.nullif(F.col("clause_no"), F.lit("")), F.lit("part")), F.lit("#"), (j + 1).cast("string")), b["block_text"], b["local_heading"],
        ),
    ).cast(f"array<{LEAF}>")
    kept = F.when(front, "long_front_matter_context_only").when(stream, "long_ocr_front_matter_context_only").when(like_table, "unstructured_table_like_unit_retained").otherwise("long_atomic_unit_retained")
    context_only = (kind == "front_matter") | (~front & stream)
    whole = one(kept, ~front & ~stream, False, F.when(context_only, "context_only").otherwise("review_required"))
    short = one("source_unit_with_context", ~front, ~front & enough, F.when(~front & enough, "pass").otherwise("context_only"))

    is_table, material, wide = kind == "table", kind == "application_material_row", F.coalesce(F.col("wide_layout"), F.lit(False))
    leaves = (
        F.when(is_table, table)
        .when(wide, one("wide_layout_legacy_fallback", False, False, "replaced_by_layout_reconstruction"))
        .when(material, one("application_material_row_linked", True, True, "pass"))
        .when(long, F.when(safe_cut, pieces).otherwise(whole))
        .otherwise(short)
    )
    action = (
        F.when(is_table & F.coalesce("has_rows", F.lit(False)), "existing_application_rows_linked")
        .when(is_table & structured, F.concat(F.lit("structured_table_rows_emitted:"), F.size("leaves").cast("string")))
        .when(is_table, F.when(long, "long_table_retained_for_review").otherwise("table_parent_created"))
        .when(wide, "wide_layout_reconstructed")
        .when(material, "application_row_retained")
        .when(long & safe_cut, F.concat(F.lit("split_at_explicit_boundaries:"), F.size("leaves").cast("string")))
        .when(long, F.when(front, "front_matter_retained_as_context_only").when(stream, "ocr_front_matter_retained_as_context_only").when(like_table, "table_like_source_retained_for_review").otherwise("retained_no_safe_explicit_boundary"))
        .otherwise("")
    )
    document = ids.stable_id("rparent", "document_id", F.lit("document_parent"))
    section = lambda c: F.when(F.coalesce(c, F.lit("")) == "", document).otherwise(ids.stable_id("rparent", "document_id", F.lit("section_parent"), c))
    own = lambda node, order: ids.stable_id("rparent", "document_id", F.lit(node), order)
    parent = (
        F.when(is_table, own("table_parent", "unit_order"))
        .when(material & ~wide, F.when(F.col("table_order").isNotNull(), own("table_parent", "table_order")).otherwise(section(F.col("scope"))))
        .when(long & safe_cut & ~wide, own("long_source_parent", "unit_order"))
        .otherwise(section(F.col("section_path")))
    )
    return scoped.withColumn("leaves", leaves).withColumn("action", action).withColumn("parent_id", parent).drop("_blocks", "_stream", "_like_table")


def branch_leaves(branches: DataFrame) -> DataFrame:
    """One row per leaf of ``leaf_branches`` with its id."""
    # An inner explode would first ask whether there are leaves at all and make them twice.
    rows = branches.select("document_id", "unit_order", "parent_id", F.inline_outer("leaves")).where("derivation_method is not null")
    return rows.withColumn("leaf_id", ids.stable_id("runit", "document_id", "derivation_method", "unit_order", "piece", "citation_text"))


def neighbor_context(units: DataFrame, short: int = SHORT_LIMIT) -> DataFrame:
    """Excerpts of the previous and next unit in the same section or page, for short units."""
    w = W.partitionBy("document_id").orderBy("unit_order")
    out = units
    parts = []
    for name, label, step in (("before", "前文：", -1), ("after", "后文：", 1)):
        near = (lambda fn: lambda c: fn(c).over(w))(F.lag if step < 0 else F.lead)
        related = (F.col("section_path") == near("section_path")) | (F.col("page_start") == near("page_start"))
        excerpt = F.substring(F.trim(F.regexp_replace(near("text"), "[ \\t\\r\\n]+", " ")), 1, EXCERPT)
        out = out.withColumn(name, F.when(F.coalesce(related, F.lit(False)) & near("text").isNotNull(), F.concat(F.lit(label), excerpt)))
        parts.append(F.col(name))
    context = F.when(F.char_length("text") < short, F.concat_ws("\n", *parts)).otherwise("")
    return out.withColumn("neighbor_context", context).drop("before", "after")


def context_header(title: Column, number: Column, section: Column, clause: Column) -> Column:
    """Labelled header lines; empty parts are left out."""
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.concat(F.lit("文件："), title), line("标准号：", number), line("章节：", section), line("条款：", clause))


def parent_nodes(leaves: DataFrame) -> DataFrame:
    """Document, section and long-source parents, one row per id. Leaves carry document_id, section_path, unit_order, is_long."""
    docs = leaves.select(
        ids.stable_id("rparent", "document_id", F.lit("document_parent")).alias("parent_id"), F.lit("document_parent").alias("node_type"),
        F.lit("").alias("parent_ref"), "document_id",
    ).distinct()
    section_id = ids.stable_id("rparent", "document_id", F.lit("section_parent"), "section_path")
    sections = leaves.where("section_path <> ''").select(
        section_id.alias("parent_id"), F.lit("section_parent").alias("node_type"),
        ids.stable_id("rparent", "document_id", F.lit("document_parent")).alias("parent_ref"), "document_id",
    ).distinct()
    longs = leaves.where("is_long").select(
        ids.stable_id("rparent", "document_id", F.lit("long_source_parent"), "unit_order").alias("parent_id"), F.lit("long_source_parent").alias("node_type"),
        F.when(F.col("section_path") == "", ids.stable_id("rparent", "document_id", F.lit("document_parent"))).otherwise(section_id).alias("parent_ref"), "document_id",
    )
    return docs.unionByName(sections).unionByName(longs)


def source_leaf_map(leaves: DataFrame, units: DataFrame) -> DataFrame:
    """Source unit → its leaves and actions; units without any leaf are marked uncovered."""
    mapped = leaves.select(F.explode("source_unit_ids").alias("unit_id"), "leaf_id", "derivation_method").groupBy("unit_id").agg(
        F.count_distinct("leaf_id").alias("leaves"), F.array_join(F.sort_array(F.collect_set("derivation_method")), "|").alias("actions")
    )
    return units.select("unit_id").join(mapped, "unit_id", "left").select(
        "unit_id", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("actions", F.lit("")).alias("actions"), F.col("leaves").isNotNull().alias("covered")
    )


def cross_page_status(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Status of multi-page units by how many of their pages have text. Units: unit_id, document_id, page_start, page_end."""
    wanted = units.where("page_end > page_start").select("unit_id", "document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    found = wanted.join(pages.where("has_text").select("document_id", "page_no", F.lit(1).alias("ok")), ["document_id", "page_no"], "left")
    counted = found.groupBy("unit_id").agg(F.count("*").alias("pages"), F.count("ok").alias("with_text"))
    status = F.when(F.col("pages") == F.col("with_text"), "complete").when(F.col("with_text") == 0, "missing").otherwise("partial")
    return counted.withColumn("status", status)


def best_page_per_label(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One segment per printed page: most compact text, then best score, then first source; with the number of candidates."""
    pick = F.max(F.struct(F.char_length(T.compact("text")).alias("n"), "score", (-F.col("source_ref")).alias("s"))).alias("best")
    out = segments.groupBy(*keys).agg(pick, F.count("*").alias("candidates"))
    return out.select(*keys, (-F.col("best.s")).alias("source_ref"), F.col("best.n").cast("long").alias("chars"), "candidates")


def marker_views(rows: DataFrame, key: list[str], columns: list[str], marker: str = "▲") -> DataFrame:
    """Wide marker matrix → one row per application type with a required flag."""
    return rows.unpivot(key, columns, "application_type", "marker").select(*key, "application_type", (F.col("marker") == marker).alias("required"))


def _carried(body: Column) -> Column:
    """Rows of a matrix with empty cells taken from the row above. Rows are taken in blocks, so no array grows row by row over a whole table."""
    n = F.size(body)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CARRY_BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<string>")

    def below(above, row):
        """The last text of each column; a column that a short row leaves out keeps it."""
        width = F.greatest(F.size(above), F.coalesce(F.size(row), F.lit(0)))
        own = lambda j: F.coalesce(F.nullif(F.get(row, j), F.lit("")), F.get(above, j))
        return F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), own)).otherwise(none)

    rows = lambda b: F.slice(body, b * CARRY_BLOCK + 1, CARRY_BLOCK)
    start = lambda kind: F.struct(kind.alias("at"), F.array().cast("array<array<string>>").alias("out"))
    step = lambda acc, row: bound(below(acc["at"], row), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))
    heads = F.aggregate(blocks, start(none), lambda acc, b: F.struct(F.aggregate(rows(b), acc["at"], below).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    whole = bound(heads, lambda h: F.flatten(F.transform(h, lambda at, b: F.aggregate(rows(b), start(at), step, lambda acc: acc["out"]))))
    shown = lambda state, row: F.transform(F.slice(state, F.lit(1), F.coalesce(F.size(row), F.lit(0))), lambda c: F.coalesce(c, F.lit("")))
    return F.zip_with(whole, body, shown)


def table_rows(tables: DataFrame) -> DataFrame:
    """Matrix rows with merged cells carried down, inside the table's row; ``matrix`` is array<array<string>> whose first row is the header.

    Rows without cells are left out.
    """
    body = F.slice("matrix", 2, F.greatest(F.size("matrix"), F.lit(1)))
    parts = tables.select("table_id", "caption", F.get("matrix", 0).alias("header"), body.alias("body"))
    rows = parts.select("table_id", "caption", "header", F.posexplode(bound(F.col("body"), _carried)).alias("row_no", "cells"))
    return rows.where(F.size("cells") > 0)


def table_row_leaves(tables: DataFrame) -> DataFrame:
    """Text leaf per table row: caption, then ``header：value`` pairs."""
    pair = F.zip_with("header", "cells", lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat_ws("：", F.nullif(h, F.lit("")), v)))
    return table_rows(tables).select("table_id", "row_no", F.concat_ws("\n", F.nullif("caption", F.lit("")), F.array_join(F.array_compact(pair), "；")).alias("leaf_text"))


def wide_page_split(ocr_lines: DataFrame) -> DataFrame:
    """Two-column pages: lines left or right of the page middle, in reading order; page label from the column's last line."""
    page = W.partitionBy("document_id", "page_no")
    side = F.when(F.col("x1") + F.col("x2") < F.max("x2").over(page), "left").otherwise("right")
    body = ocr_lines.withColumn("side", side).groupBy("document_id", "page_no", "side").agg(
        F.sort_array(F.collect_list(F.struct("y1", "x1", "text"))).alias("ls"), F.avg("score").alias("score")
    )
    texts = F.transform("ls", lambda s: s["text"])
    last = F.element_at(texts, -1)
    label = F.when(last.rlike(T.PAGE_LABEL), F.regexp_extract(last, "[0-9]+", 0))
    kept = F.when(label.isNotNull(), F.slice(texts, 1, F.size(texts) - 1)).otherwise(texts)
    return body.select("document_id", "page_no", "side", label.alias("page_label"), F.array_join(kept, "\n").alias("text"), "score")
