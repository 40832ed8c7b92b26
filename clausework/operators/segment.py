"""Cutting documents into units. A document is one row, so cutting happens inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausework.functions import spans, text as T

# Where blocks of policy clauses and of other units may start, hierarchical numbers, and group headings.
POLICY_START = f"(?:[{T.CN_NUMERALS}]+、|[（(][{T.CN_NUMERALS}0-9]+[）)]|[0-9]+[.、]|[a-zA-Z][）)])"
LIST_START = f"(?:[（(][{T.CN_NUMERALS}0-9]+[）)]|[0-9]+[.、）)]|[a-zA-Z][）)])"
HIERARCHY = "(?:[0-9]+(?:\\s*\\.\\s*[0-9]+){1,6}|[A-Za-z]\\s*\\.\\s*[0-9]+(?:\\s*\\.\\s*[0-9]+)*)\\s+"
GROUP_START = f"[{T.CN_NUMERALS}]+、|[（(][{T.CN_NUMERALS}]+[）)]"


def structural_units(documents: DataFrame, starts, sections, text: str = "text", key: str = "document_id") -> DataFrame:
    """New unit at every heading line; the active section and all following lines are carried.

    ``starts`` and ``sections`` map a line Column to a boolean; a section line always starts a unit. Work is linear in the lines:
    the lines are cut at section lines first and inside each section at the other headings, so no unit searches for its section.
    """
    cut = documents.select(key, F.filter(F.transform(T.lines(text), lambda s: F.trim(s)), lambda s: s != "").alias("ls")).where(F.size("ls") > 0)
    at = F.sequence(F.lit(1), F.size("ls"))
    cut = cut.select(key, "ls", F.filter(at, lambda i: (i == 1) | sections(F.get("ls", i - 1))).alias("heads"))

    def section(first, n):
        end = F.coalesce(F.get("heads", n + 1), F.size("ls") + 1)
        head = F.get("ls", first - 1)
        path = F.when(sections(head), F.substring(head, 1, 160))
        begins = F.filter(F.sequence(first, end - 1), lambda i: (i == first) | starts(F.get("ls", i - 1)))
        # a unit ends where the next of its section begins
        return F.zip_with(begins, F.concat(F.slice(begins, 2, F.size(begins)), F.array(end)), lambda x, y: F.struct(x.alias("b"), y.alias("e"), path.alias("path")))

    units = cut.select(key, "ls", F.posexplode(F.flatten(F.transform("heads", section))).alias("n", "u"))
    return units.select(
        key,
        (F.col("n") + 1).cast("long").alias("unit_order"),
        F.array_join(F.slice("ls", F.col("u.b"), F.col("u.e") - F.col("u.b")), "\n").alias("unit_text"),
        F.get("ls", F.col("u.b") - 1).alias("first_line"),
        F.col("u.b").cast("long").alias("line_start"),
        (F.col("u.e") - 1).cast("long").alias("line_end"),
        F.col("u.path").alias("section_path"),
    )


def clause_units(documents: DataFrame, text: str = "text", key: str = "document_id") -> DataFrame:
    """Structural units by section and clause headings, with clause number and unit kind."""
    units = structural_units(documents, lambda s: T.is_section_heading(s) | T.is_clause_heading(s), T.is_section_heading, text, key)
    clause = T.infer_clause_no("first_line")
    kind = F.when(T.is_section_heading("first_line"), "section").when(clause.isNotNull(), "clause").otherwise("front_matter")
    return units.withColumn("clause_no", clause).withColumn("unit_type", kind)


def greedy_pack(parts: Column, target: int, limit: int) -> Column:
    """Pack consecutive pieces into chunks: close a chunk at ``target``, never join past ``limit``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, piece):
        size = F.char_length(acc["open"])
        full = (size > 0) & ((size >= target) | (size + 1 + F.char_length(piece) > limit))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when((size == 0) | full, piece).otherwise(F.concat(acc["open"], F.lit("\n"), piece)).alias("open"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def clause_chunks(documents: DataFrame, limit: int = 1800, text: str = "text", key: str = "document_id") -> DataFrame:
    """Clause units; those over ``limit`` characters are packed by paragraph and numbered ``clause#n``."""
    units = clause_units(documents, text, key)
    pieces = F.when(F.char_length("unit_text") <= limit, F.array("unit_text")).otherwise(greedy_pack(T.lines("unit_text"), limit, limit))
    cut = units.select("*", F.posexplode(pieces).alias("piece", "chunk_text"), F.size(pieces).alias("pieces"))
    numbered = F.concat(F.coalesce("clause_no", F.lit("part")), F.lit("#"), (F.col("piece") + 1).cast("string"))
    return cut.withColumn("chunk_no", F.when(F.col("pieces") > 1, numbered).otherwise(F.col("clause_no"))).drop("unit_text", "pieces")


def explicit_blocks(units: DataFrame, text: str, key: list[str], policy: Column | None = None) -> DataFrame:
    """One row per block of ``block_list``; units that cannot be cut safely give no rows."""
    blocks = block_list(text, F.lit(True) if policy is None else policy)
    rows = units.select(*key, F.posexplode(blocks).alias("n", "b"))
    return rows.select(*key, (F.col("n") + 1).alias("block_no"), "b.block_text", "b.local_heading")


def block_list(text, policy: Column) -> Column:
    """Array of struct(block_text, local_heading): the text cut at visible numbering, empty where it cannot be cut safely.

    Policy clauses also start at Han-numbered headings. One split cuts the lines, so the work is linear; a block's heading is the
    last group heading up to its end. At least two meaningful and at most 50 blocks.
    """
    body = F.array_join(F.filter(F.transform(T.lines(text), lambda s: F.trim(s)), lambda s: s != ""), "\n")
    cut = lambda start: F.split(body, f"\n(?={start}|{HIERARCHY})")
    blocks = F.when(policy, cut(POLICY_START)).otherwise(cut(LIST_START))
    last = lambda b: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(b, F.lit(f"(?m)^(?:{GROUP_START}).*$"), F.lit(0))), -1)
    none = F.array().cast("array<struct<block_text:string,local_heading:string>>")

    def headed(s):
        carried = lambda j: F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.array_compact(F.slice(s["heads"], F.lit(1), j + 1))), -1), F.lit(""))
        return F.transform(s["blocks"], lambda b, j: F.struct(b.alias("block_text"), F.substring(carried(j), 1, 160).alias("local_heading")))

    def safe(b):
        meaningful = F.size(F.filter(b, lambda x: T.holds_compact(x, 8)))
        named = spans.bound(F.struct(b.alias("blocks"), F.transform(b, last).alias("heads")), headed)
        return F.when((F.size(b) <= 50) & (meaningful >= 2), named).otherwise(none)

    return spans.bound(blocks, safe)


def measurement_rows(units: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    from clausework.functions import ids

    rows = units.select(*key, F.explode(spans.spans(text, pattern)).alias("s")).select(
        *key, F.col("s.char_start").cast("long").alias("char_start"), F.col("s.raw").alias("raw_text")
    )
    return rows.withColumn("measurement_id", ids.stable_id("measurement", *key, "char_start", "raw_text"))
