"""Matches of a pattern with their character offsets, and number-plus-unit expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clausework.functions.text import _c

# Units from compound to simple, with the spelling used in canonical text.
MEASURE_UNITS = (
    ("volume_cubic_metre", "立方米", "m3", "m[³3]|立方米"),
    ("area_square_metre", "平方米", "m2", "m[²2]|平方米|平米"),
    ("length_kilometre", "千米", "km", "km|千米|公里"),
    ("length_metre", "米", "m", "m|米|公尺"),
    ("length_centimetre", "厘米", "cm", "cm|厘米|公分"),
    ("length_millimetre", "毫米", "mm", "mm|毫米"),
    ("mass_tonne", "吨", "t", "t|吨"),
    ("time_day", "日", "d", "d|日|天"),
    ("time_year", "年", "a", "a|年"),
)
NUMBER = "[+-]?[0-9]+(?:[.．][0-9]+)?"


def matches(col, pattern: str) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(0))


BLOCK = 64


def spans(col, pattern: str) -> Column:
    """Array of struct(char_start, char_end, raw): offsets are zero based and end exclusive.

    The pieces between matches come from ``split`` with the same pattern, so the offsets follow
    from running lengths and repeated text cannot be confused. Lengths are summed by blocks of 64 matches first, so
    no array grows match by match over a whole text.
    """
    text = _c(col)
    return bound(F.struct(matches(text, pattern).alias("found"), F.split(text, pattern).alias("gaps")), lambda s: _placed(s["found"], s["gaps"]))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression named inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(found: Column, gaps: Column) -> Column:
    n = F.size(found)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    length = lambda values, b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), F.lit(0), lambda total, x: total + F.char_length(x))
    before = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda acc, b: F.struct((acc["pos"] + length(gaps, b) + length(found, b)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
        lambda acc: acc["out"],
    )

    def step(acc, i):
        raw = F.get(found, i)
        begin = acc["pos"] + F.char_length(F.get(gaps, i))
        end = begin + F.char_length(raw)
        item = F.struct(begin.alias("char_start"), end.alias("char_end"), raw.alias("raw"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(item)).alias("out"))

    def block(pos, b):
        last = F.least(n, (b + 1) * BLOCK) - 1
        start = F.struct(pos.alias("pos"), F.array().cast("array<struct<char_start:int,char_end:int,raw:string>>").alias("out"))
        return F.aggregate(F.sequence(b * BLOCK, last), start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(before, block))


def measure_pattern(units=MEASURE_UNITS) -> str:
    # The look-ahead keeps "5 mg" from being read as metres.
    return f"(?i){NUMBER}[ \\t]*(?:{'|'.join(u[3] for u in units)})(?![A-Za-z0-9²³])"


def measurements(col, units=MEASURE_UNITS) -> Column:
    """Number-plus-unit expressions with canonical unit and text; numbers stay text."""

    def describe(s):
        return bound(_kind(s["raw"], units), lambda m: F.struct(
            s["char_start"].alias("char_start"),
            s["char_end"].alias("char_end"),
            s["raw"].alias("raw_text"),
            m["value"].alias("raw_value"),
            m["number"].alias("numeric_value"),
            m["unit"].alias("raw_unit"),
            m["kind"]["unit_key"].alias("unit_key"),
            m["kind"]["label"].alias("canonical_label"),
            m["kind"]["symbol"].alias("canonical_symbol"),
            F.concat(m["number"], m["kind"]["label"]).alias("canonical_text"),
        ))

    return F.transform(spans(col, measure_pattern(units)), describe)


def _kind(raw: Column, units) -> Column:
    """Struct of value, number, unit and kind (unit_key, label, symbol) of one expression; each part is computed once."""
    value = F.regexp_extract(raw, f"^({NUMBER})", 1)
    cut = lambda v: F.struct(v.alias("value"), F.replace(v, F.lit("．"), F.lit(".")).alias("number"), F.trim(F.substr(raw, F.char_length(v) + 1)).alias("unit"))
    known = lambda unit: F.coalesce(*[F.when(unit.rlike(f"(?i)^(?:{u[3]})$"), F.struct(F.lit(u[0]).alias("unit_key"), F.lit(u[1]).alias("label"), F.lit(u[2]).alias("symbol"))) for u in units])
    return bound(bound(value, cut), lambda p: F.struct(p["value"].alias("value"), p["number"].alias("number"), p["unit"].alias("unit"), known(p["unit"]).alias("kind")))


def canonical_text(col, units=MEASURE_UNITS) -> Column:
    """Text with every measurement in canonical form, for searching only."""
    pattern = measure_pattern(units)
    gaps, found = F.split(_c(col), pattern), matches(col, pattern)
    canonical = lambda raw: bound(_kind(raw, units), lambda m: F.concat(m["number"], m["kind"]["label"]))
    parts = bound(gaps, lambda g: F.struct(g.alias("gaps"), F.slice(g, F.lit(1), F.size(g) - 1).alias("heads")))
    return bound(parts, lambda p: F.concat(F.array_join(F.zip_with(p["heads"], found, lambda g, raw: F.concat(g, canonical(raw))), ""), F.element_at(p["gaps"], -1)))
