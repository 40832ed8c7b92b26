"""Column expressions for cleaning, recognising and cutting text.

Every function takes and returns Columns, so it runs inside whole-stage code on the executors.
Patterns avoid look-around unless a comment says otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

# Character classes and numerals that decide where clauses begin.
HAN = "\\u4e00-\\u9fff"
CN_NUMERALS = "一二三四五六七八九十百千万零〇两"
CLAUSE_PATTERNS = (
    f"^((?:[0-9]+|[A-Z])(?:[.．][0-9A-Z]+){{0,6}})(?:[ \\t]|[{HAN}（(])",
    f"^(第[{CN_NUMERALS}]+条)",
    f"^(第[{CN_NUMERALS}]+章)",
    f"^([{CN_NUMERALS}]+、)",
    "^([（(][一二三四五六七八九十百千万0-9]+[）)])",
    "^(附录[ \\t]*[A-ZＡ-Ｚ])",
)
INLINE_CLAUSE = f"(?:^|[ \\t。；;，,])((?:[1-9][0-9]?|[A-Z])(?:[.．][0-9A-Z]+){{1,6}})[ \\t]*[{HAN}（(]"
SECTION_PATTERNS = (f"^第[{CN_NUMERALS}]+章", "^附录[ \\t]*[A-ZＡ-Ｚ]", f"^[0-9]+[ \\t]+[{HAN}]")
CLAUSE_HEADINGS = (
    f"^第[{CN_NUMERALS}]+条",
    f"^(?:[0-9]+|[A-Z])(?:[.．][0-9A-Z]+){{0,6}}(?:[ \\t]|[{HAN}（(])",
)
PAGE_MARKER = "^[-—–― ]*[0-9]{1,4}[-—–― ]*$"
#: A printed page number: a marker, or a number of any length that begins with a dash.
PAGE_LABEL = f"{PAGE_MARKER}|^[-—–―][-—–― ]*[0-9]+[-—–― ]*$"
OCR_MARKERS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十")
DOTTED_REF = "[0-9]+(?:[.][0-9]+)+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _is(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def lines(col) -> Column:
    return F.split(_c(col), "\n")


def first_line(col) -> Column:
    return F.element_at(lines(col), 1)


#: Full-width signs, digits and letters lie 0xFEE0 above their ASCII forms; the wide blank stands apart.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def fold_wide(col) -> Column:
    """Full-width signs, letters and digits as their ASCII forms."""
    return F.translate(_c(col), WIDE, NARROW)


def normalize(col) -> Column:
    """Full-width forms folded, lower case, single spaces, trimmed: the form substring matching runs on."""
    return F.trim(F.regexp_replace(F.lower(fold_wide(col)), "[ \\t\\r\\n]+", " "))


def compact(col) -> Column:
    """Lower-case letters, digits and Han characters only."""
    return F.regexp_replace(F.lower(_c(col)), f"[^0-9a-z{HAN}]+", "")


def holds_compact(col, least: int) -> Column:
    """Whether ``compact`` text has at least ``least`` characters; reads only as far as needed, so the text is not lowered."""
    signs = f"0-9a-zA-Z\u0130\u212A{HAN}"  # all that is one of these in lower case
    return _c(col).rlike(f"^(?:[^{signs}]*+[{signs}]){{{least}}}")


def squeeze(col) -> Column:
    return F.regexp_replace(_c(col), "[ \\t\\r\\n]+", "")


def normalize_title(col) -> Column:
    """Letters and digits of any script, lower case."""
    return F.regexp_replace(F.lower(_c(col)), "[^\\p{L}\\p{N}]+", "")


def normalize_number(col) -> Column:
    """Canonical document number: one bracket style, one dash, no spaces or control characters."""
    folded = F.translate(fold_wide(col), "【［[（(﹝】］]）)﹞—–－﹣‐", "〔〔〔〔〔〔〕〕〕〕〕〕-----")
    return F.upper(F.regexp_replace(folded, "[\\p{Cc}\\p{Cf}\\p{Z}]+", ""))


def clean_display(col) -> Column:
    """Whitespace-only cleaning: line ends, blanks inside lines, at most one empty line."""
    unix = F.regexp_replace(F.regexp_replace(_c(col), "\r\n?", "\n"), "　", " ")
    inner = F.regexp_replace(F.regexp_replace(unix, "[ \\t]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(inner, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def page_artifacts(col) -> Column:
    """Struct of page text without isolated markers in the first and last two lines, and the removed markers in order."""
    parts = lines(col)
    n = F.size(parts)
    head, tail = F.slice(parts, 1, 2), F.slice(parts, F.greatest(F.lit(3), n - 1), F.lit(2))
    middle = F.slice(parts, F.lit(3), F.greatest(n - 4, F.lit(0)))
    marker = lambda x: (F.trim(x).rlike(PAGE_MARKER)) | F.trim(x).isin(*OCR_MARKERS)
    kept = F.concat(F.filter(head, lambda x: ~marker(x)), middle, F.filter(tail, lambda x: ~marker(x)))
    gone = F.transform(F.filter(F.concat(head, tail), lambda x: marker(x)), lambda x: F.trim(x))
    return F.struct(
        F.regexp_replace(F.array_join(kept, "\n"), "^[ \n]+|[ \n]+$", "").alias("clean"), gone.alias("removed")
    )


def infer_clause_no(col) -> Column:
    """First matching clause pattern at line start, else a dotted number in the first 100 characters."""
    line = F.trim(F.regexp_replace(_c(col), "[ \\t]+", " "))
    tries = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in CLAUSE_PATTERNS]
    inline = F.nullif(F.regexp_extract(F.substring(line, 1, 100), INLINE_CLAUSE, 1), F.lit(""))
    found = F.coalesce(*tries, inline)
    return F.replace(F.regexp_replace(found, "[ \\t]+", ""), F.lit("．"), F.lit("."))


def is_section_heading(col) -> Column:
    line = F.trim(_c(col))
    hit = F.lit(False)
    for p in SECTION_PATTERNS:
        hit = hit | line.rlike(p)
    return hit


def is_clause_heading(col) -> Column:
    line = F.trim(_c(col))
    hit = F.substring(line, 1, 100).rlike(INLINE_CLAUSE)
    for p in CLAUSE_HEADINGS:
        hit = hit | line.rlike(p)
    return hit


def parent_clause(col) -> Column:
    """Immediate parent of a dotted clause number with at least three parts, else null."""
    clause = F.regexp_replace(F.trim(_c(col)), "[.]+$", "")
    return F.when(
        clause.rlike("^(?:[0-9]+|[A-Za-z])(?:[.][0-9]+){2,}$"), F.regexp_replace(clause, "[.][0-9]+$", "")
    )


def final_number(col) -> Column:
    last = F.element_at(F.split(F.regexp_replace(F.trim(_c(col)), "[.]+$", ""), "[.]"), -1)
    return F.when(last.rlike("^[0-9]+$"), last.try_cast("long"))


def clause_prefixes(col) -> Column:
    """Every dotted prefix of a clause number, itself included, for prefix joins by equality."""
    parts = F.split(_c(col), "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def loose_date(col) -> Column:
    """Year, month, day in common separators; impossible dates become null."""
    pattern = "([0-9]{4})[ ]*(?:年|[-/.])[ ]*([0-9]{1,2})[ ]*(?:月|[-/.])[ ]*([0-9]{1,2})"
    text = _c(col)
    part = lambda i: F.regexp_extract(text, pattern, i)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(text.rlike(pattern), F.try_to_date(iso, "yyyy-MM-dd"))


LABEL_RANGE = "表?([A-Z])[.]([0-9]+)(?:至|到|~|～|-)表?([A-Z])[.]([0-9]+)"


def table_references(col) -> Column:
    """Table labels named in text; ranges within one letter spanning at most 20 steps are written out."""
    text = F.upper(squeeze(col))
    ranged = F.regexp_extract_all(text, F.lit(LABEL_RANGE), F.lit(0))
    parsed = F.transform(
        ranged,
        lambda r: F.struct(
            F.regexp_extract(r, LABEL_RANGE, 1).alias("a"),
            F.regexp_extract(r, LABEL_RANGE, 2).cast("int").alias("m"),
            F.regexp_extract(r, LABEL_RANGE, 3).alias("b"),
            F.regexp_extract(r, LABEL_RANGE, 4).cast("int").alias("n"),
        ),
    )
    usable = F.filter(parsed, lambda p: (p["a"] == p["b"]) & (F.abs(p["n"] - p["m"]) <= 20))
    written = F.transform(
        usable,
        lambda p: F.transform(
            F.sequence(F.least(p["m"], p["n"]), F.greatest(p["m"], p["n"])),
            lambda k: F.concat(p["a"], F.lit("."), k.cast("string")),
        ),
    )
    single = F.regexp_extract_all(text, F.lit("表([A-Z][.][0-9]+)"), F.lit(1))
    return F.array_distinct(F.concat(F.flatten(written), single))


SENTENCE_MARK = "[。！？；;.!?]"
COMMA_MARK = "[，,、]"


def _cut_after(text: Column, mark: str) -> Column:
    cut = F.split(F.regexp_replace(text, f"({mark})[ ]*", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def split_sentences(col) -> Column:
    """Sentences by terminator; one sentence over 120 characters is cut at commas instead."""
    clean = F.trim(F.regexp_replace(_c(col), "[ \\t\\r\\n]+", " "))
    by_end = _cut_after(clean, SENTENCE_MARK)
    by_comma = _cut_after(clean, COMMA_MARK)
    return F.when((F.size(by_end) <= 1) & (F.char_length(clean) > 120), by_comma).otherwise(by_end)


def count_of(text, term) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    text, term = _c(text), _c(term)
    return ((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)).cast("long")


def length_band(length: Column) -> Column:
    bands = ((20, "<20"), (50, "20-49"), (150, "50-149"), (300, "150-299"), (600, "300-599"), (1200, "600-1199"))
    out = None
    for top, name in bands:
        out = F.when(length < top, name) if out is None else out.when(length < top, name)
    return out.otherwise(">=1200")


def page_class(text, ink_ratio) -> Column:
    """Physical page class by ordered rules over page text and ink ratio."""
    # The words, the ink limit and the class names of the rules.
    t = F.trim(F.regexp_replace(_c(text), "[ \\t\\r\\n]+", " "))
    ink = _c(ink_ratio)
    has = lambda s: t.contains(s)
    dots = count_of(t, F.lit("……")) + count_of(t, F.lit("..."))
    return (
        F.when(t.rlike("^[一二三四五六七八九十]+、.{1,20}(?:矿产类|类)$"), "category_divider")
        .when((t == "") & (ink < 0.01), "blank_page")
        .when(has("目次") & (dots >= 2), "table_of_contents")
        .when(has("修改单") & (has("实施") | has("批准")), "amendment_content")
        .when(has("中华人民共和国") & has("标准") & (has("发布") | has("实施")), "standard_cover")
        .when(t == "", "scan_artifact_only")
        .otherwise("substantive_content")
    )


def identity_norm(col) -> Column:
    return F.regexp_replace(F.upper(_c(col)), "[^\\p{L}\\p{N}]+", "")


def identity_present(text, number, title) -> Column:
    """Number, whole title, or at least two title terms of four or more characters occur in the text."""
    body, code = identity_norm(text), identity_norm(number)
    bare = F.regexp_replace(_c(title), "^[《》]+|[《》]+$", "")
    whole = identity_norm(bare)
    terms = F.filter(F.transform(F.split(bare, "[、，,：: \\t\\r\\n]+"), lambda s: identity_norm(s)), lambda t: F.char_length(t) >= 4)
    hits = F.size(F.filter(terms, lambda t: F.contains(body, t)))
    return (
        _is((code != "") & F.contains(body, code))
        | _is((whole != "") & F.contains(body, whole))
        | _is((F.size(terms) > 0) & (hits >= F.least(F.lit(2), F.size(terms))))
    )


def unstructured_table_flag(col) -> Column:
    """Long streams of mostly numeric or very short lines, or text under a table caption."""
    from clausework.functions.spans import bound

    text = _c(col)
    caption = text.contains("表") & text.rlike("(?md)^ *+(?:表|续表)[ \\t]*[A-Za-z0-9]")

    def streams(parts):
        n = F.size(parts)
        numeric = F.size(F.filter(parts, lambda s: s.rlike("^[-+<≥≤~～—./0-9%°℃mMkKgGtTPa]+$")))
        short = F.size(F.filter(parts, lambda s: ~holds_compact(s, 7)))
        return (n >= 30) & ((numeric / n >= 0.20) | (short / n >= 0.55))

    # Fewer than 30 line ends cannot make 30 lines, so most texts are not cut.
    many = text.rlike("(?s)^(?:[^\\n]*+\\n){29}")
    return _is(caption | F.when(many, bound(F.filter(F.transform(lines(col), lambda s: F.trim(s)), lambda s: s != ""), streams)).otherwise(False))


def front_matter_flag(col) -> Column:
    """Contents list or cover merged with a foreword at the start of the text."""
    dense = squeeze(col)
    opening = F.substring(dense, 1, 500)
    # A sign stands in the squeezed text if it stands in the text. Most texts need no squeezing, and a branch, other than a conjunction, is left out.
    holds = lambda signs: reduce(and_, [_c(col).contains(x) for x in signs])
    contents = F.when(holds("目录"), opening.contains("目录") & ((count_of(_c(col), F.lit("......")) >= 3) | (count_of(_c(col), F.lit("……")) >= 3))).otherwise(False)
    cover = F.when(
        holds("华国前言"),
        opening.contains("中华人民共和国")
        & F.substring(dense, 1, 1200).contains("前言")
        & (opening.contains("发布") | opening.contains("实施")),
    ).otherwise(False)
    return contents | cover


# What counts as a concrete value, a fraction and a date.
VALUE_PATTERN = "[0-9]+(?:[.][0-9]+)?(?:%|％|万元|元|米|年|日|天)?"
FRACTION_PATTERN = "[0-9]+/[0-9]+"
DATE_PATTERN = "[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}"


def concrete_values(col) -> Column:
    """Numbers, fractions and dates a claim states, each once."""
    get = lambda p: F.regexp_extract_all(_c(col), F.lit(p), F.lit(0))
    return F.array_distinct(F.concat(get(VALUE_PATTERN), get(FRACTION_PATTERN), get(DATE_PATTERN)))


def grounding_norm(col) -> Column:
    """Punctuation-free upper case, the form claims are checked in."""
    return F.upper(F.regexp_replace(_c(col), "[ \\t\\r\\n\\-－—~～,，。；;:：()（）\\[\\]【】]", ""))


def char_grams(col, size: int) -> Column:
    """Distinct character n-grams in one pass (look-ahead gives overlapping matches)."""
    return F.array_distinct(F.regexp_extract_all(_c(col), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def all_groups_match(text, groups) -> Column:
    """Every group has at least one term in the text; no groups means no restriction."""
    return F.forall(groups, lambda g: F.exists(g, lambda t: F.contains(_c(text), t)))


def any_alternative_match(text, alternatives) -> Column:
    """Some alternative has all its anchors in the text."""
    dense = F.lower(squeeze(text))
    return F.exists(
        alternatives, lambda g: (F.size(g) > 0) & F.forall(g, lambda a: F.contains(dense, F.lower(squeeze(a))))
    )
