"""Quality rules: text statistics and robust multivariate outliers per language and source, all in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausework.llm.common import materialize

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
#: The transformed statistics are whole numbers of thousandths, so sums are exact in any order.
SCALE = 1000
#: Least standard deviations, in logarithms, added in squares (so that no cell's matrix is singular): a fleet of spotless documents must not make one blot an outlier.
#: A statistic alone can be rejected only if its range exceeds its floor times the root of the cutoff.
FLOORS = (0.35, 0.15, 0.4, 0.4)
DIMS = len(FLOORS)
#: Share of a cell's rows that the determinant is taken over; the factor makes it consistent for normal data in four dimensions.
COVERAGE, CONSISTENCY = 0.75, 1.49
C_STEPS = 3


def with_statistics(docs: DataFrame) -> DataFrame:
    """Add ``stats``: the base statistics and ``n_lines`` (lines with a word). Null text has no words.

    Everything happens inside the row. Repeated windows are looked for only where the number of distinct
    window hashes falls short; then sorting brings equal windows together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.expr(r"btrim(coalesce(text, ''), ' \t\n\u000b\u000c\r')")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    step1 = docs.withColumn("_words", words).withColumn("_lines", lines)
    n = F.size("_words")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    step2 = step1.select(
        *[F.col(c) for c in docs.columns],
        n.cast("long").alias("_n"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"),
        windows.alias("_windows"),
    )
    ordered = F.when(
        F.size("_windows") > F.size(F.array_distinct("_windows")),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    step3 = step2.withColumn("_sorted", ordered)
    pairs = F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_sorted")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    step4 = step3.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(pairs)))).drop("_sorted", "_windows")
    reach = F.zip_with("_starts", F.slice("_starts", 2, F.size("_starts")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeats = F.coalesce(F.aggregate(reach, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    stats = F.struct(
        F.col("_n").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.col("_n_lines").alias("n_lines"),
    )
    return step4.select(*[F.col(c) for c in docs.columns], stats.alias("stats"))


def base_failed() -> Column:
    return (F.col("stats.n_words") < 10) | (100 * F.col("stats.n_repeat_words") > 20 * F.col("stats.n_words"))


def vector() -> list[Column]:
    """Logarithms of smoothed rates: symbols per 100 characters, characters per word, repeated words and repeated lines per 100."""
    s = {c: F.col(f"stats.{c}") for c in (*STATISTICS, "n_lines")}
    rates = (
        F.log1p(100 * s["n_symbols"] / (s["word_chars"] + 50)),
        F.log((s["word_chars"] + 100) / (s["n_words"] + 20)),
        F.log1p(100 * s["n_repeat_words"] / (s["n_words"] + 20)),
        F.log1p(100 * s["n_dup_lines"] / (s["n_lines"] + 5)),
    )
    return [F.round(r * SCALE).cast("long") for r in rates]


def cells(rows: DataFrame, least: int) -> DataFrame:
    """The cell each (lang, source) is judged in, and the cells that its rows are points of.

    Judged in itself, else with the small sources of its language, else with all that is left; where these
    are fewer than ``least`` rows, with all rows of its language, else with all rows. One row per pair. Only
    a table of fewer than ``least`` rows has pairs with a null cell, and no estimate. Rows of other cells
    are also points of their language or of the whole table where some pair falls back to it.
    """
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < least, F.col("n")).otherwise(0)
    pooled = counts.withColumns({"_lang_n": F.sum(small).over(W.partitionBy("lang")), "_lang_all": F.sum("n").over(W.partitionBy("lang"))})
    left = F.when((F.col("n") < least) & (F.col("_lang_n") < least), F.col("n")).otherwise(0)
    rest = pooled.agg(F.sum(left).alias("_rest_n"), F.sum("n").alias("_n"), F.coalesce(F.max((left > 0) & (F.col("_lang_all") < least)), F.lit(False)).alias("_far"))
    name = lambda *c: F.to_json(F.struct(*c))
    own, lang, everything = name(F.lit(1).alias("level"), "lang", "source"), name(F.lit(2).alias("level"), "lang"), name(F.lit(3).alias("level"))
    whole_lang, whole = name(F.lit(4).alias("level"), "lang"), name(F.lit(5).alias("level"))
    cell = F.when(F.col("n") >= least, own).when(F.col("_lang_n") >= least, lang).when(F.col("_rest_n") >= least, everything).when(F.col("_lang_all") >= least, whole_lang).when(F.col("_n") >= least, whole)
    short = F.col("_rest_n") < least
    in_lang = short & (F.col("_lang_all") >= least) & F.col("_lang_n").between(1, least - 1)
    points = F.array_distinct(F.array_compact(F.array(cell, F.when(in_lang, whole_lang), F.when(short & F.col("_far") & (F.col("_n") >= least), whole))))
    return pooled.crossJoin(rest).select("lang", "source", cell.alias("cell"), points.alias("points"))


def _quantile_bins(binned: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """The least bin at which each key's rows reach ``share``; from counts per bin."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy(*keys).orderBy("bin"))
    everything = F.sum("k").over(W.partitionBy(*keys))
    return counts.withColumn("_c", upto).withColumn("_n", everything).where(F.col("_c") >= share * F.col("_n")).groupBy(*keys).agg(F.min("bin").alias(name))


def squared_distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor in columns l<i><j>."""
    ys: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * ys[j]
        ys.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _cholesky(moments: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Centre m<i> and factor l<i><j> of each cell's scaled covariance with the least deviations added; one row per cell."""
    out = moments
    for i in range(DIMS):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(DIMS):
        for j in range(i + 1):
            cov = CONSISTENCY * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            value = cov + (floors[i] * SCALE) ** 2 if i == j else cov
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    return out.select("cell", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def minimum_determinant(points: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Centre and covariance factor per cell of ``points`` (cell, x0..x3 long) by concentration steps.

    The start is the coordinate-wise median with the least deviations; each step keeps the three quarters
    of the rows nearest to the last estimate (ties at the border kept) and takes their exact integer
    moments. A step reads the narrow points twice and shuffles counts per cell and bin and one row of
    sums per cell and task, however large a cell is.
    """
    dims = points.select("cell", F.posexplode(F.array(*[f"x{i}" for i in range(DIMS)])).alias("dim", "bin"))
    medians = _quantile_bins(dims, ["cell", "dim"], 0.5, "median").groupBy("cell").pivot("dim", list(range(DIMS))).agg(F.first("median"))
    start = medians.select("cell", *[F.col(str(i)).cast("double").alias(f"m{i}") for i in range(DIMS)], *[F.lit(floors[i] * SCALE if i == j else 0.0).alias(f"l{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    estimate = materialize(start, "mcd-start")
    for _ in range(C_STEPS):
        near = points.join(estimate, "cell").select("cell", *[f"x{i}" for i in range(DIMS)], F.floor(F.log1p(squared_distance()) * SCALE).alias("bin"))
        border = materialize(_quantile_bins(near, ["cell"], COVERAGE, "border"), "mcd-border")  # one row a cell, so its size is known when it is joined
        kept = near.join(border, "cell").where(F.col("bin") <= F.col("border"))
        products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(DIMS) for j in range(i + 1)]
        moments = kept.groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)], *products)
        estimate = materialize(_cholesky(moments, floors), "mcd-step")
    return estimate


def with_verdict(table: DataFrame, least: int = 50, cutoff: float = 25.0, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Add base_failed, distance and kept to a stored table that has lang, source and stats.

    Rejected are rows that fail the base rule and rows whose squared distance from their cell's estimate
    exceeds ``cutoff`` (about 5e-5 of normal data in four dimensions). Estimates use every row that the base
    rule passes. Nulls in lang or source form cells of their own; cells of fewer than ``least`` rows are
    pooled by language, then over all that is left, and else judged by all rows of their language or of the
    table; where even the table is too small, only the base rule decides.
    """
    lookup = cells(table.where(~base_failed()), least)
    tagged = table.join(lookup.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "cell"), table["lang"].eqNullSafe(F.col("_l")) & table["source"].eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    xs = [x.alias(f"x{i}") for i, x in enumerate(vector())]
    narrow = table.where(~base_failed()).select("lang", "source", *xs).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    points = materialize(
        narrow.join(lookup, narrow["_lang"].eqNullSafe(F.col("lang")) & narrow["_source"].eqNullSafe(F.col("source"))).select(F.explode("points").alias("cell"), *[f"x{i}" for i in range(DIMS)]),
        "mcd-points",
    )
    estimate = minimum_determinant(points, floors)
    judged = tagged.withColumns({f"x{i}": x for i, x in enumerate(vector())}).join(estimate, "cell", "left")
    kept = ~F.col("_failed") & (F.coalesce(F.col("_distance"), F.lit(0.0)) <= cutoff)
    judged = judged.select(*[F.col(c) for c in table.columns], base_failed().alias("_failed"), squared_distance().alias("_distance"))
    return judged.select(*[F.col(c) for c in table.columns], F.col("_failed").alias("base_failed"), F.round("_distance", 6).alias("distance"), kept.alias("kept"))


def judge(docs: DataFrame, keep: list[str], least: int = 50, cutoff: float = 25.0, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """The columns ``keep`` of every row with stats, base_failed, distance and kept.

    The statistics are computed once and stored with ``keep``; the estimates read four numbers a row.
    """
    named = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), "text", "lang", "source")
    stored = materialize(with_statistics(named).drop("text"), "quality")
    judged = with_verdict(stored, least, cutoff, floors)
    return judged.select(*[F.col(f"row.{c}").alias(c) for c in keep], *[F.col(f"stats.{c}").alias(c) for c in STATISTICS], "base_failed", "distance", "kept")
