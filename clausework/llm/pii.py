"""Personal data: fixed patterns, and spans that boosted trees choose among high-recall candidates."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausework.llm.boosting import QUANTILES, Trees, binned, calibrate, fit, grow, histograms, logistic, platt
from clausework.llm.common import map_rows, materialize, running_totals

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
#: Positive rows of a kind below which the sampled documents do not suffice.
RARE = 1000
#: Rows below which no model is fitted.
LEAST = 50
#: Distinct rows for each file of a table that fitting reads again and again, so that small tables lie in few files whatever the number of shuffle partitions.
FILE_ROWS = 1 << 15
Span = tuple[str, int, int]

# Fixed patterns of the base spans. The look-behinds only keep a failed run from being tried again at
# each of its later characters, where it must fail too.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# High-recall candidates; they overlap each other and the base spans.
AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}", re.I)
DOTTED = re.compile(r"(?<![0-9])[0-9]{1,4}(?:[.:,][0-9]{1,4}){3}(?![0-9])")
GROUPED = re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){9,22}(?![0-9])")
CALL = re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[\x20().0-9/-]{5,24})[0-9](?![0-9])")
CANDIDATES = tuple((kind, p, re.compile(f"(?=({p.pattern}))", p.flags)) for kind, p in (("email", AT), ("ip", DOTTED), ("card", GROUPED), ("phone", CALL)))
#: Where a shorter candidate of the same start can end.
ENDS = re.compile(r"[A-Za-z0-9-](?![A-Za-z0-9-])|[0-9](?![0-9])")
#: Candidates scored at once, so that a text full of numbers needs bounded memory.
SCORED = 8192
CUES = {
    "email": re.compile(r"mail|contact|write|@", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|ping", re.I),
    "card": re.compile(r"card|visa|master|pay|credit", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil", re.I),
}


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at-sign outwards, so that long runs are read once."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        else:
            end = max(end, at + 1)  # nothing left of this sign can start a later match
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind and start, in code points; failing matches are dropped."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = "".join(DIGITS.findall(m.group()))
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m.group())) <= 15]
    return found


def gaps(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Stretches of the text that no base span covers."""
    end = 0
    for _, a, b in sorted(base, key=lambda s: (s[1], s[2])):
        if a > end:
            yield end, a
        end = max(end, b)
    if end < len(text):
        yield end, len(text)


def candidates(text: str, base: list[Span] = ()) -> Iterator[Span]:
    """Overlapping candidates between the base spans: every start of a kind, with each end it can have."""
    if "@" not in text and "(" not in text and "[" not in text and not DIGITS.search(text):
        return
    for low, high in gaps(text, base):
        for kind, own, ahead in CANDIDATES:
            for m in ahead.finditer(text, low, high):
                a, longest = m.span(1)
                yield kind, a, longest
                for e in ENDS.finditer(text, a, longest):
                    if e.end() < longest and own.fullmatch(text, a, e.end()):
                        yield kind, a, e.end()


def features(span: Span, text: str) -> list[float]:
    """Format of the span and of what stands around it."""
    kind, a, b = span
    own, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = "".join(DIGITS.findall(own))
    groups = [len(g) for g in re.findall(r"[0-9]+", own)] or [0]
    numbers = [int(g[:6]) for g in re.findall(r"[0-9]+", own)] or [0]
    return [
        KINDS.index(kind), len(own), len(digits), sum(c.isalpha() for c in own), len(groups), max(groups), min(groups), max(numbers),
        float(bool(digits) and luhn(digits)), own.startswith("+") or own.startswith("00"), "(" in own, own.count("."), own.count("-"), own.count(" "),
        "@" in own, "[" in own or "(at" in own.lower(), len(own.rpartition(".")[2]), float(bool(CUES[kind].search(before))),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in "\"'=_/", len(DIGITS.findall(before + after)), before[-1:].isspace() or not before, after[:1].isspace() or not after,
    ]


def rewrites(kind: str, own: str) -> list[tuple[str, int]]:
    """Other spellings of a true span (1) and damaged ones that only look like it (0)."""
    digits = DIGITS.findall(own)
    if kind == "email":
        name, _, host = own.partition("@")
        return [(f"{name} [at] {host}", 1), (f"{name}(at){host.replace('.', ' [dot] ')}", 1), (f"{name}@{host.split('.')[0]}.1", 0)]
    if kind == "ip":
        parts = own.split(".")
        return [(".".join([*parts[:3], str(int(parts[3]) + 700)]), 0), (",".join(parts), 0), (":".join(parts), 0)]
    number = "".join(digits)
    if kind == "card":
        broken = number[:-1] + str((int(number[-1]) + 5) % 10)
        return [(".".join(number[i : i + 4] for i in range(0, len(number), 4)), 1), (broken, 0), (".".join(broken[i : i + 4] for i in range(0, len(broken), 4)), 0), (" ".join(broken[i : i + 4] for i in range(0, len(broken), 4)), 0)]
    return [("00" + own[1:], 1), (f"({number[-10:-7]}) {number[-7:-4]}-{number[-4:]}", 1), (number[:9], 0), (f"{number[:4]}-{number[4:6]}-{number[6:8]}", 0), (f"{number[:3]}.{number[3:5]}", 0)]


def labelled(text: str) -> Iterator[tuple[list[float], int, int]]:
    """Training rows of one text: (features, kind, label).

    Base spans and their other spellings, put in their place in the text, are positive; damaged
    spellings and candidates between base spans are negative.
    """
    base = base_spans(text)
    for kind, a, b in base:
        yield features((kind, a, b), text), KINDS.index(kind), 1
        before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
        for own, label in rewrites(kind, text[a:b]):
            yield features((kind, len(before), len(before) + len(own)), before + own + after), KINDS.index(kind), label
    for c in candidates(text, base):
        yield features(c, text), KINDS.index(c[0]), 0


@dataclass(frozen=True)
class Model:
    trees: Trees
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return certainty(self.slope * self.trees.margin(x) + self.offset)


def certainty(z: np.ndarray) -> np.ndarray:
    """Probabilities of calibrated margins, rounded so that they agree with a threshold wherever they are computed."""
    return np.round(logistic(z), 12)


def _labelled_rows(docs: DataFrame, kinds: tuple[int, ...] | None = None) -> DataFrame:
    """Training rows of every text with their place in the draw; of ``kinds``, positive rows only."""

    def found(batch):
        for t in batch.column("text").to_pylist():
            if t and (kinds is None or any(KINDS.index(s[0]) in kinds for s in base_spans(t))):
                yield from (r for r in labelled(t) if kinds is None or (r[2] and r[1] in kinds))

    def rows(batches):
        for batch in batches:
            some = found(batch)
            while part := list(itertools.islice(some, SCORED)):
                yield pa.RecordBatch.from_arrays([pa.array([list(map(float, r[0])) for r in part], pa.list_(pa.float64())), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.int32())], names=["x", "kind", "y"])

    return docs.select("text").mapInArrow(rows, "x array<double>, kind int, y int").withColumn("turn", F.xxhash64(F.col("x").cast("string"), "kind", "y"))


def training_rows(docs: DataFrame, sample_docs: int, max_rows: int) -> tuple[np.ndarray, ...]:
    """Features, kind, label, held-out flag and weight of the drawn rows: an equal share of ``max_rows`` for each kind and label.

    Positive rows of a kind that the sampled documents show fewer than ``RARE`` times are drawn from all
    documents. A weight is the number of rows of the whole table that a drawn row stands for. Of every kind
    and label each fifth distinct row, the first included, is held out.
    """
    part, share = max(1, docs.count() // sample_docs), max_rows // (2 * len(KINDS))
    chosen = docs.where(F.coalesce(F.abs(F.xxhash64(F.lit("pii"), "doc_id", "text")) % part == 0, F.lit(False)))
    sample = materialize(_labelled_rows(chosen), "pii-sample")
    counts = {(r["kind"], r["y"]): r["count"] * part for r in sample.groupBy("kind", "y").count().collect()}
    rare = tuple(k for k in range(len(KINDS)) if counts.get((k, 1), 0) < RARE * part) if part > 1 else ()
    if rare:
        everywhere = materialize(_labelled_rows(docs, rare), "pii-rare")
        counts |= {(r["kind"], 1): r["count"] for r in everywhere.groupBy("kind").count().collect()}
    xs, kinds, ys, held, weights = [], [], [], [], []
    for (k, y), n in sorted(counts.items()):
        rows = (everywhere if y and k in rare else sample).where((F.col("kind") == k) & (F.col("y") == y))
        table = rows.orderBy("turn").limit(share).select("x", "turn").toArrow()
        if len(table):
            _, place = np.unique(table["turn"].to_numpy(), return_inverse=True)
            xs.append(np.array(table["x"].to_pylist())), kinds.append(np.full(len(table), k)), ys.append(np.full(len(table), float(y)))
            held.append(place % 5 == 0), weights.append(np.full(len(table), n / len(table)))
    return tuple(np.concatenate(c) if c else np.array([]) for c in (xs, kinds, ys, held, weights))


def train(docs: DataFrame, sample_docs: int | None = None, max_rows: int | None = None, precision: float = 0.995) -> Model | None:
    """Fit trees on the candidates of all documents, and set each kind's threshold.

    A fifth of the distinct rows is held out: it calibrates the probabilities and gives each kind's threshold, the lowest at
    which the held-out rows reach ``precision``. Rows stay in Spark and count as often as they occur; the driver gets sums of
    fixed size. With ``sample_docs`` and ``max_rows`` (for trials) the model is fitted on rows drawn by ``training_rows`` instead.
    None where there are no examples of both classes.
    """
    return fitted_everywhere(docs, precision) if sample_docs is None else fitted_on_draw(docs, sample_docs, max_rows, precision)


def threshold(reached: float | None) -> float:
    """No candidate passes where the precision is never reached."""
    return 1.1 if reached is None else max(0.9, float(reached))


def fitted_on_draw(docs: DataFrame, sample_docs: int, max_rows: int, precision: float) -> Model | None:
    x, kind, y, held, weight = training_rows(docs, sample_docs, max_rows)
    if len(y) < LEAST or y.min() == y.max():
        return None
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    trees = fit(x[~held], y[~held])
    slope, offset = calibrate(trees.margin(x[held]), y[held])
    model = Model(trees, slope, offset, (1.1,) * len(KINDS))
    p, cuts = model.probability(x[held]), []
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind[held] == k)
        ranked = own[np.argsort(-p[own], kind="stable")]
        w = weight[held][ranked]
        good = np.cumsum(w * y[held][ranked]) / np.cumsum(w) >= precision
        cuts.append(threshold(p[ranked[np.flatnonzero(good)[-1]]] if good.any() else None))
    return Model(trees, slope, offset, tuple(cuts))


def fitted_everywhere(docs: DataFrame, precision: float) -> Model | None:
    """The model of all rows: distinct rows with their number, then sums over them."""
    distinct = materialize(_labelled_rows(docs).groupBy("x", "kind", "y", "turn").agg(F.count("*").alias("times")), "pii-rows")
    # Of every kind and label the row of the least hash is held out in any case.
    first = {(r["kind"], r["y"]): r["turn"] for r in distinct.groupBy("kind", "y").agg(F.min("turn").alias("turn")).collect()}
    least = functools.reduce(lambda found, c: found | ((F.col("kind") == c[0][0]) & (F.col("y") == c[0][1]) & (F.col("turn") == c[1])), first.items(), F.lit(False))
    rows = distinct.withColumn("held", (F.pmod("turn", F.lit(5)) == 0) | least)
    counted = rows.groupBy("held", "y").agg(F.sum("times").alias("n"), F.count("*").alias("rows")).collect()
    number = {(r["held"], r["y"]): r["n"] for r in counted}
    if sum(number.values()) < LEAST or len(number) < 4:
        return None
    trees = grown(rows.where("not held"), number[False, 1] / (number[False, 0] + number[False, 1]))
    margins = with_margins(rows.where("held"), trees).groupBy("kind", "margin").agg(F.sum(F.col("times") * F.col("y")).alias("good"), F.sum("times").alias("times"))
    held = materialize(margins.coalesce(files_for(sum(r["rows"] for r in counted if r["held"]))), "pii-held")
    slope, offset = calibrated(held, number[True, 1], number[True, 0])
    return Model(trees, slope, offset, tuple(threshold(c) for c in cuts_of(held, slope, offset, precision)))


def files_for(rows: int) -> int:
    """Files that ``rows`` distinct rows are stored in."""
    return max(1, -(-rows // FILE_ROWS))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def grown(rows: DataFrame, share: float) -> Trees:
    """Trees on ``rows`` (x, y, times): bins from the exact quantiles of each feature, one pass of sums for each level of a tree."""
    values = rows.select(F.posexplode("x").alias("feature", "value"), "times").groupBy("feature", "value").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    quantiles = values.groupBy("feature").agg(F.percentile("value", F.array(*map(F.lit, QUANTILES.tolist())), F.col("times")).alias("q"), F.sum("rows").alias("rows")).collect()
    edges = [np.unique(r["q"]) for r in sorted(quantiles, key=lambda r: r["feature"])]

    def bins(batches):
        for batch in (b for b in batches if b.num_rows):
            cells = binned(_matrix(batch.column("x")), edges)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary()), batch.column("y"), batch.column("times")], names=["bins", "y", "times"])

    def blocks(batches):
        for batch in (b for b in batches if b.num_rows):
            packed = [b"".join(batch.column("bins").to_pylist()), *(batch.column(c).to_numpy().astype(np.int64).tobytes() for c in ("y", "times"))]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names=["bins", "y", "times"])

    equal = rows.select("x", "y", "times").mapInArrow(bins, "bins binary, y int, times long").groupBy("bins", "y").agg(F.sum("times").alias("times"))
    stored = materialize(equal.coalesce(files_for(max(r["rows"] for r in quantiles))).mapInArrow(blocks, "bins binary, y binary, times binary"), "pii-bins").rdd
    wide = len(edges)

    def summed(*tree):
        def sums(part):
            total = None
            for r in part:
                y, times = (np.frombuffer(r[c], np.int64) for c in ("y", "times"))
                found = histograms(np.frombuffer(r["bins"], np.uint8).reshape(-1, wide), y, times, *tree)
                total = found if total is None else total + found
            return iter(() if total is None else (total,))

        return stored.mapPartitions(sums).treeReduce(np.add)

    return grow(edges, share, summed)


def with_margins(rows: DataFrame, trees: Trees) -> DataFrame:
    def margins(batches):
        for batch in (b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "y", "times")), pa.array(trees.margin(_matrix(batch.column("x"))))], names=["kind", "y", "times", "margin"])

    return rows.select("x", "kind", "y", "times").mapInArrow(margins, "kind int, y int, times long, margin double")


def calibrated(held: DataFrame, positive: int, negative: int) -> tuple[float, float]:
    """Platt's curve over ``held`` (margin, good, times), from sums of fixed size."""

    def summed(a, b, high, low):
        m, n = F.col("margin"), F.col("times")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * m + b))))
        d, w = F.col("good") * high + (n - F.col("good")) * low - n * p, n * p * (1 - p)
        return held.agg(*[F.sum(c) for c in (d * m, d, w * m * m, w * m, w)]).first()

    slope, offset = platt(positive, negative, summed)
    return round(slope, 9), round(offset, 9)


def cuts_of(held: DataFrame, slope: float, offset: float, precision: float) -> list[float | None]:
    """Per kind, the lowest probability at which the rows from there on upwards reach ``precision``."""
    ranked = held.select(F.col("kind").cast("long").alias("kind"), (-(slope * F.col("margin") + offset)).alias("far"), "good", "times")
    for name in ("good", "times"):
        ranked = running_totals(ranked, "kind", ["far"], name, f"{name}_before")
    far = ranked.groupBy("kind", "far").agg(*[F.max(F.col(n) + F.col(f"{n}_before")).alias(n) for n in ("good", "times")])  # equal ones stand or fall together
    reached = {r["kind"]: r["far"] for r in far.where(F.col("good") >= precision * F.col("times")).groupBy("kind").agg(F.max("far").alias("far")).collect()}
    return [float(certainty(np.array([-reached[k]]))[0]) if k in reached else None for k in range(len(KINDS))]


def all_spans(texts: list[str], model: Model | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text.

    A candidate between base spans is added if its calibrated probability reaches its kind's threshold;
    among overlapping ones the most probable stays, then the longest, then the earliest.
    """
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    likely: list[tuple[float, int, int, Span]] = []
    found = ((i, s) for i, t in enumerate(texts) for s in candidates(t, base[i])) if model else iter(())
    while some := list(itertools.islice(found, SCORED)):
        p = model.probability(np.array([features(s, texts[i]) for i, s in some], float))
        likely += [(-float(q), s[1] - s[2], i, s) for q, (i, s) in zip(p, some) if q >= model.thresholds[KINDS.index(s[0])]]
    taken: list[list[tuple[int, int]]] = [[] for _ in texts]
    for _, _, i, s in sorted(likely, key=lambda c: (*c[:3], c[3][1])):
        at = bisect.bisect(taken[i], s[1:])
        if not (at and taken[i][at - 1][1] > s[1]) and not (at < len(taken[i]) and taken[i][at][0] < s[2]):
            taken[i].insert(at, s[1:])
            added[i].append(s)
    return list(zip(base, added))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find_personal_data(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with ``pii``: counts by kind of base spans, digest of base spans, all spans, redacted text.

    One row per input row, no shuffle. Null text has no spans and stays null. A column already named pii is replaced.
    """
    docs = docs.drop("pii")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(docs.columns)

    def run(batch):
        texts = batch.column("text").to_pylist()
        found = all_spans([t or "" for t in texts], shared.value)
        base = [spelled(b) for b, _ in found]
        columns = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
        columns.append(pa.array([hashlib.sha256(s.encode()).hexdigest() for s in base], pa.string()))
        columns.append(pa.array([spelled(b + a) for b, a in found], pa.string()))
        columns.append(pa.array([t if t is None else redacted(t, b + a) for t, (b, a) in zip(texts, found)], pa.string()))
        pii = pa.StructArray.from_arrays(columns, [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])
        return pa.RecordBatch.from_arrays([*batch.columns, pii], names=[*names, "pii"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    counts = ", ".join(f"n_{k}: long" for k in KINDS)
    return map_rows(docs, "text", run, f"{kinds}, pii struct<{counts}, base_sha256: string, spans: string, redacted: string>")
