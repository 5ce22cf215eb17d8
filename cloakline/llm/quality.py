"""Quality rules with adaptive thresholds.

Counts of each whole text give rates; the rates of each language and source
are summed up in quantile sketches, logarithmic histograms of a relative error
of one percent. A sketch is a set of bins with counts, so sketches merge by
adding counts: map-side partial sums are merged by the shuffle, those of the
sources of a language make that language's sketch, and those of all languages
the whole table's.

A rate's fences are its group's outer quartiles, moved out by `spread` times
their distance (three: the usual far fence). No rate has a fixed cutoff or a
least width. A small group's quartiles are drawn to those of its language, and
a language's to the whole table's, by a weight that is continuous in the size:
quartiles of n documents count n times, those around them `prior` times.

A text fails if its rate is beyond a fence even when its count is taken `sure`
standard deviations (of a count of independent events) nearer: a short text
with one symbol tells little, a long one with the same rate much. The bound is
the same for all rates.

Defined results. Null text: no words, so it fails the base rule. Null language
or source: a group of its own. Empty table: no rows. Repeated rows count and
are judged each for itself. Carried columns are set aside under names of their
own while the operator works, so that none can clash; a carried column that is
named like a result is an error that says so.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import arrow_bytes, column, pieces, result_names, written
from cloakline.llm.textops import SPACE, Words, mix, shingles

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True

COUNTS = ("q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_lines", "q_upper", "q_letters")
#: Rates: numerator, denominator, how much of the numerator one event makes (a repeat covers two windows of five words), and
#: whether a low rate also fails.
RATES = {
    "word_length": ("q_word_chars", "q_words", 1, True),
    "symbols": ("q_symbols", "q_words", 1, False),
    "dup_lines": ("q_dup_lines", "q_lines", 1, False),
    "repeats": ("q_repeat_words", "q_words", 10, False),
    "upper": ("q_upper", "q_letters", 1, False),
}
GAMMA = 1.02


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def counts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> list[np.ndarray]:
    """COUNTS of each text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    chars = _sums(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        with_word = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i] = len(with_word)
        dup[i] = lines[i] - len(set(with_word))
    repeat = np.zeros(n, np.int64)
    hashes, docs = shingles(words, window)
    if len(hashes):
        keys = mix(hashes + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            starts = np.flatnonzero(words.doc[: len(words.doc) - window + 1] == words.doc[window - 1 :])[twice[at] == keys]
            edges = np.zeros(len(words.doc) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + window, -1)
            repeat = np.bincount(words.doc[np.cumsum(edges[:-1]) > 0], minlength=n).astype(np.int64)
    return [n_words, chars, _sums(_SYMBOL[data], offsets), dup, repeat, lines, _sums(_UPPER[data], offsets), _sums(_LETTER[data], offsets)]


def counted(docs: DataFrame, *carried: str) -> DataFrame:
    """lang, source, the carried columns of docs as _c0, _c1 and so on, and COUNTS of the text with q_failed (the base rule)."""
    columns = ["lang", "source", *[f"_c{i}" for i in range(len(carried))]]
    plain = docs.select("lang", "source", *[column(c).alias(f"_c{i}") for i, c in enumerate(carried)], "text")
    text = len(columns)

    def run(batches):
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(text))
            for a, b in pieces(offsets):
                found = counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:text], *[pa.array(x, pa.int64()) for x in found]], [*columns, *COUNTS])

    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in plain.schema[:text]] + [f"{c} long" for c in COUNTS])
    failed = (F.col("q_words") < 10) | (100 * F.col("q_repeat_words") > 20 * F.col("q_words"))
    return plain.mapInArrow(run, schema).withColumn("q_failed", failed)


def _rate(name: str, sure: float = 0.0) -> F.Column:
    """A document's rate, or the one that is `sure` standard deviations off."""
    top, below, unit, _ = RATES[name]
    events = F.col(top) / unit
    return F.greatest(events + sure * F.sqrt(events), F.lit(0.0)) * unit / F.greatest(F.col(below), F.lit(1))


def _key(name: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def sketches(rows: DataFrame) -> DataFrame:
    """(q_lang, q_source, rate, bin, n): the sketch of each rate of each language and source."""
    bins = F.array(*[F.struct(F.lit(name).alias("rate"), F.when(_rate(name) > 0, F.round(F.log(_rate(name)) / math.log(GAMMA))).otherwise(-1e6).cast("int").alias("bin")) for name in RATES])
    each = rows.where(~F.col("q_failed")).select(_key("lang").alias("q_lang"), _key("source").alias("q_source"), F.explode(bins).alias("b"))
    return each.groupBy("q_lang", "q_source", "b.rate", "b.bin").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by..., rate, size, q1, q2, q3) of sketches merged by the given columns."""
    merged = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by, "rate").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = merged.withColumn("upto", F.sum("n").over(order)).withColumn("size", F.sum("n").over(Window.partitionBy(*by, "rate")))
    value = F.when(F.col("bin") == -1000000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin")))
    return run.groupBy(*by, "rate").agg(F.first("size").alias("size"), *[F.min(F.when(F.col("upto") >= q * F.col("size") / 4, value)).alias(f"q{q}") for q in (1, 2, 3)])


def _drawn(own: str, around, prior: float) -> F.Column:
    """(size, q1, q2, q3) of a group: its own quartiles, drawn to those around it the more the smaller it is."""
    n = F.col(f"{own}.size")
    mean = lambda q: (n * F.col(f"{own}.{q}") + prior * around(q)) / (n + prior)
    return F.struct(n.alias("size"), *[mean(q).alias(q) for q in ("q1", "q2", "q3")])


def thresholds(sketch: DataFrame, prior: float = 10.0, spread: float = 3.0) -> DataFrame:
    """(q_lang, q_source, fences): for each group of the sketch a map from rate to its lowest and highest value."""
    fine, by_lang, whole = _quartiles(sketch, "q_lang", "q_source"), _quartiles(sketch, "q_lang"), _quartiles(sketch)
    language = by_lang.alias("l").join(whole.alias("w"), ["rate"]).select("q_lang", "rate", _drawn("l", lambda q: F.col(f"w.{q}"), prior).alias("a"))
    both = fine.alias("f").join(language, ["q_lang", "rate"]).select("q_lang", "q_source", "rate", _drawn("f", lambda q: F.col(f"a.{q}"), prior).alias("u"))
    width = spread * (F.col("u.q3") - F.col("u.q1"))
    fence = F.struct((F.col("u.q1") - width).alias("low"), (F.col("u.q3") + width).alias("high"))
    return both.groupBy("q_lang", "q_source").agg(F.map_from_entries(F.collect_list(F.struct("rate", fence.alias("fence")))).alias("q_fences"))


def _judged(rows: DataFrame, prior: float, spread: float, sure: float) -> DataFrame:
    """rows of counted() with q_kept; rows are read twice."""
    fences = written(thresholds(written(sketches(rows), "sketches"), prior, spread), "fences")
    known = rows.withColumn("q_lang", _key("lang")).withColumn("q_source", _key("source")).join(fences, ["q_lang", "q_source"], "left")
    good = F.lit(True)
    for name, (*_, both) in RATES.items():
        fence = F.col("q_fences")[name]
        good = good & F.coalesce(_rate(name, -sure) <= F.greatest(fence["high"], F.lit(0.0)), F.lit(True))
        if both:
            good = good & F.coalesce(_rate(name, sure) >= fence["low"], F.lit(True))
    return known.withColumn("q_kept", ~F.col("q_failed") & good).drop("q_lang", "q_source", "q_fences")


def judged(docs: DataFrame, *carried: str, prior: float = 10.0, spread: float = 3.0, sure: float = 1.5) -> DataFrame:
    """The carried columns with COUNTS, q_failed (the base rule) and q_kept (the verdict)."""
    results = [*COUNTS, "q_failed", "q_kept"]
    rows = counted(docs, *carried)
    if "text" not in carried:  # texts are counted twice rather than written once more
        rows = written(rows, "counts")
    return _judged(rows, prior, spread, sure).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(result_names(carried, results))], *results)


def accepted(docs: DataFrame, prior: float = 10.0, spread: float = 3.0, sure: float = 1.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever these are named."""
    rows = _judged(counted(docs, *docs.columns), prior, spread, sure).where("q_kept")
    return rows.select([F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judged(docs, "doc_id")
    return out.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeat_words").alias("n_repeat_words"), F.col("q_failed").alias("base_failed"), F.col("q_kept").alias("kept"))
