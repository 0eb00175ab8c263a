"""Quality rules whose thresholds come from the corpus: one fence per measure, language and source.

Measures of a text are whole numbers per thousand words. Their distribution within each language and source
is kept as a histogram whose cells widen with the value (relative error 1/32): counts of cells, so histograms
merge by addition and do not depend on the order of rows. A language and source with few texts borrows the
merged histogram of its language, or of the whole corpus.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.llm.common import text_of
from admitlens.sources.stage import staged

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules. `spread` is in quarter distances beyond the outer quartile."""

    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 8
    min_group: int = 100
    #: Least distance of a fence from the outer quartile, per thousand, by measure.
    least: tuple[tuple[str, int], ...] = (("word_length", 2000), ("symbols", 200), ("dup_lines", 40), ("repeats", 450))


#: What each measure counts, per how many words, and whether small values are odd as well.
MEASURES = {"word_length": ("word_chars", True), "symbols": ("n_symbols", False), "dup_lines": ("n_dup_lines", False), "repeats": ("n_repeat_words", False)}


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated three-word windows."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at blanks of ASCII only
    blanks = len(data) - sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS)


#: So marked, Spark doesn't count the words again for every filter it moves below the projection.
counts_of = _counts.asNondeterministic()


def _measure(name: str) -> Column:
    """Per thousand words, as a whole number."""
    return F.expr(f"{MEASURES[name][0]} * 1000 div greatest(n_words, 1)")


def _cell(v: str) -> Column:
    """Cell of a whole number: exact below 64, then 32 cells for each doubling."""
    wide = f"greatest(length(bin({v})) - 6, 0)"
    return F.expr(f"32 * {wide} + shiftright({v}, cast({wide} as int))")


def _cell_value(c: str) -> Column:
    """Smallest number of a cell."""
    return F.expr(f"CASE WHEN {c} < 64 THEN {c} ELSE shiftleft({c} % 32 + 32, cast({c} div 32 - 1 as int)) END")


def sketches(measured: DataFrame) -> DataFrame:
    """Histogram rows (lang, source, measure, cell, n) of texts that pass the base rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _measure(m).alias("v")) for m in MEASURES])).alias("p")
    cells = measured.filter(~F.col("base_failed")).select("lang", "source", pairs).select("lang", "source", "p.measure", _cell("p.v").alias("cell"))
    return cells.groupBy("lang", "source", "measure", "cell").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(histogram: DataFrame, by: list[str], name: str) -> DataFrame:
    """Quarter points of histograms merged to the columns in `by`."""
    merged = histogram.groupBy(*by, "measure", "cell").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "measure")
    upto = merged.select("*", F.sum("n").over(group.orderBy("cell")).alias("upto"), F.sum("n").over(group).alias("total"))
    quarter = lambda k: _cell_value(f"(min(CASE WHEN 4 * upto >= {k} * total THEN cell END))")
    return upto.groupBy(*by, "measure").agg(F.struct(quarter(1).alias("q1"), quarter(3).alias("q3"), F.max("total").alias("total")).alias(name))


def thresholds(histogram: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per language and source with its fences, as a map of (low, high) by measure."""
    own = _quartiles(histogram, ["lang", "source"], "own")
    lang = _quartiles(histogram, ["lang"], "by_lang").withColumnRenamed("lang", "_lang")
    all_of = _quartiles(histogram, [], "by_all").withColumnRenamed("measure", "_measure")
    both = own.join(lang.withColumnRenamed("measure", "_m"), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_m")), "left")
    both = both.join(all_of, F.col("measure") == F.col("_measure"), "left")
    used = F.when(F.col("own.total") >= rules.min_group, F.col("own")).when(F.col("by_lang.total") >= rules.min_group, F.col("by_lang")).otherwise(F.col("by_all"))
    least = F.element_at(F.create_map(*[F.lit(x) for pair in rules.least for x in pair]), F.col("measure"))
    wide = F.greatest(rules.spread * (F.col("u.q3") - F.col("u.q1")), least)
    fences = both.select("lang", "source", "measure", used.alias("u")).select("lang", "source", "measure", (F.col("u.q1") - wide).alias("low"), (F.col("u.q3") + wide).alias("high"))
    aggs = [F.max(F.when(F.col("measure") == m, F.col(end))).alias(f"{m}_{end}") for m in MEASURES for end in ("low", "high")]
    return fences.groupBy("lang", "source").agg(*aggs)


def measured(docs: DataFrame, rules: QualityRules = QualityRules(), keep: list[Column] | None = None) -> DataFrame:
    """The counts of every text and whether the fixed base rule rejects it."""
    base = docs.select(*(keep or [F.col("doc_id")]), F.col("lang"), F.col("source"), counts_of(text_of()).alias("_c"))
    flat = base.select(*[c for c in base.columns if c != "_c"], "_c.*")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return flat.withColumn("base_failed", failed)


def judged(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """Join the fences and decide; a language and source without fences has no text that passed the base rule."""
    limits = fences.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, (_, two_sided) in MEASURES.items():
        inside &= _measure(m) <= F.col(f"{m}_high")
        if two_sided:
            inside &= _measure(m) >= F.col(f"{m}_low")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.withColumn("kept", kept).drop("_lang", "_source")


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept.

    A null or empty text has no words and fails the base rule. Null languages and sources are groups of their
    own. Equal rows get equal verdicts; an empty table gives an empty result; other columns are not read.
    """
    rows = staged(measured(docs, rules))
    fences = thresholds(staged(sketches(rows)), rules)
    return judged(rows, fences).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns unchanged (whatever their names).

    The counts are taken a second time instead of shuffling texts to their verdicts.
    """
    fences = thresholds(staged(sketches(measured(docs, rules))), rules)
    rows = measured(docs, rules, [F.struct("*").alias("_row")])
    return judged(rows, staged(fences)).filter("kept").select("_row.*")
