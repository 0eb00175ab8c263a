"""An inverted index of keywords in text passages, and the best documents of many searches from it.

The index is built where the texts are read: keywords come in blocks of a bounded size, a text is read once per block, all its
keywords at a time, and only the keywords of its passages with their counts leave the task. A posting list belongs to a group
of documents and a keyword and knows its highest count. A search takes the heads of its lists first, which gives the score that its
last result has at least; the longest lists whose highest counts together stay below that score are then never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.operators.keyed import top_n
from admitlens.sources.stage import release, staged

BLOCK = 1 << 16  # keywords of a block
_TERMS = "array<struct<passage_no:int,terms:array<struct<word:string,hits:int>>>>"


def passage_hits(text: str, words, size: int, step: int) -> list[tuple[int, list[tuple[str, int]]]]:
    """(passage number, [(word, occurrences that don't overlap)]) of the passages that hold a word of the automaton."""
    out = []
    for no, at in enumerate(range(0, len(text), step) if len(text) > size else (0,)):
        free: dict[str, tuple[int, int]] = {}  # word -> (occurrences, end of the last one)
        for end, word in words.iter(text[at : at + size]):
            n, upto = free.get(word, (0, 0))
            if end + 1 - len(word) >= upto:
                free[word] = (n + 1, end + 1)
        if free:
            out.append((no, [(word, n) for word, (n, _) in free.items()]))
    return out


def _terms_udf(block, size: int, step: int):
    @F.pandas_udf(_TERMS)
    def terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = ahocorasick.Automaton()
        for word in block.value:
            words.add_word(word, word)
        words.make_automaton()
        for part in texts:
            yield pd.Series([[{"passage_no": no, "terms": [{"word": w, "hits": n} for w, n in found]} for no, found in passage_hits(t, words, size, step)] if t else [] for t in part])

    return terms


def passage_terms(docs: DataFrame, text: str, keywords: DataFrame, keyword: str, size: int = 520, step: int = 440) -> DataFrame:
    """Passages of whole texts that hold keywords: the other columns of `docs`, passage_no, and `terms`, an array of (word, hits).

    Passages are `size` letters long and start every `step`; a text that is no longer is one passage. hits counts occurrences that
    don't overlap. `keywords` are distinct staged rows without empty ones; a block of them at a time comes to the driver. A text
    gives a row per passage and block.
    """
    spark, keys = docs.sparkSession, [c for c in docs.columns if c != text]
    n = max(1, -(-keywords.count() // BLOCK))
    parts = []
    for k in range(n):
        block = keywords.filter(F.pmod(F.xxhash64(keyword), F.lit(n)) == k)
        words = spark.sparkContext.broadcast([r[0] for r in block.select(keyword).collect()])
        if words.value:
            found = docs.select(*keys, F.explode(_terms_udf(words, size, step)(F.col(text))).alias("_p"))
            parts.append(found.select(*keys, "_p.passage_no", "_p.terms"))
    if not parts:
        return docs.select(*keys, F.lit(0).alias("passage_no"), F.lit(None).cast("array<struct<word:string,hits:int>>").alias("terms")).limit(0)
    return reduce(DataFrame.union, parts)


def _scored(candidates: DataFrame, terms: DataFrame, searches: DataFrame) -> DataFrame:
    """candidates (sid, doc, passage_no, ..) with their exact `score`."""
    near = terms.join(candidates, ["doc", "passage_no"])
    hits = lambda w: F.coalesce(F.get(F.filter("terms", lambda t: t["word"] == w), F.lit(0))["hits"], F.lit(0))
    score: Column = F.aggregate("words", F.lit(0), lambda acc, w: acc + hits(w))
    parts = near.join(searches.select("sid", "words"), "sid").select(*candidates.columns, score.alias("score"))
    return parts.groupBy(*candidates.columns).agg(F.sum("score").cast("int").alias("score"))  # a passage has a row per block


def best_documents(searches: DataFrame, wanted: DataFrame, members: DataFrame, terms: DataFrame, top_k: int) -> DataFrame:
    """(sid, doc, passage_no, score, place): the best `top_k` documents of each search by their best passage.

    searches: (sid, words), a repeated word counts as often as it stands there. wanted: (sid, grp), the groups a search looks into.
    members: (grp, doc, path, tie), the documents of a group; of documents with one path the first by `tie` counts, and `tie`
    orders equal scores. terms: (doc, passage_no, terms). Passages without any hit are no results. `searches` and `terms` are read
    several times: pass staged tables.
    """
    asked = searches.select("sid", F.explode("words").alias("word")).groupBy("sid", "word").agg(F.count(F.lit(1)).cast("int").alias("times"))
    asked = staged(wanted.join(asked, "sid"))
    lists = asked.select("grp", "word").distinct()
    exploded = terms.select("doc", "passage_no", F.explode("terms").alias("t")).select("doc", "passage_no", "t.*")
    index = staged(exploded.join(members, "doc").join(lists, ["grp", "word"], "left_semi"))
    sizes = index.groupBy("grp", "word").agg(F.max("hits").alias("most"), F.count(F.lit(1)).alias("n"))
    asked_lists = staged(asked.join(sizes, ["grp", "word"]))

    heads = top_n(index, ["grp", "word"], [F.col("hits").desc(), F.col("tie"), F.col("passage_no")], top_k)
    first = asked_lists.join(heads.select("grp", "word", "doc", "path", "passage_no"), ["grp", "word"]).select("sid", "doc", "path", "passage_no").distinct()
    of_doc = _scored(first, terms, searches).groupBy("sid", "path").agg(F.max("score").alias("score"))
    last = top_n(of_doc, ["sid"], [F.col("score").desc()], top_k).groupBy("sid").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("least"))
    floor = last.filter(F.col("k") == top_k).select("sid", F.col("least").alias("floor"))

    # the longest lists first, as long as what they could add together stays below the floor
    running = Window.partitionBy("sid", "grp").orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.col("times") * F.col("most")).over(running)
    planned = asked_lists.join(floor, "sid", "left").fillna(0, ["floor"]).withColumn("upto", upto)
    left_out = F.max(F.when(F.col("upto") < F.col("floor"), F.col("upto"))).over(Window.partitionBy("sid", "grp"))
    planned = planned.withColumn("rest", F.coalesce(left_out, F.lit(0))).filter(F.col("upto") >= F.col("floor"))
    read = planned.select("sid", "grp", "word", "times", "floor", "rest").join(index, ["grp", "word"])
    sums = read.groupBy("sid", "grp", "doc", "path", "tie", "passage_no").agg(F.sum(F.col("times") * F.col("hits")).alias("some"), F.max("floor").alias("floor"), F.max("rest").alias("rest"))
    hopeful = sums.filter(F.col("some") + F.col("rest") >= F.col("floor")).groupBy("sid", "doc", "path", "passage_no").agg(F.min("tie").alias("tie"))
    scored = _scored(hopeful, terms, searches)
    of_path = top_n(scored, ["sid", "path"], [F.col("tie"), F.col("score").desc(), F.col("passage_no")])
    best = staged(top_n(of_path, ["sid"], [F.col("score").desc(), F.col("tie")], top_k, rank="place").select("sid", "doc", "passage_no", "score", "place"))
    release(asked, index, asked_lists)
    return best
