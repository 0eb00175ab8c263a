"""Lines that stand in several documents stay in the first one only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.llm.common import BLANKS, LAST_ID, let, text_of, two_hashes
from admitlens.sources.stage import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Blanks cut at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def line_verdicts(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Every row of `docs` as a struct `row`, with n_lines, n_dropped and the remaining text `kept`.

    A line whose key has at least `min_chars` code points and is found in at least `min_docs` documents is
    dropped everywhere but in the smallest doc_id that holds it. A null or empty text is one empty line and
    comes back empty; a null doc_id counts as the largest id; rows of one doc_id are one document; the names
    of other columns do not matter.
    """
    body = text_of()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), body.alias("body"), F.xxhash64(body).alias("t"))
    lines = rows.select("doc", "t", F.posexplode(F.split("body", "\n")).alias("at", "line")).select("doc", "t", "at", line_key(F.col("line")).alias("key"))
    h1, h2 = two_hashes(F.col("key"))
    hashed = lines.filter(F.length("key") >= min_chars).select("doc", "t", "at", h1.alias("h1"), h2.alias("h2"))
    if min_docs == 2:  # the first and the last holder differ: no need to count holders
        counted = hashed.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    else:
        counted = hashed.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count_distinct("doc").alias("holders")).filter(F.col("holders") >= min_docs)
    repeated = staged(counted.select("h1", "h2", "first"))
    hits = hashed.join(repeated, ["h1", "h2"]).filter(F.col("doc") > F.col("first"))
    drops = hits.groupBy("doc", "t").agg(F.collect_set("at").alias("drops"))
    joined = rows.join(drops, ["doc", "t"], "left")
    split = F.split("body", "\n")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drops"))
    rest = let(split, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    n_dropped = F.coalesce(F.size("drops"), F.lit(0)).cast("long")
    return joined.select(
        "row", F.size(split).cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("body")).otherwise(rest).alias("kept"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with the remaining lines as text, all columns kept."""
    verdicts = line_verdicts(docs, min_chars, min_docs)
    kept = F.col("kept").alias("text")
    return verdicts.select(*[kept if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
