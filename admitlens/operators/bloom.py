"""Bloom filters that grow with their values up to a bound: what cannot match is left out before a shuffle; an exact join follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 26
BITS_PER_VALUE = 16  # two probes then let about one in seventy others pass


def _probes(h: Column, bits: Column) -> list[Column]:
    """Two bit numbers from separate parts of a 64-bit hash."""
    return [F.pmod(h, bits), F.pmod(F.shiftright(h, 32), bits)]


def bloom_of(values: DataFrame, key: str) -> Column:
    """The filter of a column's values as a scalar subquery: longs of 64 bits, as many as the rows ask for within the bounds. Null is a value."""
    asked = F.ceil(F.count(F.lit(1)) * BITS_PER_VALUE / 64)
    longs = values.agg(F.greatest(F.lit(FEWEST_BITS // 64), F.least(F.lit(MOST_BITS // 64), asked)).cast("long")).scalar()
    found = values.select(F.explode(F.array(*_probes(F.xxhash64(key), longs * 64))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = found.groupBy(F.shiftright("bit", 6).alias("id")).agg(F.bit_or(one).alias("word"))
    every = values.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), longs - 1)).alias("id")).join(words, "id", "left")
    row = F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))
    return every.agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["word"]).alias("bloom")).scalar()


def may_have(bloom: Column, key: Column) -> Column:
    """False only for values that are not in the filter. `bloom` is a column that holds it."""
    probes = _probes(F.xxhash64(key), F.size(bloom).cast("long") * 64)
    tests = [F.getbit(F.get(bloom, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in probes]
    return tests[0] & tests[1]


def prefiltered(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among the wanted ones (`wanted` has a column of the same name). Follow with the exact join."""
    held = rows.withColumn("_bloom", bloom_of(wanted, key))
    return held.filter(may_have(F.col("_bloom"), F.col(key))).drop("_bloom")
