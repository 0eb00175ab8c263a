"""Mixing: targets, quotas of blocks and taken words."""

import re
from collections import Counter, defaultdict

import pytest

from admitlens.llm import mixing
from admitlens.llm.mixing import Mix


def expected_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        weight = sum(w[s] for s in free)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / weight for s in names}
        over = {s for s in free if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def check(docs, plan):
    sizes, longest = Counter(), Counter()
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    want = expected_targets(sizes)
    rows, taken = plan.collect(), Counter()
    assert len(rows) == docs.count()
    for r in rows:
        assert len(r.taken) <= 3
        taken[r.doc_id] += 0
    by = defaultdict(int)
    source = {(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))): r.source for r in docs.collect()}
    for r in rows:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        by[s] += r["size"] * len(r.taken)
    for s, t in want.items():
        assert abs(by[s] - t) <= longest[s] / 2 + 1e-6, (s, by[s], t)
    return rows


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = check(docs, mixing.draws(docs))
    again = mixing.draws(docs.repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 9), ["a", "b", None][i % 3]) for i in range(200)] + [(9, "x y", "rare"), (None, "n n n", None), (None, None, "empty"), (4, "r s", "b"), (4, "r s", "b"), (4, "r s", "b")]
    docs = spark.createDataFrame([(i, t, s, 1, "q") for i, t, s in rows], "doc_id long, text string, source string, size int, h string")
    check(docs, mixing.draws(docs))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    plan = mixing.draws(docs).groupBy("doc_id", "size").agg({"*": "count"}).collect()
    want = Counter()
    for r in mixing.draws(docs).collect():
        want[r.doc_id, r["size"]] += len(r.taken)
    got = Counter((r.doc_id, len((r.text or "").split())) for r in mix.collect())
    assert got == +want and plan
    assert mixing.draws(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_tree_deals_exact_quotas(spark):
    m = Mix()
    blocks = {0: 700, 1: 31, 2: 1, 3: 0, 4: 268}
    sources = spark.createDataFrame(list(blocks.items()), "sid int, blocks long")
    rows = mixing.shard_quotas(sources, 7, m).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.sid] += r.k
        by_shard[r.shard] += r.k
    assert by_source == +Counter(blocks)
    assert sum(by_shard.values()) == 1000 and set(by_shard.values()) <= {142, 143}
    assert max(abs(r.k - 100) for r in rows if r.sid == 0) < 40


def test_draws_follow_the_distribution(spark):
    from pyspark.sql import functions as F

    n = 4000
    draw = mixing._hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), mixing._uniform(F.lit(5), F.col("id")))
    got = [r.x for r in spark.range(n).select(draw.alias("x")).collect()]
    mean = sum(got) / n
    variance = sum((x - mean) ** 2 for x in got) / n
    assert abs(mean - 4) < 0.1 and abs(variance - 10 * 0.4 * 0.6 * 20 / 29) < 0.15 and 0 <= min(got) and max(got) <= 10


def test_rows_that_differ_in_other_columns_stay_apart(spark):
    rows = [(i, f"w x{i}", "a", *other) for i in range(20) for other in (("de", None), (None, "de"), ("fr", "de"), ("fr", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, more string")
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == Counter(rows)
