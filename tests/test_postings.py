"""The keyword index and the best documents of searches against counting in every passage; filters against sets."""

import random

import pytest
from pyspark.sql import functions as F

from admitlens.operators import bloom, postings
from admitlens.sources.stage import staged


def passages(text, size, step):
    return [text] if len(text) <= size else [text[i : i + size] for i in range(0, len(text), step)]


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_terms_and_best_documents(spark, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    r = random.Random(3)
    words = ["aa", "a", "aba", "招生", "招生计划", "b c", "zz"]
    texts = {i: "".join(r.choice(["a", "b", " ", "c", "招", "生", "计划"]) for _ in range(r.randrange(60))) for i in range(80)}
    texts |= {80: None, 81: "", 82: texts[3], 83: "q" * 100}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc long, text string, extra string").repartition(3)
    asked = staged(spark.createDataFrame([(w,) for w in words], "word string"))
    terms = staged(postings.passage_terms(docs.drop("extra"), "text", asked, "word", 20, 15))
    got = {}
    for row in terms.collect():
        for t in row.terms:
            assert got.setdefault((row.doc, row.passage_no, t.word), t.hits) == t.hits
    want = {(i, k, w): p.count(w) for i, t in texts.items() for k, p in enumerate(passages(t or "", 20, 15)) for w in words if w in p}
    assert got == want

    searches = [(s, [r.choice(words) for _ in range(r.randrange(5))]) for s in range(60)]
    wanted = sorted({(s, f"g{r.randrange(4)}") for s, _ in searches for _ in range(2)})
    members = [(f"g{i % 4}", i, f"p{i % 70}", (i % 2, -i)) for i in texts] + [("g0", i, f"p{i % 70}", (2, i)) for i in range(1, 80, 9)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    best = postings.best_documents(
        staged(frame(searches, "sid long, words array<string>")), frame(wanted, "sid long, grp string"),
        frame(members, "grp string, doc long, path string, tie struct<a:int,b:int>"), terms, 2,
    )
    expect = []
    for s, asks in searches:
        found = {}
        for g, doc, path, tie in members:
            if (s, g) not in wanted:
                continue
            score, at = max((sum(p.count(w) for w in asks), -k) for k, p in enumerate(passages(texts[doc] or "", 20, 15)))
            if score and (path not in found or tie < found[path][1]):
                found[path] = (-score, tie, doc, -at)
        expect += [(s, doc, at, -score, k + 1) for k, (score, _, doc, at) in enumerate(sorted(found.values())[:2])]
    assert sorted((x.sid, x.doc, x.passage_no, x.score, x.place) for x in best.collect()) == sorted(expect)


def test_no_keywords(spark):
    docs = spark.createDataFrame([(1, "text")], "doc long, text string")
    none = staged(spark.createDataFrame([], "word string"))
    assert postings.passage_terms(docs, "text", none, "word").count() == 0


def test_bloom(spark):
    rows = spark.range(5000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), "id")).alias("k"))
    wanted = rows.filter("k IS NULL OR k LIKE '%7'")
    kept = bloom.prefiltered(rows, "k", wanted)
    assert kept.count() < 700 and kept.exceptAll(wanted).count() + 501 == kept.count()
    assert bloom.prefiltered(rows, "k", wanted.limit(0)).count() == 0


def test_bloom_grows_with_its_values(spark):
    """As many bits for each of many values as for few: rows that are not wanted are left out all the same."""
    wanted = spark.range(600000).selectExpr("id AS k")
    rows = spark.range(590000, 700000).selectExpr("id AS k")
    kept = bloom.prefiltered(rows, "k", wanted)
    assert kept.filter("k < 600000").count() == 10000
    assert kept.filter("k >= 600000").count() < 5000
