"""Counts by their definition, fences by quartiles, odd rows."""

import random
import re

import pytest

from admitlens.llm import quality
from admitlens.llm.quality import QualityRules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + d for i, x in enumerate(three) if three.count(x) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("text", ["", " ", "a b c a b c a b c", "x x x x x", "é\x1cb #\n#\n \n#\n", "a b c d a b c\na b c d a b c\n" * 3, "\x85 \xa0 <|>"])
def test_counts(text):
    assert quality.text_counts(text) == counts(text)


def test_random_counts():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", " ", "\n", "a b ", "#", "é"]) for _ in range(r.randrange(60)))
        assert quality.text_counts(text) == counts(text)


def test_verdicts_and_odd_rows(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(80)), "en", "a") for i in range(150)]
    rows += [(200, " ".join(word() + " #" for _ in range(80)), "en", "a"), (201, None, "en", "a"), (202, "", None, None), (203, "one two " * 60, "en", "a"), (204, " ".join(word() for _ in range(80)), None, None)]
    rows += [(205, " ".join(word() * 9 for _ in range(80)), "en", "new"), (None, rows[0][1], "en", "a"), (1, rows[1][1], "en", "a")]
    docs = spark.createDataFrame([(*x, 1, False) for x in rows], "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    got = {(r.doc_id, r.n_words): r for r in quality.quality_verdicts(docs).collect()}
    assert quality.quality_verdicts(docs).count() == len(rows)
    for i, text, *_ in rows:
        c = counts(text)
        g = got[i, c[0]]
        assert tuple(g)[1:6] == c and g.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
    assert not any(got[i, n].kept for i, n in got if i in (200, 201, 202, 203, 205))
    assert all(g.kept for (i, _), g in got.items() if i is None or i < 150) and got[204, 80].kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 150 + 3
    assert quality.quality_verdicts(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_cells_hold_their_values(spark):
    df = spark.range(0, 70000, 7).selectExpr("id as v").select("v", quality._cell("v").alias("cell")).select("v", "cell", quality._cell_value("cell").alias("low"))
    rows = df.orderBy("v").collect()
    assert all(r.low <= r.v <= max(r.low, r.low * 33 // 32) for r in rows)
    assert [r.cell for r in rows] == sorted(r.cell for r in rows)


def test_histograms_merge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.measured(docs, QualityRules()).persist()
    whole = quality.sketches(rows)
    parts = quality.sketches(rows.filter("doc_id % 2 = 0")).union(quality.sketches(rows.filter("doc_id % 2 = 1")))
    merged = parts.groupBy("lang", "source", "measure", "cell").sum("n")
    assert sorted(map(str, map(tuple, whole.collect()))) == sorted(map(str, map(tuple, merged.collect())))
