"""The chosen-path join against all pairs."""

import random

import numpy as np
import pytest

from admitlens.llm import chosenpath

LAST = (1 << 63) - 1


def shingles(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            shared = len(a & b)
            if (rows[i][1] or "") == (rows[j][1] or "") or shared and shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = [LAST if i is None else i for i, _ in rows]
    parts = {}
    for i in range(len(rows)):
        parts.setdefault(find(i), []).append(ids[i])
    return sorted((str(rows[i][0]), n[i], min(parts[find(i)]), ids[i] == min(parts[find(i)])) for i in range(len(rows)))


def got(docs):
    return sorted((str(r.doc_id), r.n_links, r.class_id, r.kept) for r in chosenpath.links_of_documents(docs).collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == all_pairs([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_a_large_group(spark):
    r = random.Random(3)
    words = [f"w{r.random():.9f}" for _ in range(400)]
    rows = [(i, " ".join(words[:120] + [f"x{i}"] + words[121:200])) for i in range(250)]  # one edit each: all within the threshold
    rows += [(1000 + i, " ".join(words[200:260])) for i in range(40)] + [(None, None), (None, ""), (5000, ""), (5001, "a b"), (5002, "a  b"), (5003, "a b c"), (None, "q r s t u v")]
    rows += [(7, rows[7][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, c int, n string").repartition(5)
    assert got(docs) == all_pairs(rows)
    kept = chosenpath.keep_first(docs)
    assert kept.columns == docs.columns
    want = {(a, t) for a, t, *_ in kept.collect()}
    assert {a for a, _ in want} == {0, 1000, 5000, 5001, 5003, None}
    assert got(docs.limit(0)) == []


def test_runs_of_one_signature_keep_the_recall():
    p, r, rounds = chosenpath.ChosenPath(), np.random.default_rng(8), 400_000
    equal = r.binomial(p.tokens, p.threshold, rounds)
    share, missed = equal / p.tokens, np.ones(rounds)
    parted = np.zeros(rounds)
    for _ in range(p.depth):
        one = 1 - share + share * parted
        parted = one * (1 - p.second) + one**2 * p.second
    met = equal >= p.least_equal
    missed[met] = parted[met] ** p.runs
    assert missed.mean() <= 1.1 * (1 - p.recall)
    with pytest.raises(ValueError):
        chosenpath.ChosenPath(tokens=4).runs
