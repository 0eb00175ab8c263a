"""Whitening against exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np

from admitlens.llm import whitening
from admitlens.llm.whitening import Whitening


def check(rows, out, components=16):
    good = [(i, tuple(math.floor(64 * float(np.float64(e))) + 1_000_000 for e in v)) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    fit = sorted({x for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    exact = [[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) for j in range(d)] for i in range(d)]
    v = np.array([[float(Fraction(exact[i][j], n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    order = [k for k in order if e[k] > 1e-9 * e.max()]
    assert len(out) == len(good) * len(order)
    of = {}
    for r in out:
        of.setdefault((str(r.vec_id), int(r.deviation)), []).append(r)
    for r in out:
        k = order[r.component - 1]
        assert r.n == n and abs(r.explained - e[k] / np.trace(v)) <= 1e-9 * r.explained and r.identity_error < 1e-6
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        mine = of[str(i), deviation]
        for k in order:
            want = sum((a - s / n) * b for a, s, b in zip(x, sums, u[:, k])) / math.sqrt(e[k])
            assert any(abs(abs(r.whitened) - abs(want)) < 1e-6 for r in mine if r.component == order.index(k) + 1)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [3, 2, 1, 0.5, 0.25]]) for i in range(80)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [math.nan] * 5), (103, [math.inf] * 5), (104, [0.0] * 5), (105, [1e3] * 5), (106, [-0.001] * 5)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, x string").repartition(5)
    out = whitening.whitened_embeddings(frame).collect()
    check(rows, out)
    assert whitening.whitened_embeddings(frame.limit(0)).count() == 0
    more = frame.union(spark.createDataFrame([(300, [1.0, 2.0], 0, ""), (301, [], 0, "")], frame.schema))
    assert whitening.whitened_embeddings(more).count() == len(out)  # other lengths
    assert whitening.whitened_embeddings(frame.filter("vec_id >= 200")).count() == 0  # equal ones alone


def test_fewer_dimensions_than_vectors_span(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = whitening.whitened_embeddings(frame).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12
    check(rows, out)
    assert {r.component for r in whitening.whitened_embeddings(frame, Whitening(components=0)).collect()} == set()


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    c = rng.integers(-(1 << 41), 1 << 41, (50, 4))
    got = whitening.squares(c)
    for i in range(4):
        assert got[i, i] == sum(int(a) ** 2 for a in c[:, i])
        for j in range(i + 1, 4):
            assert got[i, j] == sum((int(a) + int(b)) ** 2 for a, b in zip(c[:, i], c[:, j]))


def test_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in frame.collect()], whitening.whitened_embeddings(frame).collect())
