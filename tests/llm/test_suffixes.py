"""Repeated strings against a dictionary of all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from admitlens.llm import suffixes
from admitlens.llm.suffixes import Repeats


def expected(rows, length):
    data = [(t or "").encode() for _, t in rows]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        out.append((str(doc_id), len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("together", [2048, 2])
def test_odd_texts(spark, together):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 90, 300)]
    rows = [(i, word(r.randrange(80)) + r.choice(shared) + word(r.randrange(60)) + r.choice([*shared, ""])) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, None), (301, ""), (None, "x"), (None, word(70)), (302, "ab" * 300), (303, "z" * 39), (304, "z" * 40), (305, "y" * 41), (3, rows[3][1])]
    p = Repeats(length=40, sample=9, block=64, together=together)
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t in rows], "doc_id long, text string, n_bytes int, c binary").repartition(4)
    assert got(suffixes.repeated_bytes(docs, p)) == expected(rows, 40)
    assert suffixes.repeated_bytes(docs.limit(0), p).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(suffixes.repeated_bytes(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()], 200)


def test_names_tell_strings_apart():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=3000)), np.uint8)
    for length in (1, 2, 3, 5, 9, 24, 40, 200):
        by = {}
        for i, n in enumerate(suffixes.names(data, length).tolist()):
            assert by.setdefault(n, data[i : i + length].tobytes()) == data[i : i + length].tobytes()
        assert len(suffixes.names(data, length)) == 3001 - length
        assert len(by) == len(set(data[i : i + length].tobytes() for i in range(3001 - length)))
