"""Line de-duplication against its definition."""

import random
import re

import pytest

from admitlens.llm import linedup

LAST = (1 << 63) - 1


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({i: i + 32 for i in range(65, 91)})


def expected(rows, min_docs=2):
    ids = [LAST if i is None else i for i, _ in rows]
    holders = {}
    for i, (_, t) in zip(ids, rows):
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, (doc_id, t) in zip(ids, rows):
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= min_docs and i != min(holders[key(x)]))]
        out.append((str(doc_id), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 4])
def test_odd_rows(spark, min_docs):
    r = random.Random(6)
    lines = ["Hello World 12345", "  hello world 12345\t", "HELLO WORLD 12345\x0b", "ÉCLAIR éclair é", "éclair éclair é", "short", "", " ", "exactly 10", "not ten 9", "\xa0padded line here", "padded line here"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(99, None), (98, ""), (97, "\n"), (None, "Hello World 12345\nmine alone, only"), (None, "x"), (5, rows[5][1]), (5, "another text of five\nHello World 12345"), (70, "\n".join(["long common line"] * 3000)), (71, "long common line\n" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, n_lines int, kept string, doc int").repartition(5)
    got = linedup.line_verdicts(docs, min_docs=min_docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted((str(a), b, c, d) for a, b, c, d in got) == expected(rows, min_docs)
    out = linedup.line_dedup(docs)
    assert out.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((a, d) for a, _, _, d in expected(rows))
    assert linedup.line_dedup(docs.limit(0)).count() == 0
