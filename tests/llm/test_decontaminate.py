"""The FM-index against sorted suffixes and plain search; contaminated words against all windows."""

import random
import re

import numpy as np
import pytest

from admitlens.llm import decontaminate, fmindex
from admitlens.llm.decontaminate import Windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("seed", range(4))
def test_index(seed):
    r = np.random.default_rng(seed)
    letters = [2, 5, 300, 70_000][seed]
    parts = [r.integers(1, letters + 1, r.integers(0, 40)) for _ in range(60)]
    parts += [parts[3]] * 5 + [np.full(70, 1), np.array([], int)]
    text = np.concatenate([np.append(x, 0) for x in parts]).astype(np.int32)
    ends = np.flatnonzero(text == 0)
    whole = [(int(np.searchsorted(ends, i)) - len(ends),) if c == 0 else (int(c),) for i, c in enumerate(text)]
    order = sorted(range(len(text)), key=lambda i: [x for y in whole[i:] for x in y])
    assert fmindex.suffix_array(text).tolist() == order
    index = fmindex.FmIndex(fmindex.build(text, letters))
    assert index.locate(np.flatnonzero(text[np.array(order)] != 0)).tolist() == [i for i in order if text[i] != 0]
    patterns = np.full((200, 4), -1)
    for k in range(200):
        n, at = r.integers(1, 5), r.integers(0, len(text) - 4)
        found = text[at : at + n] if k % 2 else r.integers(0, letters + 1, n)
        patterns[k, 4 - n :] = found
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi):
        p = p[p >= 0]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()] if p.all() else []
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def expected(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (ids := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= ids
        spans = [[i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]]
        out.append((str(doc_id), len(w), len(hit), sorted(found), [list(s) for s in zip(*spans)]))
    return sorted(out)


@pytest.mark.parametrize("p", [Windows(), Windows(shard_words=50, piece_bytes=20, block=7, at_once=3)])
def test_odd_rows(spark, p):
    r = random.Random(2)
    text = lambda n: "".join(r.choice(["a", "B", "ab", "é", "İ", "x9"]) + r.choice([" ", ", ", "\n", "\x00", "_"]) for _ in range(n))
    shared = [text(n) for n in (10, 11, 25, 3, 1)]
    items = [(i, s + text(2)) for i, s in enumerate(shared)] + [(None, shared[0]), (50, None), (51, ""), (52, "zz"), (0, shared[2]), (53, "..."), (54, shared[3])]
    docs = [(i, text(r.randrange(40)) + " " + r.choice(shared) + " " + text(r.randrange(40))) for i in range(60)]
    docs += [(1, docs[1][1]), (1, docs[2][1]), (None, docs[3][1]), (None, None), (70, None), (71, ""), (72, "zz ZZ"), (73, "q" * 300), (74, "." * 300)]
    docs += [(100 + i, docs[5][1]) for i in range(20)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = decontaminate.contamination(frame, bench, p).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x["items"], [list(s) for s in x.spans]) for x in rows) == expected(docs, items, 10)
    assert decontaminate.contamination(frame.limit(0), bench, p).count() == 0
    assert {x.n_hit for x in decontaminate.contamination(frame, bench.limit(0), p).collect()} == {0}


def test_removal(spark):
    phrase = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Before, {phrase.title()}. After", 5), (2, "clean text", 6), (None, None, 7), (3, phrase, 8), (3, phrase, 9)], "doc_id long, text string, _cut int")
    items = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    got = sorted((r._cut, r.doc_id, r.text) for r in decontaminate.decontaminated(docs, items).collect())
    assert got == [(5, 1, "Before, . After"), (6, 2, "clean text"), (7, None, None), (8, 3, ""), (9, 3, "")]
