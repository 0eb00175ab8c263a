"""Double arrays against dictionaries; nodes of the conversation trie against all prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from admitlens.llm import doublearray, prefixtrie
from admitlens.llm.prefixtrie import Tries


@pytest.mark.parametrize("seed", range(4))
def test_double_array(seed):
    r = random.Random(seed)
    letters = [1, 3, 40, 5000][seed]
    seqs = [[r.randint(1, letters) for _ in range(r.randrange(7))] for _ in range(400)] + [[1] * 30, []]
    ids = np.array([c for s in seqs for c in s], np.int64)
    sizes = np.array([len(s) for s in seqs])
    trie = doublearray.pack(ids, np.cumsum(sizes) - sizes, sizes)
    want = {tuple(s[:d]) for s in seqs for d in range(1, len(s) + 1)}
    assert (trie.check >= 0).sum() == len(want)
    place = {(): 0}
    for d, live, at in trie.walk(ids, np.cumsum(sizes) - sizes, sizes):
        for k, x in zip(live.tolist(), at.tolist()):
            assert place.setdefault(tuple(seqs[k][:d]), x) == x and trie.check[x] == place[tuple(seqs[k][: d - 1])]
    assert set(place) == want | {()} and len(set(place.values())) == len(place)
    for s in list(want)[:200]:
        for c in range(1, min(letters, 50) + 2):
            assert (trie.children(np.array([place[s]]), np.array([c]))[0] >= 0) == ((*s, c) in want)


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = (*own.get(c - int(np.fmod(c, 20)), [])[:h], *v[h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in nodes.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + own_saved
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if seqs[c] == p)
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [Tries(), Tries(shard_turns=60, id_bits=2)])
def test_odd_rows(spark, p):
    r = random.Random(7)
    rows = []
    for c in [*range(150), *range(1000, 1300, 7), -1, -20, -45]:
        base = r.randrange(4)
        rows += [(c, t or r.choice([None, 0]), r.choice(["user", "user", None]), f"turn {base if t < 2 else r.randrange(3)} {t}") for t in range(r.randrange(1, 7))]
    rows += [(2000 + k, t, "user", f"long {t}") for k in range(3) for t in range(60)]
    rows += [(3000 + 20 * k, 1, "user", "the same") for k in range(60)]
    rows += [(5001, 0, "user", "gone"), (5019, 0, None, None), (5019, 1, "", ""), (None, 1, "user", "nobody"), (6000, 3, "user", "tie"), (6000, 3, "user", "tie")]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, "k") for x in rows], "conv_id long, turn long, role string, text string, h1 string").repartition(5)
    got = [tuple(x) for x in prefixtrie.prefix_nodes(frame, p).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert prefixtrie.prefix_nodes(frame.limit(0), p).count() == 0


def test_arrays(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    tries = prefixtrie.conversation_tries(frame, Tries(shard_turns=100)).collect()
    nodes = prefixtrie.prefix_nodes(frame).count()
    assert len(tries) > 1 and nodes <= sum(sum(c >= 0 for c in t.check) + 1 for t in tries) < nodes + 10 * len(tries)
    for t in tries:
        trie = doublearray.DoubleArray(np.array(t.base), np.array(t.check))
        taken = np.flatnonzero(trie.check >= 0)
        ids = taken - trie.base[trie.check[taken]]
        assert (ids >= 1).all() and (ids <= len(t.h1)).all() and (trie.children(trie.check[taken], ids) == taken).all()


def test_ties_are_ordered_by_their_hashes_alone(spark):
    rows = [(1, 5, "user", t) for t in ("a", "b", "c")]
    one, two = (spark.createDataFrame(x, "conv_id long, turn long, role string, text string") for x in (rows, rows[::-1]))
    key = lambda df: sorted(map(str, prefixtrie.prefix_nodes(df).collect()))
    assert key(one) == key(two)
