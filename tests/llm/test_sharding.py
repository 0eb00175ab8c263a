"""Shards: whole groups, near equal bytes, slots without gaps; differencing against its own definition."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from admitlens.llm import sharding
from admitlens.llm.sharding import Sharding


def check(docs, rows, shards):
    by_text, slots, sums = {}, defaultdict(list), defaultdict(int)
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(r.text or "")
    assert len(rows) == sum(map(len, text.values()))
    for r in rows:
        body = next(t for t in text[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32)
        assert r.size == len(body.encode()) + 16
        assert by_text.setdefault(body, r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    groups = defaultdict(int)
    for r in rows:
        groups[r.text_crc32] += r.size
    return [sums[k] for k in range(shards)], max(groups.values(), default=0)


@pytest.mark.parametrize("sf,bucket", [("0.01", 2048), ("0.01", 250), ("0.1", 2048), ("0.1", 250)])
def test_documents(spark, sf, bucket):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    sums, largest = check(docs, sharding.shards_of(docs, Sharding(bucket=bucket, fan_in=4)).collect(), 40)
    assert max(sums) - min(sums) <= max(64, largest - min(sums))


def test_tree_of_small_buckets(spark):
    """Whole groups and gapless slots where buckets hold fewer groups than there are shards; the balance is then rough."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums, _ = check(docs, sharding.shards_of(docs, Sharding(bucket=20, fan_in=4, single=150)).collect(), 40)
    assert max(sums) - min(sums) <= 0.2 * sum(sums) / 40


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é"), (3, "é"), (None, "x"), (None, None), (4, "x" * 5000)] + [(10 + i, f"t{i % 7}") for i in range(60)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, size int, bucket int")
    check(docs, sharding.shards_of(docs, Sharding(shards=5, bucket=3, fan_in=2, single=2)).collect(), 5)
    assert sharding.shards_of(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_differencing(seed):
    rng = np.random.default_rng(seed)
    sums = np.zeros((300, 8), np.int64)
    sums[:, 0] = rng.integers(1, 10**6, 300)
    sums[:50] = rng.integers(1, 10**5, (50, 8))
    total, to = sharding.differenced(sums)
    again = np.zeros(8, np.int64)
    for row, where in zip(sums, to):
        assert sorted(where) == list(range(8))
        again[where] += row
    assert (again == total).all() and total.max() - total.min() < 2000
    two = np.zeros((5, 2), np.int64)
    two[:, 0] = [8, 7, 6, 5, 4]
    total, _ = sharding.differenced(two)
    assert sorted(total) == [14, 16]  # differencing's answer to the textbook case
