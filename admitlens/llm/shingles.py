"""Sets of word shingles and their min-hash signatures (numpy inside Arrow batches)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word, remembered up to a number of words."""

    limit = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; a shorter text is one run; no words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    runs = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        runs = runs * _BASE + h[j : j + len(runs)]
    return np.unique(mixed(runs + np.uint64(k)))


def multipliers(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, size, np.uint64) | np.uint64(1), r.integers(0, 2**63, size, np.uint64)


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """A row per set: its smallest member under each of the hash functions, as 31-bit numbers. No set may be empty."""
    out = np.full((len(sets), len(a)), np.iinfo(np.uint64).max)
    pieces = [(k, s[at : at + at_once]) for k, s in enumerate(sets) for at in range(0, len(s), at_once)]
    while pieces:
        n = int(np.searchsorted(np.cumsum([len(s) for _, s in pieces[:4096]]), at_once)) + 1
        part, pieces = pieces[:n], pieces[n:]
        rows, members = np.array([k for k, _ in part]), np.concatenate([s for _, s in part])
        starts = np.cumsum([0, *[len(s) for _, s in part[:-1]]])
        least = np.stack([np.minimum.reduceat(members * x + y, starts) for x, y in zip(a, b)], axis=1)
        np.minimum.at(out, rows, least)
    return (out >> np.uint64(33)).astype(np.int32)


def signature_udf(width: int, size: int, seed: int):
    """text -> (n: number of shingles, sig: signature, null without words)."""
    kind = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])
    a, b = multipliers(size, seed)

    @F.pandas_udf(kind)
    def signed(texts: pd.Series) -> pd.DataFrame:
        known = WordHashes()
        sets = [shingle_set(t, width, known) for t in texts]
        signs = iter(signatures([s for s in sets if len(s)], a, b))
        return pd.DataFrame({"n": [len(s) for s in sets], "sig": [next(signs) if len(s) else None for s in sets]})

    return signed


def set_udf(width: int):
    """text -> the shingle set as bytes of sorted 64-bit numbers."""

    @F.pandas_udf(T.BinaryType())
    def as_bytes(texts: pd.Series) -> pd.Series:
        known = WordHashes()
        return pd.Series([shingle_set(t, width, known).tobytes() for t in texts])

    return as_bytes
