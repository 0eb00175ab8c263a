"""Toxicity scores: a learned lexicon, misspellings of its terms, and what stands around them.

Terms (words and beginnings of words) come from the labelled training rows, with the weight of their log odds. Every word of a
text runs through the lexicon's fuzzy trie. A hit counts as quoted if it stands in paired quotation marks or if a word of reporting or
naming is near it. Words that lean to toxic texts without passing for terms, which is all that few labels give, count by their share of a text.
A logistic model over the hits and that share, fitted on other training rows, turns them into a score.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.llm.common import text_of
from admitlens.llm.lexicon import FuzzyTrie
from admitlens.sources.stage import staged

# Quotation marks by what they pair with, and words that report or name what somebody else says.
QUOTES = {**dict.fromkeys('"', 0), **dict.fromkeys("“”„", 1), **dict.fromkeys("«»", 2), **dict.fromkeys("‘’", 3)}
REPORTING = frozenset("said says say called calls wrote writes quote quoted term word slur sagte sagt nannte wort dit dijo mot llamó palabra".split())

FEATURES = ["strongest", "open_hits", "open_rate", "fuzzy_hits", "quoted_hits", "near_hits"]
_WORD = re.compile(r"\w+")
_BLANK_SEPARATED = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_MARK = re.compile(f"[{''.join(QUOTES)}\n\r]")


@dataclass(frozen=True)
class Toxicity:
    """Parameters. `most_rows` bounds the labelled rows that lexicon and model are fitted on, `most_terms` the lexicon and the leaning words."""

    folds: int = 5
    lexicon_folds: tuple[int, ...] = (1, 2, 3)
    most_rows: int = 20000
    most_terms: int = 2000
    stem: tuple[int, int] = (3, 7)
    window: int = 6
    precision: float = 0.6
    penalty: float = 1.0


def fold(doc_id: Column, t: Toxicity) -> Column:
    return F.crc32(doc_id.cast("string")) % t.folds


def _term_counts(t: Toxicity):
    """Texts that hold a term, by label, and a 64-bit set of the words before it: copies of one text add none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, texts in batch.groupby("toxic")["body"]:
                times, before = Counter(), defaultdict(int)
                for text in texts:
                    words = _WORD.findall(text.lower())
                    seen = {w: 1 << (crc32(p.encode()) & 63) for p, w in zip(["", *words], words) if len(w) > 2}
                    for w, bit in list(seen.items()):
                        for n in range(t.stem[0], min(t.stem[1] + 1, len(w))):
                            seen[w[:n] + "*"] = seen.get(w[:n] + "*", 0) | bit
                    times.update(seen.keys())
                    for term, bits in seen.items():
                        before[term] |= bits
                if not times:
                    continue
                sets = np.array([before[term] for term in times], np.uint64).astype(np.int64)
                yield pd.DataFrame({"term": list(times), "n": list(times.values()), "before": sets}).assign(toxic=toxic)

    return count


def learned_terms(rows: DataFrame, t: Toxicity) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """(term or stem*, log odds), at most `most_terms`: those whose share of toxic texts chance does not explain.

    Behind them as many words of the same share that chance may explain, best first.
    """
    totals = dict(rows.groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return [], []
    counts = rows.select("body", "toxic").mapInPandas(_term_counts(t), "term string, n long, before long, toxic int")
    of = lambda label, c: F.when(F.col("toxic") == label, F.col(c))
    sums = counts.groupBy("term").agg(F.sum(of(1, "n")).alias("x"), F.coalesce(F.sum(of(0, "n")), F.lit(0)).alias("y"), F.bit_count(F.bit_or(of(1, "before"))).alias("places"))
    told = F.when(F.col("places") >= 20, F.col("x")).otherwise(F.least("x", "places"))  # few words before it: few independent texts
    terms = staged(sums.filter("x > 0").select("term", told.cast("double").alias("x"), "y"))
    share, base = F.col("x") / (F.col("x") + F.col("y")), bad / (bad + good)
    gain = F.col("x") * F.log(share / base) + F.when(F.col("y") > 0, F.col("y") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("x") + 0.5) / (bad - F.col("x") + 0.5)) - F.log((F.col("y") + 0.5) / (good - F.col("y") + 0.5))
    need = float(np.log(max(terms.count(), 1)) + 3)
    likely = terms.filter(share >= t.precision).select("term", gain.alias("gain"), odds.alias("odds"))
    best = likely.filter(F.col("gain") >= need)
    # words and stems by themselves: a word has up to five stems with counts no lower than its own
    found = [best.filter(kind).orderBy(F.desc("gain"), "term").limit(t.most_terms).collect() for kind in (~F.endswith("term", F.lit("*")), F.endswith("term", F.lit("*")))]
    leaning = likely.filter((F.col("gain") < need) & ~F.endswith("term", F.lit("*"))).orderBy(F.desc("gain"), "term").limit(t.most_terms).collect()
    return apart([(r.term, r.odds, r.gain) for rows in found for r in rows], need)[: t.most_terms], [(r.term, r.odds) for r in leaning]


def apart(terms: list[tuple[str, float, float]], need: float) -> list[tuple[str, float]]:
    """Best terms first, of (term, weight, gain): all words, and stems of which none begins another.

    A stem whose gain is not greater than that of its best word by what a term needs gives way to that word as a stem.
    """
    terms = sorted(terms, key=lambda x: (-x[2], x[0]))
    best: dict[str, tuple[str, float, float]] = {}
    for word, *rest in terms:
        for n in range(1, len(word) + 1 if word[-1] != "*" else 0):
            best.setdefault(word[:n], (word, *rest))
    stems, begun, kept = set(), set(), []
    for term, weight, gain in terms:
        if term[-1] != "*":
            kept.append((gain, term, weight))
            continue
        stem, other = term[:-1], best.get(term[:-1])
        if other and gain < other[2] + need:
            stem, weight, gain = other
        if stem not in begun and not any(stem[:n] in stems for n in range(1, len(stem))):
            kept.append((gain, stem + "*", weight))
            begun.update(stem[:n] for n in range(1, len(stem) + 1))
            stems.add(stem)
    return [(term, weight) for _, term, weight in sorted(kept, key=lambda x: (-x[0], x[1]))]


def quoted_words(text: str, n: int) -> np.ndarray:
    """Which of the `n` blank-separated words lie in quotation marks that open and close on one line; others are unbalanced.

    A mark before a word opens, one behind a word closes, one with blanks around does either. Within a word it is none
    (don’t). Of single marks only ‘ opens and only ’ closes: a leading ’ is an apostrophe.
    """
    inside = np.zeros(n, bool)
    opened: dict[int, int] = {}
    pairs = []
    for found in _MARK.finditer(text):
        mark, at = found[0], found.start()
        if mark in "\n\r":
            opened.clear()
            continue
        before, behind, kind = text[at - 1 : at] or " ", text[at + 1 : at + 2] or " ", QUOTES[mark]
        alone = before.isspace() and behind.isspace()
        closes = mark != "‘" and (alone or not (before.isspace() or _WORD.match(behind)))
        opens = mark != "’" and (alone or not (behind.isspace() or _WORD.match(before)))
        if closes and kind in opened:
            pairs.append((opened.pop(kind), at))
        elif opens:
            opened[kind] = at
    if pairs:
        starts = [word.start() for word in _BLANK_SEPARATED.finditer(text)]
        for first, last in pairs:
            inside[bisect_right(starts, first) - 1 : bisect_right(starts, last)] = True
    return inside


class Scorer:
    """Features of a text; remembers the words it has looked up, up to a number of them."""

    limit = 500_000

    def __init__(self, terms: list[tuple[str, float]], window: int, leaning: Sequence[tuple[str, float]] = ()) -> None:
        self.trie = FuzzyTrie({w: x for w, x in terms if w[-1] != "*"}, {w[:-1]: x for w, x in terms if w[-1] == "*"}, swaps=True)
        self.window, self.hits, self.known, self.weights = window, [None], _Known(self), dict(leaning)

    def leaning(self, text: str) -> float:
        """Weights of the leaning words of a text, for each of its distinct words."""
        if not self.weights:
            return 0.0
        words = set(_WORD.findall(text.lower()))
        return min(10.0, 10 * sum(self.weights[w] for w in sorted(words & self.weights.keys())) / max(len(words), 1))

    def look_up(self, raw: bytes) -> int:
        """Number of the hit of a blank-separated word, 0 for none."""
        best = None
        for word in _WORD.findall(raw.decode("utf-8", "replace").lower()):
            hit = self.trie.find(word)
            if hit and (best is None or hit > best):
                best = hit
        if best is None:
            return 0
        self.hits.append(best)
        return len(self.hits) - 1

    def features(self, text: str) -> list[float]:
        words = text.encode("utf-8", "surrogatepass").split()
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(numbers)
        if not len(at):
            return [0.0] * len(FEATURES)
        inside = quoted_words(text, len(words))
        strongest, open_hits, fuzzy, quoted, near = 0.0, 0, 0, 0, 0
        for k, i in enumerate(at):
            weight, edits = self.hits[numbers[i]]
            around = words[max(0, i - self.window) : i + self.window + 1]
            reported = any(w.decode("utf-8", "replace").lower().strip(".,;:!?") in REPORTING for w in around)
            if inside[i] or reported:
                quoted += 1
                continue
            fuzzy += edits > 0
            open_hits += edits == 0
            strongest = max(strongest, weight / (1 + edits))
            near += k > 0 and i - at[k - 1] <= self.window
        return [strongest, np.log1p(open_hits), min(10.0, 100 * open_hits / len(words)), np.log1p(fuzzy), np.log1p(quoted), np.log1p(near)]


class _Known(dict):
    def __init__(self, scorer: Scorer) -> None:
        super().__init__()
        self.scorer = scorer

    def __missing__(self, raw: bytes) -> int:
        number = self.scorer.look_up(raw)
        if len(self) < self.scorer.limit:
            self[raw] = number
        return number


_scorers: dict = {}


def _scorer(terms: tuple, window: int, leaning: tuple) -> Scorer:
    """The worker process keeps the last one."""
    if (terms, window, leaning) not in _scorers:
        _scorers.clear()
        _scorers[terms, window, leaning] = Scorer(list(terms), window, leaning)
    return _scorers[terms, window, leaning]


def features_udf(terms: Sequence[tuple[str, float]], leaning: Sequence[tuple[str, float]], window: int):
    kept, weak = tuple(terms), tuple(leaning)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(texts: pd.Series) -> pd.Series:
        scorer = _scorer(kept, window, weak)
        return pd.Series([[*scorer.features(t), scorer.leaning(t)] for t in texts])

    return features


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 50) -> np.ndarray:
    """Weights (the constant first) by Newton steps; the constant is not held back."""
    x = np.column_stack([np.ones(len(x)), x])
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    hold[0] = 1e-6
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(hold), x.T @ (y - p) - hold * w * (np.arange(len(w)) > 0))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, t: Toxicity = Toxicity()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Only labelled rows whose fold is not 0 teach; if they are more than `most_rows`, a share of them chosen by hash does. Labels, lang,
    source and doc_id are no inputs of a score. A null or empty text has no hits and gets the score of such texts; without both
    kinds of labels there is no lexicon and every score is the share of toxic rows. A null doc_id is not held out and
    teaches nothing. Repeated rows get equal scores; other columns are not read.
    """
    teaching = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & (fold(F.col("id"), t) != 0))
    n = teaching.count()
    share = int(min(1.0, t.most_rows / max(n, 1)) * (1 << 30))
    chosen = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) < share
    rows = docs.filter(chosen(F.col("doc_id")) & (fold(F.col("doc_id"), t) != 0)).select("doc_id", text_of().alias("body"))
    rows = staged(rows.join(teaching.filter(chosen(F.col("id"))), F.col("doc_id") == F.col("id")).select("body", "toxic", fold(F.col("doc_id"), t).alias("fold")))
    first = F.col("fold").isin(*t.lexicon_folds)
    features = features_udf(*learned_terms(rows.filter(first), t), window=t.window)
    taught = rows.filter(~first).select("toxic", features("body").alias("x")).collect()  # at most most_rows short arrays
    w = logistic(np.array([r.x for r in taught]).reshape(-1, len(FEATURES) + 1), np.array([r.toxic for r in taught], float), t.penalty)
    scored = docs.select("doc_id", features(text_of()).alias("x"))
    z = F.lit(float(w[0]))
    for k in range(len(FEATURES) + 1):
        z = z + F.lit(float(w[k + 1])) * F.get("x", F.lit(k))
    held_out = F.coalesce(fold(F.col("doc_id"), t) == 0, F.lit(False)).alias("held_out")
    scores = scored.select("doc_id", held_out, (1 / (1 + F.exp(-z))).alias("score"))
    return scores.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
