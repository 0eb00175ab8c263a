"""The fuzzy trie against edit distances; held-out accuracy; quotation; odd rows."""

import os
import random
from zlib import crc32

import pytest

from admitlens.llm import toxicity
from admitlens.llm.lexicon import FuzzyTrie


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_finds_what_edit_distance_allows():
    r = random.Random(5)
    terms = {"".join(r.choice("abc") for _ in range(r.randrange(2, 11))): r.random() for _ in range(40)}
    trie = FuzzyTrie(terms, {"ccc": 9.0})
    for _ in range(3000):
        word = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
        fits = [(distance(word, t), -w) for t, w in terms.items() if distance(word, t) <= (len(t) >= 5) + (len(t) >= 8)]
        want = (-min(fits)[1], min(fits)[0]) if fits else ((9.0, 0) if word.startswith("ccc") else None)
        assert trie.find(word) == want, word


def test_quoted_hits_count_apart():
    scorer = toxicity.Scorer([("idiot", 5.0), ("vequ*", 4.0)], 6)
    at = dict(zip(toxicity.FEATURES, range(6)))
    plain, quoted, told = (scorer.features(t) for t in ("you are an idiot now", 'they put "idiot" here', "she said he was an idiot"))
    assert plain[at["open_hits"]] > 0 and plain[at["quoted_hits"]] == 0
    assert quoted[at["open_hits"]] == told[at["open_hits"]] == 0 and quoted[at["quoted_hits"]] > 0 and told[at["quoted_hits"]] > 0
    assert scorer.features("an idiiot")[at["fuzzy_hits"]] > 0 and scorer.features("vequance")[at["strongest"]] == 4.0
    assert scorer.features("") == [0.0] * 6


@pytest.mark.parametrize("folder, least", [("sf0.1", 0.8), ("check_s", 0.95)])  # sf0.1 has 400 toxic labels to learn from
def test_held_out_accuracy(spark, folder, least):
    if not os.path.isdir(f"/root/testdata/{folder}"):
        pytest.skip("the check tool's tables are not there")
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{folder}/labels.parquet")
    if folder == "check_s":
        docs = docs.filter("doc_id % 6 = 1")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    found = sum(r.predicted for r in rows if r.toxic)
    assert found >= least * sum(r.toxic for r in rows) and sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x y", 0), (3, "w " * 100000, 0), (3, "w " * 100000, 0)], "doc_id long, text string, toxic int")
    for labels in ([], [(1, 1, 0), (2, 0, 0)], [(3, None, 1), (None, 1, 1), (7, 1, 1)]):
        rows = toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    assert toxicity.toxicity_scores(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).count() == 0


def swapped_distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_with_swapped_letters():
    r = random.Random(6)
    terms = {"".join(r.choice("abc") for _ in range(r.randrange(2, 11))): r.random() for _ in range(40)}
    trie = FuzzyTrie(terms, {}, swaps=True)
    for _ in range(3000):
        word = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
        fits = [(swapped_distance(word, t), -w) for t, w in terms.items() if swapped_distance(word, t) <= (len(t) >= 5) + (len(t) >= 8)]
        assert trie.find(word) == ((-min(fits)[1], min(fits)[0]) if fits else None), word


def test_words_stay_beside_stems():
    terms = [("idi*", 7.0, 90.0), ("idio*", 7.0, 90.0), ("idiot", 7.0, 90.0), ("vul*", 5.0, 60.0), ("vulgar", 5.0, 30.0), ("vulpe", 4.0, 25.0)]
    assert toxicity.apart(terms, 10.0) == [("idiot", 7.0), ("idiot*", 7.0), ("vul*", 5.0), ("vulgar", 5.0), ("vulpe", 4.0)]


def test_misspelled_learned_terms_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    wrong = {"pathetic": "pahtetic", "worthless": "worhtless", "stupid": "sutpid", "idiot": "ldiot", "trash": "trsah", "moron": "morron"}
    plain = docs.join(labels.filter("toxic = 0"), "doc_id").filter("text not like '%\"%' and length(text) > 100").orderBy("doc_id").limit(1).collect()[0].text.split()
    texts = [plain, *(plain[:9] + [w] + plain[9:] for pair in wrong.items() for w in pair)]
    made = spark.createDataFrame([(-1 - i, " ".join(words)) for i, words in enumerate(texts)], "doc_id long, text string")
    rows = toxicity.toxicity_scores(docs.unionByName(made), labels).filter("doc_id < 0").collect()
    score = {r.doc_id: r.score for r in rows}
    for i, pair in enumerate(wrong.items()):
        assert score[-1] < score[-3 - 2 * i] <= score[-2 - 2 * i], pair


def test_quotations_end():
    scorer = toxicity.Scorer([("idiot", 5.0)], 3)
    quoted = ["“idiot”", "say („idiot“), yes", "« un idiot » la", "»so ein idiot«", "”idiot” det", 'he: "you don’t get it, idiot," and', "‘don’t be an idiot’ there", '"a" and "an idiot"', 'x "a b c idiot"']
    plain = ["I don’t know, you idiot", 'one " mark\nyou idiot', 'a 5" pipe, you idiot', '"a" idiot "b"', "“open and\nyou idiot” now", "‘tis an idiot", "’tis the dogs’ idiot", '5" to 6" idiot 7"', "you idiot ‘x’", '"open you idiot "b"']
    for text in quoted + plain:
        got = dict(zip(toxicity.FEATURES, scorer.features(text)))
        assert (got["quoted_hits"] > 0) == (text in quoted) and (got["strongest"] > 0) == (text in plain), text


def test_few_labels_rank_held_out_rows(spark):
    """With few labels no word passes for a term; the words that lean to toxic texts still put the toxic ones first."""
    r, held, fold = random.Random(7), [], lambda i: crc32(str(i).encode()) % 5
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(90):
        words, toxic = r.sample(plain, 60), int(i % 9 == 0)
        words += r.sample(["vrag", "zottel", "quark", "mumpitz", "lorke", "pfusch", "murks", "plunder", "schund"], 4) if toxic else []
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
        held += [(i, toxic)] if fold(i) == 0 else []
    assert {t for _, t in held} == {0, 1}
    rows = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    score = {x.doc_id: x.score for x in rows}
    assert min(score[i] for i, t in held if t) > max(score[i] for i, t in held if not t)
