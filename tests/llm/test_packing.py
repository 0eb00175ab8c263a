"""Packing against the tokenizer's own ids, an exact round trip, and the least possible number of sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from admitlens.llm import packing
from admitlens.llm.packing import Packing
from admitlens.llm.tokens import WordTokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "Hello, World! it's 3.5% I'LL don't", "naïve CAFÉ éclair İstanbul ΣΑΣ", "x\x1cy \x85 z\xa0w v", "...;;, a.b.c. 1,2 3.",
    "<|endoftext|> <|STARTOFTEXT|>", "übeŕ. Straße, ﬁn ŉ ĳ", "日本語 テスト。a日.", "\n\t\x0b\x0c\r", "word " * 9000, "🙂🙂!! ok?!", "ﬀ.. ½. ²! ª. º,",
]


def expected_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_give_the_tokenizers_ids():
    tokenizer, words = Tokenizer.from_file(PATH), WordTokens(PATH)
    for text in ODD:
        got = np.frombuffer(words.of_text(text or ""), "<u4").tolist()
        assert got == expected_ids(tokenizer, text)[:-1], text


def check_pieces(texts, rows, length):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in texts:
        ids = expected_ids(tokenizer, t)
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= length
    return len(ends), sum(r.length for r in rows)


def test_odd_texts(spark):
    texts = [*enumerate(ODD), (3, "a"), (3, "a"), (None, None), (None, "b c")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, length string, sequence_id int")
    check_pieces(texts, packing.packed(docs, PATH, Packing(length=64, classes=16, least_class=1)).collect(), 64)
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.packed(docs, PATH).collect()
    used, tokens = check_pieces([(r.doc_id, r.text) for r in docs.collect()], rows, 4096)
    assert used <= -(-tokens // 4096) * 1.02 + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "five six")], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r.doc_id: expected_ids(tokenizer, r.text) for r in docs.collect()}
    for r in packing.sequences(docs, PATH, Packing(length=8, classes=4, least_class=1)).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == [x for d in r.doc_ids for x in ids[d]]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.clip(rng.lognormal(6.3, 1.1, 30000).astype(int), 1, 4096), minlength=4097)
    plan = packing.Plan(counts, Packing())
    assert (plan.given == counts).all()
    filled = np.zeros(plan.sequences, np.int64)
    for length, _, n, sequence, offset in sorted(plan.runs, key=lambda r: r[4]):
        assert (filled[sequence : sequence + n] == offset).all()
        filled[sequence : sequence + n] += length
    assert filled.max() <= 4096
    assert plan.sequences <= np.ceil((counts * np.arange(4097)).sum() / 4096) * 1.01 + 1


def test_fit_is_non_negative_and_optimal():
    rng = np.random.default_rng(5)
    a, b = rng.random((12, 40)), rng.random(12) * 9
    x = packing.non_negative_fit(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient @ x) < 1e-6
