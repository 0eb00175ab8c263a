"""The pipeline stage by stage, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
from oracle_check import connect
from test_linedup import expected as expected_lines
from test_mixing import expected_targets
from test_ngram import all_pairs
from test_packing import check_pieces

from admitlens.llm.queries import LLM_ORACLE

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert name == "packing" or docs.columns == columns
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)

    want = {r[0] for r in connect(SF_DIR).execute(f"SELECT doc_id FROM ({LLM_ORACLE['op1_quality_rules']}) WHERE kept").fetchall()}
    assert {r.doc_id for r in out["quality_rules"]} == want

    lines = expected_lines([(r.doc_id, r.text) for r in out["quality_rules"]])
    assert sorted((str(r.doc_id), r.text) for r in out["line_dedup"]) == sorted((a, d) for a, _, _, d in lines)

    pairs = all_pairs([(r.doc_id, r.text) for r in out["line_dedup"]])
    assert sorted(str(r.doc_id) for r in out["ngram_jaccard"]) == sorted(i for i, _, _, kept in pairs if kept)

    words = Counter()
    for r in out["ngram_jaccard"]:
        words[r.source] += len((r.text or "").encode().split())
    taken, longest = Counter(), Counter()
    for r in out["mixing"]:
        taken[r.source] += len((r.text or "").encode().split())
        longest[r.source] = max(longest[r.source], len((r.text or "").encode().split()))
    assert max(Counter(r.doc_id for r in out["mixing"]).values()) <= 3
    for source, target in expected_targets(words).items():
        assert abs(taken[source] - target) <= longest[source]

    used, tokens = check_pieces([(r.doc_id, r.text) for r in out["mixing"]], out["packing"], 4096)
    assert used <= -(-tokens // 4096) * 1.02 + 1


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
