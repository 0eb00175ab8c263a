"""The queries that SQL can express, on whole tables."""

import pytest
from oracle_check import connect, difference

from admitlens.llm.queries import LLM_ORACLE, LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(LLM_QUERIES[name](spark, sf_dir), connect(sf_dir), LLM_ORACLE[name]) is None
