from __future__ import annotations

import pytest
from oracle import SMALL, assert_same

import corpus_pipeline
from quillstream.llm.queries import ORACLES, QUERIES


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mixing", "bpe"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)
