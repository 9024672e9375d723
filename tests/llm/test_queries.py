"""The operators' queries against their SQL, and their shape where SQL can't say them."""

from __future__ import annotations

import pytest

from folioscan.llm.queries import ORACLES, QUERIES

from ..compare import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert assert_same(QUERIES[name](spark, SF), duck(SF), ORACLES[name])


@pytest.mark.parametrize(("name", "table"), [("op2_html_extraction", "pages"), ("op3_sentencepiece", "documents"), ("op4_sharding", "documents"), ("op5_minhash_near_dedup", "documents"), ("op7_language_id", "documents")])
def test_a_row_for_each_row(spark, name, table):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
