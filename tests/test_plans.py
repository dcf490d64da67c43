"""Plans of the hot paths: no row-wise Python, limits below the shuffle, no cross joins."""

import pytest

from corpusloom import cases

SF = "/root/testdata/sf0.001"
cases.load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c01_chunk_by_tokens", "c07_scan_summary", "e06_merge_edges", "f16_graph_parity", "g18_bm25_top_k", "g16_lexical_top_k", "g10_graph_seed", "i14_qa_candidates_pairs"])
def test_no_python_rows_and_no_cross_join(spark, name):
    p = plan(cases.QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(cases.QUERIES["g18_bm25_top_k"](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    p = cases.QUERIES["b12_filter_delete_drop"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,10)" in p


def test_every_oracle_has_a_query():
    assert set(cases.ORACLES) <= set(cases.QUERIES)
