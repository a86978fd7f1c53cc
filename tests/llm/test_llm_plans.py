"""What the physical plans may and may not hold."""

import pytest

import __spark_entry__ as entry

PYTHON = ("EvalPython", "InPandas", "InArrow", "Python")


def plan(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_ring_shards", "op7_license_scan", "op9_pii_surrogates"])
def test_native_operators_run_no_python(spark, sf_dir, name):
    p = plan(spark, sf_dir, name)
    assert not any(x in p for x in PYTHON)


@pytest.mark.parametrize("name", ["op1_ring_shards", "op2_language", "op3_merge_dropout", "op4_simhash", "op5_sampling", "op6_mix", "op7_license_scan", "op8_topk", "op9_pii_surrogates", "op10_huffman_ids"])
def test_no_pairing_of_everything(spark, sf_dir, name):
    p = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_the_scan_reads_what_it_needs(spark, sf_dir):
    p = plan(spark, sf_dir, "op7_license_scan")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
