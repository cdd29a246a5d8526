"""Physical plans: pushed filters, pruned columns, no products of tables, no unsliced windows over rows."""

import os

import pytest

from __spark_entry__ import queries
from tokenmill.operators import ordered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "weighted_route", "models_per_key", "price_lookup", "logs_by_key", "request_verdict", "guardrail_keywords", "budget_adjust",
    "running_budget", "merge_roles", "semantic_lookup", "compress_budgeted", "rule_access",
])
def test_no_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["collapse_lines", "caveman_ultra", "compress_stacked", "cache_bypass"])
def test_text_rules_only_spread_the_texts(spark, name):
    text = plan(spark, name)
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert all("REPARTITION_BY_NUM" in e for e in exchanges) and len(exchanges) <= 1
    assert "EvalPython" not in text and "InPandas" not in text


def test_scan_reads_needed_columns(spark):
    text = plan(spark, "ttl_by_intent")
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_routing_does_not_shuffle_requests(spark):
    text = plan(spark, "weighted_route")
    rows = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "key_number" not in line and "id#" not in line]
    assert "Window" not in text and "BroadcastHashJoin" in text and not [r for r in rows if "request_id" in r]


def test_hot_keys_are_cut_by_time(spark, monkeypatch):
    assert "_slice" not in plan(spark, "running_budget")
    monkeypatch.setattr(ordered, "HOT_ROWS", 5)
    text = plan(spark, "running_budget")
    assert "_slice" in text and "SinglePartition" not in text


def test_classification_moves_no_texts(spark):
    text = plan(spark, "classify_intent")
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and "EvalPython" not in text and "InPandas" not in text
    assert "BroadcastHashJoin" in text and "partial_sum" in text


def test_numbering_has_no_single_partition(spark):
    assert "SinglePartition" not in plan(spark, "fifo_batches")


def test_many_keywords_have_the_beginnings_of_passages(spark):
    d = "/root/testdata/sf0.001"
    begins = {" ".join(r.text.split(" ")[:3]).lower() for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    found = {r.phrase for r in queries()["guardrail_keywords_many"](spark, d).where("blocked").collect()}
    assert found & begins


def test_parts_of_texts_grow_with_the_file(spark, monkeypatch):
    from tokenmill.plans.inputs import view
    from tokenmill.sources import tables

    monkeypatch.setattr(tables, "SPREAD_BYTES", os.path.getsize(f"{SF}/documents.parquet") // 50)
    assert view(spark, SF, "documents").rdd.getNumPartitions() > 40
