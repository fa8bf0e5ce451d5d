"""Plan shape of every registered query (sf0.001): no cross products, pruned scans."""

import pytest

import __spark_entry__ as E

from conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in E.queries().items():
        df = fn(spark, SF001)
        out[name] = df._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cross_products(plans):
    bad = {n: f for n, p in plans.items() for f in FORBIDDEN if f in p}
    assert not bad


def test_topk_keeps_partial_limit(spark):
    df = E.queries()["q13_retrieve_top_k"](spark, SF001)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in optimized


def test_topk_exchanges_once(plans):
    # one vector per request is settled before, in a stored table; the rank needs one exchange
    assert plans["q13_retrieve_top_k"].count("Exchange hashpartitioning") <= 2


def test_pair_scoring_moves_no_text(plans):
    # the last plan of the re-rank reads ids and features, no article text
    assert "body_text" not in plans["q16_rerank_top_k"]


def test_vector_scan_is_pruned(plans):
    # the corpus vector scan never reads the label column
    assert "label" not in plans["q13_retrieve_top_k"]
    # the page cleaning scan reads only the two columns it uses
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plans["q04_clean_text"]
