"""Registered queries: names, SQL where there is one, and the shape of plans."""

import re

import pytest

import __spark_entry__ as entry
import oracle
from askorpus import llm


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.queries()) == [*range(1, 11), 12, 13]
    assert set(llm.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(llm.oracle_sql()) == {"op6_decontaminate", "op9_minhash_neardup", "op10_chat_format",
                                      "op13_collocations"}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert oracle.compare(spark, oracle.connect(sf_dir), name, sf_dir) == ""


@pytest.mark.parametrize("name", ["op1_crf_secrets", "op3_source_mix", "op4_toxicity_neighbours", "op8_token_counts"])
def test_texts_stay_where_they_are(spark, sf_dir, name):
    plan = llm.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "RoundRobin" not in plan
    for exchange in re.findall(r"Exchange .*\n.*", plan):
        assert "text#" not in exchange
