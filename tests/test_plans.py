"""What the plans must look like: no Python where column expressions do, pushed filters, pruned columns, few exchanges."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tracemill import registry
from tracemill.sources import tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", "reward_vector terminal_test_signal rubric_score summaries fidelity_score classify_content test_runs session_segments usage_aggregate hook_events wm_samples gae_advantages".split())
def test_no_python_in_the_plan(spark, name):
    assert not re.search("Python|Pandas|InArrow", plan(registry.QUERIES[name](spark, FOLDER)))


def test_columns_are_pruned_and_filters_pushed(spark):
    e = tables.episodes(spark, FOLDER).where(F.col("ord") == 7).select("id", "agent")
    text = e._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in text
    assert "l_extendedprice" not in text[text.index("Physical Plan") :] or "ReadSchema: struct<o_orderkey" in text
    scored = registry.scored(spark, FOLDER).where("validity.trust = 'low'").select("id")
    text = plan(scored)
    assert "EqualTo(validity.trust,low)" in text and "steps" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_one_exchange_by_session(spark):
    """Segments, steps and turns are windows over one partitioning."""
    assert plan(registry.QUERIES["session_segments"](spark, FOLDER)).count("Exchange hashpartitioning") == 1
    assert plan(registry.QUERIES["rl_transitions"](spark, FOLDER)).count("Exchange") == 1
