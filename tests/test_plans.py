"""Plan-shape checks for the scale properties the design relies on."""

import pytest

import __spark_entry__ as entry_mod

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    qs = entry_mod.queries()
    return {name: _plan(qs[name](spark, SF)) for name in qs}


def test_no_pair_producing_joins(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", ["recent_failures_by_cluster", "similar_vectors"])
def test_per_key_top_k_is_limited_before_the_shuffle(plans, name):
    assert "WindowGroupLimit" in plans[name]


def test_flagship_aggregates_map_side(plans):
    assert "partial_count" in plans["pass_at_k_metrics"]


def test_scans_read_only_needed_columns(plans):
    # the text-heavy columns are read only by the queries that use them
    for name in ("pass_at_k_metrics", "routing_labels", "buffer_distribution", "cluster_assign"):
        assert "html" not in plans[name] and "text:string" not in plans[name], name
