"""The pivot index gives the rows of scoring all pairs, and scores fewer."""

import numpy as np
import pytest

from failurelens.operators import pivot_index
from failurelens.operators.similarity import top_k_similar


def _store(spark, mat):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in enumerate(mat)],
                                 "record_id long, embedding array<float>")


def _queries(spark, mat):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(mat)],
                                 "query_id long, query_vec array<double>")


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["record_id"], round(r["similarity"], 9)) for r in df.collect())


def _both(spark, store, queries, k, **how):
    index = pivot_index.build_index(store, **how)
    found, cost = pivot_index.search(index, queries, k)
    return _rows(found), _rows(top_k_similar(store, queries, k)), cost


@pytest.mark.parametrize("k", [1, 4, 60])
def test_same_rows_as_all_pairs(spark, k):
    rng = np.random.default_rng(k)
    found, wanted, _ = _both(spark, _store(spark, rng.normal(size=(300, 6))),
                             _queries(spark, rng.normal(size=(9, 6))), k, n_pivots=12)
    assert found == wanted


def test_near_groups_are_scored_only(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    mat = centres[rng.integers(0, 10, 1000)] + rng.normal(scale=0.02, size=(1000, 16))
    found, wanted, cost = _both(spark, _store(spark, mat), _queries(spark, centres), 5, n_pivots=40)
    assert found == wanted
    rows = cost.collect()
    assert {r["rows_indexed"] for r in rows} == {1000}
    assert sum(r["rows_scored"] for r in rows) < 10 * 1000 / 4


def test_ties_zero_vectors_nulls_and_other_lengths(spark):
    mat = [[1, 0], [1, 0], [0, 0], None, [2, 0], [0, 1], [-1, 0], [-1, -1], [1, 0]]
    for k in (2, 3, 5, 7, 20):
        found, wanted, _ = _both(spark, _store(spark, mat), _queries(spark, [[1, 0], [0, 0], [-3, 1]]), k, n_pivots=3)
        assert found == wanted
    odd = _store(spark, [*mat, [1, 0, 0]])
    index = pivot_index.build_index(odd, n_pivots=3)
    assert index.groups[:, 0].sum() in (1, 8)  # vectors as long as the first pivot


def test_a_group_of_equal_vectors_larger_than_k(spark):
    mat = [[3, 4]] * 200 + [[4, 3]] * 200 + [[0, 1]] * 3
    found, wanted, _ = _both(spark, _store(spark, mat), _queries(spark, [[3, 4], [0, 2]]), 10, n_pivots=5)
    assert found == wanted and [r[2] for r in found[:10]] == list(range(10))


def test_empty_store_and_no_queries(spark):
    empty = _store(spark, [[1, 2]]).limit(0)
    index = pivot_index.build_index(empty)
    assert pivot_index.search(index, _queries(spark, [[1, 0]]), 3)[0].count() == 0
    index = pivot_index.build_index(_store(spark, [[1, 2]]))
    assert pivot_index.search(index, _queries(spark, [[1, 0]]).limit(0), 3)[0].count() == 0


def test_ranges_reach_the_scan(spark):
    rng = np.random.default_rng(2)
    index = pivot_index.build_index(_store(spark, rng.normal(size=(50, 4))), n_pivots=4)
    low, high = np.full((1, 4), 0.1), np.full((1, 4), 0.2)
    low[0, 2], high[0, 2] = np.inf, -np.inf
    plan = pivot_index._wanted(index.rows(spark), low, high)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(angle,0.1)" in plan
    assert "PartitionFilters: [((" in plan
