import random

import pytest
from pyspark.sql import functions as F

from failurelens.operators import buffer, sampling

N = 40


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["Syntax", "Syntax", "Syntax", "Runtime", "Logic", None]), f"p{i}") for i in range(900)]
    data += [(1000 + i, "Rare", "r") for i in range(3)]
    return spark.createDataFrame(data, "seq long, failure_cluster string, problem string").repartition(6)


def rates(spark, **r):
    return spark.createDataFrame(list(r.items()), "cluster_name string, failure_rate double")


def drawn(df):
    return sorted((r.seq, r.failure_cluster, r.problem, round(r.weight, 12)) for r in df.collect())


def summary_of(rows, parts):
    held = None
    for k in range(parts):
        held = sampling.merge(held, sampling.summarise(rows.where(F.col("seq") % parts == k), N), N)
    return held


@pytest.mark.parametrize("parts", [1, 4])
def test_any_rates_give_the_whole_buffers_sample(spark, rows, parts):
    held = summary_of(rows, parts)
    for table in ({"Syntax": 0.9}, {"Rare": 1.0, "Logic": 0.2}, {"Runtime": 0.5, "Syntax": 0.5, "Other": 1.0}):
        r = rates(spark, **table)
        for n in (1, 7, N):
            assert drawn(sampling.draw_weighted(held, n, r)) == drawn(buffer.sample_weighted(rows, n, r))
    assert drawn(sampling.draw_weighted(held, N, None)) == drawn(buffer.sample_weighted(rows, N, None))
    assert [r.seq for r in sampling.draw_uniform(held, N).collect()] == [r.seq for r in buffer.sample_uniform(rows, N).collect()]


def test_summary_is_bounded_and_counts(spark, rows):
    held = summary_of(rows, 3)
    assert held.count() <= 2 * N * 5 + 5
    assert sorted(map(tuple, sampling.distribution(held).collect()), key=str) == \
        sorted(map(tuple, buffer.distribution(rows).collect()), key=str)


def test_merging_is_associative_and_empty_parts_change_nothing(spark, rows):
    a, b, c = (sampling.summarise(rows.where(F.col("seq") % 3 == k), N) for k in range(3))
    none = sampling.summarise(rows.limit(0), N)
    same = [sorted(map(str, s.select("kind", "failure_cluster", "seq", "u", "n_rows").collect())) for s in (
        sampling.merge(sampling.merge(a, b, N), c, N), sampling.merge(a, sampling.merge(c, b, N), N),
        sampling.merge(none, sampling.merge(sampling.merge(a, c, N), b, N), N))]
    assert same[0] == same[1] == same[2]
    assert sampling.draw_weighted(none, 5, None).collect() == []


def test_stream_equals_batch(spark, rows, tmp_dir):
    from failurelens.operators.store import read_state
    from failurelens.streaming import streams
    rows.repartition(4).write.json(tmp_dir + "/in")
    stream = streams.json_stream(spark, tmp_dir + "/in", rows.schema, max_files_per_trigger=1)
    streams.start_summary(stream, tmp_dir + "/state", "summary", N, checkpoint=tmp_dir + "/check").awaitTermination()
    held = read_state(spark, tmp_dir + "/state", sampling.summarise(rows, N).schema)
    r = rates(spark, Logic=0.8)
    assert drawn(sampling.draw_weighted(held, N, r)) == drawn(buffer.sample_weighted(rows, N, r))
