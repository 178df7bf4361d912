import numpy as np
import pytest
from pyspark.sql import functions as F

from failurelens.operators import cluster

NAMES = ["Syntax", "Runtime", "Logic"]


def _vecs(spark, arr, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(arr)],
                                 "seq long, embedding array<float>")


def test_heuristic_init_below_min_samples(spark):
    rng = np.random.default_rng(0)
    df = _vecs(spark, rng.standard_normal((3, 1024)))
    c = cluster.fit(df, None, k=3, names=NAMES, min_samples=4)
    rows = c.collect()
    assert len(rows) == 3 and all(len(r.centroid) == 1024 for r in rows)
    assert all(abs(np.linalg.norm(r.centroid) - 1) < 1e-9 for r in rows)


def test_heuristic_pads_with_seeded_random(spark):
    df = _vecs(spark, [[1.0, 0.0, 0.0]])
    c = sorted(cluster.fit(df, None, k=3, names=NAMES, min_samples=4).collect(), key=lambda r: r.cluster_idx)
    assert np.allclose(c[0].centroid, [1.0, 0.0, 0.0])
    pad = np.random.default_rng(42).standard_normal((2, 3)).astype(np.float32).astype(np.float64)
    pad /= np.linalg.norm(pad, axis=1, keepdims=True)
    assert np.allclose([c[1].centroid, c[2].centroid], pad)


def test_evenly_spaced_positions(spark):
    for n, k in [(31, 23), (10, 3), (5, 5), (7, 1)]:
        got = [r.pos for r in cluster.evenly_spaced_positions(spark, n, k).orderBy("cluster_idx").collect()]
        want = list(np.linspace(0, n - 1, k, dtype=int)) if k > 1 else [0]
        assert got == want, (n, k)


def test_fit_predict_update_stats(spark):
    rng = np.random.default_rng(1)
    df = _vecs(spark, rng.standard_normal((5, 10)))
    cents = cluster.fit(df, None, k=3, names=NAMES, min_samples=4, n_init=2)
    assert cents.count() == 3
    a = cluster.assign(_vecs(spark, rng.standard_normal((1, 10))), cents)
    assert a.first().cluster_name in NAMES
    before = {r.cluster_idx: r.centroid for r in cents.collect()}
    after = {r.cluster_idx: r.centroid for r in cluster.ema_update(_vecs(spark, rng.standard_normal((1, 10)), 99),
                                                                   cents, alpha=0.1).collect()}
    assert any(not np.allclose(before[i], after[i]) for i in before)
    stats = cluster.cluster_stats(cluster.assign(df, cents), names=NAMES).collect()
    assert len(stats) == 3 and abs(sum(r.failure_rate for r in stats) - 1.0) < 1e-12


def test_zero_vector_goes_to_first_cluster(spark):
    cents = cluster.centroids_frame(spark, [(0, "Syntax", [0.0, 1.0]), (1, "Runtime", [1.0, 0.0])])
    z = spark.createDataFrame([(0, [0.0, 0.0])], "seq long, embedding array<float>")
    assert cluster.assign(z, cents).first().cluster_name == "Syntax"


def test_no_centroids_is_unknown(spark):
    z = spark.createDataFrame([(0, [1.0, 0.0])], "seq long, embedding array<float>")
    assert cluster.assign(z, None).first().cluster_name == "Unknown"


def test_lloyd_fit_from_centroids_lowers_cost(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(m, 0.05, (30, 4)) for m in ([1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0])])
    df = _vecs(spark, pts)
    noisy = np.eye(4)[:3] + rng.normal(0, 0.3, (3, 4))
    start = cluster.centroids_frame(spark, [(i, n, list(noisy[i])) for i, n in enumerate(NAMES)])
    fitted = cluster.fit(df, start, k=3, names=NAMES, min_samples=4)
    got = np.array([r.centroid for r in sorted(fitted.collect(), key=lambda r: r.cluster_idx)])
    # every true direction is recovered by some centroid
    for e in np.eye(4)[:3]:
        assert max(got @ e) > 0.99


def _ema_loop(cents, xs, alpha):
    c = [np.array(v, dtype=float) for v in cents]
    for x in xs:
        x = np.asarray(x, float)
        x = x / np.linalg.norm(x)
        j = int(np.argmax(np.stack(c) @ x))
        c[j] = (1 - alpha) * c[j] + alpha * x
    return [v / np.linalg.norm(v) for v in c]


def test_ordered_mode_equals_loop(spark):
    rng = np.random.default_rng(5)
    start = [list(v / np.linalg.norm(v)) for v in rng.standard_normal((3, 6))]
    xs = rng.standard_normal((40, 6))
    cents = cluster.centroids_frame(spark, [(i, NAMES[i], start[i]) for i in range(3)])
    df = _vecs(spark, xs).withColumn("run", F.lit("r1")).repartition(5)
    got = {r.cluster_idx: r.centroid for r in cluster.ordered_ema_update(df, cents, 0.1, key_cols=["run"]).collect()}
    want = _ema_loop(start, xs, 0.1)
    for i in range(3):
        assert np.allclose(got[i], want[i], atol=1e-12)


def test_minibatch_closed_form_equals_fold_for_fixed_assignment(spark):
    rng = np.random.default_rng(6)
    start = np.array([[1.0, 0.0], [0.0, 1.0]])
    xs = np.abs(rng.standard_normal((25, 2))) * np.array([1.0, 0.01])  # all nearest to cluster 0
    cents = cluster.centroids_frame(spark, [(0, "Syntax", list(start[0])), (1, "Runtime", list(start[1]))])
    got = {r.cluster_idx: r.centroid for r in cluster.ema_update(_vecs(spark, xs), cents, 0.1).collect()}
    c = start[0].copy()
    for x in xs:
        c = 0.9 * c + 0.1 * (x / np.linalg.norm(x))
    assert np.allclose(got[0], c / np.linalg.norm(c), atol=1e-12)
    assert np.allclose(got[1], start[1])


def test_ema_uses_every_row(spark):
    """A small decay over many rows: no rank is too old to count."""
    rng = np.random.default_rng(3)
    xs, start, alpha = rng.standard_normal((3000, 4)), np.array([1.0, 0, 0, 0]), 1e-4
    cf = cluster.centroids_frame(spark, [(0, "c", list(start))])
    got = cluster.ema_update(_vecs(spark, xs).repartition(5), cf, alpha=alpha).first().centroid
    c = start
    for x in xs.astype(np.float32).astype(np.float64):
        c = (1 - alpha) * c + alpha * x / np.linalg.norm(x)
    assert np.allclose(got, c / np.linalg.norm(c), atol=1e-9)


def test_ema_without_centroids_fits(spark):
    xs = np.repeat(np.eye(3), 10, axis=0)
    got = cluster.ema_update(_vecs(spark, xs), None).collect()
    assert len(got) == 6 and all(abs(np.linalg.norm(r.centroid) - 1) < 1e-9 for r in got)


def test_vectors_of_other_lengths_have_no_cluster(spark):
    cf = cluster.centroids_frame(spark, [(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])])
    df = spark.createDataFrame([(0, [0.0, 2.0]), (1, [1.0]), (2, None), (3, [0.0, 0.0])], "seq int, embedding array<float>")
    got = {r.seq: (r.cluster_idx, r.cluster_name) for r in cluster.assign(df, cf).collect()}
    assert got == {0: (1, "b"), 1: (-1, None), 2: (-1, None), 3: (0, "a")}


def test_hashing_encoder_and_anchors(spark):
    c = cluster.anchored_centroids(spark, k=7)
    rows = c.collect()
    assert len(rows) == 7 and all(abs(np.linalg.norm(r.centroid) - 1) < 1e-9 for r in rows)


def test_term_encoder_against_plain_counts(spark):
    import hashlib
    texts = ["Key error: KEY, key_1", "", None, "é!", "a b a " * 5000, "Key error: KEY, key_1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    got = {r.id: r.embedding for r in cluster.term_encoder(df, "text", dim=16, with_prefix=False).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
            continue
        want = [0.0] * 16
        for term in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text).lower().split():
            h = hashlib.md5(term.encode()).hexdigest()
            want[int(h[:6], 16) % 16] += 1 if int(h[6], 16) < 8 else -1
        norm = sum(x * x for x in want) ** 0.5
        assert got[i] == pytest.approx([x / (norm or 1) for x in want])
    assert cluster.term_encoder(df.limit(0), "text").count() == 0


def test_model_encoder_pandas_udf(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([("abc",)], "text string")
    v = cluster.model_encoder(df, "text", load, with_prefix=False).first().embedding
    assert pytest.approx(np.linalg.norm(v), rel=1e-6) == 1.0


def test_wide_vectors(spark):
    rng = np.random.default_rng(9)
    dim = 200
    cents = [list(v / np.linalg.norm(v)) for v in rng.standard_normal((4, dim))]
    cf = cluster.centroids_frame(spark, [(i, f"c{i}", c) for i, c in enumerate(cents)])
    xs = rng.standard_normal((300, dim)).astype(np.float32).astype(np.float64)  # stored as float
    xs[0] = 0.0
    got = {r.seq: (r.cluster_idx, r.similarity) for r in cluster.assign(_vecs(spark, xs), cf).collect()}
    m = np.array(cents)
    for i, x in enumerate(xs):
        n = np.linalg.norm(x)
        sims = m @ (x / n if n > 0 else x)
        assert got[i][0] == int(np.argmax(sims))
        assert abs(got[i][1] - sims.max()) < 1e-9


def _lloyd_loop(x, start, tol=1e-4, max_iter=300):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c, limit = np.array(start, dtype=float), x.var(axis=0, ddof=1).mean() * tol
    for _ in range(max_iter):
        j = np.argmax(x @ c.T, axis=1)
        nxt = np.array([x[j == i].mean(axis=0) if (j == i).any() else c[i] for i in range(len(c))])
        shift, c = ((nxt - c) ** 2).sum(), nxt
        if shift <= limit:
            break
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def test_lloyd_fit_equals_loop_over_rows_with_vectors(spark):
    """Rows without a vector, or with one of another length, move no centroid; empty partitions do no harm."""
    rng = np.random.default_rng(12)
    xs = rng.standard_normal((200, 5)).astype(np.float32).astype(np.float64)
    odd = spark.createDataFrame([(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0, 2.0]), (903, [])],
                                "seq long, embedding array<float>")
    start = np.eye(5)[:3]
    cf = cluster.centroids_frame(spark, [(i, n, list(start[i])) for i, n in enumerate(NAMES)])
    df = _vecs(spark, xs).union(odd).repartition(16, F.col("seq") % 5)
    got = sorted(cluster.fit(df, cf, k=3, names=NAMES).collect(), key=lambda r: r.cluster_idx)
    assert [r.cluster_name for r in got] == NAMES
    assert np.allclose([r.centroid for r in got], _lloyd_loop(xs, start), atol=1e-9)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_kmeans_fit_takes_rows_without_label_or_vector(spark, tmp_dir):
    """Null labels belong to no start cluster, null vectors to none at all; every other row is counted."""
    from failurelens.plans.queries import QUERIES
    rng = np.random.default_rng(13)
    rows = [(i, None if i % 10 == 3 else [float(x) for x in rng.standard_normal(4)], None if i % 7 == 2 else i % 10)
            for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    xs = np.array([v for _, v, _ in rows if v is not None], dtype=np.float32).astype(np.float64)
    xs /= np.linalg.norm(xs, axis=1, keepdims=True)
    group = np.array([-1 if lab is None else lab % 6 for _, v, lab in rows if v is not None])
    start = np.array([xs[group == g].mean(axis=0) for g in range(6)])
    c = _lloyd_loop(xs, start / np.linalg.norm(start, axis=1, keepdims=True))
    want = np.bincount(np.argmax(xs @ c.T, axis=1), minlength=6)
    got = {r.cluster_name: r.total_failures for r in QUERIES["kmeans_fit"](spark, tmp_dir).collect()}
    assert got == dict(zip(cluster.CLUSTER_NAMES, want.tolist(), strict=True))


def test_kmeans_fit_without_any_label_or_vector(spark, tmp_dir):
    """No labels: the fit starts by itself. No vectors: no row has a cluster."""
    from failurelens.plans.queries import QUERIES
    vecs = [[1.0, float(i % 12)] for i in range(40)]
    for name, rows, total in (("labels", [(i, v, None) for i, v in enumerate(vecs)], 40), ("vectors", [(i, None, 1) for i in range(40)], 0)):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/{name}/embeddings.parquet")
        got = QUERIES["kmeans_fit"](spark, f"{tmp_dir}/{name}").collect()
        assert len(got) == 6 and sum(r.total_failures for r in got) == total
