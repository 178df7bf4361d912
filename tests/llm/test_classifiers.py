import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from failurelens.llm import langid, quality, toxicity
from failurelens.llm.common import BATCH_BYTES, BATCH_CONF, held_out, read_table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    s, y = np.asarray(score), np.asarray(label)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(s) + 0.5


def test_split(spark):
    ids = [*range(300), None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("h"))
    for r in rows.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


# quality -----------------------------------------------------------------
def test_quality_against_plain_loops():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "***", "x|y", "GAMMA!!"]) for _ in range(rng.randint(0, 60))).encode()
             for _ in range(120)]
    labels = np.array([i % 3 > 0 for i in range(80)], int)
    model = quality.Neighbours(quality.term_vectors(texts[:80]), labels)
    got = model.scores(texts, block=7)
    for t, s in zip(texts, got, strict=True):
        z = model.latent(quality.term_vectors([t]))[0]
        cos = sorted(((float(v @ z), int(y)) for v, y in zip(model.vectors, labels, strict=True)), key=lambda p: -p[0])
        near = cos[:quality.NEIGHBOURS]
        weights = [max(c, 1e-3) ** quality.SHARPNESS for c, _ in near]
        assert s == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights), abs=0.02)


def test_term_vectors_do_not_mix_texts():
    texts = [b"", b"ab", b"abc", b"abcabc", "é à".encode(), b"x" * 30_000]
    together = quality.term_vectors(texts)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.term_vectors([t])[0], row)


def test_quality_held_out(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    held = held_out(F.col("doc_id"), 3, 1)
    out = quality.score(docs, quality.fit(docs, labels, ~held), held)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edges(spark, make_docs, clash):
    docs = clash(make_docs([(1, None), (2, ""), (3, "some text"), (None, "x"), (3, "some text"), (4, "word " * 20_000)]))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.fit(docs, none, F.lit(True)), F.lit(False)).collect()
    assert len(out) == 6 and {r.score for r in out} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, None, 0), (4, 1, 1), (None, 1, 1)], none.schema)
    out = quality.score(docs, quality.fit(docs, some, F.lit(True)), F.lit(False)).collect()
    assert all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id == 3}) == 1
    assert quality.score(make_docs([]), quality.Neighbours(np.zeros((0, 1)), np.zeros(0)), F.lit(False)).collect() == []


# toxicity ----------------------------------------------------------------
def test_gradients():
    """Backward pass against differences, for windows of unequal length."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    g = {s: rng.normal(size=(6, 3 * toxicity.STATE)) for s in "fb"}
    at, length = rng.integers(0, 6, (4, 5)), np.array([5, 3, 1, 5])
    y = np.array([1.0, 0, 0, 1])

    def loss():
        p = np.asarray(net.forward(g, at, length), np.float64)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    p, cache = net.forward(g, at, length, keep=True)
    grads, rows = net.backward(at, y, np.ones(4), p, cache, 6)
    for name in ("hf", "hb", "a", "v", "u", "o"):
        for place in list(np.ndindex(net.w[name].shape))[:: max(1, net.w[name].size // 7)]:
            held = net.w[name][place]
            net.w[name][place] = held + 1e-2
            up = loss()
            net.w[name][place] = held - 1e-2
            down = loss()
            net.w[name][place] = held
            assert grads[name][place] == pytest.approx((up - down) / 2e-2, abs=3e-3), (name, place)
    for side in "fb":
        for place in [(0, 0), (2, 11), (5, 25), (3, 7)]:
            g[side][place] += 1e-2
            up = loss()
            g[side][place] -= 2e-2
            down = loss()
            g[side][place] += 1e-2
            assert rows[side][place] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_windows_overlap_and_cover():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    doc, first, length = toxicity.windows_of(counts)
    for d, n in enumerate(counts):
        mine = [(f, f + k) for o, f, k in zip(doc, first, length, strict=True) if o == d]
        assert {p for a, b in mine for p in range(a, b)} == set(range(n))
        assert all(b <= n and b - a <= toxicity.WINDOW for a, b in mine)


@pytest.fixture(scope="module")
def network():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "zzvile" + rng.choice(words)
        texts.append(" ".join(w).encode())
        labels.append(int(i % 3 == 0))
    return toxicity.train(texts, np.array(labels)), words


def test_learns_parts_of_words_anywhere_in_a_text(network):
    net, words = network
    rng = random.Random(7)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    clean = [" ".join(say(n)).encode() for n in (10, 40, 200, 2000)]
    bad = [" ".join(say(a) + ["zzvile" + rng.choice(words)] + say(b)).encode()
           for a, b in ((3, 3), (0, 80), (80, 0), (1000, 1000))]
    scorer = toxicity.Scorer(net)
    assert (scorer.scores(bad) >= 0.3).all() and (scorer.scores(clean) < 0.3).all()
    together = scorer.scores(bad + clean)
    alone = np.array([toxicity.Scorer(net).scores([t])[0] for t in bad + clean])
    assert np.allclose(together, alone, atol=1e-4)


def test_toxicity_rows(spark, make_docs, clash, network, monkeypatch):
    monkeypatch.setattr(toxicity, "WORD_MEMO", 5)
    docs = clash(make_docs([(1, None), (2, ""), (3, "12 ..."), (None, "abc"), (1, "zzvileabc"), (4, "abc " * 20_000)]))
    out = toxicity.score(docs, network[0], F.col("doc_id") == 1).collect()
    by_text = {(r.doc_id, r.predicted) for r in out}
    assert len(out) == 6 and {(1, 0), (2, 0), (3, 0), (1, 1), (4, 0)} <= by_text
    assert all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    unfit = toxicity.fit(docs, none, F.lit(True))
    assert {r.score for r in toxicity.score(docs, unfit, F.lit(False)).collect()} == {0.0}
    assert toxicity.score(make_docs([]), network[0], F.lit(False)).collect() == []


# language ----------------------------------------------------------------
def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    pieces = langid.Pieces(vocabulary)
    p = np.random.default_rng(0).random((len(vocabulary) + 1, 2))
    ids = {v: i for i, v in enumerate(vocabulary)}

    def brute(w, k):
        if not w:
            return 1.0
        total = 0.0
        for n in range(1, len(w) + 1):
            piece = ids.get(w[:n], len(vocabulary) if n == 1 else None)
            if piece is not None:
                total += p[piece, k] * brute(w[n:], k)
        return total

    words = ["a", "ab", "aba", "abab", "bbb", "xa", "ababab", "é"]
    got = langid.word_scores(pieces, words, p)
    for w, row in zip(words, got, strict=True):
        assert np.exp(row) == pytest.approx([brute("▁" + w, k) for k in (0, 1)])

    start = langid.neutral_start(pieces)
    counts = langid.expected_counts(pieces, words, np.ones((len(words), 1)), start)

    def expected(w):
        every = []

        def walk(rest, used, weight):
            if not rest:
                every.append((used, weight))
            for n in range(1, len(rest) + 1):
                piece = ids.get(rest[:n], len(vocabulary) if n == 1 else None)
                if piece is not None:
                    walk(rest[n:], [*used, piece], weight * start[piece])
        walk("▁" + w, [], 1.0)
        total = sum(x for _, x in every)
        out = np.zeros(len(vocabulary) + 1)
        for used, x in every:
            for piece in used:
                out[piece] += x / total
        return out

    assert counts[:, 0] == pytest.approx(sum(expected(w) for w in words))


def test_long_words_are_summed_whole(monkeypatch):
    """Blocks and rescaling change nothing, and a long word neither loses pieces at a border nor underflows."""
    vocabulary = ["a", "ab", "ba", "abab", "b", "▁", "▁a", "bbabbabbabb"]
    pieces = langid.Pieces(vocabulary)
    ids = {v: i for i, v in enumerate(vocabulary)}
    p = np.random.default_rng(0).random((len(vocabulary) + 1, 2)) * 1e-9
    rng = random.Random(3)
    words = ["".join(rng.choice("abbx") for _ in range(n)) for n in (1, 2, 15, 16, 17, 33, 33, 500)] + ["bba" * 40]

    def plain(w, k):
        total, log = [1.0] + [0.0] * len(w), [0.0]
        for i in range(len(w)):
            for n in range(1, min(11, len(w) - i) + 1):
                piece = ids.get(w[i:i + n], len(vocabulary) if n == 1 else None)
                if piece is not None:
                    total[i + n] += total[i] * p[piece, k]
            top = total[i + 1]
            log.append(np.log(top))
            total = [t / top if j > i else 0.0 for j, t in enumerate(total)]
        return sum(log) + np.log(total[-1])

    wanted = [[plain("▁" + w, k) for k in (0, 1)] for w in words]
    start = langid.neutral_start(pieces)
    counts = []
    for block, rescale in ((4096, 16), (1, 1), (3, 2), (16, 5), (4096, 16)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "RESCALE", rescale)
        assert langid.word_scores(pieces, words, p) == pytest.approx(np.array(wanted))
        counts.append(langid.expected_counts(pieces, words, np.ones((len(words), 1)), start))
        assert counts[-1] == pytest.approx(counts[0])
    sizes = np.array([len(v) for v in vocabulary] + [1])
    assert sizes @ counts[0][:, 0] == pytest.approx(sum(len(w) + 1 for w in words))  # pieces cover each word once
    assert counts[0][ids["bbabbabbabb"], 0] > 0


def test_language_rows(make_docs, clash, monkeypatch):
    monkeypatch.setattr(langid, "WORD_MEMO", 4)
    en, fr = "the thing with other words and that", "une chose avec des mots autres et que"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(20)]
    rows += [(30, None, "en"), (31, "12 ... !", "en"), (32, "", "fr"), (33, en, None), (34, "THE OTHER THING", None),
             (None, "autres mots", None), (36, "x" * 60_000, "en"), (33, en, None)]
    docs = clash(make_docs(rows))
    vocabulary = ["▁", *"abcdefghijklmnopqrstuvwxyz", "th", "the", "▁the", "ch", "ose", "▁mots", "aut"]
    model = langid.learn(docs.filter("doc_id % 3 <> 0 or doc_id is null"), vocabulary)
    out = {r.doc_id: r for r in langid.predict(docs, model, F.col("doc_id") % 3 == 0).collect()}
    assert model.languages == ["en", "fr"]
    assert all(out[i].lang_pred == ("en" if i % 2 else "fr") for i in range(20))
    assert [out[i].lang_pred for i in (30, 31, 32, 33, 34, None)] == ["und", "und", "und", "en", "en", "fr"]
    assert out[30].score == 0 and all(0 <= r.score <= 1 for r in out.values())
    nothing = langid.learn(docs.filter("lang is null"), vocabulary)
    assert {r.lang_pred for r in langid.predict(docs, nothing, F.lit(False)).collect()} == {"und"}
    assert langid.predict(make_docs([]), model, F.lit(False)).collect() == []


def test_language_held_out(spark):
    import public_tokenizers
    docs = read_table(spark, SF, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    vocabulary = langid.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(regex.fullmatch(r"▁?\p{L}*", v) for v in vocabulary)
    rows = (langid.predict(docs, langid.learn(docs.filter(~held), vocabulary), held)
            .join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect())
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_toxicity_reads_long_runs_to_their_end():
    run = "abcdefghijklmnopqrstuvwxyz" * 3
    for n in range(1, 70):
        parts = toxicity.find_words(run[:n])
        assert max(map(len, parts)) <= toxicity.MAX_CHARS
        assert {g for g in (run[i:i + 7] for i in range(n - 6)) if not any(g in w for w in parts)} == set()
        assert run[:n].startswith(parts[0]) and run[:n].endswith(parts[-1])
    assert toxicity.find_words("short words, 2") == ["short", "words"]
    scorer = toxicity.Scorer(toxicity.Network())
    plain, other = scorer.scores([("x" * 30 + end).encode() for end in ("xxxxxx", "poison")])
    assert plain != other


def test_nearest_takes_the_first_of_equal_ones():
    rng = np.random.default_rng(2)
    cosine = rng.integers(0, 4, (200, 30)).astype(np.float32)
    for k in (1, 7, 15, 30):
        plain = np.sort(np.argsort(-cosine, axis=1, kind="stable")[:, :k], axis=1)
        assert (quality.nearest(cosine, k) == plain).all()


def test_fit_takes_pieces_of_long_texts_where_no_short_ones_are(spark, make_docs):
    """With long labelled texts only, the fit still learns; wordless texts of a kind are an error."""
    rng = random.Random(5)
    rows = []
    for i in range(80):
        words = [rng.choice(["tree", "river", "stone", "cloud", "road"]) for _ in range(2000)]
        if i % 2:
            words[::8] = ["vilescum"] * len(words[::8])
        rows.append((i, " ".join(words)))
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert all(len(t) > toxicity.SAMPLE_CHARS for _, t in rows)
    network = toxicity.fit(docs, labels, F.col("doc_id") < 60)
    found = {r.doc_id: r["score"] for r in toxicity.with_score(docs, network).collect()}
    assert all((found[i] >= 0.3) == bool(i % 2) for i in range(60, 80))
    short = docs.select(toxicity.pieces(F.col("text"), 8000).alias("t")).collect()
    assert all(0 < len(r.t) <= 8000 + toxicity.PIECES for r in short)
    assert [r.t for r in make_docs([(1, "ab")]).select(toxicity.pieces(F.col("text"), 8000).alias("t")).collect()] == ["ab"]
    with pytest.raises(ValueError, match="wordless"):
        toxicity.fit(make_docs([(1, "..."), (2, "some words")]),
                     spark.createDataFrame([(1, 1), (2, 0)], labels.schema), F.lit(True))


def test_features_of_many_words_take_little_room_besides_their_result():
    random.seed(5)
    words = list({"".join(random.choices("abcdefghijé", k=random.randint(2, 24))) for _ in range(60_000)})
    toxicity.features(words[:10])
    tracemalloc.start()
    found = toxicity.features(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * sum(a.nbytes for a in found)
    some = list(range(0, len(words), 997))
    for i in some:
        bucket, grams, owner = toxicity.features([words[i]])
        assert bucket[0] == found[0][i] and (owner == 0).all()
        assert (grams == found[1][found[2] == i]).all()


def test_rows_go_to_the_network_in_small_batches(spark):
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.unset(BATCH_CONF)
    try:
        docs = spark.range(0, 3000, numPartitions=1).select(
            F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
        none = toxicity.Network()
        none.ready = False
        seen = toxicity.with_score(docs, none)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 2 * BATCH_BYTES
        assert seen.filter("score = 0").count() == 3000
        spark.conf.set(BATCH_CONF, "1m")
        toxicity.with_score(docs, none)
        assert spark.conf.get(BATCH_CONF) == "1m"  # the session's own size stays
    finally:
        spark.conf.unset(BATCH_CONF)
        if before is not None:
            spark.conf.set(BATCH_CONF, before)
