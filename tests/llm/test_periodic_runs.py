import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from failurelens.llm import periodic_runs as P


def brute_runs(words):
    """Every run by comparing each lag; the smallest period of a stretch counts."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(rng, n):
    """Words with runs of many periods, some inside others and side by side."""
    words = []
    while len(words) < n:
        q = rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 32, 33, 40, 64, 65, 100])
        unit = [rng.choice("abc") if rng.random() < 0.5 else f"w{rng.randrange(60)}" for _ in range(q)]
        if q > 8 and rng.random() < 0.3:
            unit = (unit[:3] * q)[:q - 1] + ["end"]
        words += (unit * 12)[:int(q * rng.uniform(2.5, 7))] + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(6))]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [" ".join(planted(rng, rng.choice([5, 60, 400, 1500]))).encode() for _ in range(4)]
    texts += [b"", b"one", b"a " * 700, b" ".join([b"a b c d e f g h i j"] * 30), bytes(rng.choice(b"ab ") for _ in range(900))]
    words, runs = P._texts_runs(texts)
    for text, w, r in zip(texts, words, runs, strict=True):
        assert w == text.split() and r == brute_runs(w)


def test_long_periods_in_long_texts():
    rng = random.Random(1)
    unit = [f"w{rng.randrange(3000)}" for _ in range(2500)]
    few = [rng.choice("ab") for _ in range(1300)]
    words = ["s"] + unit * 4 + unit[:7] + ["t"] + few * 5 + few[:1] + ["u"] * 9
    found = P._texts_runs([" ".join(words).encode(), b"tail tail"])[1][0]
    long = [r for r in found if r[2] > 300]
    assert long == [(1, 10007, 2500), (10009, 6501, 1300)]


def test_minimizers_are_all_window_minima():
    values = np.random.default_rng(3).integers(0, 40, 300).astype(np.uint64)
    for width in (1, 2, 8, 16):
        plain = {j for i in range(len(values) - width + 1) for j in range(i, i + width)
                 if values[j] == values[i:i + width].min()}
        assert sorted(plain) == P.minimizers(values, width).tolist()


LOOPED = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]


def rows():
    rng = random.Random(9)
    out = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 7, 90, 700]))), "en") for i in LOOPED]
    out += [(10 * k + 3, " ".join(planted(rng, 300)), "en") for k in range(8)]
    out += [(1, None), (2, ""), (4, " \t\n "), (None, "a b a b a b a b a"), (5, "é x é x é x é x é x é x"),
            (6, "tie tie tie tie tie tie x no no no no no no"), (6, "tie tie tie tie tie tie x no no no no no no"),
            (LOOPED[0], None), (LOOPED[1], "one"), (8, "long " * 30_000)]
    return out


def got(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_report_equals_brute_force(make_docs):
    want = sorted((brute_row(r[0], r[1]) for r in rows() if r[0] != 8), key=str)
    assert got(P.report(P.looped(make_docs([r for r in rows() if r[0] != 8])))) == want
    assert [r[1:6] for r in got(P.report(make_docs([rows()[-1]])))] == [(1, 0, 30_000, 1, 30_000_000)]
    assert P.report(P.looped(make_docs([]))).collect() == []


def test_columns_stay(make_docs, clash):
    docs = clash(make_docs(rows()))
    out = P.with_runs(docs)
    assert out.columns[:-4] == docs.columns if "n_words" not in docs.columns else True
    assert out.filter("key = 'own key'").count() == len(rows())
    one = out.filter("doc_id = 6").first()
    assert [tuple(r) for r in one.runs] == [(0, 6, 1), (7, 6, 1)] and one.collapsed == "tie x no"


def test_small_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    small = [r for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) <= 600]
    want = sorted((brute_row(r.doc_id, r.text) for r in small), key=str)
    mine = {r.doc_id for r in small}
    assert [r for r in got(P.report(P.looped(docs))) if r[0] in mine] == want
