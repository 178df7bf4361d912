import hashlib
import random
import re

import numpy as np
import pytest

from failurelens.llm import substring_dedup as X
from failurelens.llm.fm_index import FmIndex

LAST = 1 << 62


def brute(rows, width):
    docs = [(i, LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for _, k, w in docs:
        for s in range(len(w) - width + 1):
            g = tuple(w[s:s + width])
            first[g] = min(first.get(g, k), k)
    out = []
    for i, k, w in docs:
        gone = {p for s in range(len(w) - width + 1) if first[tuple(w[s:s + width])] < k for p in range(s, s + width)}
        kept = " ".join(v for p, v in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def corpus(rng, n, words, passages):
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


def case(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(words) for _ in range(m)] for m in (8, 12, 13, 14, 20, 60, 60)]
    rows = corpus(rng, n, words, passages)
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, None), (2001, ""), (None, rows[3][1]), (None, "x y"),
             (2002, " ".join(["of"] * 400)), (2003, " ".join(["of"] * 90)), (2004, "a b " * 30), (0, rows[5][1]),
             rows[7], rows[7], (2005, "\t\n  "), (2006, "of " * 20_000)]
    return rows


def test_against_brute_force(make_docs, clash):
    rows = case(1)
    assert got(X.report(clash(make_docs(rows)))) == brute(rows, 13)


def test_small_vocabulary_and_small_shards(make_docs, monkeypatch):
    """Few words make many equal runs; a shard for every few segments must give the same."""
    monkeypatch.setattr(X, "SHARD_WORDS", 40)
    rng = random.Random(4)
    rows = corpus(rng, 120, list("ab"), [list("abbaabbbaabab")])
    assert got(X.report(make_docs(rows))) == brute(rows, 13)


def test_hot_passage(make_docs):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"u{rng.random()} {passage} v{rng.random()}") for i in range(400)] + [(900 + i, passage) for i in range(300)]
    out = got(X.report(make_docs(rows, 5)))
    assert out == brute(rows, 13)
    assert sum(r[2] for r in out) == 40 * 699


def test_other_width(make_docs):
    rows = case(9, 60)
    assert got(X.report(make_docs(rows), 7)) == brute(rows, 7)


def test_empty(make_docs):
    assert X.report(make_docs([])).collect() == []
    assert got(X.report(make_docs([(1, None)]))) == brute([(1, None)], 13)


def test_kept_text(make_docs):
    p = " ".join(f"p{i}" for i in range(13))
    rows = X.report(make_docs([(1, p), (2, f"a {p} b")])).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: p, 2: "a b"}


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for sigma in (2, 5, 40):
        segs = [rng.integers(1, sigma + 1, rng.integers(3, 12)) for _ in range(30)]
        depth = 5
        index = FmIndex(np.concatenate([np.append(s, 0) for s in segs]), depth)
        queries = [rng.integers(1, sigma + 3, rng.integers(1, 10)) for _ in range(40)] + segs[:5]
        lengths = np.array([len(q) for q in queries])
        table = np.zeros((len(queries), lengths.max()), np.int64)
        for row, q in zip(table, queries, strict=True):
            row[:len(q)] = q
        known = {tuple(s[i:i + n]) for s in segs for n in range(1, depth + 1) for i in range(len(s) - n + 1)}
        match, _ = index.matching_statistics(table, lengths)
        for q, found in zip(queries, match, strict=True):
            for p in range(len(q)):
                assert found[p] == max([0] + [n for n in range(1, depth + 1) if tuple(q[p:p + n]) in known and p + n <= len(q)])


def test_long_texts_in_pieces(make_docs, monkeypatch):
    """A piece of 64 places must give the anchors, and so the repeats, of whole texts."""
    rng = np.random.default_rng(5)
    hashed = rng.integers(0, 9, 1000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = X.anchors(hashed, 13)
    rows = case(11, 60)
    monkeypatch.setattr(X, "PLACE_BITS", 6)
    for n in (12, 13, 63, 64, 65, 76, 77, 1000):
        of, places, keys = X.anchors(hashed[:n], 13)
        assert len(of) == max(0, n - 12) and (np.diff(of) >= 0).all() and (of >= np.arange(len(of))).all()
        assert (of - np.arange(len(of)) <= 8).all() and len(places) == len(keys) == len(set(of.tolist()))
    assert np.mean(X.anchors(hashed, 13)[0] == whole[0]) > 0.9  # fewer bits of the hash decide than before
    assert got(X.report(make_docs(rows))) == brute(rows, 13)


def test_texts_with_one_hash_are_told_apart(make_docs, monkeypatch):
    """All texts share two first hashes: nothing may be taken for a copy, nothing missed."""
    weak = lambda: [X.F.coalesce(X.F.col("doc_id"), X.F.lit((1 << 63) - 1)).alias("doc_key"),
                    (X.F.length(X.F.coalesce("text", X.F.lit(""))) % 2).cast("long").alias("text_key")]
    rows = case(12, 80)
    monkeypatch.setattr(X, "row_key", weak)
    assert got(X.report(make_docs(rows))) == brute(rows, 13)
    monkeypatch.setattr(X, "MAX_SHARED", 1)
    with pytest.raises(ValueError, match="text keys"):
        X.report(make_docs(rows))
