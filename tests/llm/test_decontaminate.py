import hashlib
import random
import re

import pytest

from failurelens.llm import decontaminate as X


def words(t):
    low = "".join(c.lower() if c.isascii() else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    wins = {}
    for item, t in items:
        w = words(t)
        if w and item is not None:
            for i in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[i:i + width]), set()).add(str(item))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, names in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    ids |= names
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture()
def case():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(25)] + ["Élan", "ÀB", "x-y"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 0])] + [(7, None), (8, "W1 w1 W1 w1"), (None, "w2"),
                                                                           (1, say(11))]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, say(5) + " " + t.upper() + "!" + say(4)) for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "... --- ..."), (100, docs[-1][1]), (100, docs[-1][1])]
    return docs, items


def items_df(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_against_brute_force(spark, make_docs, clash, case):
    docs, items = case
    assert got(X.report(clash(make_docs(docs)), items_df(spark, items))) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, make_docs, case):
    docs, items = case
    whole = X.contamination(make_docs(docs), items_df(spark, items)).collect()
    parts = X.contamination(make_docs(docs), items_df(spark, items), block_bytes=120).collect()
    view = lambda rows: sorted((str(r.doc_id), r.text_key, r.n_words, sorted(r.words), sorted(r.items)) for r in rows)
    assert view(whole) == view(parts)


def test_drop_contaminated(spark, make_docs, case):
    docs, items = case
    bad = {(i, n) for i, n, hit, *_ in brute(docs, items) if hit}
    left = X.drop_contaminated(make_docs(docs), items_df(spark, items))
    assert left.columns == make_docs([]).columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert kept == sorted(((i, t) for i, t in docs if (i, len(words(t))) not in bad), key=str)


def test_proximity(spark, make_docs):
    items = items_df(spark, [(1, "alpha beta gamma"), (2, "alpha alpha"), (3, "missing alpha")])
    docs = make_docs([(1, "gamma x alpha y y beta z"), (2, "alpha " + "x " * 20 + "beta gamma"), (3, "Alpha beta. Gamma")], 1)
    block = next(X.blocks(items, 10))
    found = X.proximity_matches(X.build_index(docs, block), block, 6).collect()
    assert {(r.doc_id, r.item_id, r.start, r.length) for r in found if r.item_id == "1"} == {(1, "1", 0, 6), (3, "1", 0, 3)}
    assert {r.doc_id for r in found if r.item_id == "2"} == {1, 2, 3}
    assert not [r for r in found if r.item_id == "3"]


def test_empty_tables(spark, make_docs):
    none = items_df(spark, [])
    assert X.report(make_docs([]), items_df(spark, [(1, "a b c")])).collect() == []
    rows = X.report(make_docs([(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows) == [(1, 2, 0, False), (2, 0, 0, False)]
