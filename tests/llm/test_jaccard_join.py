import random

import numpy as np
import pytest

from failurelens.llm import jaccard_join as X


def shingles(t, k):
    w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, rule):
    sets = [(i, shingles(t, rule.k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and len(a & b) * rule.den >= rule.num * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(rng, vocabulary, bases, copies, sizes):
    rows, n = [], 0
    for _ in range(bases):
        w = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        for _ in range(rng.randint(1, copies)):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if v:
                    v[rng.randrange(len(v))] = rng.choice(vocabulary) + "x"
            rows.append((n, " ".join(v)))
            n += 1
    rng.shuffle(rows)
    return rows


RULES = [X.Rule(4, 85, 100), X.Rule(5, 80, 100), X.Rule(1, 70, 100)]


@pytest.mark.parametrize("rule", RULES)
def test_random_corpora(make_docs, clash, rule):
    rng = random.Random(rule.k)
    rows = corpus(rng, [f"w{i}" for i in range(200)], 40, 6, [0, 1, 3, 5, 12, 30, 60, 150, 400])
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (None, rows[0][1]), (1002, rows[0][1].upper()),
             (1003, "a b c"), (1004, "a  b\tC"), (1005, "z " * 20_000)]
    assert got(X.similarity_components(clash(make_docs(rows)), rule)) == brute(rows, rule)


def test_frequent_tokens_meet_in_pairs(make_docs, monkeypatch):
    """With every class frequent, small sets meet only by pairs of tokens, large ones by single tokens."""
    monkeypatch.setattr(X, "FREQUENT_TIMES", 0)
    monkeypatch.setattr(X, "FREQUENT_SIGMAS", -1e9)
    monkeypatch.setattr(X, "PAIR_SIZE", 40)
    rng = random.Random(8)
    rows = corpus(rng, [f"w{i}" for i in range(60)], 40, 5, [2, 3, 8, 20, 35, 40, 45, 50, 60])
    assert got(X.similarity_components(make_docs(rows), RULES[0])) == brute(rows, RULES[0])


def test_hot_group_and_chain(make_docs):
    """Near copies of one text, a chain whose ends are not similar, and unrelated texts with one common phrase."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"e{i}"] + base[60:])) for i in range(150)]
    chain = [f"c{i}" for i in range(100)]
    for step in range(30):
        rows.append((500 + step, " ".join(chain)))
        chain[step * 3 % 100] = f"n{step}"
    rows += [(700 + i, "the common phrase of all these texts " + " ".join(f"u{rng.random()}" for _ in range(4))) for i in range(60)]
    want = brute(rows, RULES[0])
    assert got(X.similarity_components(make_docs(rows, 6), RULES[0])) == want
    assert len({c for i, _, c in want if 500 <= i < 530}) == 1


def test_second_round_joins_components(make_docs):
    """Members linked to each other but not to their entry's hub are found across components."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 9)))) for i in range(300)]
    rule = X.Rule(1, 60, 100)
    assert got(X.similarity_components(make_docs(rows), rule)) == brute(rows, rule)


def test_ids_that_repeat(make_docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (7, a), (2, b + " tail"), (9, "other words entirely here now")]
    assert got(X.similarity_components(make_docs(rows), RULES[0])) == [
        (2, 28, 2), (5, 27, 2), (5, 27, 2), (7, 27, 2), (9, 2, 9)]


def test_keep_one(make_docs, clash):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (8, "x y z"), (None, "a b c d e f g"), (4, None), (1, "A b c d e f g")]
    docs = clash(make_docs(rows))
    left = X.keep_one(docs, X.Rule())
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "1", "4", "8", "None"]


def test_empty(make_docs):
    assert X.similarity_components(make_docs([]), X.Rule()).collect() == []
    assert got(X.similarity_components(make_docs([(1, None), (2, "")]), X.Rule())) == [(1, 0, 1), (2, 0, 2)]


def test_prefix_bound():
    for rule in RULES:
        for n in range(1, 400):
            p = rule.prefix(n)
            need = int(np.ceil(rule.num * n / rule.den - 1e-9))
            assert p == n - need + 1


def test_small_blocks_give_the_same(make_docs, monkeypatch):
    """Entries of more members than a block: blocks meet two by two."""
    monkeypatch.setattr(X, "BLOCK", 4)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 8)))) for i in range(200)]
    assert got(X.similarity_components(make_docs(rows), X.Rule(1, 60, 100))) == brute(rows, X.Rule(1, 60, 100))


def chain_of(m, step):
    """m texts; each changes ``step`` words of the one before, so only neighbours are near."""
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(m):
        out.append(" ".join(words))
        for k in range(step):
            words[(i * step + k) * 7 % 60] = f"n{i}x{k}"
    return out


def test_candidates_of_a_family_grow_with_its_size(make_docs, monkeypatch):
    """Near texts that mostly do not link: what leaves the matrices is linear in their number."""
    rule, counts = X.Rule(k=2), {}
    monkeypatch.setattr(X, "TURNS", 3)
    plain = X.across_labels
    for m in (40, 160):
        base = [f"b{i}" for i in range(200)]
        texts = []
        for i in range(m):
            own = list(base)
            for k in range(6):
                own[(13 * i + 17 * k) % 200] = f"own{i}x{k}"
            texts.append(" ".join(own))
        rows = [(i, t) for i, t in enumerate(texts)]
        made = []

        def counted(told, profiles, r, turn, made=made):
            out = plain(told, profiles, r, turn)
            if turn is not None:
                made.append(out.filter("a is not null").count())
            return out
        monkeypatch.setattr(X, "across_labels", counted)
        assert got(X.similarity_components(make_docs(rows), rule)) == brute(rows, rule)
        counts[m] = max(made, default=0)
    assert 0 < counts[160] <= 8 * counts[40], counts  # the square would be 16 times


def test_chains_are_followed_over_all_turns(make_docs):
    rule = X.Rule(k=2, num=80, den=100)
    rows = [(i, t) for i, t in enumerate(chain_of(40, 2))]
    assert got(X.similarity_components(make_docs(rows), rule)) == brute(rows, rule)


def test_spanning_forest():
    labels = np.array([5, 5, 7, 9, 9, 11])
    i, j = np.array([0, 1, 0, 3, 2]), np.array([2, 2, 3, 4, 3])
    assert X.spanning(labels, i, j, np.arange(5)) == [0, 2]
    assert X.spanning(labels, i, j, np.array([4, 2, 1, 0, 3])) == [4, 2]
