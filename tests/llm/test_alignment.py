import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from failurelens.llm import alignment as A

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def v():
    return A.Pair(*PATHS)


def plain_tokens(text):
    """(id, bytes) of both sides by the libraries themselves; none if the bytes differ."""
    if not text:
        return [], []
    t = tokenizers.Tokenizer.from_file(PATHS[0]) if not CACHE else CACHE[0]
    s = sentencepiece.SentencePieceProcessor(model_file=PATHS[1]) if not CACHE else CACHE[1]
    t.encode_special_tokens = True
    CACHE[:] = [t, s]
    letters = A.byte_level_letters()
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode())
         for i in s.encode(text)]
    same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode()
    return (a, b) if same else ([], [])


CACHE: list = []


def brute(docs):
    """Every pair of tokens compared."""
    found = []
    for doc_id, text in docs:
        sides = []
        for side in plain_tokens(text):
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            sides.append(spans)
        a, b = sides
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, _, e in a if low < e <= c) + "|"
                          + ",".join(str(i) for i, _, e in b if low < e <= c))
            low = c
        links = [(i, j) for i, s, e in a for j, p, q in b if s < q and p < e]
        found.append((doc_id, len(a), len(b), groups, links))
    n = Counter(p for *_, links in found for p in set(links))
    most: dict = {}
    for (i, _), c in n.items():
        most[i] = max(most.get(i, 0), c)
    return sorted(((d, a, b, len(g), len(k), sum(n[p] == most[p[0]] for p in k), sum(n[p] for p in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, k in found), key=str)


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


ODD = ["a  b\nc <s> <0x41> </s> <|endoftext|> <unk>", "é日本😀 ñandú", " ", "  leading", "tail \n\n", "▁ under", "\x00\x01",
       "x" * 300, "12345678901234567890", "don't we'll", "​zero width", "ﬁne ﬂuid", "é", "\U0001f468‍\U0001f469"]


def rows():
    rng = random.Random(4)
    words = ["alpha", "the", "of", "Straße", "naïve", "zzxqj", "日本語", "1999", "the"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, ""), (None, "no id"), (102, "same"), (102, "same")]
    docs += [(200 + i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 200])))) for i in range(12)]
    return docs


def test_report_equals_brute_force(make_docs, clash):
    assert got(A.report(clash(make_docs(rows())), PATHS)) == brute(rows())
    assert A.report(make_docs([]), PATHS).collect() == []


@pytest.mark.parametrize("chunk,hot", [(7, 3), (64, 10)])
def test_chunks_and_rare_pairs_change_nothing(make_docs, chunk, hot):
    assert got(A.report(make_docs(rows()), PATHS, chunk=chunk, hot=hot)) == brute(rows())


def test_joining_is_associative(v):
    rng = random.Random(2)
    text = " ".join(rng.choice(["unbelievably", "日本語", "x9y", "co-operate", "\n\t", "ß"]) for _ in range(80))
    a, b = (np.array(t.encode([text])[0]) for t in (v.a, v.b))
    parts = [A.fragment(v, *c) for c in A.chunks(v, a, b, 5)]
    assert any(not f.cut for f in parts) and any(f.cut for f in parts)
    want = A.one_group(v, (a, b))

    def same(x, y):
        assert (x.groups, x.n_a, x.n_b, x.n_groups, x.n_links) == (y.groups, y.n_a, y.n_b, y.n_groups, y.n_links)
        assert x.pairs.tolist() == y.pairs.tolist() and x.times.tolist() == y.times.tolist()

    def tree(items):
        if len(items) == 1:
            return items[0]
        k = rng.randrange(1, len(items))
        return A.joined(v, tree(items[:k]), tree(items[k:]))

    same(A.whole(v, reduce(lambda x, y: A.joined(v, x, y), parts)), want)
    for _ in range(10):
        f = A.joined(v, A.Fragment(), A.joined(v, tree(parts), A.Fragment()))
        same(A.whole(v, f), want)


def test_groups_and_own_columns(make_docs, clash, v):
    docs = clash(make_docs([(1, "naïve tokenizers"), (2, None)]))
    out = A.alignments(docs, PATHS).orderBy("own.doc_id").collect()
    assert out[0].own.asDict().keys() == set(docs.columns) and out[0].own.key == "own key"
    sides = [g.split("|") for g in out[0].groups.split(";")]
    a, b = ([int(i) for g in sides for i in g[k].split(",")] for k in (0, 1))
    assert v.a.decoded(a) == v.b.decoded(b) == " naïve tokenizers".encode()
    assert out[0].n_links == sum(out[0].times) and out[1].groups == "" and out[1].pairs == []


def test_long_text_is_joined_by_tasks(spark, v):
    text = " ".join(f"word{i % 977} naïve" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    one, many = (got(A.report(docs, PATHS, chunk=c)) for c in (1 << 24, 1 << 13))
    assert one == many and one[0][1] > 40_000
    assert A.alignments(docs, PATHS, chunk=1 << 13).filter(F.col("own").isNull()).count() == 0
