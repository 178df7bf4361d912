import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from failurelens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "<|endoftext|> x <|startoftext|>y", "a<|endoftext|", "ΣΑΣ ΟΔΟΣ", "İstanbul", "éa\x1cb\x85c d",
       "it's i'll 'sup don'T", "日本語 １２³ ½", "\x00\x01 ﻿", "ﬁ ǅ ß ẞ", "👩‍👩‍👧 é", "aaaaaaaaaaaaaaaaaaaaaa", "z" * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.BpeTables(PATH))


def texts():
    rng = random.Random(3)
    letters = "abcdeiounrstlhé'’ 0123.,!?ß日م́가"
    pieces = sorted(Tokenizer.from_file(PATH).get_vocab())
    yield from ODD
    for _ in range(1500):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        yield "".join(rng.choice(pieces).replace("</w>", "") for _ in range(rng.randint(1, 6)))


def test_same_ids_and_text_as_the_library(library, encoder):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        ids = encoder.encode(t)
        assert ids.tolist() == want, t
        assert bpe.decode_bytes(encoder.t, ids).decode() == library.decode(want, skip_special_tokens=False), t


def test_merge_order_beats_longest_match(encoder):
    """Where the longest token first would break a merge that comes earlier, the encoder steps back."""
    greedy = 0
    for w in ("thinbleing", "unhappiness", "pneumonoultramicroscopic", "bookkeeper", "mississippi", "antidisestablishment"):
        ids = encoder.word_ids(w + bpe.BpeTables.END)
        first = max(n for n in range(1, len(w) + 2) if (w + bpe.BpeTables.END)[:n] in encoder.by_text)
        greedy += len(encoder.t.strings[ids[0]]) < first
    assert greedy


def test_memo_limits_do_not_change_results(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "WORD_MEMO", 3)
    monkeypatch.setattr(bpe, "PAIR_MEMO", 3)
    fresh = bpe.Encoder(encoder.t)
    for t in ODD + ["one two three four five six seven eight nine ten eleven"]:
        assert fresh.encode(t).tolist() == encoder.encode(t).tolist()


def test_tokenize_rows(make_docs, clash, library):
    rows = [(1, "Hello World"), (2, None), (3, ""), (None, "Hello World"), (1, "Hello World")]
    docs = clash(make_docs(rows)).drop("ids", "n_tokens")
    out = bpe.tokenize(docs, PATH, ["ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])
    assert out.count() == 5 and set(docs.columns) <= set(out.columns)
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (want, len(want))
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_decode_column_and_empty_table(spark, make_docs):
    tokens = bpe.tokenize(make_docs([(1, "some words here"), (2, None)]), PATH, ["ids", "decoded"])
    back = bpe.decode(tokens.withColumnRenamed("decoded", "want"), PATH)
    assert all(r.decoded == r.want for r in back.collect())
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<bigint>")
    assert sorted(str(r.decoded) for r in bpe.decode(nulls, PATH).collect()) == ["", "None"]
    assert bpe.tokenize(make_docs([]), PATH, ["ids"]).collect() == []


def test_two_vocabularies_in_one_session(make_docs, tmp_path):
    """Two files used in turn by the same workers: each encodes with its own merges."""
    with open(PATH) as f:
        held = json.load(f)
    merges = held["model"]["merges"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    gone = set(made[len(made) // 2:]) - set(made[:len(made) // 2])
    held["model"]["merges"] = merges[:len(merges) // 2]
    held["model"]["vocab"] = {t: i for t, i in held["model"]["vocab"].items() if t not in gone}
    small = str(tmp_path / "half.json")
    with open(small, "w") as f:
        json.dump(held, f)
    texts = ["The referee explained the extraordinary circumstances", "naïve café", "internationalisation of 12345 widgets"]
    docs = make_docs(list(enumerate(texts)))
    for _ in range(2):
        for file in (PATH, small):
            library = Tokenizer.from_file(file)
            found = {r.doc_id: r.ids for r in bpe.tokenize(docs, file, ["ids"]).collect()}
            assert [found[i] for i in range(3)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
