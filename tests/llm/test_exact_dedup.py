from pyspark.sql import functions as F

from failurelens.llm import exact_dedup as X

ROWS = [(1, "a b"), (5, "a b"), (3, "a b "), (4, None), (9, ""), (7, "x" * 50_000), (8, "x" * 50_000), (2, "A b"),
        (None, "a b"), (None, "only null")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_groups_ties_and_nulls(make_docs, clash):
    assert got(X.duplicate_report(clash(make_docs(ROWS)))) == brute(ROWS)


def test_hot_group_is_salted_and_whole(make_docs):
    rows = [(i, "hot") for i in range(3000)] + [(10_000 + i, f"t{i % 700}") for i in range(1500)]
    assert got(X.duplicate_report(make_docs(rows, 7))) == brute(rows)


def test_digest_collisions_are_settled_by_text(make_docs):
    weak = lambda t: F.substring(X.sha256_hex(t), 1, 1)
    rows = ROWS + [(100 + i, f"text {i % 40}") for i in range(120)]
    df = X.duplicate_report(make_docs(rows), digest=weak)
    assert got(df) == brute(rows)
    assert {r.text_sha256 for r in df.collect()} == {r.text_sha256 for r in X.duplicate_report(make_docs(rows)).collect()}


def test_drop_duplicates_keeps_columns_and_rows(make_docs, clash):
    docs = clash(make_docs(ROWS))
    left = X.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [5, 3, 9, 8, 2, None]))


def test_empty(make_docs):
    assert X.duplicate_report(make_docs([])).collect() == []
    assert X.drop_duplicates(make_docs([])).collect() == []


def test_drop_duplicates_leaves_one_of_rows_that_repeat_id_and_text(make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, None), (3, "")] + [(9, "hot")] * 50)
    docs = docs.withColumns({c: F.lit(c) for c in ("__own", "own_sha", "OWN_ID", "_own_sha", "own_null")})
    left = X.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [
        ("1", "a"), ("2", "b"), ("3", ""), ("9", "hot"), ("None", "c")]
    assert {(r["__own"], r["own_sha"], r["OWN_ID"]) for r in left.collect()} == {("__own", "own_sha", "OWN_ID")}
