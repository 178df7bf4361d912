import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from failurelens.llm import sharding as S

SHARDS = 8


def brute(rows, n_shards=SHARDS, seed=0):
    """(doc_id, size, crc, source) rows -> sorted (row, shard, slot)."""
    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    def written(v):
        return "!" if v is None else f"={v}"

    seen, strata = Counter(), {}
    for row in rows:
        doc_id, size, crc, source = row
        copy, seen[row] = seen[row], seen[row] + 1
        order = md5("|".join([str(seed), written(doc_id), written(size), written(crc), str(copy)]))
        strata.setdefault(written(source), []).append((order, row))
    ranked = []
    for name, members in strata.items():
        u = int(md5(f"{seed}|{name}")[:12], 16) / 2 ** 48
        for r, (order, row) in enumerate(sorted(members, key=lambda m: m[0])):
            ranked.append(((r + u) / len(members), name, order, row))
    ranked.sort(key=lambda x: x[:3])
    out, n = [], len(ranked)
    for place, item in enumerate(ranked):
        shard = place * n_shards // n
        out.append((item[3], shard, place - -(-shard * n // n_shards)))
    return sorted(out, key=str)


def plain(docs):
    return [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for i, t, s in docs]


def got(df):
    return sorted((((r.doc_id, r.size, r.text_crc32, r.source), r.shard, r.slot) for r in df.collect()), key=str)


def table(spark, docs, parts=5):
    return spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(parts)


DOCS = ([(i, f"text {i % 50} é", "hot") for i in range(400)] + [(1000 + i, f"t{i}", f"s{i % 7}") for i in range(200)]
        + [(2000 + i, "x" * (i * 100), f"single{i}") for i in range(60)]
        + [(None, None, None), (None, "", None), (7, None, "hot")] + [(5, "same", "hot")] * 9 + [(None, None, None)] * 3)


def test_equals_a_plain_sort(spark):
    assert got(S.report(table(spark, DOCS))) == brute(plain(DOCS))


def test_law_mixture_and_slots(spark):
    rows = S.report(table(spark, DOCS)).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == len(DOCS)
    for k in range(SHARDS):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    totals = Counter(r.source for r in rows)
    mixed = Counter((r.source, r.shard) for r in rows)
    off = len(totals)  # a cut's place is off its fractional rank by one row for each stratum at most
    assert all(abs(mixed[s, k] - n / SHARDS) <= 2 + 2 * off * n / len(DOCS) for s, n in totals.items() for k in range(SHARDS))
    assert all(abs(mixed["hot", k] - totals["hot"] / SHARDS) <= 0.1 * totals["hot"] / SHARDS for k in range(SHARDS))
    few = table(spark, [(i, str(i), "a" if i % 3 else "b") for i in range(900)])
    mixed = Counter((r.source, r.shard) for r in S.report(few).collect())
    assert all(abs(mixed[s, k] - n / SHARDS) <= 2 for s, n in (("a", 600), ("b", 300)) for k in range(SHARDS))
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_partitions_and_seed(spark):
    first = got(S.report(table(spark, DOCS, 2)))
    assert first == got(S.report(table(spark, DOCS, 9)))
    assert first != got(S.report(table(spark, DOCS), seed=1))


def test_equal_rows_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 4)
    assert got(S.report(table(spark, DOCS))) == brute(plain(DOCS))


def test_few_and_no_rows(spark):
    assert got(S.report(table(spark, DOCS[:3]))) == brute(plain(DOCS[:3]))
    assert S.report(table(spark, [])).collect() == []


def test_clashing_columns_and_whole_rows(spark, clash, tmp_dir):
    docs = clash(table(spark, DOCS)).withColumns({"shard": F.lit("own"), "_own": F.lit("mine"), "a.b": F.lit(1)})
    placed = S.interleave(docs, "source", ["doc_id", "text"], 3)
    assert placed.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert placed.filter("_own = 'mine' and key = 'own key'").count() == len(DOCS)
    S.write_shards(table(spark, DOCS), tmp_dir + "/out", "source", ["doc_id", "text"], 3, files=2)
    back = spark.read.parquet(tmp_dir + "/out")
    assert sorted(map(str, back.select("doc_id", "text", "source").collect())) == \
        sorted(map(str, table(spark, DOCS).collect()))


def test_no_python_in_the_plan(spark):
    plan = S.report(table(spark, DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
