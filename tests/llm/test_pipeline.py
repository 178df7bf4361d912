import os
import subprocess
import sys

import pytest

import corpus_pipeline
from failurelens.llm import decontaminate, exact_dedup, jaccard_join, queries, toxicity
from failurelens.llm.common import read_table

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def test_run_against_plain_steps(spark):
    """Each decision made anew from the operators' reports, applied one after the other."""
    docs = {r.doc_id: r for r in read_table(spark, SF, "documents").collect()}
    table = read_table(spark, SF, "documents")
    network = queries.toxicity_network(spark, SF)
    scores = {r.doc_id: r["score"] for r in toxicity.with_score(table, network).select("doc_id", "score").collect()}
    left = {i: d for i, d in docs.items() if scores[i] < 0.3}
    last = {}
    for i, d in left.items():
        last[d.text] = max(last.get(d.text, i), i)
    left = {i: d for i, d in left.items() if last[d.text] == i}
    some = spark.createDataFrame(list(left.values()), table.schema)
    parts = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(some, jaccard_join.Rule()).collect()}
    left = {i: d for i, d in left.items() if parts[i] == i}
    leak = {r.doc_id for r in decontaminate.report(some, read_table(spark, SF, "benchmark")).filter("contaminated").collect()}
    left = {i: d for i, d in left.items() if i not in leak}
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(left)
    assert all(r.n_tokens == len(r.ids) for r in rows) and 0 < len(rows) < len(docs)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_nulls_and_empty_tables(spark, make_docs, clash, k):
    stage = corpus_pipeline.STAGES[k][1]
    rows = [(1, None), (2, ""), (None, None), (3, "plain words of a clean text"), (3, "plain words of a clean text"),
            (None, "another clean text entirely"), (4, "long " * 20_000)]
    docs = clash(make_docs(rows))
    left = stage(spark, docs, SF)
    assert left.columns == docs.columns
    assert {3, 4} <= {r.doc_id for r in left.select("doc_id").collect()}
    assert stage(spark, make_docs([]), SF).collect() == []


def test_exact_stage_is_the_operator(spark, make_docs):
    docs = make_docs([(1, "x"), (2, "x"), (3, "y")])
    kept = {r.doc_id for r in exact_dedup.duplicate_report(docs).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()} == kept == {2, 3}


def test_library_works_without_the_subpackage(tmp_path):
    """The entry imports, with its other queries, in a tree without llm/ and corpus_pipeline.py."""
    os.makedirs(tmp_path / "failurelens")
    for name in os.listdir(os.path.join(ROOT, "failurelens")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "failurelens", name), tmp_path / "failurelens" / name)
    with open(os.path.join(ROOT, "__spark_entry__.py")) as src, open(tmp_path / "__spark_entry__.py", "w") as dst:
        dst.write(src.read())
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print('pipeline' in q, len(q) > 30, any(k.startswith('op4_') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env=os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.stdout.split() == ["False", "True", "False"], out.stderr
