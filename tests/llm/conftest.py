import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) rows, over a few partitions."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


#: Columns whose names operators use inside.
CLASHING = ["key", "digest", "salt", "n", "rep", "label", "score", "ids", "n_tokens", "places", "kept", "held_out",
            "keep_id", "text_key", "words", "kind", "component", "terms"]


@pytest.fixture()
def clash():
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return add
