import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts (or (id, text, lang, source) rows), in ``parts`` partitions."""
    def make(rows, parts=3):
        out = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, lang, source = (*r, "en", "s0")[:4] if len(r) < 4 else r
            out.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(out, DOCS).repartition(parts, "text") if out else spark.createDataFrame([], DOCS)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Adds columns that bear the names operators use inside or return."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["score", "slot", "shard", "component_id", "n_links", "topic", "kept", "cell", "n", "u", "ref", "hi",
                 "frag", "members", "length", "block", "place", "size", "p", "label", "node", "first", "mark"]
        return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})

    return add
