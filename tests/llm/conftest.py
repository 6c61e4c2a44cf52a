import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "The cat sat on the mat and looked at the dog."), (5, "the cat  sat\non the mat and looked at the dog."),
    (6, "The cat sat on the mat and looked at the dog."), (6, "The cat sat on the mat and looked at the dog."), (None, "The cat sat on the mat and looked at the dog."),
    (7, "x" * 3000), (8, "word " * 4000), (9, "é日本🤗 \x00 <|endoftext|> </s> ▁"), (10, "12 34 !? ..."), (None, None), (11, "a"), (12, "a b"),
    (13, " leading and trailing  "), (-5, "negative id"), (14, "1"), (15, "\r\n\v\f"), (16, "don't stop now"),
]


@pytest.fixture(scope="session")
def docs(spark):
    from sightlake.llm.common import tuned

    tuned(spark)

    def make(rows, lang="en", **extra):
        full = [(i, t, lang if len(r) < 3 else r[2], "src", None) for r in rows for i, t in [r[:2]]]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """NULLs, empty, blank, long, repeated and tied rows, plus columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = docs(ODD)
    for name in ("ids", "n_tokens", "_id", "_sha", "_matches", "_language", "fp", "key", "norm", "id", "kept", "matches"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
