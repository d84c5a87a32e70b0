import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, blank, short, very long, equal and near-equal texts, a null id, a repeated row, clashing column names."""
    near = BASE.replace("alpha30", "changed")
    texts = [
        (1, BASE), (2, BASE), (3, near), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "One  TWO"), (9, LONG), (9, LONG), (None, BASE), (None, None),
        (10, "a" * 700), (11, "héllo wörld ñ 中文 😀 it's we'll\n\n  x" * 9), (12, "line one is here\n" * 30), (13, "x" * 60 + BASE[:300]), (14, "HE!! SHE!! " * 40), (15, "# * $ " * 100),
    ]
    names = ["doc_id", "text", "lang", "source", "n_chars", "id", "key", "n_words", "copies", "host", "at", "size"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.StringType(), T.StringType(), T.StringType(), T.StringType()]
    rows = [(i, t, None if i == 7 else "en", f"src{(i or 0) % 3}", None if t is None else len(t), *"abcdefg") for i, t in texts]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
