import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_texts(n, seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ré", "tu", "Xe", "no", "9"]) for _ in range(rnd.randint(1, 3)))
    passage = [word() for _ in range(70)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.choice([0, 1, 2, 5, 30, 60, 90, 150]))]
        if i % 5 == 0:
            at = rnd.randint(0, len(w))
            w[at:at] = passage[rnd.randint(0, 10) : rnd.randint(55, 70)]
        if i % 11 == 0:
            w = ["so", "so"] * 60
        text = rnd.choice([" ", "  ", "\n", "\t "]).join(w)
        if out and i % 7 == 0:
            text = rnd.choice(out) or ""
            if i % 2:
                text += " end"
        out.append(text)
    return out


@pytest.fixture(scope="session")
def docs_rows():
    """Documents with nulls in each column, empty and long texts, repeats of rows, and ids in no order."""
    texts = made_texts(60)
    rows = [(i * 3 % 61, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][min(i % 9, 3)], len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, "word", "en", "é", 4), (103, "x" * 5000, "de", "b", 5000), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA)


@pytest.fixture(scope="session")
def awkward(docs):
    """The same documents with further columns whose names the operators use themselves."""
    names = ["fp", "k1", "root", "size", "n", "h", "key", "copies", "spans", "rank", "score", "quality", "unit", "block", "word", "target", "quality_score"]
    return docs.select("*", *[F.lit("q").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def with_null_id(docs, spark):
    return docs.union(spark.createDataFrame([(None, "lost and found", "en", "a", 14), (None, None, None, None, None)], SCHEMA))


@pytest.fixture
def put(tmp_path):
    """Write tables as the queries read them; returns their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
