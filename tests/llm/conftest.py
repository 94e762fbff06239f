import pytest
from pyspark.sql import functions as F

LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents out of texts, ids counting from 0, with columns whose names operators use themselves."""

    def build(texts, partitions=3):
        rows = [(i, text, "en", f"s{i % 2}", len(text) if text else None, "a", 1, True) for i, text in enumerate(texts)]
        schema = (
            "doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "fp string, start int, kept boolean"
        )
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """NULL, empty, blank and very long texts, ties and repeated rows, a NULL id, and clashing column names."""
    base = docs_of([None, "", " \n\t", "a", "a", "b c d", LONG, LONG, "Ärger über 1 größere Zahl   und 😀 token = \"abcdef12\"", None])
    repeated = base.filter("doc_id IN (0, 3, 6, 8)")
    nameless = base.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint"))
    return base.unionByName(repeated).unionByName(nameless)


ODD_ROWS = 15


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of(["x"]).limit(0)
