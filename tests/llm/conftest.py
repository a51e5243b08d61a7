import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("n", T.LongType()), T.StructField("line", T.StringType()),
])


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Documents with extra columns whose names the operators use as well."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "x", 7, "y") for i, t, lang in rows], DOCS)

    return make


WORDS = "amber birch cedar delta ember fjord grove harbor island jungle kettle lantern meadow nectar orchid pebble quartz river saddle timber".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)
