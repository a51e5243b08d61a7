"""What reads the first clause alone gets it from the text before the first header, unless that is not sure."""

import random

from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import regex_hits
from lexfolio.operators import contract
from tests.test_tidy_text import ODD, PIECES


def test_opening_clause_equals_that_of_the_whole_text(spark):
    rng = random.Random(5)
    pieces = PIECES + ["EXHIBIT Á text", "Between Alpha Inc. and Beta LLC", "\r", "x\r\n\r\nSECTION 2. Y"]
    texts = ["\n\n".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(300)]
    texts += ["\n\n".join(rng.choices(pieces + ODD, k=rng.randint(1, 5))) for _ in range(200)] + ["", None, "\n\nSECTION 1. A", "a\n\n\nSECTION 1. A"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "version_id string, text string")
    first = lambda df: {r[0]: r[1] for r in df.select("version_id", F.get("clauses", F.lit(0))).collect()}
    assert first(contract.opening_clauses(docs)) == first(contract.segmented_documents(docs))
    parties = lambda df: {r[0]: r[1] for r in df.select("version_id", contract.parties_of(F.col("clauses"))).collect()}
    assert parties(contract.opening_clauses(docs)) == parties(contract.segmented_documents(docs))


def test_later_clauses_are_left_alone(spark):
    text = "Title\n\nBetween A and B.\n\nSECTION 1. TERM\n\n" + "word \n\n" * 50
    row = spark.createDataFrame([(text,), ("A\n\n(see above)\n\nSECTION 1. B",), ("A \n\nSECTION 1. B",)], "t string").select(contract.opening_text(F.col("t")).alias("o")).collect()
    assert [r["o"] for r in row] == ["Title\n\nBetween A and B.", "A\n\n(see above)\n\nSECTION 1. B", "A \n\nSECTION 1. B"]


def test_company_end_admits_every_company(spark):
    texts = ["Harbor Point Inc. and Delta Works LLC", 'Harbor ("Company")', "A\nLtd.", "ACompany", "Company", "a Company", "Z, Corp.", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(contract.company_hits(F.col("t")).alias("a"), regex_hits(F.col("t"), lx.COMPANY_PATTERN).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and [len(r["b"] or []) for r in got] == [2, 0, 1, 0, 0, 0, 1, 0, 0]
