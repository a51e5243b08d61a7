"""Equal clauses of a bundle of documents are analysed once; each document's facts are those found in it alone."""

import pytest
from pyspark.sql import functions as F

from lexfolio.functions.arrays import let
from lexfolio.operators import contract

DUTY = "SECTION {n}. Fees\n\nClient shall pay $5,000 within 30 days, except for taxes or tips. Subject to Section 2, either party may leave.{more}"
LIST = "\n\n- Each party shall keep item one for 45 days.\n\n- Two must not be sold if lost"


def documents():
    texts = [f"Intro {i} by A Inc.\n\n" + "\n\n".join(DUTY.format(n=n, more=LIST if (n + i) % 2 else "") for n in (1, 2)) for i in range(7)]
    # a sentence with a list stands in the text with single newlines only, unless later text holds it as the clause does
    odd = ["", "  \n\n", "one", None, "SECTION 1. A\n\nB must go. x\n\n\n\nC shall stay now.  \r\n\r\n# D\n\nE will, if so, go to Å land.", DUTY.format(n=3, more="\n\n# H\n\nX shall pay now. Y must go on.")]
    return texts + odd


@pytest.mark.parametrize("bundle", [2, 500])
def test_facts_equal_those_of_each_document(spark, monkeypatch, bundle):
    monkeypatch.setattr(contract, "BUNDLE", bundle)
    docs = contract.segmented_documents(spark.createDataFrame(list(enumerate(documents())), "version_id int, text string").coalesce(1))
    # one more document, whose first clause misses a sentence in its own slice that stands further on
    whole = docs.filter("version_id = 0").withColumn("version_id", F.lit(99)).withColumn(
        "canonical_text", F.concat("canonical_text", F.element_at("clauses", 3)["full_text"], F.element_at("clauses", 2)["full_text"]))
    docs = docs.unionByName(whole)
    plain = let(F.col("canonical_text"), lambda text: F.transform("clauses", lambda c: let(c, lambda c: contract.clause_facts_of(c, text))))
    want = {r["version_id"]: r["facts"] for r in docs.select("version_id", plain.alias("facts")).collect()}
    rows = contract.extract_facts(docs)
    assert rows.columns == [*docs.columns, "facts"]
    got = {r["version_id"]: r for r in rows.collect()}
    assert {i: r["facts"] for i, r in got.items()} == want and len(got) == len(documents()) + 1
    assert {r["version_id"]: r["clauses"] for r in docs.collect()} == {i: r["clauses"] for i, r in got.items()}
    assert contract.extract_facts(docs, "version_id").columns == ["version_id", "facts"]
