"""Clauses matched in the row of their pair: the same choice as all pairs and as the joins, without a shuffle."""

import random

import pytest
from pyspark.sql import functions as F
from test_comparison import SCHEMA, greedy, side

from lexfolio.functions.text import word_set
from lexfolio.operators import compare, contract
from lexfolio.plans.reviews import compare_contracts

MESSY = [
    "Intro by Ace Inc.\n\nSECTION 1. Fees\n\nClient shall pay 30 days.\n\n- one\n\n- two\n\nARTICLE IV: Law\n\nx", "1. A\n\n2. B\n\n(a) C\n\n12 days later",
    "  lead \r\n\r\n# Heading\n\n## \n\nSection 2\n\n\n\nEXHIBIT A fee\n\ncafé  ", "", "one block", "SECTION 9.\n\nSECTION x\n\nbody", None,
]


def three(rows):
    return [(r["number"], r["heading"], r["full_text"]) for r in rows]


def test_matches_equal_all_pairs():
    pick = random.Random(11)
    for n in range(400):
        base, target = side(pick, f"p{n}", "base"), side(pick, f"p{n}", "target")
        assert set(compare.match_clauses(three(base), three(target))) == greedy(base, target)


def test_matches_equal_the_joins(spark):
    pick = random.Random(12)
    sides = {f"p{n}": (side(pick, f"p{n}", "base"), side(pick, f"p{n}", "target")) for n in range(20)}
    rows = [tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for b, t in sides.values() for r in (*b, *t)]
    joined = {(r["pair_id"], r["t"], r["b"], r["by_number"]) for r in compare.align_clauses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert joined == {(p, *m) for p, (b, t) in sides.items() for m in compare.match_clauses(three(b), three(t))}


def test_words_equal_word_set(spark):
    texts = ["Fee 5.1 FEE İx Kelvin ß", "", "a b a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_set(F.col("t")).alias("w")).collect()
    assert all(set(r["w"]) == compare._words(r["t"]) for r in rows)


def test_clause_texts_equal_segmented_documents(spark):
    docs = spark.createDataFrame(list(enumerate(MESSY)), "version_id int, text string")
    brief = {r["version_id"]: r["c"] for r in contract.clause_texts(docs, "text", "c").collect()}
    for r in contract.segmented_documents(docs).collect():
        want = None if r["clauses"] is None else [(c["clause_number"], c["heading"], c["full_text"]) for c in r["clauses"]]
        assert (brief[r["version_id"]] and [tuple(c) for c in brief[r["version_id"]]]) == want


@pytest.mark.parametrize("shift", [0, 1, 3])
def test_every_clause_of_both_sides_is_there_once(spark, shift):
    texts = MESSY[:-1]
    pairs = [(i, t, texts[(i + shift) % len(texts)]) for i, t in enumerate(texts)]
    rows = compare_contracts(spark.createDataFrame(pairs, "pair_id int, base_text string, target_text string"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = rows.collect()
    cut = {r["version_id"]: r["clauses"] for r in contract.segmented_documents(spark.createDataFrame(list(enumerate(texts)), "version_id int, text string")).collect()}
    for i, _, _ in pairs:
        own, other = cut[i], cut[(i + shift) % len(texts)]
        mine = [r for r in got if r["pair_id"] == i]
        assert sorted(r["base_index"] for r in mine if r["base_index"] is not None) == list(range(len(own)))
        assert sorted(r["target_index"] for r in mine if r["target_index"] is not None) == list(range(len(other)))
        assert all(shift or r["alignment"] == "identical" for r in mine)


def test_quantities_are_found_once_a_side(spark):
    clauses = "array<struct<number:string,heading:string,full_text:string>>"
    pairs = spark.createDataFrame([(1, [("1", "a", "pay in 30 days notice")], [("1", "a", "pay in 45 days notice, $5 fee")])], f"pair_id int, base_clauses {clauses}, target_clauses {clauses}")
    rows = compare.compare_revisions(pairs)
    plan = rows.select("numeric_changes")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("b_full_text#") <= 12
    got = {(c["field"], c["old_value"], c["new_value"]) for c in rows.first()["numeric_changes"]}
    assert ("notice_period_days", 30.0, 45.0) in got and ("amount_usd", None, 5.0) in got
