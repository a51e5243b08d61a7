"""Values that cost a scan are bound once; what is bound keeps its results."""

from pyspark.sql import functions as F

from lexfolio.functions.arrays import regex_hits
from lexfolio.functions.quantities import quantities
from lexfolio.operators.contract import modality, placed_sentences


def test_lead_words_and_mentions_are_sought_once(spark):
    text = "Payment of $1,500 is due within thirty (30) days. Notice is ten (10) business days; then 45 days notice."
    df = spark.createDataFrame([(text,)], "text string").select(quantities(F.col("text"), F.lit(100)).alias("q"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("^.*[^A-Za-z") == 1
    assert plan.count("liability_cap_usd") <= 3
    found = {q["field"]: (q["value"], q["raw"], text[q["start"] - 100 : q["end"] - 100]) for q in df.first()["q"]}
    assert found["notice_period_days"] == (45.0, "then 45 days", "then 45 days")
    assert found["amount_usd"] == (1500.0, "$1,500 ", "$1,500 ")


def test_text_without_a_match_is_not_split(spark):
    rows = spark.createDataFrame([("none",), ("a1b22",), (None,), ("",)], "t string").select(regex_hits(F.col("t"), r"\d+").alias("h")).collect()
    assert [r["h"] and [(h["start"], h["end"], h["hit"]) for h in r["h"]] for r in rows] == [[], [(1, 2, "1"), (3, 5, "22")], None, []]


def test_sentences_beyond_their_clause_are_still_found(spark):
    whole = "1. A\n\nThe first one shall stay. The second one may go."
    body = "The first one shall stay. The second one may go."
    row = spark.createDataFrame([(whole, body)], "whole string, body string")
    for end in (len(whole), 20, 0):  # an interval shorter than the text it names, as after an edit
        clause = F.struct(F.lit(0).alias("start"), F.lit(end).alias("end"), F.col("body").alias("body_text"), F.col("body").alias("full_text"))
        found = row.select(placed_sentences(clause, F.col("whole")).alias("s")).first()["s"]
        assert [(s["start"], whole[s["start"] : s["end"]] == s["text"]) for s in found] == [(6, True), (32, True)]


def test_modal_patterns_run_only_where_their_words_occur(spark):
    texts = ["It SHALL  not go", "shallow maybe", "He may or must pay", "must not", "Shall we", "willing", "will", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(modality(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in rows] == ["shall_not", None, "must", "must_not", "shall", None, "will", None]
