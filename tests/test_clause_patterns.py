"""Cheap tests before costly patterns: they must hold whenever the pattern does, and spare the rest."""

import re

from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.quantities import duration_mentions
from lexfolio.functions.text import unclean_spacing
from lexfolio.operators import contract

HEADERS = (
    "ARTICLE IV. Scope", "Article 2", "SECTION 1.2: Fees", "Section 3 Term", "2.1 Return", "7. Law", "(a) Non-Competition", "(12) x",
    "EXHIBIT A", "exhibit b: Fees", "Schedule 1", "aNNex C", "APPENDIX 9 List",
)


def test_header_start_admits_every_header():
    for text in HEADERS:
        assert any(re.match(p.replace(r"\z", r"\Z"), text) for p, _ in lx.HEADER_PATTERNS), text
        assert re.match(lx.HEADER_START, text[:8]), text
    assert not re.match(lx.HEADER_START, "Each party"[:8])


def test_unclean_spacing(spark):
    rows = [("plain • café", False), *[(f"a{c}b", True) for c in "\r\f\v   ​﻿"], ("a b\nc", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(unclean_spacing(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_lead_words_before_a_number(spark):
    rows = spark.createDataFrame([("within a notice period of ten (10) days, and sixty-five30 days",)], "t string")
    found = rows.select(duration_mentions(F.col("t")).alias("d")).first()["d"]
    assert [(d["raw"], d["start"]) for d in found] == [("within a notice period of ten (10) days", 0), ("30 days", 55)]


def test_clause_rows_carry_no_other_clause(spark):
    clauses = "array<struct<clause_index:int,parent_index:int,full_text:string>>"
    docs = spark.createDataFrame([("v", [(0, None, "a"), (1, 0, "b"), (2, 0, "c"), (3, 1, "d")])], f"version_id string, clauses {clauses}")
    rows = contract.clause_rows(docs)
    assert {r["clause_index"]: r["child_count"] for r in rows.collect()} == {0: 2, 1: 1, 2: 0, 3: 0}
    plan = rows.select("version_id", "child_count")._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.split("\n") if "Generate" in line)
    assert "_parents" in plan and "clauses" not in generate.split("explode")[0]
