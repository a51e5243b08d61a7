"""Clauses, quantities, obligations, rules, comparison on small agreements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexfolio.functions.quantities import duration_mentions, quantities
from lexfolio.operators import compare, policy
from lexfolio.playbooks import PLAYBOOKS
from lexfolio.plans.reviews import compare_contracts, review_contracts

BASE = "\n\n".join([
    "MASTER SERVICES AGREEMENT", "This Agreement is between Acme Corp (the \"Company\") and Beta LLC (the \"Contractor\").",
    "SECTION 1. SERVICES", "Contractor shall perform the work. See Section 9.", "1.1 Scope", "Each party shall cooperate.",
    "SECTION 2. LIMITATION OF LIABILITY", "In no event shall the aggregate liability exceed $500,000, except for gross negligence and fraud.",
    "SECTION 3. TERMINATION", "Either party may terminate upon thirty (30) days prior written notice.",
    "SECTION 4. GOVERNING LAW", "This Agreement shall be governed by the laws of the State of New York."])
TARGET = BASE.replace("thirty (30)", "fourteen (14)").replace("\n\nSECTION 4. GOVERNING LAW\n\nThis Agreement shall be governed by the laws of the State of New York.", "\n\nSECTION 5. AUDIT\n\nClient may inspect books yearly.")


@pytest.fixture(scope="module")
def review(spark):
    docs = spark.createDataFrame([("v", BASE, "services")], "version_id string, text string, playbook string")
    return review_contracts(docs, "playbook").cache()


def test_clause_tree(review):
    clauses = review.first()["clauses"]
    assert [(c["clause_number"], c["level"], c["parent_index"]) for c in clauses] == [
        ("", 0, None), ("1", 1, 0), ("1.1", 2, 1), ("2", 1, 0), ("3", 1, 0), ("4", 1, 0)]
    assert [c["category"] for c in clauses[3:]] == ["liability_limitation", "termination", "governing_law"]


def test_entities_and_facts(review):
    row = review.first()
    assert [(p["short_name"], p["role"]) for p in row["parties"]] == [("Company", "primary_entity"), ("Contractor", "counterparty")]
    assert row["governing_law"]["jurisdiction"] == "New York"
    numbers = {q["field"]: q["value"] for f in row["facts"] for q in f["quantities"]}
    assert numbers["notice_period_days"] == 30 and numbers["liability_cap_usd"] == 500000
    obligations = [o for f in row["facts"] for o in f["obligations"]]
    assert any("gross negligence" in e for o in obligations for e in o["exceptions"])
    text = row["canonical_text"]
    assert all(text[o["start"]:o["end"]] == o["quote"] for o in obligations)


def test_findings_cite_the_text(review):
    row = review.first()
    found = {f["rule_id"]: f for f in row["findings"]}
    assert set(found) == {"RULE_MSA_LIABILITY_CARVEOUTS", "RULE_MSA_CROSS_REFERENCE_INTEGRITY"}
    assert "refers to 9 which" in found["RULE_MSA_CROSS_REFERENCE_INTEGRITY"]["explanation"]
    assert "willful misconduct" in found["RULE_MSA_LIABILITY_CARVEOUTS"]["explanation"]
    for f in row["findings"]:
        for c in f["citations"]:
            assert row["canonical_text"][c["start"]:c["end"]] == c["quote"]


def test_abstains_on_low_confidence(spark):
    docs = spark.createDataFrame([("v", "EMPLOYMENT AGREEMENT\n\nSome text here.", "employment")], "version_id string, text string, playbook string")
    rows = review_contracts(docs, "playbook")
    for confidence, fires in ((0.95, True), (0.65, False)):
        low = rows.withColumn("blocks", F.transform("blocks", lambda b: b.withField("confidence", F.lit(confidence))))
        found = policy.evaluate_playbooks(low.drop("results", "findings")).first()["findings"]
        assert any(f["rule_id"] == "RULE_EMP_AT_WILL" for f in found) is fires


def test_compare(spark):
    rows = compare_contracts(spark.createDataFrame([("p", BASE, TARGET)], "pair_id string, base_text string, target_text string"))
    kinds = {(r["base_heading"], r["target_heading"]): r for r in rows.collect()}
    change = kinds[("TERMINATION", "TERMINATION")]["numeric_changes"]
    assert {(c["field"], c["old_value"], c["new_value"]) for c in change} == {("notice_period_days", 30.0, 14.0), ("termination_notice_days", 30.0, 14.0)}
    assert kinds[("GOVERNING LAW", None)]["alignment"] == "deleted" and kinds[(None, "AUDIT")]["alignment"] == "added"
    summary = compare.comparison_summary(rows).first()
    assert summary["total_base"] == 6 and summary["high_risk_count"] == 3


def _lcs_by_table(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i + 1][j], dp[i][j + 1])
    return dp[-1][-1]


def test_token_diff_is_a_shortest_script():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        diff = compare.diff_tokens(a, b)
        assert "".join(t for op, t in diff if op != "insert") == a and "".join(t for op, t in diff if op != "delete") == b
        tokens = lambda s: re.findall(r"\S+|\s+", s)
        assert sum(op == "equal" for op, _ in diff) == _lcs_by_table(tokens(a), tokens(b))
    words = [f"w{i}" for i in range(300)]  # 599 tokens, and one more: no size changes the method
    big = compare.diff_tokens(" ".join(words), " ".join(words) + "!")
    assert [op for op, _ in big].count("equal") == 598 and len(big) == 600
    more = compare.diff_tokens(" ".join(words), " ".join([*words, "new"]))
    assert [op for op, _ in more] == ["equal"] * 599 + ["insert"] * 2


def test_durations_match_one_big_pattern(spark):
    whole = re.compile(r"(?:[a-zA-Z-]+(?:\s+[a-zA-Z-]+)*\s+)?\(?(\d+)\)?\s*(calendar\s+|business\s+)?(days?|months?|years?|weeks?)", re.I)
    rng = random.Random(7)
    parts = ["notice ", "thirty (30) days", "10 days", "2 business days", ", ", "a-b ", "(5)weeks ", "7 ", "years", "x9 months ", ". ", "within ", "1,000 days "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, found in df.select("t", duration_mentions(F.col("t"))).collect():
        assert [(m["start"], m["end"]) for m in found] == [m.span() for m in whole.finditer(text)]
    long = spark.createDataFrame([("word " * 20000 + "30 days notice",)], "t string")
    assert long.select(quantities(F.col("t"), F.lit(0))).first()[0][0]["value"] == 30


def test_playbook_validation(spark):
    with pytest.raises(ValueError, match="POLICY_SYNTAX_ERROR"):
        policy.load_playbook('{"id":"p","name":"n","version":"1","rules":[{"id":"","name":"n","category":"c","severity":"low","condition":{"type":"broken_cross_reference"}}]}')
    assert sum(len(r) for r in PLAYBOOKS.values()) == 13
