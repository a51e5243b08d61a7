"""Profiles, matching, checks and rewrites on one resume."""

import pytest
from pyspark.sql import functions as F

from lexfolio.functions.skills import skills_in
from lexfolio.operators import ats, ir, matching, resume, rewrite
from lexfolio.plans.reviews import resume_findings, review_resumes

TEXT = "\n\n".join([
    "Alex Rivera", "alex.rivera@example.com | (555) 234-5678 | Seattle, WA | linkedin.com/in/arivera | github.com/arivera", "PROFESSIONAL SUMMARY", "Engineer.",
    "EXPERIENCE", "Senior Engineer - Cloudscale Systems | Jan 2020 - Dec 2021", "• Responsible for building APIs using TypeScript and PostgreSQL.",
    "• Mentored 4 engineers and cut latency by 40%.", "Engineer - Datapath | Jun 2020 - Jun 2021", "• Worked on the deploying of services with Docker.",
    "EDUCATION", "University of Washington", "B.S. Computer Science | 2017", "TECHNICAL SKILLS", "Languages: TypeScript, Python; Tools: Docker, AWS"])
JOB = "Requirements:\n- 2+ years of professional experience.\n- Proficiency with TypeScript and Rust.\n- Experience with Rust programming.\nPreferred:\n- Bachelor degree in any field."


@pytest.fixture(scope="module")
def matched(spark):
    docs = spark.createDataFrame([("r", TEXT)], "version_id string, text string")
    jobs = spark.createDataFrame([("j", JOB)], "job_id string, text string")
    apps = spark.createDataFrame([("r", "j")], "version_id string, job_id string")
    return review_resumes(docs, 2024 * 12 + 1, apps, jobs).cache()


def test_profile(matched):
    p = matched.first()
    c = p["contact"]
    assert (c["name"], c["email"], c["phone"], c["location"]) == ("Alex Rivera", "alex.rivera@example.com", "(555) 234-5678", "Seattle, WA")
    assert p["total_months"] == 24 and p["total_years"] == 2.0
    assert [r["company"] for r in p["roles"]] == ["Cloudscale Systems", "Datapath"]
    assert {s["name"]: s["source"] for s in p["skills"]}["PostgreSQL"] == "inferred"
    # A school name needs words before "University"; the degree line is its own entry.
    assert [e["graduation_year"] for e in p["education"]] == [2017]


def test_matches(matched):
    got = [(m["category"], m["status"], m["score"]) for m in matched.first()["matches"]]
    assert got == [("experience_years", "supported", 1.0), ("skill", "partially_supported", 0.5), ("skill", "unsupported", 0.0), ("education", "supported", 1.0)]
    assert matching.coverage(matched).first()["required_score"] == 50


def test_checks(matched):
    scores = {c["check_id"]: c["score"] for c in matched.first()["checks"]}
    assert scores["check-action-verbs"] == 70 and scores["check-contact"] == 100
    assert matched.first()["ats_score"] == round(sum(scores.values()) / 6)
    assert ats.check_rows(matched).count() == 6


def test_rewrites(spark, matched):
    rows = {r["text"]: r for r in rewrite.revisions(resume.bullet_rows(matched)).collect()}
    assert rows["Responsible for building APIs using TypeScript and PostgreSQL."]["candidate"] == "Built APIs using TypeScript and PostgreSQL."
    pairs = spark.createDataFrame([("cut cost", "cut cost by 45%"), ("built apps", "built apps on Kubernetes"), ("helped", "Led a team of ten"), ("made 3 tools", "made 3 tools")], "o string, c string")
    kinds = [[v["kind"] for v in r[0]] for r in pairs.select(rewrite.violations(F.col("o"), F.col("c"))).collect()]
    assert kinds == [["metric"], ["technology"], ["metric", "leadership", "team_size"], []]


def test_skill_boundaries(spark):
    df = spark.createDataFrame([("C++, c++11 and golang, not Javanese; x.net",)], "t string")
    assert [s["name"] for s in df.select(skills_in(F.col("t"))).first()[0]] == ["Go", "C++", "C#"]


def test_fallback_when_no_range_parses(spark):
    docs = ir.canonical_documents(spark.createDataFrame([("r", "EXPERIENCE\n\nJob Mar 2022 - Jan 2020\n\nsome bullet text")], "version_id string, text string"))
    assert resume.extract_profiles(docs, 24294).first()["total_months"] == 12


def test_findings_carry_wording_and_cited_places(spark, matched):
    text = ir.canonical_documents(spark.createDataFrame([("r", TEXT)], "version_id string, text string")).first()["canonical_text"]
    found = {(r["category"], r["job_id"]): r for r in resume_findings(matched, matched).collect()}
    weak = found["ats_action_verbs", None]
    assert weak["title"] == "Passive Openers in Experience Bullets" and weak["explanation"].startswith("Found 2 bullet point(s)")
    assert [c["quote"] for c in weak["citations"]] == ["Responsible for building APIs using TypeScript and PostgreSQL.", "Worked on the deploying of services with Docker."]
    gap = found["role_qualification_gap", "j"]
    assert gap["title"] == "Missing Required Qualification: skill" and gap["citations"] == [] and gap["start"] is None
    rewrites = [r for r in resume_findings(matched).collect() if r["category"] == "bullet_improvement"]
    assert rewrites and all(r["patch"]["original"] == r["citations"][0]["quote"] == text[r["start"] : r["end"]] for r in rewrites)
    assert all(text[c["start"] : c["end"]] == c["quote"] for r in found.values() for c in r["citations"])


def test_a_gap_in_years_cites_the_latest_role(spark):
    docs = spark.createDataFrame([("r", TEXT)], "version_id string, text string")
    jobs = spark.createDataFrame([("j", "Requirements:\n- 9+ years of professional experience.")], "job_id string, text string")
    apps = spark.createDataFrame([("r", "j")], "version_id string, job_id string")
    text = ir.canonical_documents(docs).first()["canonical_text"]
    found = resume_findings(review_resumes(docs, 2024 * 12 + 1), review_resumes(docs, 2024 * 12 + 1, apps, jobs))
    (cited,) = found.filter("category = 'role_qualification_gap'").first()["citations"]
    # the role spans several blocks, none of which holds it alone
    assert cited["quote"] == text[cited["start"] : cited["end"]].strip() and cited["quote"].startswith("Senior Engineer") and "latency by 40%" in cited["quote"]


def test_contact_reaches_to_the_first_section_head(spark):
    far = "\n\n".join(["Alex Rivera", *[f"Line {w} of the head" for w in "abcdefgh"], "alex@example.com", "EXPERIENCE", "late@example.com"])
    near = "\n\n".join(["Alex Rivera", "EXPERIENCE", "late@example.com"])
    docs = ir.canonical_documents(spark.createDataFrame([("far", far), ("near", near), ("none", "only words")], "version_id string, text string"))
    mail = lambda **kw: {r["version_id"]: r["contact"]["email"] for r in resume.extract_profiles(docs, 0, **kw).collect()}
    assert mail() == {"far": "alex@example.com", "near": "late@example.com", "none": None}
    assert mail(contact_blocks=8)["far"] is None
