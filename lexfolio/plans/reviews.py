"""End-to-end plans: raw text in, findings and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfolio.functions.arrays import unnest
from lexfolio.operators import ats, compare, contract, ir, matching, policy, resume, rewrite


def review_contracts(docs: DataFrame, playbook: str | None = None, playbooks: dict | None = None) -> DataFrame:
    """(version_id, text[, playbook]) -> clauses, entities, facts, rule results and findings per document.

    One narrow stage: nothing is shuffled between the text and its findings.
    """
    analyzed = contract.extract_facts(contract.extract_entities(contract.segmented_documents(docs)))
    if playbook is None:
        analyzed = analyzed.withColumn("playbook", contract.infer_playbook(F.col("canonical_text")))
        playbook = "playbook"
    return policy.evaluate_playbooks(analyzed, playbook, playbooks)


def segmented_revisions(pairs: DataFrame) -> DataFrame:
    """(pair_id, base_text, target_text) -> the clauses of both sides, cut as those of one document are."""
    base = contract.clause_texts(pairs.select("pair_id", "base_text", "target_text"), "base_text", "base_clauses")
    return contract.clause_texts(base, "target_text", "target_clauses")


def compare_contracts(pairs: DataFrame) -> DataFrame:
    """(pair_id, base_text, target_text) -> one row per aligned, added or deleted clause."""
    return compare.compare_revisions(segmented_revisions(pairs))


def review_resumes(docs: DataFrame, as_of: int, applications: DataFrame | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """(version_id, text) -> audited profiles; with applications and jobs also matches per requirement."""
    profiles = ats.audit(resume.extract_profiles(ir.canonical_documents(docs), as_of))
    if applications is None:
        return profiles
    return matching.match_applications(applications, profiles, matching.parse_requirements(jobs))


def resume_findings(profiles: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Failed checks, unsupported required qualifications and verified rewrites as one table.

    Columns: version_id, job_id (of qualifications, else null), category, severity, title,
    explanation, suggested_action, confidence, citations, patch (of rewrites, else null), and
    start, end of the first citation.
    """
    patch = "struct<start:int,end:int,original:string,replacement:string,explanation:string>"
    no_job, no_patch = F.lit(None).cast("string").alias("job_id"), F.lit(None).cast(patch).alias("patch")
    out = unnest(profiles, ats.check_findings(), "version_id").select("version_id", no_job, "_item.*", no_patch)
    rewrites = rewrite.revisions(resume.bullet_rows(profiles)).filter("passed")
    cited = ats.cite(F.col("block_id"), F.col("start"), F.col("end"), F.col("text"))
    improved = ats.finding("bullet_improvement", F.lit("info"), {"why": F.col("rationale")}, F.array(cited))
    out = out.unionByName(rewrites.withColumn("_item", improved).select(
        "version_id", no_job, "_item.*", F.struct("start", "end", "text", "candidate", "rationale").cast(patch).alias("patch")))
    if matched is not None:
        required = F.filter("matches", lambda m: (m["priority"] == "required") & (m["status"] == "unsupported"))
        gaps = F.transform(required, lambda m: ats.finding(
            "role_qualification_gap", F.lit("high"), {"parts": m["category"], "text": m["requirement_text"], "why": m["explanation"]}, matching.match_citations(m)))
        out = out.unionByName(unnest(matched, gaps, "version_id", "job_id").select("version_id", "job_id", "_item.*", no_patch))
    first = F.get("citations", F.lit(0))
    return out.withColumns({"start": first["start"], "end": first["end"]})


def resume_summary(matched: DataFrame) -> DataFrame:
    """Headline numbers per application."""
    revised = F.filter(F.transform(ats.bullets(), lambda b: rewrite.propose(b["text"]).isNotNull()), lambda x: x)
    scores = matching.coverage(matched).select("version_id", "job_id", F.col("overall_score").alias("role_match_score"))
    head = matched.select(
        "version_id", "job_id", F.size("roles").alias("total_roles"), "total_years", F.size("skills").alias("total_skills"), "ats_score",
        F.size(revised).alias("revisions_generated"),
    )
    return head.join(scores, ["version_id", "job_id"])
