"""Answers to prompts from recorded responses, with deterministic ones for the rest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfolio.functions.arrays import shuffled
from lexfolio.functions.text import collapse_space, half_up
from lexfolio.operators.textjoin import contains_join

# Answers of the deterministic engine.
RESUME_ANSWER = json.dumps({
    "workflow": "resume_intelligence", "status": "completed_deterministic",
    "findings": [{"category": "summary", "severity": "info", "title": "Deterministic Resume Analysis",
                  "explanation": "Candidate profile and experience extracted using rule-based AST engine."}],
}, indent=2)
CONTRACT_ANSWER = json.dumps({
    "workflow": "contract_review", "status": "completed_deterministic",
    "findings": [{"category": "overview", "severity": "info", "title": "Deterministic Contract Inspection",
                  "explanation": "Obligations and policies verified using structural AST evaluator."}],
}, indent=2)


def prompt_key(prompt):
    return F.sha2(collapse_space(prompt), 256)


def replay(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Add ``provider`` and ``answer``: the response recorded for the same prompt, else one whose
    first 40 characters the prompt holds, else null.

    ``prompts(prompt_id, prompt)``, ``recorded(seq, prompt, response)``; a later recording of a
    prompt replaces an earlier one.
    """
    store = recorded.withColumn("key", prompt_key(F.col("prompt"))).groupBy("key").agg(
        F.max_by("response", "seq").alias("response"), F.min("seq").alias("seq")
    )
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt")))
    direct = keyed.join(shuffled(store.select("key", F.col("response").alias("_direct"))), "key", "left")
    missed = direct.filter(F.col("_direct").isNull()).select(F.col("prompt_id").alias("text_id"), F.col("prompt").alias("text"))
    heads = store.select(F.col("seq").alias("needle_id"), F.left("response", F.lit(40)).alias("needle")).filter(F.trim("needle") != "")
    partial = contains_join(heads, missed, merged=True).groupBy("text_id").agg(F.min("needle_id").alias("seq"))
    second = partial.join(shuffled(store.select("seq", F.col("response").alias("_second"))), "seq").select(F.col("text_id").alias("prompt_id"), "_second")
    return direct.join(shuffled(second), "prompt_id", "left").select(
        "prompt_id", "prompt",
        F.when(F.col("_direct").isNotNull(), "recorded").when(F.col("_second").isNotNull(), "recorded_partial").alias("provider"),
        F.coalesce("_direct", "_second").alias("answer"),
    )


def with_fallback(replayed: DataFrame, model_name: str = "deterministic-v1") -> DataFrame:
    """Fill unanswered prompts with the deterministic answer and add token counts and fingerprint."""
    low = F.lower("prompt")
    canned = F.when(F.contains(low, F.lit("resume")) | F.contains(low, F.lit("candidate")), RESUME_ANSWER).otherwise(CONTRACT_ANSWER)
    filled = replayed.withColumn("answer", F.coalesce("answer", canned)).withColumn("provider", F.coalesce("provider", F.lit("deterministic")))
    quarter = lambda n: half_up(n / 4).cast("int")
    n, m = F.length("prompt"), F.length("answer")
    return filled.select(
        "*", quarter(n).alias("prompt_tokens"), quarter(m).alias("completion_tokens"), quarter(n + m).alias("total_tokens"),
        F.when(F.col("provider") == "deterministic", F.sha2(F.concat(F.lit(model_name), "prompt"), 256)).alias("fingerprint"),
    )
