"""Workspace tables: documents, runs, findings, citations, decisions, tasks, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfolio import lexicons as lx


def visible_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(~F.col("is_deleted"))


def of_severity(findings: DataFrame, level: str = "all") -> DataFrame:
    return findings if level == "all" else findings.filter(F.col("severity") == level)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 1).when(severity == "high", 2).when(severity == "medium", 3).when(severity == "low", 4).otherwise(5)


def documents_overview(documents: DataFrame, versions: DataFrame, findings: DataFrame) -> DataFrame:
    """Live documents with page count, hash and finding count of their current version."""
    counts = findings.groupBy("version_id").agg(F.count("*").alias("n"))
    v = versions.select(F.col("version_id").alias("current_version_id"), "page_count", "sha256")
    return (
        visible_documents(documents)
        .join(v, "current_version_id", "left")
        .join(counts.withColumnRenamed("version_id", "current_version_id"), "current_version_id", "left")
        .select(
            "document_id", "workspace_id", "title", F.coalesce("page_count", F.lit(1)).alias("page_count"),
            F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("n", F.lit(0)).alias("findings_count"),
        )
    )


def findings_with_citations(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """Findings with their citations nested in text order; an empty array if none."""
    nested = citations.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "quote"))).alias("citations"))
    empty = F.array().cast("array<struct<start:int,end:int,quote:string>>")
    return findings.join(nested, "finding_id", "left").withColumn("citations", F.coalesce("citations", empty))


def user_workspaces(workspaces: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(workspaces, "workspace_id").select("user_id", "workspace_id", "name", "slug", "role")


def allowed_members(members: DataFrame, minimum: str) -> DataFrame:
    """Members whose role ranks at least ``minimum``."""
    rank = F.coalesce(*[F.when(F.col("role") == r, F.lit(n)) for r, n in lx.ROLE_RANKS])
    return members.filter(rank >= dict(lx.ROLE_RANKS)[minimum])


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("decision_state") == "pending").alias("pending"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run published last per version, ties by id; an aggregate, so hot versions combine early."""
    newest = F.max(F.struct("published_at", "run_id", "status", "fencing_token"))
    return runs.groupBy("workspace_id", "version_id").agg(newest.alias("_r")).select("workspace_id", "version_id", "_r.*")


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Critical first, then by creation; a range-partitioned sort."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", "created_at", "finding_id")


def newest_page(rows: DataFrame, group: str, order: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest rows per group; tasks forward at most limit+offset rows per group."""
    w = Window.partitionBy(group).orderBy(F.desc(order), tie)
    ranked = rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit + offset)
    return ranked.filter(F.col("position") > offset)


def list_documents(documents: DataFrame, document_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = visible_documents(documents)
    if document_type:
        rows = rows.filter(F.col("document_type") == document_type)
    return newest_page(rows, "workspace_id", "updated_at", "document_id", limit, offset)


def list_audit(events: DataFrame, target_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = events.filter(F.col("target_type") == target_type) if target_type else events
    return newest_page(rows, "workspace_id", "created_at", "event_id", limit, offset)


def soft_delete(documents: DataFrame, deletions: DataFrame) -> DataFrame:
    """Documents after a batch of deletion rows (document_id, deleted_at)."""
    d = deletions.groupBy("document_id").agg(F.max("deleted_at").alias("_at"))
    joined = documents.join(d, "document_id", "left")
    return joined.withColumns({
        "is_deleted": F.col("is_deleted") | F.col("_at").isNotNull(),
        "updated_at": F.greatest("updated_at", F.coalesce("_at", "updated_at")),
    }).drop("_at")


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest decision per finding; a decision without a note keeps the last note given."""
    order = F.struct("decided_at", "decision_id")
    latest = decisions.groupBy("finding_id").agg(
        F.max_by("decision_state", order).alias("_state"), F.max("decided_at").alias("decided_at"),
        F.max_by("note", F.when(F.col("note").isNotNull(), order)).alias("decision_note"),
    )
    return findings.join(latest, "finding_id", "left").withColumn("decision_state", F.coalesce("_state", "decision_state")).drop("_state")


def decision_audit(decisions: DataFrame) -> DataFrame:
    """One audit row per decision."""
    return decisions.select(
        F.sha2(F.concat_ws(":", F.lit("audit"), "decision_id"), 256).alias("event_id"), F.lit("finding_decision").alias("action"),
        F.lit("finding").alias("target_type"), F.col("finding_id").alias("target_id"),
        F.to_json(F.struct("decision_state", "note")).alias("metadata_json"), F.col("decided_at").alias("created_at"),
    )


def active_leases(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isin("leased", "running"))


def dead_letters(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status") == "failed")


def claimable_tasks(tasks: DataFrame, now: Column, n: int | None = None) -> DataFrame:
    """Tasks to run in order: due, with attempts left, pending or with an expired lease; the first ``n`` of them if given."""
    open_ = (F.col("status") == "pending") | (F.col("status").isin("leased", "running") & (F.col("lease_expires_at") < now))
    due = (F.col("next_attempt_after") <= now) & (F.col("attempts") < F.col("max_attempts"))
    ready = tasks.filter(open_ & due).orderBy(F.desc("priority"), "created_at", "task_id")
    return ready if n is None else ready.limit(n)


def retry_schedule(tasks: DataFrame) -> DataFrame:
    """Delay before the next attempt: 2^attempts * 2 seconds, at most 300 (jitter left out)."""
    delay = F.least(F.lit(300), (F.pow(F.lit(2.0), F.col("attempts")) * 2).cast("int"))
    retry = F.col("attempts") < F.col("max_attempts")
    return tasks.withColumn("delay_seconds", F.when(retry, delay)).withColumn("next_status", F.when(retry, "pending").otherwise("failed"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: the first incoming row per key that does not exist yet."""
    cols = [c for c in incoming.columns if c not in (key, order)]
    first = incoming.groupBy(key).agg(F.min(F.struct(order, *cols)).alias("_f")).select(key, "_f.*")
    return first.join(existing.select(key), key, "left_anti")


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows for a frame of keys."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def first_of_each(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """First row per key in the given order, as an aggregate."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_f")).select(*keys, "_f.*")


def fresh_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results that carry their task's current token; ``results`` may be a stream."""
    current = tasks.select("task_id", F.col("fencing_token").alias("_token"))
    return results.join(current, "task_id").filter(F.col("fencing_token") == F.col("_token")).drop("_token")


def current_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Published results that carry their task's current token; a repeated publication counts once."""
    return first_of_each(fresh_results(results, tasks), ("task_id",), "published_at")


def explode_results(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested results -> run, finding and citation rows ready to write."""
    runs = results.drop("findings")
    findings = results.select("run_id", F.explode("findings").alias("f")).select("run_id", "f.*")
    citations = findings.select("finding_id", F.explode("citations").alias("c")).select("finding_id", "c.*")
    return runs, findings.drop("citations"), citations


def invocation_rows(answers: DataFrame, calls: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Provenance rows: who answered which prompt for which task and run, how fast and with how many tokens.

    ``answers`` has prompt_id, prompt, provider, prompt_tokens, completion_tokens. ``calls`` adds
    task_id, model_name, model_revision, started_at and finished_at by prompt_id (the earliest
    call of a prompt counts), ``runs`` run_id and workspace_id by task_id (the latest published
    counts). Prompts that no call or run knows keep nulls there; latency needs both times.
    A provider that neither replays nor computes its answers is live.
    """
    kind = F.col("provider")
    recorded, computed = F.startswith(kind, F.lit("recorded")), kind == "deterministic"
    rows = answers
    if calls is not None:
        call = F.min_by(F.struct("task_id", "model_name", "model_revision", "started_at", "finished_at"), F.struct("started_at", "task_id"))
        rows = rows.join(calls.groupBy("prompt_id").agg(call.alias("_call")), "prompt_id", "left").select(*answers.columns, "_call.*")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("task_id", "model_name", "model_revision")}).withColumns(
            {c: F.lit(None).cast("timestamp") for c in ("started_at", "finished_at")})
    if runs is not None:
        run = F.max_by(F.struct("run_id", "workspace_id"), F.struct("published_at", "run_id"))
        rows = rows.join(runs.groupBy("task_id").agg(run.alias("_run")), "task_id", "left").select(*rows.columns, "_run.*")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("run_id", "workspace_id")})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    millis = (micros("finished_at") - micros("started_at")) / 1000
    return rows.select(
        F.sha2(F.concat_ws("|", F.coalesce("run_id", F.lit("")), F.coalesce("task_id", F.lit("")), F.col("prompt_id")), 256).alias("invocation_id"),
        "prompt_id", "run_id", "task_id", "workspace_id", "provider", "model_name", "model_revision", F.sha2("prompt", 256).alias("prompt_hash"),
        "prompt_tokens", "completion_tokens", F.floor(millis).cast("bigint").alias("latency_ms"),
        (~recorded & ~computed).alias("is_live"), recorded.alias("is_recorded"), computed.alias("is_deterministic"),
    )
