"""Workspace tables derived from orders, line items, customers, nations and events, and the queries over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio.functions.arrays import shuffled
from lexfolio.operators import replay as rp
from lexfolio.operators import workspace as w
from lexfolio.plans.registry import query
from lexfolio.session import scratch_path
from lexfolio.sources.corpora import build

WORKSPACES = "SELECT 'ws-' || CAST(n_nationkey AS STRING) AS workspace_id, 'Workspace ' || n_name AS name, lower(n_name) AS slug FROM nation"
MEMBERS = """SELECT 'ws-' || CAST(c_nationkey AS STRING) AS workspace_id, 'u' || CAST(c_custkey % 400 AS STRING) AS user_id,
 CASE c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'admin' ELSE 'owner' END AS role, c_custkey AS member_no FROM customer"""
DOCUMENTS = """SELECT 'd' || CAST(o_orderkey AS STRING) AS document_id, 'ws-' || CAST(o_custkey % 25 AS STRING) AS workspace_id, CASE o_orderkey % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'resume' ELSE 'job' END AS document_type,
 'Title ' || CAST(o_orderkey AS STRING) AS title, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'v' || CAST(o_orderkey AS STRING) END AS current_version_id, o_orderkey % 11 = 0 AS is_deleted, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders"""
VERSIONS = """SELECT 'v' || CAST(o_orderkey AS STRING) AS version_id, CAST(1 + o_orderkey % 9 AS INT) AS page_count, md5('v' || CAST(o_orderkey AS STRING)) AS sha256 FROM orders WHERE o_orderkey % 17 <> 0"""
_FID = "'f' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING)"
FINDINGS = f"""SELECT {_FID} AS finding_id, 'v' || CAST(l_orderkey AS STRING) AS version_id, CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
 CASE WHEN l_quantity > 40 THEN 'accepted' WHEN l_quantity > 35 THEN 'rejected' ELSE 'pending' END AS decision_state, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_quantity"""
CITATIONS = " UNION ALL ".join(
    f"""SELECT DISTINCT {_FID} AS finding_id, CAST(l_partkey % 500 + {i * 7} AS INT) AS cstart, CAST(l_partkey % 500 + {i * 7} + l_quantity AS INT) AS cend, 'quote {i} of ' || CAST(l_orderkey AS STRING) AS quote FROM lineitem WHERE l_linenumber % 4 >= {i}""" for i in (1, 2, 3))
DECISIONS = " UNION ALL ".join(
    f"""SELECT DISTINCT {_FID} || '#{i}' AS decision_id, {_FID} AS finding_id, CASE (l_partkey + {i}) % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'deferred' END AS decision_state, CASE WHEN (l_partkey + {i}) % 4 = 0 THEN NULL ELSE 'note {i}' END AS note,
 timestamp '2024-03-01 00:00:00' + CAST((l_partkey * {7 if i == 1 else 11}) % 1000 AS INT) * INTERVAL 1 MINUTE AS decided_at FROM lineitem WHERE l_linenumber <= {5 - i}""" for i in (1, 2))
TASKS = """SELECT 't' || CAST(event_id AS STRING) AS task_id, CASE event_id % 2 WHEN 0 THEN 'contract_review' ELSE 'resume_intelligence' END AS workflow, CASE event_id % 6 WHEN 0 THEN 'leased' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'completed' ELSE 'pending' END AS status,
 CAST(user_id % 5 AS INT) AS priority, CAST(event_id % 11 AS INT) AS attempts, CAST(3 + event_id % 7 AS INT) AS max_attempts, CAST(1 + event_id % 3 AS INT) AS fencing_token, ts AS created_at, ts + INTERVAL 10 MINUTE AS lease_expires_at, ts + INTERVAL 5 MINUTE AS next_attempt_after FROM events"""
RUNS = """SELECT 'r' || CAST(event_id AS STRING) AS run_id, 'ws-' || CAST(user_id % 25 AS STRING) AS workspace_id, 'v' || CAST(user_id AS STRING) AS version_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
 CAST(event_id % 3 AS INT) AS fencing_token, ts AS published_at FROM events"""
AUDIT = """SELECT 'a' || CAST(event_id AS STRING) AS event_id, 'ws-' || CAST(user_id % 25 AS STRING) AS workspace_id, 'u' || CAST(user_id AS STRING) AS actor_id, event_type AS action, CASE event_id % 3 WHEN 0 THEN 'finding' ELSE 'document' END AS target_type, props AS metadata_json, ts AS created_at FROM events"""
NOW = "timestamp '2024-01-20 00:00:00'"


def documents(t):
    return build(t, DOCUMENTS, "orders")


def findings(t):
    return build(t, FINDINGS, "lineitem")


def citations(t):
    return build(t, CITATIONS, "lineitem").withColumnsRenamed({"cstart": "start", "cend": "end"})


def decisions(t):
    return build(t, DECISIONS, "lineitem")


def tasks(t):
    return build(t, TASKS, "events")


def runs(t):
    return build(t, RUNS, "events")


def audit_events(t):
    return build(t, AUDIT, "events")


@query("p12_visible_documents", f"SELECT document_id, workspace_id FROM ({DOCUMENTS}) WHERE workspace_id = 'ws-7' AND NOT is_deleted")
def _(t):
    return w.visible_documents(documents(t)).filter(F.col("workspace_id") == "ws-7").select("document_id", "workspace_id")


@query("p13_severity_filter", f"SELECT finding_id, severity FROM ({FINDINGS}) WHERE severity = 'critical'")
def _(t):
    return w.of_severity(findings(t), "critical").select("finding_id", "severity")


@query("j15_documents_overview", f"""WITH d AS ({DOCUMENTS}), v AS ({VERSIONS}), f AS ({FINDINGS}) SELECT document_id, workspace_id, title, coalesce(page_count, 1) AS page_count, coalesce(sha256, '') AS sha256,
 coalesce((SELECT count(*) FROM f WHERE f.version_id = d.current_version_id), 0) AS findings_count FROM d LEFT JOIN v ON v.version_id = d.current_version_id WHERE NOT is_deleted""")
def _(t):
    return w.documents_overview(documents(t), build(t, VERSIONS, "orders"), findings(t))


@query("j16_findings_with_citations", f"""WITH c AS ({CITATIONS}) SELECT f.finding_id, severity, CAST(count(c.finding_id) AS INTEGER) AS n, coalesce(string_agg(cstart || ':' || cend || ':' || quote, '|' ORDER BY cstart, cend, quote), '') AS citations FROM ({FINDINGS}) f LEFT JOIN c USING (finding_id) GROUP BY ALL""")
def _(t):
    shown = F.transform("citations", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), c["quote"]))
    return w.findings_with_citations(findings(t), citations(t)).select("finding_id", "severity", F.size("citations").alias("n"), F.array_join(shown, "|").alias("citations"))


@query("j17_user_workspaces", f"SELECT user_id, workspace_id, name, slug, role FROM ({MEMBERS}) JOIN ({WORKSPACES}) USING (workspace_id)")
def _(t):
    return w.user_workspaces(build(t, WORKSPACES, "nation"), build(t, MEMBERS, "customer"))


@query("j18_role_check", f"SELECT workspace_id, user_id, role, member_no FROM ({MEMBERS}) WHERE role IN ('admin', 'owner')")
def _(t):
    return w.allowed_members(build(t, MEMBERS, "customer"), "admin")


@query("g01_severity_counts", f"SELECT version_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (decision_state = 'pending') AS pending FROM ({FINDINGS}) GROUP BY version_id")
def _(t):
    return w.severity_counts(findings(t), "version_id")


@query("g02_latest_runs", f"SELECT workspace_id, version_id, published_at, run_id, status, fencing_token FROM ({RUNS}) QUALIFY row_number() OVER (PARTITION BY workspace_id, version_id ORDER BY published_at DESC, run_id DESC) = 1")
def _(t):
    return w.latest_runs(runs(t))


@query("g03_ordered_findings", f"SELECT finding_id, version_id, severity, decision_state, created_at, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS severity_rank FROM ({FINDINGS}) ORDER BY severity_rank, created_at, finding_id")
def _(t):
    return w.ordered_findings(findings(t))


@query("g04_list_documents", f"SELECT document_id, workspace_id, updated_at, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY updated_at DESC, document_id) AS INTEGER) AS position FROM ({DOCUMENTS}) WHERE NOT is_deleted AND document_type = 'contract' QUALIFY position BETWEEN 11 AND 60")
def _(t):
    return w.list_documents(documents(t), "contract", 50, 10).select("document_id", "workspace_id", "updated_at", "position")


@query("g05_list_audit", f"SELECT event_id, workspace_id, action, metadata_json, created_at, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, event_id) AS INTEGER) AS position FROM ({AUDIT}) WHERE target_type = 'finding' QUALIFY position <= 50")
def _(t):
    return w.list_audit(audit_events(t), "finding").select("event_id", "workspace_id", "action", "metadata_json", "created_at", "position")


_DELETIONS = "SELECT 'd' || CAST(user_id AS STRING) AS document_id, ts AS deleted_at FROM events WHERE event_type = 'error'"


@query("g06_soft_delete", f"WITH x AS (SELECT document_id, max(deleted_at) AS deleted_at FROM ({_DELETIONS}) GROUP BY document_id) SELECT d.document_id, is_deleted OR deleted_at IS NOT NULL AS is_deleted, greatest(updated_at, coalesce(deleted_at, updated_at)) AS updated_at FROM ({DOCUMENTS}) d LEFT JOIN x USING (document_id)")
def _(t):
    return w.soft_delete(documents(t), build(t, _DELETIONS, "events")).select("document_id", "is_deleted", "updated_at")


@query("g07_apply_decisions", f"""WITH d AS ({DECISIONS}), l AS (SELECT finding_id, arg_max(decision_state, (decided_at, decision_id)) AS s, max(decided_at) AS decided_at, arg_max(note, (decided_at, decision_id)) FILTER (note IS NOT NULL) AS decision_note FROM d GROUP BY finding_id)
SELECT f.finding_id, coalesce(s, decision_state) AS decision_state, decided_at, decision_note FROM ({FINDINGS}) f LEFT JOIN l USING (finding_id)""")
def _(t):
    return w.apply_decisions(findings(t), decisions(t)).select("finding_id", "decision_state", "decided_at", "decision_note")


@query("g07_decision_audit", f"SELECT sha256('audit:' || decision_id) AS event_id, 'finding_decision' AS action, 'finding' AS target_type, finding_id AS target_id, '{{\"decision_state\":\"' || decision_state || '\"' || coalesce(',\"note\":\"' || note || '\"', '') || '}}' AS metadata_json, decided_at AS created_at FROM ({DECISIONS})")
def _(t):
    return w.decision_audit(decisions(t))


@query("g08_active_leases", f"SELECT task_id, workflow, status, fencing_token, lease_expires_at, attempts FROM ({TASKS}) WHERE status IN ('leased', 'running')")
def _(t):
    return w.active_leases(tasks(t)).select("task_id", "workflow", "status", "fencing_token", "lease_expires_at", "attempts")


@query("g09_dead_letters", f"SELECT task_id, workflow, attempts, created_at FROM ({TASKS}) WHERE status = 'failed'")
def _(t):
    return w.dead_letters(tasks(t)).select("task_id", "workflow", "attempts", "created_at")


@query("g10_claimable_tasks", f"SELECT task_id, priority, created_at FROM ({TASKS}) WHERE (status = 'pending' OR (status IN ('leased', 'running') AND lease_expires_at < {NOW})) AND next_attempt_after <= {NOW} AND attempts < max_attempts")
def _(t):
    return w.claimable_tasks(tasks(t), F.expr(NOW)).select("task_id", "priority", "created_at")


@query("g11_retry_schedule", f"SELECT task_id, attempts, CASE WHEN attempts < max_attempts THEN CAST(least(300, pow(2, attempts) * 2) AS INTEGER) END AS delay_seconds, CASE WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS next_status FROM ({TASKS})")
def _(t):
    return w.retry_schedule(tasks(t)).select("task_id", "attempts", "delay_seconds", "next_status")


@query("g13_first_of_each", f"SELECT workspace_id, action, created_at, event_id FROM ({AUDIT}) QUALIFY row_number() OVER (PARTITION BY workspace_id, action ORDER BY created_at, event_id) = 1")
def _(t):
    return w.first_of_each(audit_events(t).select("workspace_id", "action", "created_at", "event_id"), ("workspace_id", "action"), "created_at")


@query("g14_expected_actual", f"""WITH e AS (SELECT version_id, severity FROM ({FINDINGS}) WHERE decision_state <> 'rejected'), a AS (SELECT version_id, severity FROM ({FINDINGS}) WHERE decision_state <> 'pending')
SELECT version_id, severity, 'both' AS side FROM (SELECT * FROM e INTERSECT SELECT * FROM a) UNION ALL SELECT version_id, severity, 'expected_only' FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT version_id, severity, 'actual_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""")
def _(t):
    f = findings(t)
    e = f.filter("decision_state <> 'rejected'").select("version_id", "severity").distinct().withColumn("e", F.lit(1))
    a = f.filter("decision_state <> 'pending'").select("version_id", "severity").distinct().withColumn("a", F.lit(1))
    return e.join(a, ["version_id", "severity"], "full").select(
        "version_id", "severity", F.when(F.col("a").isNull(), "expected_only").when(F.col("e").isNull(), "actual_only").otherwise("both").alias("side"))


_INCOMING = "SELECT 'nation_' || CAST(c_custkey % 60 AS STRING) AS slug, c_custkey AS seq, 'Workspace of ' || c_name AS name FROM customer"


@query("g16_insert_if_absent", f"SELECT slug, seq, name FROM ({_INCOMING}) WHERE slug NOT IN (SELECT slug FROM ({WORKSPACES})) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY seq) = 1")
def _(t):
    return w.insert_if_absent(build(t, WORKSPACES, "nation"), build(t, _INCOMING, "customer"), "slug", "seq")


@query("g17_key_lookup", f"SELECT document_id, title, current_version_id FROM ({DOCUMENTS}) WHERE document_id IN (SELECT 'd' || user_id FROM events)")
def _(t):
    keys = t.events.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("document_id"))
    return w.lookup(documents(t), keys, "document_id").select("document_id", "title", "current_version_id")


@query("g18_contracts_newest", f"SELECT document_id, workspace_id, created_at FROM ({DOCUMENTS}) WHERE document_type = 'contract' ORDER BY created_at DESC")
def _(t):
    return documents(t).filter(F.col("document_type") == "contract").select("document_id", "workspace_id", "created_at").orderBy(F.desc("created_at"))


_RESULTS = "SELECT 't' || CAST(event_id - event_id % 4 AS STRING) AS task_id, CAST(1 + event_id % 3 AS INT) AS fencing_token, ts AS published_at, 'r' || CAST(event_id AS STRING) AS run_id FROM events"


@query("s08_stale_rejection", f"SELECT task_id, published_at, fencing_token, run_id FROM ({_RESULTS}) r JOIN (SELECT task_id, fencing_token AS tok FROM ({TASKS})) USING (task_id) WHERE fencing_token = tok QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY published_at, fencing_token, run_id) = 1")
def _(t):
    return w.current_results(build(t, _RESULTS, "events"), tasks(t))


@query("s07_publish_results", f"SELECT f.version_id AS run_id, count(DISTINCT f.finding_id) AS findings, count(c.finding_id) AS citations FROM ({FINDINGS}) f LEFT JOIN ({CITATIONS}) c USING (finding_id) GROUP BY ALL")
def _(t):
    full = w.findings_with_citations(findings(t), citations(t))
    nested = full.groupBy(F.col("version_id").alias("run_id")).agg(F.collect_list(F.struct("finding_id", "severity", "citations")).alias("findings"))
    runs_, f, c = w.explode_results(nested)
    path = scratch_path(t.spark, "publish")
    for name, frame in (("runs", runs_), ("findings", f), ("citations", c)):
        frame.write.parquet(f"{path}/{name}")
    back = {n: t.spark.read.parquet(f"{path}/{n}") for n in ("runs", "findings", "citations")}
    per = back["findings"].join(back["citations"].groupBy("finding_id").agg(F.count("*").alias("n")), "finding_id", "left")
    return per.groupBy("run_id").agg(F.count("*").alias("findings"), F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("citations")).join(back["runs"], "run_id")


@query("s10_audit_append", f"SELECT workspace_id, count(*) AS events, min(created_at) AS first_at, max(created_at) AS last_at FROM ({AUDIT}) GROUP BY workspace_id")
def _(t):
    path = scratch_path(t.spark, "audit")
    for kind in ("finding", "document"):
        audit_events(t).filter(F.col("target_type") == kind).write.mode("append").partitionBy("target_type").parquet(path)
    return t.spark.read.parquet(path).groupBy("workspace_id").agg(F.count("*").alias("events"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


# Recorded responses: each opening prompt of a conversation with the answer that follows it.
_PROMPTS = "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS prompt_id, CASE WHEN turn % 4 = 2 THEN 'About the candidate: ' || text ELSE text END AS prompt FROM conversations WHERE role = 'user'"
_RECORDED = "SELECT a.conv_id AS seq, a.text AS prompt, b.text AS response FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0"
_NORM = "lower(trim(regexp_replace({e}, '\\s+', ' ', 'g')))"
REPLAY = f"""pr AS ({_PROMPTS}), rec AS ({_RECORDED}), st AS (SELECT {_NORM.format(e='prompt')} AS key, arg_max(response, seq) AS response, min(seq) AS seq FROM rec GROUP BY ALL),
d AS (SELECT pr.*, st.response AS direct FROM pr LEFT JOIN st ON st.key = {_NORM.format(e='pr.prompt')}),
p2 AS (SELECT prompt_id, arg_min(response, seq) AS second FROM d JOIN st ON contains(prompt, left(response, 40)) AND trim(left(response, 40)) <> '' WHERE direct IS NULL GROUP BY prompt_id),
rp AS (SELECT prompt_id, prompt, CASE WHEN direct IS NOT NULL THEN 'recorded' WHEN second IS NOT NULL THEN 'recorded_partial' END AS provider, coalesce(direct, second) AS answer FROM d LEFT JOIN p2 USING (prompt_id))"""


def recorded(t):
    c = t.conversations
    opening = c.filter("turn = 0").select(F.col("conv_id").alias("seq"), F.col("text").alias("prompt"))
    return opening.join(shuffled(c.filter("turn = 1").select(F.col("conv_id").alias("seq"), F.col("text").alias("response"))), "seq")


@query("j20_recorded_lookup", f"WITH {REPLAY} SELECT prompt_id, prompt, provider, answer FROM rp")
def _(t):
    return rp.replay(build(t, _PROMPTS, "conversations"), recorded(t))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FILLED = f"""{REPLAY}, fb AS (SELECT prompt_id, prompt, coalesce(provider, 'deterministic') AS provider, coalesce(answer, CASE WHEN contains(lower(prompt), 'resume') OR contains(lower(prompt), 'candidate') THEN {_q(rp.RESUME_ANSWER)} ELSE {_q(rp.CONTRACT_ANSWER)} END) AS answer FROM rp)"""


@query("j21_deterministic_fallback", f"""WITH {FILLED} SELECT prompt_id, provider, md5(answer) AS answer_md5, CAST(floor(length(prompt) / 4 + 0.5) AS INTEGER) AS prompt_tokens, CAST(floor(length(answer) / 4 + 0.5) AS INTEGER) AS completion_tokens,
 CAST(floor((length(prompt) + length(answer)) / 4 + 0.5) AS INTEGER) AS total_tokens, CASE WHEN provider = 'deterministic' THEN sha256('deterministic-v1' || prompt) END AS fingerprint FROM fb""")
def _(t):
    return rp.with_fallback(rp.replay(build(t, _PROMPTS, "conversations"), recorded(t))).withColumn("answer_md5", F.md5("answer")).drop("prompt", "answer")


@query("g12_invocation_rows", f"""WITH {FILLED} SELECT prompt_id, provider, sha256(prompt) AS prompt_hash, CAST(floor(length(prompt) / 4 + 0.5) AS INTEGER) AS prompt_tokens, CAST(floor(length(answer) / 4 + 0.5) AS INTEGER) AS completion_tokens, false AS is_live, provider <> 'deterministic' AS is_recorded, provider = 'deterministic' AS is_deterministic FROM fb""")
def _(t):
    rows = w.invocation_rows(rp.with_fallback(rp.replay(build(t, _PROMPTS, "conversations"), recorded(t))))
    return rows.select("prompt_id", "provider", "prompt_hash", "prompt_tokens", "completion_tokens", "is_live", "is_recorded", "is_deterministic")


# Answers of a live model: what the assistant says next, where the recordings (first turns) do not reach.
_LIVE = "SELECT CAST(a.conv_id AS STRING) || '-' || CAST(a.turn AS STRING) AS prompt_id, b.text AS live FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND a.turn >= 2"
# One call for each event of the user whose number is the conversation's; its task is the event's.
_CALLS = "SELECT CAST(c.conv_id AS STRING) || '-' || CAST(c.turn AS STRING) AS prompt_id, 't' || CAST(event_id AS STRING) AS task_id, 'model-' || CAST(event_id % 3 AS STRING) AS model_name, CASE WHEN event_id % 4 > 0 THEN 'rev-' || CAST(event_id % 4 AS STRING) END AS model_revision, ts AS started_at, CASE WHEN event_id % 7 > 0 THEN ts + INTERVAL 1 SECOND * (event_id % 90) END AS finished_at FROM conversations c JOIN events e ON e.user_id = c.conv_id WHERE c.role = 'user'"
_TASK_RUNS = "SELECT run_id, workspace_id, 't' || CAST(CAST(substring(run_id, 2) AS BIGINT) - CAST(substring(run_id, 2) AS BIGINT) % 2 AS STRING) AS task_id, published_at FROM runs"


def _calls(t):
    prompts = t.conversations.filter("role = 'user'").select("conv_id", "turn")
    n = F.col("event_id")
    return prompts.join(t.events.select("event_id", "user_id", "ts"), F.col("conv_id") == F.col("user_id")).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"),
        F.concat(F.lit("t"), n.cast("string")).alias("task_id"), F.concat(F.lit("model-"), (n % 3).cast("string")).alias("model_name"),
        F.when(n % 4 > 0, F.concat(F.lit("rev-"), (n % 4).cast("string"))).alias("model_revision"), F.col("ts").alias("started_at"),
        F.when(n % 7 > 0, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (n % 90) * 1000000)).alias("finished_at"))


@query("g12_invocation_provenance", f"""WITH {FILLED}, lv AS ({_LIVE}), an AS (SELECT prompt_id, prompt, CASE WHEN provider = 'deterministic' AND live IS NOT NULL THEN 'hosted' ELSE provider END AS provider, CASE WHEN provider = 'deterministic' AND live IS NOT NULL THEN live ELSE answer END AS answer FROM fb LEFT JOIN lv USING (prompt_id)),
ca AS (SELECT * FROM ({_CALLS}) QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY started_at, task_id) = 1), runs AS ({RUNS}), ru AS (SELECT * FROM ({_TASK_RUNS}) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY published_at DESC, run_id DESC) = 1)
SELECT sha256(coalesce(run_id, '') || '|' || coalesce(task_id, '') || '|' || prompt_id) AS invocation_id, prompt_id, run_id, task_id, workspace_id, provider, model_name, model_revision, sha256(prompt) AS prompt_hash, CAST(floor(length(prompt) / 4 + 0.5) AS INTEGER) AS prompt_tokens, CAST(floor(length(answer) / 4 + 0.5) AS INTEGER) AS completion_tokens,
 CAST(floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000) AS BIGINT) AS latency_ms, provider = 'hosted' AS is_live, starts_with(provider, 'recorded') AS is_recorded, provider = 'deterministic' AS is_deterministic FROM an LEFT JOIN ca USING (prompt_id) LEFT JOIN ru USING (task_id)""")
def _(t):
    replayed = rp.replay(build(t, _PROMPTS, "conversations"), recorded(t))
    live = t.conversations.filter("role = 'assistant' AND turn >= 3").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("prompt_id"), F.col("text").alias("live"))
    missed = F.col("provider").isNull() & F.col("live").isNotNull()
    answered = replayed.join(live, "prompt_id", "left").withColumns({
        "answer": F.when(missed, F.col("live")).otherwise(F.col("answer")), "provider": F.when(missed, "hosted").otherwise(F.col("provider"))}).drop("live")
    runs_ = build(t, RUNS, "events").withColumn("_n", F.substring("run_id", 2, 20).cast("bigint")).select(
        "run_id", "workspace_id", F.concat(F.lit("t"), (F.col("_n") - F.col("_n") % 2).cast("string")).alias("task_id"), "published_at")
    return w.invocation_rows(rp.with_fallback(answered), _calls(t), runs_)
