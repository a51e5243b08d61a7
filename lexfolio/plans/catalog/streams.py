"""Streaming jobs run over what the tables hold, compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio.plans.catalog.contracts_sql import policy_cte
from lexfolio.plans.catalog.workspaces import _RESULTS, TASKS, tasks
from lexfolio.plans.registry import query
from lexfolio.session import scratch_path
from lexfolio.playbooks import PLAYBOOKS
from lexfolio.sources import corpora
from lexfolio.sources.corpora import build
from lexfolio.streaming import jobs


@query("t01_review_stream", f"WITH RECURSIVE {policy_cte(PLAYBOOKS)} SELECT version_id, rule_id, severity, explanation FROM findings")
def _(t):
    orders = jobs.table_stream(t.spark, t.folder, "orders").repartition(t.spark.sparkContext.defaultParallelism)
    select = corpora.CONTRACTS_SQL.removesuffix(" FROM orders").removeprefix("SELECT ")
    texts = t.spark.sql("SELECT " + select + " FROM {o}", o=orders)
    return jobs.review_stream(texts).select("version_id", "rule_id", "severity", "explanation")


@query("t02_stream_dedup", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def _(t):
    docs = jobs.table_stream(t.spark, t.folder, "documents").select("text", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("arrived"))
    return jobs.run_available(jobs.first_contents(docs, "arrived", "30 days").select("sha256"), "dedup")


@query("t03_idempotent_publish", f"SELECT task_id, published_at, fencing_token, run_id FROM ({_RESULTS}) r JOIN (SELECT task_id, fencing_token AS tok FROM ({TASKS})) USING (task_id) WHERE fencing_token = tok QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY published_at, fencing_token, run_id) = 1")
def _(t):
    # Results arrive in three files in the order of their time; the second arrives twice, and the job is started anew for each.
    landing, folder = scratch_path(t.spark, "results"), scratch_path(t.spark, "publish-stream")
    results = build(t, _RESULTS, "events")
    first, last = t.events.agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b")).first()
    third = (last - first) / 3 if first else None
    share = F.when(F.col("published_at") < F.lit(first) + F.lit(third), 0).when(F.col("published_at") < F.lit(first) + F.lit(third) * 2, 1).otherwise(2) if first else F.lit(0)
    out = None
    for part in (0, 1, 1, 2):
        results.filter(share == part).write.mode("append").parquet(landing)
        out = jobs.publish_stream(t.spark.readStream.schema(results.schema).parquet(landing), tasks(t), folder=folder)
    return out


@query("t04_window_counts", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
 SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)""")
def _(t):
    events = jobs.table_stream(t.spark, t.folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.run_available(jobs.window_counts(events, "ts", "event_type", "1 hour", "30 minutes"), "windows")
