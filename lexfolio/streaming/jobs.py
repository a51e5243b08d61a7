"""Streaming forms of intake, review, publication and counting.

Per-document stages need no state, so a stream runs the same plans as a batch. Sinks
are folders keyed by batch id: a batch that is replayed after a failure overwrites
what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lexfolio.operators import policy
from lexfolio.operators.workspace import fresh_results
from lexfolio.plans.reviews import review_contracts
from lexfolio.session import scratch_path


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream of files, be it one file or a directory of them.

    The path is a pattern that only the table matches: a stream takes a single file by a pattern alone.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.{{parquet}}")


#: Keyed state in RocksDB with change logs: a checkpoint costs what changed, not all keys. State with a
#: time to live asks for batches without data for ever, so a run over what is there does without them.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def run_available(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Process what is there in append mode and return the sink as a table; ``folder`` as in ``run_batches``."""
    spark = stream.sparkSession
    path = folder or scratch_path(spark, label)
    run = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], label: str, folder: str | None = None) -> DataFrame:
    """Apply a batch plan to every micro-batch; each batch owns one folder of the sink.

    ``folder`` holds the sink and the checkpoint; a later run on the same folder resumes the
    stream.
    """
    spark = stream.sparkSession
    path = folder or scratch_path(spark, label)

    def publish(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    run = stream.writeStream.foreachBatch(publish).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/data").drop("batch_id")


def review_stream(texts: DataFrame, label: str = "review-stream", folder: str | None = None) -> DataFrame:
    """(version_id, text, playbook) as a stream -> findings."""
    return run_batches(texts, lambda batch: policy.finding_rows(review_contracts(batch, "playbook")), label, folder)


def first_contents(texts: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Drop repeated contents that arrive within the delay, by content hash."""
    hashed = texts.withColumn("sha256", F.sha2("text", 256)).withWatermark(event_time, delay)
    return hashed.dropDuplicatesWithinWatermark(["sha256"])


class FirstOfKey(StatefulProcessor):
    """The first row of each key by ``order``, once over all batches; state is one flag per key, kept for ``keep_ms``."""

    def __init__(self, columns: list[str], order: list[str], keep_ms: int | None):
        self.columns, self.order, self.keep_ms = columns, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "published boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if self.done.exists():
            return iter(())
        first = min(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order))
        self.done.update((True,))
        return iter([Row(*self.columns)(*[first[c] for c in self.columns])])


def first_of_key_stream(rows: DataFrame, key: str, order: list[str], keep_days: float | None = 30) -> DataFrame:
    """Stream of the first row per key: of the batch in which the key comes first, the least by ``order``, nulls first.

    Rows without a key have none to be repeated under and are left out. A key is forgotten
    ``keep_days`` after its row (None: never), which bounds the state; a repetition later than
    that counts as new. Rows of one key in an Arrow batch are combined before they are shuffled.
    """

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(order, kind="stable", na_position="first").drop_duplicates(key)

    keyed = rows.filter(F.col(key).isNotNull())
    keep_ms = None if keep_days is None else max(1, round(keep_days * 86_400_000))
    combined = keyed.mapInPandas(combine, keyed.schema)
    mode = "None" if keep_ms is None else "ProcessingTime"
    return combined.groupBy(key).transformWithState(FirstOfKey(keyed.columns, order, keep_ms), keyed.schema, "Append", mode)


def publish_stream(
    results: DataFrame, tasks: DataFrame, label: str = "publish-stream", folder: str | None = None, keep_days: float | None = 30
) -> DataFrame:
    """Results with their task's current token, once per task over all batches and restarts.

    What was published is known from state keyed by task, so no batch reads the sink.
    """
    spark = results.sparkSession
    earlier = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        order = ["published_at", *[c for c in results.columns if c not in ("task_id", "published_at")]]
        first = first_of_key_stream(fresh_results(results, tasks), "task_id", order, keep_days)
        return run_available(first, label, folder)
    finally:
        for k, v in earlier.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def window_counts(events: DataFrame, event_time: str, kind: str, width: str, delay: str) -> DataFrame:
    """Counts per kind and time window; a window is final once the delay has passed."""
    return (
        events.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width), kind)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "n")
    )
