"""Audit of how document filters act together, in every order they can be applied.

Method: incremental retraction streaming. The files of the table are processed as
available-now micro-batches. Four filters look at one text alone and make a mask; the
fifth removes a text that a smaller id holds as well, which only the whole table can tell.
State keyed by text (a few texts share a slot, which saves calls) holds for each text the smallest id so far with its marks. A smaller id takes
its place, and the marks of the earlier one are retracted: they leave their counter and
enter the one with the fifth filter's bit. Counters are rows per part, mask and label, so
all 120 orders follow from a table whose size does not depend on the documents.

Copies of one text meet in one key. Each task therefore combines equal texts first, and a
key gets at most a row for each task, part and label, whatever share of the table it holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lexfolio.session import scratch_path

LETTERS = "ABCDE"
#: Texts that share one state, on average.
TEXTS_IN_SLOT = 8
BY = ("text_key", "part", "mask", "good", "toxic")
BITS = {letter: 1 << i for i, letter in enumerate(LETTERS)}
#: State lives on disk and memory holds a cache of it; a batch stores its changes, not the whole state.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
MARKS = "part string, mask int, good boolean, toxic boolean, n long"
CHANGE = Row("part", "mask", "good", "toxic", "n")


def failed(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    # single blanks split without a regular expression; what lies between two of them is no word
    words = F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]+", " "), " "), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = {
        "A": n < 50,
        "B": distinct * 100 < n * 65,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }
    bits = F.lit(0)
    for letter, test in tests.items():
        bits = bits + F.when(test, F.lit(BITS[letter])).otherwise(F.lit(0))
    return bits


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, mask) of documents, streamed or not; texts go no further than this."""
    text = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    return text.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), failed(F.col("text")).alias("mask"))


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row a document: a label counts if any of its rows has it."""
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one Arrow batch with equal part and labels: the smallest id, rows that have it, all rows."""
    for batch in batches:
        found: dict[tuple, list] = {}
        ids, *rest = (batch.column(c).to_pylist() for c in ("doc_id", *BY))
        for doc_id, *key in zip(ids, *rest, strict=True):
            entry = found.setdefault((*key, doc_id is None), [doc_id, 0, 0])
            entry[2] += 1
            if doc_id is not None:
                if doc_id < entry[0]:
                    entry[0], entry[1] = doc_id, 0
                entry[1] += doc_id == entry[0]
        rows = [(*key[:-1], *entry) for key, entry in found.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.binary(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*BY, "least", "n_least", "n"])


COMBINED = "text_key binary, part string, mask int, good boolean, toxic boolean, least long, n_least long, n long"


class SmallestIds(StatefulProcessor):
    """Keyed state of the few texts whose keys fall into one slot: of each its smallest id so far and,
    by part and labels, how many rows hold it.

    New rows give changes of the counters, retractions included.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("smallest", "texts string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.state.get()
        texts = json.loads(known[0]) if known is not None else {}
        by_text: dict[str, list[Row]] = {}
        for row in rows:
            by_text.setdefault(row["text_key"].hex(), []).append(row)
        changes: list[tuple] = []
        changed = False
        for text, new in by_text.items():
            before = texts.get(text, [None, []])
            least, held, found = advance(*before, new)
            changes += found
            if [least, held] != before:
                texts[text], changed = [least, held], True
        if changed:
            self.state.update((json.dumps(texts, separators=(",", ":")),))
        return iter([CHANGE(*c) for c in changes])


def advance(least: int | None, held: list, rows: Iterable[Row]) -> tuple[int | None, list, list[tuple]]:
    """The state of a text after some combined rows, and the (part, mask, good, toxic, n) changes they bring."""
    late = BITS["E"]
    changes: list[tuple] = []
    for row in rows:
        part, mask, good, toxic, low, n_low, n = row["part"], row["mask"], row["good"], row["toxic"], row["least"], row["n_least"], row["n"]
        if low is None:  # a row without an id is nobody's copy and has none
            changes.append((part, mask, good, toxic, n))
            continue
        if n > n_low:
            changes.append((part, mask | late, good, toxic, n - n_low))
        if least is None or low < least:
            for p, m, g, t, k in held:
                changes += [(p, m, g, t, -k), (p, m | late, g, t, k)]
            least, held = low, []
        if low == least:
            changes.append((part, mask, good, toxic, n_low))
            held = [*held, [part, mask, good, toxic, n_low]]
        else:
            changes.append((part, mask | late, good, toxic, n_low))
    return least, held, changes


def counter_changes(docs: DataFrame, labels: DataFrame, slots: int) -> DataFrame:
    """Stream of (part, mask, good, toxic, n): what a stream of documents adds to the counters and takes back."""
    rows = marked(docs).join(label_flags(labels), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    combined = rows.mapInArrow(combine, COMBINED)
    slotted = combined.withColumn("slot", F.pmod(F.xxhash64("text_key"), F.lit(slots)))
    return slotted.groupBy("slot").transformWithState(SmallestIds(), MARKS, "Append", "None")


def run_stream(docs: DataFrame, labels: DataFrame, out: str, checkpoint: str, slots: int) -> None:
    """Process all that a document stream has now. Each micro-batch writes its own folder below ``out``,
    and writes it again when it is replayed; with the same ``checkpoint`` and ``slots`` a later run takes up
    new files only. ``slots`` is about an eighth of the texts to come: a slot's state is read and written whole."""

    def store(changes: DataFrame, batch: int) -> None:
        summed = changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    spark = docs.sparkSession
    earlier = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        writer = counter_changes(docs, labels, slots).writeStream.outputMode("append").foreachBatch(store)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in earlier.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counters(spark: SparkSession, out: str) -> DataFrame:
    """(part, mask, good, toxic, n): the sum of all batches' changes; rows that cancel out go."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MARKS)
    changes = spark.read.schema(f"{MARKS}, batch int").parquet(out)
    return changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def _steps() -> Column:
    """Every filter behind every set of earlier ones: its orders, and how often an order begins so."""
    out = []
    for letter in LETTERS:
        others = LETTERS.replace(letter, "")
        for k in range(len(LETTERS)):
            for earlier in combinations(others, k):
                orders = ["".join((*a, letter, *b)) for a in permutations(earlier) for b in permutations([x for x in others if x not in earlier])]
                out.append(
                    F.struct(
                        F.lit(sum(BITS[x] for x in earlier)).alias("before"), F.lit(BITS[letter]).alias("bit"), F.lit(k + 1).alias("step"),
                        F.lit(factorial(k) * factorial(4 - k)).cast("long").alias("times"), F.lit(",".join(orders)).alias("orders"),
                    )
                )
    return F.array(*out)


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, from the counters alone."""
    mask, bit, before, n = F.col("mask"), F.col("bit"), F.col("before"), F.col("n")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(test: Column, name: str) -> Column:
        return F.sum(F.when(test, n).otherwise(F.lit(0))).cast("long").alias(name)

    by_step = (
        counted.select("part", "mask", "good", "toxic", "n", F.explode(_steps()).alias("_s"))
        .select("part", "mask", "good", "toxic", "n", "_s.*")
        .groupBy("part", "before", "bit", "step", "times", "orders")
        .agg(
            total(~fails & ~gone, "kept"), total(fails & ~gone, "removed"), total(fails & gone, "redundant"),
            total(mask == bit, "unique_fails"), total(fails & ~gone & F.col("good"), "good_lost"), total(fails & ~gone & F.col("toxic"), "toxic_lost"),
        )
    )
    shared = F.sum(F.col("times") * F.col("removed")).over(Window.partitionBy("part", "bit")).cast("long")
    return by_step.withColumn("shapley", shared).select(
        "part", F.explode(F.split("orders", ",")).alias("filter_order"), "step",
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def audit_files(spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """The audit of a Parquet table of documents (doc_id, text, source), streamed file by file.

    ``batch_bytes`` of files make a micro-batch, 32 MB for each core unless it is given. A null
    text is empty, a null source is the part "". Rows that share id and text are no copies of
    each other; a row without an id is no copy and has none. Repeated labels count once.
    Other columns are ignored. An empty table has no parts and gives no rows.
    """
    most = batch_bytes or (32 << 20) * spark.sparkContext.defaultParallelism
    anything = f"{path[:-1]}[{path[-1]}]"  # a file source takes a table of one file by a glob only
    table = spark.read.parquet(path)
    slots = max(1, table.count() // TEXTS_IN_SLOT)
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(most)).parquet(anything)
    folder = scratch_path(spark, "filter-audit")
    run_stream(stream, labels, f"{folder}/changes", f"{folder}/checkpoint", slots)
    return audit(counters(spark, f"{folder}/changes"))


#: The same audit as one SQL statement.
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(words) < 50 AS fa,
    100 * len(list_distinct(words)) < 65 * len(words) AS fb,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fc,
    regexp_matches(t, '[#$%&*|]') AS fd,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS fe
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (
  SELECT part, good, toxic, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS mask, count(*) AS n
  FROM m GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
