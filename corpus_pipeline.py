"""The training-data pipeline: five stages over documents, each stage a table for the next.

Language identification and the quality classifier reject documents, line deduplication
edits texts, the n-gram join keeps one document of each group, packing cuts what is left
into sequences. A stage takes (spark, docs, sf_dir) and returns its rows; all but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfolio.llm import line_dedup, ngram_join, packing, ppm, pu_quality
from lexfolio.llm.common import table
from lexfolio.session import scratch_path

#: A text is rejected as being in no known language below this share of its best language.
LANGUAGE_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language: not und, and one language clearly ahead. Null texts go."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    judged = ppm.predict(own, ppm.train(ppm.learning_rows(docs)))
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select("_row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose document the classifier predicts to be good. Rows without a doc_id are no documents and go."""
    judged = pu_quality.classify(docs, table(spark, sf_dir, "labels"))
    good = judged.groupBy("doc_id").agg(F.max("predicted").alias("_good")).filter("_good = 1").select(F.col("doc_id").alias("_id"))
    return docs.join(good, docs["doc_id"].cast("long") == good["_id"], "left_semi")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, texts without the lines that an earlier line repeats."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("_row")
    return line_dedup.dedupe(docs.select("doc_id", "text", others)).select("_row.*", "text").select(*docs.columns)


def group_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one that names the group, its smallest doc_id."""
    kept = ngram_join.near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs["doc_id"].cast("long") == kept["_id"], "left_semi")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("lines", line_stage),
    ("groups", group_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained models nor the packing order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
