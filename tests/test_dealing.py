"""Rows that become texts are dealt to all tasks, however their file is cut."""

from pyspark.sql import functions as F

from lexfolio.plans.registry import Tables
from lexfolio.sources import corpora


def test_one_row_group_in_many_splits(spark, tmp_path):
    spark.range(1, 20001, 1, 1).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        contracts = corpora.contracts(Tables(spark, str(tmp_path)))
        tasks = [r["count"] for r in contracts.select("version_id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sum(tasks) == 20000
    assert max(tasks) < 20000 / 8
