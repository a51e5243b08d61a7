"""Registry of named queries and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

def spread(df: DataFrame) -> DataFrame:
    """Use every core when a small input arrives in fewer splits than there are cores.

    Large inputs already have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame) -> DataFrame:
    """Deal rows of a few numbers evenly, for work that makes a long text of each.

    Splits are counted by bytes, but one task reads a whole row group, so most of many splits may
    be empty; and a split of numbers becomes hundreds of times its size in text.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else 4 * splits)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table, for text work that costs far more than its bytes suggest."""
        return spread(getattr(self, name))


    def dealt(self, name: str) -> DataFrame:
        """The table, to derive a text from each row."""
        return deal(getattr(self, name))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional SQL twin."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
