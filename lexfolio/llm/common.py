"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read by Spark."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``: the fixed split into learning and held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)).cast("int")


def batches_of(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Cut a batch into slices whose ``column`` holds about ``max_bytes`` at most (one row at least).

    Keeps the memory of a Python worker independent of how long the texts of a batch are.
    """
    lengths = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)]
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SEGMENT_BITS = 1 << 20


def filter_bits(entries: int, each: int = 16, least: int = 1 << 16, most: int = 1 << 28) -> int:
    """Size of a Bloom filter: a power of two, ``each`` bits an entry, at most ``most`` (32 MB).

    Beyond the bound the filter lets more through; whoever uses it must stay right then.
    """
    return min(most, 1 << (max(least, entries * each) - 1).bit_length())


def collect_bits(placed: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a filter in which the bits ``placed(bit)`` are set.

    Executors fill segments of it; the driver only puts them side by side.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        segment = np.zeros(SEGMENT_BITS, np.uint8)
        segment[(rows["bit"] % SEGMENT_BITS).to_numpy()] = 1
        packed = np.packbits(segment, bitorder="little").tobytes()
        return pd.DataFrame({"segment": [int(rows["bit"].iloc[0]) // SEGMENT_BITS], "bits": [packed]})

    out = np.zeros(max(1, bits // 8), np.uint8)
    segments = placed.distinct().groupBy(F.expr(f"bit div {SEGMENT_BITS}").alias("segment")).applyInPandas(fill, "segment long, bits binary")
    for row in segments.toLocalIterator():
        lo = row["segment"] * SEGMENT_BITS // 8
        part = np.frombuffer(row["bits"], np.uint8)[: len(out) - lo]
        out[lo : lo + len(part)] = part
    return out


def has_bits(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bits ``at`` (unsigned 64-bit numbers) are set."""
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
