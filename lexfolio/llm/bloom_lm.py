"""Language-model scoring with a log-frequency Bloom filter.

n-gram counts are quantised on a logarithmic scale; an n-gram of level q is stored as q
entries (n-gram, 1) .. (n-gram, q) of a Bloom filter of fixed size. Its count is read back
by probing level after level until one is missing. The filter is cut into segments by the
leading bits of the n-gram hash, so that each counting task fills its own segment; the
filter has a fixed number of bits, whatever the corpus holds, and is what workers get.

The exact unigram counts of the base score stay distributed: the most frequent words (a
bounded number) go to the workers, every other word is resolved by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of, id_remainder, shuffle_partitions
from lexfolio.session import materialize

#: Hashes of the tokens that are no words: before the first word, after the last.
START, END = np.uint64(0x5BF03635F0A5D6A1), np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers that mix 64-bit hashes.
MIX_A, MIX_B, MIX_C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """bits: size of the filter. base: of the count scale. probes: hashes an entry.
    min_pair: bigrams seen less often are left to the smoothing, as usual for back-off models.
    weight: of the bigram estimate. head_words: unigrams sent to the workers with exact counts."""

    bits: int = 1 << 28
    base: float = 1.5
    probes: int = 2
    min_pair: int = 2
    weight: float = 0.2
    head_words: int = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * MIX_C + (right ^ (right >> np.uint64(29))) * MIX_B)


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count))."""
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def count_at(level: np.ndarray, base: float) -> np.ndarray:
    """Middle of the counts of a level; 0 at level 0."""
    low = np.ceil(base ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(base**level - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def probe(h: np.ndarray, level: int, probes: int, segment_bits: int) -> Iterator[np.ndarray]:
    """Places of an entry inside its segment."""
    for k in range(probes):
        yield mixed(h + np.uint64((level * 16 + k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(segment_bits)


class WordHashes:
    """64-bit hashes of the words of a text, with a bounded cache."""

    def __init__(self, most: int = 150_000):
        self.most, self.cache = most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        cache = self.cache
        try:
            found = [cache[w] for w in words]
        except KeyError:
            if len(cache) > self.most:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            found = [cache[w] for w in words]
        out = np.empty(len(found) + 1, np.uint64)
        out[:-1] = found
        out[-1] = END
        return out


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    return pair_hash(np.concatenate(([START], tokens[:-1])), tokens)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(b"".join(keys), np.uint64)
    c = np.frombuffer(b"".join(counts), np.uint32).astype(np.float64)
    distinct, at = np.unique(k, return_inverse=True)
    return distinct, np.bincount(at, weights=c, minlength=len(distinct)).astype(np.int64)


def count_ngrams(texts: DataFrame, settings: Settings, chunk_tokens: int = 1_000_000) -> tuple[DataFrame, int]:
    """One row per hash segment: its part of the filter, its unigrams with exact counts, its totals."""
    segments = 1 << max(4, (shuffle_partitions(texts.sparkSession) - 1).bit_length())
    shift = np.uint64(64 - (segments.bit_length() - 1))
    segment_bits = settings.bits // segments

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        ones: list[np.ndarray] = []
        twos: list[np.ndarray] = []
        held = 0

        def emit():
            rows = []
            for kind, (keys, counts) in enumerate((_counted(ones), _counted(twos)), 1):
                cuts = np.searchsorted(keys >> shift, np.arange(segments + 1))
                for s in range(segments):
                    a, b = cuts[s], cuts[s + 1]
                    if b > a:
                        rows.append((s, kind, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["segment", "n", "keys", "counts"])

        for whole in batches:
            for batch in batches_of(whole, "text", 2 << 20):
                for text in batch.column("text").to_pylist():
                    t = words(text)
                    ones.append(t)
                    twos.append(pairs_of(t))
                    held += len(t)
                if held > chunk_tokens:
                    yield emit()
                    ones, twos, held = [], [], 0
        if held:
            yield emit()

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(segment_bits, np.bool_)
        one = rows[rows["n"] == 1]
        keys, counts = _summed(list(one["keys"]), list(one["counts"]))
        two = rows[rows["n"] == 2]
        pair_keys, pair_counts = _summed(list(two["keys"]), list(two["counts"]))
        often = pair_counts >= settings.min_pair
        for h, c in ((keys, counts), (pair_keys[often], pair_counts[often])):
            levels = level_of(c, settings.base) if len(c) else c
            for level in range(1, int(levels.max(initial=0)) + 1):
                for at in probe(h[levels >= level], level, settings.probes, segment_bits):
                    bits[at] = True
        return pd.DataFrame({
            "segment": [int(rows["segment"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()],
            "words": [keys.view(np.int64).tolist()], "counts": [counts.tolist()], "total": [int(counts.sum())], "kinds": [len(keys)],
        })

    gathered = texts.select("text").mapInArrow(gather, "segment int, n int, keys binary, counts binary")
    reduced = gathered.groupBy("segment").applyInPandas(
        reduce, "segment int, bits binary, words array<long>, counts array<long>, total long, kinds long"
    )
    return materialize(reduced, "ngram-counts"), segments


def probed_counts(h: np.ndarray, bits: np.ndarray, segments: int, settings: Settings) -> np.ndarray:
    """Counts of n-gram hashes, read from the filter by repeated membership probes."""
    segment_bits = settings.bits // segments
    offset = (h >> np.uint64(64 - (segments.bit_length() - 1))) * np.uint64(segment_bits)
    level = np.zeros(len(h), np.int64)
    alive = np.arange(len(h))
    depth = 1
    while len(alive):
        there = np.ones(len(alive), np.bool_)
        for at in probe(h[alive], depth, settings.probes, segment_bits):
            place = at + offset[alive]
            there &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        alive = alive[there]
        level[alive] = depth
        depth += 1
        if depth > 64:
            break
    return count_at(level, settings.base)


def score_texts(docs: DataFrame, train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score each row's ``text`` under the counts of ``train``'s texts; other columns of ``docs`` stay.

    Adds n_tokens, n_known, train_tokens, base_score (add-one unigrams, exact counts) and
    score (interpolated bigrams from the filter, log10). A null text is empty: one end token.
    With no training text all counts are 0. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    counts, segments = count_ngrams(train, settings)
    totals = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    n, v = int(totals[0]), int(totals[1])
    bits = np.zeros(settings.bits // 8, np.uint8)
    each = settings.bits // segments // 8
    for row in counts.select("segment", "bits").toLocalIterator():  # fixed size in all: settings.bits
        bits[row["segment"] * each : (row["segment"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    table = counts.select(F.explode(F.arrays_zip("words", "counts")).alias("e")).select(
        F.col("e.words").alias("word"), F.col("e.counts").alias("n")
    )
    # the least count of the head: the distribution of log counts has a few dozen rows
    steps = table.groupBy(F.floor(F.log2("n") * 4).alias("step")).count().orderBy(F.desc("step")).collect()
    least, heads = 2.0**62, 0
    for s in steps:
        heads += s["count"]
        if heads > settings.head_words:
            break
        least = 2.0 ** (s["step"] / 4)
    is_head = F.floor(F.log2("n") * 4) >= round(np.log2(least) * 4)
    head = table.filter(is_head).toPandas()
    head = head.sort_values("word")
    order = np.argsort(head["word"].to_numpy(np.int64).view(np.uint64), kind="stable")
    head_words = head["word"].to_numpy(np.int64).view(np.uint64)[order]
    head_counts = head["n"].to_numpy(np.int64)[order]
    shared = spark.sparkContext.broadcast((bits, head_words, head_counts))
    norm = float(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, head_words, head_counts = shared.value
        words = WordHashes()
        task = TaskContext.get().partitionId() << 40
        number = 0
        for whole in batches:
            for batch in batches_of(whole, "text", 2 << 20):
                docs_tokens = [words(t) for t in batch.column("text").to_pylist()]
                sizes = np.array([len(t) for t in docs_tokens], np.int64)
                tokens = np.concatenate(docs_tokens)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                # distinct tokens and pairs of the batch are probed once
                kinds, at = np.unique(tokens, return_inverse=True)
                place = np.minimum(np.searchsorted(head_words, kinds), max(0, len(head_words) - 1))
                c = np.where(head_words[place] == kinds, head_counts[place], 0) if len(head_words) else np.zeros(len(kinds), np.int64)
                gain = np.log10(c + 1.0)[at]
                one = probed_counts(kinds, bits, segments, settings)
                previous = np.concatenate(([END], tokens[:-1]))
                previous[starts] = START
                pairs, pair_at = np.unique(pair_hash(previous, tokens), return_inverse=True)
                two = probed_counts(pairs, bits, segments, settings)[pair_at]
                before = np.concatenate(([0.0], one[at][:-1]))
                before[starts] = one[np.searchsorted(kinds, END)]  # as many texts begin as end
                share = np.minimum(1.0, two / np.maximum(before, np.maximum(two, 1.0)))
                p = settings.weight * share + (1 - settings.weight) * (one[at] + 1.0) / norm
                known = (c > 0)[at]
                score = np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)
                tail_words, tail_counts = [], []
                for s, size in zip(starts, sizes, strict=True):
                    t = tokens[s : s + size][~known[s : s + size]]
                    w, k = np.unique(t, return_counts=True)
                    tail_words.append(w.view(np.int64))
                    tail_counts.append(k)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(w) for w in tail_words]))), pa.int32())
                columns = {name: batch.column(name) for name in keep} | {
                    "_row": pa.array(task + number + np.arange(len(sizes))),
                    "n_tokens": pa.array(sizes),
                    "_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    "_gain": pa.array(np.add.reduceat(gain, starts)),
                    "score": pa.array(score),
                    "_tail": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tail_words), pa.int64())),
                    "_times": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tail_counts), pa.int64())),
                }
                number += len(sizes)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    schema += (", " if schema else "") + "_row long, n_tokens long, _known long, _gain double, score double, _tail array<long>, _times array<long>"
    scored = materialize(docs.mapInArrow(run, schema), "lm-scores")
    tail = scored.select("_row", F.explode(F.arrays_zip("_tail", "_times")).alias("e")).select(
        "_row", F.col("e._tail").alias("word"), F.col("e._times").alias("times")
    )
    found = (
        tail.join(table.filter(~is_head), "word")
        .groupBy("_row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more"), F.sum("times").alias("_also"))
    )
    none = F.lit(0)
    return scored.join(found, "_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("_known") + F.coalesce("_also", none)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_gain") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(norm)))).alias("base_score"),
        "score",
    )


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The digest over documents: learn from ids whose remainder modulo 7 is not 2, score all."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(id_remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    return score_texts(rows, rows.filter(~F.col("held_out")), settings)
