"""Phrase collocations of each language, from exact counts of runs of one to four words.

Method: HAT-trie counting. A task keeps a trie over word numbers whose upper level branches
on the first word and whose leaves are hash containers of what follows; a container that
grows too large bursts into one container for each next word. When the trie as a whole
reaches its bound, its largest subtrees leave it as sorted runs. A phrase belongs to the
partition that its first two words hash to; there the runs of all tasks are merged in
order, block by block, so neither side ever holds a whole table.

Counting takes two passes. The first counts words and pairs. A longer phrase can only be
frequent if all its pairs are, so the second counts runs of three and four words whose pairs
pass a Bloom filter of the frequent ones. Its size follows their number up to a fixed
bound; a false positive costs a row that the threshold drops, never a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of, shuffle_partitions
from lexfolio.session import materialize

#: Bits of a word number in a packed suffix; a suffix of three words fits 63 bits.
WORD_BITS = 21
#: Word numbers that one task hands out before it spills everything and starts anew.
MAX_WORDS = 700_000
#: Entries of all containers of one task before subtrees are spilled.
MAX_ENTRIES = 900_000
#: Entries of one container before it bursts.
BURST_ENTRIES = 8_192
#: Phrases in one row of a run.
BLOCK = 4_096
#: Bits of the filter for each frequent pair, and the bound of its size (32 MB).
FILTER_BITS_EACH, FILTER_MAX_BITS, FILTER_SEGMENT_BITS = 16, 1 << 28, 1 << 20

RUN = "part int, lang string, first binary, phrases binary, counts binary"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
_WORD_MASK = (1 << WORD_BITS) - 1


class HatTrie:
    """Counts of word-number sequences: a root by first word, hash containers below, burst on demand."""

    def __init__(self, burst: int = BURST_ENTRIES):
        self.burst = burst
        self.root: dict[int, dict] = {}
        #: first words whose container has burst: their value maps the next word to a container
        self.open: set[int] = set()
        self.size = 0

    def add(self, first: np.ndarray, suffix: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct (first, suffix) entries, sorted by first and then suffix."""
        if not len(first):
            return
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]).tolist()
        firsts, ends = first[starts].tolist(), [*starts[1:], len(first)]
        suffixes, times = suffix.tolist(), counts.tolist()
        root, size = self.root, self.size
        for word, lo, hi in zip(firsts, starts, ends, strict=True):
            container = root.get(word)
            if container is None:
                container = root[word] = dict(zip(suffixes[lo:hi], times[lo:hi], strict=True))
                size += hi - lo
            elif word in self.open:
                size += self._add_below(container, suffixes, times, lo, hi)
                continue
            else:
                before = len(container)
                for i in range(lo, hi):
                    s = suffixes[i]
                    container[s] = container.get(s, 0) + times[i]
                size += len(container) - before
            if len(container) > self.burst:
                self._open(word, container)
        self.size = size

    def _add_below(self, node: dict, suffixes: list, times: list, lo: int, hi: int) -> int:
        new = 0
        for i in range(lo, hi):
            s = suffixes[i]
            container = node.setdefault(s >> 2 * WORD_BITS, {})
            if s in container:
                container[s] += times[i]
            else:
                container[s] = times[i]
                new += 1
        return new

    def _open(self, word: int, container: dict) -> None:
        """Burst: one container for each next word instead of one for all."""
        node: dict[int, dict] = {}
        for s, n in container.items():
            node.setdefault(s >> 2 * WORD_BITS, {})[s] = n
        self.root[word] = node
        self.open.add(word)

    def containers(self, word: int) -> list[dict]:
        """The hash containers of one subtree."""
        return list(self.root[word].values()) if word in self.open else [self.root[word]]

    def take(self, most_left: int) -> Iterator[tuple[int, list[dict]]]:
        """Remove whole subtrees, largest first, until at most ``most_left`` entries stay."""
        sizes = {word: sum(map(len, c.values())) if word in self.open else len(c) for word, c in self.root.items()}
        for word in sorted(sizes, key=sizes.__getitem__, reverse=True) if most_left else sizes:
            if self.size <= most_left:
                return
            containers = self.containers(word)
            self.size -= sizes[word]
            del self.root[word]
            self.open.discard(word)
            yield word, containers


def words_with_breaks(text: str) -> list[bytes]:
    """Words of a text in lower case (A-Z alone); b"." stands wherever a piece ends."""
    plain = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_BREAKS)
    return plain.replace(b".", b" . ").split()


def part_of(lang: str, first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """Partition of all phrases of a language that begin with the same two words (or are one word), from word hashes."""
    with np.errstate(over="ignore"):
        h = (first * np.uint64(0x9E3779B97F4A7C15) + second) ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


class PhraseCounter:
    """Counts phrases of some lengths for one task and turns spilled subtrees into runs."""

    def __init__(self, orders: tuple[int, ...], parts: int, passes=None, max_entries: int = MAX_ENTRIES, max_words: int = MAX_WORDS):
        self.orders, self.parts, self.passes = orders, parts, passes
        self.max_entries, self.max_words = max_entries, max_words
        self._reset()

    def _reset(self) -> None:
        self.tries: dict[str, HatTrie] = defaultdict(HatTrie)
        numbers = count(1)
        self.numbers: dict[bytes, int] = defaultdict(numbers.__next__)
        self.numbers[b"."] = 0
        self.totals: dict[str, int] = defaultdict(int)
        self.hashes = np.zeros(1, np.uint64)

    def _word_hashes(self) -> np.ndarray:
        """64-bit hashes of all numbered words, extended by the new ones."""
        known = len(self.hashes)
        if len(self.numbers) > known:
            words = list(self.numbers)[known:]
            self.hashes = np.r_[self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))]
        return self.hashes

    def add(self, lang: str, texts: list[str]) -> Iterator[tuple]:
        """Count some texts of one language; yields run blocks when bounds are reached."""
        tokens: list[bytes] = []
        for t in texts:
            tokens += words_with_breaks(t)
            tokens.append(b".")
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        del tokens
        ids = np.r_[ids, np.zeros(3, np.int64)]
        n = len(ids) - 3
        w = [ids[k : n + k] for k in range(4)]
        if 1 in self.orders:
            self.totals[lang] += int(np.count_nonzero(ids))
        if self.passes:
            h = self._word_hashes()
            good = self.passes(lang, h[ids[:-1]], h[ids[1:]]) & (ids[:-1] > 0) & (ids[1:] > 0)
            good = np.r_[good, np.zeros(3, bool)]
        for order in self.orders:
            if self.passes:
                keep = np.logical_and.reduce([good[k : n + k] for k in range(order - 1)])
            else:
                keep = np.logical_and.reduce([w[k] > 0 for k in range(order)])
            at = np.flatnonzero(keep)
            suffix = np.zeros(len(at), np.int64)
            for k in range(1, order):
                suffix |= w[k][at] << (3 - k) * WORD_BITS
            self.tries[lang].add(*self._distinct(w[0][at], suffix, order))
        if len(self.numbers) > self.max_words:
            yield from self.flush()
        elif sum(t.size for t in self.tries.values()) > self.max_entries:
            yield from self._spill(self.max_entries // 2)

    @staticmethod
    def _distinct(first: np.ndarray, suffix: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct entries in order, with their counts. Up to three words are one sortable number."""
        if order < 4:
            key = np.sort(first << 2 * WORD_BITS | suffix >> WORD_BITS)
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            first, suffix = key[new] >> 2 * WORD_BITS, (key[new] & (1 << 2 * WORD_BITS) - 1) << WORD_BITS
        else:
            order_of = np.lexsort((suffix, first))
            first, suffix = first[order_of], suffix[order_of]
            new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (suffix[1:] != suffix[:-1])]) if len(first) else np.zeros(0, int)
            key, first, suffix = first, first[new], suffix[new]
        return first, suffix, np.diff(np.r_[new, len(key)])

    def flush(self) -> Iterator[tuple]:
        """All that is left, as runs; the counter is empty afterwards."""
        yield from self._spill(0)
        for lang, total in self.totals.items():
            yield 0, lang, b"", b"", np.array([total], "<i8").tobytes()
        self._reset()

    def _spill(self, most_left: int) -> Iterator[tuple]:
        names = list(self.numbers)
        hashes = self._word_hashes()
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(1, len(names) + 1)
        rank[0] = 0  # number 0: no word
        tails = [b"", *map(b" ".__add__, names[1:])]
        whole = max(1, sum(t.size for t in self.tries.values()))
        for lang, trie in self.tries.items():
            taken = list(trie.take(trie.size * most_left // whole))
            if not taken:
                continue
            leaves = [c for _, containers in taken for c in containers]
            sizes = [sum(map(len, containers)) for _, containers in taken]
            n = sum(sizes)
            suffix = np.fromiter(chain.from_iterable(leaves), np.int64, n)
            times = np.fromiter(chain.from_iterable(map(dict.values, leaves)), np.int64, n)
            w = [np.repeat(np.array([word for word, _ in taken], np.int64), sizes)]
            w += [suffix >> k * WORD_BITS & _WORD_MASK for k in (2, 1, 0)]
            part = part_of(lang, hashes[w[0]], np.where(w[1] > 0, hashes[w[1]], np.uint64(0)), self.parts)
            upper = (part << 2 * WORD_BITS) | (rank[w[0]] << WORD_BITS) | rank[w[1]]
            lower = (rank[w[2]] << WORD_BITS) | rank[w[3]]
            order = np.lexsort((lower, upper)) if lower.any() else np.argsort(upper)
            part, times, w = part[order], times[order], [x[order] for x in w]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                for at in range(lo, hi, BLOCK):
                    end = min(at + BLOCK, hi)
                    phrases = map(names.__getitem__, w[0][at:end].tolist())
                    for x in w[1:]:
                        if x[at:end].any():
                            phrases = map(add, phrases, map(tails.__getitem__, x[at:end].tolist()))
                    phrases = list(phrases)
                    yield int(part[at]), lang, min(phrases), b"\n".join(phrases), times[at:end].astype("<i8").tobytes()


def _rows(blocks: Iterator[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    """Run blocks as Arrow batches of a few rows."""
    held: list[tuple] = []
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["part", "lang", "first", "phrases", "counts"])

    for b in blocks:
        held.append(b)
        if len(held) >= most:
            yield batch()
    if held:
        yield batch()


def count_runs(docs: DataFrame, orders: tuple[int, ...], parts: int, frequent: PairFilter | None = None) -> DataFrame:
    """Sorted runs of the phrases of ``docs(lang, text)``: the map side."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent) if frequent else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PhraseCounter(orders, parts, shared.value.passes if shared else None)

        def blocks() -> Iterator[tuple]:
            for whole in batches:
                for batch in batches_of(whole, "text", 8 << 20):
                    by: dict[str, list[str]] = defaultdict(list)
                    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                        by[lang].append(text)
                    for lang, texts in by.items():
                        yield from counter.add(lang, texts)
            yield from counter.flush()

        yield from _rows(blocks())

    return docs.mapInArrow(run, RUN)


def merge_runs(runs: DataFrame, parts: int, least: int) -> DataFrame:
    """(lang, phrase, n) of all phrases with n >= ``least``: the runs of each partition, merged in order.

    Blocks arrive sorted by their first phrase. Whatever lies before the first phrase of the
    block just read is complete, so only blocks that overlap are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        at, room = None, 200_000

        def done(lang: str, keys: list[bytes]) -> pa.RecordBatch:
            found = sorted(k for k in keys if held[k] >= least or not k)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array([held[k] for k in found], pa.int64())],
                ["lang", "phrase", "n"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["part"], row["lang"])
                if at is not None and here != at:
                    yield done(at[1], list(held))
                    held, room = {}, 200_000
                elif len(held) > room:
                    first = row["first"]
                    ready = [k for k in held if k < first]
                    yield done(here[1], ready)
                    for k in ready:
                        del held[k]
                    room = max(200_000, 2 * len(held))
                at = here
                counts = np.frombuffer(row["counts"], "<i8").tolist()
                get = held.get
                for phrase, n in zip(row["phrases"].split(b"\n"), counts, strict=True):
                    held[phrase] = get(phrase, 0) + n
        if at is not None:
            yield done(at[1], list(held))

    ordered = runs.repartition(parts, "part").sortWithinPartitions("part", "lang", "first")
    return ordered.mapInArrow(run, "lang string, phrase string, n long")


class PairFilter:
    """Bloom filter of word pairs by language, two probes each; hashes two words without joining them."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(max(1, bits // 8), np.uint8)

    def places(self, lang: str, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two bit numbers for each pair of word hashes."""
        with np.errstate(over="ignore"):
            h = left * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        mask = np.uint64(self.bits - 1)
        return h & mask, (h >> np.uint64(33)) & mask

    def passes(self, lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = np.ones(len(left), bool)
        for at in self.places(lang, left, right):
            found &= (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def pair_filter(pairs: DataFrame) -> PairFilter:
    """Filter of ``pairs(lang, phrase)``; executors fill its segments, the driver only puts them side by side."""
    wanted = max(1 << 16, pairs.count() * FILTER_BITS_EACH)
    found = PairFilter(min(FILTER_MAX_BITS, 1 << (wanted - 1).bit_length()))
    bits = found.bits

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = PairFilter(bits)
        for frame in batches:
            for lang, phrases in frame.groupby("lang")["phrase"]:
                both = [p.encode("utf-8", "surrogatepass").split(b" ") for p in phrases]
                left, right = (np.array([xxhash.xxh3_64_intdigest(b[k]) for b in both], np.uint64) for k in (0, 1))
                yield pd.DataFrame({"bit": np.concatenate(own.places(lang, left, right)).astype(np.int64)})

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        segment = np.zeros(FILTER_SEGMENT_BITS, np.uint8)
        segment[(rows["bit"] % FILTER_SEGMENT_BITS).to_numpy()] = 1
        packed = np.packbits(segment, bitorder="little").tobytes()
        return pd.DataFrame({"segment": [int(rows["bit"].iloc[0]) // FILTER_SEGMENT_BITS], "bits": [packed]})

    placed = pairs.select("lang", "phrase").mapInPandas(place, "bit long").distinct()
    segments = placed.groupBy(F.expr(f"bit div {FILTER_SEGMENT_BITS}").alias("segment")).applyInPandas(fill, "segment long, bits binary")
    for row in segments.toLocalIterator():
        lo = row["segment"] * FILTER_SEGMENT_BITS // 8
        part = np.frombuffer(row["bits"], np.uint8)[: len(found.words) - lo]
        found.words[lo : lo + len(part)] = part
    return found


def frequent_phrases(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, phrase, n) of all phrases of one to four words with n >= ``least``, read from a written table.

    The phrase "" holds the number of all word occurrences of the language.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    short = materialize(merge_runs(count_runs(source, (1, 2), parts), parts, least), "phrases-short")
    pairs = short.filter(F.contains("phrase", F.lit(" ")))
    long = materialize(merge_runs(count_runs(source, (3, 4), parts, pair_filter(pairs)), parts, least), "phrases-long")
    return short.unionByName(long)


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def score_phrases(counted: DataFrame, least: int = 30, share: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer candidate explains."""
    totals = counted.filter("phrase = ''").select("lang", F.col("n").alias("_total"))
    known = counted.filter("phrase <> ''")
    candidates = (
        known.filter((F.col("n") >= least) & F.contains("phrase", F.lit(" ")))
        .select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    )
    cuts = candidates.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w"
    ).select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("_left"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("_right"),
    )
    part = known.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    left = part.withColumnsRenamed({"_part": "_left", "_n": "l"})
    right = part.withColumnsRenamed({"_part": "_right", "_n": "r"})
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).withColumn(
        # exact: both operands are decimals, div keeps the integer part
        "score", F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    inside = (
        candidates.filter(F.size("w") > 2)
        .select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("_len"))
        .select("lang", "a", "w", "_len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("_len") + 1)).alias("_at"))
        .groupBy("lang", F.concat_ws(" ", F.slice("w", F.col("_at"), F.col("_len"))).alias("phrase"))
        .agg(F.max("a").alias("_longer"))
    )
    explained = (_wide("_longer") * 100) >= (_wide("a") * share)
    return (
        best.join(inside, ["lang", "phrase"], "left")
        .filter(F.col("_longer").isNull() | ~explained)
        .join(totals, "lang")
        .select("lang", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_total").alias("n"), F.col("_b.score").cast("long").alias("score"))
    )


def mine(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    ``docs`` has lang and text; other columns are ignored. A null text counts as empty, a null
    language as ``und``. Repeated rows count each time. A language without candidates, or an
    empty table, gives no rows. Ties in score go to the more frequent and then to the phrase
    that is smaller by bytes.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = score_phrases(frequent_phrases(docs, least), least, share).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
