"""Grouped prefix join of documents by the Jaccard similarity of their word n-grams.

Shingles are put in one global order, from rare to frequent. Two sets of sizes n and m with
similarity t share a shingle among the first  n - ceil(t n) + 1  of each (their prefixes).
Documents with one prefix and one size form a group; groups, not documents, meet in the
join, are filtered by size and by the position of the shared shingle, and only then are
their members expanded and verified on the whole sets. Before sets are fetched, bit fields
of a fixed size rule out most pairs that share a passage and little else.

The result is the connected components of the links. A link inside a component that is
already known adds nothing, so the join runs twice: first every member of a group, and
every group that holds a shingle, is verified against a leader of it (as many pairs as
rows); then, exactly, all remaining candidates between different components. A group of
thousands of near copies is joined by its leader and never expanded into its pairs. Members
of one group that the leader leaves in different components are joined by what follows the
prefix they have in common.

The order comes from a fixed number of counters: a shingle's frequency is that of its
hash bucket. Any total order gives the exact result; this one puts frequent passages last
and needs the same memory at every corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of
from lexfolio.session import materialize

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BUCKET_BITS = 21
CHUNKS = 64
PARITY_BITS = 1024


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Distinct shingle hashes of a text, ascending."""

    def __init__(self, width: int, most: int = 50_000):
        self.width, self.most, self.cache = width, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
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
        h = np.array(found, np.uint64)
        k = min(self.width, len(h))
        code = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            code = _mixed(code * _C + h[i : len(h) - k + 1 + i])
        return np.unique(code)


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def rarest(shingles: np.ndarray, counts: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Places ``start`` to ``stop`` of the shingles in the global order, rarest first."""
    rarity = (counts[bucket_of(shingles)].astype(np.uint64) << np.uint64(32)) | np.arange(len(shingles), dtype=np.uint64)
    return shingles[np.sort(np.partition(rarity, stop - 1)[:stop])[start:].astype(np.uint64) & np.uint64(2**32 - 1)]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits: whether an odd number of shingles falls on each.

    Where two such fields differ, one of the sets has a shingle that the other lacks, so the
    number of differing bits never exceeds the size of the symmetric difference.
    """
    odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bucket_counts(texts: DataFrame, width: int) -> np.ndarray:
    """In how many documents the shingles of each hash bucket occur: 2^BUCKET_BITS counters, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for whole in batches:
            for batch in batches_of(whole, "text", 8 << 20):
                sets = [shingles(t) for t in batch.column("text").to_pylist()]
                total += np.bincount(bucket_of(np.concatenate(sets)), minlength=len(total))
        if total.any():
            parts = [p.astype(np.uint32).tobytes() for p in np.split(total, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.uint32).astype(np.int64) for b in rows["counts"])
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "counts": [total.tobytes()]})

    summed = texts.select("text").mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    out = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.int64)
    for r in summed.collect():  # 64 rows of a fixed size
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, n, set_a, set_b (key of the whole set), prefix_key, parity, prefix (shingles, rarest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shingles = shared.value, Shingles(width)
        for whole in batches:
            for batch in batches_of(whole, "text", 8 << 20):
                rows = []
                for text in batch.column("text").to_pylist():
                    s = shingles(text)
                    n = len(s)
                    if not n:
                        rows.append((0, 0, 0, 0, s, parity(s)))
                        continue
                    key = xxhash.xxh3_128_intdigest(s.tobytes())
                    p = rarest(s, counts, 0, prefix_size(n, percent))
                    rows.append((n, key >> 64, key & (2**64 - 1), xxhash.xxh3_64_intdigest(p.tobytes()), p, parity(s)))
                signed = [pa.array(np.array([r[i] for r in rows], np.uint64).view(np.int64)) for i in range(4)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(r[4]) for r in rows]))), pa.int32()),
                    pa.array(np.concatenate([r[4] for r in rows]).view(np.int64)),
                )
                words = PARITY_BITS // 64
                fields = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(rows) + 1) * words, pa.int32()), pa.array(np.concatenate([r[5] for r in rows] or [np.empty(0, np.int64)]))
                )
                names = ["doc_id", "n", "set_a", "set_b", "prefix_key", "parity", "prefix"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *signed, fields, lists], names)

    return docs.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, prefix_key long, parity array<long>, prefix array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, width: int, filter_bits: int = 22) -> DataFrame:
    """set_a, set_b, shingles of the documents in ``ids`` and of a few others.

    A bit field of fixed size over hashed ids spares most documents the work. Those that pass
    it by chance stay: whoever joins by the set key does not meet them, and nothing is shuffled.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << filter_bits)).cast("int")
    field = np.zeros((1 << filter_bits) // 8, np.uint8)
    words = ids.select(bucket.alias("b")).groupBy(F.expr("b div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 32))")).alias("bits"))
    for r in words.toLocalIterator():  # at most 2^filter_bits / 32 rows
        field[4 * r["word"] : 4 * r["word"] + 4] |= np.array([r["bits"]], "<u4").view(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, shingles = shared.value, Shingles(width)
        for whole in batches:
            b = whole.column("b").to_numpy()
            wanted = whole.filter(pa.array((field[b >> 3] >> (b & 7)) & 1 == 1))
            del whole, b
            for batch in batches_of(wanted, "text", 1 << 20):
                sets = [shingles(t) for t in batch.column("text").to_pylist()]
                keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                halves = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in ([x >> 64 for x in keys], [x & (2**64 - 1) for x in keys])]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([*halves, lists], ["set_a", "set_b", "shingles"])
                del batch, sets, keys, halves, lists
            # the next batch comes when this one is gone, and what it took goes back to the machine
            del wanted
            pa.default_memory_pool().release_unused()

    return docs.select("text", bucket.alias("b")).mapInArrow(run, "set_a long, set_b long, shingles array<long>")


def inner_pairs(docs: DataFrame, split: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Candidates (a, b) inside one group, between different components; no link is lost.

    ``split``: rep, group, component, set_a, set_b. Members have their prefix and their size in
    common. Of the n shingles a link needs  k = ceil(2 percent n / (100 + percent)), so linked members
    share one of the first  n - k + 1  beyond the prefix. Where k is within the prefix, the leader
    has linked all members already.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            column = batch.column("shingles")
            more = []
            for i in range(len(column)):
                s = column[i].values.to_numpy().view(np.uint64)
                n = len(s)
                first, extra = prefix_size(n, percent), n - -(-2 * percent * n // (100 + percent)) + 1
                more.append(rarest(s, counts, first, min(n, first + extra)) if n else s)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(m) for m in more]))), pa.int32()),
                pa.array(np.concatenate([*more, np.empty(0, np.uint64)]).view(np.int64)),
            )
            yield pa.RecordBatch.from_arrays([batch.column("set_a"), batch.column("set_b"), lists], ["set_a", "set_b", "more"])

    sets = sets_of(docs, split.select(F.col("rep").alias("doc_id")), width)
    beyond = sets.mapInArrow(run, "set_a long, set_b long, more array<long>")
    held = split.join(beyond, ["set_a", "set_b"]).dropDuplicates(["rep"]).select("rep", "group", "component", F.explode("more").alias("shingle"))
    token = Window.partitionBy("group", "shingle")
    mixed = held.withColumn("mixed", F.min("component").over(token) != F.max("component").over(token)).filter("mixed").drop("mixed")
    mixed = materialize(mixed, "inner")
    a = mixed.select("group", "shingle", F.col("rep").alias("a"), F.col("component").alias("c_a"))
    b = mixed.select("group", "shingle", F.col("rep").alias("b"), F.col("component").alias("c_b"))
    return a.join(b, ["group", "shingle"]).filter("c_a < c_b").select("a", "b").distinct()


def not_apart(pairs: DataFrame, known: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives that their parity fields do not rule out; no link is lost."""
    own = kinds.select(F.col("rep").alias("doc_id"), "set_a", "set_b").join(_ends(pairs), "doc_id")
    fields = materialize(
        known.select("doc_id", "set_a", "set_b", "n", "parity").join(own, ["doc_id", "set_a", "set_b"]).dropDuplicates(["doc_id"]).select("doc_id", "n", "parity"),
        "parities",
    )
    of_a = fields.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("f_a"))
    of_b = fields.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("f_b"))
    differing = F.aggregate(F.zip_with("f_a", "f_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, v: total + v)
    return pairs.join(of_a, "a").join(of_b, "b").filter((100 + percent) * differing <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; ``keys``: set key of each representative."""
    left = sets.select(F.col("set_a").alias("x_a"), F.col("set_b").alias("y_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("set_a").alias("x_b"), F.col("set_b").alias("y_b"), F.col("shingles").alias("s_b"))
    of_a = keys.select(F.col("rep").alias("a"), F.col("set_a").alias("x_a"), F.col("set_b").alias("y_a"))
    of_b = keys.select(F.col("rep").alias("b"), F.col("set_a").alias("x_b"), F.col("set_b").alias("y_b"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(of_a, "a").join(of_b, "b").join(left, ["x_a", "y_a"]).join(right, ["x_b", "y_b"]).filter(100 * common >= percent * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def components(edges: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, component_id) of every node of (a, b): the smallest id it reaches.

    Each round takes the smallest label among the neighbours, then the label of that label,
    until nothing changes; every round is a table in the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        done = materialize(jumped, "labels")
        labels = done.select("node", "label")
        if done.filter("old != label").isEmpty():
            return labels.select(F.col("node").alias(id_), F.col("label").alias("component_id"))


def _needed(n_a: Column, n_b: Column, overlap: Column, percent: int) -> Column:
    """overlap / union >= percent / 100, for an overlap of sets of the two sizes."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each distinct doc_id.

    Rows without a doc_id are left out. Of rows that share one, the one with the most
    shingles (then the smallest set key) speaks for it. A document without words has no
    shingles and is its own component; one with fewer than ``width`` words has one shingle.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = bucket_counts(rows, width)
    known = materialize(prefixes(rows, counts, width, percent), "prefixes")
    spoken = F.max(F.struct("n", (-F.col("set_a")).alias("x"), "set_a", "set_b", "prefix_key")).alias("s")
    small = materialize(known.groupBy("doc_id").agg(spoken).select("doc_id", "s.n", "s.set_a", "s.set_b", "s.prefix_key"), "documents")
    # copies: one representative for each set; groups: one leader for each prefix and size
    kinds = materialize(small.filter("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep"), F.min("prefix_key").alias("prefix_key")), "sets")
    heads = kinds.groupBy("prefix_key", "n").agg(F.min("rep").alias("group"))
    members = materialize(kinds.join(heads, ["prefix_key", "n"]).select("rep", "group", "n", "set_a", "set_b"), "groups")

    leaders = members.filter("rep = group").select(F.col("group").alias("doc_id"), "set_a", "set_b")
    posted = (
        known.join(leaders, ["doc_id", "set_a", "set_b"])
        .dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("group"), "n", F.posexplode("prefix").alias("at", "shingle"))
        .select("shingle", "group", (F.col("n") * F.lit(1 << 31) + F.col("at")).alias("place"))
    )
    token = Window.partitionBy("shingle")
    ends = posted.select("*", F.min("group").over(token).alias("low"), F.max("group").over(token).alias("high")).filter("low != high")
    n, at = F.expr("int(place div 2147483648)"), F.expr("int(place % 2147483648)")
    shared = materialize(ends.select("shingle", "group", n.alias("n"), at.alias("at"), "low", "high"), "postings")

    near = shared.select(F.col("group").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter("a != b")
    sizes = members.filter("rep = group")
    sized = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sized = sized.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("n_b")), "b")
    sized = sized.filter(_needed(F.col("n_a"), F.col("n_b"), F.least("n_a", "n_b"), percent)).select("a", "b")
    first = materialize(sized.union(members.filter("rep != group").select(F.col("group").alias("a"), F.col("rep").alias("b"))), "candidates")
    first = materialize(not_apart(first, known, kinds, percent), "candidates")
    sets = materialize(sets_of(rows, _ends(first), width), "shingles")
    links = materialize(linked(first, sets, kinds, percent), "links")
    found = components(links)

    # exact: every candidate between components that are still apart, of two groups or of one
    placed = members.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "rep", "group", F.coalesce("component_id", "rep").alias("component"), "set_a", "set_b"
    )
    parts = placed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    split = materialize(placed.join(parts.select("group"), "group", "left_semi"), "split")
    apart = shared.select("shingle", "group", "n", "at").join(placed.select("group", "component").distinct(), "group")
    token_parts = F.min("component").over(token) != F.max("component").over(token)
    apart = materialize(apart.withColumn("mixed", token_parts).filter("mixed").drop("mixed"), "apart")
    a = apart.select("shingle", F.col("group").alias("g_a"), F.col("n").alias("n_a"), F.col("at").alias("p_a"), F.col("component").alias("c_a"))
    b = apart.select("shingle", F.col("group").alias("g_b"), F.col("n").alias("n_b"), F.col("at").alias("p_b"), F.col("component").alias("c_b"))
    most = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    fits = (F.col("g_a") != F.col("g_b")) & (F.col("c_a") < F.col("c_b")) & _needed(F.col("n_a"), F.col("n_b"), most, percent)
    group_pairs = a.join(b, "shingle").filter(fits).select("g_a", "g_b", "c_a", "c_b").distinct()
    of_a = placed.select(F.col("group").alias("g_a"), F.col("component").alias("c_a"), F.col("rep").alias("a"))
    of_b = placed.select(F.col("group").alias("g_b"), F.col("component").alias("c_b"), F.col("rep").alias("b"))
    second = group_pairs.join(of_a, ["g_a", "c_a"]).join(of_b, ["g_b", "c_b"]).select("a", "b").distinct()
    if not split.isEmpty():
        second = second.union(inner_pairs(rows, split, counts, width, percent)).distinct()
    second = materialize(second, "candidates")
    second = materialize(not_apart(second, known, kinds, percent), "candidates")
    more = linked(second, materialize(sets_of(rows, _ends(second), width), "shingles"), kinds, percent)
    total = components(links.union(materialize(more, "links")))

    by_set = kinds.join(total.withColumnRenamed("doc_id", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return small.join(by_set, ["set_a", "set_b", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
