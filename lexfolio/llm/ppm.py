"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts: how often each byte followed each
context of 0 to 3 bytes in the learning texts. A byte that its context has never seen costs
the escape probability (distinct / (total + distinct) of the context) and is then coded one
context shorter, down to uniform bytes. The code length of a text under each frozen tree is
exact; the shortest names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of, id_remainder
from lexfolio.session import materialize

ORDERS = (1, 2, 3, 4)  # lengths of the counted byte strings: context and next byte
#: Unlike lengths must not share codes: each string is written after its length.
_LETTER = regex.compile(r"\p{L}")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def strings_of(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of the n-byte strings that end at each byte from n-1 on (data: unsigned bytes)."""
    code = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for k in range(n):
        code = (code << np.uint64(8)) | data[k : len(data) - n + 1 + k]
    return code


def count_strings(texts: DataFrame, least: int, most_nodes: int) -> DataFrame:
    """lang, n, code, count over whole texts; strings seen under ``least`` times grow no branch.

    Counts are summed per task first, then by key, so that no language is gathered anywhere.
    At most ``most_nodes`` strings a language stay, the most frequent: the tree has a bounded
    size and rarer strings are coded through escapes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, pieces: list[bytes]) -> None:
            # a line feed between texts; strings across it only see one more byte
            code = strings_of(np.frombuffer(b"\n\n\n" + b"\n\n\n".join(pieces), np.uint8), 4).astype(np.uint32)
            keys, counts = np.unique(code, return_counts=True)
            if lang in sums:
                keys, at = np.unique(np.concatenate((sums[lang][0], keys)), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate((sums[lang][1], counts))).astype(np.int64)
            sums[lang] = keys, counts

        for whole in batches:
            for batch in batches_of(whole, "text", 8 << 20):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text.encode())
                for lang, pieces in by.items():
                    add(lang, pieces)
        for lang, (keys, counts) in sums.items():
            for a in range(0, len(keys), 200_000):
                k = keys[a : a + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(counts[a : a + 200_000].astype(np.int64))], ["lang", "code", "n"]
                )

    summed = texts.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return summed.filter(F.col("n") >= least).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most_nodes)


class Lookup:
    """Rows by code: open addressing in a table at most half full, probed for whole arrays."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.codes = codes
        left = np.arange(len(codes))
        step = 0
        while len(left):
            at = self._at(codes[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1
        self.steps = step

    def _at(self, codes: np.ndarray, step: int) -> np.ndarray:
        return (((codes * _MULTIPLY) >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 if unknown."""
        row = self.slots[self._at(codes, 0)]
        known = len(self.codes)
        if not known:
            return np.full(len(codes), -1, np.int32)
        out = np.where((row >= 0) & (self.codes[row] == codes), row, -1)
        open_ = np.flatnonzero((row >= 0) & (out < 0))
        for step in range(1, self.steps):
            if not len(open_):
                break
            row = self.slots[self._at(codes[open_], step)]
            hit = (row >= 0) & (self.codes[row] == codes[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[(row >= 0) & ~hit]
        return out


@dataclass
class ContextTrees:
    """Frozen statistics of all languages side by side.

    cost[n]: bits of the last byte of each known n-byte string, per language, escapes
    included. escape[n]: bits of an escape from each known n-byte context, per language.
    """

    languages: list[str]
    cost: list
    escape: list
    codes: list

    @classmethod
    def build(cls, languages: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray) -> ContextTrees:
        m = len(languages)
        cost, escape, codes = [np.full((1, m), 8.0, np.float32)], [], [np.zeros(1, np.uint64)]
        for n in ORDERS:
            mask = np.uint64(256**n - 1)
            own, at = np.unique(code.astype(np.uint64) & mask, return_inverse=True)
            seen = np.zeros((len(own), m))
            np.add.at(seen, (at, lang), count)
            contexts, up = np.unique(own >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), m)), np.zeros((len(contexts), m))
            np.add.at(total, up, seen)
            np.add.at(kinds, up, seen > 0)
            # a context that a language lacks escapes for nothing
            out = np.where(total > 0, -np.log2(np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)), 0)
            lower = cost[n - 1][np.searchsorted(codes[n - 1], own & np.uint64(256 ** (n - 1) - 1))] if n > 1 else np.full((len(own), m), 8.0)
            direct = -np.log2(np.where(seen > 0, seen / np.maximum(total + kinds, 1)[up], 1))
            cost.append(np.where(seen > 0, direct, out[up] + lower).astype(np.float32))
            escape.append((contexts, out.astype(np.float32)))
            codes.append(own)
        return cls(languages, cost, escape, codes)

    def prepare(self) -> None:
        self.find = [Lookup(c) for c in self.codes]
        self.find_context = [Lookup(c) for c, _ in self.escape]

    def bits(self, code: np.ndarray, n: int = 4) -> np.ndarray:
        """Bits of the last byte of each n-byte string, per language."""
        if n == 0:
            return np.full((len(code), len(self.languages)), 8.0, np.float32)
        row = self.find[n].find(code)
        out = self.cost[n][row]
        new = np.flatnonzero(row < 0)
        if len(new):
            context = self.find_context[n - 1].find(code[new] >> np.uint64(8))
            left = np.where(context[:, None] >= 0, self.escape[n - 1][1][context], 0)
            out[new] = left + self.bits(code[new] & np.uint64(256 ** (n - 1) - 1), n - 1)
        return out


def train(texts: DataFrame, least: int = 2, most_nodes: int = 400_000) -> ContextTrees:
    """Trees from lang and text (neither null). The statistics that reach the driver have a bounded size."""
    rows = materialize(count_strings(texts, least, most_nodes).select("lang", "code", "n"), "ppm-counts")
    languages = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    frame = rows.toPandas()
    return ContextTrees.build(
        languages, frame["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), frame["code"].to_numpy(np.int64), frame["n"].to_numpy(np.float64)
    )


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte; only ``text`` is looked at.

    Null texts, texts without a letter, and all texts where nothing was learned: und, score 0.
    score is the language's share of the texts' probabilities; equal lengths go to the first name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        trees.prepare()
        names = np.array([*trees.languages, "und"], object)
        m = len(trees.languages)
        for whole in batches:
            for batch in batches_of(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                pieces = [b"\n\n\n" + t.encode() if t and _LETTER.search(t) else b"" for t in texts]
                size = np.array([max(0, len(p) - 3) for p in pieces])
                total = np.zeros((len(pieces), m))
                if m and size.any():
                    code = strings_of(np.frombuffer(b"".join(pieces), np.uint8), 4)
                    begin = np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1]))
                    bits = trees.bits(code)
                    filled = np.flatnonzero(size)
                    # strings that begin before a text's own three line feeds lie between the cuts
                    cuts = np.stack((begin[filled], begin[filled] + size[filled]), axis=1).ravel()
                    if cuts[-1] >= len(bits):
                        cuts = cuts[:-1]
                    total[filled] = np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)[::2]
                choice = np.where(size > 0, total.argmin(axis=1) if m else m, m)
                share = np.exp2(np.maximum(total.min(axis=1, keepdims=True) - total, -1000)).sum(axis=1) if m else np.ones(len(pieces))
                score = np.where(choice < m, 1 / share, 0.0)
                rate = np.where(choice < m, total.min(axis=1) / np.maximum(size, 1), 8.0) if m else np.full(len(pieces), 8.0)
                columns = {c: batch.column(c) for c in batch.schema.names if c != "text" or keep_text}
                columns |= {"lang_pred": pa.array(names[choice]), "score": pa.array(score), "bits_per_byte": pa.array(rate)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    keep_text = "text" in docs.columns[:-1] or docs.columns[-1] != "text"
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text" or keep_text)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, bits_per_byte double")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter((id_remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text"
    )


def identify(docs: DataFrame) -> DataFrame:
    """The digest over documents: doc_id, held_out, lang_pred, score, bits_per_byte."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, train(learning_rows(docs)))
