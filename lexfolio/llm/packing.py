"""Packing of tokenised documents into fixed-length sequences.

Method: first-fit decreasing in randomised groups of documents. In each group the pieces
are placed, longest first, into the leftmost sequence that still has room; a tournament
tree over the free room of the sequences finds it in logarithmic time. Groups are drawn by
a hash, so that they are alike in content, independent and bounded in size, whatever the
table holds.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of

#: Characters that the whitespace rules of the tokenizer treat alike in every library.
_PLAIN_CHUNK = regex.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
_ODD_SPACE = regex.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
)


class ByteBpe:
    """Encoder of a public byte-level BPE vocabulary with a bounded cache of words.

    White space followed by a word begins a new unit of the vocabulary's own split, so a
    text is encoded word by word; a word met before costs one dictionary lookup. ``ranks``
    is the vocabulary as ranks, ``pattern`` its split pattern, ``full`` the tokenizer file,
    which encodes texts with unusual white space whole.
    """

    def __init__(self, ranks: str, pattern: str, full: str, cache_words: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(full)
        self.full.encode_special_tokens = True

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.cache_words = cache_words
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def _cached(self, cache: dict[str, bytes], words: list[str], lead: str) -> bytes:
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            if len(cache) > self.cache_words:
                cache.clear()
            for word in words:
                if word not in cache:
                    cache[word] = self._ids(lead + word)
            return b"".join(map(cache.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self._cached(self.first, _PLAIN_CHUNK.findall(text), "")
        words = text.split(" ")
        return self._cached(self.first, words[:1], "") + self._cached(self.inner, words[1:], " ")


def public_byte_bpe() -> tuple[str, str, str]:
    """Ranks, split pattern and file of ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


class FreeRoom:
    """Tournament tree over sequences: each inner node holds the most free room below it."""

    def __init__(self, sequences: int, length: int):
        self.leaves = 1 << max(0, (sequences - 1).bit_length())
        self.tree = [length] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Take ``need`` from the leftmost sequence with that much room; its number."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        at = node - self.leaves
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return at


def first_fit_decreasing(sizes: list[int], length: int) -> list[int]:
    """Sequence number of each size (all between 1 and ``length``), given in decreasing order."""
    room = FreeRoom(max(1, len(sizes)), length)
    return [room.place(n) for n in sizes]


def plan_group(totals: list[int], length: int, min_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of one group as lists of (document, start, length).

    Whole sequences are cut from documents longer than one; what is left of each document
    is placed first-fit decreasing. Then the emptiest sequences are taken apart to fill gaps
    of ``min_cut`` tokens or more elsewhere, so that about one sequence of a group is short.
    """
    bins: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(totals):
        full = n // length
        bins.extend([(d, k * length, length)] for k in range(full))
        if n % length:
            rest.append((n % length, d, full * length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    placed = first_fit_decreasing([r[0] for r in rest], length)
    open_bins: list[list[tuple[int, int, int]]] = [[] for _ in range(max(placed, default=-1) + 1)]
    for b, (n, d, start) in zip(placed, rest, strict=True):
        open_bins[b].append((d, start, n))
    fill = [sum(p[2] for p in b) for b in open_bins]
    order = sorted(range(len(open_bins)), key=lambda b: (-fill[b], b))
    low = len(order) - 1
    for at, b in enumerate(order):
        gap = length - fill[b]
        if gap < min_cut or fill[b] & (fill[b] - 1) == 0:
            continue
        while gap and low > at:
            donor = order[low]
            if not open_bins[donor]:
                low -= 1
                continue
            d, start, n = open_bins[donor].pop()
            take = min(gap, n)
            open_bins[b].append((d, start, take))
            if take < n:
                open_bins[donor].append((d, start + take, n - take))
            gap -= take
            fill[b] += take
            fill[donor] -= take
    return bins + [b for b in open_bins if b]


def tokenize(docs: DataFrame, end_id: int = 0) -> DataFrame:
    """(doc_id, group_key, ids): ids as little-endian 32-bit integers, closed by ``end_id``."""
    vocabulary = public_byte_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in batches_of(whole, "text", 16 << 20):
                texts = batch.column("text").to_pylist()
                # two bytes an id are enough for a vocabulary under 65,536 and halve the shuffle
                ids = [np.frombuffer(bpe.encode(t or "") + end, "<u4").astype("<u2").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("group_key"), pa.array(ids, pa.binary())], ["doc_id", "group_key", "ids"]
                )

    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("group_key"))
    return source.mapInArrow(run, "doc_id long, group_key long, ids binary")


def pack(docs: DataFrame, length: int = 1024, docs_per_group: int = 1024, min_cut: int = 32) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is the end
    id alone. Each row is a document of its own, repeated rows included. An empty table
    gives no pieces. A sequence is padded to ``length`` unless its size is a power of two;
    ``padded_length`` says to what. The number of rows only sets the number of groups.
    """
    groups = max(1, -(-docs.count() // docs_per_group))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["pack_group"].iloc[0])
        rows = rows.sort_values(["group_key", "doc_id"], kind="stable")
        ids = [np.frombuffer(b, "<u2").astype("<u4") for b in rows["ids"]]
        doc_ids = rows["doc_id"].tolist()
        out = []
        for s, pieces in enumerate(plan_group([len(x) for x in ids], length, min_cut)):
            size = sum(p[2] for p in pieces)
            padded = size if size & (size - 1) == 0 else length
            offset = 0
            for d, start, n in pieces:
                crc = zlib.crc32(ids[d][start : start + n].tobytes())
                out.append((doc_ids[d], start, n, crc, len(ids[d]), (group << 32) + s, offset, padded))
                offset += n
        names = [c.split()[0] for c in PIECES.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")  # a null id stays null
        return frame

    tokens = tokenize(docs).withColumn("pack_group", F.pmod(F.xxhash64("group_key"), F.lit(groups)))
    return tokens.groupBy("pack_group").applyInPandas(run, PIECES)
