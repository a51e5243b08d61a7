"""Byte-level BPE of whole tables, with passages that texts share encoded once.

Method: content-defined chunk reuse. A rolling hash over 32 bytes cuts every text where its
content says so, hence a passage is cut alike in all texts that hold it. Chunks that occur
at several places are encoded once, in the task of the text that owns their first place, and
their ids are joined to the other places. A text is then put together: the stretches between
reused chunks are encoded in place, and around each chunk join a window is encoded anew. It
ends at places where a unit of the tokenizer's split ends whatever stands around them, and it
grows until its ids agree with those of the chunk on both sides; a chunk without such
agreement is encoded with its surroundings.

Texts travel once, compressed, to meet the ids of their chunks; equal texts travel once a
task and are encoded once. Texts that own chunks travel once more to their encoding; a Bloom
filter of bounded size keeps the others back, and what it lets through by chance is dropped by
the join. Everything else that is shuffled is chunk keys and reused ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of, collect_bits, filter_bits, has_bits
from lexfolio.llm.packing import ByteBpe, public_byte_bpe
from lexfolio.session import materialize

#: A chunk has 2^10 bytes on average, at least 256 and at most 8,192.
CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST = 10, 256, 8_192
#: Text keys that a task remembers to send equal texts once.
REMEMBERED = 200_000
#: Bytes of text handled at once in a task.
SLICE_BYTES = 4 << 20
#: Words whose ids a task keeps.
CACHED_WORDS = 100_000

#: A letter or digit followed by a character that is neither: the tokenizer's split always
#: ends a unit here. Both sides are classes that no version of Unicode has changed.
_BOUNDARY = re.compile(
    rb"(?:(?<=[A-Za-z0-9])|(?<=\xc3[\xa0-\xb6\xb8-\xbf])|(?<=\xd0[\x90-\xbf])|(?<=\xd1[\x80-\x8f])|(?<=[\xe5-\xe8][\x80-\xbf][\x80-\xbf]))"
    rb"(?=[ \n.,;:!?()\"]|\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9a\x9b\x9f])"
)

_GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b])) & 0xFFFFFFFF for b in range(256)], np.uint32)


def cut_places(data: bytes) -> np.ndarray:
    """Places (ascending) before which the rolling hash of the 32 bytes before them asks for a cut."""
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    at = at[at < len(raw)]
    return at[raw[at] & 0xC0 != 0x80]  # only where a character begins


def chunk_ranges(data: bytes, start: int, stop: int, cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Chunks of the bytes start to stop; ``cuts`` are the places inside that the hash asks for."""
    at = start
    for cut in [*cuts, stop]:
        if cut - at < CHUNK_LEAST and cut != stop:
            continue
        while cut - at > CHUNK_MOST:
            end = at + CHUNK_MOST
            while data[end] & 0xC0 == 0x80:
                end -= 1
            yield at, end
            at = end
        if cut > at:
            yield at, cut
            at = cut


def sections(data: bytes, special: bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """Stretches between occurrences of a special token's text; with n occurrences there are n + 1."""
    stop = len(data) if stop is None else stop
    while special and 0 <= (found := data.find(special, start, stop)):
        yield start, found
        start = found + len(special)
    yield start, stop


class WordBpe(ByteBpe):
    """The encoder of words; the library's own tokenizer is loaded when a text with unusual white space needs it."""

    def __init__(self, ranks: str, pattern: str, full: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.cache_words = CACHED_WORDS
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self._file = full

    @cached_property
    def full(self):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self._file)
        whole.encode_special_tokens = True
        return whole


class Pieces:
    """The bytes of every id of a vocabulary given as ranks, special token included."""

    def __init__(self, ranks: str, special: tuple[str, int]):
        self.special, self.special_id = special[0].encode(), np.array([special[1]], "<u4").tobytes()
        with open(ranks, "rb") as lines:
            pieces = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
        self.pieces = [pieces.get(i, b"") for i in range(max(max(pieces), special[1]) + 1)]
        self.pieces[special[1]] = self.special

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


class ChunkEncoder(Pieces):
    """Encodes texts with the ids of some of their chunks given.

    ``special`` is the (text, id) of the token that the library recognises inside texts.
    """

    def __init__(self, vocabulary: tuple[str, str, str], special: tuple[str, int] = ("<|endoftext|>", 50256)):
        super().__init__(vocabulary[0], special)
        self.bpe = WordBpe(*vocabulary)
        self.lengths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        #: windows around joins that were encoded, and how many grew
        self.windows = self.grown = 0

    def encode(self, data: bytes) -> bytes:
        """Ids (little-endian unsigned 32-bit) of a stretch without special tokens."""
        return self.bpe.encode(data.decode("utf-8")) if data else b""

    def _reuse(self, data: bytes, at: int, begin: int, end: int, start: int, stop: int, ids: np.ndarray) -> tuple[list[bytes], int] | None:
        """Ids from ``at`` to a place inside the chunk start..stop of the section begin..end, and that place.

        The last unit of the chunk is left to the next window. None if the chunk can't be used.
        """
        chunk = data[start:stop]
        marks = [m.start() for m in _BOUNDARY.finditer(chunk) if m.start()]
        if start == begin:
            marks.insert(0, 0)
        if stop == end:
            marks.append(stop - start)
        if len(marks) < 3:
            return None
        ends = np.r_[0, np.cumsum(self.lengths[ids])]
        inner = np.searchsorted(ends, marks)
        if not np.array_equal(ends[inner], marks):
            return None
        raw = ids.astype("<u4").tobytes()
        out = []
        # the window begins at the last sure place before the chunk
        left = at
        if start > at:
            before = [m.start() for m in _BOUNDARY.finditer(data[max(at, start - 512) : start])]
            left = max(at, start - 512) + before[-1] if before else at
            out.append(self.encode(data[at:left]))
        last = len(marks) - 1
        for k in range(last):
            window = self.encode(data[left : start + marks[k + 1]])
            agreed = raw[4 * inner[k] : 4 * inner[k + 1]]
            self.windows += 1
            if window.endswith(agreed) and int(self.lengths[np.frombuffer(window[: len(window) - len(agreed)], "<u4")].sum()) == start + marks[k] - left:
                out += [window, raw[4 * inner[k + 1] : 4 * inner[last]]]
                return out, start + marks[last]
            self.grown += 1
        return None

    def assemble(self, data: bytes, known: list[tuple[int, int, bytes]], kind: str) -> np.ndarray:
        """Ids of a whole text; ``known`` holds (start, stop, ids) of reused chunks in ascending order."""
        out: list[bytes] = []
        waiting = iter(known)
        following = next(waiting, None)
        for n, (begin, end) in enumerate(sections(data, self.special)):
            if n:
                out.append(self.special_id)
            at = begin
            while following and following[1] <= end:
                start, stop, packed = following
                following = next(waiting, None)
                if start >= at and (found := self._reuse(data, at, begin, end, start, stop, np.frombuffer(packed, kind))):
                    out += found[0]
                    at = found[1]
            out.append(self.encode(data[at:end]))
        return np.frombuffer(b"".join(out), "<u4")


def _id_kind(vocabulary_size: int) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(text_key, text): a null text is empty, the key its SHA-256."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))


def _distinct_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded size, with rows dropped whose text the task has sent before."""
    seen: set[bytes] = set()
    for whole in batches:
        for batch in batches_of(whole, "text", SLICE_BYTES):
            fresh = []
            for i, key in enumerate(batch.column("text_key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            if fresh:
                yield batch.take(pa.array(fresh))


def chunk_places(keyed: DataFrame, special: str = "<|endoftext|>") -> DataFrame:
    """(chunk_key, text_key, start, stop) of all chunks of distinct texts."""
    mark = special.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _distinct_slices(batches):
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            keys = batch.column("text_key").to_pylist()
            joined = b"".join(texts)
            cuts = cut_places(joined) if joined else np.zeros(0, int)
            chunk_key, text_key, starts, stops = [], [], [], []
            base = 0
            for key, data in zip(keys, texts, strict=True):
                # the first cut is at least CHUNK_LEAST in, so the hash never reaches into the text before
                for begin, end in sections(data, mark):
                    lo, hi = np.searchsorted(cuts, [base + begin + CHUNK_LEAST, base + end])
                    for start, stop in chunk_ranges(data, begin, end, (cuts[lo:hi] - base).tolist()):
                        chunk_key.append(xxhash.xxh3_128_digest(data[start:stop]))
                        text_key.append(key)
                        starts.append(start)
                        stops.append(stop)
                base += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk_key, pa.binary()), pa.array(text_key, pa.binary()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
                ["chunk_key", "text_key", "start", "stop"],
            )

    return keyed.mapInArrow(run, "chunk_key binary, text_key binary, start int, stop int").distinct()


def _key_bits(keys: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filter places of each text key; the keys are hashes already."""
    words = np.frombuffer(b"".join(k[:16] for k in keys), "<u8").reshape(-1, 2) & np.uint64(bits - 1)
    return words[:, 0], words[:, 1]


def _packed(keyed: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(text_key, packed): distinct texts, compressed, dealt out by key.

    With ``only(text_key)`` those alone, and what its filter takes for them.
    """
    bits, shared = 0, None
    if only is not None:
        bits = filter_bits(only.count())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = np.concatenate(_key_bits(batch.column(0).to_pylist(), bits))
                yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int64))], ["bit"])

        table = collect_bits(only.select("text_key").mapInArrow(place, "bit long"), bits)
        shared = keyed.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in _distinct_slices(batches):
            if shared is not None:
                one, two = _key_bits(batch.column("text_key").to_pylist(), bits)
                batch = batch.filter(pa.array(has_bits(shared.value, one) & has_bits(shared.value, two)))
            packed = [press.compress(t.as_buffer().to_pybytes()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(packed, pa.binary())], ["text_key", "packed"])

    return keyed.mapInArrow(run, "text_key binary, packed binary").repartition("text_key").dropDuplicates(["text_key"])


def encode_texts(
    docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, special: tuple[str, int] = ("<|endoftext|>", 50256), decoded: bool = False
) -> DataFrame:
    """(text_key, ids array<int>), one row for each distinct text of ``docs(text)``; with ``decoded`` also the text that the ids give."""
    vocabulary = vocabulary or public_byte_bpe()
    kind = _id_kind(special[1] + 1)
    keyed = keyed_texts(docs)
    places = materialize(chunk_places(keyed, special[0]), "bpe-chunks")
    repeated = places.groupBy("chunk_key").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "start", "stop")).alias("o")).filter("n > 1")
    owned = materialize(
        repeated.groupBy(F.col("o.text_key").alias("text_key")).agg(F.collect_list(F.struct("chunk_key", "o.start", "o.stop")).alias("own")), "bpe-owned"
    )

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpack = ChunkEncoder(vocabulary, special), zstandard.ZstdDecompressor()
        for batch in batches:
            for one in range(batch.num_rows):
                data = unpack.decompress(batch.column("packed")[one].as_py())
                own = batch.column("own")[one].as_py()
                ids = [np.frombuffer(encoder.encode(data[c["start"] : c["stop"]]), "<u4").astype(kind).tobytes() for c in own]
                yield pa.RecordBatch.from_arrays([pa.array([c["chunk_key"] for c in own], pa.binary()), pa.array(ids, pa.binary())], ["chunk_key", "ids"])

    encoded = _packed(keyed, owned).join(owned, "text_key").mapInArrow(encode_owned, "chunk_key binary, ids binary")
    known = places.join(encoded, "chunk_key").groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "ids"))).alias("known"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpack = ChunkEncoder(vocabulary, special), zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in batches_of(whole, "packed", SLICE_BYTES // 4):
                found = []
                for packed, known in zip(batch.column("packed"), batch.column("known"), strict=True):
                    chunks = [(c["start"], c["stop"], c["ids"]) for c in known.as_py() or ()]
                    found.append(encoder.assemble(unpack.decompress(packed.as_py()), chunks, kind))
                offsets = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                flat = pa.array(np.concatenate(found).astype(np.int32))
                columns, names = [batch.column("text_key"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["text_key", "ids"]
                if decoded:
                    columns, names = [*columns, pa.array([encoder.decode(x) for x in found], pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "text_key binary, ids array<int>" + ", text string" * decoded
    return _packed(keyed).join(known, "text_key", "left").mapInArrow(assemble, schema)


def decode_texts(encoded: DataFrame, vocabulary: tuple[str, str, str] | None = None, special: tuple[str, int] = ("<|endoftext|>", 50256)) -> DataFrame:
    """``encoded(text_key, ids)`` with its decoded text; special tokens are kept."""
    vocabulary = vocabulary or public_byte_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary[0], special)
        for batch in batches:
            ids = batch.column("ids")
            texts = [pieces.decode(x.values.to_numpy()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), ids, pa.array(texts, pa.string())], ["text_key", "ids", "text"])

    return encoded.select("text_key", "ids").mapInArrow(run, "text_key binary, ids array<int>, text string")


def encode(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs(doc_id, text)``.

    A null text is empty, an empty text has no ids. Rows may repeat, with or without an id;
    each gets its own row. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"))
    return rows.join(encode_texts(docs, vocabulary), "text_key").select("doc_id", "ids")


def digests(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, special: tuple[str, int] = ("<|endoftext|>", 50256)) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: hashes of the decimal ids and of the decoded text."""
    decoded = encode_texts(docs, vocabulary, special, decoded=True)
    written = F.concat_ws(",", F.col("ids").cast("array<string>"))
    by_text = decoded.select(
        "text_key", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"))
    return rows.join(by_text, "text_key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
