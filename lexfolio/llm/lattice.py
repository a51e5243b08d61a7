"""SentencePiece encoding, decoding and sampled segmentations without replacement.

A text is cut into words at the escaped blanks; pieces do not cross them, so the lattice of
a text is the chain of its words' lattices. Each node carries the exact log weight of all
its completions (pieces weigh ``temperature`` times their score). Segmentations are drawn by
perturbed A-star search: the root holds a Gumbel variable, a node's best child inherits its
parent's value and the other children together get one that is bounded by it. Taking nodes
from the queue in falling order emits distinct segmentations in the order of their
perturbed weights, which is Gumbel top-k sampling without replacement. The next value in
the queue is the threshold of the inclusion scores. Draws are seeded by the row key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of
from lexfolio.llm.ppm import Lookup

BLANK = "▁"


class Pieces:
    """Vocabulary of a public SentencePiece model with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        m = self.model
        size = m.get_piece_size()
        usual = [i for i in range(size) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))]
        self.ids = {m.id_to_piece(i): i for i in usual}
        self.scores = np.array([m.get_score(i) for i in range(size)])
        self.bytes = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(size) if m.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.surface = [b""] * size
        for piece, i in self.ids.items():
            self.surface[i] = piece.replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        codes, rows = [], []
        for piece, i in self.ids.items():
            code = 0
            for c in piece:
                code = (code + ord(c) + 1) * int(_STEP) % 2**64
            codes.append(code)
            rows.append(i)
        self.row_ids = np.array(rows, np.int64)
        self.find = Lookup(np.array(codes, np.uint64))

    def written(self, choices: np.ndarray) -> np.ndarray:
        """Ids of lattice choices: a code point without a piece becomes its bytes."""
        if (choices >= 0).all():
            return choices.astype(np.int32)
        out: list[int] = []
        for c in choices.tolist():
            out += [c] if c >= 0 else [self.bytes[b] for b in chr(-1 - c).encode()]
        return np.array(out, np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and fallback bytes joined, the blank that encoding puts first removed."""
        raw = b"".join(itemgetter(*ids, ids[-1])(self.surface)[:-1]).decode("utf-8", "replace") if ids else ""
        return raw[1:] if raw.startswith(" ") else raw


class WordLattices:
    """Lattices of a set of words as flat arrays, built for all words together.

    A node stands before a character of a word. Its choices are a run in the choice arrays:
    cumulative probability (plus the node number), piece id (below 0: the bytes of a code
    point), next node (-1 at the word's end) and log probability.
    """

    def __init__(self, pieces: Pieces, temperature: float, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        total = len(points)
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(total)  # characters to the word's end
        self.root = dict(zip(words, (np.cumsum(sizes) - sizes).tolist(), strict=True))
        nodes, ids, lengths = [], [], []
        at, code = np.arange(total), np.zeros(total, np.uint64)
        for n in range(1, pieces.longest + 1):
            fits = left[at] >= n
            at, code = at[fits], code[fits]
            code = (code + points[at + n - 1] + np.uint64(1)) * _STEP
            row = pieces.find.find(code)
            hit = np.flatnonzero(row >= 0)
            nodes.append(at[hit])
            ids.append(pieces.row_ids[row[hit]])
            lengths.append(np.full(len(hit), n, np.int64))
        bare = np.ones(total, np.bool_)
        bare[nodes[0]] = False
        bare = np.flatnonzero(bare)  # characters without a piece of their own are written in bytes
        nodes.append(bare)
        ids.append(-1 - points[bare].astype(np.int64))
        lengths.append(np.ones(len(bare), np.int64))
        node, id_, length = np.concatenate(nodes), np.concatenate(ids), np.concatenate(lengths)
        width = 1 + (points[node] > 0x7F).astype(np.int64) + (points[node] > 0x7FF) + (points[node] > 0xFFFF)
        score = temperature * np.where(id_ >= 0, pieces.scores[np.maximum(id_, 0)], pieces.scores.min() * width)
        # weights from the words' ends: nodes with r characters left need those with fewer
        order = np.lexsort((length, node, left[node]))
        node, id_, length, score = node[order], id_[order], length[order], score[order]
        weight = np.zeros(total + 1)
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.empty(0, np.int64)
        cuts = np.searchsorted(left[node[starts]], np.arange(1, (left.max() if total else 0) + 2))
        following = np.where(length < left[node], node + length, -1)
        value = np.empty(len(node))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            first, last = starts[a], starts[b] if b < len(starts) else len(node)
            v = score[first:last] + np.where(following[first:last] >= 0, weight[following[first:last]], 0.0)
            runs = starts[a:b] - first
            top = np.maximum.reduceat(v, runs)
            counts = np.diff(np.append(runs, last - first))
            weight[node[starts[a:b]]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, counts)), runs))
            value[first:last] = v
        log_share = value - weight[node]
        order = np.lexsort((-log_share, node))  # likely choices first: a draw mostly ends at the first
        node, self.ids, self.following, self.log_share = node[order], id_[order], following[order], np.minimum(log_share[order], 0.0)
        self.begin = np.searchsorted(node, np.arange(total + 1))
        share = np.exp(self.log_share)
        running = np.cumsum(share)
        base = np.concatenate(([0.0], running))[self.begin[:-1]]
        self.cumulative = node + np.minimum(running - base[node], 1.0)
        self.cumulative[self.begin[1:] - 1] = np.arange(1, total + 1)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(key: np.ndarray, counter: np.ndarray, purpose: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row key, the place and the purpose alone."""
    h = key ^ (counter.astype(np.uint64) * _STEP + np.uint64(purpose))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _bounded(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of the given locations, each below its bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class Drawn:
    """One segmentation of one text: nodes, choices, log probability before each choice."""

    __slots__ = ("nodes", "taken", "before", "log_prob", "perturbed")

    def __init__(self, nodes, taken, before, log_prob, perturbed):
        self.nodes, self.taken, self.before, self.log_prob, self.perturbed = nodes, taken, before, log_prob, perturbed


def sample(lattices: WordLattices, texts: list[list[str]], k: int, keys: np.ndarray) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to ``k`` distinct segmentations: choices, log probability, perturbed weight, inclusion score.

    A text with fewer segmentations gives all of them; then nothing is left in its queue and
    every inclusion score is 1. All texts advance together: each round draws one path for
    every text that has a node left, through the words behind the place where it branches.
    """
    root, begin, following = lattices.root, lattices.begin, lattices.following
    log_share, cumulative = lattices.log_share, lattices.cumulative
    roots = [np.array([root[w] for w in words], np.int64) for words in texts]
    keys = keys.astype(np.uint64)
    queues: list[list[tuple]] = [[] for _ in texts]
    chains: list[list[Drawn]] = [[] for _ in texts]
    serial = 0

    def draw(round_: int, who: list[int], prefixes: list[tuple[np.ndarray, np.ndarray]], begins: list[np.ndarray], bounds: np.ndarray) -> None:
        """One new path for each text of ``who``: prefix (nodes, choices), then drawn from ``begins`` on."""
        nonlocal serial
        sizes = np.array([len(b) for b in begins], np.int64)
        node = np.concatenate(begins) if begins else np.empty(0, np.int64)
        text = np.repeat(np.arange(len(who)), sizes)
        number = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = keys[np.array(who, np.int64)]
        where, step, parts = np.arange(len(node)), 0, []
        while len(node):
            u = _uniform(key[text[where]], (number[where] << 20) + step, 8 * round_ + 1)
            taken, target = begin[node], node + u
            behind = np.flatnonzero(cumulative[taken] <= target)
            while len(behind):
                taken[behind] += 1
                behind = behind[cumulative[taken[behind]] <= target[behind]]
            parts.append((where, node, taken))
            node = following[taken]
            more = node >= 0
            where, node, step = where[more], node[more], step + 1
        where, nodes, taken = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
        order = np.argsort(where, kind="stable")
        nodes, taken, owner = nodes[order], taken[order], text[where[order]]
        cuts = np.searchsorted(owner, np.arange(len(who) + 1))
        steps = log_share[taken]
        running = np.concatenate(([0.0], np.cumsum(steps)))
        fixed = np.array([float(log_share[p[1]].sum()) for p in prefixes])
        before = running[:-1] - running[cuts[:-1]][owner] + fixed[owner]
        left = -np.expm1(steps)
        many = (begin[nodes + 1] - begin[nodes] > 1) & (left > 1e-300)
        place = np.arange(len(nodes)) - cuts[:-1][owner]
        value = np.full(len(nodes), -np.inf)
        o = np.flatnonzero(many)
        value[o] = _bounded(before[o] + np.log(left[o]), bounds[owner[o]], _uniform(key[owner[o]], place[o], 8 * round_ + 2))
        filled = np.flatnonzero(cuts[1:] > cuts[:-1])
        for _ in range(k):  # a text can use at most k of the nodes left behind here
            if not len(filled):
                break
            top = np.maximum.reduceat(value, cuts[filled])
            found = np.flatnonzero(value == np.repeat(top, np.diff(cuts)[filled]))
            _, first = np.unique(owner[found], return_index=True)
            for at in found[first].tolist():
                if value[at] > -np.inf:
                    w = int(owner[at])
                    here = len(prefixes[w][0]) + at - int(cuts[w])
                    heapq.heappush(queues[who[w]], (-float(value[at]), serial, len(chains[who[w]]), here, (int(taken[at]),)))
                    serial += 1
                    value[at] = -np.inf
        for w, doc in enumerate(who):
            a, b = int(cuts[w]), int(cuts[w + 1])
            p_nodes, p_taken = prefixes[w]
            p_before = np.concatenate(([0.0], np.cumsum(log_share[p_taken])))[:-1] if len(p_taken) else np.empty(0)
            log_prob = float(fixed[w] + running[b] - running[a])
            chains[doc].append(Drawn(np.concatenate((p_nodes, nodes[a:b])), np.concatenate((p_taken, taken[a:b])), np.concatenate((p_before, before[a:b])), log_prob, float(bounds[w])))

    none = np.empty(0, np.int64)
    everyone = list(range(len(texts)))
    start = -np.log(-np.log(_uniform(keys, np.zeros(len(keys), np.int64), 0)))
    draw(0, everyone, [(none, none)] * len(texts), roots, start)
    for round_ in range(1, k):
        who, prefixes, begins, bounds = [], [], [], []
        for doc in everyone:
            if not queues[doc]:
                continue
            negative, _, source, place, excluded = heapq.heappop(queues[doc])
            c = chains[doc][source]
            node = int(c.nodes[place])
            options = np.array([x for x in range(int(begin[node]), int(begin[node + 1])) if x not in excluded])
            share = np.exp(log_share[options])
            u = _uniform(keys[doc : doc + 1], np.array([place]), 8 * round_ + 3)[0]
            pick = int(options[min(int(np.searchsorted(np.cumsum(share), u * share.sum(), side="right")), len(options) - 1)])
            rest = share[options != pick].sum()
            if rest > 1e-300:  # the choices of this node that no chain took
                location = np.array([c.before[place] + np.log(rest)])
                v = _bounded(location, np.array([-negative]), _uniform(keys[doc : doc + 1], np.array([place]), 8 * round_ + 4))
                heapq.heappush(queues[doc], (-float(v[0]), serial, source, place, (*excluded, pick)))
                serial += 1
            word = int(np.count_nonzero(following[c.taken[:place]] < 0))
            inner = int(following[pick])
            who.append(doc)
            prefixes.append((c.nodes[: place + 1], np.append(c.taken[:place], pick)))
            begins.append(np.concatenate(([inner], roots[doc][word + 1 :])) if inner >= 0 else roots[doc][word + 1 :])
            bounds.append(-negative)
        if not who:
            break
        draw(round_, who, prefixes, begins, np.array(bounds))
    out = []
    for doc in everyone:
        threshold = -queues[doc][0][0] if queues[doc] else None
        out.append([
            (c.taken, c.log_prob, c.perturbed, 1.0 if threshold is None else float(-np.expm1(-np.exp(min(c.log_prob - threshold, 700.0)))))
            for c in chains[doc]
        ])
    return out


def split_words(text: str) -> list[str]:
    """Words of a text with the blank before each; a run of blanks is a word of its own."""
    escaped = BLANK + text.replace(" ", BLANK)
    if BLANK + BLANK not in escaped and escaped != BLANK:
        return [BLANK + w for w in escaped[1:].split(BLANK)]
    out: list[str] = []
    for part in escaped[1:].split(BLANK):
        if not part or not out:
            out.append(BLANK + part)
        elif out[-1].strip(BLANK) == "":
            out[-1] += BLANK + part
        else:
            out.append(BLANK + part)
    return out


def public_piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sample_segmentations(
    docs: DataFrame, k: int = 2, temperature: float = 1e-3, seed: int = 1, model: str | None = None
) -> DataFrame:
    """doc_id, sample (from 1), ids, n_pieces, log_prob, perturbed, inclusion, round_trip for each text.

    ``docs`` has doc_id and text. A null or empty text has no pieces: one sample without ids,
    probability 1. Equal rows (doc_id and text) draw alike. round_trip: decoding the ids gives
    the text back. A text with fewer than ``k`` segmentations gives as many as it has.
    """
    path = model or public_piece_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for whole in batches:
            for batch in batches_of(whole, "text", 2 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                words = [split_words(t) if t else [] for t in texts]
                lattices = WordLattices(pieces, temperature, sorted({w for ws in words for w in ws}))
                drawn = sample(lattices, words, k, batch.column("key").to_numpy().view(np.uint64))
                columns: list[list] = [[] for _ in range(8)]
                for doc, text, chains in zip(batch.column("doc_id").to_pylist(), texts, drawn, strict=True):
                    for s, (taken, log_prob, perturbed, inclusion) in enumerate(chains, 1):
                        ids = pieces.written(lattices.ids[taken])
                        good = pieces.decode(ids.tolist()) == text
                        for column, v in zip(columns, (doc, s, ids, len(ids), log_prob, perturbed, inclusion, good), strict=True):
                            column.append(v)
                types = (pa.int64(), pa.int32(), None, pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                names = ["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip"]
                arrays = [pa.array(c, t) if t else None for c, t in zip(columns, types, strict=True)]
                offsets = np.concatenate(([0], np.cumsum(columns[3]))).astype(np.int32)
                arrays[2] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns[2]), pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key"))
    return rows.mapInArrow(
        run, "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, inclusion double, round_trip boolean"
    )


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` (with ids, array of ints) plus decoded: null ids give null, no ids the empty text."""
    path = model or public_piece_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, decoded string")
