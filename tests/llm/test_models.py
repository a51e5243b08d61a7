"""Search, sampling, packing and trained scorers against brute force, round trips and held-out accuracy."""

import collections
import math
import zlib

import numpy as np
import pytest

from lexfolio.llm import bloom_lm, lattice, packing, ppm, pu_quality, vptree
from tests.llm.conftest import prose


def _crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("factor", [1.0, 1.15])
def test_vantage_search_against_brute_force(spark, factor):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[100:140] = x[100]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [None] * 8), (704, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vptree.search(frame, frame.filter("vec_id % 20 = 0"), k=20, factor=factor, leaf=16, shard_rows=200, block_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 600, 20):
        s = np.einsum("ij,j->i", x, x[q])
        want = [i for i in sorted(range(600), key=lambda i: (-s[i], i)) if i != q][:20]
        hit += len(set(want) & set(got[q]))
        if factor == 1.0:
            assert got[q] == want
    assert hit >= 0.9 * 20 * 30 and 700 not in got and 701 not in got


def test_vantage_search_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in vptree.search(few, few).collect()] == [(0, 1, 1), (1, 1, 0)]
    assert vptree.search(few.limit(0), few.limit(0)).count() == 0


@pytest.mark.parametrize("factor", [1.0, 1.15])
def test_ties_of_different_vectors_go_to_the_smallest_ids(spark, factor):
    rng = np.random.default_rng(5)
    ties = [[1.0, *(float(v) for v in rng.integers(-1000, 1000, 3) / 1024)] for _ in range(400)]
    rows = [(i, v, "a") for i, v in enumerate(ties)] + [(1000, [1.0, 0.0, 0.0, 0.0], "q"), (1000, [1.0, 0.0, 0.0, 0.0], "q")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = vptree.search(frame, frame.filter("vec_id = 1000").limit(1), factor=factor, leaf=16, shard_rows=150).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20)) and {r.score for r in got} == {1.0}


def test_vectors_meet_those_of_their_own_width(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [1.0, 0.0, 2.0]), (3, [3.0, 1.0, 0.0]), (5, [])], "vec_id long, embedding array<double>")
    got = vptree.search(frame, frame.filter("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 1, 0.5), (20, 3, 3.0)]


def test_sampled_segmentations_are_distinct_and_decode(docs_frame):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (4, "  two  blanks "), (5, "zß€ 𝄞\n\ttab"), (6, prose(1, 3000)), (1, "the cat sat")]
    got = lattice.sample_segmentations(docs_frame([(i, t, "en") for i, t in rows]), k=3)
    out = collections.defaultdict(list)
    for r in got.collect():
        assert r.round_trip and 0 <= r.inclusion <= 1
        out[r.doc_id].append(tuple(r.ids))
    assert len(out[1]) == 6 and len(set(out[1])) == 3  # the repeated row draws alike
    assert out[2] == out[3] == [()]
    decoded = {r.doc_id: r.decoded for r in lattice.decode(got.filter("sample = 1")).collect()}
    assert decoded[4] == "  two  blanks " and decoded[5] == "zß€ 𝄞\n\ttab"


def test_samples_follow_the_lattice_without_replacement():
    pieces = lattice.Pieces(lattice.public_piece_model())
    words = lattice.split_words("the")
    net = lattice.WordLattices(pieces, 1e-4, words)
    drawn = lattice.sample(net, [words] * 20_000, 2, np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    share = {tuple(c[0]): math.exp(c[1]) for d in drawn for c in d}
    first = collections.Counter(tuple(d[0][0]) for d in drawn)
    pairs = collections.Counter((tuple(d[0][0]), tuple(d[1][0])) for d in drawn)
    assert abs(sum(share.values()) - 1) < 1e-6
    assert all(abs(first[s] / 20_000 - p) < 0.015 for s, p in share.items())
    assert all(abs(n / 20_000 - share[a] * share[b] / (1 - share[a])) < 0.015 for (a, b), n in pairs.items())


def test_first_fit_decreasing_matches_a_plain_scan():
    sizes = sorted(np.random.default_rng(2).integers(1, 1025, 400).tolist(), reverse=True)
    room, want = [], []
    for n in sizes:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(1024)
        room[at] -= n
        want.append(at)
    assert packing.first_fit_decreasing(sizes, 1024) == want


def test_packing_holds_every_token_once(docs_frame):
    from tokenizers import Tokenizer

    rows = [(i, prose(i, 20 + 37 * i)) for i in range(60)] + [(100, None), (101, ""), (102, "a  b\n\n c\x1c d e <|endoftext|> "), (103, prose(7, 4000)), (5, "again"), (None, "no id")]
    got = packing.pack(docs_frame([(i, t, "en") for i, t in rows]), docs_per_group=16).collect()
    full = Tokenizer.from_file(packing.public_byte_bpe()[2])
    full.encode_special_tokens = True
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for i, rs in pieces.items():
        assert sum(r.length for r in rs) == sum(map(len, want[i]))
        for r in rs:
            assert any(len(w) == r.doc_tokens and zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for w in want[i])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    padded = sum({r.sequence_id: r.padded_length for r in got}.values())
    assert padded - sum(r.length for r in got) < 0.05 * padded
    assert packing.pack(docs_frame([])).count() == 0


def test_language_of_held_out_texts(docs_frame):
    words = {"en": "the house and of with that", "de": "das haus und von mit dass", "fr": "la maison et de avec que"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[lang].split(), 30)), lang) for i in range(120) for lang in [("en", "de", "fr")[i % 3]]]
    edge = [(900, None, "en"), (901, "", "en"), (902, "12 !? 34", "de"), (903, "das haus", None), (904, "the house " * 20_000, "en")]
    got = {r.doc_id: r for r in ppm.identify(docs_frame(rows + edge)).collect()}
    assert len(got) == 125
    held = [(i, lang) for i, _, lang in rows if _crc(i, 4) == 2]
    assert all(got[i].held_out and got[i].lang_pred == lang for i, lang in held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "en"]
    assert got[900].score == 0.0
    alone = ppm.identify(docs_frame([(1, "some text", None)])).first()
    assert alone.lang_pred == "und" and ppm.identify(docs_frame([])).count() == 0


def test_code_lengths_match_plain_escapes():
    text = b"abracadabra abracadabra"
    trees = ppm.ContextTrees.build(["x"], *_counts(text))
    trees.prepare()
    seen = collections.Counter()
    data = b"\n\n\n" + text
    for k in range(3, len(data)):
        for n in (1, 2, 3, 4):
            seen[data[k - n + 1 : k + 1]] += 1

    def bits(context, c):
        after = {g[-1]: v for g, v in seen.items() if len(g) == len(context) + 1 and g[:-1] == context}
        total, kinds = sum(after.values()), len(after)
        if c in after:
            return -math.log2(after[c] / (total + kinds))
        out = -math.log2(kinds / (total + kinds)) if total else 0.0
        return out + (bits(context[1:], c) if context else 8.0)

    probe = b"\n\n\nabrakadaxbra"
    got = trees.bits(ppm.strings_of(np.frombuffer(probe, np.uint8), 4))[:, 0]
    assert np.allclose(got, [bits(probe[k - 3 : k], probe[k]) for k in range(3, len(probe))], atol=1e-4)


def _counts(text):
    codes, n = np.unique(ppm.strings_of(np.frombuffer(b"\n\n\n" + text, np.uint8), 4), return_counts=True)
    return np.zeros(len(codes), np.int64), codes.astype(np.int64), n.astype(float)


def test_language_model_base_score_is_exact(docs_frame):
    rows = [(i, prose(i % 9, 40)) for i in range(40)] + [(50, None), (51, ""), (52, "Amber1 new\tWORD"), (53, "big " * 30_000), (3, prose(3, 5))]
    got = bloom_lm.score_documents(docs_frame([(i, t, "en") for i, t in rows]), bloom_lm.Settings(bits=1 << 20, head_words=20)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = collections.Counter(x for i, t in rows if _crc(i, 7) != 2 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    assert bloom_lm.score_documents(docs_frame([])).count() == 0


def test_filter_gives_counts_back():
    settings = bloom_lm.Settings(bits=1 << 20)
    h = bloom_lm.mixed(np.arange(1, 2001, dtype=np.uint64))
    counts = np.resize([1, 2, 3, 10, 1000], 2000)
    levels = bloom_lm.level_of(counts, settings.base)
    bits, size = np.zeros(1 << 20, bool), (1 << 20) // 16
    for level in range(1, levels.max() + 1):
        own = h[levels >= level]
        for at in bloom_lm.probe(own, level, settings.probes, size):
            bits[at + (own >> np.uint64(60)) * np.uint64(size)] = True
    got = bloom_lm.probed_counts(h, np.packbits(bits, bitorder="little"), 16, settings)
    want = bloom_lm.count_at(levels, settings.base)
    assert (got >= want).all() and (got == want).mean() > 0.95  # never too low, seldom too high


def test_quality_of_held_out_documents(spark, docs_frame):
    good = [(i, ". ".join(prose(i * 50 + k, 9).capitalize() for k in range(6)) + ".") for i in range(150)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(200, 260)]
    edge = [(900, None), (901, ""), (902, "x" * 200_000)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (900, None, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in pu_quality.classify(docs_frame([(i, t, "en") for i, t in good + bad + edge]), frame).collect()}
    held = [(i, 1) for i, _ in good if _crc(i, 4) == 2] + [(i, 0) for i, _ in bad if _crc(i, 4) == 2]
    assert sum(got[i].predicted == q for i, q in held) >= 0.95 * len(held)
    assert all(0 <= got[i].score <= 1 for i in (900, 901, 902)) and len(got) == 213
    none = pu_quality.classify(docs_frame([(1, "a", "en")]), frame.limit(0)).first()
    assert none.score == 0.5 and pu_quality.classify(docs_frame([]), frame).count() == 0
