"""Chunked BPE against the tokenizer library, the filter audit against SQL and a plain count, collocations against a plain count."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexfolio.llm import bpe_chunks, collocations, filter_audit

from .conftest import prose

AWKWARD = ["a", "b", "é", "ж", "語", "。", " ", "  ", "\n", "'s", "'re", "'", "1", "23", "!", "<|endoftext|>", "🙂", "\t", "x" * 30, "　", "ü", "ß", "."]


def awkward(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return "".join(pick.choice(AWKWARD) for _ in range(n))


# --- chunked BPE ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_digests_equal_the_library(docs_frame, library):
    passage = awkward(1, 5000)
    texts = [awkward(k, 40 * k) for k in range(12)] + [awkward(50 + k, 60) + passage[k:] + awkward(90 + k, 60) for k in range(6)]
    texts += [None, "", " ", "hello world", "hello world", "a" * 30_000, "a" * 30_000 + " b", " " * 9_000, prose(3, 4000)]
    rows = [(i if i != 4 else None, t, "en") for i, t in enumerate(texts)]

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    got = [tuple(r) for r in bpe_chunks.digests(docs_frame(rows)).collect()]
    assert sorted(got, key=str) == sorted((want(i, t) for i, t, _ in rows), key=str)


def test_ids_and_round_trip(docs_frame):
    rows = [(1, prose(1, 900), "en"), (1, prose(1, 900), "en"), (2, None, "en")]
    encoded = bpe_chunks.encode(docs_frame(rows))
    assert encoded.columns == ["doc_id", "ids"] and encoded.count() == 3
    back = bpe_chunks.decode_texts(bpe_chunks.encode_texts(docs_frame(rows)))
    assert sorted(r.text for r in back.collect()) == sorted({prose(1, 900), ""})
    assert bpe_chunks.digests(docs_frame([]).limit(0)).count() == 0


def test_chunks_are_cut_by_content_and_reused():
    shared = prose(5, 3000).encode()

    def chunks(data):
        cuts = bpe_chunks.cut_places(data)
        return [data[a:b] for a, b in bpe_chunks.chunk_ranges(data, 0, len(data), cuts[cuts >= bpe_chunks.CHUNK_LEAST].tolist())]

    one, two = chunks(b"some words before. " + shared), chunks(b"quite another beginning of the same passage " + shared)
    assert b"".join(one).endswith(shared) and all(len(c) <= bpe_chunks.CHUNK_MOST for c in one)
    both = set(one) & set(two)
    assert sum(map(len, both)) > 0.8 * len(shared)

    encoder = bpe_chunks.ChunkEncoder(bpe_chunks.public_byte_bpe())
    data, known, at = b"some words before. " + shared, [], 0
    for c in one:
        if c in both:
            known.append((at, at + len(c), np.frombuffer(encoder.encode(c), "<u4").astype("<u2").tobytes()))
        at += len(c)
    whole = np.frombuffer(encoder.encode(data), "<u4")
    assert np.array_equal(encoder.assemble(data, known, "<u2"), whole)
    assert encoder.windows >= len(known) and encoder.grown == 0

    # ids that no encoding gives are noticed at the join and left out
    spoilt = [(a, b, np.frombuffer(ids, "<u2")[::-1].tobytes()) for a, b, ids in known]
    assert np.array_equal(encoder.assemble(data, spoilt, "<u2"), whole)


# --- filter audit ---------------------------------------------------------------------

FILLER = " ".join(f"word{i}" for i in range(60))


def audit_rows():
    rows = [
        (9, FILLER, "web"), (3, FILLER, "books"), (3, FILLER, None), (7, FILLER, "web"), (1, FILLER + " #", "web"), (0, FILLER + " #", ""),
        (5, "short", "web"), (6, "AB CD", "books"), (8, "same " * 70, "web"), (2, "same " * 70, "books"), (11, None, "web"), (10, "", "web"),
        (None, FILLER, "web"), (None, "short", None), (12, "\x0b" + FILLER + "\x0c", "web"), (13, "É" * 40 + " " + FILLER, "web"), (4, "short", "web"),
    ]
    return pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})


LABELS = pd.DataFrame([(9, 1, 0), (3, 1, 1), (5, 0, 1), (7, 1, 0), (7, 0, 0), (99, 1, 1)], columns=["doc_id", "quality", "toxic"])


def by_sql(documents, labels):
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("labels", labels)
    return sorted(con.execute(filter_audit.AUDIT_SQL).fetchall())


@pytest.mark.parametrize("files", [1, 6, 17])
def test_audit_equals_sql_however_the_files_arrive(spark, tmp_path, files):
    frame = audit_rows()
    for k in range(files):  # later files hold smaller ids: every one of them retracts
        part = frame.iloc[k::files].assign(n_chars=1, mask="x", part="y", n="z")
        spark.createDataFrame(part, "doc_id long, text string, source string, n_chars long, mask string, part string, n string").coalesce(1).write.parquet(
            f"{tmp_path}/t", mode="append"
        )
    labels = spark.createDataFrame(LABELS)
    got = filter_audit.audit_files(spark, f"{tmp_path}/t", labels, batch_bytes=1)
    assert sorted(tuple(r) for r in got.collect()) == by_sql(frame, LABELS)


def test_audit_of_one_order_by_hand(spark, tmp_path):
    spark.createDataFrame(audit_rows(), "doc_id long, text string, source string").write.parquet(f"{tmp_path}/t")
    got = filter_audit.audit_files(spark, f"{tmp_path}/t", spark.createDataFrame(LABELS))
    rows = {r.step: r for r in got.filter("part = 'web' and filter_order = 'EABCD'").collect()}
    # ids 9, 7 copy 3; 1 copies 0; 8 copies 2; 5 copies 4; 11 copies 10
    assert (rows[1].removed, rows[1].kept, rows[1].redundant) == (6, 5, 0)
    assert rows[1].good_lost == 2 and rows[1].toxic_lost == 1
    assert got.filter("part = 'web'").count() == 600


def test_audit_goes_on_from_its_checkpoint(spark, tmp_path):
    frame, labels = audit_rows(), spark.createDataFrame(LABELS)
    schema = "doc_id long, text string, source string"
    for k, part in enumerate((frame.iloc[:6], frame.iloc[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/t", mode="append")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/t")
        filter_audit.run_stream(stream, labels, f"{tmp_path}/out", f"{tmp_path}/state", slots=3)
    got = filter_audit.audit(filter_audit.counters(spark, f"{tmp_path}/out"))
    assert sorted(tuple(r) for r in got.collect()) == by_sql(frame, LABELS)


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/t")
    assert filter_audit.audit_files(spark, f"{tmp_path}/t", spark.createDataFrame(LABELS)).count() == 0


# --- collocations ---------------------------------------------------------------------


def plain_collocations(rows, least, share, top):
    counts, total = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3, 4):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def collocation_rows():
    pick = random.Random(7)
    words = ["the", "of", "new", "York", "city", "é", "\x01", "語", "over", "a", "'", " "]
    rows = [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(0, 160))) + pick.choice([".", "\n", " ?\t", ""]), pick.choice(["en", "de", None, "und"])) for i in range(90)]
    rows += [(200 + i, "New York city over; in the city of new york, city.\tThe end", "en") for i in range(35)]
    return rows + [(300, None, "en"), (301, "", "fr"), (None, "lone words", "fr"), (302, "in the city of " * 400, "de")]


def test_collocations_equal_a_plain_count(docs_frame):
    rows = collocation_rows()
    for top in (2000, 5):
        got = [tuple(r) for r in collocations.mine(docs_frame(rows), top=top).collect()]
        assert sorted(got) == plain_collocations(rows, 30, 80, top)
    assert collocations.mine(docs_frame([]).limit(0)).count() == 0


def test_counts_do_not_depend_on_bursts_and_spills(monkeypatch):
    rows = collocation_rows()
    monkeypatch.setattr(collocations, "BLOCK", 3)
    wanted = None
    for burst, entries, words in ((8_192, 900_000, 700_000), (4, 900_000, 700_000), (4, 50, 700_000), (16, 200, 9)):
        counter = collocations.PhraseCounter((1, 2, 3, 4), 5, None, entries, words)
        for trie_burst in [burst]:
            counter.tries.default_factory = lambda b=trie_burst: collocations.HatTrie(b)
        got, spilled = Counter(), 0
        for i in range(0, len(rows), 7):
            for lang in ("en", "de", "und"):
                for _, name, first, phrases, counts in counter.add(lang, [t or "" for _, t, own in rows[i : i + 7] if (own or "und") == lang]):
                    assert first == min(phrases.split(b"\n"))
                    spilled += 1
                    got.update(dict(zip([(name, p) for p in phrases.split(b"\n")], np.frombuffer(counts, "<i8").tolist(), strict=True)))
        for _, name, _, phrases, counts in counter.flush():
            for p, n in zip(phrases.split(b"\n"), np.frombuffer(counts, "<i8").tolist(), strict=True):
                got[name, p] += n
        wanted = wanted or got
        assert got == wanted
        assert (entries, words) == (900_000, 700_000) or spilled


def test_runs_of_one_prefix_meet_and_merge_in_order(spark, docs_frame):
    rows = [(i, f"alpha beta w{i % 50}. " * 3, "en") for i in range(400)]
    docs = docs_frame(rows).select("lang", "text").repartition(6)
    runs = collocations.count_runs(docs, (1, 2, 3), 7)
    whole = {(r.phrase): r.n for r in collocations.merge_runs(runs, 7, 24).collect()}
    assert whole["alpha beta"] == 1200 and whole["alpha beta w7"] == 24 and whole[""] == 3600
    prefixes = runs.filter(F.contains(F.col("phrases"), F.lit(b"alpha beta w"))).select("part").distinct()
    assert prefixes.count() == 1


def test_pair_filter_never_loses_a_pair(spark):
    pairs = [("en", f"left{i} right{i * 7 % 911}") for i in range(5000)]
    found = collocations.pair_filter(spark.createDataFrame(pairs, "lang string, phrase string"))

    def hashes(words):
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64)

    left, right = zip(*(p.split(" ") for _, p in pairs), strict=True)
    assert found.passes("en", hashes(left), hashes(right)).all()
    assert found.passes("en", hashes(right), hashes(left)).mean() < 0.1
