"""Normalisation, canonical text, offsets, chunking."""

import numpy as np
from pyspark.sql import functions as F

from lexfolio.functions.arrays import regex_hits, running_starts
from lexfolio.functions.hashing import _Word, _bucket, _embed
from lexfolio.functions.text import dice, normalize_text, search_tokens, utf16_offset
from lexfolio.operators import ir, layout, retrieval


def test_normalize_text(spark):
    df = spark.createDataFrame([("  a\r\nb\rc\fd e​f é ﻿",)], "t string")
    assert df.select(normalize_text(F.col("t"))).first()[0] == "a\nb\nc\nd ef é"


def test_running_starts_any_length(spark):
    for n in (0, 1, 15, 16, 17, 300, 1025):
        got = spark.range(1).select(running_starts(F.expr(f"transform(filter(sequence(0, {n}), i -> i < {n}), i -> cast(i % 7 as int))"))).first()[0]
        want = np.concatenate([[0], np.cumsum([i % 7 for i in range(n)])])[:-1].tolist() if n else []
        assert got == want


def test_regex_hits_positions(spark):
    text = "a1bb22ccc333"
    hits = spark.createDataFrame([(text,)], "t string").select(regex_hits(F.col("t"), r"\d+")).first()[0]
    assert [(h["start"], h["end"], h["hit"]) for h in hits] == [(1, 2, "1"), (4, 6, "22"), (9, 12, "333")]


def test_blocks_and_offsets(spark):
    text = "# Title\n\nFirst para\n\n- item one\n\n\n\n• item two\n\nlast"
    doc = ir.canonical_documents(spark.createDataFrame([("v", text)], "version_id string, text string")).first()
    assert [b["block_type"] for b in doc["blocks"]] == ["heading", "paragraph", "list_item", "list_item", "paragraph"]
    assert all(doc["canonical_text"][b["start"]:b["end"]] == b["text"] for b in doc["blocks"])
    assert "First para\n- item one\n• item two\n\nlast" in doc["canonical_text"]
    assert doc["blocks"][0]["level"] == 1 and [b["block_index"] for b in doc["blocks"]] == [0, 1, 2, 4, 5]


def test_utf16_offsets(spark):
    df = spark.createDataFrame([("a\U0001F600b",)], "t string")
    assert df.select(utf16_offset(F.col("t"), F.lit(2))).first()[0] == 3


def test_source_map_counts_bytes_units_and_boxes(spark):
    texts = ["# Tête", "a😀b 中文", "- item", "", "end é"]
    doc = ir.canonical_documents(spark.createDataFrame([("v", "\n\n".join(texts)), ("e", ""), ("n", None)], "version_id string, text string"))
    whole = doc.filter("version_id = 'v'").first()["canonical_text"]
    rows = ir.source_map(doc, origin=True).orderBy("start").collect()
    assert len(rows) == 4 and all(r["bbox"] is None and r["version_id"] == "v" for r in rows)
    for r in rows:
        for edge in ("start", "end"):
            before = whole[: r[edge]]
            assert (r[f"byte_{edge}"], r[f"utf16_{edge}"]) == (len(before.encode()), len(before.encode("utf-16-be")) // 2)
    schema = "version_id string, page_number int, reading_order int, block_index int, block_type string, text string, level int, confidence double, is_ocr boolean, bbox_x double, bbox_y double, bbox_width double, bbox_height double"
    paged = spark.createDataFrame([("v", 2, 0, 1, "paragraph", "b", None, 1.0, False, 0.1, 0.2, 0.3, 0.4), ("v", 1, 0, 0, "paragraph", "a", None, 1.0, True, None, None, None, None)], schema)
    rows = ir.source_map(ir.canonical_from_blocks(paged), origin=True).orderBy("start").collect()
    assert [tuple(r["bbox"]) for r in rows] == [(None,) * 4, (0.1, 0.2, 0.3, 0.4)] and [r["byte_start"] for r in rows] == [0, 3]


def test_tokens_and_dice(spark):
    df = spark.createDataFrame([("The café costs $5.00, it's non-trivial.", "a b c", "b c d")], "t string, x string, y string")
    row = df.select(search_tokens(F.col("t")).alias("t"), dice(F.col("x"), F.col("y")).alias("d")).first()
    assert row["t"] == ["caf", "costs", "$5.00", "non-trivial."] and abs(row["d"] - 2 / 3) < 1e-12


def _chunks_by_loop(blocks, target=500, overlap=100):
    out, cur, head = [], [], ""

    def flush():
        nonlocal cur
        if not cur:
            return
        out.append((head, [b["block_id"] for b in cur]))
        kept, size = [], 0
        for b in reversed(cur):
            if size + len(b["text"]) > overlap:
                break
            kept.insert(0, b)
            size += len(b["text"])
        cur = kept

    for b in blocks:
        if b["block_type"] == "heading":
            flush()
            head = b["text"]
        cur.append(b)
        if sum(len(x["text"]) for x in cur) >= target:
            flush()
    flush()
    return out


def test_chunks_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(25):
        parts = [("SECTION %d head" % i if rng.random() < 0.2 else "w" * int(rng.integers(1, 260))) for i in range(int(rng.integers(1, 30)))]
        rows.append((str(d), "\n\n".join(parts)))
    docs = layout.retype_paragraphs(ir.canonical_documents(spark.createDataFrame(rows, "version_id string, text string")))
    got: dict = {}
    for r in retrieval.chunk_documents(docs).orderBy("version_id", "chunk_index").collect():
        got.setdefault(r["version_id"], []).append((r["heading"], r["block_ids"]))
    for d in docs.collect():
        assert got[d["version_id"]] == _chunks_by_loop(d["blocks"])


def test_embedding_hash_by_definition():
    def slow(s, seed):
        h = seed
        for ch in s:
            h = (31 * h + ord(ch)) & 0xFFFFFFFF
        return _bucket(h)

    w = _Word("liability")
    assert w.buckets[0] == slow("liability", 0x12345678) and w.buckets[2] == slow("lia", 0x55AA55AA)
    v = _embed("cap on liability", {})
    assert abs(float(np.dot(v, v)) - 1) < 1e-12 and not _embed("  ", {}).any()
