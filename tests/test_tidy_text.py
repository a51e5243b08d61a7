"""Clauses cut from tidy text against clauses built from blocks, on pieces at the edge of being headers and bullets."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.text import compose_unicode, tidy_blocks
from lexfolio.operators import contract, ir

PIECES = ["Plain words.", "SECTION 1. TERM", "Section 2.1: Fees", "SECTION", "SECTION 3.\nbelow", "SECTION 4. A\nB", "ARTICLE IV", "1.2 Scope", "3. Audit", "7",
          "(a) Non-Competition", "(see above)", "Exhibit A", "annex b: Table", "Schedules apply.", "# Title", "## ", "•", "• one", "-\nfoo", "- two\n- three", "*x", "a\n- b",
          "café", "termination of liability", "2 notices", "#1. Head"]
ODD = ["", " led", "trail ", "\ttab", "café", "a\r\nb", "a b", "​z", "\n", "end\n", "　w"]


def texts():
    rng = random.Random(7)
    tidy = ["\n\n".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(300)]
    return tidy + ["\n\n".join(rng.choices(PIECES + ODD, k=rng.randint(1, 8))) for _ in range(200)] + ["", None, " ", "\n\n", "•\n\n• b", "a\n\n\n\nb"]


def test_tidy_documents_equal_built_ones(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts())], "version_id string, text string")
    built = docs.select("version_id", ir.place_blocks(ir.text_blocks(compose_unicode(F.col("text")))).alias("p")).select("version_id", "p.canonical_text", "p.blocks")
    want = {r["version_id"]: r for r in contract.segment_clauses(built).collect()}
    got = contract.segmented_documents(docs).collect()
    assert len(got) == len(want) == docs.count()
    for row in got:
        assert row == want[row["version_id"]]
    assert {r["version_id"]: r for r in ir.canonical_documents(docs).collect()} == {k: r for k, r in zip(want, [w for w in built.collect()])}


def test_tidy_clauses_need_no_blocks(spark):
    """The cut answers for itself unless a block only begins like a header; untidy text never reaches it."""
    rows = spark.createDataFrame([("A.\n\nSECTION 1. TERM\n\nb\n\n- c\n\n- d\n\n1.1 Sub",), ("A.\n\n(see above)",), ("A. \n\nSECTION 1. B",), ("A.\r\n\r\nB",)], "text string")
    canonical = F.regexp_replace("text", lx.BULLET_BREAK, "\n")
    cut = rows.select(tidy_blocks(F.col("text")).alias("tidy"), contract.clauses_of_tidy(F.col("text"), canonical).alias("clauses")).collect()
    assert [r["tidy"] for r in cut] == [True, True, False, False]
    assert [(c["clause_number"], c["start"], c["end"], c["block_ids"], c["parent_index"]) for c in cut[0]["clauses"]] == [
        ("", 0, 2, ["b0"], None), ("1", 4, 30, ["b1", "b2", "b3", "b4"], 0), ("1.1", 32, 39, ["b5"], 1)]
    assert cut[1]["clauses"] is None


def test_texts_without_doubtful_characters_are_composed(spark):
    """Every character that composing could change, reorder or join is sent to the composer."""
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string")
    stable = {r["c"] for r in rows.filter(~F.col("c").rlike(lx.DOUBTFUL_NFC)).collect()}
    joins = {d[1] for d in (unicodedata.decomposition(c).split() for c in chars) if len(d) == 2 and not d[0].startswith("<")}
    joins |= {f"{c:04X}" for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}
    assert len(stable) > 30000
    assert not [c for c in stable if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or f"{ord(c):04X}" in joins]
