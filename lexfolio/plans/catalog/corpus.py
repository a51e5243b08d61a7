"""Scans, normalisation, canonical text and span cutting over documents and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio.functions.text import normalize_text
from lexfolio.operators import ir
from lexfolio.plans.catalog.sqlparts import blocks_cte, cleaned
from lexfolio.plans.registry import query
from lexfolio.sources import corpora

CONTRACTS = f"contracts AS ({corpora.CONTRACTS_SQL})"


def doc_lines(t):
    """Documents as canonical rows; their text has single newlines, so lines are the blocks."""
    return ir.canonical_documents(
        t.spread("documents").select(F.col("doc_id").cast("string").alias("version_id"), "text"), separator=ir.LINE
    )


def contract_docs(t):
    return ir.canonical_documents(corpora.contracts(t))


DOC_LINES = blocks_cte("(SELECT CAST(doc_id AS VARCHAR) AS version_id, text FROM documents)", "version_id", r"\r?\n")
CONTRACT_BLOCKS = f"{CONTRACTS}, {blocks_cte('contracts', 'version_id')}"


@query("s01_text_scan", f"WITH {DOC_LINES} SELECT version_id, block_index, block_type, text, level FROM blocks")
def _(t):
    return ir.block_rows(doc_lines(t), "version_id").select("version_id", "block_index", "block_type", "text", "level")


@query("s01_blank_line_scan", f"WITH {CONTRACT_BLOCKS} SELECT version_id, block_index, block_type, text, level FROM blocks")
def _(t):
    return ir.block_rows(contract_docs(t), "version_id").select("version_id", "block_index", "block_type", "text", "level")


@query("p01_normalize_text", f"SELECT page_id, {cleaned('html')} AS text FROM pages")
def _(t):
    return t.spread("pages").select("page_id", normalize_text(F.col("html")).alias("text"))


@query("p02_canonical_text", f"WITH {CONTRACT_BLOCKS} SELECT version_id, canonical_text FROM blocks_doc")
def _(t):
    return contract_docs(t).select("version_id", "canonical_text")


@query("p03_source_map", f"""WITH {CONTRACT_BLOCKS} SELECT version_id, block_id, 1 AS page_number, start, "end", false AS is_ocr, 1.0::DOUBLE AS confidence FROM blocks""")
def _(t):
    return ir.source_map(contract_docs(t))


@query("p02_offset_check", f"""WITH {DOC_LINES} SELECT version_id, CAST(count(*) AS BIGINT) AS blocks,
 CAST(sum(CASE WHEN substring(canonical_text, start + 1, "end" - start) = text THEN 1 ELSE 0 END) AS BIGINT) AS aligned
 FROM blocks JOIN blocks_doc USING (version_id) GROUP BY version_id""")
def _(t):
    docs = doc_lines(t)
    ok = F.filter("blocks", lambda b: F.substring("canonical_text", b["start"] + 1, b["end"] - b["start"]) == b["text"])
    return docs.select(
        "version_id", F.size("blocks").cast("bigint").alias("blocks"), F.size(ok).cast("bigint").alias("aligned")
    ).filter(F.col("blocks") > 0)


@query("p02_utf16_offsets", f"""WITH {DOC_LINES} SELECT version_id, block_id,
 CAST(length(substring(canonical_text, 1, start)) + len(regexp_extract_all(substring(canonical_text, 1, start), '[\\x{{10000}}-\\x{{10FFFF}}]')) AS INTEGER) AS utf16_start
 FROM blocks JOIN blocks_doc USING (version_id)""")
def _(t):
    return ir.source_map(doc_lines(t), origin=True).select("version_id", "block_id", "utf16_start")


@query("p03_byte_offsets", f"""WITH {DOC_LINES} SELECT version_id, block_id, start, "end", CAST(strlen(substring(canonical_text, 1, start)) AS INTEGER) AS byte_start,
 CAST(strlen(substring(canonical_text, 1, "end")) AS INTEGER) AS byte_end FROM blocks JOIN blocks_doc USING (version_id)""")
def _(t):
    return ir.source_map(doc_lines(t), origin=True).select("version_id", "block_id", "start", "end", "byte_start", "byte_end")


@query("s09_ir_round_trip", f"""WITH {CONTRACT_BLOCKS} SELECT version_id, canonical_text, CAST(count(*) AS INTEGER) AS blocks,
 CAST(sum(start + "end") AS BIGINT) AS offset_sum FROM blocks JOIN blocks_doc USING (version_id) GROUP BY version_id, canonical_text""")
def _(t):
    docs = contract_docs(t).select("version_id", "canonical_text", "blocks")
    back = ir.from_json_document(ir.to_json_document(docs), docs.schema)
    total = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + b["start"] + b["end"])
    return back.select("version_id", "canonical_text", F.size("blocks").alias("blocks"), total.alias("offset_sum"))
