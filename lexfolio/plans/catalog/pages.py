"""Page layout, OCR words and file intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.operators import ir, layout
from lexfolio.plans.catalog.corpus import CONTRACT_BLOCKS, contract_docs
from lexfolio.plans.registry import query
from lexfolio.session import materialize, scratch_path
from lexfolio.sources import corpora, files

IT = f"it AS ({corpora.TEXT_ITEMS_SQL})"
COLS = f"""{IT}, cc AS (SELECT version_id, page_number, CASE WHEN n >= 10 AND l > n * 0.25 AND r > n * 0.25 AND s < n * 0.1 THEN 2 ELSE 1 END AS column_count FROM (SELECT version_id, page_number, count(*) AS n, count(*) FILTER (x + width < 306 - 18.36) AS l, count(*) FILTER (x > 306 + 18.36) AS r,
 count(*) FILTER (x < 306 - 18.36 AND x + width > 306 + 18.36) AS s FROM it GROUP BY ALL))"""
ORD = f"""{COLS}, o1 AS (SELECT it.*, CASE WHEN column_count = 2 AND x >= 306 THEN 2 ELSE 1 END AS col FROM it JOIN cc USING (version_id, page_number)),
o2 AS (SELECT *, CASE WHEN lag(col) OVER w <> col OR lag(y) OVER w - y >= 4 THEN 1 ELSE 0 END AS nw FROM o1 WINDOW w AS (PARTITION BY version_id, page_number ORDER BY col, y DESC, x, item_no)),
o3 AS (SELECT *, sum(nw) OVER (PARTITION BY version_id, page_number ORDER BY col, y DESC, x, item_no ROWS UNBOUNDED PRECEDING) AS line FROM o2),
o AS (SELECT *, row_number() OVER (PARTITION BY version_id, page_number ORDER BY line, x, y DESC, item_no) AS ord FROM o3)"""
GRP = f"""{ORD}, g1 AS (SELECT *, CASE WHEN abs(lag(y) OVER (PARTITION BY version_id, page_number ORDER BY ord) - y) > 16 THEN 1 ELSE 0 END AS j FROM o WHERE trim(str) <> ''),
g2 AS (SELECT *, sum(j) OVER (PARTITION BY version_id, page_number ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM g1),
g3 AS (SELECT version_id, page_number, CAST(g + 1 AS INTEGER) AS reading_order, trim(string_agg(str, ' ' ORDER BY ord)) AS text, min(x / 612) AS x0, min((792 - y) / 792) AS y0, max(x / 612 + width / 612) AS x1, max((792 - y) / 792 + height / 792) AS y1 FROM g2 GROUP BY version_id, page_number, g),
gb AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^(SECTION|ARTICLE|\\d+(\\.\\d+)*)\\s+') OR (length(text) < 80 AND text = upper(text) AND regexp_matches(text, '[A-Z]')) THEN 'heading' WHEN regexp_matches(text, '^([•\\-*]|\\d+\\))\\s+') THEN 'list_item' ELSE 'paragraph' END AS block_type FROM g3)"""


@query("p05_column_detection", f"WITH {COLS} SELECT version_id, page_number, column_count, CASE WHEN column_count = 2 THEN 0.88::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM cc")
def _(t):
    return layout.page_columns(corpora.text_items(t))


@query("p06_reading_order", f"WITH {ORD} SELECT version_id, page_number, item_no, str, col AS \"column\", CAST(line AS BIGINT) AS line, CAST(ord AS INTEGER) AS \"order\" FROM o")
def _(t):
    return layout.reading_order(corpora.text_items(t)).select("version_id", "page_number", "item_no", "str", "column", F.col("line").cast("bigint").alias("line"), "order")


@query("p07_item_grouping", f"WITH {GRP} SELECT version_id, page_number, reading_order, text, block_type, round(x0, 4) AS bbox_x, round(y0, 4) AS bbox_y, round(greatest(0.01, x1 - x0), 4) AS bbox_width, round(greatest(0.01, y1 - y0), 4) AS bbox_height FROM gb")
def _(t):
    return layout.group_blocks(layout.reading_order(corpora.text_items(t))).drop("confidence", "is_ocr", "level")


@query("p08_running_lines", f"""WITH {GRP}, z AS (SELECT version_id, page_number, trim(str) AS text, CASE WHEN (792 - y) / 792 < 0.08 THEN 'header' WHEN (792 - y) / 792 > 0.92 THEN 'footer' END AS zone FROM it),
m AS (SELECT version_id, text, CASE WHEN count(*) FILTER (zone = 'header') >= 2 THEN 'header' ELSE 'footer' END AS mark FROM z WHERE zone IS NOT NULL AND length(text) >= 3 AND version_id IN (SELECT version_id FROM it GROUP BY version_id HAVING count(DISTINCT page_number) > 1)
 GROUP BY version_id, text HAVING count(*) FILTER (zone = 'header') >= 2 OR count(*) FILTER (zone = 'footer') >= 2)
SELECT version_id, page_number, reading_order, text, coalesce(mark, block_type) AS block_type FROM gb LEFT JOIN m USING (version_id, text)""")
def _(t):
    items = corpora.text_items(t)
    blocks = layout.group_blocks(layout.reading_order(items))
    return layout.label_running_lines(blocks, items).select("version_id", "page_number", "reading_order", "text", "block_type")


@query("p09_low_glyph_pages", f"WITH {IT} SELECT version_id, page_number, CAST(sum(length(str)) AS BIGINT) AS glyphs FROM it GROUP BY ALL HAVING sum(length(str)) < 50 UNION ALL SELECT DISTINCT version_id, 1000, 0 FROM it")
def _(t):
    items = corpora.text_items(t)
    scanned = items.select("version_id", F.lit(1000).alias("page_number"))  # a last page without text
    return layout.low_glyph_pages(items, pages=items.select("version_id", "page_number").union(scanned))


@query("p04_page_rollup", f"WITH {COLS} SELECT version_id, page_number, CASE WHEN page_number = 2 THEN 1 ELSE column_count END AS column_count, CASE WHEN page_number = 2 THEN 1.0::DOUBLE WHEN column_count = 2 THEN 0.88::DOUBLE ELSE 0.95::DOUBLE END AS reading_order_confidence FROM cc")
def _(t):
    pages = layout.page_columns(corpora.text_items(t)).withColumnRenamed("confidence", "reading_order_confidence")
    unknown = F.col("page_number") == 2
    return ir.page_rollup(pages.withColumns({c: F.when(~unknown, F.col(c)) for c in ("column_count", "reading_order_confidence")}))


@query("p10_heading_rule", f"""WITH {CONTRACT_BLOCKS} SELECT version_id, block_id, CASE WHEN block_type = 'paragraph' AND regexp_matches(text, '(?i)^(SECTION|ARTICLE|\\d+(\\.\\d+)*)\\s+') THEN 'heading' ELSE block_type END AS block_type,
 CASE WHEN block_type = 'paragraph' AND regexp_matches(text, '(?i)^(SECTION|ARTICLE|\\d+(\\.\\d+)*)\\s+') THEN 2 ELSE level END AS level FROM blocks""")
def _(t):
    return ir.block_rows(layout.retype_paragraphs(contract_docs(t)), "version_id").select("version_id", "block_id", "block_type", "level")


_CELLS = "SELECT CAST(l_suppkey AS STRING) AS version_id, CAST(l_orderkey AS INT) AS table_no, CAST(l_linenumber AS INT) AS row_no, CAST(l_partkey AS BIGINT) AS cell_no, CASE WHEN l_quantity < 5 THEN ' ' ELSE ' ' || l_returnflag || CAST(l_partkey AS STRING) END AS text FROM lineitem"


@query("p11_table_rows", f"SELECT version_id, table_no, row_no, string_agg(trim(text), ' | ' ORDER BY cell_no, trim(text)) AS text FROM ({_CELLS}) WHERE trim(text) <> '' GROUP BY ALL")
def _(t):
    return layout.table_rows(corpora.build(t, _CELLS, "lineitem"))


@query("p02_paged_document", f"""WITH {GRP}, s AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN block_type = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM gb WINDOW w AS (PARTITION BY version_id ORDER BY page_number, reading_order))
SELECT version_id, string_agg(sep || text, '' ORDER BY page_number, reading_order) AS canonical_text FROM s GROUP BY version_id""")
def _(t):
    blocks = layout.group_blocks(layout.reading_order(corpora.text_items(t))).withColumn("block_index", F.col("reading_order"))
    return ir.canonical_from_blocks(blocks).select("version_id", "canonical_text")


@query("p03_boxes", f"""WITH {GRP}, s AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN block_type = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM gb WINDOW w AS (PARTITION BY version_id ORDER BY page_number, reading_order)),
e AS (SELECT *, sum(length(sep) + length(text)) OVER w AS stop, sum(strlen(sep) + strlen(text)) OVER w AS byte_stop FROM s WINDOW w AS (PARTITION BY version_id ORDER BY page_number, reading_order ROWS UNBOUNDED PRECEDING))
SELECT version_id, page_number, 'b' || reading_order AS block_id, CAST(stop - length(text) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", CAST(byte_stop - strlen(text) AS INTEGER) AS byte_start, CAST(byte_stop AS INTEGER) AS byte_end,
 round(x0, 4) AS bbox_x, round(y0, 4) AS bbox_y, round(greatest(0.01, x1 - x0), 4) AS bbox_width, round(greatest(0.01, y1 - y0), 4) AS bbox_height FROM e""")
def _(t):
    blocks = layout.group_blocks(layout.reading_order(corpora.text_items(t))).withColumn("block_index", F.col("reading_order"))
    rows = ir.source_map(ir.canonical_from_blocks(blocks), origin=True)
    return rows.select("version_id", "page_number", "block_id", "start", "end", "byte_start", "byte_end", *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("x", "y", "width", "height")])


OCR = f"""ow AS ({corpora.OCR_WORDS_SQL}), al AS (SELECT * FROM ow UNION ALL SELECT DISTINCT version_id, 1, page_num, 0, 0, 0, 0, 0, 1000, 1400, -1.0, '' FROM ow WHERE page_num % 2 = 0)"""


@query("s11_ocr_blocks", f"""WITH {OCR}, sz AS (SELECT version_id, page_num, coalesce(max(CASE WHEN level = 1 THEN width END), 612) AS pw, coalesce(max(CASE WHEN level = 1 THEN height END), 792) AS ph FROM al GROUP BY ALL)
SELECT version_id, page_num AS page_number, block_num AS reading_order, string_agg(trim(text), ' ' ORDER BY word_num, trim(text)) AS text, round(min("left") / pw, 4) AS bbox_x, round(min(top) / ph, 4) AS bbox_y, round((max("left" + width) - min("left")) / pw, 4) AS bbox_width,
 round((max(top + height) - min(top)) / ph, 4) AS bbox_height, round(avg(least(1, greatest(0, conf / 100))), 3) AS confidence FROM al JOIN sz USING (version_id, page_num) WHERE level = 5 AND conf > 0 AND trim(text) <> '' GROUP BY version_id, page_num, block_num, pw, ph""")
def _(t):
    words = corpora.ocr_words(t)
    pages = words.filter(F.col("page_num") % 2 == 0).select("version_id", "page_num").distinct().selectExpr(
        "version_id", "1 AS level", "page_num", "0 AS block_num", "0 AS line_num", "CAST(0 AS BIGINT) AS word_num", "0 AS left", "0 AS top", "1000 AS width", "1400 AS height", "CAST(-1 AS DOUBLE) AS conf", "'' AS text")
    return layout.ocr_blocks(words.unionByName(pages)).drop("block_type", "is_ocr")


# File bodies from documents: the key decides the kind of file the bytes pretend to be.
_BODY = """CASE doc_id % 9 WHEN 0 THEN '%PDF-1.4 ' || text WHEN 1 THEN 'PK' || chr(3) || chr(4) || text WHEN 2 THEN chr(1) || text WHEN 3 THEN 'ab' WHEN 4 THEN '%PDF broken' WHEN 5 THEN '%PDF-1.7 ' || text || ' /Encrypt 5 0 R' WHEN 6 THEN '' WHEN 7 THEN chr(27) || chr(9) || text ELSE text END"""
_TYPE = f"CASE doc_id % 9 WHEN 1 THEN '{lx.DOCX_TYPE}' WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN '{lx.TEXT_TYPE}' WHEN 8 THEN CASE WHEN octet_length(encode(text)) < 4 THEN NULL ELSE '{lx.TEXT_TYPE}' END ELSE '{lx.PDF_TYPE}' END"


def bodies(t):
    return t.spread("documents").select("doc_id", "source", F.encode(F.expr(_BODY), "UTF-8").alias("content"))


@query("s02_file_triage", f"SELECT doc_id, {_TYPE} AS media_type FROM documents")
def _(t):
    return bodies(t).select("doc_id", files.media_type(F.col("content")).alias("media_type"))


@query("s03_admission_checks", f"""SELECT doc_id, {_TYPE} AS media_type, CASE WHEN octet_length(encode({_BODY})) < 4 THEN 'CORRUPT_DOCUMENT' WHEN octet_length(encode({_BODY})) > 20000 THEN 'FILE_TOO_LARGE' WHEN doc_id % 9 IN (1, 2) THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN doc_id % 9 = 4 THEN 'CORRUPT_DOCUMENT' WHEN doc_id % 9 = 5 THEN 'ENCRYPTED_DOCUMENT' END AS error_code FROM documents""")
def _(t):
    return files.admit(bodies(t), allowed=(lx.PDF_TYPE, lx.TEXT_TYPE), max_bytes=20000).select("doc_id", "media_type", "error_code")


@query("s04_content_dedup", f"SELECT sha256(b) AS sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS copies, max(octet_length(b)) AS byte_size FROM (SELECT doc_id, source, encode(text) AS b FROM documents) GROUP BY sha256(b)")
def _(t):
    rows = t.spread("documents").select("doc_id", "source", F.encode("text", "UTF-8").alias("content"))
    return files.distinct_contents(rows, "doc_id", "source").withColumn("byte_size", F.col("byte_size").cast("bigint"))


@query("s05_blob_lookup", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def _(t):
    rows = t.spread("documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))
    stored = files.distinct_contents(rows.filter(F.col("lang") == "en"), "doc_id")
    return files.known_contents(rows, stored).select("doc_id")


@query("s05_blob_metadata", f"""WITH b AS (SELECT doc_id, lang, {_BODY} AS body, {_TYPE} AS media_type FROM documents),
k AS (SELECT sha256(body) AS sha256, min(doc_id) AS first_id, max(octet_length(encode(body))) AS byte_size, arg_min(coalesce(media_type, 'application/octet-stream'), doc_id) AS media_type FROM b GROUP BY ALL)
SELECT sha256, CAST(byte_size AS BIGINT) AS byte_size, media_type, first_id AS stored_at FROM k WHERE sha256 IN (SELECT sha256(body) FROM b WHERE lang = 'en')""")
def _(t):
    rows = bodies(t).join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("media_type", files.media_type(F.col("content")))
    stored = files.distinct_contents(rows, "doc_id", "media_type").withColumnRenamed("doc_id", "stored_at")
    asked = rows.filter("lang = 'en'").select(files.content_key(F.col("content")).alias("sha256"))
    return files.blob_metadata(asked, stored).withColumn("byte_size", F.col("byte_size").cast("bigint"))


@query("s06_document_write", f"WITH {CONTRACT_BLOCKS} SELECT version_id, playbook AS workspace_id, CAST(count(*) AS BIGINT) AS blocks, sha256(canonical_text) AS sha256 FROM blocks JOIN blocks_doc USING (version_id) JOIN contracts USING (version_id) GROUP BY version_id, playbook, canonical_text")
def _(t):
    path = scratch_path(t.spark, "documents")
    files.write_documents(contract_docs(t).withColumnRenamed("playbook", "workspace_id"), path)
    blocks = files.read_blocks(t.spark, path).groupBy("version_id").agg(F.count("*").alias("blocks"))
    return t.spark.read.parquet(f"{path}/versions").join(blocks, "version_id").select("version_id", "workspace_id", "blocks", "sha256")


@query("s06_partition_rewrite", f"""WITH {CONTRACT_BLOCKS} SELECT version_id, playbook AS workspace_id, CAST(count(*) + CASE WHEN playbook = 'nda' THEN 1 ELSE 0 END AS BIGINT) AS blocks,
 sha256(canonical_text || CASE WHEN playbook = 'nda' THEN chr(10) || chr(10) || 'Amended.' ELSE '' END) AS sha256, playbook = 'services' AND ends_with(version_id, '3') AS is_deleted, playbook <> 'nda' AS same_version_file, playbook NOT IN ('nda', 'services') AS same_document_file
 FROM blocks JOIN blocks_doc USING (version_id) JOIN contracts USING (version_id) GROUP BY version_id, playbook, canonical_text""")
def _(t):
    # One workspace is deleted from and another published anew, both twice; the files of the others stay as they are.
    path = scratch_path(t.spark, "rewrite")
    texts = corpora.contracts(t).withColumnRenamed("playbook", "workspace_id")
    files.write_documents(ir.canonical_documents(texts), path)

    def held(name):
        return t.spark.read.parquet(f"{path}/{name}").select("version_id", F.col("_metadata.file_path").alias(name))

    before = materialize(held("versions").join(held("documents"), "version_id"), "files")
    amended = texts.filter("workspace_id = 'nda'").withColumn("text", F.concat("text", F.lit("\n\nAmended.")))
    gone = texts.filter("workspace_id = 'services' AND version_id LIKE '%3'").select("workspace_id", "version_id", F.to_timestamp(F.lit("2024-05-01")).alias("deleted_at"))
    for _ in range(2):
        files.republish_documents(ir.canonical_documents(amended), path)
        files.delete_documents(gone, path)
    blocks = files.read_blocks(t.spark, path).groupBy("version_id").agg(F.count("*").alias("blocks"))
    now = t.spark.read.parquet(f"{path}/versions").select("version_id", "workspace_id", "sha256", F.col("_metadata.file_path").alias("v"))
    documents = t.spark.read.parquet(f"{path}/documents").select("version_id", "is_deleted", F.col("_metadata.file_path").alias("d"))
    return now.join(documents, "version_id").join(blocks, "version_id").join(before, "version_id").select(
        "version_id", "workspace_id", "blocks", "sha256", "is_deleted", (F.col("v") == F.col("versions")).alias("same_version_file"),
        (F.col("d") == F.col("documents")).alias("same_document_file"))
