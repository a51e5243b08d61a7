"""Document representation: blocks, canonical text, source map, pages.

A document is one row and its blocks are an array in that row, so building,
offsetting and re-joining text are narrow steps without a shuffle. ``block_rows``
flattens to one row per block where a flat table is wanted. Offsets are 0-based,
half-open and count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import let, running_starts, unnest
from lexfolio.functions.text import clean_spacing, compose_unicode, slice_text, squeeze_ends, tidy_blocks, unclean_spacing

BLANK_LINE = r"\r?\n\r?\n"
LINE = r"\r?\n"

BLOCK = T.StructType([
    T.StructField("block_index", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("block_type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("is_ocr", T.BooleanType()),
])


def text_blocks(text: Column, separator: str = BLANK_LINE, tidy: bool = False) -> Column:
    """Split text into typed blocks; the index counts empty pieces as well.

    ``tidy`` says that ``tidy_blocks`` holds for the text, so that no piece needs a second look.
    """

    def block(piece: Column, i: Column, dirty: Column | None = None) -> Column:
        heading = F.startswith(piece, F.lit("#"))
        # a marker and one space decide; an anchored pattern would be tried at every character of the piece
        bullet = F.left(piece, F.lit(2)).rlike(lx.BULLET_LINE)
        return F.struct(
            i.cast("int").alias("block_index"),
            F.lit(1).alias("page_number"),
            F.when(heading, "heading").when(bullet, "list_item").otherwise("paragraph").alias("block_type"),
            (piece if dirty is None else F.when(dirty, clean_spacing(piece)).otherwise(piece)).alias("text"),
            F.when(heading, F.length(F.regexp_extract(piece, r"^#+", 0))).when(bullet, 1).alias("level"),
            F.lit(1.0).alias("confidence"),
            F.lit(False).alias("is_ocr"),
        )

    def build(t: Column) -> Column:
        pieces = F.transform(F.split(t["text"], separator, -1), squeeze_ends)
        return F.filter(F.transform(pieces, lambda p, i: block(p, i, t["dirty"])), lambda b: b["text"] != "")

    if tidy:
        return F.transform(F.split(text, "\n\n", -1), lambda p, i: block(p, i))
    # One scan of the text tells whether any block needs its spacing cleaned.
    return let(F.struct(text.alias("text"), unclean_spacing(text).alias("dirty")), build)


def separator_before(block_type: Column, i: Column) -> Column:
    tight = block_type.isin("list_item", "table_row", "table_cell")
    return F.when(i == 0, "").when(tight, "\n").otherwise("\n\n")


def place_blocks(blocks: Column, boxes: bool = False) -> Column:
    """Blocks in reading order -> struct(canonical_text, blocks with start and end), and their ``bbox`` where they have one."""

    def build(bs: Column) -> Column:
        lengths = F.transform(
            bs, lambda b, i: F.length(separator_before(b["block_type"], i)) + F.length(b["text"])
        )
        return let(
            running_starts(lengths),
            lambda begins: F.struct(
                F.array_join(
                    F.transform(bs, lambda b, i: F.concat(separator_before(b["block_type"], i), b["text"])), ""
                ).alias("canonical_text"),
                F.transform(
                    bs,
                    lambda b, i: let(
                        F.get(begins, i) + F.length(separator_before(b["block_type"], i)),
                        lambda start: F.struct(
                            b["block_index"].alias("block_index"),
                            F.concat(F.lit("b"), b["block_index"].cast("string")).alias("block_id"),
                            b["page_number"].alias("page_number"),
                            b["block_type"].alias("block_type"),
                            b["text"].alias("text"),
                            b["level"].alias("level"),
                            b["confidence"].alias("confidence"),
                            b["is_ocr"].alias("is_ocr"),
                            start.alias("start"),
                            (start + F.length(b["text"])).alias("end"),
                            *([b["bbox"].alias("bbox")] if boxes else []),
                        ),
                    ),
                ).alias("blocks"),
            ),
        )

    return let(blocks, build)


def placed_documents(docs: DataFrame, text: str = "text", separator: str = BLANK_LINE) -> DataFrame:
    """Composed text rows with ``_placed``: ``place_blocks`` of the text, null where its blocks are tidy as they stand."""
    composed = docs.withColumn(text, compose_unicode(F.col(text)))
    placed = place_blocks(text_blocks(F.col(text), separator))
    if separator == BLANK_LINE:
        placed = F.when(F.coalesce(tidy_blocks(F.col(text)), F.lit(False)), None).otherwise(placed)
    return composed.withColumn("_placed", placed)


def placed_text(text: str = "text") -> Column:
    """Canonical text of ``placed_documents``; tidy text only loses half of the blank lines before list items."""
    return F.when(F.col("_placed").isNull(), F.regexp_replace(text, lx.BULLET_BREAK, "\n")).otherwise(F.col("_placed.canonical_text"))


def placed_blocks(text: str = "text") -> Column:
    """Placed blocks of ``placed_documents``."""
    own = place_blocks(text_blocks(F.col(text), tidy=True))["blocks"]
    return F.when(F.col("_placed").isNull(), own).otherwise(F.col("_placed.blocks"))


def canonical_documents(docs: DataFrame, text: str = "text", separator: str = BLANK_LINE) -> DataFrame:
    """Raw text rows -> rows with ``canonical_text`` and ``blocks``; no shuffle."""
    placed = placed_documents(docs, text, separator)
    tidy = separator == BLANK_LINE
    return placed.select(
        *[F.col(c) for c in docs.columns if c != text],
        (placed_text(text) if tidy else F.col("_placed.canonical_text")).alias("canonical_text"),
        (placed_blocks(text) if tidy else F.col("_placed.blocks")).alias("blocks"),
    )


_BOX = {n: f"bbox_{n}" for n in ("x", "y", "width", "height")}


def canonical_from_blocks(blocks: DataFrame, key: str = "version_id") -> DataFrame:
    """Flat block rows of paged documents -> one canonical row per document.

    Needs ``page_number``, ``reading_order`` and the fields of ``BLOCK``. One
    document's text is one value, so its blocks meet in one row by definition. Boxes in columns
    bbox_x, bbox_y, bbox_width and bbox_height become a ``bbox`` of the blocks.
    """
    boxes = set(_BOX.values()) <= set(blocks.columns)
    item = F.struct(
        "page_number", "reading_order", *[f.name for f in BLOCK.fields if f.name != "page_number"],
        *([F.struct(*[F.col(c).cast("double").alias(n) for n, c in _BOX.items()]).alias("bbox")] if boxes else []),
    )
    rows = blocks.withColumn("text", clean_spacing(compose_unicode(F.col("text")))).filter(F.col("text") != "")
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    placed = grouped.withColumn("_placed", place_blocks(F.col("_items"), boxes))
    return placed.select(
        key, F.col("_placed.canonical_text").alias("canonical_text"), F.col("_placed.blocks").alias("blocks")
    )


def block_rows(canonical: DataFrame, *keep: str) -> DataFrame:
    """One row per block."""
    return unnest(canonical, F.col("blocks"), *keep).select(*keep, "_item.*")


def source_map(canonical: DataFrame, key: str = "version_id", origin: bool = False) -> DataFrame:
    """Block id, page, interval, OCR flag and confidence per block.

    With ``origin`` also the interval in UTF-8 bytes and UTF-16 units of the canonical text, and
    ``bbox``, null for blocks without a box. Separators are ASCII, so a block's offset grows by
    what the texts of earlier blocks take beyond one unit a character: one prefix sum a document.
    """
    plain = ["block_id", "page_number", "start", "end", "is_ocr", "confidence"]
    if not origin:
        return block_rows(canonical, key).select(key, *plain)
    has_box = "bbox" in canonical.schema["blocks"].dataType.elementType.names
    box = F.col("_b.bbox") if has_box else F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")
    sizes = {"byte": F.octet_length, "utf16": lambda text: (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")}

    def beyond(size) -> Column:
        return running_starts(F.transform("blocks", lambda b: size(b["text"]) - F.length(b["text"])))

    rows = canonical.select(key, "blocks", *[beyond(size).alias(name) for name, size in sizes.items()]).select(key, F.explode(F.arrays_zip("blocks", *sizes)).alias("_z"))
    flat = rows.select(key, F.col("_z.blocks").alias("_b"), *[F.col(f"_z.{name}").alias(name) for name in sizes])
    starts = {name: F.col("_b.start") + F.col(name) for name in sizes}
    return flat.select(
        key, *[F.col(f"_b.{c}").alias(c) for c in plain],
        *[c for name, size in sizes.items() for c in (starts[name].alias(f"{name}_start"), (starts[name] + size(F.col("_b.text"))).alias(f"{name}_end"))],
        box.alias("bbox"),
    )


def page_rollup(pages: DataFrame) -> DataFrame:
    """Fill the page defaults: one column, reading-order confidence 1."""
    return pages.withColumns({
        "column_count": F.coalesce(F.col("column_count"), F.lit(1)),
        "reading_order_confidence": F.coalesce(F.col("reading_order_confidence"), F.lit(1.0)),
    })


def to_json_document(canonical: DataFrame, key: str = "version_id") -> DataFrame:
    """Serialise each document to one JSON string."""
    return canonical.select(key, F.to_json(F.struct(key, "canonical_text", "blocks")).alias("ir_json"))


def from_json_document(rows: DataFrame, schema: str | T.StructType, key: str = "version_id") -> DataFrame:
    """Parse serialised documents, failing on malformed input."""
    parsed = rows.select(F.from_json("ir_json", schema, {"mode": "FAILFAST"}).alias("_d"))
    return parsed.select("_d.*")


def cut_by_spans(docs: DataFrame, spans: DataFrame, key: str = "version_id") -> DataFrame:
    """Cut each text into plain and cited pieces.

    Invalid spans are dropped, overlaps are clipped to the running end, and spans
    fully covered by earlier ones vanish. Spans of one document are bounded by its
    text length after de-duplication, so they fold inside the document's row.
    """
    cited = spans.filter((F.col("start") >= 0) & (F.col("start") < F.col("end"))).groupBy(key, "start", "end").agg(
        F.min("citation_id").alias("citation_id")
    )
    per_doc = cited.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "citation_id"))).alias("_spans")
    )
    state = "struct<at:int,pieces:array<struct<start:int,end:int,citation_id:string>>>"

    def step(acc: Column, s: Column) -> Column:
        plain = F.when(
            s["start"] > acc["at"],
            F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"), F.lit(None).cast("string").alias("citation_id"))),
        ).otherwise(F.array().cast("array<struct<start:int,end:int,citation_id:string>>"))
        cited_piece = F.when(
            s["end"] > acc["at"],
            F.array(F.struct(F.greatest(acc["at"], s["start"]).alias("start"), s["end"].alias("end"), s["citation_id"].alias("citation_id"))),
        ).otherwise(F.array().cast("array<struct<start:int,end:int,citation_id:string>>"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["pieces"], plain, cited_piece).alias("pieces"),
        )

    empty = F.array().cast("array<struct<start:int,end:int,citation_id:string>>")
    folded = docs.join(per_doc, key, "left").withColumn(
        "_f",
        F.aggregate(
            F.filter(F.coalesce(F.col("_spans"), empty), lambda s: s["end"] <= F.length("canonical_text")),
            F.struct(F.lit(0).alias("at"), empty.alias("pieces")).cast(state),
            lambda acc, s: step(acc, s).cast(state),
        ),
    )
    tail = F.when(
        F.col("_f.at") < F.length("canonical_text"),
        F.array(F.struct(F.col("_f.at").alias("start"), F.length("canonical_text").alias("end"), F.lit(None).cast("string").alias("citation_id"))),
    ).otherwise(empty)
    return folded.select(
        key, "canonical_text", F.posexplode(F.concat("_f.pieces", tail)).alias("piece_index", "_p")
    ).select(
        key,
        "piece_index",
        F.col("_p.start").alias("start"),
        F.col("_p.end").alias("end"),
        F.col("_p.citation_id").alias("citation_id"),
        slice_text(F.col("canonical_text"), F.col("_p.start"), F.col("_p.end")).alias("text"),
    )
