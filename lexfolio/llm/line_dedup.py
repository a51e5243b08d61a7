"""Line deduplication by a deletion-neighbourhood join, natively in Spark SQL.

Lines within one edit (a character inserted, deleted or replaced) have a variant in common
among the line itself and the line with one character deleted. A line emits its variants as
hashed keys, equal keys are joined, the edit distance is verified, and a line with an
earlier one that near is removed; equal lines keep the earliest.

Long lines would emit a key a character. One edit leaves the first or the second half of
the shorter line in place, and again one half of the rest, and so on. So variants are
emitted only by lines that share all but an eighth with another one, and only over that
eighth. Equal lines are known by 128 bits of hashes; near candidates are verified on their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfolio.session import materialize


#: A place in the order of lines: the document, its row (by a hash of the text), the line number.
PLACE = ("doc_id", "row", "at")


def _row_key() -> Column:
    """What tells rows of one doc_id apart: 128 bits of their texts."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, at (line number from 0), line (trimmed) for the lines that are not blank."""
    each = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    return each.select(*PLACE, F.trim("line").alias("line")).filter("line != ''")


def _halved(steps: int) -> Column:
    """Keys of what a line may share with one within an edit, after ``steps`` halvings.

    An entry pins the length of the shorter line, then of its unshared rest. One edit leaves
    the front or the back half of that rest in place: the half enters the key, the other
    half is the next rest (from ``s``, ``r`` characters here, ``m`` in the shorter line).
    """
    line, n = F.col("line"), F.length("line")

    def entry(s, r, m, h):
        return F.struct(s.cast("int").alias("s"), r.cast("int").alias("r"), m.cast("int").alias("m"), h.alias("h"))

    def split(e: Column) -> Column:
        front = F.shiftright(e["m"], 1)
        back = e["m"] - front
        return F.array(
            entry(e["s"] + front, e["r"] - front, e["m"] - front, F.xxhash64(e["h"], F.lit("front"), F.substring(line, e["s"], front))),
            entry(e["s"], e["r"] - back, e["m"] - back, F.xxhash64(e["h"], F.lit("back"), F.substring(line, e["s"] + e["r"] - back, back))),
        )

    keys = F.array(*[entry(F.lit(1), n, m, F.xxhash64(m)) for m in (n, n - 1)])
    for _ in range(steps):
        keys = F.flatten(F.transform(keys, split))
    return keys


def _variants(rest: Column) -> Column:
    """Hashes of a string and of it with each one character deleted."""
    size = F.length(rest)
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        lambda i: F.xxhash64(F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, size))),
    )
    return F.array_distinct(F.concat(F.array(F.xxhash64(rest)), cut))


def _shared(keyed: DataFrame, key: str) -> DataFrame:
    """Rows (x, key) whose key another x has as well."""
    same = Window.partitionBy(key)
    return keyed.withColumn("_low", F.min("x").over(same)).withColumn("_high", F.max("x").over(same)).filter("_low != _high").drop("_low", "_high")


def near_lines(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """x, y of the line classes (x, y, place of the earliest, halves) that have an earlier different one within one edit.

    Only hashes are shuffled until few lines are left; then their variants are keys as well.
    """
    halves = classes.select("x", F.explode("halves").alias("half"))
    ids = _shared(halves, "half").select("x").distinct()
    texts = lines.join(ids, "x").join(classes.select("x", "y", "first"), ["x", "y"]).filter(F.struct(*PLACE) == F.col("first"))
    # a row that is stored twice holds its lines twice at one place
    kept = materialize(texts.select("x", "y", "line", "first").dropDuplicates(["x", "y"]), "lines")
    eighths = kept.select("x", F.posexplode(_halved(3)["h"]).alias("i", "key"))
    emitting = _shared(eighths, "key").distinct()
    rest = F.element_at(_halved(3), F.col("i") + 1)
    emitted = kept.join(emitting, "x").withColumn("e", rest).select(
        "x", "key", F.explode(_variants(F.substring(F.col("line"), F.col("e.s"), F.col("e.r")))).alias("variant")
    )
    keyed = materialize(_shared(emitted.select("x", F.xxhash64("key", "variant").alias("key")), "key").distinct(), "variants")
    pairs = keyed.join(keyed.select("key", F.col("x").alias("x_b")), "key").filter("x < x_b").select("x", "x_b").distinct()
    a = kept.select("x", F.struct("x", "y").alias("id_a"), F.col("line").alias("l_a"), F.col("first").alias("f_a"))
    b = kept.select(F.col("x").alias("x_b"), F.struct("x", "y").alias("id_b"), F.col("line").alias("l_b"), F.col("first").alias("f_b"))
    near = pairs.join(a, "x").join(b, "x_b").filter(F.levenshtein("l_a", "l_b", 1) >= 0)
    return near.select(F.when(F.col("f_a") < F.col("f_b"), F.col("id_b")).otherwise(F.col("id_a")).alias("id")).select("id.*").distinct()


def dedupe(docs: DataFrame, edits: int = 1) -> DataFrame:
    """``docs`` with ``text`` rid of its repeated lines, n_lines and n_removed added.

    Order of lines: by doc_id, then by row where rows share a doc_id (a hash of the text
    orders those), then by place. Of equal lines (spaces at the ends aside) the earliest stays.
    A line also goes if an earlier different line, of any length, is within ``edits`` (0 or 1;
    other bounds raise). A carriage return counts as a character. Blank lines stay as they are.
    Null texts stay null, with 0 lines. Rows without doc_id stay whole and take no part. Rows
    of one doc_id and one text are the same row stored again: each gets the same text.
    """
    if edits not in (0, 1):
        raise ValueError(f"edits must be 0 or 1, not {edits}")
    lines = lines_of(docs).withColumn("x", F.xxhash64("line")).withColumn("y", F.xxhash64(F.lit(1), "line"))
    # copies fold into classes with their earliest place before the shuffle; texts stay where they are
    halves = _halved(1)["h"] if edits else F.array().cast("array<long>")
    summary = (F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"), F.any_value(halves).alias("halves"))
    classes = materialize(lines.groupBy("x", "y").agg(*summary), "classes")
    again = classes.filter("n > 1").select("x", "y", "first")
    if edits:
        gone = near_lines(lines, classes).withColumn("gone", F.lit(True))
        again = again.join(gone, ["x", "y"], "full")
    else:
        again = again.withColumn("gone", F.lit(None).cast("boolean"))
    drop = (
        lines.select(*PLACE, "x", "y")
        .join(materialize(again, "repeats"), ["x", "y"])
        .filter(F.coalesce("gone", F.lit(False)) | (F.struct(*PLACE) != F.col("first")))
        .groupBy(F.col("doc_id").alias("_drop_doc"), F.col("row").alias("_drop_row"))
        .agg(F.collect_set("at").alias("_drop_lines"))  # at most the lines of one text
    )
    joined = docs.join(drop, (F.col("doc_id").cast("long") == F.col("_drop_doc")) & (_row_key() == F.col("_drop_row")), "left")
    split = F.split("text", "\n")
    kept = F.filter(split, lambda line, i: ~F.array_contains("_drop_lines", i))
    text = F.when(F.col("_drop_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, lambda line: F.trim(line) != "")), F.lit(0))
    kept_columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*kept_columns, n_lines.alias("n_lines"), F.coalesce(F.size("_drop_lines"), F.lit(0)).alias("n_removed"))
