"""SpotSigs fingerprints, natively in Spark SQL.

A spot is a common word (an anchor) with the next content words after it; common words in
between are skipped. A text's fingerprint is the set of its spots, hashed. Two texts are
alike by the Jaccard similarity of their sets. For joins, texts are dealt out by set length:
only texts whose lengths are within the threshold of each other can match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfolio.llm.common import shuffle_partitions

#: Common words of four languages (fixed values).
ANCHORS = tuple(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "aber als auch auf das dem den der des die ein eine einen für im ist mit nicht sich und von zu "
    "au aux avec ce dans des du elle en est et il la le les pas pour que qui sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y".split()
)
_MARK = "\u0001"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spots(text: Column, chain: int = 2) -> Column:
    """Sorted distinct 32-bit hashes of the spots of a text (null: empty).

    An anchor starts a spot where a content word follows at once and ``chain`` content words
    follow in all. A text without any spot has its whole words as its only one, so that short
    texts are alike only when they are equal; a text without words has the empty set.
    """
    words = _words(F.coalesce(text, F.lit("")))
    marked = F.concat_ws(" ", F.transform(words, lambda w: F.when(w.isin(*ANCHORS), F.concat(F.lit(_MARK), w)).otherwise(w)))
    # possessive loops: no recursion on long runs, no second try
    follow = f"(?: {_MARK}[^ ]++)*+ [^ {_MARK}][^ ]*+"
    pattern = f"{_MARK}(?=([^ ]++ [^ {_MARK}][^ ]*+{follow * (chain - 1)}))"
    found = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
    sets = F.array_sort(F.array_distinct(F.transform(found, lambda s: F.hash(F.regexp_replace(s, f" {_MARK}[^ ]++", "")))))
    whole = F.when(F.length(marked) > 0, F.array(F.hash(marked))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(sets) > 0, sets).otherwise(whole)


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two spot sets; two empty sets are equal: 1."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def written(sets: Column) -> Column:
    """A spot set as text: eight hexadecimal digits a spot, in order."""
    return F.concat_ws("", F.transform(sets, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def near_pairs(docs: DataFrame, threshold: float = 0.75, chain: int = 2) -> DataFrame:
    """Pairs of distinct spot sets (class ids a < b, the smallest doc_id of each) with similarity of ``threshold`` or more.

    Equal sets are one class, so copies never meet in pairs. Classes are dealt by set length
    into ranges that grow by 1/threshold; a class can only match its own range and the next.
    Within them, two sets must share one of the first  n - ceil(threshold n) + 1  spots of
    an order from rare to frequent.
    """
    sets = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", spots(F.col("text"), chain).alias("spots"))
    classes = sets.filter(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("spots"))
    each = classes.select("id", "n", F.explode("spots").alias("spot"))
    often = each.groupBy("spot").agg(F.count("*").alias("often"))
    ordered = each.join(often.filter("often > 1"), "spot")
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "spot")) + (F.col("n") - F.count("*").over(Window.partitionBy("id")))
    first = ordered.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0) / F.log(F.lit(1 / threshold)))
    dealt = first.withColumn("part", part.cast("int"))
    a = dealt.select("spot", "part", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"))
    b = dealt.select("spot", F.explode(F.array(F.col("part"), F.col("part") + 1, F.col("part") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"))
    needed = (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold))
    room = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) + F.least("p_a", "p_b")
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (room >= needed - 1e-9)
    pairs = a.join(b, ["spot", "part"]).filter(fits).select("a", "b").distinct()
    left = classes.select(F.col("id").alias("a"), F.col("spots").alias("s_a"))
    right = classes.select(F.col("id").alias("b"), F.col("spots").alias("s_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("s_a"), F.col("s_b")).alias("score")).filter(F.col("score") >= threshold)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The digest over documents: each text, its edited text and the next document, in fingerprints.

    Rows without a doc_id are no documents and are left out; rows that share one follow each
    other by text. The order of documents is cut into ranges by ids of the table; the first
    row of a range is also dealt to the range before, and the very first to the last, so each
    range knows what follows its last row.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * shuffle_partitions(docs.sparkSession)
    cut = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()
    starts = sorted({cut[0], *(cut[1] or [])} - {None})
    bounds = F.array(*[F.lit(s).cast("long") for s in starts])
    part = F.greatest(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0))
    own = F.struct(part.alias("part"), F.lit(0).alias("after"))
    before = F.struct(F.when(part == 0, F.lit(max(0, len(starts) - 1))).otherwise(part - 1).alias("part"), F.when(part == 0, 2).otherwise(1).alias("after"))
    dealt = rows.withColumn("spots", spots(F.col("text"))).withColumn(
        "at", F.explode(F.when(F.col("doc_id").isin(starts), F.array(own, before)).otherwise(F.array(own)))
    )
    order = Window.partitionBy("at.part").orderBy("at.after", "doc_id", "text")
    placed = dealt.withColumn("next", F.lead(F.struct("text", "spots")).over(order)).filter(F.col("at.after") == 0)
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (size - half)), F.substring(F.col("next.text"), F.lit(1), half))
    return (
        placed.select("doc_id", "spots", size.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next.spots").alias("next_spots"))
        .withColumn("edited_spots", spots(F.col("edited")))
        .select(
            "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            written(F.col("spots")).alias("fingerprint"), written(F.col("edited_spots")).alias("edited_fingerprint"),
            likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        )
    )
