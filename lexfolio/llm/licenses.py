"""License scan, natively in Spark SQL: an exact set-similarity join of text blocks with license templates.

A block is a window of words, half as long again as the template, at any place of a text;
line breaks neither cut nor widen it. It meets a template when it holds at least
``threshold`` of the template's words (containment). Words are put in one global order,
from rare to frequent over all documents; a text with a block that meets a template must
hold one of the template's first  n - ceil(threshold n) + 1  words, which makes the join
candidates. The length filter leaves out texts with too few words, the positional filter
those that first meet a template too late in its order. The windows of what is left are
verified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfolio.functions.arrays import let

#: Phrases of the base labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: License notices as they are commonly written (fixed values): label and words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
)
#: A word of a text whose capitals are not yet lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(text: Column) -> Column:
    """Words of a text in lower-case ASCII, one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAP, " ")), F.lit(" "))


def _most_in_window(text: Column, words: Column, span: Column) -> Column:
    """The most distinct ``words`` that any ``span`` successive words of a text hold."""
    every = F.filter(F.split(_plain(text), " "), lambda w: w != "")
    hits = F.filter(F.transform(every, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(words, x["w"]))
    # a window with the most begins at a hit and has at most ``span`` of them
    held = lambda at: F.transform(at, lambda x, k: F.filter(F.slice(at, k + 1, span), lambda y: y["i"] < x["i"] + span))
    return let(hits, lambda at: F.array_max(F.transform(held(at), lambda h: F.size(F.array_distinct(F.transform(h, lambda y: y["w"]))))))


def matches(docs: DataFrame, row: list[str], templates=TEMPLATES, threshold: float = 0.9, stretch: float = 1.5) -> DataFrame:
    """``row`` columns, label and containment of every (row, template) that meets the threshold.

    ``templates``: (label, words) pairs. The words are looked for in windows of ``stretch`` times
    the template's length, the best one counts. Null and empty texts have no windows. Repeated
    rows repeat their matches.
    """
    spark = docs.sparkSession
    sets = [(i, label, sorted(set(words.split())), math.ceil(stretch * len(words.split()))) for i, (label, words) in enumerate(templates)]
    vocabulary = sorted({w for _, _, s, _ in sets for w in s})
    # words of templates alone matter to prefixes and overlaps
    held = docs.select(*row, F.col("text").alias("_text"), F.array_distinct(F.filter(F.split(_plain(F.col("text")), " "), lambda w: w.isin(vocabulary))).alias("words"))
    shortest = min(-(-len(s) * int(round(threshold * 1000)) // 1000) for _, _, s, _ in sets)
    blocks = held.filter(F.size("words") >= shortest)
    often = {r[0]: r[1] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect()}  # template words only
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for i, label, words, span in sets:
        by_rank = sorted(words, key=rank.__getitem__)
        need = -(-len(words) * int(round(threshold * 1000)) // 1000)
        for place, w in enumerate(by_rank[: len(words) - need + 1]):
            prefixes.append((w, place, i, label, by_rank, need, span))
    index = spark.createDataFrame(prefixes, "w string, place int, template int, label string, template_words array<string>, need int, span int")
    first = sorted({p[0] for p in prefixes})
    probes = blocks.withColumn("w", F.explode(F.filter("words", lambda w: w.isin(first))))
    met = (
        probes.join(F.broadcast(index), "w")  # a few words a template
        .filter((F.size("words") >= F.col("need")) & (F.size("template_words") - F.col("place") >= F.col("need")))
        # the first word in common alone speaks for the pair
        .filter(F.array_position("template_words", F.col("w")) == F.array_min(F.transform(F.array_intersect("template_words", "words"), lambda x: F.array_position("template_words", x))))
        .filter(F.size(F.array_intersect("words", "template_words")) >= F.col("need"))
    )
    most = _most_in_window(F.col("_text"), F.col("template_words"), F.col("span"))
    return met.withColumn("_most", most).filter(F.col("_most") >= F.col("need")).select(*row, "label", (F.col("_most") / F.size("template_words")).alias("containment"))


def _places(phrase: str) -> dict[str, Column]:
    """Count, smallest and largest start (in words) of a phrase in ``plain``, spaces around each word."""
    plain, here = F.col("plain"), f" {phrase} "
    first = F.instr(plain, here)
    back = F.instr(F.reverse(plain), here[::-1])
    before_last = F.length(plain) - back - len(here) + 2
    spaces = lambda upto: F.length(F.regexp_replace(F.substring(plain, F.lit(1), upto), "[^ ]", "")) - 1
    return {
        "count": F.regexp_count(plain, F.lit(f"(?<= ){phrase}(?= )")),
        "first": F.when(first > 0, spaces(first).cast("long")),
        "last": F.when(first > 0, spaces(before_last).cast("long")),
    }


def scan(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The digest over documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row per row with a doc_id. Rows with the same doc_id get the labels found in any of
    them. A null text is empty. score: 1 with a base label, else the best containment, else 0.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = matches(rows, ["doc_id"], threshold=threshold).groupBy("doc_id").agg(
        F.collect_set("label").alias("_labels"), F.max("containment").alias("_best")  # at most one entry a label
    )
    near = F.col("text").rlike("(?i)" + "|".join(p.replace(" ", _GAP) for p in PHRASES))
    base = rows.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long")).withColumn("plain", F.when(near, _plain(F.col("text"))))
    places = {p: _places(p) for p in PHRASES}
    count = sum((F.coalesce(x["count"], F.lit(0)) for x in places.values()), F.lit(0))
    labels = F.array_compact(F.array(*[F.when(places[p]["count"] > 0, F.lit(label)) for p, label in PHRASES.items()]))
    base = base.select(
        "doc_id", "n_words", count.cast("long").alias("n_base"), F.least(*[x["first"] for x in places.values()]).alias("first_word"),
        F.greatest(*[x["last"] for x in places.values()]).alias("last_word"), labels.alias("_base"),
    )
    every = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    return base.join(found, "doc_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
