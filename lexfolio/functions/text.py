"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import let


def squeeze_ends(text: Column) -> Column:
    """Strip every kind of whitespace at both ends (plain ``trim`` strips only U+0020)."""
    return F.btrim(text, F.lit(lx.EDGE_SPACE))


def _any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.startswith(text, F.lit(w[1:])) if w.startswith("^") else F.contains(text, F.lit(w)))
    return out


def contains_any(text: Column, words) -> Column:
    """True when any of the words occurs; a leading ^ anchors a word at the start.

    The text is bound first, so an expression such as ``lower(...)`` runs once.
    """
    return let(text, lambda t: _any_of(t, words))


def first_label(text: Column, table, default: Column) -> Column:
    """Label of the first (label, words) row whose words occur in ``text``."""

    def pick(t: Column) -> Column:
        expr = None
        for label, words in table:
            cond = _any_of(t, words)
            expr = F.when(cond, label) if expr is None else expr.when(cond, label)
        return expr.otherwise(default)

    return let(text, pick)


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def doubtful_unicode(text: Column) -> Column:
    """True when the text holds characters that NFC may change or reorder."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(lx.DOUBTFUL_NFC)


def compose_unicode(text: Column) -> Column:
    """NFC. Spark has no builtin; only values with doubtful characters reach the Arrow function."""
    return F.coalesce(_nfc(F.when(doubtful_unicode(text), text)), text)


def unclean_spacing(text: Column) -> Column:
    """True when clean-up could change more than the ends; the wide characters are sought as bytes, one by one."""
    out = text.rlike(lx.UNCLEAN_NARROW)
    for c in lx.UNCLEAN_WIDE:
        out = out | F.contains(text, F.lit(c))
    return out


def tidy_blocks(text: Column) -> Column:
    """True when the pieces between blank lines are blocks as they stand: none empty, none to be trimmed or cleaned."""
    loose = text.rlike(lx.ODD_SPACE)
    for edge in (" ", "\n"):
        loose = loose | F.startswith(text, F.lit(edge)) | F.endswith(text, F.lit(edge)) | F.contains(text, F.lit("\n\n" + edge))
    return (text != "") & ~(loose | F.contains(text, F.lit(" \n\n")))


def clean_spacing(text: Column) -> Column:
    """Newline and exotic-space clean-up of already composed text."""
    t = F.regexp_replace(text, r"\r\n?|[\f\x0B]", "\n")
    t = F.translate(t, "\u00a0\u2007\u202f\u200b\ufeff", "   ")
    return squeeze_ends(t)


def normalize_text(text: Column) -> Column:
    """NFC, LF newlines, plain spaces, no zero-width characters, no outer whitespace."""
    return clean_spacing(compose_unicode(text))


def search_tokens(text: Column) -> Column:
    """Lower-case search tokens: ASCII word characters, $, - and . ; no stopwords."""
    # what no token holds separates tokens, so that the text is not written anew with spaces there
    words = F.split(F.lower(text), lx.TOKEN_BREAK)
    # a list of values becomes a hash set; an array of them would be compared word by word for every token
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(lx.STOPWORDS))


def word_set(text: Column) -> Column:
    """Distinct lower-case ASCII words, the basis of the Dice similarity."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def dice_of_sets(a: Column, b: Column) -> Column:
    """Dice similarity of two word sets: both empty 1, one empty 0."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))
    )


def dice(a: Column, b: Column) -> Column:
    return dice_of_sets(word_set(a), word_set(b))


def collapse_space(text: Column) -> Column:
    """Whitespace runs to one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def half_up(value: Column, digits: int = 0) -> Column:
    """Round halves towards positive infinity, as the labelled scores expect."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def utf16_offset(text: Column, offset: Column) -> Column:
    """UTF-16 code-unit offset of a code-point offset, for exports."""
    return (F.octet_length(F.encode(F.left(text, offset), "UTF-16BE")) / 2).cast("int")


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Half-open 0-based slice."""
    return F.substring(text, start + 1, end - start)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths, empty or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same & (norms != 0.0), dot(a, b) / norms).otherwise(F.lit(0.0))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Replace each ``{{key}}``; a null value leaves its placeholder."""
    out = F.lit(template)
    for key, value in values.items():
        if "{{" + key + "}}" in template:
            out = F.when(value.isNotNull(), F.replace(out, F.lit("{{" + key + "}}"), value)).otherwise(out)
    return out


def number_text(value: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
