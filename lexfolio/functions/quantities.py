"""Durations and money in text, with the field their surroundings imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import last_with, let, regex_hits
from lexfolio.functions.text import contains_any, half_up, slice_text, squeeze_ends

QUANTITY = "struct<field:string,value:double,unit:string,raw:string,start:int,end:int>"

_DURATION_TEST = r"(?i)\d\)?\s*(?:calendar\s|business\s|day|month|year|week)"
_MONEY_TEST = r"(?i)(?:\$|USD\s*|EUR\s*|GBP\s*)\d"


def _lead_words(gap: Column) -> Column:
    """The words right before a number: trailing letters, hyphens and spaces of the gap.

    Matching the number first and extending left gives the same span as one pattern
    for both, without the nested repetition that overflows the JVM regex stack.
    """
    tail = F.ltrim(F.regexp_replace(gap, r"(?s)^.*[^A-Za-z\s\-]", ""))
    return let(F.regexp_replace(tail, r"^\s+", ""), lambda t: F.when(t.rlike(r"\s\z"), t).otherwise(F.lit("")))


def _context(text: Column, start: Column, end: Column) -> Column:
    begin = F.greatest(F.lit(0), start - 50)
    return F.lower(slice_text(text, begin, end + 50))


def _duration_kind(window: Column) -> Column:
    return let(window, _kind_of)


def _kind_of(window: Column) -> Column:
    ctx = dict(lx.DURATION_CONTEXTS)
    ends = contains_any(window, ("terminate",)) & ~contains_any(window, ("following termination",))
    return (
        F.when(contains_any(window, ctx["compete"]), "compete")
        .when(contains_any(window, ctx["renew"]), "renew")
        .when(contains_any(window, ctx["notice"]) | ends, "notice")
        .when(contains_any(window, ctx["confidential"]), "confidential")
        .when(contains_any(window, ctx["net"]), "net")
    )


def duration_mentions(text: Column) -> Column:
    """array<struct<kind,value,unit,raw,start,end>> in text order; unclassified ones have a null kind."""

    def mention(s: Column, h: Column) -> Column:
        def led(lead: Column) -> Column:
            return F.struct((h["start"] - F.length(lead)).alias("start"), h["end"].alias("end"), F.concat(lead, h["hit"]).alias("raw"), h["hit"].alias("hit"))

        return let(
            let(_lead_words(h["gap"]), led),
            lambda m: let(
                F.struct(
                    m["start"].alias("start"),
                    m["end"].alias("end"),
                    squeeze_ends(m["raw"]).alias("raw"),
                    F.regexp_extract(m["hit"], r"\d+", 0).cast("double").alias("n"),
                    F.lower(F.left(F.regexp_extract(m["hit"], lx.DURATION_CORE, 3), F.lit(5))).alias("u"),
                    _duration_kind(_context(s, m["start"], m["end"])).alias("kind"),
                ),
                lambda m: F.struct(
                    m["kind"].alias("kind"),
                    _duration_value(m["kind"], m["n"], m["u"]).alias("value"),
                    F.when(m["kind"] == "compete", "months").when(m["kind"] == "confidential", "years").otherwise("days").alias("unit"),
                    m["raw"].alias("raw"),
                    m["start"].alias("start"),
                    m["end"].alias("end"),
                ),
            ),
        )

    return let(text, lambda s: let(regex_hits(s, lx.DURATION_CORE), lambda hs: F.transform(hs, lambda h: mention(s, h))))


def _duration_value(kind: Column, n: Column, unit: Column) -> Column:
    months, years = F.startswith(unit, F.lit("month")), F.startswith(unit, F.lit("year"))
    days = F.when(months, n * 30).when(years, n * 365).otherwise(n)
    as_months = F.when(months, n).when(years, n * 12).otherwise(half_up(n / 30))
    as_years = F.when(years, n).when(months, half_up(n / 12)).otherwise(half_up(n / 365))
    return F.when(kind == "compete", as_months).when(kind == "confidential", as_years).otherwise(days)


def money_mentions(text: Column) -> Column:
    """array<struct<field,value,unit,raw,start,end>> in text order."""

    def mention(s: Column, h: Column) -> Column:
        number = F.replace(F.regexp_extract(h["hit"], lx.MONEY_PATTERN, 1), F.lit(","), F.lit("")).cast("double")
        word = F.lower(F.regexp_extract(h["hit"], lx.MONEY_PATTERN, 2))
        scale = F.when(word == "million", 1e6).when(word == "billion", 1e9).when(word == "thousand", 1e3).otherwise(1.0)
        cap = contains_any(_context(s, h["start"], h["end"]), lx.CAP_WORDS)
        return F.struct(
            F.when(cap, "liability_cap_usd").otherwise("amount_usd").alias("field"),
            (number * scale).alias("value"),
            F.lit("usd").alias("unit"),
            h["hit"].alias("raw"),
            h["start"].alias("start"),
            h["end"].alias("end"),
        )

    return let(text, lambda s: let(regex_hits(s, lx.MONEY_PATTERN), lambda hs: F.transform(hs, lambda h: mention(s, h))))


def quantities(text: Column, base: Column) -> Column:
    """One entry per field, the last mention winning; offsets are shifted by ``base``."""

    # the mention is bound: a field read of an unbound one would search for it once more
    def entry(field: str, found: Column) -> Column:
        return let(found, lambda m: F.when(
            m.isNotNull(),
            F.struct(
                F.lit(field).alias("field"),
                m["value"].alias("value"),
                m["unit"].alias("unit"),
                m["raw"].alias("raw"),
                (base + m["start"]).cast("int").alias("start"),
                (base + m["end"]).cast("int").alias("end"),
            ).cast(QUANTITY),
        ))

    def pick(found: Column) -> Column:
        entries = []
        for kind, fields in lx.DURATION_FIELDS.items():
            for f in fields:
                entries.append(entry(f, last_with(found["d"], "kind", kind)))
        for f in ("liability_cap_usd", "amount_usd"):
            entries.append(entry(f, last_with(found["m"], "field", f)))
        return F.filter(F.array(*entries), lambda e: e.isNotNull())

    def scan(t: Column) -> Column:
        found = F.struct(F.when(t["d"], duration_mentions(t["text"])).alias("d"), F.when(t["m"], money_mentions(t["text"])).alias("m"))
        return F.when(t["d"] | t["m"], let(found, pick)).otherwise(F.array().cast(f"array<{QUANTITY}>"))

    # Most sentences state no quantity; two cheap tests that every match passes spare them the scan, or one of the two.
    tests = lambda s: F.struct(s.alias("text"), s.rlike(_DURATION_TEST).alias("d"), s.rlike(_MONEY_TEST).alias("m"))
    return let(let(text, tests), scan)


def merge_quantities(base: Column, extra: Column) -> Column:
    """Per field the value from ``extra`` if any, else from ``base``."""
    kept = F.filter(base, lambda b: ~F.exists(extra, lambda e: e["field"] == b["field"]))
    return F.concat(kept, extra)
