"""Array helpers that keep a document's parts inside its own row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, never broadcast.

    Rows exploded from arrays are estimated at a fraction of their size, and compressed files
    at theirs; a broadcast chosen from either holds the whole side in the driver.
    """
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda re-evaluates any outer expression it mentions for every element, and
    the optimizer may inline an earlier projection into it; binding avoids both.
    The fold runs over nothing and only finishes: unlike ``transform``, it does not copy
    the result with all its texts at every level of nesting.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def running_starts(lengths: Column) -> Column:
    """Exclusive running sum of an int array, in about n*sqrt(n) copies.

    Appending to an array copies it, so one fold over n elements is quadratic.
    Folding slices of sqrt(n) elements and then the slice totals is not.
    """

    def within(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts")),
            lambda acc, x: F.struct(
                (acc["total"] + x).alias("total"),
                F.concat(acc["starts"], F.array(acc["total"])).alias("starts"),
            ),
        )

    def build(arr: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(arr))).cast("int"))
        blocks = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(arr), F.lit(1)), width),
            lambda at: within(F.slice(arr, at, width)),
        )
        return let(
            blocks,
            lambda bs: let(
                within(F.transform(bs, lambda b: b["total"])),
                lambda base: F.flatten(
                    F.transform(
                        bs,
                        lambda b, i: F.transform(b["starts"], lambda s: s + F.get(base["starts"], i)),
                    )
                ),
            ),
        )

    # Short arrays, the common case, need no second level.
    return let(lengths, lambda arr: F.when(F.size(arr) <= 48, within(arr)["starts"]).otherwise(build(arr)))


def regex_hits(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` with 0-based half-open offsets and the gap before each.

    Splitting on the pattern gives the text between matches, so positions follow
    from running lengths and no per-row Python is needed. Text without a match is scanned
    once and not split.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string,gap:string>>")

    def build(s: Column, found: Column) -> Column:
        return let(
            F.struct(F.split(s, pattern, -1).alias("gaps"), found.alias("hits")),
            lambda p: let(
                running_starts(
                    F.transform(p["hits"], lambda h, i: F.length(F.get(p["gaps"], i)) + F.length(h))
                ),
                lambda begins: F.transform(
                    p["hits"],
                    lambda h, i: F.struct(
                        (F.get(begins, i) + F.length(F.get(p["gaps"], i))).alias("start"),
                        (F.get(begins, i) + F.length(F.get(p["gaps"], i)) + F.length(h)).alias("end"),
                        h.alias("hit"),
                        F.get(p["gaps"], i).alias("gap"),
                    ),
                ),
            ),
        )

    return let(text, lambda s: let(
        F.regexp_extract_all(s, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, none).otherwise(build(s, found))
    ))


def last_with(items: Column, field: str, value) -> Column:
    """Last struct whose ``field`` equals ``value`` or null."""
    return F.try_element_at(F.filter(items, lambda x: x[field] == value), F.lit(-1))


def first_where(items: Column, keep: Callable[[Column], Column]) -> Column:
    """First element satisfying ``keep`` or null."""
    return F.get(F.filter(items, keep), F.lit(0))


def unnest(df: DataFrame, items: Column, *keep: str, name: str = "_item", position: str | None = None) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer add a size filter that evaluates the array
    a second time; for arrays that are costly to build the outer form avoids that.
    Likewise ``unnest(df, F.array(x))`` keeps the rows where a costly ``x`` is not null
    without the filter being pushed below the projection and computing ``x`` again.
    """
    if position:
        out = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    else:
        out = df.select(*keep, F.explode_outer(items).alias(name))
    return out.filter(F.col(name).isNotNull())
