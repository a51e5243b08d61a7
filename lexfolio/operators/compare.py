"""Clause alignment and change analysis of two revisions.

``compare_revisions`` matches the clauses of a pair in the pair's own row; ``align_clauses`` does the
same for clauses that are rows of their own, by equi-joins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import first_where, let, shuffled
from lexfolio.functions.quantities import quantities
from lexfolio.functions.text import dice_of_sets, squeeze_ends
from lexfolio.session import materialize

_WORD = re.compile("[a-z0-9]+")


def _one_side(clauses: DataFrame, name: str) -> DataFrame:
    """Clauses of a side, columns prefixed by its first letter; the index is the letter alone."""
    own = clauses.filter(F.col("side") == name).drop("side")
    return own.select("pair_id", *[F.col(c).alias(name[0] if c == "i" else f"{name[0]}_{c}") for c in own.columns if c != "pair_id"])


def _leading_words(words: Column, least: float) -> Column:
    """The words one of which two sets of at least that Dice similarity share, in a fixed order with long words first.

    2o / (n + m) >= s and o <= m give o >= s n / (2 - s), so at most n - o words can be missed in a row.
    """
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])
    n = F.size(words)
    shared = F.ceil(n * (least / (2 - least)) - 1e-9).cast("int")
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.slice(ordered, F.lit(1), n - shared + 1))


def numbered_candidates(base: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_id, t, b, numbered, score): clause pairs with one number and like headings, by an equi-join on the number."""
    like = (F.lower("b_heading") == F.lower("t_heading")) | (dice_of_sets(F.col("b_heading_words"), F.col("t_heading_words")) > lx.HEADING_SIMILARITY)
    heads = [x.select("pair_id", n, F.col(f"{n}_number").alias("_number"), f"{n}_heading", f"{n}_heading_words").filter("_number <> ''") for x, n in ((base, "b"), (target, "t"))]
    return heads[0].join(shuffled(heads[1]), ["pair_id", "_number"]).filter(like).select("pair_id", "t", "b", F.lit(True).alias("numbered"), F.lit(0.0).alias("score"))


def text_candidates(base: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_id, t, b, numbered, score): clause pairs with like texts, by an equi-join on words that like texts must share."""
    leads = [x.select("pair_id", n, F.explode(_leading_words(F.col(f"{n}_words"), lx.TEXT_SIMILARITY)).alias("_w")) for x, n in ((base, "b"), (target, "t"))]
    near = leads[0].join(shuffled(leads[1]), ["pair_id", "_w"]).select("pair_id", "t", "b").distinct()
    score = dice_of_sets(F.col("b_words"), F.col("t_words"))
    return (
        near.join(shuffled(base.select("pair_id", "b", "b_words")), ["pair_id", "b"]).join(shuffled(target.select("pair_id", "t", "t_words")), ["pair_id", "t"])
        .select("pair_id", "t", "b", F.lit(False).alias("numbered"), score.alias("score"))
        .filter(F.col("score") >= lx.TEXT_SIMILARITY)
    )


def choose_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy one-to-one matches from candidates in the order in which they are to be taken, pair after pair."""
    at, taken, done = None, set(), set()
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "t", "b", "numbered")), strict=True):
            pair_id, t, b, _ = row
            if pair_id != at:
                at, taken, done = pair_id, set(), set()
            if t not in done and b not in taken:
                done.add(t)
                taken.add(b)
                out.append(row)
        kinds = [batch.schema.field("pair_id").type, pa.int32(), pa.int32(), pa.bool_()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pair_id", "t", "b", "by_number"])


def align_clauses(clauses: DataFrame) -> DataFrame:
    """(pair_id, t, b, by_number): matches of the two sides of each pair of revisions.

    Targets pick in order: first the first free base clause with the same number and a like
    heading, then, for those left, the free one with the most similar text.
    """
    kind = clauses.schema["pair_id"].dataType.simpleString()
    base, target = _one_side(clauses, "base"), _one_side(clauses, "target")

    def chosen(candidates: DataFrame) -> DataFrame:
        ordered = candidates.repartition("pair_id").sortWithinPartitions("pair_id", "t", F.desc("score"), "b")
        return ordered.mapInArrow(choose_matches, f"pair_id {kind}, t int, b int, by_number boolean")

    # What a number settles takes no part in the search by text, whose candidates are by far the most.
    by_number = materialize(chosen(numbered_candidates(base, target)), "numbered")
    left = [x.join(shuffled(by_number.select("pair_id", n)), ["pair_id", n], "left_anti") for x, n in ((base, "b"), (target, "t"))]
    return by_number.unionByName(chosen(text_candidates(*left)))


# --- matches inside the row of a pair ---------------------------------------------------------


@lru_cache(maxsize=4096)
def _short_words(text: str) -> frozenset[str]:
    return frozenset(_WORD.findall(text.lower()))


def _words(text: str) -> frozenset[str]:
    """``word_set`` of a text; sets of short texts, which recur from pair to pair, are kept."""
    return _short_words(text) if len(text) <= 4000 else frozenset(_WORD.findall(text.lower()))


def _dice(a: frozenset[str], b: frozenset[str]) -> float:
    """``dice_of_sets`` of two sets."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    return 2.0 * len(a & b) / (len(a) + len(b))


def _leads(words: frozenset[str], least: float) -> list[str]:
    """``_leading_words`` of a set."""
    shared = math.ceil(len(words) * (least / (2 - least)) - 1e-9)
    return sorted(words, key=lambda w: (-len(w), w))[: len(words) - shared + 1] if words else [""]


def match_clauses(base: list[tuple[str, str, str]], target: list[tuple[str, str, str]]) -> list[tuple[int, int, bool]]:
    """(t, b, by_number) of clauses (number, heading, full text): the matches ``align_clauses`` finds by joins."""
    numbered: dict[str, list[int]] = {}
    for b, (number, _, _) in enumerate(base):
        if number:
            numbered.setdefault(number, []).append(b)
    taken, done, out = set(), set(), []
    for t, (number, heading, _) in enumerate(target):
        for b in numbered.get(number, ()):
            if b not in taken and (base[b][1].lower() == heading.lower() or _dice(_words(base[b][1]), _words(heading)) > lx.HEADING_SIMILARITY):
                out.append((t, b, True))
                taken.add(b)
                done.add(t)
                break
    held: dict[str, list[int]] = {}
    left = [t for t in range(len(target)) if t not in done]
    if left:
        for b in range(len(base)):
            if b not in taken:
                for w in _leads(_words(base[b][2]), lx.TEXT_SIMILARITY):
                    held.setdefault(w, []).append(b)
    for t in left:
        own = _words(target[t][2])
        near = {b for w in _leads(own, lx.TEXT_SIMILARITY) for b in held.get(w, ()) if b not in taken}
        score, b = max(((_dice(_words(base[b][2]), own), -b) for b in near), default=(0.0, 0))
        if near and score >= lx.TEXT_SIMILARITY:
            out.append((t, -b, False))
            taken.add(-b)
    return out


def match_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair_id, base_clauses, target_clauses) -> one row per matched, added or deleted clause, texts taken over as they are."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            sides = {}
            for n in ("base", "target"):
                lists = batch.column(f"{n}_clauses")
                flat = lists.flatten()
                fields = [flat.field(f) for f in ("number", "heading", "full_text")]
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
                sides[n] = (fields, list(zip(*(f.to_pylist() for f in fields), strict=True)), ends)
            (b_fields, base, b_ends), (t_fields, target, t_ends) = sides["base"], sides["target"]
            row, bs, ts, by_number, similarity, b_at, t_at = [], [], [], [], [], [], []

            def put(p: int, b: int | None, t: int | None, numbered: bool | None, alike: float) -> None:
                row.append(p), bs.append(b), ts.append(t), by_number.append(numbered), similarity.append(alike)
                b_at.append(None if b is None else b_ends[p] + b), t_at.append(None if t is None else t_ends[p] + t)

            for p in range(batch.num_rows):
                own, other = base[b_ends[p] : b_ends[p + 1]], target[t_ends[p] : t_ends[p + 1]]
                found = match_clauses(own, other)
                for t, b, numbered in found:
                    x, y = own[b][2], other[t][2]
                    exact = x == y or x.strip(lx.EDGE_SPACE) == y.strip(lx.EDGE_SPACE)
                    put(p, b, t, numbered, 1.0 if exact else _dice(_words(x), _words(y)))
                met_t, met_b = {t for t, _, _ in found}, {b for _, b, _ in found}
                for t in range(len(other)):
                    if t not in met_t:
                        put(p, None, t, None, 0.0)
                for b in range(len(own)):
                    if b not in met_b:
                        put(p, b, None, None, 0.0)
            b_rows, t_rows = pa.array(b_at, pa.int64()), pa.array(t_at, pa.int64())
            columns = {
                "pair_id": batch.column("pair_id").take(pa.array(row, pa.int64())), "b": pa.array(bs, pa.int32()), "t": pa.array(ts, pa.int32()),
                "by_number": pa.array(by_number, pa.bool_()), "similarity": pa.array(similarity, pa.float64()),
                **{f"b_{f}": c.take(b_rows) for f, c in zip(("number", "heading", "full_text"), b_fields, strict=True)},
                **{f"t_{f}": c.take(t_rows) for f, c in zip(("number", "heading", "full_text"), t_fields, strict=True)},
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def numeric_changes(base: Column, target: Column) -> Column:
    """Per field changed, removed or added between two quantity arrays, which are bound: a lambda would find them anew for every field."""
    return let(F.struct(base.alias("b"), target.alias("t")), lambda p: _changes(p["b"], p["t"]))


def _changes(base: Column, target: Column) -> Column:
    fields = F.array_distinct(F.concat(F.transform(base, lambda q: q["field"]), F.transform(target, lambda q: q["field"])))

    def change(f: Column) -> Column:
        return let(
            F.struct(
                first_where(base, lambda q: q["field"] == f).alias("b"),
                first_where(target, lambda q: q["field"] == f).alias("t"),
            ),
            lambda p: F.struct(
                f.alias("field"),
                p["b"]["value"].alias("old_value"),
                p["t"]["value"].alias("new_value"),
                F.coalesce(p["t"]["unit"], p["b"]["unit"]).alias("unit"),
                F.when(p["t"].isNull(), F.concat(f, F.lit(" ("), p["b"]["raw"], F.lit(") was removed")))
                .when(p["b"].isNull(), F.concat(f, F.lit(" was added with value "), p["t"]["raw"]))
                .otherwise(F.concat(f, F.lit(" changed from "), p["b"]["raw"], F.lit(" to "), p["t"]["raw"])).alias("description"),
            ),
        )

    return F.filter(
        F.transform(fields, change), lambda c: c["old_value"].isNull() | c["new_value"].isNull() | (c["old_value"] != c["new_value"])
    )


def obligation_change(base: Column, target: Column) -> Column:
    """modality_shift when a duty became a permission, added when a prohibition is new, else null."""
    duty, shift = r"(?i)\b(shall|must)\b", r"(?i)\b(may)\b"
    return F.when(base.rlike(duty) & target.rlike(shift) & ~target.rlike(duty), "modality_shift").when(
        ~base.rlike(duty) & target.rlike(r"(?i)\b(shall not|must not)\b"), "added"
    )


def compare_revisions(pairs: DataFrame) -> DataFrame:
    """One row per aligned, added or deleted clause.

    ``pairs(pair_id, base_clauses, target_clauses)`` holds the clauses (number, heading, full_text) of
    both sides; a pair is matched in its own row, so nothing is shuffled or stored.
    """
    kind = pairs.schema["pair_id"].dataType.simpleString()
    texts = ", ".join(f"{n}_{f} string" for n in "bt" for f in ("number", "heading", "full_text"))
    scored = pairs.select("pair_id", "base_clauses", "target_clauses").mapInArrow(
        match_pairs, f"pair_id {kind}, b int, t int, by_number boolean, similarity double, {texts}"
    )
    both = F.col("b").isNotNull() & F.col("t").isNotNull()
    scored = scored.withColumn("exact", squeeze_ends(F.col("b_full_text")) == squeeze_ends(F.col("t_full_text")))
    renumbered = F.col("b_number") != F.col("t_number")
    label = (
        F.when(F.col("b").isNull(), "added")
        .when(F.col("t").isNull(), "deleted")
        .when(~F.col("by_number") & renumbered & (F.col("similarity") > lx.MOVED_BY_TEXT), "moved")
        .when(F.col("exact"), "identical")
        .when(renumbered & (F.col("similarity") > lx.MOVED_BY_LABEL), "moved")
        .otherwise("modified")
    )
    none = "array<struct<field:string,old_value:double,new_value:double,unit:string,description:string>>"
    numeric = F.when(
        both & ~F.col("exact"),
        numeric_changes(quantities(F.col("b_full_text"), F.lit(0)), quantities(F.col("t_full_text"), F.lit(0))),
    ).otherwise(F.array().cast(none))
    duty = (
        F.when(F.col("b").isNull(), "added").when(F.col("t").isNull(), "removed")
        .when(~F.col("exact"), obligation_change(F.col("b_full_text"), F.col("t_full_text")))
    )
    return scored.select(
        "pair_id", F.col("b").alias("base_index"), F.col("t").alias("target_index"), label.alias("alignment"), "similarity",
        F.col("b_heading").alias("base_heading"), F.col("t_heading").alias("target_heading"),
        F.col("b_full_text").alias("base_text"), F.col("t_full_text").alias("target_text"),
        numeric.alias("numeric_changes"), duty.alias("obligation_change"),
    )


def comparison_summary(alignments: DataFrame) -> DataFrame:
    """Counts per alignment type; a numeric or obligation change makes a row high-risk."""
    kinds = ("identical", "modified", "added", "deleted", "moved")
    return alignments.groupBy("pair_id").agg(
        F.count("base_index").cast("int").alias("total_base"),
        F.count("target_index").cast("int").alias("total_target"),
        *[F.count_if(F.col("alignment") == k).cast("int").alias(f"{k}_count") for k in kinds],
        F.count_if((F.size("numeric_changes") > 0) | F.col("obligation_change").isNotNull()).cast("int").alias("high_risk_count"),
    )


# --- token diff ------------------------------------------------------------------------------

_TOKENS = re.compile(r"\S+|\s+")


def diff_tokens(base: str, target: str) -> list[tuple[str, str]]:
    """Edit script over words and spaces from a longest common subsequence.

    Each table row is one vectorised step. Only every sqrt(n)-th row is kept; the rows
    between are computed again while the script is read backwards, so that long clauses
    need no whole table.
    """
    a, b = _TOKENS.findall(base), _TOKENS.findall(target)
    ids: dict[str, int] = {}
    x = [ids.setdefault(t, len(ids)) for t in a]
    y = np.array([ids.setdefault(t, len(ids)) for t in b], dtype=np.int64)

    def below(row: np.ndarray, token: int) -> np.ndarray:
        out = np.zeros_like(row)
        grown = np.where(y == token, row[:-1] + 1, row[1:])
        out[1:] = np.maximum.accumulate(np.maximum(grown, row[1:]))
        return out

    stride = max(1, math.isqrt(len(a)))
    row = np.zeros(len(b) + 1, dtype=np.int32)
    kept = [row]
    for i, token in enumerate(x, 1):
        row = below(row, token)
        if i % stride == 0:
            kept.append(row)
    table: dict[int, np.ndarray] = {}
    out: list[tuple[str, str]] = []
    i, j = len(a), len(b)
    while i or j:
        if i and i - 1 not in table:
            first = (i - 1) // stride * stride
            table = {first: kept[first // stride]}
            for r in range(first, i):
                table[r + 1] = below(table[r], x[r])
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("equal", a[i]))
        elif j and (not i or table[i][j - 1] >= table[i - 1][j]):
            j -= 1
            out.append(("insert", b[j]))
        else:
            i -= 1
            out.append(("delete", a[i]))
    return out[::-1]


_DIFF = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("token", T.StringType())]))


@lru_cache(maxsize=512)
def _short_diff(base: str, target: str) -> list[dict]:
    return [{"op": op, "token": token} for op, token in diff_tokens(base, target)]


def _script(base: str, target: str) -> list[dict]:
    """``diff_tokens`` as rows; the same change of short clauses recurs from pair to pair and is kept."""
    return (_short_diff if len(base) + len(target) <= 4000 else _short_diff.__wrapped__)(base, target)


@F.pandas_udf(_DIFF)
def _token_diff(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([_script(b or "", t or "") for b, t in zip(base, target, strict=True)])


def token_diffs(alignments: DataFrame) -> DataFrame:
    """Add ``diff``. Only modified pairs reach Python; the rest is one operation repeated."""
    changed = F.col("base_text") != F.col("target_text")
    scripted = _token_diff(F.when(changed, F.col("base_text")).otherwise(""), F.when(changed, F.col("target_text")).otherwise(""))
    whole = F.coalesce("target_text", "base_text")
    op = F.when(F.col("base_text").isNull(), "insert").when(F.col("target_text").isNull(), "delete").otherwise("equal")
    plain = F.transform(F.regexp_extract_all(whole, F.lit(r"\S+|\s+"), 0), lambda t: F.struct(op.alias("op"), t.alias("token")))
    return alignments.withColumn("_d", scripted).withColumn("diff", F.when(changed, F.col("_d")).otherwise(plain)).drop("_d")
