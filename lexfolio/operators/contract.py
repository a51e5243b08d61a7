"""Clauses, entities, obligations and clause facts of agreements.

Everything here maps a document row to arrays in the same row; flat tables come
from ``clause_rows`` and ``obligation_rows``. No step shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import first_where, let, regex_hits, running_starts, unnest
from lexfolio.functions.quantities import merge_quantities, quantities
from lexfolio.functions.text import contains_any, doubtful_unicode, first_label, half_up, squeeze_ends, tidy_blocks
from lexfolio.operators import ir

# --- clauses -------------------------------------------------------------------


def section_header(block: Column, *, trimmed: bool = False) -> Column:
    """struct(number, heading, level) of a header block, else null."""

    def numbered(text: Column, pattern: str, offset: int) -> Column:
        # every pattern's number has a character at least, so an empty one tells that nothing matched
        return let(F.regexp_extract(text, pattern, 1), lambda number: F.when(number != "", F.struct(
            number.alias("number"),
            let(squeeze_ends(F.regexp_extract(text, pattern, 2)), lambda rest: F.when(rest != "", rest).otherwise(text)).alias("heading"),
            (F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + (offset or 1)).cast("int").alias("level"),
        )))

    def build(text: Column) -> Column:
        found = F.coalesce(*[numbered(text, pattern, offset) for pattern, offset in lx.HEADER_PATTERNS])
        plain = F.when(
            block["block_type"] == "heading",
            F.struct(F.lit("").alias("number"), text.alias("heading"), F.lit(1).alias("level")),
        )
        # Few blocks can be numbered headers; the rest is spared six patterns, each tried at every character.
        return F.when(F.left(text, F.lit(8)).rlike(lx.HEADER_START), F.coalesce(found, plain)).otherwise(plain)

    return build(block["text"]) if trimmed else let(squeeze_ends(block["text"]), build)


def heading_category(heading: Column) -> Column:
    return let(F.lower(heading), lambda h: first_label(h, lx.HEADING_CATEGORIES, F.lit("unknown")))


def body_category(body: Column) -> Column:
    return let(F.lower(body), lambda b: first_label(b, lx.BODY_CATEGORIES, F.lit("general_clause")))


def _parents(levels: Column) -> Column:
    """Index of the nearest earlier clause with a smaller level, -1 if none.

    The fold keeps the open ancestors; its stack is as short as the numbering is deep.
    """
    entry = "struct<i:int,level:int>"
    state = f"struct<open:array<{entry}>,out:array<int>>"

    def step(acc: Column, item: Column) -> Column:
        return let(
            F.filter(acc["open"], lambda o: o["level"] < item["level"]),
            lambda open_: F.struct(
                F.concat(open_, F.array(item)).alias("open"),
                F.concat(acc["out"], F.array(F.coalesce(F.try_element_at(open_, F.lit(-1))["i"], F.lit(-1)))).alias("out"),
            ).cast(state),
        )

    items = F.transform(levels, lambda l, i: F.struct(i.cast("int").alias("i"), l.alias("level")).cast(entry))
    start = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast("array<int>").alias("out")).cast(state)
    return F.aggregate(items, start, step, lambda acc: acc["out"])


def _with_parents(clauses: Column) -> Column:
    return let(clauses, lambda cs: let(
        _parents(F.transform(cs, lambda c: c["level"])),
        lambda ps: F.transform(cs, lambda c, i: c.withField("parent_index", F.nullif(F.get(ps, i), F.lit(-1)))),
    ))


def _clause(j: Column, head: Column, full: Column, body: Column, block_ids: Column, **place: Column) -> Column:
    """The clause under ``head``, a preamble without one; ``place`` holds its first block, page, start and end."""

    def build(p: Column) -> Column:
        category = F.when(head.isNull(), "preamble").otherwise(heading_category(p["heading"]))
        return let(category, lambda cat: F.struct(
            j.cast("int").alias("clause_index"),
            F.coalesce(head["number"], F.lit("")).alias("clause_number"),
            p["heading"].alias("heading"),
            F.coalesce(head["level"], F.lit(0)).alias("level"),
            F.when(cat == "unknown", body_category(F.when(p["body"] != "", p["body"]).otherwise(p["full"]))).otherwise(cat).alias("category"),
            *[place[name].alias(name) for name in ("block_id", "page_number", "start", "end")],
            p["body"].alias("body_text"),
            p["full"].alias("full_text"),
            block_ids.alias("block_ids"),
        ))

    return let(F.struct(full.alias("full"), body.alias("body"), F.coalesce(head["heading"], F.lit("Preamble")).alias("heading")), build)


def clauses_of_tidy(text: Column, canonical_text: Column) -> Column:
    """``clauses_of`` for text whose blocks are tidy, cut at the blank lines before headers without any block made.

    Null if a block begins like a header and is none.
    """
    name = lambda i: F.concat(F.lit("b"), i.cast("string"))

    def cut(part: Column) -> Column:
        def clause(full: Column, j: Column, p: Column, at: Column) -> Column:
            head, opening, first, start = F.get(p["heads"], j), F.get(p["openings"], j), F.get(at["blocks"], j), F.get(at["starts"], j)
            return _clause(
                j, head, full, F.when(head.isNull(), full).otherwise(F.substring(full, F.length(opening) + 3, F.length(full))),
                F.transform(F.sequence(first, first + F.get(p["counts"], j) - 1), name),
                block_id=name(first), page_number=F.lit(1), start=start, end=start + F.get(p["lengths"], j) - 2,
            )

        starts = F.struct(running_starts(part["lengths"]).alias("starts"), running_starts(part["counts"]).alias("blocks"))
        cs = let(starts, lambda at: F.transform(part["full"], lambda full, j: clause(full, j, part, at)))
        return F.when(F.forall(F.slice(part["heads"], F.lit(2), F.size(part["heads"])), lambda h: h.isNotNull()), _with_parents(cs))

    def opened(full: Column) -> Column:
        return let(F.transform(full, lambda c: F.substring_index(c, "\n\n", 1)), lambda openings: F.struct(
            full.alias("full"), openings.alias("openings"),
            F.transform(openings, lambda o: section_header(F.struct(F.when(F.startswith(o, F.lit("#")), "heading").alias("block_type"), o.alias("text")), trimmed=True)).alias("heads"),
            F.transform(full, lambda c: F.size(F.split(c, "\n\n", -1))).alias("counts"),
            F.transform(F.split(canonical_text, lx.HEADER_BREAK, -1), lambda c: F.length(c) + 2).alias("lengths"),
        ))

    return let(let(F.split(text, lx.HEADER_BREAK, -1), opened), cut)


def clauses_of(blocks: Column) -> Column:
    """Segment placed blocks into clauses with number, heading, level, parent and category."""

    def cut(bs: Column, heads: Column) -> Column:
        n = F.size(bs)
        opening = F.filter(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | F.get(heads, i).isNotNull())
        )

        def clause(starts: Column, lo: Column, j: Column) -> Column:
            hi = F.coalesce(F.get(starts, j + 1), n)
            head = F.get(heads, lo)
            first, last = F.get(bs, lo), F.get(bs, hi - 1)
            texts = F.transform(F.slice(bs, lo + 1, hi - lo), lambda b: b["text"])
            return _clause(
                j, head, F.array_join(texts, "\n\n"), F.array_join(F.when(head.isNull(), texts).otherwise(F.slice(texts, F.lit(2), hi - lo)), "\n\n"),
                F.transform(F.slice(bs, lo + 1, hi - lo), lambda b: b["block_id"]),
                block_id=first["block_id"], page_number=first["page_number"], start=first["start"], end=last["end"],
            )

        return let(opening, lambda starts: F.transform(starts, lambda lo, j: clause(starts, lo, j)))

    return let(
        blocks,
        lambda bs: let(F.transform(bs, lambda b: section_header(b)), lambda heads: _with_parents(cut(bs, heads))),
    )


def segment_clauses(canonical: DataFrame) -> DataFrame:
    """Add ``clauses`` to canonical documents."""
    return canonical.withColumn("clauses", clauses_of(F.col("blocks")))


def segmented_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw text rows -> canonical documents with ``clauses``, those of tidy text cut from the text itself."""
    placed = ir.placed_documents(docs, text).withColumn("canonical_text", ir.placed_text(text))
    tidy = F.when(F.col("_placed").isNull(), clauses_of_tidy(F.col(text), F.col("canonical_text")))
    return placed.select(
        *[F.col(c) for c in docs.columns if c != text], "canonical_text", ir.placed_blocks(text).alias("blocks"),
        F.coalesce(tidy, clauses_of(ir.placed_blocks(text))).alias("clauses"),
    )


def clause_texts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with ``name`` in place of ``text``: number, heading and full text of the clauses of ``segmented_documents``, nothing else."""

    def brief(number: Column, heading: Column, full: Column) -> Column:
        return F.struct(number.alias("number"), heading.alias("heading"), full.alias("full_text"))

    def cut(parts: Column) -> Column:
        def head(part: Column, j: Column) -> Column:
            opening = F.substring_index(part, "\n\n", 1)
            return section_header(F.struct(F.when(F.startswith(opening, F.lit("#")), "heading").alias("block_type"), opening.alias("text")), trimmed=True)

        def named(part: Column, h: Column) -> Column:
            return brief(F.coalesce(h["number"], F.lit("")), F.coalesce(h["heading"], F.lit("Preamble")), part)

        return let(F.transform(parts, head), lambda heads: F.when(
            F.forall(F.slice(heads, F.lit(2), F.size(heads)), lambda h: h.isNotNull()),
            F.transform(parts, lambda part, j: named(part, F.get(heads, j))),
        ))

    placed = ir.placed_documents(docs, text)
    tidy = F.when(F.col("_placed").isNull(), let(F.split(text, lx.HEADER_BREAK, -1), cut))
    general = F.transform(clauses_of(ir.placed_blocks(text)), lambda c: brief(c["clause_number"], c["heading"], c["full_text"]))
    return placed.select(*[F.col(c) for c in docs.columns if c != text], F.coalesce(tidy, general).alias(name))


def opening_text(text: Column) -> Column:
    """``text`` up to its first header after the beginning, for what reads the first clause alone.

    Whole where the blocks up to that header are not sure as they stand: those to be cleaned or
    composed, and one that begins like a header and is none.
    """

    def cut(parts: Column) -> Column:
        known = F.concat(F.get(parts, F.lit(0)), F.lit("\n\n"), F.substring_index(F.get(parts, F.lit(1)), "\n\n", 1))
        opening = F.substring_index(F.get(parts, F.lit(1)), "\n\n", 1)
        head = section_header(F.struct(F.when(F.startswith(opening, F.lit("#")), "heading").alias("block_type"), opening.alias("text")), trimmed=True)
        sure = let(known, lambda k: tidy_blocks(k) & ~doubtful_unicode(k)) & head.isNotNull()
        return F.when(sure, F.get(parts, F.lit(0))).otherwise(text)

    return let(F.split(text, lx.HEADER_BREAK, 2), cut)


def opening_clauses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``segmented_documents`` with the first clause of each document, and only where needed the others.

    A preamble is always the first clause, so what reads it needs no more.
    """
    return segmented_documents(docs.withColumn(text, opening_text(F.col(text))), text)


def clause_rows(segmented: DataFrame, key: str = "version_id") -> DataFrame:
    """One row per clause with the parent's index and the number of direct children."""
    children = lambda c: F.size(F.filter("_parents", lambda p: p == c["clause_index"]))
    # a clause row carries the parents' indices, not the other clauses
    rows = unnest(segmented.withColumn("_parents", F.col("clauses.parent_index")), F.col("clauses"), key, "_parents")
    return rows.select(key, "_item.*", children(F.col("_item")).alias("child_count"))


# --- entities -------------------------------------------------------------------


def party_role(name: Column) -> Column:
    return first_label(F.lower(name), lx.PARTY_ROLES, F.lit("party"))


def company_hits(text: Column) -> Column:
    """``regex_hits`` of company names by their suffix."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string,gap:string>>")
    return let(text, lambda t: F.when(~t.rlike(lx.COMPANY_END), none).otherwise(regex_hits(t, lx.COMPANY_PATTERN)))


def parties_of(clauses: Column) -> Column:
    """array<struct<name,short_name,role,start,end,block_id>> from the preamble or first clause."""
    shape = "array<struct<name:string,short_name:string,role:string,start:int,end:int,block_id:string>>"

    def named(src: Column) -> Column:
        def party(h: Column) -> Column:
            raw = squeeze_ends(F.regexp_extract(h["hit"], lx.PARTY_PATTERN, 1))
            name = F.regexp_replace(F.regexp_replace(raw, r"^,\s*", ""), r"\s*,\z", "")
            alias = F.coalesce(
                F.nullif(F.regexp_extract(h["hit"], lx.PARTY_PATTERN, 2), F.lit("")),
                F.regexp_extract(h["hit"], lx.PARTY_PATTERN, 3),
            )
            short = let(squeeze_ends(alias), lambda a: F.when(a != "", a).otherwise(name))
            return F.struct(
                name.alias("name"), short.alias("short_name"), party_role(short).alias("role"),
                (src["start"] + h["start"]).alias("start"), (src["start"] + h["end"]).alias("end"), src["block_id"].alias("block_id"),
            )

        hits = F.transform(regex_hits(src["full_text"], lx.PARTY_PATTERN), party)
        return F.filter(
            hits,
            lambda p: (F.length(p["name"]) > 2) & (F.length(p["name"]) < 100) & ~F.startswith(F.lower(p["name"]), F.lit("the laws")),
        ).cast(shape)

    def by_suffix(src: Column) -> Column:
        def party(h: Column) -> Column:
            name = squeeze_ends(h["hit"])
            return F.struct(
                name.alias("name"), name.alias("short_name"), F.lit("contracting_party").alias("role"),
                (src["start"] + h["start"]).alias("start"), (src["start"] + h["start"] + F.length(name)).alias("end"),
                src["block_id"].alias("block_id"),
            )

        return F.transform(company_hits(src["full_text"]), party).cast(shape)

    source = F.coalesce(first_where(clauses, lambda c: c["category"] == "preamble"), F.get(clauses, F.lit(0)))
    return let(source, lambda src: let(named(src), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(by_suffix(src))))


def defined_terms_of(clauses: Column) -> Column:
    """array<struct<term,definition,start,end,block_id>> in clause, pattern and text order."""

    def matches(c: Column, pattern: str) -> Column:
        return F.transform(
            regex_hits(c["full_text"], pattern),
            lambda h: F.struct(
                squeeze_ends(F.regexp_extract(h["hit"], pattern, 1)).alias("term"),
                squeeze_ends(F.regexp_extract(h["hit"], pattern, 2)).alias("definition"),
                (c["start"] + h["start"]).alias("start"),
                (c["start"] + h["end"]).alias("end"),
                c["block_id"].alias("block_id"),
            ),
        )

    def in_clause(c: Column) -> Column:
        found = F.concat(*[matches(c, p) for p in lx.DEFINITION_PATTERNS])
        return F.filter(found, lambda d: (F.length(d["term"]) > 1) & (F.length(d["term"]) < 60))

    likely = F.filter(
        clauses,
        lambda c: contains_any(F.lower(c["heading"]), ("definition",)) | (c["category"] == "confidentiality") | (c["level"] <= 2),
    )
    return let(
        likely, lambda some: F.flatten(F.transform(F.when(F.size(some) > 0, some).otherwise(clauses), in_clause))
    )


def governing_law_of(clauses: Column, canonical_text: Column) -> Column:
    """struct<jurisdiction,start,end> from the governing-law clause, else the whole text; null if none."""
    source = F.coalesce(
        let(
            first_where(clauses, lambda c: c["category"] == "governing_law"),
            lambda c: F.when(c.isNotNull(), F.struct(c["full_text"].alias("text"), c["start"].alias("base"))),
        ),
        F.struct(canonical_text.alias("text"), F.lit(0).alias("base")),
    )

    def build(s: Column) -> Column:
        at = F.regexp_instr(s["text"], F.lit(lx.GOVERNING_LAW_PATTERN))
        hit = F.regexp_extract(s["text"], lx.GOVERNING_LAW_PATTERN, 0)
        return F.when(
            at > 0,
            F.struct(
                F.regexp_extract(s["text"], lx.GOVERNING_LAW_PATTERN, 1).alias("jurisdiction"),
                (s["base"] + at - 1).alias("start"),
                (s["base"] + at - 1 + F.length(hit)).alias("end"),
            ),
        )

    return let(source, build)


def extract_entities(segmented: DataFrame) -> DataFrame:
    """Add ``parties``, ``defined_terms`` and ``governing_law``."""
    return segmented.withColumns({
        "parties": parties_of(F.col("clauses")),
        "defined_terms": defined_terms_of(F.col("clauses")),
        "governing_law": governing_law_of(F.col("clauses"), F.col("canonical_text")),
    })


# --- obligations ------------------------------------------------------------------


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, lx.SENTENCE_BREAK, -1), squeeze_ends), lambda s: s != "")


def placed_sentences(clause: Column, canonical_text: Column) -> Column:
    """Sentences of ten characters or more with offsets: the next occurrence at or after
    the end of the one before, or that end itself if the text differs. They are sought in the
    clause's own text first, and only beyond it when they are not there."""
    sent = "struct<text:string,start:int,end:int>"
    state = f"struct<at:int,out:array<{sent}>>"

    def fold(own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            tail = F.substring(canonical_text, clause["start"] + 1, F.length(canonical_text))
            return let(
                let(
                    F.call_function("locate", s, own, acc["at"] + 1),
                    lambda near: F.when(near > 0, near).otherwise(F.call_function("locate", s, tail, acc["at"] + 1)),
                ),
                lambda pos: let(
                    F.when(pos > 0, pos - 1).otherwise(acc["at"]),
                    lambda start: F.struct(
                        (start + F.length(s)).alias("at"),
                        F.concat(acc["out"], F.array(F.struct(
                            s.alias("text"), (clause["start"] + start).alias("start"), (clause["start"] + start + F.length(s)).alias("end")
                        ).cast(sent))).alias("out"),
                    ).cast(state),
                ),
            )

        body = F.when(clause["body_text"] != "", clause["body_text"]).otherwise(clause["full_text"])
        return F.aggregate(
            F.filter(split_sentences(body), lambda s: F.length(s) >= 10),
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{sent}>").alias("out")).cast(state),
            step,
            lambda acc: acc["out"],
        )

    return let(F.substring(canonical_text, clause["start"] + 1, clause["end"] - clause["start"]), fold)


def modality(sentence: Column) -> Column:
    """First modal by priority, not by position; null if none. A pattern runs only where its words occur."""

    def pick(low: Column) -> Column:
        expr = F
        for name, pattern in lx.MODALS:
            words = [F.contains(low, F.lit(w)) for w in name.split("_")]
            expr = expr.when(reduce(and_, words) & sentence.rlike(pattern), name)
        return expr

    return let(F.lower(sentence), pick)


def _modal_part(sentence: Column, modal: Column, which: str) -> Column:
    """Text before or after the first occurrence of the given modal."""
    expr = None
    for name, pattern in lx.MODALS:
        around = rf"(?is)^(.*?){pattern.removeprefix('(?i)')}(.*)\z"
        value = F.regexp_extract(sentence, around, 1 if which == "before" else 2)
        expr = F.when(modal == name, value) if expr is None else expr.when(modal == name, value)
    return squeeze_ends(expr)


def clean_actor(raw: Column) -> Column:
    plain = F.regexp_replace(raw, lx.ACTOR_LEAD_IN, "")
    plain = squeeze_ends(F.regexp_replace(plain, lx.ACTOR_NUMBERING, ""))
    return let(plain, lambda p: F.when(p == "", "party").otherwise(squeeze_ends(F.element_at(F.split(p, ",", -1), -1))))


def mutual_language(text: Column) -> Column:
    return let(
        F.lower(text),
        lambda t: contains_any(t, lx.MUTUAL_PHRASES) | (F.contains(t, F.lit("party a")) & F.contains(t, F.lit("party b"))),
    )


def condition_phrase(sentence: Column) -> Column:
    return F.nullif(squeeze_ends(F.regexp_extract(sentence, lx.CONDITION_PATTERN, 0)), F.lit(""))


def exceptions_in(sentence: Column) -> Column:
    phrase = squeeze_ends(F.regexp_extract(sentence, lx.EXCEPTION_PATTERN, 1))
    parts = F.transform(F.split(phrase, lx.EXCEPTION_SPLIT, -1), lambda p: F.lower(squeeze_ends(p)))
    return F.filter(parts, lambda p: F.length(p) > 3)


def references_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(lx.REFERENCE_PATTERN), 1)


def obligation_fields(sentence: Column) -> Column:
    """The obligation a placed sentence states, null without a modal."""

    def build(s: Column) -> Column:
        text = s["text"]
        return let(
            modality(text),
            lambda m: F.when(
                m.isNotNull(),
                let(
                    clean_actor(_modal_part(text, m, "before")),
                    lambda actor: F.struct(
                        actor.alias("actor"),
                        m.alias("modality"),
                        _modal_part(text, m, "after").alias("action"),
                        condition_phrase(text).alias("condition"),
                        exceptions_in(text).alias("exceptions"),
                        (contains_any(F.lower(actor), lx.MUTUAL_ACTORS) | mutual_language(text)).alias("is_bilateral"),
                        quantities(text, s["start"]).alias("quantities"),
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        text.alias("quote"),
                    ),
                ),
            ),
        )

    return let(sentence, build)


def clause_facts_of(clause: Column, canonical_text: Column) -> Column:
    """Obligations and the facts rules test: actor, quantities, exceptions, references, symmetry."""

    def facts(obls: Column) -> Column:
        first = F.get(obls, F.lit(0))
        merged = F.aggregate(
            obls,
            quantities(clause["full_text"], clause["start"]),
            lambda acc, o: merge_quantities(acc, o["quantities"]),
        )
        return F.struct(
            clause["clause_index"].alias("clause_index"),
            clause["clause_number"].alias("clause_number"),
            clause["heading"].alias("heading"),
            clause["category"].alias("category"),
            clause["full_text"].alias("text"),
            clause["start"].alias("start"),
            clause["end"].alias("end"),
            clause["block_id"].alias("block_id"),
            clause["page_number"].alias("page_number"),
            first["actor"].alias("actor"),
            first["action"].alias("action"),
            F.when(F.size(obls) > 0, F.forall(obls, lambda o: o["is_bilateral"])).otherwise(mutual_language(clause["full_text"])).alias("is_bilateral"),
            merged.alias("quantities"),
            F.flatten(F.transform(obls, lambda o: o["exceptions"])).alias("exceptions"),
            references_in(clause["full_text"]).alias("references"),
            obls.alias("obligations"),
        )

    stated = F.filter(F.transform(placed_sentences(clause, canonical_text), obligation_fields), lambda o: o.isNotNull())
    return let(stated, facts)


#: Documents whose clauses are compared with each other, so that equal ones are analysed once.
BUNDLE = 500


def bundle_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with ``clauses`` and ``_own`` -> one row for up to ``BUNDLE`` of them: ``docs`` with ``_at``, the places of
    their clauses in ``texts``, which holds each pair of clause texts once."""
    for whole in batches:
        for start in range(0, whole.num_rows, BUNDLE):
            batch = whole.slice(start, BUNDLE)
            lists = batch.column("clauses")
            flat, own = lists.flatten(), batch.column("_own").flatten()
            fields = [flat.field("full_text"), flat.field("body_text"), pc.struct_field(own, "own"), pc.struct_field(own, "rest")]
            seen: dict[tuple, int] = {}
            at = [seen.setdefault(key, len(seen)) for key in zip(*(f.to_pylist() for f in fields), strict=True)]
            first = np.unique(np.array(at, dtype=np.int64), return_index=True)[1]
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
            names = [n for n in batch.schema.names if n != "_own"]
            docs = pa.StructArray.from_arrays([*(batch.column(n) for n in names), places], [*names, "_at"])
            texts = pa.StructArray.from_arrays([f.take(pa.array(first)) for f in fields], ["full_text", "body_text", "own", "rest"])
            one = lambda items: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
            yield pa.RecordBatch.from_arrays([one(docs), one(texts)], ["docs", "texts"])


def _alone(text: Column) -> Column:
    """Facts of a clause that begins its document."""
    own = F.coalesce(text["own"], text["full_text"])
    none = F.lit(None)
    clause = F.struct(
        text["full_text"].alias("full_text"), text["body_text"].alias("body_text"), F.lit(0).alias("start"), F.length(own).alias("end"),
        none.cast("int").alias("clause_index"), none.cast("int").alias("page_number"),
        *[none.cast("string").alias(n) for n in ("clause_number", "heading", "category", "block_id")],
    )
    return let(clause, lambda c: clause_facts_of(c, F.coalesce(text["rest"], own)))


def _own_texts(clause: Column, canonical_text: Column) -> Column:
    """What a clause's sentences are sought in, null if that is its full text: its slice of the canonical text, and
    the whole ``rest`` of that from its start if a sentence has a place that does not end within the slice."""

    def build(own: Column) -> Column:
        body = F.when(clause["body_text"] != "", clause["body_text"]).otherwise(clause["full_text"])

        def beyond(s: Column) -> Column:
            return F.contains(F.substring(canonical_text, F.greatest(clause["start"], clause["end"] - F.length(s) + 1) + 1, F.length(canonical_text)), s)

        rest = F.when(F.exists(split_sentences(body), beyond), F.substring(canonical_text, clause["start"] + 1, F.length(canonical_text)))
        return F.when(own != clause["full_text"], F.struct(own.alias("own"), rest.alias("rest")))

    return let(F.substring(canonical_text, clause["start"] + 1, clause["end"] - clause["start"]), build)


def _moved(facts: Column, clause: Column) -> Column:
    """Facts of a clause alone at the place of an equal clause."""
    by = clause["start"]
    shift = lambda x: x.withField("start", x["start"] + by).withField("end", x["end"] + by)
    out = facts.withField("quantities", F.transform(facts["quantities"], shift))
    out = out.withField("obligations", F.transform(facts["obligations"], lambda o: shift(o).withField("quantities", F.transform(o["quantities"], shift))))
    for name in ("clause_index", "clause_number", "heading", "category", "start", "end", "block_id", "page_number"):
        out = out.withField(name, clause[name])
    return out


def extract_facts(segmented: DataFrame, *keep: str) -> DataFrame:
    """Add ``facts``: one struct per clause with its obligations inside; of other columns ``keep``, all by default.

    The facts of a clause follow from its texts, so equal clauses of a bundle of documents are analysed once.
    """
    names = list(keep or segmented.columns)
    base = segmented.select(*dict.fromkeys([*names, "clauses", "canonical_text"]))
    own = let(F.col("canonical_text"), lambda text: F.transform("clauses", lambda c: _own_texts(c, text)))
    sent = base.withColumn("_own", own).select(*dict.fromkeys([*names, "clauses"]), "_own")
    doc = T.StructType([*[f for f in sent.schema.fields if f.name != "_own"], T.StructField("_at", T.ArrayType(T.IntegerType()))])
    texts = "array<struct<full_text:string,body_text:string,own:string,rest:string>>"
    bundles = sent.mapInArrow(bundle_documents, f"docs array<{doc.simpleString()}>, texts {texts}")

    def facts_of(d: Column) -> Column:
        return F.zip_with(d["clauses"], d["_at"], lambda c, i: _moved(F.get("_known", i), c))

    analysed = bundles.withColumn("_known", F.transform("texts", lambda t: let(t, _alone)))
    rows = F.transform("docs", lambda d: F.struct(*[d[n].alias(n) for n in names], F.when(d["clauses"].isNotNull(), facts_of(d)).alias("facts")))
    return unnest(analysed, rows, name="_d").select("_d.*")


def fact_rows(with_facts: DataFrame, key: str = "version_id") -> DataFrame:
    return unnest(with_facts, F.col("facts"), key).select(key, "_item.*")


def obligation_rows(with_facts: DataFrame, key: str = "version_id") -> DataFrame:
    """One row per obligation."""
    per_clause = unnest(with_facts, F.col("facts"), key).select(key, F.col("_item.clause_index").alias("clause_index"), F.col("_item.obligations").alias("_o"))
    return unnest(per_clause, F.col("_o"), key, "clause_index", position="obligation_index").select(
        key, "clause_index", "obligation_index", "_item.*"
    )


def sentence_rows(segmented: DataFrame, key: str = "version_id") -> DataFrame:
    """One row per placed sentence."""
    placed = let(F.col("canonical_text"), lambda text: F.transform("clauses", lambda c: F.struct(
        c["clause_index"].alias("clause_index"), placed_sentences(c, text).alias("sentences"))))
    per_clause = unnest(segmented.withColumn("_s", placed), F.col("_s"), key).select(key, "_item.*")
    return unnest(per_clause, F.col("sentences"), key, "clause_index", position="sentence_index").select(
        key, "clause_index", "sentence_index", "_item.*"
    )


# --- document level -----------------------------------------------------------------


def infer_playbook(canonical_text: Column) -> Column:
    """Playbook by wording. 'nda' also hits 'standard' or 'calendar'; kept as the labels expect."""
    return let(F.lower(canonical_text), lambda t: first_label(t, lx.PLAYBOOK_WORDS, F.lit(lx.DEFAULT_PLAYBOOK)))


def contract_summary(analyzed: DataFrame, key: str = "version_id") -> DataFrame:
    """Clause, obligation and severity counts and the bilateral share per document."""
    obligations = F.flatten(F.transform("facts", lambda f: f["obligations"]))
    count = lambda level: F.size(F.filter("findings", lambda f: f["severity"] == level))
    return analyzed.select(
        key,
        F.size("clauses").alias("total_clauses"),
        F.transform(F.array(obligations), lambda os: F.struct(
            F.size(os).alias("n"), F.size(F.filter(os, lambda o: o["is_bilateral"])).alias("b"))).getItem(0).alias("_o"),
        *[count(level).alias(f"{level}_findings") for level in lx.SEVERITIES[:4]],
    ).select(
        key,
        "total_clauses",
        F.col("_o.n").alias("total_obligations"),
        *[f"{level}_findings" for level in lx.SEVERITIES[:4]],
        F.when(F.col("_o.n") > 0, half_up(F.col("_o.b") / F.col("_o.n"), 2)).otherwise(F.lit(1.0)).alias("bilateral_ratio"),
    )
