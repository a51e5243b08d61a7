"""Candidate profiles: sections, contact, roles, experience, education, skills, certifications.

A profile is built inside the resume's own row; ``as_of`` (year*12+month) closes open roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import first_where, let, unnest
from lexfolio.functions.skills import skills_in
from lexfolio.functions.text import half_up, squeeze_ends

_SKILL = "struct<name:string,category:string,source:string,evidence:string,start:int,end:int,block_id:string>"


def section_heads(blocks: Column) -> Column:
    """Section name per block that is a section header, else null."""

    def head(b: Column) -> Column:
        def build(t: Column) -> Column:
            is_header = (b["block_type"] == "heading") | ((F.length(t) < 40) & (F.length(t) > 3) & (t == F.upper(t)))
            expr = None
            low = F.lower(t)
            for name, words in lx.RESUME_SECTIONS:
                cond = low.rlike("|".join(words))
                expr = F.when(cond, name) if expr is None else expr.when(cond, name)
            return F.when(is_header, expr)

        return let(squeeze_ends(b["text"]), build)

    return F.transform(blocks, head)


def section_blocks(blocks: Column, heads: Column, name: str) -> Column:
    """Blocks of the first section of that name."""

    def cut(at: Column) -> Column:
        lo = first_where(at, lambda i: F.get(heads, i) == name)
        return let(
            lo,
            lambda lo: let(
                F.coalesce(first_where(at, lambda i: i > lo), F.size(blocks)),
                lambda hi: F.when(lo.isNotNull(), F.slice(blocks, lo + 2, hi - lo - 1)).otherwise(F.slice(blocks, 1, 0)),
            ),
        )

    positions = F.filter(F.transform(heads, lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull())
    return let(positions, cut)


def contact_of(blocks: Column, heads: Column, top: int | None = None) -> Column:
    """struct<name,email,phone,linkedin,github,location> from the head of a resume.

    That is every block before the first section head, and eight at least; ``top`` sets a fixed number instead.
    """

    def some(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    def build(top: Column) -> Column:
        lines = F.transform(top, lambda b: squeeze_ends(F.element_at(F.split(squeeze_ends(b["text"]), "\n", -1), 1)))
        name = first_where(
            lines, lambda l: (F.length(l) > 2) & (F.length(l) < 40) & ~F.contains(l, F.lit("@")) & ~F.contains(l, F.lit("http")) & ~l.rlike(r"\d{3}")
        )
        return let(
            F.array_join(F.transform(top, lambda b: b["text"]), "\n"),
            lambda t: let(
                F.regexp_extract(t, lx.LOCATION_PATTERN, 1),
                lambda loc: F.struct(
                    name.alias("name"),
                    some(F.regexp_extract(t, lx.EMAIL_PATTERN, 1)).alias("email"),
                    some(squeeze_ends(F.regexp_extract(t, lx.PHONE_PATTERN, 0))).alias("phone"),
                    some(F.regexp_extract(t, lx.LINKEDIN_PATTERN, 0)).alias("linkedin"),
                    some(F.regexp_extract(t, lx.GITHUB_PATTERN, 0)).alias("github"),
                    F.when((loc != "") & ~F.lower(loc).rlike("university|college"), squeeze_ends(loc)).alias("location"),
                ),
            ),
        )

    if top is not None:
        return let(F.slice(blocks, 1, top), build)
    before = F.coalesce(first_where(F.transform(heads, lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()), F.size(blocks))
    return let(F.greatest(F.lit(8), before), lambda n: let(F.slice(blocks, F.lit(1), n), build))


def month_number(name: Column, default: int) -> Column:
    """Month of a name or a two-digit number; anything else is the default."""
    key = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    by_name = F.array_position(F.array(*[F.lit(m) for m in lx.MONTHS]), F.left(key, F.lit(3))).cast("int")
    digits = F.when(key.rlike(r"^(0[1-9]|1[0-2])\z"), key.cast("int"))
    return F.coalesce(digits, F.when(key.rlike("^[a-z]") & (by_name > 0), by_name), F.lit(default))


def date_span(text: Column) -> Column:
    """struct<hit,start_month,end_month,is_current,start_text,end_text> of the first date range, null if none."""

    def build(hit: Column) -> Column:
        g = lambda n: F.regexp_extract(hit, lx.DATE_SPAN_PATTERN, n)
        current = F.lower(g(3)).rlike("present|current|now")
        label = lambda m, y: F.when(m != "", F.concat_ws(" ", m, y)).otherwise(y)
        return F.when(
            hit != "",
            F.struct(
                hit.alias("hit"),
                (g(2).cast("int") * 12 + month_number(g(1), 1)).alias("start_month"),
                F.when(~current & (g(5) != ""), F.nullif(g(5), F.lit("")).cast("int") * 12 + month_number(g(4), 12)).alias("end_month"),
                current.alias("is_current"),
                label(g(1), g(2)).alias("start_text"),
                F.when(current, "Present").otherwise(label(g(4), g(5))).alias("end_text"),
            ),
        )

    return let(F.regexp_extract(text, lx.DATE_SPAN_PATTERN, 0), build)


def title_company(text: Column) -> Column:
    def build(parts: Column) -> Column:
        two = F.size(parts) >= 2
        title = F.nullif(squeeze_ends(F.get(parts, F.lit(0))), F.lit(""))
        company = F.when(two, F.nullif(squeeze_ends(F.get(parts, F.lit(1))), F.lit("")))
        return F.struct(F.coalesce(title, F.lit("Engineer")).alias("title"), F.coalesce(company, F.lit("Company")).alias("company"))

    return let(F.split(text, lx.TITLE_SPLIT_PATTERN, -1), build)


def bullets_of(block: Column) -> Column:
    """array<struct<text,start,end,block_id>>: marker-free lines over five characters, else the whole text."""
    bullet = "struct<text:string,start:int,end:int,block_id:string>"
    state = f"struct<at:int,out:array<{bullet}>>"

    def place(text: Column, lines: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            return let(
                F.call_function("locate", line, text, acc["at"] + 1) - 1,
                lambda p: F.struct(
                    (p + F.length(line)).alias("at"),
                    F.concat(acc["out"], F.array(F.struct(
                        line.alias("text"), (block["start"] + p).alias("start"), (block["start"] + p + F.length(line)).alias("end"), block["block_id"].alias("block_id")
                    ).cast(bullet))).alias("out"),
                ).cast(state),
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{bullet}>").alias("out")).cast(state)
        return F.aggregate(lines, start, step, lambda acc: acc["out"])

    def build(text: Column) -> Column:
        lines = F.filter(
            F.transform(F.split(text, "\n", -1), lambda l: squeeze_ends(F.regexp_replace(l, lx.BULLET_MARKER, ""))), lambda l: F.length(l) > 5
        )
        return let(lines, lambda ls: place(text, F.when(F.size(ls) > 0, ls).otherwise(F.array(text))))

    return let(squeeze_ends(block["text"]), build)


def roles_of(experience: Column) -> Column:
    """Roles open at blocks with a date range; later blocks are their bullets."""

    def opening(b: Column) -> Column:
        t = squeeze_ends(b["text"])
        short = (b["block_type"] == "heading") | (F.length(t) < 160) | (~F.startswith(t, F.lit("•")) & ~F.startswith(t, F.lit("-")))
        return F.when(short, date_span(t))

    def role(bs: Column, spans: Column, starts: Column, lo: Column, j: Column) -> Column:
        hi = F.coalesce(F.get(starts, j + 1), F.size(bs))
        head, span = F.get(bs, lo), F.get(spans, lo)
        rest = squeeze_ends(F.regexp_replace(squeeze_ends(_without(squeeze_ends(head["text"]), span["hit"])), lx.HEADER_TAIL_PATTERN, ""))
        return let(
            title_company(rest),
            lambda tc: F.struct(
                j.cast("int").alias("role_index"),
                tc["title"].alias("title"),
                tc["company"].alias("company"),
                span["start_text"].alias("start_text"),
                span["end_text"].alias("end_text"),
                span["start_month"].alias("start_month"),
                span["end_month"].alias("end_month"),
                span["is_current"].alias("is_current"),
                head["start"].alias("start"),
                F.get(bs, hi - 1)["end"].alias("end"),
                head["block_id"].alias("block_id"),
                F.flatten(F.transform(F.slice(bs, lo + 2, hi - lo - 1), bullets_of)).alias("bullets"),
            ),
        )

    def build(bs: Column) -> Column:
        return let(
            F.transform(bs, opening),
            lambda spans: let(
                F.filter(F.transform(spans, lambda s, i: F.when(s.isNotNull(), i)), lambda i: i.isNotNull()),
                lambda starts: F.transform(starts, lambda lo, j: role(bs, spans, starts, lo, j)),
            ),
        )

    return let(experience, build)


def _without(text: Column, part: Column) -> Column:
    """Text with the first occurrence of ``part`` removed."""
    at = F.call_function("instr", text, part)
    return F.concat(F.left(text, at - 1), F.substring(text, at + F.length(part), F.length(text)))


def experience_months(roles: Column, as_of: int) -> Column:
    """Months covered by at least one role, both ends included; twelve per role if no range is usable."""
    state = "struct<lo:int,hi:int,total:int>"

    def add(acc: Column, v: Column) -> Column:
        joined = v["s"] <= acc["hi"]
        closed = F.greatest(F.lit(1), acc["hi"] - acc["lo"] + 1)
        return F.when(joined, F.struct(acc["lo"].alias("lo"), F.greatest(acc["hi"], v["e"]).alias("hi"), acc["total"].alias("total")).cast(state)).otherwise(
            F.struct(v["s"].alias("lo"), v["e"].alias("hi"), (acc["total"] + closed).alias("total")).cast(state)
        )

    def merge(iv: Column) -> Column:
        first = F.get(iv, F.lit(0))
        begin = F.struct(first["s"].alias("lo"), first["e"].alias("hi"), F.lit(0).alias("total")).cast(state)
        return F.when(
            F.size(iv) > 0,
            F.aggregate(F.slice(iv, 2, F.size(iv)), begin, add, lambda acc: acc["total"] + F.greatest(F.lit(1), acc["hi"] - acc["lo"] + 1)),
        ).otherwise(F.size(roles) * 12)

    spans = F.transform(
        roles,
        lambda r: F.struct(
            r["start_month"].alias("s"),
            F.when(r["is_current"] | r["end_month"].isNull(), F.lit(as_of)).otherwise(r["end_month"]).alias("e"),
        ),
    )
    return let(F.array_sort(F.filter(spans, lambda v: v["s"].isNotNull() & (v["e"] >= v["s"]))), merge)


def education_of(blocks: Column) -> Column:
    def entry(b: Column) -> Column:
        def build(t: Column) -> Column:
            degree = squeeze_ends(F.regexp_extract(t, lx.DEGREE_PATTERN, 0))
            school = squeeze_ends(F.regexp_extract(t, lx.SCHOOL_PATTERN, 0))
            return F.when(
                t.rlike(lx.DEGREE_PATTERN) | t.rlike(lx.SCHOOL_PATTERN),
                F.struct(
                    F.when(t.rlike(lx.SCHOOL_PATTERN), school).otherwise(squeeze_ends(F.element_at(F.split(t, "\n", -1), 1))).alias("institution"),
                    F.when(t.rlike(lx.DEGREE_PATTERN), degree).alias("degree"),
                    F.nullif(F.regexp_extract(t, lx.GRADUATION_PATTERN, 1), F.lit("")).cast("int").alias("graduation_year"),
                    b["start"].alias("start"), b["end"].alias("end"), b["block_id"].alias("block_id"),
                ),
            )

        return let(squeeze_ends(b["text"]), build)

    return F.filter(F.transform(blocks, entry), lambda e: e.isNotNull())


def profile_skills(skill_blocks: Column, roles: Column) -> Column:
    """Skills of the skills section, then those of bullets; the first evidence of each is kept."""

    def evidenced(source: str, text: Column, at: Column) -> Column:
        return F.transform(skills_in(text), lambda s: F.struct(
            s["name"].alias("name"), s["category"].alias("category"), F.lit(source).alias("source"), text.alias("evidence"),
            at["start"].alias("start"), at["end"].alias("end"), at["block_id"].alias("block_id")).cast(_SKILL))

    explicit = F.flatten(F.transform(skill_blocks, lambda b: evidenced("explicit", squeeze_ends(b["text"]), b)))
    bullets = F.flatten(F.transform(roles, lambda r: r["bullets"]))
    inferred = F.flatten(F.transform(bullets, lambda b: evidenced("inferred", b["text"], b)))
    return F.aggregate(
        F.concat(explicit, inferred),
        F.array().cast(f"array<{_SKILL}>"),
        lambda acc, s: F.when(F.exists(acc, lambda a: a["name"] == s["name"]), acc).otherwise(F.concat(acc, F.array(s))),
    )


def certifications_of(blocks: Column) -> Column:
    lines = F.flatten(F.transform(blocks, lambda b: F.split(b["text"], "\n", -1)))
    return F.filter(F.transform(lines, lambda l: squeeze_ends(F.regexp_replace(l, lx.CERT_MARKER, ""))), lambda l: F.length(l) > 3)


def extract_profiles(canonical: DataFrame, as_of: int, key: str = "version_id", contact_blocks: int | None = None) -> DataFrame:
    """Canonical resumes -> one profile row each; no shuffle. ``contact_blocks``: see ``contact_of``."""
    heads = canonical.withColumn("_heads", section_heads(F.col("blocks")))
    cut = heads.withColumns({
        f"_{name}": section_blocks(F.col("blocks"), F.col("_heads"), name)
        for name in ("summary", "experience", "education", "skills", "certifications")
    })
    has_summary = F.array_contains("_heads", "summary")
    with_roles = cut.select(
        key, "blocks", "_education", "_skills", "_certifications",
        contact_of(F.col("blocks"), F.col("_heads"), contact_blocks).alias("contact"),
        F.when(has_summary, squeeze_ends(F.array_join(F.transform("_summary", lambda b: b["text"]), "\n\n"))).alias("summary_text"),
        roles_of(F.col("_experience")).alias("roles"),
    )
    measured = with_roles.select(
        key, "blocks", "contact", "summary_text", "roles",
        experience_months(F.col("roles"), as_of).alias("total_months"),
        education_of(F.col("_education")).alias("education"),
        profile_skills(F.col("_skills"), F.col("roles")).alias("skills"),
        certifications_of(F.col("_certifications")).alias("certifications"),
    )
    return measured.withColumn("total_years", half_up(F.col("total_months") / 12, 1))


def role_rows(profiles: DataFrame, key: str = "version_id") -> DataFrame:
    return unnest(profiles, F.col("roles"), key).select(key, "_item.*")


def bullet_rows(profiles: DataFrame, key: str = "version_id") -> DataFrame:
    roles = unnest(profiles, F.col("roles"), key).select(key, F.col("_item.role_index").alias("role_index"), F.col("_item.bullets").alias("_bs"))
    return unnest(roles, F.col("_bs"), key, "role_index", position="bullet_index").select(key, "role_index", "bullet_index", "_item.*")
