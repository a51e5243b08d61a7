"""Skill ontology lookups as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import let
from lexfolio.functions.text import squeeze_ends

SKILL = "struct<name:string,category:string>"


def _bounded(alias: str) -> str:
    """The alias between ASCII word boundaries; a boundary next to a symbol needs a word character beyond it."""
    word = "[A-Za-z0-9_]"
    left = f"(?<!{word})" if re.match(r"\w", alias[0]) else f"(?<={word})"
    right = f"(?!{word})" if re.match(r"\w", alias[-1]) else f"(?={word})"
    return left + re.sub(r"([.+*?^${}()|\[\]\\#])", r"\\\1", alias) + right


def skills_in(text: Column) -> Column:
    """array<struct<name,category>> of the skills named in a text, in ontology order."""

    def build(low: Column) -> Column:
        # A plain substring test rules most skills out before any pattern runs.
        found = [
            F.when(
                reduce(or_, [F.contains(low, F.lit(a)) for a in aliases]) & low.rlike("|".join(_bounded(a) for a in aliases)),
                F.struct(F.lit(name).alias("name"), F.lit(cat).alias("category")),
            )
            for name, cat, aliases in lx.SKILLS
        ]
        return F.filter(F.array(*found), lambda s: s.isNotNull()).cast(f"array<{SKILL}>")

    return let(F.lower(text), build)


def canonical_skill(term: Column) -> Column:
    """Canonical name of an alias; an unknown term comes back trimmed."""
    pairs = []
    for name, _, aliases in lx.SKILLS:
        for alias in dict.fromkeys((name.lower(), *aliases)):
            pairs += [F.lit(alias), F.lit(name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(squeeze_ends(term))), squeeze_ends(term))
