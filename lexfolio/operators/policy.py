"""Rule playbooks over clause facts.

A playbook is data. Its condition trees become Column expressions over the ``facts``
array of a document, so all rules of a document are tested in its own row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import first_where, last_with, let, shuffled, unnest
from lexfolio.functions.text import contains_any, fill_template, number_text, slice_text
from lexfolio.playbooks import PLAYBOOKS

_CITES = "array<struct<block_id:string,quote:string>>"
_DETAILS = "array<struct<key:string,value:string>>"
_OUTCOME = f"struct<passed:boolean,details:{_DETAILS},cites:{_CITES}>"


def _cite(block_id: Column, quote: Column) -> Column:
    return F.struct(block_id.alias("block_id"), quote.alias("quote"))


def _outcome(passed: Column, details: dict[str, Column] | None = None, cites: Column | None = None) -> Column:
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (details or {}).items()]
    known = F.filter(F.array(*pairs), lambda d: d["value"].isNotNull()) if pairs else F.array().cast(_DETAILS)
    return F.struct(
        passed.alias("passed"), known.alias("details"), (F.array().cast(_CITES) if cites is None else cites).alias("cites")
    ).cast(_OUTCOME)


# --- leaf conditions -----------------------------------------------------------------


def _presence(cond: dict, facts: Column) -> Column:
    def fits(f: Column) -> Column:
        same = f["category"] == cond["category"]
        if cond["category"] == "at_will":
            words = F.lower(F.concat_ws(" ", f["text"], F.coalesce(f["actor"], F.lit(""))))
            return same | contains_any(words, ("at-will", "at will", "with or without cause"))
        return same

    def judge(found: Column) -> Column:
        details = {"clauseCount": F.size(found), "category": F.lit(cond["category"])}
        if cond["expected"] == "present":
            return _outcome(F.size(found) > 0, details)
        return _outcome(F.size(found) == 0, details, F.transform(found, lambda f: _cite(f["block_id"], f["text"])))

    return let(F.filter(facts, fits), judge)


def _compare(value: Column, op: str, threshold: float) -> Column:
    t = F.lit(float(threshold))
    return {">": value > t, "<": value < t, ">=": value >= t, "<=": value <= t, "==": value == t, "!=": value != t}[op]


def _threshold(cond: dict, facts: Column) -> Column:
    def value_of(f: Column) -> Column:
        return let(
            first_where(f["quantities"], lambda q: q["field"] == cond["field"]),
            lambda q: F.when(q.isNotNull(), F.struct(
                q["value"].alias("value"), f["block_id"].alias("block_id"),
                F.when(q["raw"] != "", q["raw"]).otherwise(f["text"]).alias("quote"))),
        )

    def judge(bad: Column) -> Column:
        last = F.try_element_at(bad, F.lit(-1))["value"]
        seen = F.when(last.isNotNull(), F.lit(True))
        details = {
            "extractedValue": number_text(last), "actualValue": number_text(last),
            "threshold": F.when(seen, number_text(F.lit(float(cond["threshold"])))), "unit": F.when(seen, cond["unit"]),
        }
        return _outcome(F.size(bad) == 0, details, F.transform(bad, lambda b: _cite(b["block_id"], b["quote"])))

    values = F.filter(F.transform(facts, value_of), lambda v: v.isNotNull())
    return let(F.filter(values, lambda v: ~_compare(v["value"], cond["operator"], cond["threshold"])), judge)


def _prohibited(cond: dict, facts: Column) -> Column:
    pattern = cond["pattern"] if cond.get("caseSensitive") else "(?i)" + cond["pattern"]
    scope = F.filter(facts, lambda f: f["category"] == cond["scopeCategory"]) if cond.get("scopeCategory") else facts
    hits = F.transform(F.filter(scope, lambda f: f["text"].rlike(pattern)), lambda f: _cite(f["block_id"], F.regexp_extract(f["text"], pattern, 0)))
    return let(hits, lambda h: _outcome(F.size(h) == 0, {"prohibitedMatch": F.try_element_at(h, F.lit(-1))["quote"]}, h))


def _exception(cond: dict, facts: Column) -> Column:
    twins = {"liability": "liability_limitation", "liability_limitation": "liability"}
    scope = [cond["scopeCategory"], *([twins[cond["scopeCategory"]]] if cond["scopeCategory"] in twins else [])]

    def judge(found: Column) -> Column:
        def missing(text: Column) -> Column:
            absent = [
                F.when(~contains_any(text, (req.lower(), *lx.EXCEPTION_SYNONYMS.get(req.lower(), ()))), F.lit(req))
                for req in cond["requiredExceptions"]
            ]
            return F.filter(F.array(*absent), lambda m: m.isNotNull())

        first = F.get(found, F.lit(0))
        return let(
            missing(F.array_join(F.transform(found, lambda f: F.lower(f["text"])), " ")),
            lambda gone: F.when(
                (F.size(found) > 0) & (F.size(gone) > 0),
                _outcome(F.lit(False), {"missingExceptions": F.array_join(gone, ",")}, F.array(_cite(first["block_id"], first["text"]))),
            ).otherwise(_outcome(F.lit(True))),
        )

    return let(F.filter(facts, lambda f: f["category"].isin(scope)), judge)


def _asymmetry(cond: dict, facts: Column) -> Column:
    def judge(found: Column) -> Column:
        mutual = F.exists(found, lambda f: contains_any(F.lower(f["text"]), lx.SYMMETRY_WORDS))
        return let(
            first_where(found, lambda f: ~f["is_bilateral"]),
            lambda one: F.when(
                one.isNotNull() & ~mutual,
                _outcome(F.lit(False), {"asymmetricParty": F.coalesce(F.nullif(one["actor"], F.lit("")), F.lit("unilateral"))},
                         F.array(_cite(one["block_id"], one["text"]))),
            ).otherwise(_outcome(F.lit(True))),
        )

    return let(F.filter(facts, lambda f: f["category"] == cond["obligationCategory"]), judge)


def defined_sections(facts: Column) -> Column:
    """Clause numbers and lower-case headings a reference may point to."""
    numbers = F.filter(F.transform(facts, lambda f: f["clause_number"]), lambda n: n != "")
    return F.array_distinct(F.concat(numbers, F.transform(facts, lambda f: F.lower(f["heading"]))))


def _broken(cond: dict, facts: Column) -> Column:
    def per_clause(f: Column, defined: Column) -> Column:
        return F.transform(
            F.filter(f["references"], lambda r: ~F.array_contains(defined, r)),
            lambda r: F.struct(r.alias("ref"), _cite(f["block_id"], f["text"]).alias("cite")),
        )

    def judge(bad: Column) -> Column:
        last = F.try_element_at(bad, F.lit(-1))["ref"]
        return _outcome(F.size(bad) == 0, {"brokenReference": last, "brokenRef": last}, F.transform(bad, lambda b: b["cite"]))

    return let(defined_sections(facts), lambda d: let(F.flatten(F.transform(facts, lambda f: per_clause(f, d))), judge))


_LEAVES = {
    "clause_presence": _presence,
    "numeric_threshold": _threshold,
    "prohibited_formulation": _prohibited,
    "required_exception": _exception,
    "party_asymmetry": _asymmetry,
    "broken_cross_reference": _broken,
}


def evaluate_condition(cond: dict, facts: Column) -> Column:
    """struct<passed, details, cites>. Compound nodes stop early but keep what failed branches cited."""
    kind = cond["type"]
    if kind in _LEAVES:
        return _LEAVES[kind](cond, facts)
    if kind == "logical_not":
        return let(evaluate_condition(cond["condition"], facts), lambda o: o.withField("passed", ~o["passed"]))
    go_on_while = kind == "logical_and"

    def chain(done: Column, rest: list[dict]) -> Column:
        if not rest:
            return done
        step = let(evaluate_condition(rest[0], facts), lambda o: F.struct(
            o["passed"].alias("passed"), F.concat(done["details"], o["details"]).alias("details"), F.concat(done["cites"], o["cites"]).alias("cites")
        ).cast(_OUTCOME))
        open_ = done["passed"] if go_on_while else ~done["passed"]
        return let(F.when(open_, step).otherwise(done), lambda d: chain(d, rest[1:]))

    return let(_outcome(F.lit(go_on_while)), lambda d: chain(d, cond["conditions"]))


# --- documents -------------------------------------------------------------------------


def anchor(quote: Column, block_id: Column, text: Column, blocks: Column) -> Column:
    """Citation re-anchored at the first occurrence of the quote, else at its block."""

    def build(b: Column, at: Column) -> Column:
        found = at > 0
        start = F.when(found, at - 1).otherwise(F.coalesce(b["start"], F.lit(0)))
        return F.struct(
            block_id.alias("block_id"),
            F.coalesce(b["page_number"], F.lit(1)).alias("page_number"),
            start.alias("start"),
            F.when(found, at - 1 + F.length(quote)).otherwise(F.coalesce(b["end"], start + 10)).alias("end"),
            quote.alias("quote"),
            F.coalesce(b["confidence"], F.lit(0.95)).alias("confidence"),
            F.when(F.coalesce(b["is_ocr"], F.lit(False)), "ocr").otherwise("digital_text").alias("source_type"),
        )

    return let(
        first_where(blocks, lambda b: b["block_id"] == block_id),
        lambda b: let(F.call_function("instr", text, quote), lambda at: build(b, at)),
    )


def rule_result(rule: dict, facts: Column, text: Column, blocks: Column, mean_confidence: Column) -> Column:
    """Trace and finding fields of one rule for one document."""
    keys = ("clauseCount", "category", "extractedValue", "actualValue", "threshold", "unit", "prohibitedMatch",
            "missingExceptions", "asymmetricParty", "brokenReference", "brokenRef")
    cond = rule["condition"]
    must_exist = cond["type"] == "clause_presence" and cond["expected"] == "present"
    patch = rule.get("patchTemplate")

    def build(o: Column) -> Column:
        values = {k: last_with(o["details"], "key", k)["value"] for k in keys}
        abstained = ~o["passed"] & (mean_confidence < lx.ABSTAIN_BELOW) if must_exist else F.lit(False)
        return F.struct(
            F.lit(rule["id"]).alias("rule_id"),
            F.lit(rule["name"]).alias("title"),
            F.lit(rule["category"]).alias("category"),
            F.lit(rule["severity"]).alias("severity"),
            F.lit(cond["type"]).alias("condition_type"),
            o["passed"].alias("passed"),
            abstained.alias("abstained"),
            o["details"].alias("details"),
            fill_template(rule["explanationTemplate"], values).alias("explanation"),
            F.lit(rule.get("suggestedAction")).cast("string").alias("suggested_action"),
            F.lit(patch["replacementText"] if patch else None).cast("string").alias("patch_text"),
            F.lit(patch["explanation"] if patch else None).cast("string").alias("patch_explanation"),
            F.transform(o["cites"], lambda c: anchor(c["quote"], c["block_id"], text, blocks)).alias("citations"),
        )

    return let(evaluate_condition(cond, facts), build)


def _results_of(rules: list[dict], doc: Column) -> Column:
    return let(
        doc, lambda d: F.array(*[rule_result(r, d["facts"], d["canonical_text"], d["blocks"], d["mean"]) for r in rules])
    )


def evaluate_playbooks(docs: DataFrame, playbook: str = "playbook", playbooks: dict[str, list[dict]] | None = None) -> DataFrame:
    """Add ``results`` (one struct per rule of the document's playbook) and ``findings``.

    ``docs`` needs canonical_text, blocks and facts. Documents of an unknown playbook get none.
    """
    mean = F.when(F.size("blocks") > 0, F.aggregate("blocks", F.lit(0.0), lambda a, b: a + b["confidence"]) / F.size("blocks")).otherwise(F.lit(0.95))
    results = None
    for name, rules in (playbooks or PLAYBOOKS).items():
        branch = _results_of(rules, F.struct("facts", "canonical_text", "blocks", mean.alias("mean")))
        cond = F.col(playbook) == name
        results = F.when(cond, branch) if results is None else results.when(cond, branch)
    with_results = docs.withColumn("results", results)
    return with_results.withColumn(
        "findings", F.filter(F.coalesce("results", F.filter("results", lambda r: F.lit(False))), lambda r: ~r["passed"] & ~r["abstained"])
    )


def trace_rows(evaluated: DataFrame, key: str = "version_id") -> DataFrame:
    """One row per document and rule, before failures are filtered."""
    return unnest(evaluated, F.col("results"), key).select(
        key, "_item.rule_id", "_item.title", "_item.severity", "_item.condition_type", "_item.passed", "_item.abstained", "_item.details",
        F.size("_item.citations").alias("citation_count"),
    )


def finding_rows(evaluated: DataFrame, key: str = "version_id") -> DataFrame:
    """One row per finding with a deterministic id and the patch taken from its first citation."""
    rows = unnest(evaluated, F.col("findings"), key)
    f = F.col("_item")
    first = F.get(f["citations"], F.lit(0))
    patched = f["patch_text"].isNotNull() & first.isNotNull()
    return rows.select(
        key,
        F.sha2(F.concat_ws(":", F.lit("finding"), key, f["rule_id"]), 256).alias("finding_id"),
        F.lit("contract_review").alias("workflow"),
        *[f[c].alias(c) for c in ("rule_id", "category", "severity", "title", "explanation", "suggested_action")],
        F.when(patched, first["start"]).alias("patch_start"),
        F.when(patched, first["end"]).alias("patch_end"),
        F.when(patched, first["quote"]).alias("patch_original"),
        F.when(patched, f["patch_text"]).alias("patch_replacement"),
        F.lit("high").alias("confidence"),
        F.lit("pending").alias("decision_state"),
        f["citations"].alias("citations"),
    )


def citation_rows(findings: DataFrame, key: str = "version_id") -> DataFrame:
    return unnest(findings, F.col("citations"), key, "finding_id", position="citation_index").select(
        key, "finding_id", "citation_index", "_item.*"
    )


def realign(quote: Column, start: Column, end: Column, text: Column) -> Column:
    """struct<start,end>: kept if the slice equals the quote, else its first occurrence if any."""
    at = F.call_function("instr", text, quote)
    move = (slice_text(text, start, end) != quote) & (at > 0) & (quote != "")
    return F.struct(
        F.when(move, at - 1).otherwise(start).alias("start"), F.when(move, at - 1 + F.length(quote)).otherwise(end).alias("end")
    )


def broken_references(facts: DataFrame, key: str = "version_id") -> DataFrame:
    """References to sections a document does not have, as an anti-join over flat clause facts."""
    refs = facts.select(key, "clause_index", F.posexplode("references").alias("ref_index", "ref"))
    names = facts.select(key, F.explode(F.array("clause_number", F.lower("heading"))).alias("ref")).filter(F.col("ref") != "")
    return refs.join(shuffled(names.distinct()), [key, "ref"], "left_anti")


# --- rule tables --------------------------------------------------------------------------


def _rule_error(text: str | None) -> str | None:
    """Error code of one rule in JSON; conditions nest without limit, hence plain recursion."""
    syntax, typ = "POLICY_SYNTAX_ERROR", "POLICY_TYPE_ERROR"

    def condition(c) -> str | None:
        kind = c.get("type") if isinstance(c, dict) else None
        if not kind:
            return syntax
        if kind in ("logical_and", "logical_or"):
            children = c.get("conditions")
            if not isinstance(children, list) or not children:
                return syntax
            return next((e for e in map(condition, children) if e), None)
        if kind == "logical_not":
            return condition(c["condition"]) if c.get("condition") else syntax
        if kind == "numeric_threshold":
            number = isinstance(c.get("threshold"), (int, float)) and not isinstance(c.get("threshold"), bool)
            fine = number and c.get("field") and c.get("operator") in lx.NUMERIC_OPERATORS and c.get("unit") in lx.NUMERIC_UNITS
            return None if fine else typ
        needs = {
            "clause_presence": ("category", "expected"), "prohibited_formulation": ("pattern",),
            "required_exception": ("scopeCategory", "requiredExceptions"),
            "party_asymmetry": ("obligationCategory", "requiredSymmetry"), "broken_cross_reference": (),
        }.get(kind)
        if needs is None or any(not c.get(n) for n in needs):
            return typ
        if kind == "required_exception" and not isinstance(c["requiredExceptions"], list):
            return typ
        return None

    try:
        rule = json.loads(text or "")
    except ValueError:
        return syntax
    if not isinstance(rule, dict) or any(not rule.get(n) for n in ("id", "name", "category", "severity", "condition")):
        return syntax
    return typ if rule["severity"] not in lx.SEVERITIES else condition(rule["condition"])


@F.pandas_udf(T.StringType())
def _rule_errors(rules: pd.Series) -> pd.Series:
    return rules.map(_rule_error)


def validate_rules(rules: DataFrame, column: str = "rule_json") -> DataFrame:
    """Add ``error_code``: null for a valid rule."""
    return rules.withColumn("error_code", _rule_errors(F.col(column)))


def load_playbook(text: str) -> list[dict]:
    """Rules of a playbook given as JSON; raises on the first invalid rule."""
    book = json.loads(text)
    if not all(book.get(k) for k in ("id", "name", "version")) or not isinstance(book.get("rules"), list):
        raise ValueError("POLICY_SYNTAX_ERROR: playbook needs id, name, version and rules")
    for rule in book["rules"]:
        error = _rule_error(json.dumps(rule))
        if error:
            raise ValueError(f"{error}: rule {rule.get('id')}")
    return book["rules"]
