"""Clauses, entities, quantities, obligations, facts, rules and findings over contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import unnest
from lexfolio.functions.quantities import quantities
from lexfolio.functions.text import dice
from lexfolio.operators import contract as c
from lexfolio.operators import policy as p
from lexfolio.plans.catalog.contracts_sql import CLAUSE_Q, CLAUSES, FACTS, OBLIGATIONS, policy_cte, sentences_cte
from lexfolio.plans.catalog.corpus import CONTRACTS
from lexfolio.plans.catalog.sqlparts import WS, dice as dice_sql, label_case, pattern, word_set
from lexfolio.plans.registry import query
from lexfolio.playbooks import PLAYBOOKS
from lexfolio.sources import corpora


def segmented(t):
    return c.segmented_documents(corpora.contracts(t))


def opening(t):
    return c.opening_clauses(corpora.contracts(t))


def with_facts(t, *keep):
    return c.extract_facts(segmented(t), *keep)


def reviewed(t):
    return p.evaluate_playbooks(with_facts(t))


@query("c01_c02_clauses", f"WITH {CLAUSES} SELECT version_id, clause_index, clause_number, heading, level, block_id, start, \"end\", md5(full_text) AS text_md5, CAST(n_blocks AS INTEGER) AS blocks FROM clauses")
def _(t):
    return c.clause_rows(segmented(t)).select(
        "version_id", "clause_index", "clause_number", "heading", "level", "block_id", "start", "end",
        F.md5("full_text").alias("text_md5"), F.size("block_ids").alias("blocks"))


@query("c03_hierarchy", f"""WITH {CLAUSES}, par AS (SELECT a.version_id, a.clause_index, max(b.clause_index) AS parent_index FROM clauses a LEFT JOIN clauses b ON a.version_id = b.version_id AND b.clause_index < a.clause_index AND b.level < a.level GROUP BY ALL),
kids AS (SELECT version_id, parent_index AS clause_index, count(*) AS n FROM par GROUP BY ALL)
SELECT version_id, clause_index, par.parent_index, CAST(coalesce(n, 0) AS INTEGER) AS child_count FROM par LEFT JOIN kids USING (version_id, clause_index)""")
def _(t):
    return c.clause_rows(segmented(t)).select("version_id", "clause_index", "parent_index", "child_count")


@query("c04_c05_categories", f"WITH {CLAUSES} SELECT heading, category, CAST(count(*) AS BIGINT) AS clauses FROM clauses GROUP BY ALL")
def _(t):
    return c.clause_rows(segmented(t)).groupBy("heading", "category").agg(F.count("*").alias("clauses"))


_PARTY = pattern(lx.PARTY_PATTERN)
_COMPANY = pattern(lx.COMPANY_PATTERN)


def _hits(src: str, p: str, name: str) -> str:
    return f"""{name}_p AS (SELECT version_id, clause_index, block_id, start, unnest(string_split_regex(full_text, {p})[:-2]) AS gap, unnest(regexp_extract_all(full_text, {p})) AS hit, generate_subscripts(regexp_extract_all(full_text, {p}), 1) AS j FROM {src}),
{name} AS (SELECT *, CAST(start + sum(length(gap) + length(hit)) OVER (PARTITION BY version_id, clause_index ORDER BY j) - length(hit) AS INTEGER) AS pos0 FROM {name}_p)"""


@query("c06_c08_parties", f"""WITH {CLAUSES}, src AS (SELECT * FROM clauses QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY category <> 'preamble', clause_index) = 1),
{_hits('src', _PARTY, 'ph')}, {_hits('src', _COMPANY, 'fh')},
named AS (SELECT version_id, j, regexp_replace(regexp_replace(trim(regexp_extract(hit, {_PARTY}, 1), {WS}), '^,\\s*', ''), '\\s*,$', '') AS name,
  trim(coalesce(nullif(regexp_extract(hit, {_PARTY}, 2), ''), regexp_extract(hit, {_PARTY}, 3)), {WS}) AS alias, pos0 AS start, CAST(pos0 + length(hit) AS INTEGER) AS "end" FROM ph),
ok AS (SELECT version_id, j, name, CASE WHEN alias <> '' THEN alias ELSE name END AS short_name, start, "end" FROM named WHERE length(name) > 2 AND length(name) < 100 AND NOT starts_with(lower(name), 'the laws')),
un AS (SELECT version_id, j, name, short_name, {label_case('lower(short_name)', lx.PARTY_ROLES, "'party'")} AS role, start, "end" FROM ok
  UNION ALL SELECT version_id, j, trim(hit, {WS}), trim(hit, {WS}), 'contracting_party', pos0, CAST(pos0 + length(trim(hit, {WS})) AS INTEGER) FROM fh WHERE version_id NOT IN (SELECT version_id FROM ok))
SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY j) - 1 AS INTEGER) AS party_index, name, short_name, role, start, "end" FROM un""")
def _(t):
    rows = opening(t).select("version_id", c.parties_of(F.col("clauses")).alias("parties"))
    return unnest(rows, F.col("parties"), "version_id", position="party_index").select(
        "version_id", "party_index", "_item.name", "_item.short_name", "_item.role", "_item.start", "_item.end")


@query("c07_company_fallback", f"""WITH {CLAUSES}, src AS (SELECT * FROM clauses WHERE category = 'preamble'), {_hits('src', _COMPANY, 'fh')}
SELECT version_id, trim(hit, {WS}) AS name, pos0 AS start FROM fh""")
def _(t):
    from lexfolio.functions.text import squeeze_ends

    rows = c.clause_rows(opening(t)).filter(F.col("category") == "preamble")
    hits = unnest(rows.withColumn("_h", c.company_hits(F.col("full_text"))), F.col("_h"), "version_id", "start")
    return hits.select("version_id", squeeze_ends(F.col("_item.hit")).alias("name"), (F.col("start") + F.col("_item.start")).alias("start"))


_D1, _D2 = (pattern(p_) for p_ in lx.DEFINITION_PATTERNS)


@query("c09_defined_terms", f"""WITH {CLAUSES}, likely AS (SELECT * FROM clauses WHERE contains(lower(heading), 'definition') OR category = 'confidentiality' OR level <= 2),
src AS (SELECT * FROM likely UNION ALL SELECT * FROM clauses WHERE version_id NOT IN (SELECT version_id FROM likely)), {_hits('src', _D1, 'd1')}, {_hits('src', _D2, 'd2')},
a AS (SELECT version_id, clause_index, trim(regexp_extract(hit, {_D1}, 1), {WS}) AS term, trim(regexp_extract(hit, {_D1}, 2), {WS}) AS definition, pos0 AS start, CAST(pos0 + length(hit) AS INTEGER) AS "end" FROM d1
 UNION ALL SELECT version_id, clause_index, trim(regexp_extract(hit, {_D2}, 1), {WS}), trim(regexp_extract(hit, {_D2}, 2), {WS}), pos0, CAST(pos0 + length(hit) AS INTEGER) FROM d2)
SELECT version_id, term, definition, start, "end" FROM a WHERE length(term) > 1 AND length(term) < 60""")
def _(t):
    rows = segmented(t).select("version_id", c.defined_terms_of(F.col("clauses")).alias("terms"))
    return unnest(rows, F.col("terms"), "version_id").select("version_id", "_item.term", "_item.definition", "_item.start", "_item.end")


@query("c10_c11_quantities", f"WITH {CLAUSES},{CLAUSE_Q} SELECT version_id, clause_index, field, value, unit, raw, start, \"end\" FROM cq")
def _(t):
    rows = c.clause_rows(segmented(t)).select("version_id", "clause_index", quantities(F.col("full_text"), F.col("start")).alias("q"))
    return unnest(rows, F.col("q"), "version_id", "clause_index").select("version_id", "clause_index", "_item.*")


_LAW = pattern(lx.GOVERNING_LAW_PATTERN)


@query("c12_governing_law", f"""WITH {CLAUSES}, src AS (SELECT version_id, full_text AS text, start AS base FROM clauses WHERE category = 'governing_law' QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY clause_index) = 1),
al AS (SELECT * FROM src UNION ALL SELECT version_id, canonical_text, 0 FROM blocks_doc WHERE version_id NOT IN (SELECT version_id FROM src))
SELECT version_id, regexp_extract(text, {_LAW}, 1) AS jurisdiction, CAST(base + strpos(text, regexp_extract(text, {_LAW})) - 1 AS INTEGER) AS start,
 CAST(base + strpos(text, regexp_extract(text, {_LAW})) - 1 + length(regexp_extract(text, {_LAW})) AS INTEGER) AS "end" FROM al WHERE regexp_matches(text, {_LAW})""")
def _(t):
    found = F.array(c.governing_law_of(F.col("clauses"), F.col("canonical_text")))
    return unnest(segmented(t), found, "version_id").select("version_id", "_item.*")


@query("c13_c14_sentences", f"WITH RECURSIVE {CLAUSES},{sentences_cte()} SELECT version_id, clause_index, sentence_index, text, start, \"end\" FROM sentences")
def _(t):
    return c.sentence_rows(segmented(t))


@query("c15_c19_obligations", f"""WITH RECURSIVE {OBLIGATIONS} SELECT version_id, clause_index, obligation_index, actor, modality, action, condition, array_to_string(exceptions, '|') AS exceptions, is_bilateral, start, "end", quote FROM obligations""")
def _(t):
    return c.obligation_rows(with_facts(t, "version_id")).drop("quantities").withColumn("exceptions", F.array_join("exceptions", "|"))


@query("c15_modality_counts", f"WITH RECURSIVE {OBLIGATIONS} SELECT modality, is_bilateral, CAST(count(*) AS BIGINT) AS obligations FROM obligations GROUP BY ALL")
def _(t):
    return c.obligation_rows(with_facts(t, "version_id")).groupBy("modality", "is_bilateral").agg(F.count("*").alias("obligations"))


@query("c20_cross_references", f"""WITH {CLAUSES} SELECT version_id, clause_index, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS ref_index, unnest(r) AS ref FROM
 (SELECT version_id, clause_index, regexp_extract_all(full_text, {pattern(lx.REFERENCE_PATTERN)}, 1) AS r FROM clauses)""")
def _(t):
    rows = c.clause_rows(segmented(t)).withColumn("refs", c.references_in(F.col("full_text")))
    return unnest(rows, F.col("refs"), "version_id", "clause_index", name="ref", position="ref_index")


@query("c21_clause_facts", f"""WITH RECURSIVE {FACTS}, q AS (SELECT version_id, clause_index, string_agg(field || '=' || CAST(value AS BIGINT), ',' ORDER BY field) AS quantities FROM fq GROUP BY ALL)
SELECT version_id, clause_index, category, actor, action, is_bilateral, coalesce(quantities, '') AS quantities, exceptions FROM facts LEFT JOIN q USING (version_id, clause_index)""")
def _(t):
    shown = F.array_sort(F.transform("quantities", lambda q: F.concat(q["field"], F.lit("="), q["value"].cast("bigint").cast("string"))))
    return c.fact_rows(with_facts(t, "version_id")).select(
        "version_id", "clause_index", "category", "actor", "action", "is_bilateral", F.array_join(shown, ",").alias("quantities"),
        F.array_join("exceptions", "|").alias("exceptions"))


@query("j11_obligations_per_clause", f"""WITH RECURSIVE {FACTS} SELECT version_id, clause_index, CAST(n_obligations AS INTEGER) AS obligations, CAST((SELECT count(*) FROM fq q WHERE q.version_id = f.version_id AND q.clause_index = f.clause_index) AS INTEGER) AS quantities FROM facts f""")
def _(t):
    return c.fact_rows(with_facts(t, "version_id")).select("version_id", "clause_index", F.size("obligations").alias("obligations"), F.size("quantities").alias("quantities"))


@query("c22_infer_playbook", f"WITH {CONTRACTS} SELECT version_id, {label_case('lower(text)', lx.PLAYBOOK_WORDS, repr(lx.DEFAULT_PLAYBOOK))} AS playbook FROM contracts")
def _(t):
    return corpora.contracts(t).select("version_id", c.infer_playbook(F.col("text")).alias("playbook"))


@query("c24_dice_similarity", f"""WITH w AS (SELECT doc_id, {word_set('text')} AS ws FROM documents)
SELECT a.doc_id, round({dice_sql('a.ws', 'b.ws')}, 6) AS similarity FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def _(t):
    docs = t.spread("documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return docs.join(nxt, "doc_id").select("doc_id", F.round(dice(F.col("text"), F.col("next_text")), 6).alias("similarity"))


POLICY = policy_cte(PLAYBOOKS)


@query("l02_l09_rule_traces", f"WITH RECURSIVE {POLICY} SELECT version_id, rule_id, severity, condition_type, n_viol IS NULL AS passed, CAST(coalesce(n_cites, 0) AS INTEGER) AS citation_count FROM traces")
def _(t):
    return p.trace_rows(reviewed(t)).select("version_id", "rule_id", "severity", "condition_type", "passed", "citation_count")


_MUST_EXIST = ", ".join(f"'{r['id']}'" for rules in PLAYBOOKS.values() for r in rules if r["condition"]["type"] == "clause_presence" and r["condition"]["expected"] == "present")


# Every seventh contract was read badly: its blocks are a quarter or three quarters sure, in turn.
@query("l09_abstentions", f"""WITH RECURSIVE {POLICY}, sure AS (SELECT version_id, avg(CASE WHEN CAST(version_id AS BIGINT) % 7 <> 0 THEN 1.0 WHEN block_index % 2 = 0 THEN 0.25 ELSE 0.75 END) AS mean FROM blocks GROUP BY version_id),
t AS (SELECT version_id, rule_id, n_viol IS NULL AS passed, n_viol IS NOT NULL AND rule_id IN ({_MUST_EXIST}) AND mean < {lx.ABSTAIN_BELOW} AS abstained FROM traces JOIN sure USING (version_id))
SELECT version_id, rule_id, passed, abstained, NOT passed AND NOT abstained AS found FROM t""")
def _(t):
    sure = F.when(F.col("version_id").cast("long") % 7 != 0, 1.0)
    docs = with_facts(t).withColumn("blocks", F.transform("blocks", lambda b: b.withField("confidence", sure.when(b["block_index"] % 2 == 0, 0.25).otherwise(0.75))))
    judged = p.evaluate_playbooks(docs)
    found = F.transform("findings", lambda f: f["rule_id"])
    return unnest(judged.withColumn("_found", found), F.col("results"), "version_id", "_found").select(
        "version_id", "_item.rule_id", "_item.passed", "_item.abstained", F.array_contains("_found", F.col("_item.rule_id")).alias("found"))


@query("l10_findings", f"WITH RECURSIVE {POLICY} SELECT version_id, rule_id, category, severity, title, explanation, suggested_action, CASE WHEN patch_text IS NOT NULL AND quote IS NOT NULL THEN quote END AS patch_original, CASE WHEN patch_text IS NOT NULL AND quote IS NOT NULL THEN patch_text END AS patch_replacement FROM findings")
def _(t):
    return p.finding_rows(reviewed(t)).select(
        "version_id", "rule_id", "category", "severity", "title", "explanation", "suggested_action", "patch_original", "patch_replacement")


@query("l10_citations", f"WITH RECURSIVE {POLICY} SELECT version_id, rule_id, citation_index, block_id, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", quote FROM cites")
def _(t):
    f = p.finding_rows(reviewed(t))
    return unnest(f, F.col("citations"), "version_id", "rule_id", position="citation_index").select(
        "version_id", "rule_id", "citation_index", "_item.block_id", "_item.start", "_item.end", "_item.quote")


@query("l11_rule_summary", f"WITH RECURSIVE {POLICY} SELECT rule_id, CAST(count(*) AS BIGINT) AS evaluated, CAST(count(n_viol) AS BIGINT) AS failed FROM traces GROUP BY rule_id")
def _(t):
    return p.trace_rows(reviewed(t)).groupBy("rule_id").agg(F.count("*").alias("evaluated"), F.count_if(~F.col("passed")).alias("failed"))


@query("c23_contract_summary", f"""WITH RECURSIVE {POLICY}, s AS (SELECT version_id, {', '.join(f"count(*) FILTER (severity = '{v}') AS {v}_findings" for v in lx.SEVERITIES[:4])} FROM findings GROUP BY version_id),
o AS (SELECT version_id, count(*) AS n, count(*) FILTER (is_bilateral) AS b FROM obligations GROUP BY version_id), k AS (SELECT version_id, count(*) AS total_clauses FROM clauses GROUP BY version_id)
SELECT version_id, CAST(total_clauses AS INTEGER) AS total_clauses, CAST(coalesce(n, 0) AS INTEGER) AS total_obligations, {', '.join(f"CAST(coalesce({v}_findings, 0) AS INTEGER) AS {v}_findings" for v in lx.SEVERITIES[:4])},
 coalesce(floor(b / n * 100 + 0.5) / 100, 1.0::DOUBLE) AS bilateral_ratio FROM k LEFT JOIN o USING (version_id) LEFT JOIN s USING (version_id)""")
def _(t):
    return c.contract_summary(reviewed(t))


@query("j10_broken_references", f"""WITH RECURSIVE {FACTS} SELECT version_id, clause_index, CAST(j - 1 AS INTEGER) AS ref_index, ref FROM (SELECT version_id, clause_index, unnest(refs) AS ref, generate_subscripts(refs, 1) AS j FROM facts) r
WHERE NOT EXISTS (SELECT 1 FROM facts d WHERE d.version_id = r.version_id AND (d.clause_number = r.ref OR lower(d.heading) = r.ref))""")
def _(t):
    rows = c.clause_rows(segmented(t)).withColumn("references", c.references_in(F.col("full_text")))
    return p.broken_references(rows).select("version_id", "clause_index", "ref_index", "ref")


# Compound conditions, prohibited wording and an own playbook given as data.
CUSTOM = {
    "own": [
        {"id": "AND", "name": "and", "category": "x", "severity": "low", "explanationTemplate": "{{prohibitedMatch}} {{clauseCount}}", "condition": {"type": "logical_and", "conditions": [
            {"type": "clause_presence", "category": "governing_law", "expected": "present"}, {"type": "prohibited_formulation", "pattern": "source code|section \\d{2}"}]}},
        {"id": "OR", "name": "or", "category": "x", "severity": "low", "explanationTemplate": "{{clauseCount}}", "condition": {"type": "logical_or", "conditions": [
            {"type": "clause_presence", "category": "indemnification", "expected": "present"}, {"type": "numeric_threshold", "field": "payment_net_days", "operator": ">", "threshold": 30, "unit": "days"}]}},
        {"id": "NOT", "name": "not", "category": "x", "severity": "info", "explanationTemplate": "n", "condition": {"type": "logical_not", "condition": {
            "type": "prohibited_formulation", "pattern": "compelled by law", "scopeCategory": "confidentiality"}}},
    ],
}


@query("l08_compound_rules", f"""WITH RECURSIVE {FACTS}, d AS (SELECT version_id, count(*) FILTER (category = 'governing_law') AS gov, count(*) FILTER (category = 'indemnification') AS ind,
 count(*) FILTER (regexp_matches(full_text, '(?i)source code|section \\d{{2}}')) AS bad, count(*) FILTER (category = 'confidentiality' AND contains(lower(full_text), 'compelled by law')) AS law FROM facts GROUP BY ALL),
pay AS (SELECT version_id, count(*) AS n FROM fq WHERE field = 'payment_net_days' AND NOT value > 30 GROUP BY ALL)
SELECT version_id, 'AND' AS rule_id, gov > 0 AND bad = 0 AS passed, CAST(CASE WHEN gov > 0 THEN bad ELSE 0 END AS INTEGER) AS citation_count FROM d
UNION ALL SELECT version_id, 'OR', ind > 0 OR coalesce(n, 0) = 0, CAST(CASE WHEN ind > 0 THEN 0 ELSE coalesce(n, 0) END AS INTEGER) FROM d LEFT JOIN pay USING (version_id)
UNION ALL SELECT version_id, 'NOT', law > 0, CAST(law AS INTEGER) FROM d""")
def _(t):
    docs = with_facts(t).withColumn("playbook", F.lit("own"))
    return p.trace_rows(p.evaluate_playbooks(docs, playbooks=CUSTOM)).select("version_id", "rule_id", "passed", "citation_count")


RULE_JSON = """'{"id":"' || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'R' || CAST(p_partkey AS STRING) END || '","name":"n","category":"' || p_type || '","severity":"'
 || CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'severe' END || '","condition":'
 || CASE p_partkey % 7 WHEN 0 THEN '{"type":"clause_presence","category":"term"' || CASE WHEN p_size > 25 THEN ',"expected":"absent"}' ELSE '}' END
 WHEN 1 THEN '{"type":"numeric_threshold","field":"f","operator":"' || CASE WHEN p_size > 40 THEN '~' ELSE '<=' END || '","threshold":' || CAST(p_size AS STRING) || ',"unit":"' || CASE WHEN p_size < 5 THEN 'weeks' ELSE 'days' END || '"}'
 WHEN 2 THEN '{"type":"logical_and","conditions":[{"type":"broken_cross_reference"}' || CASE WHEN p_size > 30 THEN ',{"type":"nonsense"}' ELSE '' END || ']}'
 WHEN 3 THEN '{"type":"logical_not","condition":{"type":"prohibited_formulation"' || CASE WHEN p_size > 20 THEN ',"pattern":"x"' ELSE '' END || '}}'
 WHEN 4 THEN '{"type":"required_exception","scopeCategory":"s","requiredExceptions":[' || CASE WHEN p_size > 20 THEN '"a"' ELSE '' END || ']}'
 WHEN 5 THEN '{"type":"logical_or","conditions":[]}' ELSE '{"type":"broken_cross_reference"}' END || '}'"""


@query("l01_validate_rules", f"""WITH r AS (SELECT p_partkey, rule_json, p_size, p_partkey % 7 AS kind, p_partkey % 9 = 0 AS noid FROM (SELECT *, {RULE_JSON} AS rule_json FROM part))
SELECT p_partkey, CASE WHEN noid THEN 'POLICY_SYNTAX_ERROR' WHEN p_size % 6 = 5 THEN 'POLICY_TYPE_ERROR'
 WHEN kind = 0 AND p_size <= 25 THEN 'POLICY_TYPE_ERROR' WHEN kind = 1 AND (p_size > 40 OR p_size < 5) THEN 'POLICY_TYPE_ERROR' WHEN kind = 2 AND p_size > 30 THEN 'POLICY_TYPE_ERROR'
 WHEN kind = 3 AND p_size <= 20 THEN 'POLICY_TYPE_ERROR' WHEN kind = 4 AND p_size <= 20 THEN 'POLICY_TYPE_ERROR' WHEN kind = 5 THEN 'POLICY_SYNTAX_ERROR' END AS error_code FROM r""")
def _(t):
    rules = t.spread("part").selectExpr("p_partkey", RULE_JSON + " AS rule_json")
    return p.validate_rules(rules).select("p_partkey", "error_code")
