"""SQL twin of the contract analysis, built up CTE by CTE with windows and joins."""

from __future__ import annotations

from lexfolio import lexicons as lx
from lexfolio.plans.catalog.corpus import CONTRACT_BLOCKS
from lexfolio.plans.catalog.sqlparts import WS, any_of, label_case, pattern

PP = "chr(10) || chr(10)"


def clauses_cte(blocks: str = "blocks", name: str = "clauses") -> str:
    nums = " ".join(f"WHEN pat = {i} THEN regexp_extract(tt, {pattern(p)}, 1)" for i, (p, _) in enumerate(lx.HEADER_PATTERNS))
    rest = " ".join(f"WHEN pat = {i} THEN trim(regexp_extract(tt, {pattern(p)}, 2), {WS})" for i, (p, _) in enumerate(lx.HEADER_PATTERNS))
    offs = " ".join(f"WHEN pat = {i} THEN {o or 1}" for i, (_, o) in enumerate(lx.HEADER_PATTERNS))
    pats = " ".join(f"WHEN regexp_matches(tt, {pattern(p)}) THEN {i}" for i, (p, _) in enumerate(lx.HEADER_PATTERNS))
    return f"""
{name}_h AS (SELECT *, CASE {pats} WHEN block_type = 'heading' THEN 99 END AS pat FROM (SELECT *, trim(text, {WS}) AS tt FROM {blocks})),
{name}_x AS (SELECT *, CASE {nums} ELSE '' END AS num, CASE {rest} ELSE '' END AS rest, CASE {offs} ELSE 1 END AS off FROM {name}_h),
{name}_i AS (SELECT *, CASE WHEN pat IS NULL THEN 0 ELSE off + length(num) - length(replace(num, '.', '')) END AS lvl, CASE WHEN pat IS NULL THEN 'Preamble' WHEN rest <> '' THEN rest ELSE tt END AS hd,
  CAST(sum(CASE WHEN pat IS NOT NULL OR first THEN 1 ELSE 0 END) OVER (PARTITION BY version_id ORDER BY block_index) - 1 AS INTEGER) AS clause_index
  FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY block_index) = 1 AS first FROM {name}_x)),
{name}_g AS (SELECT version_id, clause_index, arg_min(num, block_index) AS clause_number, arg_min(hd, block_index) AS heading, CAST(arg_min(lvl, block_index) AS INTEGER) AS level,
  arg_min(block_id, block_index) AS block_id, min(start) AS start, max("end") AS "end", string_agg(text, {PP} ORDER BY block_index) AS full_text,
  coalesce(string_agg(CASE WHEN pat IS NULL THEN text END, {PP} ORDER BY block_index), '') AS body_text, bool_or(pat IS NOT NULL) AS headed, count(*) AS n_blocks FROM {name}_i GROUP BY ALL),
{name}_c AS (SELECT *, CASE WHEN NOT headed THEN 'preamble' ELSE {label_case('lower(heading)', lx.HEADING_CATEGORIES, "'unknown'")} END AS cat0,
  {label_case("lower(CASE WHEN body_text <> '' THEN body_text ELSE full_text END)", lx.BODY_CATEGORIES, "'general_clause'")} AS cat1 FROM {name}_g),
{name} AS (SELECT version_id, clause_index, clause_number, heading, level, CASE WHEN cat0 = 'unknown' THEN cat1 ELSE cat0 END AS category, block_id, start, "end", body_text, full_text, n_blocks FROM {name}_c)"""


def quantities_cte(src: str, keys: str, name: str) -> str:
    """``src(keys, text, base)`` -> <name>(keys, field, value, unit, raw, start, end), last mention per field."""
    dur = pattern(r"(?i)(?:[a-zA-Z-]+(?:\s+[a-zA-Z-]+)*\s+)?\(?(\d+)\)?\s*(calendar\s+|business\s+)?(days?|months?|years?|weeks?)")
    ctx = dict(lx.DURATION_CONTEXTS)
    money = pattern(lx.MONEY_PATTERN)
    fields = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(f) for f in fs)}]" for k, fs in lx.DURATION_FIELDS.items())

    def placed(p: str, tag: str) -> str:
        return f"""
{name}_{tag}p AS (SELECT {keys}, text, base, unnest(string_split_regex(text, {p})[:-2]) AS gap, unnest(regexp_extract_all(text, {p})) AS hit, generate_subscripts(regexp_extract_all(text, {p}), 1) AS j FROM {src} WHERE regexp_matches(text, '\\d')),
{name}_{tag}q AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY {keys} ORDER BY j) AS e FROM {name}_{tag}p),
{name}_{tag} AS (SELECT *, e - length(hit) AS s, lower(substring(text, CAST(greatest(0, e - length(hit) - 50) AS BIGINT) + 1, CAST(e + 50 - greatest(0, e - length(hit) - 50) AS BIGINT))) AS win FROM {name}_{tag}q)"""

    return f"""{placed(dur, 'd')},{placed(money, 'm')},
{name}_k AS (SELECT *, CASE WHEN {any_of('win', ctx['compete'])} THEN 'compete' WHEN {any_of('win', ctx['renew'])} THEN 'renew'
   WHEN {any_of('win', ctx['notice'])} OR (contains(win, 'terminate') AND NOT contains(win, 'following termination')) THEN 'notice'
   WHEN {any_of('win', ctx['confidential'])} THEN 'confidential' WHEN {any_of('win', ctx['net'])} THEN 'net' END AS kind,
   CAST(regexp_extract(hit, '\\d+') AS DOUBLE) AS n, lower(regexp_extract(hit, {dur}, 3)) AS u FROM {name}_d),
{name}_v AS (SELECT {keys}, j, base + s AS s, base + e AS e, trim(hit, {WS}) AS raw, kind,
   CASE kind WHEN 'compete' THEN CASE WHEN starts_with(u, 'month') THEN n WHEN starts_with(u, 'year') THEN n * 12 ELSE floor(n / 30 + 0.5) END
     WHEN 'confidential' THEN CASE WHEN starts_with(u, 'year') THEN n WHEN starts_with(u, 'month') THEN floor(n / 12 + 0.5) ELSE floor(n / 365 + 0.5) END
     ELSE CASE WHEN starts_with(u, 'month') THEN n * 30 WHEN starts_with(u, 'year') THEN n * 365 ELSE n END END AS value,
   CASE kind WHEN 'compete' THEN 'months' WHEN 'confidential' THEN 'years' ELSE 'days' END AS unit FROM {name}_k WHERE kind IS NOT NULL),
{name}_u AS (SELECT {keys}, j, s, e, raw, value, unit, unnest(CASE kind {fields} END) AS field FROM {name}_v
  UNION ALL SELECT {keys}, j, base + s, base + e, hit, CAST(replace(regexp_extract(hit, {money}, 1), ',', '') AS DOUBLE) *
   CASE lower(regexp_extract(hit, {money}, 2)) WHEN 'million' THEN 1000000 WHEN 'billion' THEN 1000000000 WHEN 'thousand' THEN 1000 ELSE 1 END, 'usd',
   CASE WHEN {any_of('win', lx.CAP_WORDS)} THEN 'liability_cap_usd' ELSE 'amount_usd' END FROM {name}_m),
{name} AS (SELECT {keys}, field, value, unit, raw, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM {name}_u QUALIFY row_number() OVER (PARTITION BY {keys}, field ORDER BY j DESC) = 1)"""


def sentences_cte() -> str:
    mark = f"regexp_replace(CASE WHEN body_text <> '' THEN body_text ELSE full_text END, '([.?!])\\s+([A-Z0-9\"“])', '\\1' || chr(1) || '\\2', 'g')"
    return f"""
sp AS (SELECT version_id, clause_index, CAST(row_number() OVER (PARTITION BY version_id, clause_index ORDER BY j) - 1 AS INTEGER) AS sentence_index, s FROM
  (SELECT version_id, clause_index, trim(unnest(string_split({mark}, chr(1))), {WS}) AS s, generate_subscripts(string_split({mark}, chr(1)), 1) AS j FROM clauses) WHERE length(s) >= 10),
sr AS (SELECT version_id, clause_index, -1 AS sentence_index, start AS "end", start, '' AS text FROM clauses
  UNION ALL SELECT version_id, clause_index, sentence_index + 1, CAST(p + length(s) AS INTEGER), CAST(p AS INTEGER), s FROM (
    SELECT sr.version_id, sr.clause_index, sr.sentence_index, s, CASE WHEN strpos(substring(canonical_text, "end" + 1), s) > 0 THEN "end" + strpos(substring(canonical_text, "end" + 1), s) - 1 ELSE "end" END AS p
    FROM sr JOIN sp ON sp.version_id = sr.version_id AND sp.clause_index = sr.clause_index AND sp.sentence_index = sr.sentence_index + 1 JOIN blocks_doc ON blocks_doc.version_id = sr.version_id)),
sentences AS (SELECT version_id, clause_index, sentence_index, text, start, "end" FROM sr WHERE sentence_index >= 0)"""


def mutual(expr: str) -> str:
    return f"({any_of(expr, lx.MUTUAL_PHRASES)} OR (contains({expr}, 'party a') AND contains({expr}, 'party b')))"


def obligations_cte() -> str:
    names = " ".join(f"WHEN regexp_matches(text, {pattern(p)}) THEN '{n}'" for n, p in lx.MODALS)
    part = lambda g: " ".join(
        f"WHEN '{n}' THEN regexp_extract(text, {pattern('(?is)^(.*?)' + p.removeprefix('(?i)') + '(.*)$')}, {g})" for n, p in lx.MODALS)
    return f"""
ob0 AS (SELECT *, CASE {names} END AS modality FROM sentences),
ob1 AS (SELECT *, trim(CASE modality {part(1)} END, {WS}) AS before, trim(CASE modality {part(2)} END, {WS}) AS action FROM ob0 WHERE modality IS NOT NULL),
ob2 AS (SELECT *, trim(regexp_replace(regexp_replace(before, {pattern(lx.ACTOR_LEAD_IN)}, ''), {pattern(lx.ACTOR_NUMBERING)}, ''), {WS}) AS cleaned FROM ob1),
ob3 AS (SELECT *, CASE WHEN cleaned = '' THEN 'party' ELSE trim(string_split(cleaned, ',')[-1], {WS}) END AS actor,
  nullif(trim(regexp_extract(text, {pattern(lx.CONDITION_PATTERN)}), {WS}), '') AS condition,
  list_filter(list_transform(regexp_split_to_array(trim(regexp_extract(text, {pattern(lx.EXCEPTION_PATTERN)}, 1), {WS}), {pattern(lx.EXCEPTION_SPLIT)}), lambda x: lower(trim(x, {WS}))), lambda x: length(x) > 3) AS exceptions FROM ob2),
obligations AS (SELECT version_id, clause_index, sentence_index, CAST(row_number() OVER (PARTITION BY version_id, clause_index ORDER BY sentence_index) - 1 AS INTEGER) AS obligation_index,
  actor, modality, action, condition, exceptions, {any_of('lower(actor)', lx.MUTUAL_ACTORS)} OR {mutual('lower(text)')} AS is_bilateral, start, "end", text AS quote FROM ob3)"""


CLAUSES = f"{CONTRACT_BLOCKS},{clauses_cte()}"
OBLIGATIONS = f"{CLAUSES},{sentences_cte()},{obligations_cte()}"
CLAUSE_Q = quantities_cte("(SELECT version_id, clause_index, full_text AS text, start AS base FROM clauses)", "version_id, clause_index", "cq")
OBL_Q = quantities_cte("(SELECT version_id, clause_index, obligation_index, quote AS text, start AS base FROM obligations)", "version_id, clause_index, obligation_index", "oq")
FACTS = f"""{OBLIGATIONS},{CLAUSE_Q},{OBL_Q},
fq AS (SELECT version_id, clause_index, field, value, unit, raw, start, "end" FROM (SELECT version_id, clause_index, -1 AS obligation_index, field, value, unit, raw, start, "end" FROM cq UNION ALL SELECT * FROM oq)
  QUALIFY row_number() OVER (PARTITION BY version_id, clause_index, field ORDER BY obligation_index DESC) = 1),
fo AS (SELECT version_id, clause_index, arg_min(actor, obligation_index) AS actor, arg_min(action, obligation_index) AS action, bool_and(is_bilateral) AS both_sides,
  string_agg(nullif(array_to_string(exceptions, '|'), ''), '|' ORDER BY obligation_index) AS exceptions, count(*) AS n FROM obligations GROUP BY ALL),
facts AS (SELECT c.*, o.actor, o.action, coalesce(o.both_sides, {mutual('lower(c.full_text)')}) AS is_bilateral, coalesce(o.exceptions, '') AS exceptions, coalesce(o.n, 0) AS n_obligations,
  regexp_extract_all(c.full_text, {pattern(lx.REFERENCE_PATTERN)}, 1) AS refs FROM clauses c LEFT JOIN fo o USING (version_id, clause_index))"""


def num(e: str) -> str:
    return f"CASE WHEN {e} = floor({e}) THEN CAST(CAST({e} AS BIGINT) AS VARCHAR) ELSE CAST({e} AS VARCHAR) END"


def _leaf(rule: dict) -> str:
    """(version_id, clause_index, quote, detail) per violation, or per document for compound tests."""
    c, rid = rule["condition"], rule["id"]
    head = f"SELECT version_id, '{rid}' AS rule_id, "
    if c["type"] == "numeric_threshold":
        bad = {"<=": ">", ">=": "<"}[c["operator"]]
        return head + f"clause_index, 0 AS j, raw AS quote, {num('value')} AS detail FROM fq WHERE field = '{c['field']}' AND value {bad} {c['threshold']}"
    if c["type"] == "clause_presence" and c["expected"] == "absent":
        return head + f"clause_index, 0, full_text, NULL FROM facts WHERE category = '{c['category']}'"
    if c["type"] == "clause_presence":
        return (f"SELECT version_id, '{rid}', -1, 0, NULL, NULL FROM contracts WHERE version_id NOT IN (SELECT version_id FROM facts WHERE category = 'at_will' OR "
                f"{any_of(chr(40) + 'lower(full_text || chr(32) || coalesce(actor, chr(32))))', ('at-will', 'at will', 'with or without cause'))})")
    if c["type"] == "required_exception":
        scope = "'liability', 'liability_limitation'" if c["scopeCategory"] == "liability" else f"'{c['scopeCategory']}'"
        miss = ", ".join(f"CASE WHEN NOT bool_or({any_of('lower(full_text)', (r, *lx.EXCEPTION_SYNONYMS.get(r, ())))}) THEN '{r}' END" for r in c["requiredExceptions"])
        return (f"SELECT version_id, '{rid}', ci, 0, quote, detail FROM (SELECT version_id, min(clause_index) AS ci, arg_min(full_text, clause_index) AS quote, "
                f"array_to_string(list_filter([{miss}], lambda x: x IS NOT NULL), ',') AS detail FROM facts WHERE category IN ({scope}) GROUP BY version_id) WHERE detail <> ''")
    if c["type"] == "party_asymmetry":
        return (f"SELECT version_id, '{rid}', ci, 0, quote, NULL FROM (SELECT version_id, min(CASE WHEN NOT is_bilateral THEN clause_index END) AS ci, arg_min(full_text, CASE WHEN NOT is_bilateral THEN clause_index END) AS quote, "
                f"bool_or({any_of('lower(full_text)', lx.SYMMETRY_WORDS)}) AS m FROM facts WHERE category = '{c['obligationCategory']}' GROUP BY version_id) WHERE NOT m AND ci IS NOT NULL")
    return (f"SELECT version_id, '{rid}', clause_index, j, full_text, ref FROM (SELECT version_id, clause_index, full_text, unnest(refs) AS ref, generate_subscripts(refs, 1) AS j FROM facts) r "
            f"WHERE NOT EXISTS (SELECT 1 FROM facts d WHERE d.version_id = r.version_id AND (d.clause_number = r.ref OR lower(d.heading) = r.ref))")


def rules_values(playbooks: dict) -> str:
    rows = []
    for pb, rules in playbooks.items():
        for r in rules:
            q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
            patch = r["patchTemplate"] or {}
            rows.append(f"('{pb}', '{r['id']}', {q(r['name'])}, '{r['category']}', '{r['severity']}', '{r['condition']['type']}', {q(r['explanationTemplate'])}, {q(r['suggestedAction'])}, {q(patch.get('replacementText'))})")
    return f"rules(playbook, rule_id, title, category, severity, condition_type, template, suggested_action, patch_text) AS (VALUES {', '.join(rows)})"


def policy_cte(playbooks: dict) -> str:
    leaves = " UNION ALL ".join(_leaf(r) for rules in playbooks.values() for r in rules)
    return f"""{FACTS}, {rules_values(playbooks)},
bad(version_id, rule_id, clause_index, j, quote, detail) AS ({leaves}),
viol AS (SELECT b.*, f.block_id FROM bad b LEFT JOIN facts f USING (version_id, clause_index)),
traces AS (SELECT version_id, r.*, v.n AS n_viol, v.n_cites, v.detail, v.quote, v.block_id FROM contracts JOIN rules r USING (playbook)
  LEFT JOIN (SELECT version_id, rule_id, count(*) AS n, count(quote) AS n_cites, arg_max(detail, clause_index * 1000 + j) AS detail, arg_min(quote, clause_index * 1000 + j) AS quote, arg_min(block_id, clause_index * 1000 + j) AS block_id FROM viol GROUP BY ALL) v USING (version_id, rule_id)),
findings AS (SELECT *, regexp_replace(replace(replace(template, '{{{{extractedValue}}}}', coalesce(detail, '')), '{{{{missingExceptions}}}}', coalesce(detail, '')), '\\{{\\{{brokenReference\\}}\\}}', coalesce(detail, '')) AS explanation FROM traces WHERE n_viol > 0),
cites AS (SELECT version_id, rule_id, CAST(row_number() OVER (PARTITION BY version_id, rule_id ORDER BY clause_index, j) - 1 AS INTEGER) AS citation_index, block_id, quote,
  CASE WHEN strpos(canonical_text, quote) > 0 THEN strpos(canonical_text, quote) - 1 ELSE b.start END AS start,
  CASE WHEN strpos(canonical_text, quote) > 0 THEN strpos(canonical_text, quote) - 1 + length(quote) ELSE b."end" END AS "end"
  FROM viol JOIN contracts USING (version_id) JOIN rules USING (playbook, rule_id) JOIN blocks_doc USING (version_id) JOIN blocks b USING (version_id, block_id) WHERE quote IS NOT NULL)"""
