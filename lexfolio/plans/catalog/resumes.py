"""Profiles, requirements, matches, checks and rewrites over resumes and job posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.arrays import unnest
from lexfolio.functions.skills import canonical_skill
from lexfolio.operators import ats, ir, matching, resume, rewrite
from lexfolio.plans import reviews
from lexfolio.plans.catalog.sqlparts import WS, any_of, blocks_cte, label_case, pattern
from lexfolio.plans.registry import query
from lexfolio.sources import corpora
from lexfolio.sources.corpora import build

AS_OF = 2024 * 12 + 6


def profiles(t):
    return resume.extract_profiles(ir.canonical_documents(corpora.resumes(t)), AS_OF)


# Every job post is applied for; posts outnumber resumes, so every resume applies as well.
APPLICATIONS = "SELECT CAST(p_partkey % (SELECT count(*) FROM customer) AS STRING) AS version_id, CAST(p_partkey AS STRING) AS job_id FROM part"


def applications(t):
    return build(t, APPLICATIONS, "part", "customer")


def matched(t):
    return matching.match_applications(applications(t), ats.audit(profiles(t)), matching.parse_requirements(corpora.jobs(t)))


_SECTION = "CASE " + " ".join(f"WHEN {any_of('lower(tt)', ws)} THEN '{n}'" for n, ws in lx.RESUME_SECTIONS) + " END"
_DATE = pattern(lx.DATE_SPAN_PATTERN)
_SKILLS = ", ".join(
    f"({i}, '{n}', '{c}', '{'|'.join(chr(92) + 'b' + ''.join(chr(92) + ch if ch in '.+*?^${}()|[]' else ch for ch in a) + chr(92) + 'b' for a in al)}')" for i, (n, c, al) in enumerate(lx.SKILLS))


def _month(e: str, default: int) -> str:
    k = f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"
    names = " ".join(f"WHEN starts_with({k}, '{m}') THEN {i + 1}" for i, m in enumerate(lx.MONTHS))
    return f"CASE WHEN regexp_matches({k}, '^(0[1-9]|1[0-2])$') THEN CAST({k} AS INTEGER) {names} ELSE {default} END"


RES = f"""WITH resumes AS ({corpora.RESUMES_SQL}), {blocks_cte('resumes', 'version_id')},
rb AS (SELECT *, trim(text, {WS}) AS tt, CAST(row_number() OVER (PARTITION BY version_id ORDER BY block_index) AS INTEGER) AS rn FROM blocks),
rh AS (SELECT *, CASE WHEN length(tt) < 40 AND length(tt) > 3 AND tt = upper(tt) THEN {_SECTION} END AS head FROM rb),
rs AS (SELECT *, last_value(CASE WHEN head IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY rn) AS hat FROM rh),
fs AS (SELECT version_id, head AS section, min(rn) AS at0 FROM rh WHERE head IS NOT NULL GROUP BY ALL),
sb AS (SELECT rs.*, section FROM rs JOIN fs ON fs.version_id = rs.version_id AND rs.hat = fs.at0 WHERE rs.head IS NULL),
xd AS (SELECT *, regexp_extract(tt, {_DATE}) AS hit FROM sb WHERE section = 'experience'),
xr AS (SELECT *, hit <> '' AND (length(tt) < 160 OR NOT regexp_matches(tt, '^[•-]')) AS opens FROM xd),
xi AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY version_id ORDER BY rn) - 1 AS INTEGER) AS role_index FROM xr),
xh AS (SELECT *, trim(regexp_replace(trim(substring(tt, 1, strpos(tt, hit) - 1) || substring(tt, strpos(tt, hit) + length(hit)), {WS}), '[|•·,–—-]+$', ''), {WS}) AS rest FROM xi WHERE opens),
xp AS (SELECT *, regexp_split_to_array(rest, '\\s*[-|•·@,–—]\\s*') AS parts, regexp_extract(hit, {_DATE}, 1) AS m1, regexp_extract(hit, {_DATE}, 2) AS y1, regexp_extract(hit, {_DATE}, 3) AS e3, regexp_extract(hit, {_DATE}, 4) AS m2, regexp_extract(hit, {_DATE}, 5) AS y2 FROM xh),
roles AS (SELECT version_id, role_index, coalesce(nullif(trim(parts[1], {WS}), ''), 'Engineer') AS title, CASE WHEN len(parts) >= 2 THEN coalesce(nullif(trim(parts[2], {WS}), ''), 'Company') ELSE 'Company' END AS company,
  CAST(y1 AS INTEGER) * 12 + {_month('m1', 1)} AS start_month, regexp_matches(lower(e3), 'present|current|now') AS is_current,
  CASE WHEN NOT regexp_matches(lower(e3), 'present|current|now') THEN CAST(nullif(y2, '') AS INTEGER) * 12 + {_month('m2', 12)} END AS end_month, start, block_id, rn FROM xp),
rends AS (SELECT version_id, role_index, max("end") AS "end" FROM xi WHERE role_index >= 0 GROUP BY ALL),
bl AS (SELECT version_id, role_index, rn, start, tt, block_id, list_filter(list_transform(string_split(tt, chr(10)), lambda l: trim(regexp_replace(l, '^[•\\-*\\d.)\\s]+', ''), {WS})), lambda l: length(l) > 5) AS ls FROM xi WHERE NOT opens AND role_index >= 0),
bx AS (SELECT version_id, role_index, rn, start, tt, block_id, unnest(CASE WHEN len(ls) > 0 THEN ls ELSE [tt] END) AS line, generate_subscripts(CASE WHEN len(ls) > 0 THEN ls ELSE [tt] END, 1) AS j FROM bl),
bullets AS (SELECT version_id, role_index, CAST(row_number() OVER (PARTITION BY version_id, role_index ORDER BY rn, j) - 1 AS INTEGER) AS bullet_index, line AS text, CAST(start + strpos(tt, line) - 1 AS INTEGER) AS start, CAST(start + strpos(tt, line) - 1 + length(line) AS INTEGER) AS "end", block_id FROM bx),
skills_def(o, name, category, p) AS (VALUES {_SKILLS}),
iv AS (SELECT version_id, start_month AS s, CASE WHEN is_current OR end_month IS NULL THEN {AS_OF} ELSE end_month END AS e FROM roles),
iw AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY version_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv WHERE e >= s),
ig AS (SELECT *, sum(fresh) OVER (PARTITION BY version_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM iw),
im AS (SELECT version_id, sum(n) AS months FROM (SELECT version_id, g, greatest(1, max(e) - min(s) + 1) AS n FROM ig GROUP BY ALL) GROUP BY version_id),
exper AS (SELECT r.version_id, CAST(coalesce(months, 12 * (SELECT count(*) FROM roles q WHERE q.version_id = r.version_id)) AS INTEGER) AS total_months FROM resumes r LEFT JOIN im USING (version_id)),
edu AS (SELECT version_id, rn, CASE WHEN regexp_matches(tt, {pattern(lx.SCHOOL_PATTERN)}) THEN trim(regexp_extract(tt, {pattern(lx.SCHOOL_PATTERN)}), {WS}) ELSE trim(string_split(tt, chr(10))[1], {WS}) END AS institution,
  CASE WHEN regexp_matches(tt, {pattern(lx.DEGREE_PATTERN)}) THEN trim(regexp_extract(tt, {pattern(lx.DEGREE_PATTERN)}), {WS}) END AS degree, CAST(nullif(regexp_extract(tt, {pattern(lx.GRADUATION_PATTERN)}, 1), '') AS INTEGER) AS graduation_year
  FROM sb WHERE section = 'education' AND (regexp_matches(tt, {pattern(lx.DEGREE_PATTERN)}) OR regexp_matches(tt, {pattern(lx.SCHOOL_PATTERN)}))),
ev AS (SELECT version_id, 0 AS src, rn * 1000 AS pos, tt AS evidence, 'explicit' AS source FROM sb WHERE section = 'skills' UNION ALL SELECT version_id, 1, role_index * 1000 + bullet_index, text, 'inferred' FROM bullets),
skills AS (SELECT version_id, name, category, source, evidence FROM ev JOIN skills_def ON regexp_matches(lower(evidence), p) QUALIFY row_number() OVER (PARTITION BY version_id, name ORDER BY src, pos) = 1)"""

_F1 = f"string_agg(text, chr(10) ORDER BY rn)"
CONTACT = f"""ct AS (SELECT version_id, {_F1} AS t, arg_min(fl, rn) FILTER (length(fl) > 2 AND length(fl) < 40 AND NOT contains(fl, '@') AND NOT contains(fl, 'http') AND NOT regexp_matches(fl, '\\d{{3}}')) AS name FROM (SELECT *, trim(string_split(tt, chr(10))[1], {WS}) AS fl FROM rh QUALIFY rn <= greatest(8, coalesce(min(rn) FILTER (head IS NOT NULL) OVER (PARTITION BY version_id) - 1, count(*) OVER (PARTITION BY version_id)))) GROUP BY version_id),
contact AS (SELECT version_id, name, nullif(regexp_extract(t, {pattern(lx.EMAIL_PATTERN)}, 1), '') AS email, nullif(trim(regexp_extract(t, {pattern(lx.PHONE_PATTERN)}), {WS}), '') AS phone, nullif(regexp_extract(t, {pattern(lx.LINKEDIN_PATTERN)}), '') AS linkedin,
 nullif(regexp_extract(t, {pattern(lx.GITHUB_PATTERN)}), '') AS github, CASE WHEN regexp_matches(lower(loc), 'university|college') THEN NULL ELSE nullif(trim(loc, {WS}), '') END AS location FROM (SELECT *, regexp_extract(t, {pattern(lx.LOCATION_PATTERN)}, 1) AS loc FROM ct))"""


@query("u01_sections", f"{RES} SELECT version_id, block_id, coalesce(max(CASE WHEN head IS NOT NULL THEN head END) OVER (PARTITION BY version_id, hat), 'contact') AS section FROM rs")
def _(t):
    docs = ir.canonical_documents(corpora.resumes(t)).withColumn("heads", resume.section_heads(F.col("blocks")))
    carried = F.transform("blocks", lambda b, i: F.struct(
        b["block_id"].alias("block_id"),
        F.coalesce(F.try_element_at(F.filter(F.slice("heads", 1, i + 1), lambda h: h.isNotNull()), F.lit(-1)), F.lit("contact")).alias("section")))
    return unnest(docs.withColumn("_s", carried), F.col("_s"), "version_id").select("version_id", "_item.*")


@query("u02_contact", f"{RES}, {CONTACT} SELECT * FROM contact")
def _(t):
    return profiles(t).select("version_id", "contact.*")


@query("u03_summary_text", f"{RES} SELECT version_id, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS summary_text FROM sb WHERE section = 'summary' GROUP BY version_id")
def _(t):
    return profiles(t).select("version_id", "summary_text")


@query("u04_u06_roles", f"{RES} SELECT version_id, role_index, title, company, start_month, end_month, is_current, start, \"end\" FROM roles JOIN rends USING (version_id, role_index)")
def _(t):
    return resume.role_rows(profiles(t)).select("version_id", "role_index", "title", "company", "start_month", "end_month", "is_current", "start", "end")


@query("u07_bullets", f"{RES} SELECT version_id, role_index, bullet_index, text, start, \"end\", block_id FROM bullets")
def _(t):
    return resume.bullet_rows(profiles(t))


@query("u08_experience", f"{RES} SELECT version_id, total_months, floor(total_months / 12 * 10 + 0.5) / 10 AS total_years FROM exper")
def _(t):
    return profiles(t).select("version_id", "total_months", "total_years")


@query("u09_education", f"{RES} SELECT version_id, institution, degree, graduation_year FROM edu")
def _(t):
    return unnest(profiles(t), F.col("education"), "version_id").select("version_id", "_item.institution", "_item.degree", "_item.graduation_year")


_ALIASES = ", ".join(f"('{a}', '{n}')" for n, _, al in lx.SKILLS for a in dict.fromkeys((n.lower(), *al)))
_TERM = "CASE p_partkey % 6 WHEN 0 THEN ' K8S ' WHEN 1 THEN 'golang' WHEN 2 THEN p_name WHEN 3 THEN 'Amazon Web Services' WHEN 4 THEN 'c++' ELSE 'Next' END"


@query("u10_canonical_skill", f"WITH a(alias, name) AS (VALUES {_ALIASES}) SELECT p_partkey, coalesce(name, trim({_TERM})) AS skill FROM part LEFT JOIN a ON alias = lower(trim({_TERM}))")
def _(t):
    return t.part.select("p_partkey", canonical_skill(F.expr(_TERM)).alias("skill"))


@query("u11_u12_skills", f"{RES} SELECT version_id, name, category, source, evidence FROM skills")
def _(t):
    return unnest(profiles(t), F.col("skills"), "version_id").select("version_id", "_item.name", "_item.category", "_item.source", "_item.evidence")


@query("u13_certifications", f"{RES} SELECT version_id, c AS certification FROM (SELECT version_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '^[•\\-*\\s]+', ''), {WS}) AS c FROM sb WHERE section = 'certifications') WHERE length(c) > 3")
def _(t):
    return unnest(profiles(t), F.col("certifications"), "version_id", name="certification")


REQ = f"""jobs AS ({corpora.JOBS_SQL}), jl AS (SELECT job_id, trim(unnest(string_split(text, chr(10))), {WS}) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM jobs),
jm AS (SELECT *, CASE WHEN {any_of('lower(l)', lx.PREFERRED_MARKERS)} THEN 'preferred' WHEN {any_of('lower(l)', lx.REQUIRED_MARKERS)} THEN 'required' END AS marker FROM jl WHERE l <> ''),
jp AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY j), 'required') AS priority, trim(regexp_replace(l, '^(?:[•\\-*]|\\d+[.)])\\s*', ''), {WS}) AS txt FROM jm),
req AS (SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY j) - 1 AS INTEGER) AS requirement_index, priority, txt AS text,
 CASE WHEN regexp_matches(lower(txt), {pattern(lx.YEARS_PATTERN)}) AND {any_of('lower(txt)', ('experience', 'background'))} THEN 'experience_years' ELSE {label_case('lower(txt)', lx.REQUIREMENT_CLASSES, "'skill'")} END AS category,
 CAST(nullif(regexp_extract(txt, {pattern(lx.YEARS_PATTERN)}, 1), '') AS INTEGER) AS min_years, {label_case('lower(txt)', lx.DEGREES, 'NULL')} AS degree_level FROM jp WHERE marker IS NULL AND length(txt) >= 15 AND NOT {any_of('lower(l)', lx.JOB_BOILERPLATE)}),
rt AS (SELECT job_id, requirement_index, o, lower(name) AS term FROM req JOIN skills_def ON regexp_matches(lower(text), p))"""


@query("u14_u15_requirements", f"""WITH skills_def(o, name, category, p) AS (VALUES {_SKILLS}), {REQ}, tt AS (SELECT job_id, requirement_index, string_agg(term, ',' ORDER BY o) AS terms FROM rt GROUP BY ALL)
SELECT job_id, requirement_index, priority, category, text, min_years, degree_level, coalesce(terms, '') AS terms FROM req LEFT JOIN tt USING (job_id, requirement_index)""")
def _(t):
    return matching.requirement_rows(matching.parse_requirements(corpora.jobs(t))).withColumn("terms", F.array_join("terms", ","))


MATCH = f"""{RES}, {REQ}, app AS ({APPLICATIONS}),
ax AS (SELECT a.version_id, r.*, floor(total_months / 12 * 10 + 0.5) / 10 AS years FROM app a JOIN req r USING (job_id) JOIN exper USING (version_id)),
sk AS (SELECT a.version_id, a.job_id, t.requirement_index, count(*) AS nt, count(s.name) AS nm FROM app a JOIN rt t USING (job_id) LEFT JOIN skills s ON s.version_id = a.version_id AND lower(s.name) = t.term GROUP BY ALL),
ed AS (SELECT version_id, count(*) AS n, count(degree) AS nd FROM edu GROUP BY ALL),
ld AS (SELECT DISTINCT version_id FROM (SELECT version_id FROM roles WHERE regexp_matches(title, {pattern(lx.LEADER_TITLE)}) UNION ALL SELECT version_id FROM bullets WHERE regexp_matches(text, {pattern(lx.LEADER_BULLET)}))),
lw AS (SELECT DISTINCT ax.version_id, ax.job_id, requirement_index FROM ax JOIN bullets b USING (version_id) WHERE len(list_filter(regexp_extract_all(lower(ax.text), '[a-z]{{4,}}'), lambda w: contains(lower(b.text), w))) >= 2),
mt AS (SELECT ax.*, CASE category WHEN 'experience_years' THEN CASE WHEN years >= coalesce(nullif(min_years, 0), 3) THEN 'supported' WHEN years >= coalesce(nullif(min_years, 0), 3) * 0.65 THEN 'partially_supported' ELSE 'unsupported' END
  WHEN 'education' THEN CASE WHEN ed.n IS NULL THEN 'unsupported' WHEN nd > 0 THEN 'supported' ELSE 'partially_supported' END
  WHEN 'leadership' THEN CASE WHEN ld.version_id IS NOT NULL THEN 'supported' ELSE 'partially_supported' END
  WHEN 'domain_knowledge' THEN CASE WHEN lw.version_id IS NOT NULL THEN 'supported' ELSE 'unsupported' END
  ELSE CASE WHEN nt IS NULL THEN CASE WHEN lw.version_id IS NOT NULL THEN 'supported' ELSE 'unsupported' END WHEN nm = nt THEN 'supported' WHEN nm > 0 THEN 'partially_supported' ELSE 'unsupported' END END AS status, nt, nm, lw.version_id IS NOT NULL AS lexical
  FROM ax LEFT JOIN ed USING (version_id) LEFT JOIN ld USING (version_id) LEFT JOIN sk USING (version_id, job_id, requirement_index) LEFT JOIN lw USING (version_id, job_id, requirement_index)),
matches AS (SELECT version_id, job_id, requirement_index, category, priority, text AS requirement_text, status, CAST(CASE WHEN category = 'experience_years' THEN CASE status WHEN 'supported' THEN 1.0 WHEN 'unsupported' THEN 0.2 ELSE 0.6 END
  WHEN category = 'education' THEN CASE status WHEN 'supported' THEN 1.0 WHEN 'unsupported' THEN 0.0 ELSE 0.7 END WHEN category = 'leadership' THEN CASE status WHEN 'supported' THEN 1.0 ELSE 0.5 END
  WHEN category = 'domain_knowledge' OR nt IS NULL THEN CASE WHEN lexical THEN 0.85 ELSE 0.1 END ELSE CASE WHEN nm = nt THEN 1.0 WHEN nm > 0 THEN floor(nm / nt * 100 + 0.5) / 100 ELSE 0 END END AS DOUBLE) AS score FROM mt)"""


@query("u16_u20_matches", f"{MATCH} SELECT * FROM matches")
def _(t):
    return matching.match_rows(matched(t)).drop("explanation", "start", "end")


@query("u21_coverage", f"""{MATCH}, c AS (SELECT version_id, job_id, count(*) AS n, count(*) FILTER (priority = 'required') AS rn, count(*) FILTER (priority <> 'required') AS pn, coalesce(list_reduce(list(score ORDER BY requirement_index) FILTER (priority = 'required'), lambda a, x: a + x), 0) AS re, coalesce(list_reduce(list(score ORDER BY requirement_index) FILTER (priority <> 'required'), lambda a, x: a + x), 0) AS pe,
 count(*) FILTER (status = 'supported') AS s1, count(*) FILTER (status = 'partially_supported') AS s2, count(*) FILTER (status = 'unsupported') AS s3 FROM matches GROUP BY ALL)
SELECT version_id, job_id, CAST(n AS INTEGER) AS total_requirements, CAST(rn AS INTEGER) AS required_count, CAST(pn AS INTEGER) AS preferred_count, CAST(s1 AS INTEGER) AS supported_count, CAST(s2 AS INTEGER) AS partially_supported_count, CAST(s3 AS INTEGER) AS unsupported_count,
 CAST(floor((re * 0.75 + pe * 0.25) / (greatest(1, rn) * 0.75 + greatest(1, pn) * 0.25) * 100 + 0.5) AS INTEGER) AS overall_score, CASE WHEN rn > 0 THEN CAST(floor(re / rn * 100 + 0.5) AS INTEGER) ELSE 100 END AS required_score, CASE WHEN pn > 0 THEN CAST(floor(pe / pn * 100 + 0.5) AS INTEGER) ELSE 100 END AS preferred_score FROM c""")
def _(t):
    return matching.coverage(matched(t))


@query("j19_skill_ratios", f"""{RES}, {REQ}, app AS ({APPLICATIONS})
SELECT a.version_id, a.job_id, t.requirement_index, CAST(count(*) AS INTEGER) AS terms, CAST(count(s.name) AS INTEGER) AS matched, round(count(s.name) / count(*), 6) AS ratio FROM app a JOIN rt t USING (job_id) LEFT JOIN skills s ON s.version_id = a.version_id AND lower(s.name) = t.term GROUP BY ALL""")
def _(t):
    req = matching.requirement_rows(matching.parse_requirements(corpora.jobs(t))).join(applications(t), "job_id")
    have = unnest(profiles(t), F.col("skills"), "version_id").select("version_id", "_item.name")
    return matching.skill_ratios(req, have, ("version_id", "job_id", "requirement_index"))


ATS = f"""{RES}, {CONTACT}, bs AS (SELECT version_id, count(*) AS n, count(*) FILTER ({' OR '.join(f"starts_with(lower(text), '{w}')" for w in lx.WEAK_OPENERS)}) AS weak, count(*) FILTER (regexp_matches(text, {pattern(lx.QUANTIFIED_PATTERN)})) AS q FROM bullets GROUP BY ALL),
rep AS (SELECT version_id, count(*) AS n FROM (SELECT version_id, regexp_replace(lower(regexp_extract(text, '^\\S*')), '[^a-z]', '', 'g') AS w FROM bullets) WHERE length(w) > 3 GROUP BY version_id, w HAVING count(*) > 3),
gap AS (SELECT DISTINCT version_id FROM (SELECT version_id, start_month - lead(end_month) OVER (PARTITION BY version_id ORDER BY role_index) AS g FROM roles) WHERE g > 6),
base AS (SELECT r.version_id, (email IS NULL)::INT + (phone IS NULL)::INT + (location IS NULL)::INT AS mc, (NOT EXISTS (SELECT 1 FROM roles x WHERE x.version_id = r.version_id))::INT + (NOT EXISTS (SELECT 1 FROM edu x WHERE x.version_id = r.version_id))::INT + (NOT EXISTS (SELECT 1 FROM skills x WHERE x.version_id = r.version_id))::INT AS ms,
 gap.version_id IS NOT NULL AS gp, coalesce(bs.n, 0) AS nb, coalesce(weak, 0) AS weak, coalesce(q, 0) AS q, EXISTS (SELECT 1 FROM rep WHERE rep.version_id = r.version_id) AS rp FROM resumes r JOIN contact USING (version_id) LEFT JOIN bs USING (version_id) LEFT JOIN gap USING (version_id)),
sc AS (SELECT *, CASE WHEN mc > 0 THEN greatest(20, 100 - 30 * mc) ELSE 100 END AS s1, CASE WHEN ms > 0 THEN greatest(30, 100 - 30 * ms) ELSE 100 END AS s2, CASE WHEN gp THEN 75 ELSE 100 END AS s3, CASE WHEN weak > 0 THEN greatest(40, 100 - 15 * weak) ELSE 100 END AS s4,
 CASE WHEN nb = 0 THEN 40 WHEN q / nb < 0.35 THEN greatest(30, CAST(floor(q / nb * 100 + 0.5) AS INTEGER) * 2) ELSE 100 END AS s5, CASE WHEN rp THEN 80 ELSE 100 END AS s6 FROM base)"""


@query("u22_u28_ats_audit", f"""{ATS} SELECT version_id, CAST(s1 AS INTEGER) AS contact, CAST(s2 AS INTEGER) AS structure, CAST(s3 AS INTEGER) AS chronology, CAST(s4 AS INTEGER) AS verbs, CAST(s5 AS INTEGER) AS quantification, CAST(s6 AS INTEGER) AS repetition,
 CAST(floor((s1 + s2 + s3 + s4 + s5 + s6) / 6 + 0.5) AS INTEGER) AS ats_score, CAST((s1 = 100)::INT + (s2 = 100)::INT + (s3 = 100)::INT + (s4 = 100)::INT + (s5 = 100)::INT + (s6 = 100)::INT AS INTEGER) AS ats_passed FROM sc""")
def _(t):
    names = ("contact", "structure", "chronology", "verbs", "quantification", "repetition")
    return ats.audit(profiles(t)).select("version_id", *[F.get("checks", F.lit(i))["score"].alias(n) for i, n in enumerate(names)], "ats_score", "ats_passed")


_PAST = "CASE v " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lx.PAST_TENSE.items()) + " ELSE regexp_replace(v, 'ing$', 'ed') END"
REV = f"""rv0 AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^responsible for\\s+([a-z]+ing)\\s+(.*)$') THEN 1 WHEN regexp_matches(text, '(?i)^(?:helped with|assisted with|assisted in)\\s+(?:the\\s+)?([a-z]+ing)\\s+(.*)$') THEN 2 WHEN regexp_matches(text, '(?i)^worked on\\s+(?:the\\s+)?([a-z]+ing)\\s+(.*)$') THEN 3 END AS kind FROM bullets),
rv1 AS (SELECT *, lower(regexp_extract(text, '(?i)^(?:responsible for|helped with|assisted with|assisted in|worked on)\\s+(?:the\\s+)?([a-z]+ing)\\s+(.*)$', 1)) AS v, regexp_extract(text, '(?i)^(?:responsible for|helped with|assisted with|assisted in|worked on)\\s+(?:the\\s+)?([a-z]+ing)\\s+(.*)$', 2) AS rest FROM rv0 WHERE kind IS NOT NULL),
rev AS (SELECT version_id, role_index, bullet_index, text, start, "end", CASE WHEN kind = 2 THEN 'Collaborated to ' || regexp_replace(v, 'ing$', '') || ' ' || rest ELSE upper(left({_PAST}, 1)) || substring({_PAST}, 2) || ' ' || rest END AS candidate,
 CASE kind WHEN 1 THEN 'Replaced passive opener ''Responsible for ' || v || ''' with dynamic action verb ''' || {_PAST} || '''.' WHEN 2 THEN 'Strengthened passive ''Helped with'' to proactive collaboration.' ELSE 'Replaced vague ''Worked on'' with precise action verb ''' || {_PAST} || '''.' END AS rationale FROM rv1)"""


@query("u29_bullet_revisions", f"{RES}, {REV} SELECT version_id, role_index, bullet_index, text, candidate, rationale, true AS passed FROM rev")
def _(t):
    return rewrite.revisions(resume.bullet_rows(profiles(t))).select("version_id", "role_index", "bullet_index", "text", "candidate", "rationale", "passed")


def _nums(e: str) -> str:
    p = pattern(r"(?i)\b(\d+(?:,\d{3})*(?:\.\d+)?|(?:one|two|three|four|five|six|seven|eight|nine|ten))\b")
    return f"list_transform(regexp_extract_all({e}, {p}), lambda n: lower(replace(n, ',', '')))"


@query("u30_validate_rewrites", f"""WITH skills_def(o, name, category, p) AS (VALUES {_SKILLS}), rw AS ({corpora.REWRITES_SQL}),
n AS (SELECT rewrite_id, len(list_filter({_nums('candidate')}, lambda x: NOT list_contains({_nums('original')}, x))) AS metrics FROM rw),
s AS (SELECT rewrite_id, count(*) AS technologies FROM rw JOIN skills_def ON regexp_matches(lower(candidate), p) AND NOT regexp_matches(lower(original), p) GROUP BY ALL),
v AS (SELECT rewrite_id, CAST(metrics AS INTEGER) AS metrics, CAST(coalesce(technologies, 0) AS INTEGER) AS technologies, CAST((NOT regexp_matches(lower(original), 'lead|led|head|direct') AND regexp_matches(lower(candidate), '^(led|directed|headed) '))::INT AS INTEGER) AS leadership,
 CAST((NOT contains(lower(original), 'team of') AND contains(lower(candidate), 'team of'))::INT AS INTEGER) AS team_size FROM rw JOIN n USING (rewrite_id) LEFT JOIN s USING (rewrite_id))
SELECT *, metrics + technologies + leadership + team_size = 0 AS valid FROM v""")
def _(t):
    rows = corpora.rewrites(t).withColumn("v", rewrite.violations(F.col("original"), F.col("candidate")))
    n = lambda kind: F.size(F.filter("v", lambda x: x["kind"] == kind))
    return rows.select("rewrite_id", n("metric").alias("metrics"), n("technology").alias("technologies"), n("leadership").alias("leadership"), n("team_size").alias("team_size"), (F.size("v") == 0).alias("valid"))


@query("u31_number_tokens", f"WITH rw AS ({corpora.REWRITES_SQL}) SELECT rewrite_id, array_to_string({_nums('candidate')}, ',') AS numbers FROM rw")
def _(t):
    return corpora.rewrites(t).select("rewrite_id", F.array_join(rewrite.number_tokens(F.col("candidate")), ",").alias("numbers"))


@query("u32_resume_findings", f"""{MATCH.replace('WITH resumes', 'WITH resumes', 1)}, {CONTACT}, {ATS.split(CONTACT + ', ')[1]}, {REV}, f AS (
 SELECT version_id, 'ats_contact' AS category, CASE WHEN email IS NULL THEN 'critical' ELSE 'medium' END AS severity FROM sc JOIN contact USING (version_id) WHERE s1 < 100
 UNION ALL SELECT version_id, 'ats_structure', 'high' FROM sc WHERE s2 < 100 UNION ALL SELECT version_id, 'ats_chronology', 'medium' FROM sc WHERE s3 < 100 UNION ALL SELECT version_id, 'ats_action_verbs', 'medium' FROM sc WHERE s4 < 100
 UNION ALL SELECT version_id, 'ats_quantification', 'medium' FROM sc WHERE s5 < 100 AND nb > 0 UNION ALL SELECT version_id, 'ats_repetition', 'low' FROM sc WHERE s6 < 100
 UNION ALL SELECT version_id, 'bullet_improvement', 'info' FROM rev UNION ALL SELECT version_id, 'role_qualification_gap', 'high' FROM matches WHERE priority = 'required' AND status = 'unsupported')
SELECT version_id, category, severity, CAST(count(*) AS BIGINT) AS findings FROM f GROUP BY ALL""")
def _(t):
    found = reviews.resume_findings(ats.audit(profiles(t)), matched(t))
    return found.groupBy("version_id", "category", "severity").agg(F.count("*").alias("findings"))


def _worded(category: str, **values: str) -> str:
    """title, explanation, suggested_action and confidence of a category with SQL expressions filled in."""
    texts = next(f[1:] for f in lx.RESUME_FINDINGS if f[0] == category)
    out = []
    for name, text in zip(("title", "explanation", "suggested_action", "confidence"), texts, strict=True):
        e = "'" + text.replace("'", "''") + "'"
        for key, value in values.items():
            e = f"replace({e}, '{{{{{key}}}}}', {value})"
        out.append(f"{e} AS {name}")
    return ", ".join(out)


def _listed(sep: str, *parts: tuple[str, str]) -> str:
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{label}{chr(39)} END' for c, label in parts)}], lambda x: x IS NOT NULL), '{sep}')"


_GONE = (("email IS NULL", "email address"), ("phone IS NULL", "phone number"), ("location IS NULL", "location / city"))
_SECTIONS = tuple((f"NOT EXISTS (SELECT 1 FROM {t} x WHERE x.version_id = sc.version_id)", label) for t, label in (("roles", "Experience"), ("edu", "Education"), ("skills", "Skills")))
_CITED = "block_id || '@' || CAST(start AS STRING) || '-' || CAST(\"end\" AS STRING) || ' ' || {quote}"


@query("u32_finding_evidence", f"""{MATCH}, {CONTACT}, {ATS.split(CONTACT + ', ')[1]}, {REV},
wk AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY role_index, bullet_index) AS k FROM bullets WHERE {' OR '.join(f"starts_with(lower(text), '{w}')" for w in lx.WEAK_OPENERS)}),
wc AS (SELECT version_id, string_agg({_CITED.format(quote='text')}, ' / ' ORDER BY k) AS cited FROM wk WHERE k <= {lx.CITED_WEAK_BULLETS} GROUP BY version_id),
g1 AS (SELECT version_id, role_index, company AS later, start_month - lead(end_month) OVER w AS months, lead(company) OVER w AS earlier FROM roles WINDOW w AS (PARTITION BY version_id ORDER BY role_index)),
g2 AS (SELECT version_id, arg_min(CAST(months AS VARCHAR) || ' month gap between ' || earlier || ' and ' || later, role_index) AS words FROM g1 WHERE months > 6 GROUP BY version_id),
o1 AS (SELECT version_id, w, count(*) AS n, min(role_index * 100000 + bullet_index) AS seen FROM (SELECT *, regexp_replace(lower(regexp_extract(text, '^\\S*')), '[^a-z]', '', 'g') AS w FROM bullets) WHERE length(w) > 3 GROUP BY ALL HAVING count(*) > 3),
o2 AS (SELECT version_id, string_agg('"' || w || '" (' || CAST(n AS VARCHAR) || 'x)', ', ' ORDER BY seen) AS words FROM o1 GROUP BY version_id),
top AS (SELECT r.version_id, r.start, e."end" FROM roles r JOIN rends e USING (version_id, role_index) WHERE r.role_index = 0),
hb AS (SELECT top.*, coalesce(min(b.block_id) FILTER (b.start <= top.start AND b."end" >= top."end"), arg_min(b.block_id, b.block_index)) AS block_id FROM top JOIN blocks b USING (version_id) GROUP BY ALL),
rc AS (SELECT version_id, {_CITED.format(quote=f"trim(substring(canonical_text, start + 1, {chr(34)}end{chr(34)} - start), {WS})")} AS cited FROM hb JOIN blocks_doc USING (version_id)),
tn AS (SELECT job_id, requirement_index, string_agg(term, ', ' ORDER BY o) AS names FROM rt GROUP BY ALL),
gq AS (SELECT mt.version_id, mt.job_id, category, text, CASE WHEN category = 'experience_years' THEN 'Candidate has ' || CASE WHEN years = floor(years) THEN CAST(CAST(years AS BIGINT) AS VARCHAR) ELSE CAST(years AS VARCHAR) END || ' years of experience, which does not meet the required ' || CAST(coalesce(nullif(min_years, 0), 3) AS VARCHAR) || '+ years.'
  WHEN category = 'education' THEN 'No formal degree or educational history listed on resume.' WHEN category <> 'domain_knowledge' AND nt IS NOT NULL THEN 'No evidence found on resume for requested technologies: ' || names || '.' ELSE 'No direct evidence found on resume for "' || text || '".' END AS why,
  CASE WHEN category = 'experience_years' THEN coalesce(cited, '') ELSE '' END AS cited FROM mt LEFT JOIN tn USING (job_id, requirement_index) LEFT JOIN rc ON rc.version_id = mt.version_id WHERE priority = 'required' AND status = 'unsupported')
SELECT version_id, NULL AS job_id, 'ats_contact' AS category, CASE WHEN email IS NULL THEN 'critical' ELSE 'medium' END AS severity, {_worded('ats_contact', parts=_listed(', ', *_GONE), both=_listed(' and ', *_GONE))}, '' AS cited, NULL AS replacement FROM sc JOIN contact USING (version_id) WHERE mc > 0
UNION ALL SELECT version_id, NULL, 'ats_structure', 'high', {_worded('ats_structure', parts=_listed(', ', *_SECTIONS), both=_listed(' and ', *_SECTIONS))}, '', NULL FROM sc WHERE ms > 0
UNION ALL SELECT version_id, NULL, 'ats_chronology', 'medium', {_worded('ats_chronology', parts='words')}, '', NULL FROM g2
UNION ALL SELECT version_id, NULL, 'ats_action_verbs', 'medium', {_worded('ats_action_verbs', parts='CAST(weak AS VARCHAR)')}, cited, NULL FROM sc JOIN wc USING (version_id)
UNION ALL SELECT version_id, NULL, 'ats_quantification', 'medium', {_worded('ats_quantification', parts='CAST(CAST(floor(q / nb * 100 + 0.5) AS INTEGER) AS VARCHAR)')}, '', NULL FROM sc WHERE nb > 0 AND q / nb < 0.35
UNION ALL SELECT version_id, NULL, 'ats_repetition', 'low', {_worded('ats_repetition', parts='words')}, '', NULL FROM o2
UNION ALL SELECT version_id, NULL, 'bullet_improvement', 'info', {_worded('bullet_improvement', why='rationale')}, {_CITED.format(quote='text')}, candidate FROM rev JOIN bullets b USING (version_id, role_index, bullet_index, text, start, "end")
UNION ALL SELECT version_id, job_id, 'role_qualification_gap', 'high', {_worded('role_qualification_gap', parts='category', text='text', why='why')}, cited, NULL FROM gq""")
def _(t):
    found = reviews.resume_findings(ats.audit(profiles(t)), matched(t))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(
        c["block_id"], F.lit("@"), c["start"].cast("string"), F.lit("-"), c["end"].cast("string"), F.lit(" "), c["quote"])), " / ")
    return found.select(
        "version_id", "job_id", "category", "severity", "title", "explanation", "suggested_action", "confidence", cited.alias("cited"),
        F.col("patch.replacement").alias("replacement"))


@query("u33_resume_summary", f"""{MATCH}, {CONTACT}, {ATS.split(CONTACT + ', ')[1]}, {REV}, c AS (SELECT version_id, job_id, count(*) FILTER (priority = 'required') AS rn, count(*) FILTER (priority <> 'required') AS pn, coalesce(list_reduce(list(score ORDER BY requirement_index) FILTER (priority = 'required'), lambda a, x: a + x), 0) AS re, coalesce(list_reduce(list(score ORDER BY requirement_index) FILTER (priority <> 'required'), lambda a, x: a + x), 0) AS pe FROM matches GROUP BY ALL)
SELECT version_id, job_id, CAST((SELECT count(*) FROM roles r WHERE r.version_id = c.version_id) AS INTEGER) AS total_roles, floor(total_months / 12 * 10 + 0.5) / 10 AS total_years, CAST((SELECT count(*) FROM skills k WHERE k.version_id = c.version_id) AS INTEGER) AS total_skills,
 CAST(floor((s1 + s2 + s3 + s4 + s5 + s6) / 6 + 0.5) AS INTEGER) AS ats_score, CAST((SELECT count(*) FROM rev v WHERE v.version_id = c.version_id) AS INTEGER) AS revisions_generated,
 CAST(floor((re * 0.75 + pe * 0.25) / (greatest(1, rn) * 0.75 + greatest(1, pn) * 0.25) * 100 + 0.5) AS INTEGER) AS role_match_score FROM c JOIN sc USING (version_id) JOIN exper USING (version_id)""")
def _(t):
    return reviews.resume_summary(matched(t))
