"""Alignment, changes and token diffs of contract revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio.functions.arrays import unnest
from lexfolio.operators import compare, ir
from lexfolio.plans.catalog.contracts_sql import clauses_cte, quantities_cte
from lexfolio.plans.catalog.sqlparts import WS, blocks_cte, dice, word_set
from lexfolio.plans.registry import query
from lexfolio.plans.reviews import segmented_revisions
from lexfolio.sources import corpora


def revision_pairs(t):
    return segmented_revisions(corpora.revisions(t))


def alignments(t):
    return compare.compare_revisions(revision_pairs(t))


def _side(name: str) -> str:
    src = f"(SELECT pair_id AS version_id, {name}_text AS text FROM revisions)"
    return f"{blocks_cte(src, 'version_id', name=name)},{clauses_cte(name, name[0] + 'c')}, {name[0]}w AS (SELECT *, {word_set('full_text')} AS ws, {word_set('heading')} AS hs FROM {name[0]}c)"


ALIGN = f"""revisions AS ({corpora.REVISIONS_SQL}), {_side('base')}, {_side('target')},
sc AS (SELECT b.version_id, b.clause_index AS b, t.clause_index AS t, {dice('b.ws', 't.ws')} AS score,
  b.clause_number <> '' AND b.clause_number = t.clause_number AND (lower(b.heading) = lower(t.heading) OR {dice('b.hs', 't.hs')} > 0.6) AS numbered FROM bw b JOIN tw t USING (version_id)),
ca AS MATERIALIZED (SELECT version_id, t, list(b ORDER BY b) FILTER (numbered) AS c1, list(b ORDER BY score DESC, b) FILTER (score >= 0.45) AS c2 FROM sc GROUP BY ALL),
nt AS MATERIALIZED (SELECT version_id, max(clause_index) + 1 AS n FROM tc GROUP BY version_id),
g AS (SELECT version_id, n, -1 AS step, []::INTEGER[] AS used, []::INTEGER[] AS done, NULL::INTEGER AS t, NULL::INTEGER AS b, NULL::BOOLEAN AS by_number FROM nt
  UNION ALL SELECT version_id, n, step, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, CASE WHEN pick IS NULL THEN done ELSE list_append(done, t) END, t, pick, step < n FROM (
    SELECT g.version_id, g.n, g.step + 1 AS step, used, done, ca.t AS t, CASE WHEN g.step + 1 >= g.n AND list_contains(done, ca.t) THEN NULL
      ELSE list_filter(CASE WHEN g.step + 1 < g.n THEN coalesce(c1, []) ELSE coalesce(c2, []) END, lambda x: NOT list_contains(used, x))[1] END AS pick
    FROM g JOIN ca ON ca.version_id = g.version_id AND ca.t = (g.step + 1) % g.n WHERE g.step + 1 < 2 * g.n)),
al AS (SELECT version_id, t, b, by_number FROM g WHERE b IS NOT NULL
  UNION ALL SELECT version_id, clause_index, NULL, NULL FROM tc WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.version_id = tc.version_id AND g.t = tc.clause_index AND g.b IS NOT NULL)
  UNION ALL SELECT version_id, NULL, clause_index, NULL FROM bc WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.version_id = bc.version_id AND g.b = bc.clause_index)),
a0 AS (SELECT al.*, bw.full_text AS bt, tw.full_text AS tt, bw.clause_number AS bn, tw.clause_number AS tn, bw.heading AS bh, tw.heading AS th, trim(bw.full_text, {WS}) = trim(tw.full_text, {WS}) AS exact,
  {dice('bw.ws', 'tw.ws')} AS dice FROM al LEFT JOIN bw ON bw.version_id = al.version_id AND bw.clause_index = b LEFT JOIN tw ON tw.version_id = al.version_id AND tw.clause_index = t),
a1 AS (SELECT *, CASE WHEN b IS NULL OR t IS NULL THEN 0.0::DOUBLE WHEN exact THEN 1.0::DOUBLE ELSE dice END AS similarity FROM a0),
ali AS (SELECT *, CASE WHEN b IS NULL THEN 'added' WHEN t IS NULL THEN 'deleted' WHEN NOT by_number AND bn <> tn AND similarity > 0.7 THEN 'moved' WHEN exact THEN 'identical' WHEN bn <> tn AND similarity > 0.85 THEN 'moved' ELSE 'modified' END AS alignment,
  CASE WHEN b IS NULL THEN 'added' WHEN t IS NULL THEN 'removed' WHEN exact THEN NULL
   WHEN regexp_matches(bt, '(?i)\\b(shall|must)\\b') AND regexp_matches(tt, '(?i)\\bmay\\b') AND NOT regexp_matches(tt, '(?i)\\b(shall|must)\\b') THEN 'modality_shift'
   WHEN NOT regexp_matches(bt, '(?i)\\b(shall|must)\\b') AND regexp_matches(tt, '(?i)\\b(shall not|must not)\\b') THEN 'added' END AS obligation_change FROM a1)"""

NUMERIC = f"""{ALIGN},{quantities_cte("(SELECT version_id, b, t, bt AS text, 0 AS base FROM ali WHERE b IS NOT NULL AND t IS NOT NULL AND NOT exact)", "version_id, b, t", "qb")},
{quantities_cte("(SELECT version_id, b, t, tt AS text, 0 AS base FROM ali WHERE b IS NOT NULL AND t IS NOT NULL AND NOT exact)", "version_id, b, t", "qt")},
nc AS (SELECT version_id, b, t, field, x.value AS old_value, y.value AS new_value, coalesce(y.unit, x.unit) AS unit, CASE WHEN y.raw IS NULL THEN field || ' (' || x.raw || ') was removed' WHEN x.raw IS NULL THEN field || ' was added with value ' || y.raw
  ELSE field || ' changed from ' || x.raw || ' to ' || y.raw END AS description FROM qb x FULL JOIN qt y USING (version_id, b, t, field) WHERE x.value IS DISTINCT FROM y.value)"""


@query("j12_j14_clause_alignment", f"WITH RECURSIVE {ALIGN} SELECT version_id AS pair_id, b AS base_index, t AS target_index, alignment, round(similarity, 6) AS similarity, bh AS base_heading, th AS target_heading FROM ali")
def _(t):
    return alignments(t).select("pair_id", "base_index", "target_index", "alignment", F.round("similarity", 6).alias("similarity"), "base_heading", "target_heading")


@query("c25_alignment_labels", f"WITH RECURSIVE {ALIGN} SELECT alignment, CAST(count(*) AS BIGINT) AS clauses FROM ali GROUP BY alignment")
def _(t):
    return alignments(t).groupBy("alignment").agg(F.count("*").alias("clauses"))


@query("c27_numeric_changes", f"WITH RECURSIVE {NUMERIC} SELECT version_id AS pair_id, b AS base_index, t AS target_index, field, old_value, new_value, unit, description FROM nc")
def _(t):
    return unnest(alignments(t), F.col("numeric_changes"), "pair_id", "base_index", "target_index").select("pair_id", "base_index", "target_index", "_item.*")


@query("c28_obligation_changes", f"WITH RECURSIVE {ALIGN} SELECT version_id AS pair_id, b AS base_index, t AS target_index, obligation_change FROM ali WHERE obligation_change IS NOT NULL")
def _(t):
    return alignments(t).filter(F.col("obligation_change").isNotNull()).select("pair_id", "base_index", "target_index", "obligation_change")


@query("c29_comparison_summary", f"""WITH RECURSIVE {NUMERIC}, k AS (SELECT ali.*, EXISTS (SELECT 1 FROM nc WHERE nc.version_id = ali.version_id AND nc.b = ali.b AND nc.t = ali.t) AS num FROM ali)
SELECT version_id AS pair_id, CAST(count(b) AS INTEGER) AS total_base, CAST(count(t) AS INTEGER) AS total_target, {', '.join(f"CAST(count(*) FILTER (alignment = '{a}') AS INTEGER) AS {a}_count" for a in ('identical', 'modified', 'added', 'deleted', 'moved'))},
 CAST(count(*) FILTER (num OR obligation_change IS NOT NULL) AS INTEGER) AS high_risk_count FROM k GROUP BY version_id""")
def _(t):
    return compare.comparison_summary(alignments(t))


@query("c26_token_diff")
def _(t):
    rows = compare.token_diffs(alignments(t))
    count = lambda op: F.size(F.filter("diff", lambda d: d["op"] == op))
    return rows.select("pair_id", "base_index", "target_index", *[count(op).alias(op + "s") for op in ("equal", "insert", "delete")])


@query("c26_rebuilt_sides", f"WITH RECURSIVE {ALIGN} SELECT version_id AS pair_id, b AS base_index, t AS target_index, alignment, md5(coalesce(bt, '')) AS base_md5, md5(coalesce(tt, '')) AS target_md5, CASE WHEN bt = tt THEN 0 WHEN bt IS NULL OR tt IS NULL THEN 1 ELSE 2 END AS kind FROM ali")
def _(t):
    """Both sides of every clause put together again from the edit script, and what kinds of steps it takes."""
    rows = compare.token_diffs(alignments(t))
    side = lambda other: F.md5(F.array_join(F.transform(F.filter("diff", lambda d: d["op"] != other), lambda d: d["token"]), ""))
    ops = F.array_distinct(F.transform("diff", lambda d: d["op"]))
    kind = F.when(ops == F.array(F.lit("equal")), 0).when((F.size(ops) == 1) & (F.col("base_text").isNull() | F.col("target_text").isNull()), 1).otherwise(2)
    return rows.select("pair_id", "base_index", "target_index", "alignment", side("insert").alias("base_md5"), side("delete").alias("target_md5"), kind.alias("kind"))
