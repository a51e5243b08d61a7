"""SQL fragments shared by the DuckDB twins: blocks, canonical text, tokens, clauses."""

from __future__ import annotations

from lexfolio import lexicons as lx

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
NL = "chr(10)"


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def cleaned(expr: str) -> str:
    return (f"trim(regexp_replace(translate(regexp_replace(nfc_normalize({expr}), '\\r\\n?|[\\f\\x0B]', chr(10), 'g'), "
            f"chr(160) || chr(8199) || chr(8239), '   '), '[\\x{{200B}}\\x{{FEFF}}]', '', 'g'), {WS})")


def blocks_cte(src: str, key: str, sep: str = r"\r?\n\r?\n", text: str = "text", name: str = "blocks") -> str:
    """CTEs <name>_p, <name> (one row per block with offsets) and <name>_doc (canonical text)."""
    split = f"regexp_split_to_array({text}, '{sep}')"
    return f"""
{name}_p AS (SELECT {key}, trim(unnest({split}), {WS}) AS piece, CAST(generate_subscripts({split}, 1) - 1 AS INTEGER) AS block_index FROM {src}),
{name}_t AS (SELECT {key}, block_index, {cleaned('piece')} AS text,
  CASE WHEN starts_with(piece, '#') THEN 'heading' WHEN regexp_matches(piece, '^[•\\-*]\\s+') THEN 'list_item' ELSE 'paragraph' END AS block_type,
  CASE WHEN starts_with(piece, '#') THEN CAST(length(regexp_extract(piece, '^#+')) AS INTEGER) WHEN regexp_matches(piece, '^[•\\-*]\\s+') THEN 1 END AS level
  FROM {name}_p WHERE piece <> ''),
{name}_s AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN block_type = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END AS sep
  FROM {name}_t WHERE text <> '' WINDOW w AS (PARTITION BY {key} ORDER BY block_index)),
{name} AS (SELECT {key}, block_index, 'b' || block_index AS block_id, block_type, text, level, sep,
  CAST(sum(length(sep) + length(text)) OVER w - length(text) AS INTEGER) AS start,
  CAST(sum(length(sep) + length(text)) OVER w AS INTEGER) AS "end"
  FROM {name}_s WINDOW w AS (PARTITION BY {key} ORDER BY block_index)),
{name}_doc AS (SELECT {key}, string_agg(sep || text, '' ORDER BY block_index) AS canonical_text FROM {name} GROUP BY {key})"""


def tokens(expr: str) -> str:
    plain = f"regexp_replace(lower({expr}), '[^A-Za-z0-9_\\s$\\-.]', ' ', 'g')"
    return (f"list_filter(regexp_split_to_array({plain}, '\\s+'), lambda t: length(t) > 1 AND NOT list_contains({words(lx.STOPWORDS)}, t))")


def word_set(expr: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expr}), '[a-z0-9]+'))"


def dice(a: str, b: str) -> str:
    """Dice over two already built word lists."""
    return (f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END")


def any_of(expr: str, items) -> str:
    out = []
    for w in items:
        q = w.lstrip("^").replace("'", "''")
        out.append(f"starts_with({expr}, '{q}')" if w.startswith("^") else f"contains({expr}, '{q}')")
    return "(" + " OR ".join(out) + ")"


def label_case(expr: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(expr, ws)} THEN '{lab}'" for lab, ws in table) + f" ELSE {default} END"
