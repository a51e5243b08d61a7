"""Text corpora derived row by row from the relational tables.

Each corpus is one SQL expression over integer keys, written in the dialect that
Spark and DuckDB share, so both engines build the same characters and the corpus
grows with its seed table. The wording follows the labelled cases the operators
are judged on: quantities, modal verbs, cross references, date ranges, skills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

GAP = "\n\n"


def _lit(text: str) -> str:
    assert "'" not in text and "\\" not in text
    return f"'{text}'"


def _join(*parts: str) -> str:
    return " || ".join(p if p.startswith(("CASE", "CAST", "'", "(")) else _lit(p) for p in parts)


def _num(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def contract_text(k: str = "k", *, notice: str | None = None, cap: str | None = None, audit: str = "false",
                  drop_law: str = "false", shift: str = "false", relax: str = "false") -> str:
    """SQL expression for one agreement with key ``k``.

    The keyword arguments are SQL expressions that vary a revision: notice days,
    liability cap, an added audit clause, a dropped governing-law clause, a shift
    of section numbers from payment on, and shall -> may in the services clause.
    """
    notice = notice or f"CASE {k} % 4 WHEN 0 THEN 'ten (10)' WHEN 1 THEN 'thirty (30)' WHEN 2 THEN '45' ELSE 'sixty (60)' END"
    cap = cap or f"CASE {k} % 4 WHEN 0 THEN '$250,000' WHEN 1 THEN '$1,500,000' WHEN 2 THEN 'USD 2 million' ELSE '$750,000.00' END"

    def sec(n: int) -> str:
        return f"CASE WHEN {shift} THEN '{n + 1}' ELSE '{n}' END"

    title = (f"CASE {k} % 3 WHEN 0 THEN 'MUTUAL NON-DISCLOSURE AGREEMENT' WHEN 1 THEN 'EXECUTIVE EMPLOYMENT AGREEMENT' "
             f"ELSE 'MASTER SERVICES AGREEMENT' END")
    parties = _join(
        "This Agreement is made by and between Harbor ",
        f"CASE {k} % 5 WHEN 0 THEN 'Point' WHEN 1 THEN 'Lane' WHEN 2 THEN 'Ridge' WHEN 3 THEN 'View' ELSE 'Gate' END",
        f"CASE WHEN {k} % 7 = 3 THEN ' Inc. and Delta Works LLC' ELSE ' Holdings (\"Company\") and Delta Works ' END",
        f"CASE WHEN {k} % 7 = 3 THEN '' WHEN {k} % 7 < 3 THEN '(the \"Contractor\")' ELSE ', a Delaware limited liability company (the \"Receiving Party\")' END",
        ". The agreement number is ", _num(k), ".")
    definitions = ("SECTION 1. DEFINITIONS" + GAP +
                   "\"Confidential Information\" means any non-public data that a party discloses; "
                   "\"Services\" shall mean the work described in Exhibit A. (Affiliate) means an entity under common control.")
    conf_head = f"CASE WHEN {k} % 2 = 0 THEN 'SECTION 2. CONFIDENTIALITY' ELSE 'SECTION 2. OBLIGATIONS OF RECIPIENT' END"
    conf_body = (f"CASE WHEN {k} % 2 = 0 THEN 'Each party shall hold all records in strict confidence for a period of ' "
                 f"ELSE 'Recipient shall not disclose any records of the other side for a period of ' END")
    conf_tail = _join(_num(f"1 + {k} % 7"), f"CASE WHEN {k} % 7 = 0 THEN ' year. ' ELSE ' years. ' END")
    carve = (f"CASE {k} % 4 WHEN 0 THEN 'Protected records exclude public knowledge, independent development, and disclosures compelled by law.' "
             f"WHEN 1 THEN 'Protected records exclude matters in the public domain, independently developed work, or those under court order.' "
             f"WHEN 2 THEN 'Recipient may share records with advisers, except for source code, trade secrets and pricing data.' "
             f"ELSE 'Recipient must not copy records unless the owner agrees in writing.' END")
    carve_sub = _join(GAP, "2.1 Return of Materials", GAP,
                      "Upon request, Recipient will return all records within ", _num(f"5 + {k} % 3"), " business days. See Section 2 and Clause 5.",
                      f"CASE WHEN {k} % 6 = 0 THEN ' The process in Section 99 applies.' ELSE '' END")
    indemnity = f"CASE WHEN {k} % 5 = 0 THEN {_join(GAP + 'SECTION 3. INDEMNIFICATION' + GAP + 'Contractor shall indemnify, defend and hold harmless the Company from third party claims.')} ELSE '' END"
    inventions = (f"CASE WHEN {k} % 3 = 1 THEN {_join(GAP + 'SECTION 3. INVENTIONS' + GAP + 'Employee assigns all inventions made during employment')} "
                  f"|| CASE WHEN {k} % 4 < 2 THEN ', excluding prior inventions listed on Exhibit A.' ELSE '.' END || "
                  f"{_join(GAP + '(a) Non-Competition' + GAP + 'Employee shall not engage in any competing business for ')} || "
                  f"CASE {k} % 4 WHEN 0 THEN 'six (6) months' WHEN 1 THEN 'twenty-four (24) months' WHEN 2 THEN '2 years' ELSE '90 days' END || ' after leaving.' "
                  f"|| CASE WHEN {k} % 8 = 1 THEN ' Employment is at-will and may end with or without cause.' ELSE '' END ELSE '' END")
    liability = (f"CASE WHEN {k} % 3 = 2 THEN {_join(GAP + 'SECTION 4. LIMITATION OF LIABILITY' + GAP + 'In no event shall the aggregate liability of a party exceed ')} || {cap} "
                 f"|| CASE WHEN {k} % 4 < 2 THEN ', except for gross negligence, willful misconduct or fraud.' ELSE '. Fees of EUR 5,000 apply.' END ELSE '' END")
    services = f"CASE WHEN {relax} THEN 'Contractor may deliver the work on time.' ELSE 'Contractor shall deliver the work on time.' END"
    payment = _join(GAP, "SECTION ", sec(5), ". PAYMENT", GAP, "Client shall pay each invoice within ", _num(f"15 + 15 * ({k} % 4)"),
                    " days of receipt. Late sums bear interest if unpaid. ", services)
    lists = _join(GAP, "- Monthly statement of work", GAP, "- Itemised expenses", GAP, "• Signed timesheets café annex")
    renewal = _join(GAP, "SECTION ", sec(6), ". TERM AND RENEWAL", GAP,
                    "This Agreement renews automatically unless a party objects ", _num(f"30 * (1 + {k} % 4)"), " days before the renewal date.")
    termination = _join(GAP, "SECTION ", sec(7), ". TERMINATION", GAP,
                        "Subject to Section 2.1, either party may terminate this Agreement upon ", notice, " days prior written notice. ",
                        "However, Client must settle open sums; provided that work was accepted, payment follows Article 5.")
    audit_part = f"CASE WHEN {audit} THEN {_join(GAP + 'SECTION 8. AUDIT RIGHTS' + GAP + 'Client may inspect records once per year. Contractor shall not obstruct an audit.')} ELSE '' END"
    law = (f"CASE WHEN {drop_law} THEN '' ELSE {_join(GAP + 'SECTION 9. GOVERNING LAW' + GAP + 'This Agreement shall be governed by the laws of the State of ')} || "
           f"CASE {k} % 4 WHEN 0 THEN 'New York' WHEN 1 THEN 'Delaware' WHEN 2 THEN 'California' ELSE 'Texas' END || '.' END")
    exhibit = f"CASE WHEN {k} % 2 = 1 THEN {_join(GAP + 'EXHIBIT A' + GAP + 'Statement of work and fee table.')} ELSE '' END"
    return "(" + " || ".join([
        title, _lit(GAP), parties, _lit(GAP), _lit(definitions), _lit(GAP), conf_head, _lit(GAP), conf_body, conf_tail, carve,
        carve_sub, indemnity, inventions, liability, payment, lists, renewal, termination, audit_part, law, exhibit]) + ")"


PLAYBOOK_SQL = "CASE {k} % 3 WHEN 0 THEN 'nda' WHEN 1 THEN 'employment' ELSE 'services' END"

CONTRACTS_SQL = f"""SELECT CAST(o_orderkey AS STRING) AS version_id, {PLAYBOOK_SQL.format(k='o_orderkey')} AS playbook,
 {contract_text('o_orderkey')} AS text FROM orders"""

# A revision changes the notice period, the cap, adds or drops a clause, renumbers, or relaxes a duty.
_TARGET = contract_text(
    "o_orderkey",
    notice="CASE o_orderkey % 3 WHEN 0 THEN 'fourteen (14)' WHEN 1 THEN 'thirty (30)' ELSE '45' END",
    cap="CASE WHEN o_orderkey % 2 = 0 THEN '$250,000' ELSE '$3,000,000' END",
    audit="o_orderkey % 4 = 0", drop_law="o_orderkey % 5 = 0", shift="o_orderkey % 6 = 0", relax="o_orderkey % 7 = 0")

REVISIONS_SQL = f"""SELECT CAST(o_orderkey AS STRING) AS pair_id, {contract_text('o_orderkey')} AS base_text,
 {_TARGET} AS target_text FROM orders"""


def resume_text(k: str = "k") -> str:
    """SQL expression for one resume with key ``k``."""
    skills = (f"CASE {k} % 5 WHEN 0 THEN 'TypeScript, React, Node.js, PostgreSQL, Docker' WHEN 1 THEN 'Python, Django, AWS, Redis, Git' "
              f"WHEN 2 THEN 'Go, Kubernetes, Terraform, Linux' WHEN 3 THEN 'Java, Spring Boot, MySQL, Kafka' ELSE 'C++, Rust, SQL, Machine Learning' END")
    newer = f"CAST(2012 + {k} % 9 AS STRING)"
    older_start = f"CAST(2006 + {k} % 5 AS STRING)"
    older_end = f"CAST(CASE WHEN {k} % 3 = 0 THEN 2013 + {k} % 9 WHEN {k} % 4 = 0 THEN 2010 + {k} % 9 ELSE 2012 + {k} % 9 END AS STRING)"
    head = _join("Candidate Number ", _num(k), f"CASE WHEN {k} % 9 = 4 THEN '' ELSE {_join(GAP + 'candidate', _num(k), '@example.com | 555-')} || CAST(100 + {k} % 900 AS STRING) || '-' || CAST(1000 + {k} % 9000 AS STRING) "
                 f"|| CASE WHEN {k} % 6 = 5 THEN '' ELSE ' | Chicago, IL' END || ' | linkedin.com/in/cand' || {_num(k)} || ' | github.com/cand' || {_num(k)} END")
    summary = _join(GAP, "PROFESSIONAL SUMMARY", GAP, "Engineer with a record of shipping reliable systems.")
    exp = _join(GAP, "EXPERIENCE", GAP,
                f"CASE {k} % 3 WHEN 0 THEN 'Senior Engineer' WHEN 1 THEN 'Lead Developer' ELSE 'Software Engineer' END", " | Blue Rock | Mar ", newer, " - ",
                f"CASE WHEN {k} % 2 = 0 THEN 'Present' ELSE 'October 2022' END", GAP,
                f"CASE WHEN {k} % 2 = 0 THEN '• Responsible for building payment services using ' ELSE '• Built payment services using ' END",
                f"CASE {k} % 5 WHEN 0 THEN 'Redis and Python' WHEN 1 THEN 'Docker' WHEN 2 THEN 'PostgreSQL' WHEN 3 THEN 'Kubernetes' ELSE 'GraphQL' END", ".", GAP,
                "• Helped with designing the billing interface for ", _num(f"2 + {k} % 50"), " customers.", GAP,
                f"CASE {k} % 4 WHEN 0 THEN '• Worked on optimizing query latency by 35%.' WHEN 1 THEN '• Mentored three junior engineers.' "
                f"WHEN 2 THEN '• Reduced costs by $1,200 per month.' ELSE '• Improved build times.' END", GAP,
                f"CASE WHEN {k} % 10 = 7 THEN {_join('Built a cache layer' + chr(10) + '- Built a queue' + chr(10) + '- Built a scheduler' + chr(10) + '- Built a parser' + GAP)} ELSE '' END",
                f"CASE WHEN {k} % 8 = 6 THEN '' ELSE {_join('Developer - Green Field, Inc. | Jan ', older_start, ' to ', older_end, GAP + '• Maintained internal compliance reports and dashboards.' + GAP)} END")
    edu = f"CASE WHEN {k} % 7 = 2 THEN '' ELSE {_join('EDUCATION', GAP + 'State University of Technology', GAP)} || CASE WHEN {k} % 4 = 3 THEN 'Completed coursework' ELSE 'Bachelor of Science in Computer Science' END || ', 2008' || {_lit(GAP)} END"
    skl = f"CASE WHEN {k} % 11 = 8 THEN '' ELSE {_join('TECHNICAL SKILLS', GAP + 'Technologies: ')} || {skills} || {_lit(GAP)} END"
    cert = f"CASE WHEN {k} % 3 = 1 THEN {_join('CERTIFICATIONS' + GAP + '- Certified Cloud Practitioner' + chr(10) + '- Scrum Master')} ELSE 'End of resume text' END"
    return "(" + " || ".join([head, summary, exp, edu, skl, cert]) + ")"


RESUMES_SQL = f"SELECT CAST(c_custkey AS STRING) AS version_id, {resume_text('c_custkey')} AS text FROM customer"


def job_text(k: str = "k") -> str:
    """SQL expression for one job description with key ``k``."""
    return "(" + _join(
        "Role: Specialist ", _num(k), chr(10) + "About the role: we build data products." + chr(10) + "Requirements:" + chr(10) + "- ",
        _num(f"1 + {k} % 10"), "+ years of engineering experience." + chr(10) + "- Proficiency in ",
        f"CASE {k} % 4 WHEN 0 THEN 'Python and Redis' WHEN 1 THEN 'TypeScript and PostgreSQL' WHEN 2 THEN 'Kubernetes' ELSE 'Rust and Docker' END",
        "." + chr(10) + "* Bachelor of Science degree or equivalent." + chr(10) + "1. Ability to mentor and lead cross-functional teams." + chr(10) +
        "- Knowledge of compliance reports and security dashboards." + chr(10) + "Short line" + chr(10) + "Preferred:" + chr(10) + "- Experience with ",
        f"CASE {k} % 3 WHEN 0 THEN 'AWS or Azure' WHEN 1 THEN 'payment services design' ELSE 'machine learning' END",
        "." + chr(10) + "We are an equal opportunity employer." + chr(10)) + ")"


JOBS_SQL = f"SELECT CAST(p_partkey AS STRING) AS job_id, {job_text('p_partkey')} AS text FROM part"

REWRITES_SQL = f"""SELECT DISTINCT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS rewrite_id,
 'Responsible for building ' || CAST(2 + l_linenumber AS STRING) || ' services using ' || CASE l_orderkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE 'C++11' END
 || CASE WHEN l_orderkey % 4 = 0 THEN ' with a lead engineer' ELSE ' for three clients' END || '.' AS original,
 CASE WHEN l_orderkey % 5 = 0 THEN 'Led ' ELSE 'Built ' END || CAST(2 + l_linenumber AS STRING) || ' services using '
 || CASE l_orderkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE 'C++11' END
 || CASE (l_orderkey + l_linenumber) % 6 WHEN 1 THEN ' and cut latency by 45%' WHEN 2 THEN ' on Kubernetes' WHEN 3 THEN ' with a team of eight' WHEN 4 THEN ' for $12,500' ELSE '' END || '.' AS candidate
 FROM lineitem"""

# Positioned text: one "document" per part, three pages, items placed by line attributes.
TEXT_ITEMS_SQL = """SELECT CAST(l_partkey AS STRING) AS version_id, CAST(1 + l_orderkey % 3 AS INT) AS page_number,
 CAST(l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS BIGINT) AS item_no,
 CASE WHEN l_linenumber = 1 THEN 'Quarterly Report' WHEN l_linenumber = 7 THEN 'Page footer text'
      WHEN l_quantity > 45 THEN 'SECTION ' || CAST(l_linenumber AS STRING) || ' SCOPE' WHEN l_quantity < 4 THEN '- item ' || CAST(l_orderkey AS STRING)
      ELSE 'word' || CAST(l_orderkey AS STRING) || ' and ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS str,
 CAST(CASE WHEN l_linenumber = 1 THEN 40 WHEN (l_partkey % 2 = 0 AND l_linenumber % 2 = 0) THEN 330 + l_quantity ELSE 40 + l_quantity END AS DOUBLE) AS x,
 CAST(CASE WHEN l_linenumber = 1 THEN 760 WHEN l_linenumber = 7 THEN 20 ELSE 700 - 13 * (l_orderkey % 50) END AS DOUBLE) AS y,
 CAST(CASE WHEN l_partkey % 2 = 0 THEN 120 ELSE 320 END AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height,
 CAST(612 AS DOUBLE) AS page_width, CAST(792 AS DOUBLE) AS page_height FROM lineitem"""

# Word boxes: every line item is a word of a scanned page per supplier.
OCR_WORDS_SQL = """SELECT CAST(l_suppkey AS STRING) AS version_id, CAST(5 AS INT) AS level, CAST(1 + l_orderkey % 40 AS INT) AS page_num,
 CAST(1 + l_partkey % 9 AS INT) AS block_num, CAST(l_linenumber AS INT) AS line_num,
 CAST(l_orderkey * 10000 + l_linenumber * 1000 + l_partkey % 1000 AS BIGINT) AS word_num,
 CAST(20 + 10 * l_linenumber AS INT) AS "left", CAST(30 + 5 * (l_orderkey % 100) AS INT) AS top, CAST(l_quantity AS INT) AS width, CAST(11 AS INT) AS height,
 CAST(CASE WHEN l_returnflag = 'N' AND l_linenumber = 3 THEN -1 ELSE 60 + l_quantity * 0.7193 END AS DOUBLE) AS conf,
 CASE WHEN l_linenumber = 5 THEN '' ELSE 'tok' || CAST(l_orderkey % 1000 AS STRING) END AS text FROM lineitem"""


def build(tables, sql: str, *needs: str) -> DataFrame:
    """Run one corpus query over the named tables, without touching shared views."""
    frames = {n: tables.dealt(n) for n in needs}
    text = sql.replace('"left"', "`left`")
    for n in needs:
        text = text.replace(f" FROM {n}", f" FROM {{{n}}}")
    return tables.spark.sql(text, **frames)


def contracts(tables) -> DataFrame:
    return build(tables, CONTRACTS_SQL, "orders")


def revisions(tables) -> DataFrame:
    return build(tables, REVISIONS_SQL, "orders")


def resumes(tables) -> DataFrame:
    return build(tables, RESUMES_SQL, "customer")


def jobs(tables) -> DataFrame:
    return build(tables, JOBS_SQL, "part")


def rewrites(tables) -> DataFrame:
    return build(tables, REWRITES_SQL, "lineitem")


def text_items(tables) -> DataFrame:
    return build(tables, TEXT_ITEMS_SQL, "lineitem")


def ocr_words(tables) -> DataFrame:
    return build(tables, OCR_WORDS_SQL, "lineitem")


# --- labelled cases: boundary variants by index arithmetic, at any scale ----------------


def contract_case_text(k: str) -> str:
    """A mutual agreement that is clean, too long in term, or holds an indemnity, by ``k % 3``."""
    years = f"CASE WHEN {k} % 3 = 0 THEN 4 + {k} % 4 ELSE 2 END"
    indemnity = f"CASE WHEN {k} % 3 = 1 THEN {_join('SECTION 3. INDEMNITY' + GAP + 'The recipient shall defend and indemnify the owner against every claim.' + GAP)} ELSE '' END"
    return "(" + _join(
        "MUTUAL NON-DISCLOSURE AGREEMENT NO. ", _num(k), GAP + "Between Alpha House ", _num(k), " and Beta House ", _num(k), "." + GAP +
        "SECTION 1. CONFIDENTIAL INFORMATION" + GAP + "Each party agrees to keep confidential information secret. Excluded are public knowledge, "
        "independent development and disclosures under court order." + GAP + "SECTION 2. TERM" + GAP + "The confidentiality term shall be ", _num(years), " years." + GAP,
        indemnity, "SECTION 4. TERMINATION" + GAP + "Either side may leave on thirty (30) days notice.") + ")"


SPLIT_SQL = "CASE WHEN {k} % 30 < 20 THEN 'dev' ELSE 'held_out' END"

CONTRACT_CASES_SQL = f"""SELECT CAST(o_orderkey AS STRING) AS version_id, 'nda' AS playbook, {SPLIT_SQL.format(k='o_orderkey')} AS split, {contract_case_text('o_orderkey')} AS text,
 CASE o_orderkey % 3 WHEN 0 THEN 'RULE_NDA_DURATION_LIMIT' WHEN 1 THEN 'RULE_NDA_PROHIBITED_INDEMNITY' ELSE '' END AS expected FROM orders"""


def resume_case_text(k: str, year: int = 2024) -> str:
    """A profile with ``2 + k % 8`` years in one open role."""
    start = _num(f"{year} - (2 + {k} % 8)")
    return "(" + _join(
        "Candidate Variant ", _num(k), GAP + "variant", _num(k), "@example.com | 555-000-", _num(f"1000 + {k} % 9000"), " | Chicago, IL" + GAP + "PROFESSIONAL SUMMARY" + GAP +
        "Software professional in industry." + GAP + "EXPERIENCE" + GAP + "Software Engineer - Platform Alpha | Jan ", start, " - Present" + GAP +
        "• Responsible for developing services with TypeScript and PostgreSQL." + GAP + "EDUCATION" + GAP + "State University" + GAP +
        "Bachelor of Science in Computer Science | ", start, GAP + "TECHNICAL SKILLS" + GAP + "Technologies: TypeScript, JavaScript, PostgreSQL, Docker, Git") + ")"


_REQUIRED_YEARS = "CASE WHEN c_custkey % 2 = 0 THEN 1 + c_custkey % 8 ELSE 6 + c_custkey % 8 END"
RESUME_CASES_SQL = f"SELECT CAST(c_custkey AS STRING) AS version_id, {resume_case_text('c_custkey')} AS text FROM customer"
RESUME_CASE_JOBS_SQL = "SELECT CAST(c_custkey AS STRING) AS job_id, (" + _join(
    "Requirements:" + chr(10) + "- ", _num(_REQUIRED_YEARS), "+ years software engineering experience." + chr(10) + "- Proficiency with TypeScript and PostgreSQL.") + ") AS text FROM customer"
RESUME_LABELS_SQL = f"""SELECT CAST(c_custkey AS STRING) AS version_id, {SPLIT_SQL.format(k='c_custkey')} AS split, CAST(1 + c_custkey % 8 AS DOUBLE) AS min_years, CAST(4 + c_custkey % 8 AS DOUBLE) AS max_years,
 CAST({_REQUIRED_YEARS} AS STRING) || '+ years' AS snippet, CASE WHEN c_custkey % 2 = 0 THEN 'supported' ELSE 'unsupported' END AS status FROM customer"""
CASE_SKILLS = ("TypeScript", "PostgreSQL", "Docker", "Git")
