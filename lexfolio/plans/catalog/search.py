"""Tokens, chunks, index, BM25, dense, exact, fused and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexfolio import lexicons as lx
from lexfolio.functions.hashing import embed
from lexfolio.functions.text import search_tokens
from lexfolio.operators import layout, retrieval as r
from lexfolio.operators.stored_index import StoredIndex
from lexfolio.plans.catalog.corpus import CONTRACT_BLOCKS, DOC_LINES, contract_docs, doc_lines
from lexfolio.plans.catalog.sqlparts import pattern, tokens, words
from lexfolio.plans.registry import query
from lexfolio.session import materialize, scratch_path


def chunks_cte(blocks: str = "blocks", name: str = "chunks", typ: str = "block_type") -> str:
    """Recursive fold over the blocks of every document in lock step."""
    def keep(lo, hi):
        return (f"CAST({hi} - len(list_filter(list_slice(ends, greatest({lo}, {hi} - 100) + 1, {hi}), lambda p: ends[{hi} + 1] - p <= 100)) AS INTEGER)")
    return f"""
{name}_d AS (SELECT version_id, list({typ} ORDER BY block_index) AS types, list(text ORDER BY block_index) AS texts, list(start ORDER BY block_index) AS st,
  list("end" ORDER BY block_index) AS en, list(length(text) ORDER BY block_index) AS lens, CAST(count(*) AS INTEGER) AS n FROM {blocks} GROUP BY version_id),
{name}_e AS (SELECT version_id, types, texts, st, en, n, list_concat([0::BIGINT], list(s ORDER BY block_index)) AS ends FROM {name}_d JOIN
  (SELECT version_id, block_index, CAST(sum(length(text)) OVER (PARTITION BY version_id ORDER BY block_index) AS BIGINT) AS s FROM {blocks}) USING (version_id) GROUP BY ALL),
{name}_r AS (
  SELECT version_id, 0 AS i, 0 AS lo, '' AS heading, -1 AS alo, -1 AS ahi, '' AS ah, -1 AS blo, -1 AS bhi, '' AS bh FROM {name}_e
  UNION ALL
  SELECT version_id, i + 1, CASE WHEN ends[i + 2] - ends[lo1 + 1] >= 500 THEN {keep('lo1', '(i + 1)')} ELSE lo1 END,
    h, CASE WHEN fl THEN lo ELSE -1 END, i, ph, CASE WHEN ends[i + 2] - ends[lo1 + 1] >= 500 THEN lo1 ELSE -1 END, i + 1, h FROM (
    SELECT version_id, i, lo, fl, ends, heading AS ph, CASE WHEN fl THEN {keep('lo', 'i')} ELSE lo END AS lo1,
      CASE WHEN types[i + 1] = 'heading' THEN texts[i + 1] ELSE heading END AS h FROM (
      SELECT version_id, i, lo, heading, ends, types, texts, types[i + 1] = 'heading' AND lo < i AS fl FROM {name}_r JOIN {name}_e USING (version_id) WHERE i < n))),
{name}_o AS (SELECT version_id, i, 0 AS k, alo AS lo, ahi AS hi, ah AS heading FROM {name}_r WHERE alo >= 0
  UNION ALL SELECT version_id, i, 1, blo, bhi, bh FROM {name}_r WHERE blo >= 0
  UNION ALL SELECT version_id, i, 2, lo, n, heading FROM {name}_r JOIN {name}_e USING (version_id) WHERE i = n AND lo < n),
{name} AS (SELECT version_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY i, k) - 1 AS INTEGER) AS chunk_index, heading, lo, hi, st[lo + 1] AS start, en[hi] AS "end",
  'chunk-' || version_id || '-' || (row_number() OVER (PARTITION BY version_id ORDER BY i, k) - 1) AS chunk_id,
  substring(canonical_text, st[lo + 1] + 1, en[hi] - st[lo + 1]) AS text FROM {name}_o JOIN {name}_e USING (version_id) JOIN {blocks}_doc USING (version_id))"""


DOC_CHUNKS = f"{DOC_LINES}, {chunks_cte()}"
# Contract paragraphs that read like section headers become headings before chunking.
CONTRACT_CHUNKS = f"""{CONTRACT_BLOCKS}, {chunks_cte(typ="CASE WHEN block_type = 'paragraph' AND regexp_matches(text, '(?i)^(SECTION|ARTICLE|[0-9]+(\\.[0-9]+)*)\\s+') THEN 'heading' ELSE block_type END")}"""


def doc_chunks(t):
    return materialize(r.chunk_documents(doc_lines(t)), "chunks")


def contract_chunks(t):
    return r.chunk_documents(layout.retype_paragraphs(contract_docs(t)))


def passages(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERY_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE n_nationkey % 4 WHEN 0 THEN 'What does Section ' || CAST(1 + n_nationkey % 9 AS STRING) || ' say about "strict confidence"?'
 WHEN 1 THEN 'Payment within ' || CAST(15 * (1 + n_nationkey % 4) AS STRING) || ' days or $1,500,000 cap' WHEN 2 THEN 'renewal clause 5 and section 2.1 with USD 2 million by 2024-05-01'
 ELSE 'go rust (c++) docker, "gross negligence" 45 days' END AS query FROM nation"""


def term_queries(t):
    return t.spark.sql(QUERY_SQL.replace("FROM nation", "FROM {nation}"), nation=t.nation)


@query("r02_tokenize", f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.spread("documents").select("doc_id", F.array_join(search_tokens(F.col("text")), " ").alias("tokens"))


@query("r01_chunk_documents", f"""WITH RECURSIVE {DOC_CHUNKS} SELECT version_id, chunk_index, chunk_id, heading, start, "end", text, hi - lo AS blocks FROM chunks""")
def _(t):
    return r.chunk_documents(doc_lines(t)).select(
        "version_id", "chunk_index", "chunk_id", "heading", "start", "end", "text", F.size("block_ids").alias("blocks"))


@query("r01_chunk_headed", f"""WITH RECURSIVE {CONTRACT_CHUNKS} SELECT version_id, chunk_index, heading, start, "end", md5(text) AS text_md5, hi - lo AS blocks FROM chunks""")
def _(t):
    return contract_chunks(t).select(
        "version_id", "chunk_index", "heading", "start", "end", F.md5("text").alias("text_md5"), F.size("block_ids").alias("blocks"))


INDEX = f"""toks AS (SELECT version_id, chunk_id, {tokens("heading || ' ' || text")} AS t FROM chunks),
posts AS (SELECT version_id, chunk_id, len(t) AS n, unnest(t) AS term FROM toks),
postings AS (SELECT version_id, chunk_id, CAST(n AS INTEGER) AS len, term, CAST(count(*) AS INTEGER) AS tf FROM posts GROUP BY ALL),
stats AS (SELECT count(*) AS n_chunks, avg(len(t)) AS avg_len FROM toks)"""


def bm25_cte(queries: str, k: int, name: str = "bm25") -> str:
    return f"""
{name}_q AS (SELECT query_id, unnest({tokens('query')}) AS term FROM {queries}),
{name}_qt AS (SELECT query_id, term, count(*) AS qtf FROM {name}_q GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
{name}_s AS (SELECT query_id, chunk_id, sum(qtf * ln((n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) *
  (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)))) AS score
  FROM {name}_qt JOIN {name}_df USING (term) JOIN postings USING (term) CROSS JOIN stats GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank
  FROM {name}_s QUALIFY rank <= {k})"""


@query("r03_inverted_index", f"""WITH RECURSIVE {DOC_CHUNKS}, {INDEX}
 SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(min(len) AS INTEGER) AS min_len, CAST(max(len) AS INTEGER) AS max_len FROM postings GROUP BY term""")
def _(t):
    return r.postings(r.chunk_documents(doc_lines(t))).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("occurrences"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))


BENCH_Q = "(SELECT item_id AS query_id, text AS query FROM benchmark)"


BM25_SQL = f"WITH RECURSIVE {DOC_CHUNKS}, {INDEX}, {bm25_cte(BENCH_Q, 10)} SELECT * FROM bm25"


@query("r04_bm25_search", BM25_SQL)
def _(t):
    return r.corpus_bm25(r.chunk_documents(doc_lines(t)), passages(t), 10)


def stored_index(t, chunks) -> StoredIndex:
    """A new index that holds some chunks."""
    index = StoredIndex(t.spark, scratch_path(t.spark, "stored-index"))
    index.add(chunks)
    return index


@query("r04_bm25_pruned", BM25_SQL)
def _(t):
    return stored_index(t, r.chunk_documents(doc_lines(t))).bm25(passages(t), 10)


OWN_Q = "SELECT CAST(doc_id AS VARCHAR) AS version_id, CAST(doc_id // 3 AS BIGINT) AS query_id, regexp_extract(text, '^[^.]*') AS query FROM documents"
OWN_BM25 = f"""q AS (SELECT version_id, query_id, unnest({tokens("query")}) AS term FROM ({OWN_Q})),
qt AS (SELECT version_id, query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
vstats AS (SELECT version_id, count(*) AS n_chunks, avg(len(t)) AS avg_len FROM toks GROUP BY version_id),
df AS (SELECT version_id, term, count(*) AS df FROM postings GROUP BY ALL),
own AS (SELECT query_id, version_id, chunk_id, sum(qtf * ln((n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)))) AS score
  FROM qt JOIN df USING (version_id, term) JOIN postings USING (version_id, term) JOIN vstats USING (version_id) GROUP BY ALL)"""


def own_queries(t):
    """The first sentence of every document, asked of that document alone."""
    return t.documents.select(F.col("doc_id").cast("string").alias("version_id"), F.expr("doc_id div 3").alias("query_id"), F.regexp_extract("text", r"^[^.]*", 0).alias("query"))


@query("r04_bm25_per_version", f"""WITH RECURSIVE {DOC_CHUNKS}, {INDEX}, {OWN_BM25}
SELECT query_id, version_id, chunk_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id, version_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM own QUALIFY rank <= 3""")
def _(t):
    chunks, own = doc_chunks(t), own_queries(t)
    scope = ("version_id",)
    index = materialize(r.postings(chunks, scope), "postings")
    return r.bm25_search(index, r.chunk_stats(chunks, index, scope), own, 3, scope)


# The embedding twin hashes each distinct word once with list folds over its characters.
HASH = """(CASE WHEN {h} >= 2147483648 THEN 4294967296 - {h} ELSE {h} END) % 384"""


def embed_cte(src: str, name: str) -> str:
    def h(seed, expr):
        return f"list_reduce(list_transform(string_split({expr}, ''), lambda c: unicode(c)::BIGINT), lambda a, c: (31 * a + c) % 4294967296, {seed}::BIGINT)"
    return f"""
{name}_w AS (SELECT id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM (SELECT id, regexp_split_to_array(trim(lower(text), ' ' || chr(10)), '\\s+') AS ws FROM {src} WHERE trim(text, ' ' || chr(10)) <> '')),
{name}_d AS (SELECT w, {h(lx.EMBED_SEED_WORD, 'w')} AS h1, {h(lx.EMBED_SEED_WORD_2, 'w')} AS h2, CASE WHEN {h(lx.EMBED_SEED_SIGN, 'w')} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM (SELECT DISTINCT w FROM {name}_w)),
{name}_g AS (SELECT w, {h(lx.EMBED_SEED_GRAM, 'g')} AS h FROM (SELECT w, unnest(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))) AS g FROM {name}_d WHERE length(w) >= 3)),
{name}_b AS (SELECT id, w || '_' || n AS pair FROM (SELECT id, w, lead(w) OVER (PARTITION BY id ORDER BY p) AS n FROM {name}_w) WHERE n IS NOT NULL),
{name}_bd AS (SELECT pair, {h(lx.EMBED_SEED_PAIR, 'pair')} AS h FROM (SELECT DISTINCT pair FROM {name}_b)),
{name}_f AS (SELECT id, {HASH.format(h='h1')} AS bucket, s AS x FROM {name}_w JOIN {name}_d USING (w)
  UNION ALL SELECT id, {HASH.format(h='h2')}, 0.5::DOUBLE * s FROM {name}_w JOIN {name}_d USING (w)
  UNION ALL SELECT id, {HASH.format(h='h')}, 0.3::DOUBLE FROM {name}_w JOIN {name}_g USING (w)
  UNION ALL SELECT id, {HASH.format(h='h')}, 0.7::DOUBLE FROM {name}_b JOIN {name}_bd USING (pair)),
{name}_v AS (SELECT id, bucket, sum(x) AS x FROM {name}_f GROUP BY ALL),
{name} AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {name}_v)"""


@query("r05_feature_embedding", f"""WITH {embed_cte("(SELECT doc_id AS id, text FROM documents)", "emb")}
 SELECT id AS doc_id, CAST(bucket AS INTEGER) AS bucket, round(x, 5) AS weight FROM emb WHERE abs(x) > 0.000001""")
def _(t):
    vec = t.spread("documents").select("doc_id", embed(F.col("text")).alias("v"))
    return vec.select("doc_id", F.posexplode_outer("v").alias("bucket", "w")).filter(F.abs("w") > 0.000001).select(
        "doc_id", "bucket", F.round("w", 5).alias("weight"))


@query("r06_cosine_similarity", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return r.pairwise_cosine(a.join(b, "vec_id")).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("r07_dense_top_k", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q CROSS JOIN embeddings e)
 SELECT query_id, chunk_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def _(t):
    items = t.spread("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return r.dense_top_k(items, items.select(F.col("chunk_id").alias("query_id"), "vector"), 10)


def terms_cte(source: str) -> str:
    return f"""qs AS ({source}),
raw_terms AS ({' UNION ALL '.join(f"SELECT query_id, {i} AS c, generate_subscripts(m, 1) AS j, unnest(m) AS term, '{kind}' AS term_type FROM (SELECT query_id, regexp_extract_all(query, {pattern(p)}) AS m FROM qs)" for i, (kind, p) in enumerate(lx.TERM_PATTERNS))}
  UNION ALL SELECT query_id, 4, generate_subscripts(m, 1), unnest(m), 'named_skill' FROM (SELECT query_id, list_filter(list_transform(regexp_split_to_array(lower(query), '\\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9_.\\-/]', '', 'g')), lambda w: list_contains({words(lx.QUERY_SKILLS)}, w)) AS m FROM qs)
  UNION ALL SELECT query_id, 5, 1, m, 'verbatim' FROM (SELECT query_id, regexp_extract(query, '"([^"]+)"', 1) AS m FROM qs) WHERE m <> ''),
terms AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c, j) - 1 AS INTEGER) AS pos, lower(term) AS term, term_type FROM raw_terms)"""


TERMS = terms_cte(QUERY_SQL)


@query("r08_query_terms", f"WITH {TERMS} SELECT query_id, pos, term, term_type FROM terms")
def _(t):
    return r.extract_terms(term_queries(t))


def exact_cte(k: int, name: str = "exact") -> str:
    return f"""{name}_h AS (SELECT query_id, chunk_id, pos, term, term_type, CASE term_type WHEN 'verbatim' THEN 3.0::DOUBLE WHEN 'clause_number' THEN 2.5::DOUBLE WHEN 'amount' THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS pts
  FROM (SELECT chunk_id, lower(heading || ' ' || text) AS low FROM chunks) JOIN terms ON contains(low, term)),
{name} AS (SELECT query_id, chunk_id, arg_max(term, pos) AS matched_term, arg_max(term_type, pos) AS term_type, round(sum(pts), 2) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY sum(pts) DESC, chunk_id) AS INTEGER) AS rank FROM {name}_h GROUP BY query_id, chunk_id QUALIFY rank <= {k})"""


@query("r09_exact_search", f"WITH RECURSIVE {CONTRACT_CHUNKS}, {TERMS}, {exact_cte(10)} SELECT * FROM exact")
def _(t):
    return r.exact_search(contract_chunks(t), r.extract_terms(term_queries(t)), 10)


@query("r10_rank_fusion", f"""WITH RECURSIVE {CONTRACT_CHUNKS}, {TERMS}, {INDEX}, {bm25_cte('qs', 20)}, {exact_cte(20)}
SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.5::DOUBLE / (60 + e.rank), 0), 6) AS rrf_score, b.rank AS bm25_rank, e.rank AS exact_rank
FROM bm25 b FULL JOIN exact e USING (query_id, chunk_id)""")
def _(t):
    chunks = materialize(contract_chunks(t), "chunks")
    q = term_queries(t)
    return r.fuse_rankings({
        "bm25": r.corpus_bm25(chunks, q, 20),
        "exact": r.exact_search(chunks, r.extract_terms(q), 20),
    })


HYBRID_SQL = f"""WITH RECURSIVE {DOC_CHUNKS}, {INDEX}, {terms_cte(BENCH_Q[1:-1])}, {bm25_cte('qs', 20)}, {exact_cte(20)},
{embed_cte("(SELECT chunk_id AS id, heading || ' ' || text AS text FROM chunks)", "ce")}, {embed_cte("(SELECT item_id AS id, text FROM benchmark)", "qe")},
dense AS (SELECT qe.id AS query_id, ce.id AS chunk_id, CAST(row_number() OVER (PARTITION BY qe.id ORDER BY round(sum(qe.x * ce.x), 9) DESC, ce.id) AS INTEGER) AS rank
  FROM qe JOIN ce USING (bucket) GROUP BY qe.id, ce.id QUALIFY rank <= 20),
fused AS (SELECT query_id, chunk_id, sum(w / (60 + rank)) AS score, max(CASE WHEN c = 'b' THEN rank END) AS bm25_rank, max(CASE WHEN c = 'd' THEN rank END) AS dense_rank, max(CASE WHEN c = 'e' THEN rank END) AS exact_rank
  FROM (SELECT query_id, chunk_id, rank, 1.0::DOUBLE AS w, 'b' AS c FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 1.0, 'd' FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1.5, 'e' FROM exact) GROUP BY ALL)
SELECT chunk_id, query_id, round(score, 6) AS rrf_score, bm25_rank, dense_rank, exact_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank, heading, text
FROM fused JOIN chunks USING (chunk_id) QUALIFY rank <= 10"""


@query("r11_hybrid_search", HYBRID_SQL)
def _(t):
    return r.hybrid_search(doc_chunks(t), passages(t), 10)


@query("r11_hybrid_stored", HYBRID_SQL)
def _(t):
    return stored_index(t, r.chunk_documents(doc_lines(t))).hybrid(passages(t), 10)


# Each document answers for itself: other fusion constants than the corpus search, 2k = 6 hits a channel.
@query("r11_hybrid_per_version", f"""WITH RECURSIVE {DOC_CHUNKS}, {INDEX}, {OWN_BM25}, ownq AS ({OWN_Q}),
{terms_cte("SELECT version_id || '/' || query_id AS query_id, query FROM ownq")},
{embed_cte("(SELECT chunk_id AS id, heading || ' ' || text AS text FROM chunks)", "ce")}, {embed_cte("(SELECT version_id AS id, query AS text FROM ownq)", "qe")},
bm AS (SELECT query_id, version_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, version_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM own QUALIFY rank <= 6),
dots AS (SELECT qe.id AS version_id, ce.id AS chunk_id, sum(qe.x * ce.x) AS s FROM chunks JOIN ce ON ce.id = chunk_id JOIN qe ON qe.id = version_id AND qe.bucket = ce.bucket GROUP BY ALL),
de AS (SELECT ownq.query_id, version_id, chunk_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY round(coalesce(s, 0), 9) DESC, chunk_id) AS INTEGER) AS rank FROM chunks JOIN ownq USING (version_id) LEFT JOIN dots USING (version_id, chunk_id) QUALIFY rank <= 6),
exh AS (SELECT c.version_id, c.chunk_id, CASE term_type WHEN 'verbatim' THEN 3.0::DOUBLE WHEN 'clause_number' THEN 2.5::DOUBLE WHEN 'amount' THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS pts
  FROM terms JOIN chunks c ON c.version_id = split_part(query_id, '/', 1) AND contains(lower(c.heading || ' ' || c.text), term)),
ex AS (SELECT query_id, version_id, chunk_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY sum(pts) DESC, chunk_id) AS INTEGER) AS rank FROM exh JOIN ownq USING (version_id) GROUP BY query_id, version_id, chunk_id QUALIFY rank <= 6),
fused AS (SELECT query_id, version_id, chunk_id, sum(w / (30 + rank)) AS score, max(CASE WHEN c = 'b' THEN rank END) AS bm25_rank, max(CASE WHEN c = 'd' THEN rank END) AS dense_rank, max(CASE WHEN c = 'e' THEN rank END) AS exact_rank
  FROM (SELECT query_id, version_id, chunk_id, rank, 2.0::DOUBLE AS w, 'b' AS c FROM bm UNION ALL SELECT query_id, version_id, chunk_id, rank, 1.0, 'd' FROM de UNION ALL SELECT query_id, version_id, chunk_id, rank, 0.5, 'e' FROM ex) GROUP BY ALL)
SELECT version_id, chunk_id, query_id, round(score, 6) AS rrf_score, bm25_rank, dense_rank, exact_rank, CAST(row_number() OVER (PARTITION BY query_id, version_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank, heading, text
FROM fused JOIN chunks USING (version_id, chunk_id) QUALIFY rank <= 3""")
def _(t):
    index = stored_index(t, r.chunk_documents(doc_lines(t)))
    return index.hybrid(own_queries(t), 3, scoped=True, rrf_k=30, weights={"bm25": 2.0, "dense": 1.0, "exact": 0.5})


@query("r12_incremental_index", f"""WITH RECURSIVE {DOC_CHUNKS}, {INDEX} SELECT version_id, CAST(count(*) AS BIGINT) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY version_id""")
def _(t):
    chunks = doc_chunks(t)
    path = scratch_path(t.spark, "index")
    english = t.documents.filter(F.col("lang") == "en").select(F.col("doc_id").cast("string").alias("version_id"))
    r.write_index(chunks.join(english, "version_id", "left_semi"), path)
    r.write_index(chunks, path)
    return t.spark.read.parquet(path).groupBy("version_id").agg(
        F.count("*").alias("postings"), F.sum("tf").cast("bigint").alias("occurrences"))


# English documents first, then the rest; French ones are evicted, and of these every other one comes back.
@query("r12_index_lifecycle", f"""WITH RECURSIVE {DOC_CHUNKS}, {INDEX},
live AS (SELECT CAST(doc_id AS VARCHAR) AS version_id FROM documents WHERE lang IS DISTINCT FROM 'fr' OR doc_id % 2 = 0),
p AS (SELECT version_id, term, count(*) AS n, sum(tf) AS tf FROM postings GROUP BY ALL)
SELECT term, CAST(sum(n) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(count(*) AS BIGINT) AS versions FROM p JOIN live USING (version_id) GROUP BY term""")
def _(t):
    chunks, ids = doc_chunks(t), F.col("doc_id").cast("string").alias("version_id")
    english, french = (t.documents.filter(F.col("lang") == x) for x in ("en", "fr"))
    index = stored_index(t, chunks.join(english.select(ids), "version_id", "left_semi"))
    index.add(chunks)
    index.evict(french.select(ids))
    index.add(chunks.join(french.filter("doc_id % 2 = 0").select(ids), "version_id", "left_semi"))
    of_version = index.chunks().select("version_id", "chunk_id", F.explode("terms").alias("term", "tf"))
    posted = index.blocks().select("term", F.explode("postings").alias("p")).select("term", "p.chunk_id", "p.tf")
    return posted.join(of_version.drop("tf"), ["term", "chunk_id"]).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("occurrences"), F.countDistinct("version_id").alias("versions"))
