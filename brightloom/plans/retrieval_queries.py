"""Lexical and vector retrieval, fusion, reranking, caching and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.functions.query import vector_gate as gate
from brightloom.operators import context, dense, fusion, lexical, scoped, search
from brightloom.operators.held import hold, small
from brightloom.operators.summary import quantile
from brightloom.plans.harness import chunk_index, chunks, documents, stored_vectors, table
from brightloom.plans.registry import Fixture, boundary_cut, query

SECTIONS = Fixture("query_id long, section string", (1, "3"), (1, "57(2)"), (2, "318(4)(a)"), (3, "4"))
#: A section brought to its number; a chunk is hit by its section or its subsection, whatever the case.
HITS = f"(SELECT query_id, section, regexp_extract(section, '^[0-9]+[A-Za-z]?') AS number FROM {SECTIONS.sql()}) q JOIN c ON c.section_ref ILIKE q.number || '%' OR c.subsection_ref ILIKE q.number || '%'"
LEXICAL = Fixture("query_id long, query string", (1, "idiot of that"), (2, "stupid clown"), (3, "les des pour"), (4, "worthless moron the"), (5, "nothingmatches"))
TERMS = f"q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\pL\\pN_]+'))) AS lexeme FROM {LEXICAL.sql()})"
BM25_SCORES = """p AS (SELECT chunk_id, len(words) AS dl, unnest(words) AS lexeme FROM w),
tf AS (SELECT lexeme, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM p WHERE lexeme IN (SELECT lexeme FROM q) GROUP BY 1, 2),
df AS (SELECT lexeme, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
s AS (SELECT query_id, chunk_id, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY lexeme)) AS score
      FROM tf JOIN df USING (lexeme) JOIN q USING (lexeme), st GROUP BY 1, 2)"""
BM25 = f"""{TERMS},
{BM25_SCORES},
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""
VECTORS = """cen AS (SELECT CAST(label AS BIGINT) AS query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, LATERAL unnest(range(1, len(embedding) + 1)) t(i) GROUP BY 1, 2),
vq AS (SELECT query_id, list(x ORDER BY i) AS q FROM cen GROUP BY 1),
vs AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, vq)"""

HEADER = """concat('<CHUNK:', left(chunk_id, 8), '> [', concat_ws(' | ', citation, CASE WHEN section_ref IS NOT NULL THEN '§' || coalesce(subsection_ref, section_ref) END,
  CASE law WHEN 'BNS' THEN 'BNS 2023' WHEN 'BNSS' THEN 'BNSS 2023' WHEN 'BSA' THEN 'BSA 2023' WHEN 'IPC' THEN 'IPC 1860' WHEN 'CrPC' THEN 'CrPC 1973' WHEN 'Constitution' THEN 'Constitution of India' END,
  court, CAST(year AS VARCHAR), 'p.' || CAST(page_number AS VARCHAR), '[' || upper(chunk_type) || ']'), ']')"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector for each label: the mean of its vectors."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


@query(f"""SELECT query_id, section, CAST(rank AS INTEGER) AS rank, chunk_id FROM (
SELECT query_id, section, chunk_id, row_number() OVER (PARTITION BY query_id, section ORDER BY chunk_index, chunk_id) AS rank FROM {HITS}) WHERE rank <= 10""")
def exact_section_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.exact_sections(chunk_index(spark, sf_dir).keys, SECTIONS.frame(spark)).select("query_id", "section", "rank", "chunk_id")


def _fts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    made = chunk_index(spark, sf_dir)
    found = lexical.websearch(made, spark.createDataFrame([(1, text)], "query_id long, query string"))
    return made.chunks.select("chunk_id", "document_id").join(small(hold(found.select("chunk_id"), "found")), "chunk_id")


@query("SELECT chunk_id, document_id FROM w WHERE list_contains(words, 'idiot') AND list_contains(words, 'that')")
def fts_boolean_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts(spark, sf_dir, "idiot that")


@query("SELECT chunk_id, document_id FROM w WHERE list_contains(words, 'idiot') OR list_contains(words, 'moron')")
def fts_boolean_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts(spark, sf_dir, "idiot OR moron")


@query("SELECT chunk_id, document_id FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' of the ')")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts(spark, sf_dir, '"of the"')


@query("SELECT chunk_id, document_id FROM w WHERE list_contains(words, 'idiot') AND NOT list_contains(words, 'moron')")
def fts_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts(spark, sf_dir, "idiot -moron")


@query("SELECT lexeme, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT lexeme, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(words) AS lexeme FROM w) GROUP BY 1, 2) GROUP BY 1")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_index(spark, sf_dir).places(F.lit(True)).groupBy("lexeme").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"{{WITH}}, {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(chunk_index(spark, sf_dir), LEXICAL.frame(spark)).withColumn("score", F.round("score", 6))


@query("""{WITH}, p AS (SELECT chunk_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
one AS (SELECT chunk_id, sum(0.1) AS r FROM p WHERE word = 'moron' GROUP BY 1),
two AS (SELECT chunk_id, sum(0.1 / greatest(1, place - before)) AS r FROM (SELECT *, lag(place) OVER o AS before, lag(word) OVER o AS other FROM p WHERE word IN ('idiot', 'that') WINDOW o AS (PARTITION BY chunk_id ORDER BY place)) WHERE other <> word GROUP BY 1)
SELECT chunk_id, round(max(r / (r + 1)), 9) AS rank FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1""")
def cover_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.websearch(chunk_index(spark, sf_dir), spark.createDataFrame([(1, "idiot that OR moron")], "query_id long, query string"))
    return found.select("chunk_id", F.round("rank", 9).alias("rank"))


def _ranked(where: str, k: int) -> str:
    return f"{{WITH}}, {VECTORS}, r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE {where}) SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"


@query(_ranked("true", 30))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.coded_search(*stored_vectors(spark, sf_dir), centroids(spark, sf_dir), threshold=-1.0).withColumn("score", F.round("score", 6))


@query(_ranked("label IN (1, 3, 5)", 30))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.coded_search(*stored_vectors(spark, sf_dir), centroids(spark, sf_dir), threshold=-1.0, keep=F.col("label").isin(1, 3, 5)).withColumn("score", F.round("score", 6))


@query(_ranked("score >= 0.25", 10**9))
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.vector_search(vectors(spark, sf_dir), centroids(spark, sf_dir), k=None, threshold=0.25).withColumn("score", F.round("score", 6))


@query("""WITH g AS (SELECT conv_id, turn, text, conv_id % 5 AS exact, (conv_id + turn) % 12 AS lexical, CASE conv_id % 3 WHEN 0 THEN 'section 318 ' || text WHEN 1 THEN text ELSE left(text, 20) END AS query FROM conversations)
SELECT conv_id, turn, md5(text) AS said, CASE WHEN exact >= 3 THEN false WHEN lexical - exact < 3 THEN true
WHEN regexp_matches(query, '(?i)\\b(section|sec\\.?|s\\.)\\s*\\d+') AND exact > 0 THEN false WHEN len(regexp_extract_all(query, '[\\pL\\pN_]+')) < 6 THEN false ELSE true END AS use_vector FROM g""")
def vector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything said in the conversations as a query."""
    text = F.col("text")
    query = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("section 318 "), text)).when(F.col("conv_id") % 3 == 1, text).otherwise(F.substring(text, 1, 20))
    found = gate(F.col("conv_id") % 5, (F.col("conv_id") + F.col("turn")) % 12, query)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("said"), found.alias("use_vector"))


@query("""WITH r AS (SELECT label AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS first, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS last FROM embeddings),
s AS (SELECT query_id, chunk_id, round(CASE WHEN first <= 50 THEN 0.55 / (60 + first) ELSE 0 END + CASE WHEN last <= 30 THEN 0.45 / (60 + last) ELSE 0 END, 9) AS score FROM r WHERE first <= 50 OR last <= 30)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 60""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists of every label's vectors: the first 50 and the last 30."""
    rows = vectors(spark, sf_dir).select(F.col("label").alias("query_id"), "chunk_id", F.col("chunk_id").cast("long").alias("i"))
    ranked = lambda order, k: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).where(F.col("rank") <= k)
    return fusion.rrf([(ranked(F.col("i"), 50), 0.55), (ranked(F.desc("i"), 30), 0.45)])


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact hits, BM25 hits and their documents' vector neighbours, each a ranked list for a query id."""
    exact = lexical.exact_sections(chunk_index(spark, sf_dir).keys, SECTIONS.frame(spark)).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    ranked = lexical.bm25(chunk_index(spark, sf_dir), LEXICAL.frame(spark))
    near = dense.coded_search(*stored_vectors(spark, sf_dir), centroids(spark, sf_dir), threshold=0.25)
    return exact, ranked, near


TIERS = f"""ex AS (SELECT query_id, chunk_id, min(rank) AS rank, 1.0 AS score FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id, section ORDER BY chunk_index, chunk_id) AS rank
  FROM {HITS}) WHERE rank <= 10 GROUP BY 1, 2),
lx AS (SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 50),
vn AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE score >= 0.25) WHERE rank <= 30)"""
FUSED = """fu AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score FROM (SELECT query_id, chunk_id, 2.0 / (60 + rank) AS s FROM ex UNION ALL SELECT query_id, chunk_id, 0.55 / (60 + rank) FROM lx UNION ALL SELECT query_id, chunk_id, 0.45 / (60 + rank) FROM vn) GROUP BY 1, 2),
fr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu)"""


@query(f"{{WITH}}, {BM25}, {VECTORS}, {TIERS}, {FUSED} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 60")
def hybrid_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, lexical and vector lists of a batch of queries fused by weight."""
    exact, ranked, near = _tiers(spark, sf_dir)
    return fusion.rrf([(exact, 2.0), (ranked, 0.55), (near, 0.45)])


@query(f"""{{WITH}}, {BM25}, {VECTORS}, {TIERS}, kf AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, tier_rank) AS n FROM (SELECT query_id, chunk_id, score, rank AS tier_rank, 0 AS tier FROM ex UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM lx))
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(tier AS INTEGER) AS tier, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier, tier_rank, chunk_id) AS rank FROM kf WHERE n = 1) WHERE rank <= 50""")
def tier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact, ranked, _ = _tiers(spark, sf_dir)
    return fusion.cut_merged(fusion.keep_first([exact, ranked]), 50).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "tier", "rank")


@query(f"""{{WITH}}, {BM25} SELECT query_id, chunk_id, CASE WHEN hi = lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 6) END AS score FROM (SELECT query_id, chunk_id, score, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm WHERE rank <= 50)""")
def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.min_max(lexical.bm25(chunk_index(spark, sf_dir), LEXICAL.frame(spark)))
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


RERANK = """cand AS (SELECT fr.query_id, chunk_id, score, rank, ex.chunk_id IS NOT NULL AS exact, content_length % 7 - 3 AS raw FROM fr LEFT JOIN (SELECT query_id, chunk_id FROM ex) ex USING (query_id, chunk_id) JOIN c USING (chunk_id) WHERE rank <= 60),
nm AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM cand)"""
LEFT = "LEFT JOIN (SELECT query_id, chunk_id, true AS hit FROM ex) ex USING (query_id, chunk_id)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact, ranked, near = _tiers(spark, sf_dir)
    exact = hold(exact, "exact")
    fused = fusion.rrf([(exact, 2.0), (ranked, 0.55), (near, 0.45)])
    rows = fused.join(exact.select("query_id", "chunk_id", F.lit(True).alias("exact")), ["query_id", "chunk_id"], "left").na.fill(False, ["exact"])
    # A fixed formula stands in for the pair model.
    # Of each query at most 60 are left: they go to the chunks, which stay where they are.
    return chunks(spark, sf_dir).select("chunk_id", "content", "chunk_type", "section_ref", "document_id", (F.col("content_length") % 7 - 3).alias("raw")).join(small(hold(rows, "fused")), "chunk_id")


def _reranked(final: str) -> str:
    return f"""{{WITH}}, {BM25}, {VECTORS}, {TIERS}, {FUSED}, {RERANK.replace("ex.chunk_id IS NOT NULL", "coalesce(ex.hit, false)").replace("LEFT JOIN (SELECT query_id, chunk_id FROM ex) ex USING (query_id, chunk_id)", LEFT)},
fs AS (SELECT query_id, chunk_id, score, rank, exact, CASE WHEN exact THEN 1.0 ELSE {final} END AS final_score FROM nm)
SELECT query_id, chunk_id, score, final_score, CAST(final_rank AS INTEGER) AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, CASE WHEN exact THEN rank END, final_score DESC, rank, chunk_id) AS final_rank FROM fs) WHERE final_rank <= 6"""


@query(_reranked("round(0.7 / (1 + exp(-raw)) + 0.3 * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6)"))
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(_candidates(spark, sf_dir))


@query(_reranked("score"))
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(_candidates(spark, sf_dir), raw=None)


@query(f"""{{WITH}}, {BM25}, m AS (SELECT query_id // 3 AS q, query_id % 3 AS sub_query, chunk_id, score, rank FROM bm WHERE rank <= 50),
n AS (SELECT q, count(DISTINCT sub_query) AS lists FROM m GROUP BY 1), f AS (SELECT q, chunk_id, sum(1.0 / (60 + rank)) AS rrf, any_value(score) AS own, min(sub_query) AS first FROM m GROUP BY 1, 2),
sq AS (SELECT q AS query_id, chunk_id, round(CASE WHEN lists = 1 THEN own ELSE rrf END, 9) AS score, concat('sub', CAST(first AS VARCHAR)) AS source FROM f JOIN n USING (q))
SELECT query_id, chunk_id, score, source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sq) WHERE rank <= 40""")
def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.bm25(chunk_index(spark, sf_dir), LEXICAL.frame(spark)).withColumn("sub_query", F.col("query_id") % 3).withColumn("query_id", F.floor(F.col("query_id") / 3))
    return fusion.multi_query(rows.withColumn("source", F.concat(F.lit("sub"), F.col("sub_query").cast("string"))))


SCOPED = Fixture("query_id long, document_id string, query string", (1, "28", "what is the idiot"), (2, "7", "summarize theast unknownword"), (3, "9", "zzzzz qqqqq"), (4, "1", "the of"))


@query(f"""{{WITH}}, q AS (SELECT query_id, document_id, CASE WHEN starts_with(query, 'what is ') THEN substr(query, 9) WHEN starts_with(query, 'summarize ') THEN substr(query, 11) ELSE query END AS clean FROM {SCOPED.sql()}),
r AS (SELECT query_id, w.*, list_distinct(regexp_extract_all(clean, '[\\pL\\pN_]+')) AS ws, list_slice(list_filter(string_split(clean, ' '), lambda x: length(x) > 4), 1, 4) AS ks FROM q JOIN w USING (document_id)),
st AS (SELECT query_id, chunk_id, 0 AS stage, round(o / (o + len(words)), 6) AS score, round(o / (o + len(words)), 6) AS b FROM (SELECT *, CAST(len(list_filter(words, lambda x: list_contains(ws, x))) AS DOUBLE) AS o FROM r) WHERE list_has_all(words, ws)
  UNION ALL SELECT query_id, chunk_id, 1, 0.5, -chunk_index FROM r WHERE len(list_filter(ks, lambda k: contains(lower(content), k))) > 0
  UNION ALL SELECT query_id, chunk_id, 2, 1.0, -chunk_index FROM r WHERE content_length > 150)
SELECT query_id, CAST(stage AS INTEGER) AS stage, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, chunk_id) AS rank FROM st JOIN (SELECT query_id, min(stage) AS stage FROM st GROUP BY 1) m USING (query_id, stage)) WHERE rank <= 15""")
def doc_scoped_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped.in_document(chunks(spark, sf_dir), SCOPED.frame(spark))


@query("""SELECT CAST(query_id AS VARCHAR) AS query_id, chunk_id FROM (SELECT document_id AS query_id, chunk_id, row_number() OVER (PARTITION BY document_id, md5(lower(trim(regexp_replace(left(content, 200), '\\s+', ' ', 'g')))) ORDER BY chunk_index, chunk_id) AS n FROM c) WHERE n = 1""")
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select(F.col("document_id").alias("query_id"), F.col("chunk_index").alias("rank"), "chunk_id", "content")
    return context.deduplicate(rows).select("query_id", "chunk_id")


@query(f"""{{WITH}}, k AS (SELECT document_id, chunk_id, content, chunk_type, chunk_index, {HEADER} AS header FROM c JOIN d USING (document_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_type NOT IN ('section', 'final_order', 'subsection'), chunk_index, chunk_id) AS i FROM k),
n AS MATERIALIZED (SELECT document_id, i, header, content FROM o WHERE i <= 30)
SELECT document_id AS query_id, md5(context) AS context, CAST(blocks AS INTEGER) AS blocks FROM (WITH RECURSIVE r AS (
  SELECT document_id, 0 AS i, 0 AS used, '' AS context, 0 AS blocks FROM n WHERE i = 1
  UNION ALL SELECT document_id, i, used + length(block) + 2, CASE WHEN i = 1 THEN block ELSE context || chr(10) || chr(10) || block END, blocks + 1 FROM (
    SELECT r.document_id, n.i, r.used, r.context, r.blocks, n.header || chr(10) || {boundary_cut("n.content", "(1920 - r.used - length(n.header) - 3)")} AS block
    FROM r JOIN n ON n.document_id = r.document_id AND n.i = r.i + 1 WHERE 1920 - r.used - length(n.header) - 3 > 80))
  SELECT * FROM r) WHERE true QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY blocks DESC) = 1""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chunks packed into 1920 characters; all blocks that fit are packed, while the SQL stops at 30."""
    none = F.lit(None).cast("string")
    c, d = chunks(spark, sf_dir), documents(spark, sf_dir)
    rows = c.join(d.withColumns({"case_number": none, "court_name": none}), "document_id")
    rows = rows.select(F.col("document_id").alias("query_id"), "chunk_id", "content", "chunk_type", F.col("chunk_index").alias("rank"), (1 / (1 + F.col("chunk_index"))).alias("final_score"), context.header().alias("header"))
    return context.pack(rows, max_tokens=600).withColumn("context", F.md5("context"))


CACHE = """cq AS (SELECT vec_id AS query_id, embedding, CASE WHEN label % 2 = 0 THEN ['BNS', 'IPC'] ELSE [] END AS laws FROM embeddings),
ce AS (SELECT CAST(vec_id AS VARCHAR) AS key, embedding AS e, vec_id AS cached, CASE WHEN label % 2 = 0 THEN ['BNS', 'IPC'] ELSE [] END AS laws FROM embeddings ORDER BY vec_id DESC LIMIT 200)"""


@query(f"""{{WITH}}, {CACHE} SELECT query_id, key, similarity FROM (SELECT query_id, key, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY cached DESC) AS n
FROM cq JOIN ce USING (laws) WHERE round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) >= 0.94) WHERE n = 1""")
def semantic_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    even = F.col("label") % 2 == 0
    asked = e.select(F.col("vec_id").alias("query_id"), "embedding", F.when(even, F.array(F.lit("IPC"), F.lit("BNS"))).otherwise(F.array().cast("array<string>")).alias("law_filter"))
    cache = e.select(F.col("vec_id").cast("string").alias("key"), "embedding", F.when(even, F.array(F.lit("BNS"), F.lit("IPC"))).otherwise(F.array().cast("array<string>")).alias("law_filter"), F.lit("").alias("result"), F.timestamp_seconds("vec_id").alias("cached_at"))
    return dense.cache_probe(asked, cache).select("query_id", "key", "similarity")


@query("SELECT CAST(vec_id AS VARCHAR) AS key FROM embeddings ORDER BY vec_id DESC LIMIT 400")
def cache_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.timestamp_seconds("vec_id").alias("cached_at"))
    return dense.cache_store(e.where("cast(key as long) % 2 = 0"), e.where("cast(key as long) % 2 = 1")).select("key")


GOLDEN = Fixture("query_id long, expected_sections array<string>, expected_intent string, min_confidence double", (1, ["57"], "provision_lookup", 0.5), (2, ["318"], "case_search", 0.9), (3, ["9999"], "provision_lookup", 0.2), (4, [], "general_query", 0.0))
MADE = Fixture("query_id long, intent string, confidence double, latency_ms double", (1, "provision_lookup", 0.7, 10.0), (2, "provision_lookup", 0.8, 30.0), (3, "provision_lookup", 0.3, 20.0))


@query(f"""{{WITH}}, h AS (SELECT query_id, section_ref FROM (SELECT q.query_id, c.section_ref, row_number() OVER (PARTITION BY q.query_id, q.section ORDER BY chunk_index, chunk_id) AS n FROM {HITS}) WHERE n <= 10),
g AS (SELECT g.*, len(expected_sections) = 0 OR EXISTS (SELECT 1 FROM h, unnest(g.expected_sections) e(s) WHERE h.query_id = g.query_id AND contains(h.section_ref, e.s)) AS hit, intent, confidence FROM {GOLDEN.sql("g")} LEFT JOIN {MADE.sql("m")} USING (query_id))
SELECT round(avg(CAST(hit AS INTEGER)), 6) AS section_hit_rate, round(avg(CAST(coalesce(intent = expected_intent, false) AS INTEGER)), 6) AS intent_accuracy, round(avg(CAST(coalesce(confidence >= min_confidence, false) AS INTEGER)), 6) AS confidence_rate FROM g""")
def eval_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden set against what the exact lookup retrieves."""
    c = chunks(spark, sf_dir)
    found = c.select("chunk_id", "section_ref").join(small(hold(lexical.exact_sections(chunk_index(spark, sf_dir).keys, SECTIONS.frame(spark)), "sections")), "chunk_id")
    rates = search.evaluate(GOLDEN.frame(spark), found, MADE.frame(spark))
    return rates.select(*(F.round(c, 6).alias(c) for c in ("section_hit_rate", "intent_accuracy", "confidence_rate")))


LOOKUPS = Fixture("query_id long, section string, laws array<string>", (1, "57", None), (2, "318", ["BNS", "IPC"]), (3, "4", ["CrPC"]))


@query(f"""SELECT query_id, chunk_id, document_id, source_url, CAST(rank AS INTEGER) AS rank FROM (SELECT q.query_id, c.chunk_id, c.document_id, d.source_url, row_number() OVER (PARTITION BY q.query_id ORDER BY chunk_index, chunk_id) AS rank
FROM c JOIN d USING (document_id) JOIN {LOOKUPS.sql("q")} ON (c.section_ref = q.section OR c.subsection_ref ILIKE q.section || '%') AND (q.laws IS NULL OR list_contains(q.laws, d.law))) WHERE rank <= 3""")
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.find_by_section(chunks(spark, sf_dir), documents(spark, sf_dir), LOOKUPS.frame(spark), keys=chunk_index(spark, sf_dir).keys).select("query_id", "chunk_id", "document_id", "source_url", "rank")


CITED = Fixture("query_id long, citation string", (1, "air 1991, SC (1)"), (2, "AIR 1997 SC 7"), (3, "nothing"))


@query(f"""SELECT query_id, document_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, d.document_id, c.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY d.document_id, c.chunk_id NULLS FIRST) AS rank
FROM d JOIN {CITED.sql("q")} ON lower(trim(regexp_replace(d.citation, '[().,\\s]+', ' ', 'g'))) = lower(trim(regexp_replace(q.citation, '[().,\\s]+', ' ', 'g'))) LEFT JOIN c ON c.document_id = d.document_id AND c.chunk_type = 'final_order') WHERE rank <= 2""")
def citation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.find_by_citation(documents(spark, sf_dir), chunks(spark, sf_dir), CITED.frame(spark)).select("query_id", "document_id", "chunk_id", "rank")


@query("SELECT document_id, section_ref, snippet FROM (SELECT document_id, section_ref, left(content, 150) AS snippet, row_number() OVER (PARTITION BY document_id, section_ref ORDER BY chunk_index, chunk_id) AS n FROM c WHERE section_ref IS NOT NULL) WHERE n = 1")
def section_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.section_snippet(chunks(spark, sf_dir))


@query("""WITH v AS (SELECT user_id AS run, list_sort(list(value)) AS v, len(v) AS m, median(value) AS p50, 19 * (m + 1) AS place, greatest(1, least(place // 20, m - 1)) AS low, place - low * 20 AS rest FROM events GROUP BY 1)
SELECT run, round(p50, 6) AS p50_ms, round(CASE WHEN m < 5 THEN v[m] ELSE (v[low] * (20 - rest) + v[low + 1] * rest) / 20 END, 6) AS p95_ms FROM v""")
def eval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as the timings of a run."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.median("value").alias("p50"), F.collect_list("value").alias("all"))
    return rows.select("run", F.round("p50", 6).alias("p50_ms"), F.round(quantile(F.col("all"), 20, 19), 6).alias("p95_ms"))
