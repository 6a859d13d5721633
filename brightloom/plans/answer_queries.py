"""Mapped sections, drafts, records, stored turns, parts of judgments, rejected vectors, and the whole way from query to record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import query as Q
from brightloom.functions.query import understand
from brightloom.functions.vectors import hashing_model
from brightloom.operators import answers, grounding, ingest, search
from brightloom.operators.held import hold
from brightloom.plans.harness import chunk_index, chunks, documents, table
from brightloom.plans.registry import boundary_cut, literal, query
from brightloom.plans.retrieval_queries import BM25_SCORES, HEADER
from brightloom.plans.text_queries import PHRASES, N, named_in, synonyms_of

#: Every document as a query that retrieved its own chunks; a model names the sections of some of them, wrongly every other time, and some by their chunk.
FOUND = "r AS (SELECT doc_id AS query_id, chunk_index AS rank, chunk_id, section_ref, law, citation, content FROM c JOIN d USING (document_id))"
VALID = f"""{FOUND}, n AS (SELECT query_id, rank, CASE WHEN (rank // 6 + query_id) % 2 = 0 THEN section_ref ELSE '9' || section_ref || 'a' END AS section_number, CASE WHEN query_id % 5 = 1 THEN left(chunk_id, 12) END AS citation_chunk_id FROM r WHERE section_ref IS NOT NULL),
v AS (SELECT n.*, left(n.citation_chunk_id, 8) IN (SELECT left(r.chunk_id, 8) FROM r WHERE r.query_id = n.query_id) IS TRUE OR lower(n.section_number) IN (SELECT lower(r.section_ref) FROM r WHERE r.query_id = n.query_id) IS TRUE AS valid FROM n)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).join(documents(spark, sf_dir), "document_id")
    return rows.select(F.col("doc_id").alias("query_id"), F.col("chunk_index").alias("rank"), "chunk_id", "section_ref", "law", "citation", "content")


def _named(found: DataFrame) -> DataFrame:
    right = (F.floor(F.col("rank") / 6) + F.col("query_id")) % 2 == 0
    name = F.when(right, F.col("section_ref")).otherwise(F.concat(F.lit("9"), "section_ref", F.lit("a")))
    return found.where("section_ref is not null").select("query_id", "rank", name.alias("section_number"), F.when(F.col("query_id") % 5 == 1, F.substring("chunk_id", 1, 12)).alias("citation_chunk_id"))


@query(f"{{WITH}}, {VALID} SELECT query_id, rank, section_number, valid FROM v")
def section_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    return answers.validate_sections(_named(found), found).select("query_id", "rank", "section_number", "valid")


@query(f"""{{WITH}}, {VALID}, g AS (SELECT query_id, list(lower(section_number)) AS valid FROM v WHERE valid GROUP BY 1),
k AS (SELECT r.query_id, r.chunk_id, r.section_ref IS NULL OR list_contains(g.valid, lower(r.section_ref)) IS TRUE AS keep, g.valid IS NOT NULL AND r.query_id % 3 <> 2 AS mapped FROM r LEFT JOIN g USING (query_id)),
s AS (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS left_over FROM k) SELECT query_id, chunk_id FROM s WHERE NOT mapped OR keep OR NOT left_over""")
def mapping_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    intents = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.element_at(F.array(F.lit("provision_lookup"), F.lit("drafting_request"), F.lit("case_search")), (F.col("doc_id") % 3 + 1).cast("int")).alias("intent"))
    return answers.narrow(found, answers.validate_sections(_named(found), found), intents).select("query_id", "chunk_id")


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as a model would send them: bare, fenced, amid words, cut off, not at all."""
    p, way = F.col("props"), F.col("event_id") % 5
    reply = F.when(way == 0, p).when(way == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(way == 2, F.concat(F.lit("Sure: "), p, F.lit(" done"))).when(way == 3, F.replace(p, F.lit("}"), F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", answers.parse_json(reply, "k int")["k"].alias("k"))


@query("SELECT conv_id AS query_id, CAST(i - 1 AS INTEGER) AS position, CASE WHEN i > 1 THEN ' ' ELSE '' END || parts[i] AS piece FROM (SELECT conv_id, string_split(arg_max(text, turn), ' ') AS parts FROM conversations GROUP BY 1) t, LATERAL unnest(range(1, len(parts) + 1)) u(i)")
def word_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("answer"))
    return answers.word_events(last)


@query("SELECT user_id AS query_id, round(sum(value) FILTER (WHERE event_type <> (SELECT min(event_type) FROM events)), 4) AS total_ms, count(DISTINCT event_type) AS steps FROM events GROUP BY 1")
def latency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timings: the first type by name stands for a total, which is not counted."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("first"))
    step = F.when(F.col("event_type") == F.col("first"), "total_ms").otherwise(F.col("event_type"))
    found = answers.total_latency(e.crossJoin(F.broadcast(first)).select(F.col("user_id").alias("query_id"), step.alias("step"), F.col("value").alias("ms")))  # one row
    return found.select("query_id", F.round("total_ms", 4).alias("total_ms"), F.size("latency_ms").cast("long").alias("steps"))


TURNS = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


@query(f"""WITH t AS ({TURNS}), n AS (SELECT conv_id, trim(left(min_by(text, turn), 80)) AS title, max(turn) AS last FROM t GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'old' ELSE title END AS title, last AS updated FROM n""")
def store_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns stored into sessions of which those with even ids are known."""
    t = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("session_id"), F.lit("u").alias("user_id"), F.col("text").alias("message"), F.lit("ok").alias("answer"), F.timestamp_seconds("turn").alias("at"))
    old = t.where("cast(session_id as long) % 2 = 0").select("session_id", "user_id", F.lit("old").alias("title"), F.timestamp_seconds(F.lit(0)).alias("created_at"), F.timestamp_seconds(F.lit(0)).alias("updated_at")).distinct()
    sessions, _ = answers.store_turns(old, t)
    return sessions.select("session_id", "title", F.unix_seconds("updated_at").alias("updated"))


@query("SELECT doc_id AS id, concat('To ', coalesce(source, ''), ': [FACTS] by ', coalesce(lang, '')) AS draft FROM documents")
def draft_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("court"), F.col("source"), F.lit("name"), F.col("lang"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), answers.fill_template(F.lit("To [COURT]: [FACTS] by [NAME]"), values).alias("draft"))


@query(f"""{{WITH}}, {FOUND} SELECT query_id, md5(string_agg('<CHUNK:' || left(chunk_id, 8) || '> [' || trim(law || ' ' || coalesce(section_ref, '')) || '] [' || coalesce(citation, '') || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS context FROM r WHERE rank <= 6 GROUP BY 1""")
def draft_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.draft_context(_found(spark, sf_dir)).withColumn("context", F.md5("context"))


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, vec_id % 3 <> 0 AS embedded FROM embeddings")
def embed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model that returns a short vector for every third text."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"), F.col("vec_id").cast("string").alias("content"))
    found = ingest.embed_chunks(rows, lambda texts: [[0.0] * (4 if int(t) % 3 else 3) for t in texts], 4)
    return found.select("chunk_id", F.col("error").isNull().alias("embedded"))


@query("SELECT c.chunk_id, chunk_type, content_length, document_type, law, court, year, source_url FROM c JOIN d USING (document_id)")
def index_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("law", F.lit(None).cast("string"))
    d = documents(spark, sf_dir).withColumn("court_name", F.lit(None).cast("string"))
    return ingest.payloads(c, d).select("chunk_id", "chunk_type", "content_length", "document_type", "law", "court", "year", "source_url")


@query()
def summary_text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all texts."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return ingest.summary_windows(rows, 2000, 300).select("document_id", "window", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


#: Every item of the benchmark as a question: a phrase that rules look for, and its first four words.
ASKED = f"""asked AS (SELECT item_id AS query_id, {literal(PHRASES)}[1 + item_id % {N}] || ' ' || array_to_string(string_split(text, ' ')[1:4], ' ') AS text FROM benchmark),
known AS (SELECT query_id, list_distinct(flatten([{", ".join(f"regexp_extract_all(text, {literal(p)}, 1)" for p in Q.SECTIONS)}])) AS sections, {named_in(Q.LAW_WORDS)} AS laws, {named_in(Q.COURT_WORDS)} AS courts,
  list_transform(regexp_extract_all(text, '\\b(19[0-9][0-9]|20[0-2][0-9])\\b'), lambda z: CAST(z AS INTEGER)) AS years, flatten([{", ".join(synonyms_of(*rule) for rule in Q.SYNONYMS)}]) AS terms, text FROM asked),
spelt AS (SELECT query_id, CASE WHEN len(terms) > 0 THEN array_to_string(list_prepend('"' || text || '"', terms), ' OR ') ELSE trim(text) END AS spelt FROM known),
may AS (SELECT k.query_id, c.chunk_id FROM known k, c JOIN d USING (document_id) WHERE (len(laws) = 0 OR list_contains(laws, law)) AND (len(courts) = 0 OR coalesce(list_contains(courts, court), false)) AND (len(years) = 0 OR year BETWEEN list_min(years) AND list_max(years)))"""
FOUND_FOR = f"""q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(spelt, '"|\\bOR\\b', ' ', 'g')), '[\\pL\\pN_]+'))) AS lexeme FROM spelt),
{BM25_SCORES},
lx AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s JOIN may USING (query_id, chunk_id) QUALIFY rank <= 50),
sec AS (SELECT query_id, section, regexp_extract(section, '^[0-9]+[A-Za-z]?') AS number FROM (SELECT query_id, unnest(sections) AS section FROM known)),
ex AS (SELECT query_id, chunk_id, min(rank) AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id, section ORDER BY chunk_index, chunk_id) AS rank FROM sec JOIN c ON c.section_ref ILIKE number || '%' OR c.subsection_ref ILIKE number || '%' JOIN may USING (query_id, chunk_id)) WHERE rank <= 10 GROUP BY 1, 2),
fu AS (SELECT query_id, chunk_id, round(sum(s), 9) AS score, bool_or(exact) AS exact FROM (SELECT query_id, chunk_id, 2.0 / (60 + rank) AS s, true AS exact FROM ex UNION ALL SELECT query_id, chunk_id, 0.55 / (60 + rank), false FROM lx) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 60),
rr AS (SELECT *, CASE WHEN exact THEN 1.0 ELSE score END AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, CASE WHEN exact THEN rank END, CASE WHEN exact THEN 1.0 ELSE score END DESC, rank, chunk_id) AS final_rank FROM fr QUALIFY final_rank <= 6)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (1 + F.col("item_id") % N).cast("int"))
    words = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", phrase, words).alias("query"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return chunks(spark, sf_dir, "law", "court", "year", "citation", "source_url").withColumns({"case_number": none, "court_name": none})


@query(f"""{{WITH}}, {ASKED}, {FOUND_FOR}, k AS (SELECT query_id, chunk_id, content, chunk_type, final_score, final_rank, {HEADER} AS header FROM rr JOIN c USING (chunk_id) JOIN d USING (document_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, md5(lower(trim(regexp_replace(left(content, 200), '\\s+', ' ', 'g')))) ORDER BY final_rank, chunk_id) = 1),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_type NOT IN ('section', 'final_order', 'subsection'), final_score DESC, final_rank) AS i FROM k)
SELECT query_id, md5(context) AS context, CAST(blocks AS INTEGER) AS blocks FROM (WITH RECURSIVE r AS (
  SELECT query_id, 0 AS i, 0 AS used, '' AS context, 0 AS blocks FROM n WHERE i = 1
  UNION ALL SELECT query_id, i, used + length(block) + 2, CASE WHEN i = 1 THEN block ELSE context || chr(10) || chr(10) || block END, blocks + 1 FROM (
    SELECT r.query_id, n.i, r.used, r.context, r.blocks, n.header || chr(10) || {boundary_cut("n.content", "(11520 - r.used - length(n.header) - 3)")} AS block
    FROM r JOIN n ON n.query_id = r.query_id AND n.i = r.i + 1 WHERE 11520 - r.used - length(n.header) - 3 > 80))
  SELECT * FROM r) WHERE true QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY blocks DESC) = 1""")
def search_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the benchmark's questions to packed contexts."""
    found = search.retrieve(_corpus(spark, sf_dir), _asked(spark, sf_dir), index=chunk_index(spark, sf_dir))
    return search.contexts(found).withColumn("context", F.md5("context"))


@query()
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the benchmark's questions to verified records, with stand-ins for the embedding and the language model."""
    corpus, asked = _corpus(spark, sf_dir), _asked(spark, sf_dir)
    model = hashing_model(64)
    vectors = ingest.embed_chunks(corpus, model, 64, carry=("law", "court", "year")).drop("document_id", "error")
    found = hold(search.retrieve(corpus, asked, vectors, model, 64, index=chunk_index(spark, sf_dir)), "found")  # a few rows for each query, read by every step that follows
    written = search.extract_answers(found)
    kept = found.withColumns({"answer_id": F.col("query_id"), "rank": F.col("final_rank")})
    checked = grounding.verify(grounding.claims(written.withColumnRenamed("query_id", "answer_id")), kept, corpus, documents(spark, sf_dir))
    rows = written.join(understand(asked).select("query_id", "intent", "law_filter"), "query_id")
    return answers.response(rows, kept.select("query_id", "rank", "document_id", "final_score"), checked).select("query_id", "intent", "answer", "confidence", "band", F.size("citations").alias("citations"), F.size("hallucination_flags").alias("flags"), F.array_join("warnings", ",").alias("warnings"))
