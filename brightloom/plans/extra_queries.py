"""Operators that no other query calls, over whole tables: users, issues, drafts, packing for summaries, prompts, ordered and partitioned chunks, uploads, versions, index updates, several fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.operators import answers, catalog, context, grounding, index, lexical, scoped, summary
from brightloom.operators.held import hold, new_folder
from brightloom.plans.harness import chunks, documents, table
from brightloom.plans.registry import query
from brightloom.plans.retrieval_queries import BM25, LEXICAL
from brightloom.sources import files, tables
from brightloom.streaming import flush


@query("SELECT c_custkey FROM customer WHERE lower(trim(c_name)) = (SELECT lower(min(c_name)) FROM customer) AND c_custkey % 2 = (SELECT min(c_custkey) FROM customer) % 2")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, of which every other one is active; the first by name is looked up in other letters and with blanks."""
    users = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.upper("c_name")).alias("email"))
    name, first = users.agg(F.min(F.trim("email")), F.min("c_custkey")).first()
    users = users.withColumn("is_active", F.col("c_custkey") % 2 == first % 2)
    return catalog.active_user(users, f" {name.lower()} ").select("c_custkey")


@query("SELECT conv_id, turn, md5(text) AS said, md5(array_to_string(list_filter(list_transform(string_split_regex(text, '\\n+|\\d+\\.\\s+'), lambda s: trim(s)), lambda s: s <> ''), '|')) AS issues FROM conversations")
def issue_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("said"), F.md5(F.array_join(summary.issue_list(F.col("text")), "|")).alias("issues"))


@query("SELECT conv_id, turn, md5(text) AS said, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN length(trim(left(text, 9))) > 0 THEN 1 ELSE 0 END AS n FROM conversations")
def unsupported_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what a model names as unsupported, what stands in the answer: the beginning always does, the whole in every other turn."""
    text = F.col("text")
    named = F.array(F.substring(text, 1, 9), F.when(F.col("turn") % 2 == 0, text).otherwise(F.concat(text, F.lit(" not said"))), F.lit(""))
    found = grounding.unsupported(F.concat(text, F.lit(" <CHUNK:abcd1234>")), named)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("said"), F.size(found).alias("n"))


@query("SELECT document_id, round(CASE WHEN n > 0 THEN least(0.6, 0.3 + 0.3 * n / 6) ELSE 0.2 END, 9) AS confidence FROM (SELECT document_id, count(*) FILTER (WHERE chunk_type = 'facts') AS n FROM c GROUP BY 1)")
def draft_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).groupBy("document_id").agg(F.count_if(F.col("chunk_type") == "facts").alias("n"))
    return rows.select("document_id", F.round(summary.draft_confidence(F.col("n")), 9).alias("confidence"))


@query("""WITH {w}, k AS (SELECT document_id, chunk_index, chunk_type NOT IN ('ratio', 'final_order', 'findings', 'facts', 'issues', 'section', 'punishment') AS late, chunk_id, '[' || coalesce(nullif(concat_ws(' | ', citation, '§' || section_ref, law, 'p.' || CAST(page_number AS VARCHAR)), ''), 'Source') || ']' AS header, content FROM c JOIN d USING (document_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY late, chunk_index, chunk_id) AS i FROM k),
n AS MATERIALIZED (SELECT document_id, i, header, content FROM o WHERE i <= 40)
SELECT document_id AS query_id, md5(context) AS context, CAST(blocks AS INTEGER) AS blocks FROM (WITH RECURSIVE r AS (
  SELECT document_id, 0 AS i, 0 AS used, '' AS context, 0 AS blocks FROM n WHERE i = 1
  UNION ALL SELECT document_id, i, used + length(block) + 2, CASE WHEN i = 1 THEN block ELSE context || chr(10) || chr(10) || block END, blocks + 1 FROM (
    SELECT r.document_id, n.i, r.used, r.context, r.blocks, n.header || chr(10) || CASE WHEN length(n.content) <= room THEN n.content ELSE regexp_replace(left(n.content, room), '(?s)^(.+\\.)[ \\n].*$', '\\1') || ' [...]' END AS block
    FROM r JOIN (SELECT *, 0 AS z FROM n) n ON n.document_id = r.document_id AND n.i = r.i + 1, LATERAL (SELECT 2000 - r.used - length(n.header) - 1 AS room) q WHERE room > 80))
  SELECT * FROM r) WHERE true QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY blocks DESC) = 1""".replace("{w}", "{WITH}").replace("WITH {WITH}", "{WITH}"))
def summary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chunks packed into 2000 characters for a summary; all blocks that fit are packed, of short lines more than the 40 at which the SQL stops."""
    d = documents(spark, sf_dir).withColumn("court_name", F.lit(None).cast("string"))
    rows = chunks(spark, sf_dir).join(d, "document_id").select(F.col("document_id").alias("query_id"), "chunk_id", "content", "chunk_type", F.col("chunk_index").alias("rank"), (1 / (1 + F.col("chunk_index"))).alias("final_score"), "citation", "section_ref", "law", "page_number", "court_name")
    return context.compress(rows, max_tokens=500).withColumn("context", F.md5("context"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS back FROM conversations), l AS (SELECT conv_id, text AS query FROM t WHERE back = 1),
p AS (SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY back DESC) AS past FROM t WHERE back > 1 AND back <= 7 GROUP BY 1)
SELECT conv_id AS query_id, md5(CASE conv_id % 3 WHEN 0 THEN 'CASES' || chr(10) || coalesce(past, '') || chr(10) || query WHEN 1 THEN CASE WHEN past IS NULL THEN '' ELSE 'CONVERSATION HISTORY:' || chr(10) || past || chr(10) || chr(10) END || 'SOURCES:' || chr(10) || 'No relevant sources found.' || chr(10) || chr(10) || 'QUERY:' || chr(10) || query
ELSE 'DRAFT from ctx: ' || query END) AS prompt FROM l LEFT JOIN p USING (conv_id)""")
def prompts_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last turn as a query, the six before it as its history; two intents have templates."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    t = table(spark, sf_dir, "conversations").withColumn("back", back)
    intent = F.element_at(F.array(F.lit("case_search"), F.lit("general_query"), F.lit("drafting_request")), (F.col("conv_id") % 3 + 1).cast("int"))
    asked = t.where("back = 1").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("conv_id") % 3 == 2, "ctx").otherwise("").alias("context"), intent.alias("intent"))
    history = t.where("back > 1").select(F.col("conv_id").alias("query_id"), (-F.col("back")).alias("turn"), "role", F.col("text").alias("content"))
    made = answers.prompts(asked, history, templates={"case_search": "CASES\n{history}\n{query}", "drafting_request": "DRAFT from {context}: {query}"})
    return made.select("query_id", F.md5("prompt").alias("prompt"))


@query("SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS place FROM c")
def ordered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a reader gets them, numbered in that order within their partition."""
    rows = catalog.ordered_chunks(chunks(spark, sf_dir)).withColumn("i", F.monotonically_increasing_id())
    first = rows.groupBy("document_id").agg(F.min("i").alias("first"))
    return rows.join(first, "document_id").select("document_id", "chunk_id", (F.col("i") - F.col("first")).alias("place"))


@query("SELECT law, count(*) AS n, CAST(sum(content_length) AS BIGINT) AS chars FROM (SELECT CASE WHEN law = 'IPC' THEN 'Other' ELSE law END AS law, content_length FROM c JOIN d USING (document_id)) GROUP BY 1")
def chunks_by_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored in a folder for each law, those of one law without it, and read back."""
    law = documents(spark, sf_dir).select("document_id", F.when(F.col("law") != "IPC", F.col("law")).alias("law"))
    folder = new_folder(spark, "by-law")
    tables.write_chunks(chunks(spark, sf_dir).join(law, "document_id"), folder)
    return spark.read.parquet(folder).groupBy("law").agg(F.count("*").alias("n"), F.sum("content_length").alias("chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS upload_id, octet_length(encode(text)) AS size, md5(text) AS content FROM documents WHERE octet_length(encode(text)) > 0")
def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an upload in parts of 1000 bytes, one of them twice, written to files and read back."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("upload_id"), F.col("text").cast("binary").alias("data")).where(F.octet_length("data") > 0)
    starts = F.flatten(F.array(F.sequence(F.lit(0), F.octet_length("data") - 1, F.lit(1000)), F.array(F.lit(0))))
    # Parts are cut before they become rows, so that no row carries the whole text.
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(F.col("data"), i + 1, F.lit(1000)).alias("content")))
    parts = d.select("upload_id", F.octet_length("data").alias("total"), F.inline(cut))
    stored = hold(files.write_uploads(parts, new_folder(spark, "uploads")), "uploads").where("complete")
    return files.digests(stored).withColumnRenamed("md5", "content")


@query("SELECT document_id, law FROM d WHERE doc_id % 4 <> 0")
def version_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of which a second version comes into use and a third, too short, doesn't."""
    d = documents(spark, sf_dir)
    kept, n = tables.VersionedTable(spark, new_folder(spark, "versions")), d.where("doc_id % 4 <> 0").count()
    kept.swap(d.select("document_id", "law"), d.count())
    kept.swap(d.where("doc_id % 4 <> 0").select("document_id", "law"), n)
    kept.swap(d.where("doc_id % 2 = 0").select("document_id", "law"), d.count())
    return kept.read()


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label AS document_id FROM embeddings WHERE vec_id % 7 <> 3")
def flush_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of vectors moved into an index; every seventh has lost a component and is put aside."""
    source = table(spark, sf_dir, "embeddings")
    dim = source.agg(F.max(F.size("embedding"))).first()[0]
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/embeddings.parquet*")
    cut = F.when(F.col("vec_id") % 7 == 3, F.slice("embedding", 1, dim - 1)).otherwise(F.col("embedding"))
    rows = stream.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").alias("document_id"), cut.alias("embedding"), F.timestamp_seconds("vec_id").alias("created_at"))
    folder = new_folder(spark, "flush")
    flush.flush(rows, f"{folder}/index", f"{folder}/aside", f"{folder}/stream", dim, every=None).awaitTermination()
    return flush.indexed(spark, f"{folder}/index").select("chunk_id", "document_id")


#: The chunks after an update: documents that five divides are gone, of those that three divides only the first ten chunks are left.
UPDATED = "w2 AS (SELECT w.* FROM w WHERE CAST(document_id AS BIGINT) % 5 <> 0 AND (CAST(document_id AS BIGINT) % 3 <> 0 OR chunk_index < 10))"


@query("{WITH}, " + UPDATED + ", " + BM25.replace("FROM w)", "FROM w2)").replace("FROM w),", "FROM w2),") + " SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 50")
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index after an update with replaced and deleted documents."""
    c, path, i = chunks(spark, sf_dir), new_folder(spark, "updated-index"), F.col("document_id").cast("long")
    index.write_index(c, path)
    changed = c.where((i % 3 == 0) & (i % 5 != 0) & (F.col("chunk_index") < 10))
    # A document that is left with no chunk is deleted, too.
    gone = c.where((i % 5 == 0) | (i % 3 == 0)).select("document_id").distinct()
    made = index.update(spark, path, changed, gone)
    return lexical.bm25(made, LEXICAL.frame(spark)).withColumn("score", F.round("score", 6))


@query("""{WITH}, f AS (SELECT chunk_id, 'content' AS field, words FROM w UNION ALL SELECT chunk_id, 'head', regexp_extract_all(lower(left(content, 40)), '[\\pL\\pN_]+') FROM c),
q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\pL\\pN_]+'))) AS lexeme FROM {q}),
tf AS (SELECT field, lexeme, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, chunk_id, len(words) AS dl, unnest(words) AS lexeme FROM f) WHERE lexeme IN (SELECT lexeme FROM q) GROUP BY 1, 2, 3),
df AS (SELECT field, lexeme, count(*) AS df FROM tf GROUP BY 1, 2), st AS (SELECT field, count(*) AS n, avg(len(words)) AS avgdl FROM f GROUP BY 1),
s AS (SELECT field, query_id, chunk_id, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ORDER BY lexeme)) AS score FROM tf JOIN df USING (field, lexeme) JOIN st USING (field) JOIN q USING (lexeme) GROUP BY 1, 2, 3),
m AS (SELECT query_id, chunk_id, coalesce(max(score) FILTER (WHERE field = 'content'), 0) AS a, coalesce(max(score) FILTER (WHERE field = 'head'), 0) * 2 AS b FROM s GROUP BY 1, 2),
r AS (SELECT query_id, chunk_id, greatest(a, b) + 0.3 * (a + b - greatest(a, b)) AS score FROM m)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM r) WHERE rank <= 50""".replace("{q}", LEXICAL.sql()))
def multi_field_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over contents and, with twice the weight, over their first 40 characters."""
    c = chunks(spark, sf_dir)
    made = lexical.write_fields(c, {"content": F.col("content"), "head": F.left("content", F.lit(40))}, new_folder(spark, "fields"))
    found = lexical.multi_field(made, LEXICAL.frame(spark), {"content": 1.0, "head": 2.0})
    return found.withColumn("score", F.round("score", 6))


@query("SELECT doc_id AS query_id, chunk_id, CAST(rank AS INTEGER) AS rank, law, court, year, source_url FROM (SELECT d.doc_id, c.chunk_id, d.law, d.court, d.year, d.source_url, row_number() OVER (PARTITION BY d.doc_id ORDER BY c.chunk_index, c.chunk_id) AS rank FROM c JOIN d USING (document_id) WHERE content_length > 150) WHERE rank <= 15")
def scoped_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked for words that it doesn't have: its first long chunks, with its metadata."""
    d = documents(spark, sf_dir)
    asked = d.select(F.col("doc_id").alias("query_id"), "document_id", F.lit("zzzzqqqq xxxxyyyy").alias("query"))
    return scoped.in_document(chunks(spark, sf_dir), asked, documents=d).select("query_id", "chunk_id", "rank", "law", "court", "year", "source_url")
