"""Browsing, monitoring, sinks and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import catalog as C
from brightloom.plans.harness import by_document, chunks, documents, table
from brightloom.plans.registry import query
from brightloom.sources import tables as S

LIST = "SELECT {cols} FROM d LEFT JOIN (SELECT document_id, count(*) AS n FROM c GROUP BY 1) k USING (document_id)"
URL = "coalesce(source_url, concat('/api/v1/documents/', document_id, '/view'))"


@query(LIST.format(cols=f"document_id, law, year, coalesce(n, 0) AS total_chunks, {URL} AS access_url") + " WHERE law IN ('BNS', 'BNSS') AND court = 'Supreme Court' AND year >= 1995 AND year <= 2020 AND document_type = 'judgment' ORDER BY year DESC, document_id LIMIT 20 OFFSET 20")
def doc_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).where(C.metadata_filter(["BNS", "BNSS"], ["Supreme Court"], 1995, 2020, "judgment"))
    page = C.listing(rows, chunks(spark, sf_dir), page=2, page_size=20, order=(F.col("year").desc(), F.col("document_id")))
    return page.select("document_id", "law", "year", "total_chunks", C.access_url(F.col("source_url"), F.col("document_id")).alias("access_url"))


@query("SELECT count(*) AS total FROM d WHERE citation ILIKE '%SC 1%'")
def doc_listing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumns({"case_number": F.lit(None).cast("string"), "court_name": F.lit(None).cast("string")})
    return rows.where(C.search_filter("SC 1")).agg(F.count("*").alias("total"))


@query("SELECT document_id FROM d WHERE contains(lower(citation), 'sc 1') OR contains(lower(topic), 'sc 1')")
def document_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("parties", F.lit(None).cast("map<string,string>"))
    return rows.where(C.text_filter("SC 1")).select("document_id")


@query("SELECT left(chunk_id, 8) AS chunk_id, left(document_id, 8) AS document_id, round(chunk_index / 7.0, 4) AS score, left(content, 200) AS content_preview FROM c")
def debug_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("chunk_id", "document_id", (F.col("chunk_index") / 7.0).alias("score"), "content")
    return C.debug_view(rows)


@query(LIST.format(cols="document_id, coalesce(n, 0) AS total_chunks"))
def document_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = by_document(spark, sf_dir)
    counts = C.chunk_counts(c)
    return d.select("document_id").join(counts, "document_id", "left").na.fill(0)


@query("SELECT count(*) AS total, count(DISTINCT law) AS laws, count(DISTINCT court) AS courts FROM d")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_stats(documents(spark, sf_dir))


@query("SELECT count(*) AS total, CAST(round(avg(content_length)) AS INTEGER) AS avg_length, count(DISTINCT document_id) AS documents FROM c")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_stats(chunks(spark, sf_dir))


@query("SELECT chunk_type, count(*) AS n, CAST(sum(content_length) AS BIGINT) AS chars FROM c GROUP BY 1")
def chunk_type_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_type_distribution(chunks(spark, sf_dir))


@query("SELECT document_id, string_agg(concat(chunk_type, '=', CAST(n AS VARCHAR)), ',' ORDER BY chunk_type) AS types FROM (SELECT document_id, chunk_type, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1")
def chunk_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.type_histogram(chunks(spark, sf_dir))
    return rows.select("document_id", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("types"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value < 50) AS pending FROM events GROUP BY 1")
def staged_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") < 50).alias("pending"))


@query("SELECT 'documents' AS table_name, count(*) AS n FROM d UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'messages', count(*) FROM conversations UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return C.row_counts(documents=documents(spark, sf_dir), chunks=chunks(spark, sf_dir), messages=t("conversations"), vectors=t("embeddings"), events=t("events"))


@query("SELECT document_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS full_text_md5 FROM c GROUP BY 1")
def fulltext_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.full_texts(by_document(spark, sf_dir)[1]).select("document_id", F.md5("full_text").alias("full_text_md5"))


@query("SELECT chunk_id, chunk_index, left(content, 200) AS preview FROM c WHERE document_id = '7' AND chunk_type = 'facts' ORDER BY chunk_index LIMIT 100")
def chunk_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.viewer(chunks(spark, sf_dir), "7", "facts").select("chunk_id", "chunk_index", F.left("content", F.lit(200)).alias("preview"))


@query("SELECT document_id, law IN ('BNS', 'IPC') AS by_law, coalesce(court = 'High Court', false) AS by_court, year >= 2000 AND year <= 2010 AS by_years, document_type = 'statute' AS by_type FROM d")
def metadata_filter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda **k: F.coalesce(C.metadata_filter(**k), F.lit(False))
    return documents(spark, sf_dir).select("document_id", f(laws=["BNS", "IPC"]).alias("by_law"), f(courts=["High Court"]).alias("by_court"), f(year_from=2000, year_to=2010).alias("by_years"), f(document_type="statute").alias("by_type"))


@query("SELECT chunk_id, CASE WHEN source_url IS NOT NULL THEN concat(source_url, '#page=', CAST(page_number AS VARCHAR)) END AS deep_link FROM c JOIN d USING (document_id)")
def deep_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).join(documents(spark, sf_dir).select("document_id", "source_url"), "document_id")
    return rows.select("chunk_id", C.deep_link(F.col("source_url"), F.col("page_number")).alias("deep_link"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, left(min_by(text, turn), 80) AS title, count(*) AS messages, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.left(F.min_by("text", "turn"), F.lit(80)).alias("title"), F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return rows.select(F.col("conv_id").cast("string").alias("session_id"), "title", "messages", "last_turn")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS created_at, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("created_at"), "role")
    return C.messages_of(rows, rows, F.col("role") == "system")


@query("SELECT session_id, created_at, CAST(back AS INTEGER) AS back FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS created_at, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE back <= 6")
def last6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("created_at")).distinct()
    return C.last_turns(rows)


@query("SELECT document_id, 'new' AS topic, CASE WHEN doc_id % 2 = 0 THEN law ELSE 'Other' END AS law FROM d")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents upserted into a table that holds those with even ids."""
    d = documents(spark, sf_dir).select("doc_id", "document_id", "topic", "law")
    rows = d.select("document_id", F.lit("new").alias("topic"), F.lit("Other").alias("law"))
    return S.upsert(d.where("doc_id % 2 = 0").select("document_id", "topic", "law"), rows, "document_id", ["topic"])


@query("SELECT chunk_id, document_id FROM c WHERE chunk_index % 3 <> 0")
def insert_ignore_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return S.insert_new(c.where("chunk_index % 3 = 0"), c, "chunk_id").select("chunk_id", "document_id")


@query("SELECT chunk_id FROM c JOIN d USING (document_id) WHERE law <> 'IPC'")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return S.delete_documents({"chunks": chunks(spark, sf_dir)}, d.where("law = 'IPC'"))["chunks"].select("chunk_id")


@query("SELECT document_id FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = d.document_id)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id").join(chunks(spark, sf_dir).select("document_id"), "document_id", "left_anti")


@query("""SELECT document_id, CAST(n AS BIGINT) AS total_chunks, CAST(s AS BIGINT) AS staged,
CASE WHEN n = 0 THEN 'parsing' WHEN done >= n THEN 'complete' WHEN s + done < n THEN 'embedding' ELSE 'indexing' END AS stage
FROM (SELECT document_id, doc_id % 9 AS done, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM d LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE chunk_index % 2 = 0) AS s FROM c GROUP BY 1) k USING (document_id))""")
def progress_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = by_document(spark, sf_dir)
    d = d.withColumn("indexed_chunk_count", (F.col("doc_id") % 9).cast("int"))
    return C.progress(d, c, c.where("chunk_index % 2 = 0")).select("document_id", "total_chunks", "staged", "stage")


@query("SELECT document_id, count(*) AS total_chunks FROM c WHERE document_id NOT IN (SELECT document_id FROM c WHERE chunk_type = 'ratio' OR chunk_index >= 30) GROUP BY 1")
def counter_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return C.backfill_counts(c, c.where("chunk_index >= 30"))


@query("SELECT user_id, count(*) AS flushed FROM events WHERE value >= 50 GROUP BY 1")
def flush_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value >= 50").groupBy("user_id").agg(F.count("*").alias("flushed"))


#: Documents as uploads in parts of 1000 bytes, of which every third is yet to come.
PARTS = "p AS (SELECT CAST(doc_id AS VARCHAR) AS upload_id, octet_length(encode(text)) AS total, unnest(range(0, octet_length(encode(text)), 1000)) AS start, (start // 1000 + doc_id) % 3 <> 0 AS received FROM documents)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("total")).where("total > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(1000).cast("long"))).alias("start"))
    return rows.select(F.col("doc_id").cast("string").alias("upload_id"), "total", "start", (F.floor(F.col("start") / 1000) + F.col("doc_id")) % 3 != 0)


@query(f"WITH {PARTS} SELECT upload_id, start FROM p WHERE NOT received")
def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).toDF("upload_id", "total", "start", "come").groupBy("upload_id", "total").agg(F.collect_list(F.when(F.col("come"), F.col("start"))).alias("received"))
    return rows.select("upload_id", F.explode(C.missing_parts(F.col("total"), 1000, F.col("received"))).alias("start"))


@query(f"WITH {PARTS} SELECT upload_id, CAST(sum(least(1000, total - start)) AS BIGINT) AS received, sum(least(1000, total - start)) >= max(total) AS complete FROM p WHERE received GROUP BY 1")
def received_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).toDF("upload_id", "total", "start", "come").where("come")
    size = F.least(F.lit(1000), F.col("total") - F.col("start"))
    return rows.groupBy("upload_id").agg(F.sum(size).alias("received"), (F.sum(size) >= F.max("total")).alias("complete"))
