"""Retrieval inside one document for each query, with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.query import scoped_query
from brightloom.operators.fusion import first_stage
from brightloom.operators.lexical import tokens, top_k

# Words that the keyword fallback leaves out.
STOP = ("from", "this", "that", "with", "were", "what", "which", "have", "been", "case", "legal", "court", "suit", "file")


#: What a scoped hit carries of its document.
METADATA = ("document_type", "law", "court", "court_name", "citation", "year", "source_url")


def in_document(chunks: DataFrame, queries: DataFrame, k: int = 15, documents: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, stage and rank of each query's (query_id, document_id, query) best chunks of its document.

    Stages: chunks with all words of the query, by how often they occur by length; else chunks that hold one of its first four long words (0.5);
    else chunks over 150 characters (1.0); the last two in document order. With ``documents`` hits also have document_id and their document's METADATA, null where it is unknown.
    """
    asked = queries.withColumn("clean", scoped_query(F.col("query"))).withColumn("words", F.array_distinct(tokens(F.col("clean"))))
    keys = F.slice(F.filter(F.transform(F.filter(F.split(F.trim("clean"), r"\s+"), lambda w: F.length(w) > 4), lambda w: F.lower(F.btrim(w, F.lit(".,?!")))), lambda w: ~w.isin(*STOP)), 1, 4)
    rows = asked.withColumn("keys", keys).join(chunks, "document_id").withColumn("has", tokens(F.col("content")))
    every = F.forall("words", lambda w: F.array_contains("has", w)) & (F.size("words") > 0)
    often = F.size(F.filter("has", lambda t: F.array_contains("words", t)))
    any_key = F.exists("keys", lambda w: F.contains(F.lower("content"), w))
    order = (-F.col("chunk_index")).cast("double")
    pick = lambda cond, score, by: rows.where(cond).select("query_id", "chunk_id", score.alias("score"), by.alias("by"))
    share = F.round(often / (often + F.size("has")), 6)
    staged = first_stage([pick(every, share, share), pick(any_key, F.lit(0.5), order), pick(F.col("content_length") > 150, F.lit(1.0), order)])
    found = top_k(staged, k, "by").drop("by")
    if documents is None:
        return found
    known = documents.select("document_id", *(F.col(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in METADATA))
    return found.join(queries.select("query_id", "document_id"), "query_id").join(known, "document_id", "left")
