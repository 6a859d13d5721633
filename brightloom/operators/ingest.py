"""Ingestion of a folder from files to an index: parsing, chunks, vectors, rejects and a report, each one job over all files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brightloom.functions import chunking
from brightloom.functions.chunking import chunk_documents, windows
from brightloom.functions.text import summary_sentences
from brightloom.schemas import LAWS, known
from brightloom.sources import files as files_of

#: Tries of a batch before its chunks count as failed, and texts of a batch.
TRIES, BATCH = 3, 512


def embed_chunks(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], dim: int, tries: int = TRIES, batch: int = BATCH, carry: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, document_id, embedding, error and what is carried of every chunk, by an injected model, in batches.

    A batch that fails is tried again; after the last try its chunks get an error and no vector, and so does a chunk whose vector has another
    size. The job goes on: failed chunks are rows to quarantine, and a lost executor's batches are simply made again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                vectors, error = [None] * len(some), None
                for _ in range(tries):
                    try:
                        vectors, error = [list(map(float, v)) for v in model(some["content"].tolist())], None
                        break
                    except Exception as e:  # a failed batch is a result
                        error = f"{type(e).__name__}: {e}"
                sizes = [error or (None if len(v) == dim else f"{len(v)} components") for v in (vectors if error is None else [[]] * len(some))]
                yield pd.DataFrame({"chunk_id": some["chunk_id"], "document_id": some["document_id"], "embedding": [v if e is None else None for v, e in zip(vectors, sizes, strict=True)], "error": sizes, **{c: some[c] for c in carry}})

    made = StructType.fromDDL("chunk_id string, document_id string, embedding array<float>, error string")
    return chunks.select("chunk_id", "document_id", "content", *carry).mapInPandas(run, StructType([*made, *(chunks.schema[c] for c in carry)]))


# What stands for missing metadata.
DEFAULTS = {"chunk_type": "passage", "document_type": "upload", "law": "Other", "is_landmark": False, "language": "en"}
#: What an index keeps of a chunk's document.
OF_DOCUMENT = "document_type string, law string, court string, court_name string, case_number string, citation string, year int, date_decided timestamp, bench array<string>, parties map<string,string>, topic string, keywords array<string>, source_url string, is_landmark boolean, language string"


def complete(prompts: DataFrame, model: Callable[[list[str]], list[str]], tries: int = TRIES, batch: int = BATCH) -> DataFrame:
    """query_id, reply and error of every prompt (query_id, prompt), by an injected model, in batches that are tried again as ``embed_chunks`` does; after the last try a batch's prompts have no reply and an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                replies, error = [None] * len(some), None
                for _ in range(tries):
                    try:
                        replies, error = list(model(some["prompt"].tolist())), None
                        break
                    except Exception as e:  # a failed batch is a result
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"query_id": some["query_id"], "reply": replies, "error": error})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, reply string, error string")


def payloads(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id and what an index keeps beside its vector: the chunk's place and its document's metadata, with DEFAULTS for what is missing; columns that ``documents`` doesn't have are null."""
    fields = [part.strip().split(" ", 1) for part in re.split(r",(?![^<]*>)", OF_DOCUMENT)]
    given = {n: F.col(n).cast(t) if n in documents.columns else F.lit(None).cast(t) for n, t in fields} | {"law": known(F.col("law"), LAWS, "Other")}
    d = documents.select("document_id", *(c.alias(n) for n, c in given.items()))
    rows = chunks.drop(*given).join(d, "document_id", "left")
    or_default = lambda c: F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c)
    return rows.select("chunk_id", "document_id", or_default("chunk_type"), "chunk_index", "content_length", "page_number", "section_ref", "subsection_ref", *map(or_default, given))


def ingest_folder(spark: SparkSession, folder: str, known_documents: DataFrame | None = None, manifest: DataFrame | None = None, readers: dict = files_of.READERS) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of the files below ``folder`` whose names ``known_documents`` (original_filename) does not have."""
    found = files_of.find_files(spark, folder)
    if known_documents is not None:
        found = files_of.not_yet_read(found, known_documents)
    parsed = files_of.parse_files(found, readers)
    parsed = parsed if manifest is None else files_of.with_urls(parsed, manifest, folder)
    documents = files_of.to_documents(parsed)
    return documents, chunk_documents(documents.select("document_id", "text", F.col("page_map").alias("pages")))


def report(files: DataFrame, documents: DataFrame, embedded: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: files in all, ingested, partial (some chunk has no vector), failed, skipped, chunks, and documents without a source_url."""
    per = embedded.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("error").isNotNull()).alias("lost"))
    rows = documents.select("document_id", "method", "source_url").join(per, "document_id", "left").na.fill(0, ["chunks", "lost"])
    read = F.col("method") != "failed"
    sums = rows.agg(F.count_if(read).alias("ingested"), F.count_if(read & (F.col("lost") > 0)).alias("partial"), F.count_if(~read).alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"), F.count_if(F.col("source_url").isNull()).alias("documents_without_source_url"))
    return files.agg((F.count("*") + skipped).alias("total_files")).crossJoin(F.broadcast(sums.withColumn("skipped", F.lit(skipped))))  # one row each


def judgment_parts(judgments: DataFrame) -> DataFrame:
    """document_id, position, chunk_type and content of the marked parts of judgments (document_id, text); null and empty texts give none."""
    return judgments.where("text <> ''").select("document_id", F.posexplode(chunking.judgment_parts(F.col("text"))).alias("position", "p")).select("document_id", "position", "p.*")


def summary_windows(documents: DataFrame, size: int = 12_000, overlap: int = 500) -> DataFrame:
    """document_id, window and text: long texts in windows of whole sentences for a summary of each, to be merged by ``summary.merge``."""
    cut = F.udf(lambda s: windows([x for x in s if x], size, overlap) if s is not None else [], "array<string>", useArrow=True)
    return documents.select("document_id", F.posexplode(cut(summary_sentences(F.coalesce("text", F.lit(""))))).alias("window", "text"))
