"""Tables (as DDL, which every reader takes for a schema) and closed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed sets of the data model.
DOCUMENT_TYPES = ("judgment", "statute", "notification", "circular", "upload")
LAWS = ("BNS", "BNSS", "BSA", "IPC", "CrPC", "Constitution", "Other")
COURTS = ("Supreme Court", "High Court", "District Court", "Tribunal", "Other")
CHUNK_TYPES = ("facts", "issues", "arguments", "findings", "ratio", "final_order", "chapter", "section", "subsection", "explanation", "punishment", "passage")
INTENTS = ("provision_lookup", "case_search", "procedure_query", "drafting_request", "summarization", "general_query")
DRAFT_TYPES = ("bail_application", "anticipatory_bail", "legal_notice", "affidavit", "complaint", "fir_quashing_petition", "written_statement", "vakalatnama")
USER_ROLES = ("admin", "advocate", "researcher", "student", "guest")
RETRIEVAL_PATHS = ("exact_lookup", "bm25", "vector", "hybrid", "document_fts")

DOCUMENTS = (
    "document_id string, document_type string, law string, court string, court_name string, case_number string, citation string, "
    "year int, date_decided timestamp, bench array<string>, parties map<string,string>, topic string, keywords array<string>, source_url string, "
    "original_filename string, is_landmark boolean, language string, pages int, uploaded_by string, created_at timestamp, updated_at timestamp, indexed_chunk_count int"
)
CHUNKS = (
    "chunk_id string, document_id string, chunk_type string, content string, content_length int, chunk_index int, page_number int, "
    "section_ref string, subsection_ref string, law string, created_at timestamp"
)
STAGED_CHUNKS = ("chunk_id string, document_id string, embedding array<float>, metadata map<string,string>, indexed boolean, processing boolean, created_at timestamp")
SESSIONS = ("session_id string, user_id string, title string, law_filter array<string>, created_at timestamp, updated_at timestamp")
MESSAGES = (
    "message_id string, session_id string, role string, content string, citations array<struct<document_id:string,chunk_id:string,citation_text:string,verified:boolean>>, "
    "hallucination_flags array<string>, confidence double, latency_ms double, created_at timestamp"
)
CACHE = ("key string, embedding array<float>, law_filter array<string>, query string, result string, cached_at timestamp")


def known(value: Column, values: tuple[str, ...], default: str | None) -> Column:
    """The member of ``values`` that equals ``value`` without regard to case, else ``default``."""
    found = F.lit(default)
    for v in reversed(values):
        found = F.when(F.lower(value) == v.lower(), F.lit(v)).otherwise(found)
    return found
