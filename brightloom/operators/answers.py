"""From retrieved chunks to final records: mapped sections, prompts, drafts, assembled answers, events and stored turns.

Everything is keyed by query_id, so that a batch of queries is one job. What a language model would write is a column that the caller brings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.operators import grounding

# The intents whose sections are mapped before an answer is written.
MAPPED_INTENTS = ("provision_lookup", "procedure_query", "drafting_request")


def parse_json(raw: Column, ddl: str) -> Column:
    """A model's reply as a struct: fences off, then the whole text, else what stands from the first { to the last }; null if neither is JSON."""
    clean = F.trim(F.regexp_replace(raw, r"```(?:json)?\s*|\s*```", ""))
    inner = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    whole = F.when(F.try_parse_json(clean).isNotNull(), clean)
    part = F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)
    return F.from_json(F.coalesce(whole, part), ddl)


def validate_sections(proposed: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``proposed`` (query_id, section_number, citation_chunk_id) with valid: whether its chunk or its section was retrieved for the query.

    A chunk counts by the first eight characters of its id, a section by its number without regard to case.
    """
    ids = retrieved.select("query_id", F.substring("chunk_id", 1, 8).alias("_id")).distinct()
    refs = retrieved.where("section_ref is not null").select("query_id", F.lower("section_ref").alias("_ref")).distinct()
    rows = proposed.withColumn("_id", F.substring(F.coalesce("citation_chunk_id", F.lit("")), 1, 8)).withColumn("_ref", F.lower("section_number"))
    rows = rows.join(ids.withColumn("_by_id", F.lit(True)), ["query_id", "_id"], "left").join(refs.withColumn("_by_ref", F.lit(True)), ["query_id", "_ref"], "left")
    return rows.select(*proposed.columns, (F.coalesce("_by_id", F.lit(False)) | F.coalesce("_by_ref", F.lit(False))).alias("valid"))


def narrow(retrieved: DataFrame, validated: DataFrame, intents: DataFrame) -> DataFrame:
    """``retrieved`` without chunks of sections that were not validated, for queries whose intent is mapped.

    Chunks without a section stay. A query with no validated section, or of which nothing would be left, keeps all its chunks.
    """
    refs = validated.where("valid").select("query_id", F.lower(F.trim("section_number")).alias("_ref")).where("_ref <> ''").distinct()
    mapped = intents.where(F.col("intent").isin(*MAPPED_INTENTS)).select("query_id").join(refs.select("query_id").distinct(), "query_id", "left_semi").withColumn("_mapped", F.lit(True))
    ref = F.lower(F.trim(F.coalesce("section_ref", F.lit(""))))
    rows = retrieved.withColumn("_ref", ref).join(refs.withColumn("_hit", F.lit(True)), ["query_id", "_ref"], "left").join(mapped, "query_id", "left")
    rows = rows.withColumn("_keep", F.coalesce("_hit", F.lit(False)) | (F.coalesce("section_ref", F.lit("")) == ""))
    some = F.max("_keep").over(Window.partitionBy("query_id"))
    return rows.withColumn("_some", some).where(F.col("_mapped").isNull() | F.col("_keep") | ~F.col("_some")).select(*retrieved.columns)


def prompts(contexts: DataFrame, history: DataFrame, turns: int = 6, templates: dict[str, str] | None = None) -> DataFrame:
    """query_id and prompt: the last turns of a conversation (query_id, turn, role, content), if there are any, before context and query.

    ``contexts`` has query_id, query, context and, if there are ``templates``, intent. A query without sources says so. A template is the caller's text for an intent, in which {context}, {query} and
    {history} are filled in; an intent without one takes that of general_query, if there is one.
    """
    recent = Window.partitionBy("query_id").orderBy(F.desc("turn"))
    said = history.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= turns)
    line = F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.coalesce("content", F.lit(""))).alias("line"))
    past = said.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("_past"))
    body = F.concat(F.lit("SOURCES:\n"), F.coalesce(F.nullif("context", F.lit("")), F.lit("No relevant sources found.")), F.lit("\n\nQUERY:\n"), F.col("query"))
    before = F.when(F.col("_past").isNotNull(), F.concat(F.lit("CONVERSATION HISTORY:\n"), F.col("_past"), F.lit("\n\n"))).otherwise("")
    prompt = F.concat(before, body)
    if templates:
        given = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
        template = F.coalesce(F.try_element_at(given, F.col("intent")), F.try_element_at(given, F.lit("general_query")))
        sources = F.coalesce(F.nullif("context", F.lit("")), F.lit("No relevant sources found."))
        # The query goes in last, so that braces in what is filled in are left alone but for the query's own mark.
        filled = F.replace(F.replace(F.replace(template, F.lit("{history}"), F.coalesce("_past", F.lit(""))), F.lit("{context}"), sources), F.lit("{query}"), F.col("query"))
        prompt = F.when(template.isNotNull(), filled).otherwise(prompt)
    return contexts.join(past, "query_id", "left").select("query_id", prompt.alias("prompt"))


def draft_context(retrieved: DataFrame, most: int = 6) -> DataFrame:
    """query_id and context: each of the first chunks under its tag, law and section, and citation."""
    head = F.concat(F.lit("<CHUNK:"), F.substring("chunk_id", 1, 8), F.lit("> ["), F.trim(F.concat_ws(" ", F.coalesce("law", F.lit("")), F.coalesce("section_ref", F.lit("")))), F.lit("] ["), F.coalesce("citation", F.lit("")), F.lit("]\n"), F.col("content"))
    rows = retrieved.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("block")))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def fill_template(template: Column, values: Column) -> Column:
    """A draft's template with each [NAME] that the map ``values`` holds in place; others stay for the advocate to fill."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("["), F.upper(e["key"]), F.lit("]")), F.coalesce(e["value"], F.lit(""))))


def response(answers: DataFrame, retrieved: DataFrame, verified: DataFrame) -> DataFrame:
    """One record for each query: answer without what failed or marks chunks, confidence and its parts, citations, flags and warnings.

    ``answers`` has query_id, answer, intent and law_filter; ``retrieved`` query_id, rank, document_id and final_score; ``verified`` is what
    ``grounding.verify`` returns with query_id as answer_id.
    """
    top = retrieved.where(F.col("rank") <= 5).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "final_score"))), lambda x: x["final_score"]).alias("scores"),
        F.count_distinct("document_id").cast("int").alias("documents"),
    )
    n = retrieved.groupBy("query_id").agg(F.count("*").cast("int").alias("chunks"))
    of = lambda status, what: F.array_sort(F.collect_list(F.when(F.col("status") == status, what)))
    checked = verified.groupBy(F.col("answer_id").alias("query_id")).agg(
        of("verified", F.struct("claim_id", F.col("raw_text").alias("citation_text"), "chunk_id", "document_id")).alias("citations"),
        of("flagged", F.col("raw_text")).alias("flags"),
    )
    rows = answers.join(top, "query_id", "left").join(n, "query_id", "left").join(checked, "query_id", "left")
    flags, scores = F.coalesce("flags", F.array().cast("array<string>")), F.coalesce("scores", F.array().cast("array<double>"))
    n_verified = F.coalesce(F.size("citations"), F.lit(0))
    rows = rows.withColumns({"flags": flags, "scores": scores, "n_verified": F.when(n_verified > 0, n_verified).otherwise(0), "documents": F.coalesce("documents", F.lit(0)), "chunks": F.coalesce("chunks", F.lit(0))})
    c = grounding.confidence(F.col("scores"), F.col("documents"), F.col("n_verified"), F.size("flags"))
    return rows.select(
        "query_id",
        "intent",
        grounding.strip_tags(grounding.strip_flagged(F.col("answer"), F.col("flags"))).alias("answer"),
        c["confidence"].alias("confidence"),
        c["band"].alias("band"),
        "citations",
        F.col("flags").alias("hallucination_flags"),
        grounding.warnings(F.size("flags"), F.element_at("scores", F.when(F.size("scores") > 0, 1)), F.col("intent"), F.col("law_filter"), F.col("chunks")).alias("warnings"),
    )


def word_events(answers: DataFrame) -> DataFrame:
    """query_id, position and piece: an answer split at blanks into what a client would be sent, every piece but the first with its blank."""
    rows = answers.select("query_id", F.posexplode(F.split("answer", " ")).alias("position", "word"))
    return rows.select("query_id", "position", F.when(F.col("position") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), F.col("word"))).alias("piece"))


def total_latency(timings: DataFrame) -> DataFrame:
    """query_id, a map of summed milliseconds by step, and total_ms of them without the totals among them (query_id, step, ms)."""
    sums = timings.groupBy("query_id", "step").agg(F.sum("ms").alias("ms"))
    counted = F.when(~F.col("step").isin("total_ms", "retrieve_total_ms"), F.col("ms"))
    return sums.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "ms")))).alias("latency_ms"), F.sum(counted).alias("total_ms"))


def store_turns(sessions: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions after ``turns`` (session_id, user_id, message, answer, at), and the two messages of each turn.

    A known session only gets a new updated_at; a new one is titled by the first 80 characters of its first message.
    """
    first = turns.groupBy("session_id").agg(F.min_by("user_id", "at").alias("user_id"), F.trim(F.left(F.min_by("message", "at"), F.lit(80))).alias("title"), F.min("at").alias("created_at"), F.max("at").alias("_last"))
    known = sessions.join(first.select("session_id", "_last"), "session_id", "left").withColumn("updated_at", F.coalesce("_last", "updated_at")).select(*sessions.columns)
    new = first.join(sessions.select("session_id"), "session_id", "left_anti").withColumn("updated_at", F.col("_last")).drop("_last")
    said = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    messages = turns.select("session_id", F.col("at").alias("created_at"), said.alias("m")).select("session_id", "m.role", "m.content", "created_at")
    return known.unionByName(new, allowMissingColumns=True), messages
