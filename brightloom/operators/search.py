"""A batch of queries from text to context: understanding, the three searches under each query's own filters, gate, fusion, rerank, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.query import LAW_WORDS, expand_synonyms, understand, vector_gate
from brightloom.functions.vectors import embed
from brightloom.operators import batches, context, dense, fusion, held, lexical, summary

#: Lengths of a section's list, the lexical and the vector list, and of what is fused.
EXACT, LEXICAL, NEAR, FUSED = 10, 50, 30, 60


def fits(of: Callable[[str], Column] = F.col) -> Column:
    """Whether a chunk with law, court and year passes a query's law_filter, court_filter, year_from and year_to, which ``of`` gives; what a query leaves out holds."""
    one_of = lambda given, value: (F.coalesce(F.size(of(given)), F.lit(0)) <= 0) | F.coalesce(F.array_contains(of(given), F.col(value)), F.lit(False))
    since = of("year_from").isNull() | F.coalesce(F.col("year") >= of("year_from"), F.lit(False))
    until = of("year_to").isNull() | F.coalesce(F.col("year") <= of("year_to"), F.lit(False))
    return one_of("law_filter", "law") & one_of("court_filter", "court") & since & until


def asked_for(queries: DataFrame, law_words: tuple = LAW_WORDS) -> DataFrame:
    """``queries`` with the filters that hold: what a caller gives (columns given_laws, given_courts, given_year_from, given_year_to, where there are any) before what the text implies."""
    rows = understand(queries, law_words=law_words)
    for given, derived in (("given_laws", "law_filter"), ("given_courts", "court_filter"), ("given_year_from", "year_from"), ("given_year_to", "year_to")):
        if given in queries.columns:
            filled = F.size(given) > 0 if derived.endswith("filter") else F.col(given) > 0
            rows = rows.withColumn(derived, F.when(F.coalesce(filled, F.lit(False)), F.col(given)).otherwise(F.col(derived)))
    return rows


def retrieve(
    corpus: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, model: Callable | None = None, dim: int = 0, k: int = 6, index: lexical.Index | None = None, full_text: bool = False, reranker: Callable | None = None, law_words: tuple = LAW_WORDS, codes: DataFrame | None = None
) -> DataFrame:
    """The k best chunks of each query (query_id, query), with their columns, score, final_score and final_rank.

    ``corpus`` has the chunks' columns with their documents' law, court and year. Filters that a query's caller gives, else those that its text implies, act before every
    limit. The ranked tier is BM25 over ``index`` (which carries law, court and year; made of the corpus where none is given) or, with ``full_text``, its web-search match of the query with
    its synonyms by cover density. Vectors (chunk_id, embedding; with law, court and year as the index has them they need no join) are searched for the queries that pass the gate, by what ``model`` makes of the
    query's text; with ``codes`` (as ``dense.write_vectors`` stores them) only vectors whose bounds leave them are read. ``reranker`` scores pairs of query and content; without it the fused score is final. The queries of a batch are bounded; the sections and words that they name are not. The batch's exact
    and ranked lists, of a fixed length for each section and query, are stored, as several steps read them.
    """
    asked = held.batch(asked_for(queries, law_words).select("query_id", "query", "section_refs", "law_filter", "court_filter", "year_from", "year_to"))
    filters = F.broadcast(asked.select("query_id", "law_filter", "court_filter", "year_from", "year_to"))
    index = lexical.index(corpus, carry=("law", "court", "year")) if index is None else index
    sections = asked.select("query_id", F.explode("section_refs").alias("section"), "law_filter", "court_filter", "year_from", "year_to")
    exact = lexical.exact_sections(index.live(index.keys), sections, EXACT, pair=fits()).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    exact = held.hold(exact, "exact")
    spelt = expand_synonyms(F.col("query"))
    meta = index.live(index.chunks).select("chunk_id", "law", "court", "year")
    # Filters are decided once for each combination of metadata; where there are too many of them, for each row.
    decided = None if full_text and vectors is None else batches.allowed(meta, ["law", "court", "year"], asked.drop("query", "section_refs"), fits)
    allowed = lambda scored: (scored if "law" in scored.columns else scored.join(meta, "chunk_id")).join(filters, "query_id").where(fits()).select("query_id", "chunk_id", "score")
    if full_text:
        found = lexical.websearch(index, asked.select("query_id", spelt.alias("query"))).withColumnRenamed("rank", "score")
        ranked = lexical.top_k(allowed(found), LEXICAL, "score")
    else:
        words = asked.select("query_id", F.regexp_replace(spelt, r'"|\bOR\b', " ").alias("query"))
        ranked = lexical.bm25_allowed(index, words, LEXICAL, decided) if decided else None
        ranked = lexical.bm25(index, words, LEXICAL, allowed) if ranked is None else ranked
    ranked = held.hold(ranked, "ranked")
    lists = [(exact, 2.0), (ranked, 0.55)]
    if vectors is not None:
        hits = fusion.keep_first([exact, ranked]).groupBy("query_id").agg(F.count_if(F.col("tier") == 0).alias("exact"), F.count("*").alias("all"))
        gated = asked.join(hits, "query_id", "left").na.fill(0, ["exact", "all"]).where(vector_gate(F.col("exact"), F.col("all"), F.col("query")))
        gated = gated.withColumn("embedding", embed(F.col("query"), model, dim)).drop("query", "section_refs", "exact", "all")
        known = lambda rows: rows if {"law", "court", "year"} <= set(rows.columns) else rows.join(meta, "chunk_id")
        if codes is not None:
            near = dense.coded_search(known(codes), vectors, gated, NEAR, 0.25, fits=fits)
        elif decided:
            near = dense.scan_search(known(vectors), gated, decided, NEAR, 0.25)
        else:
            near = dense.vector_search(known(vectors), gated, NEAR, 0.25, pair=fits())
        lists.append((near, 0.45))
    fused = fusion.rrf(lists, FUSED).join(exact.select("query_id", "chunk_id", F.lit(True).alias("exact")), ["query_id", "chunk_id"], "left").na.fill(False, ["exact"])
    of = lambda rows, *columns: corpus.select(*columns or "*").join(held.small(held.hold(rows, "candidates")), "chunk_id")  # noqa: E731  rows of a bounded number a query go to the corpus, which stays where it is
    if reranker is None:
        return of(fusion.rerank(fused, k, raw=None))
    pairs = of(fused, "chunk_id", "content").join(F.broadcast(asked.select("query_id", "query")), "query_id")
    return of(fusion.rerank(pairs.withColumn("raw", fusion.score_pairs(F.col("query"), F.col("content"), reranker)), k))


def retrieve_multi(corpus: DataFrame, queries: DataFrame, k: int = 10, cut: int = 40, reranker: Callable | None = None, **settings) -> DataFrame:
    """query_id, chunk_id, score, final_score and final_rank of each query's k best chunks over its first three sub-queries (query_id, sub_query, query and any given filters).

    Sub-queries are retrieved as queries of their own, with the caller's filters; those without text, or of which nothing is found, are left out. Their lists are fused by reciprocal ranks with equal weight, and the ``cut`` best of that
    are reranked against the query's first sub-query that is left; a single list that is left stays as it is.
    """
    first = Window.partitionBy("query_id").orderBy("sub_query")
    asked = queries.where(F.length(F.trim("query")) > 0).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 3)
    asked = held.batch(asked.drop("_n").withColumnRenamed("query_id", "_query").withColumn("query_id", F.struct("_query", "sub_query")))
    found = held.hold(retrieve(corpus, asked.drop("_query", "sub_query"), k=k, reranker=reranker, **settings).select("query_id", "chunk_id", "final_score", F.col("final_rank").alias("rank")), "sub-queries")
    lists = found.select(F.col("query_id._query").alias("query_id"), F.col("query_id.sub_query").alias("sub_query"), "chunk_id", F.col("final_score").alias("score"), "rank", F.lit("").alias("source"))
    fused = fusion.multi_query(lists, cut).drop("source")
    n = lists.groupBy("query_id").agg(F.count_distinct("sub_query").alias("lists"), F.min("sub_query").alias("first"))
    rows = fused.join(n, "query_id")
    if reranker is None:
        final = F.col("score")
    else:
        text = asked.select(F.col("_query").alias("query_id"), F.col("sub_query").alias("first"), "query")
        rows = rows.join(F.broadcast(text), ["query_id", "first"]).join(corpus.select("chunk_id", "content"), "chunk_id")
        rows = fusion.min_max(rows.withColumn("norm", F.col("score")), "norm").withColumn("raw", fusion.score_pairs(F.col("query"), F.col("content"), reranker))
        final = F.when(F.col("lists") == 1, F.col("score")).otherwise(0.7 * fusion.sigmoid(F.col("raw")) + 0.3 * F.col("norm"))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank", "chunk_id")
    rows = rows.withColumn("final_score", final).withColumn("final_rank", F.row_number().over(order))
    return rows.where(F.col("final_rank") <= k).select("query_id", "chunk_id", "score", "final_score", "final_rank")


def evaluate(golden: DataFrame, retrieved: DataFrame, records: DataFrame) -> DataFrame:
    """section_hit_rate, intent_accuracy, confidence_rate, p50_ms and p95_ms of a golden set.

    ``golden`` (query_id, expected_sections, expected_intent, min_confidence), ``retrieved`` (query_id, section_ref) and ``records`` (query_id, intent,
    confidence, latency_ms). A query of which nothing was retrieved counts as missed unless it expects no section.
    """
    got = retrieved.where("section_ref is not null").groupBy("query_id").agg(F.collect_set("section_ref").alias("got"))
    rows = golden.join(got, "query_id", "left").join(records, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    met = lambda c: F.coalesce(c, F.lit(False))
    return summary.evaluation(rows.select(met(summary.hit(F.coalesce("expected_sections", F.array().cast("array<string>")), F.col("got"))).alias("section_hit"), met(F.col("intent") == F.col("expected_intent")).alias("intent_correct"), met(F.col("confidence") >= F.col("min_confidence")).alias("confident"), "latency_ms"))


def contexts(retrieved: DataFrame, k: int = 6, tokens_a_chunk: int = 600) -> DataFrame:
    """query_id, context and blocks: the retrieved chunks without repeated contents, under their headers, within the budget."""
    rows = retrieved.withColumn("header", context.header()).withColumn("rank", F.col("final_rank"))
    return context.pack(context.deduplicate(rows), max_tokens=k * tokens_a_chunk)


def extract_answers(retrieved: DataFrame) -> DataFrame:
    """query_id and answer: a stand-in for a language model that quotes the first sentence of each query's best chunk with its tag."""
    best = retrieved.where("final_rank = 1")
    first = F.element_at(F.split("content", "(?<=[.!?])\\s+"), 1)
    return best.select("query_id", F.concat(first, F.lit(" <CHUNK:"), F.substring("chunk_id", 1, 8), F.lit(">")).alias("answer"))
