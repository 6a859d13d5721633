"""Browsing and monitoring a corpus: filters, listings, statistics, progress, sessions, deep links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metadata_filter(laws: list[str] | None = None, courts: list[str] | None = None, year_from: int | None = None, year_to: int | None = None, document_type: str | None = None) -> Column:
    """All the given conditions; a missing or empty one holds for every row."""
    terms = [F.lit(True)]
    terms += [F.col("law").isin(laws)] if laws else []
    terms += [F.col("court").isin(courts)] if courts else []
    terms += [F.col("year") >= year_from] if year_from else []
    terms += [F.col("year") <= year_to] if year_to else []
    terms += [F.col("document_type") == document_type] if document_type else []
    return reduce(lambda a, b: a & b, terms)


def search_filter(term: str | None) -> Column:
    """Citation, case number or court name holds the term, without regard to case; % and _ in it stand for anything."""
    return F.lit(True) if not term else reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in ("citation", "case_number", "court_name")))


def text_filter(term: str | None) -> Column:
    """Citation, topic or a party's name (a map ``parties``, where there is one) holds the term, without regard to case."""
    low = (term or "").lower()
    return F.lit(True) if not low else reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False)) for c in (F.col("citation"), F.col("topic"), F.array_join(F.map_values("parties"), " "))))


def debug_view(retrieved: DataFrame, digits: int = 4, preview: int = 200) -> DataFrame:
    """Retrieved rows for inspection: short ids, rounded scores and the beginning of the content."""
    scores = {c: F.round(c, digits) for c in retrieved.columns if c.endswith("score")}
    short = {c: F.left(c, F.lit(8)) for c in ("chunk_id", "document_id") if c in retrieved.columns}
    return retrieved.withColumns({**scores, **short, "content_preview": F.left("content", F.lit(preview))}).drop("content")


def access_url(source_url: Column, document_id: Column) -> Column:
    return F.coalesce(source_url, F.concat(F.lit("/api/v1/documents/"), document_id, F.lit("/view")))


def deep_link(source_url: Column, page: Column, page_needed: bool = True) -> Column:
    """url#page=n; null without a url, and without a page if one is needed."""
    bare = F.lit(None).cast("string") if page_needed else source_url
    return F.when(page > 0, F.concat(source_url, F.lit("#page="), page.cast("string"))).otherwise(bare)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("total_chunks"))


def listing(documents: DataFrame, chunks: DataFrame, page: int = 1, page_size: int = 20, order: tuple[Column, ...] = ()) -> DataFrame:
    """One page of ``documents``, newest first, with the number of chunks; only the page's documents' chunks are counted."""
    order = order or (F.col("created_at").desc(), F.col("document_id"))
    rows = documents.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    counts = chunk_counts(chunks.join(F.broadcast(rows.select("document_id")), "document_id", "left_semi"))  # a page at most
    return rows.join(counts, "document_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))


def table_stats(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("total"), F.count_distinct("law").alias("laws"), F.count_distinct("court").alias("courts"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total"), F.round(F.avg("content_length")).cast("int").alias("avg_length"), F.count_distinct("document_id").alias("documents"))


def chunk_type_distribution(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("content_length").alias("chars"))


def type_histogram(chunks: DataFrame) -> DataFrame:
    """document_id and a map of chunk type to count."""
    counts = chunks.groupBy("document_id", "chunk_type").agg(F.count("*").alias("n"))
    return counts.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_type", "n")))).alias("types"))


def row_counts(**tables: DataFrame) -> DataFrame:
    """table and n for each table given."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()))


def viewer(chunks: DataFrame, document_id: str, chunk_type: str | None = None, limit: int = 100) -> DataFrame:
    rows = chunks.where(F.col("document_id") == document_id)
    return (rows.where(F.col("chunk_type") == chunk_type) if chunk_type else rows).orderBy("chunk_index").limit(max(1, min(limit, 1000)))


def full_texts(chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """document_id and its chunks in order, a blank line between them; with ``titles`` (document_id, title) under the title and a line of equal signs as long as it."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    texts = chunks.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda c: c["content"]), "\n\n").alias("full_text"))
    if titles is None:
        return texts
    head = F.concat(F.col("title"), F.lit("\n"), F.repeat(F.lit("="), F.length("title")), F.lit("\n\n"))
    return texts.join(titles.select("document_id", "title"), "document_id", "left").select("document_id", F.concat(F.coalesce(head, F.lit("")), F.col("full_text")).alias("full_text"))


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """All chunks of every document in their order, without limit: sorted within partitions by document, so that writers and readers can stream them."""
    return chunks.repartition("document_id").sortWithinPartitions("document_id", "chunk_index")


def progress(documents: DataFrame, chunks: DataFrame, staged: DataFrame) -> DataFrame:
    """document_id, chunk and staged counts, indexed_chunk_count and stage: parsing, complete, embedding or indexing, in this order of tests."""
    rows = documents.select("document_id", "indexed_chunk_count").join(chunk_counts(chunks), "document_id", "left")
    rows = rows.join(staged.groupBy("document_id").agg(F.count("*").alias("staged")), "document_id", "left").na.fill(0)
    stage = F.when(F.col("total_chunks") == 0, "parsing").when(F.col("indexed_chunk_count") >= F.col("total_chunks"), "complete").when(F.col("staged") + F.col("indexed_chunk_count") < F.col("total_chunks"), "embedding").otherwise("indexing")
    return rows.withColumn("stage", stage)


def backfill_counts(chunks: DataFrame, staged: DataFrame) -> DataFrame:
    """Chunk counts of the documents of which nothing is staged."""
    return chunk_counts(chunks.join(staged.select("document_id").distinct(), "document_id", "left_anti"))


def messages_of(messages: DataFrame, sessions: DataFrame, user: Column) -> DataFrame:
    """Messages, oldest first, of the sessions that belong to the user."""
    return messages.join(sessions.where(user), "session_id", "left_semi").orderBy("session_id", "created_at")


def last_turns(messages: DataFrame, n: int = 6) -> DataFrame:
    """The n most recent turns of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def missing_parts(total: Column, part: int, received: Column) -> Column:
    """Starts of the parts of an upload of ``total`` bytes that are not among those received."""
    return F.array_sort(F.array_except(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(part).cast("long")), received))


def active_user(users: DataFrame, email: str) -> DataFrame:
    return users.where((F.lower(F.trim("email")) == email.strip().lower()) & F.col("is_active"))
