"""Summaries of a document's chunks: text by kind, sections discussed, merging of partial summaries, evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The summary's field for each kind of chunk.
FIELDS = {"facts": "facts", "issues": "issues", "arguments": "arguments", "findings": "findings", "ratio": "ratio_decidendi", "final_order": "final_order"}


def by_kind(chunks: DataFrame) -> DataFrame:
    """document_id and a column for each field: its chunks in order, a blank line between them; null without any."""
    rows = chunks.where(F.col("chunk_type").isin(*FIELDS)).groupBy("document_id", "chunk_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n").alias("text"))
    return rows.groupBy("document_id").agg(*(F.max(F.when(F.col("chunk_type") == kind, F.col("text"))).alias(field) for kind, field in FIELDS.items()))


def sections_discussed(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.sort_array(F.collect_set("section_ref")).alias("sections"))


def issue_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+|\d+\.\s+"), lambda s: F.trim(s)), lambda s: s != "")


def merge(parts: DataFrame) -> DataFrame:
    """One summary for each document_id of partial ones (position, facts, findings, ratio, issues, final_order).

    Texts are joined by blank lines, issues are distinct and at most ten, the last final order holds; without any, facts, findings and order say
    'Not extracted.'
    """
    rows = parts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "facts", "findings", "ratio", "issues", "final_order"))).alias("p"))
    given = lambda f: F.filter(F.transform("p", lambda x: x[f]), lambda v: v.isNotNull() & (v != ""))
    joined = lambda f: F.nullif(F.array_join(given(f), "\n\n"), F.lit(""))
    none = F.lit("Not extracted.")
    issues = F.array_distinct(F.flatten(F.transform("p", lambda x: F.coalesce(x["issues"], F.array().cast("array<string>")))))
    order = F.when(F.size(given("final_order")) > 0, F.element_at(given("final_order"), -1)).otherwise(none)
    return rows.select("document_id", F.coalesce(joined("facts"), none).alias("facts"), F.coalesce(joined("findings"), none).alias("findings"), joined("ratio").alias("ratio_decidendi"), F.slice(issues, 1, 10).alias("issues"), order.alias("final_order"))


def draft_confidence(sources: Column, most: int = 6) -> Column:
    """0.2 without sources, else 0.3 and up to 0.3 more by their share of ``most``, at most 0.6."""
    return F.when(sources > 0, F.least(F.lit(0.6), 0.3 + 0.3 * sources / most)).otherwise(0.2)


def hit(expected: Column, got: Column) -> Column:
    """Whether an expected section is part of one found; no expectation is met."""
    return (F.size(expected) == 0) | F.exists(expected, lambda e: F.exists(got, lambda g: F.contains(g, e)))


def quantile(values: Column, n: int, i: int) -> Column:
    """Cut point i of n by the exclusive method over an array (unsorted); its largest with under five values."""
    v, m = F.array_sort(values), F.size(values)
    place = i * (m + 1)
    low = F.greatest(F.lit(1), F.least(F.floor(place / n).cast("int"), m - 1))
    rest = place - low * n
    cut = (F.element_at(v, low) * (n - rest) + F.element_at(v, low + 1) * rest) / n
    return F.when(m >= 5, cut).otherwise(F.array_max(v))


def evaluation(results: DataFrame) -> DataFrame:
    """section_hit_rate, intent_accuracy, confidence_rate, p50_ms and p95_ms of rows with the booleans section_hit, intent_correct and confident, and latency_ms.

    Latencies of one evaluation run are few, so they are gathered.
    """
    rate = lambda c: F.avg(F.col(c).cast("double"))
    rows = results.agg(rate("section_hit").alias("section_hit_rate"), rate("intent_correct").alias("intent_accuracy"), rate("confident").alias("confidence_rate"), F.median("latency_ms").alias("p50_ms"), F.collect_list("latency_ms").alias("all"))
    return rows.select("section_hit_rate", "intent_accuracy", "confidence_rate", "p50_ms", quantile(F.col("all"), 20, 19).alias("p95_ms"))
