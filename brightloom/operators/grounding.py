"""Grounding: claims in an answer, their verification, stripping of what fails, confidence, assembled lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.operators.catalog import deep_link

# What marks claims and tags, and which names of laws stand for each other.
SECTION_CLAIM = r"(?i)\b(?:section|sec\.?|s\.)\s*(\d+[A-Za-z]?)(?:\s*\([^)]+\))*(?:\s+(?:of\s+)?(?:the\s+)?)?(?:(BNSS|BNS|BSA|IPC|CrPC|Constitution)\b)?"
RAW_SECTION_CLAIM = r"(?i)(?:section|sec\.?|s\.)\s*(\d+[A-Za-z]?)(?:\s*\([^)]+\))*(?:\s+(?:of\s+)?(?:the\s+)?)?(BNS|BNSS|BSA|IPC|CrPC|Constitution)?"
JUDGMENT_CLAIM = r"(?i)(?:AIR\s+\d{4}\s+\w+\s+\d+|\(\d{4}\)\s+\d+\s+SCC\s+\d+|\b\d{4}\s+[A-Za-z]\w*\s+\d+)"
RAW_JUDGMENT_CLAIM = r"(?i)(?:AIR\s+\d{4}\s+\w+\s+\d+|\(\d{4}\)\s+\d+\s+SCC\s+\d+|\d{4}\s+\w+\s+\d+)"
TAG = r"(?i)<CHUNK:([a-f0-9]{4,8})>"
ALIASES = {"BNS": ("BNS", "IPC"), "BNSS": ("BNSS", "CRPC"), "BSA": ("BSA", "EVIDENCE ACT"), "IPC": ("IPC", "BNS")}
CHECKABLE = (r"(?i)\b(?:section|§|article|rule)\s+\d+", r"\b(?:BNS|BNSS|BSA|IPC|CrPC|Constitution)\b", r"\b(?:AIR|SCC|SCR)\s+\d{4}\b", r"(?i)\b\d{1,3}\s+(?:days|months|years|hours)\b")


def strip_tags(answer: Column) -> Column:
    return F.regexp_replace(answer, r"(?i)\s*<CHUNK:[a-f0-9]{4,8}>", "")


def needs_audit(answer: Column) -> Column:
    """Whether an answer, without tags, has 120 characters and something that can be checked."""
    clean = F.trim(strip_tags(answer))
    return (F.length(clean) >= 120) & reduce(lambda a, b: a | b, (clean.rlike(p) for p in CHECKABLE))


def unsupported(answer: Column, sentences: Column) -> Column:
    """Of sentences that a model names, those that stand in the answer word for word."""
    return F.filter(F.transform(sentences, lambda s: F.trim(s)), lambda s: (s != "") & F.contains(strip_tags(answer), s))


def _claims_of(answers: DataFrame, kind: str, pattern: str, law_group: bool) -> DataFrame:
    """Matches of one pattern with the tag nearest behind each, in 200 characters, else nearest before it."""
    mark = "\u0001"  # stands for a match while the text is split; an answer's own become blanks
    clean = answers.withColumn("answer", F.translate("answer", mark, " "))
    clean = clean.select("answer_id", "answer", F.regexp_extract_all("answer", F.lit(pattern), F.lit(0)).alias("hits"), F.split(F.regexp_replace("answer", pattern, mark), mark).alias("parts"))
    rows = clean.select("answer_id", "answer", "hits", "parts", F.posexplode("hits").alias("i", "raw"))
    size = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    start = size("parts", F.col("i") + 1) + size("hits", F.col("i"))
    after, before = F.substring("answer", start + F.length("raw") + 1, F.lit(200)), F.substring("answer", F.greatest(F.lit(1), start - 199), F.least(start, F.lit(200)))
    ahead, behind = F.regexp_extract_all(after, F.lit(TAG), F.lit(1)), F.regexp_extract_all(before, F.lit(TAG), F.lit(1))
    tag = F.when(F.size(ahead) > 0, F.element_at(ahead, 1)).when(F.size(behind) > 0, F.element_at(behind, -1))
    law = F.nullif(F.upper(F.regexp_extract("raw", pattern, 2)), F.lit("")) if law_group else F.lit(None).cast("string")
    section = F.regexp_extract("raw", pattern, 1) if law_group else F.lit(None).cast("string")
    return rows.select("answer_id", F.lit(kind).alias("claim_type"), "i", F.trim("raw").alias("raw_text"), law.alias("law"), section.alias("section_num"), F.when(F.lit(not law_group), F.trim("raw")).alias("citation"), F.lower(tag).alias("tag"))


def claims(answers: DataFrame, raw: bool = False) -> DataFrame:
    """claim_id and what each distinct claim of an answer (answer_id, answer) says, with the tag next after it, else next before it.

    Section claims are distinct by number and law, judgment claims by their text; the first of equals stays. ``raw`` uses the looser
    patterns, which take BNS for BNSS and any year, word and number for a citation.
    """
    rows = _claims_of(answers, "section", RAW_SECTION_CLAIM if raw else SECTION_CLAIM, True).unionByName(_claims_of(answers, "judgment", RAW_JUDGMENT_CLAIM if raw else JUDGMENT_CLAIM, False))
    same = Window.partitionBy("answer_id", "claim_type", F.coalesce("section_num", "citation"), F.coalesce("law", F.lit(""))).orderBy("i")
    rows = rows.withColumn("n", F.row_number().over(same)).where("n = 1")
    order = Window.partitionBy("answer_id").orderBy(F.desc("claim_type"), "i")
    return rows.withColumn("claim_id", F.row_number().over(order)).drop("n", "i")


def aliases(law: Column) -> Column:
    """The names, in capitals, that a claim's law may have in a chunk; without a law, none."""
    out = F.array(F.upper(law))
    for key, names in ALIASES.items():
        out = F.when(F.upper(law) == key, F.array(*map(F.lit, names))).otherwise(out)
    return out


def verify(claims: DataFrame, retrieved: DataFrame, knowledge: DataFrame, documents: DataFrame, fuzzy_any_law: bool = False) -> DataFrame:
    """claim columns, stage, chunk_id, document_id and status (verified, flagged, unchecked) of every claim.

    Stages in order: tag (the tagged chunk agrees with the claim), fuzzy (the best-ranked retrieved chunk with the section and a law that
    may stand for the claim's, or with the citation), base (any chunk of the knowledge base; for judgments any document). ``retrieved`` has answer_id,
    rank, chunk_id, document_id, section_ref, law, citation; ``knowledge`` chunk_id, document_id, section_ref, subsection_ref and law.
    ``fuzzy_any_law`` lets a retrieved chunk of any law do.
    """
    c = claims.withColumn("want", T.normal_claim_section(F.col("section_num"))).withColumn("cite", T.normal_citation(F.col("citation")))
    r = retrieved.select("answer_id", "rank", "chunk_id", "document_id", T.normal_claim_section(F.col("section_ref")).alias("has"), F.upper("law").alias("has_law"), T.normal_citation(F.col("citation")).alias("has_cite"))
    says = F.coalesce(F.col("want") == F.col("has"), F.lit(False)) | F.coalesce(F.col("cite") == F.col("has_cite"), F.lit(False))
    law_fits = F.lit(True) if fuzzy_any_law else F.col("law").isNull() | F.array_contains(aliases(F.col("law")), F.col("has_law"))
    pairs = c.join(r, "answer_id")
    hit = lambda rows, stage, order: rows.groupBy("answer_id", "claim_id").agg(F.min_by(F.struct("chunk_id", "document_id"), order).alias("at")).select("answer_id", "claim_id", F.lit(stage).alias("stage"), "at")
    tagged = hit(pairs.where((F.col("tag") == F.lower(F.substring("chunk_id", 1, 8))) & says), 0, -F.col("rank"))  # of equal short ids the last holds
    fuzzy = hit(pairs.where(says & (law_fits | F.col("want").isNull())), 1, F.col("rank"))
    k = knowledge.select("chunk_id", "document_id", "section_ref", "subsection_ref", F.upper("law").alias("has_law"))
    lawful = F.col("law").isNull() | F.array_contains(aliases(F.col("law")), F.col("has_law"))
    # Of all chunks of a section, as of a beginning or a citation, and a law the first is kept before claims are joined: pairs would grow with the square of the tables.
    first = lambda rows, *keys, order="chunk_id": rows.groupBy(*keys).agg(F.min_by(F.struct("chunk_id", "document_id"), order).alias("at")).select(*keys, "at.chunk_id", "at.document_id")
    exact = c.where("want is not null").join(first(k, "section_ref", "has_law"), (F.col("section_ref") == F.col("want")) & lawful).drop("section_ref")
    # A subsection is looked up by each of its beginnings, of which one is the number.
    begins = F.transform(F.sequence(F.lit(1), F.length("subsection_ref")), lambda n: F.lower(F.substring(F.col("subsection_ref"), F.lit(1), n)))
    starts = c.where("want is not null").withColumn("f", F.lower("want")).join(first(k.where("length(subsection_ref) > 0").withColumn("f", F.explode(begins)), "f", "has_law"), "f").where(lawful).drop("f")
    base = hit(exact.unionByName(starts.select(*exact.columns)), 2, F.col("chunk_id"))
    orders = knowledge.where("chunk_type = 'final_order'").groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id")) if "chunk_type" in knowledge.columns else knowledge.where("false").select("document_id", "chunk_id")
    cited = documents.select("document_id", T.normal_citation(F.col("citation")).alias("cite")).where("cite is not null").join(orders, "document_id", "left")
    judged = hit(c.where("cite is not null").join(first(cited, "cite", order="document_id"), "cite"), 2, F.col("document_id"))
    stages = reduce(DataFrame.unionByName, (tagged, fuzzy, base, judged)).groupBy("answer_id", "claim_id").agg(F.min(F.struct("stage", "at")).alias("x"))
    stage = F.element_at(F.array(F.lit("tag"), F.lit("fuzzy"), F.lit("base")), F.col("x.stage") + 1)
    status = F.when(F.col("x").isNotNull(), "verified").when(F.col("claim_type").isin("section", "judgment"), "flagged").otherwise("unchecked")
    return claims.join(stages, ["answer_id", "claim_id"], "left").select(*claims.columns, F.when(F.col("x").isNotNull(), stage).alias("stage"), "x.at.chunk_id", "x.at.document_id", status.alias("status"))


def strip_flagged(answer: Column, flagged: Column) -> Column:
    """The answer without the sentences that hold a flagged text, whatever its case."""
    kept = F.filter(T.answer_sentences(answer), lambda s: ~F.exists(flagged, lambda f: F.contains(F.lower(s), F.lower(f))))
    return F.when(F.coalesce(F.size(flagged), F.lit(0)) > 0, F.trim(F.array_join(kept, " "))).otherwise(answer)


def confidence(scores: Column, documents: Column, verified: Column, flagged: Column) -> Column:
    """struct of confidence, band and what they come from.

    scores: final scores in rank order; documents: how many different documents the first five have. 0.45 retrieval + 0.15 diversity + 0.40 verified
    share, at most 0.6 less 0.05 for each flag after the first up to the fourth.
    """
    top, zero = F.slice(scores, 1, 3), F.lit(0.0)
    n = F.size(top)
    mean = F.least(F.aggregate(top, zero, lambda s, x: s + x) / F.when(n > 0, n), F.lit(1.0))
    retrieval = F.when(n > 0, mean * (0.7 + 0.3 * n / 3)).otherwise(0.15)
    diversity = F.least(documents / 3.0, F.lit(1.0))
    checked = verified + flagged
    share = F.when(checked > 0, verified / F.when(checked > 0, checked)).otherwise(0.35)
    raw = 0.45 * retrieval + 0.15 * diversity + 0.40 * share
    capped = F.when(flagged > 0, F.least(raw, 0.6 - F.least(flagged - 1, F.lit(3)) * 0.05)).otherwise(raw)
    value = F.round(F.greatest(zero, F.least(F.lit(1.0), capped) - 1e-9), 3)  # halves go down
    return F.struct(
        value.alias("confidence"),
        band(value).alias("band"),
        F.round(retrieval, 3).alias("retrieval_quality"),
        n.alias("chunks_used"),
        F.round(diversity, 3).alias("source_diversity"),
        F.round(share, 3).alias("verification_ratio"),
    )


def band(value: Column) -> Column:
    return F.when(value >= 0.75, "high").when(value >= 0.45, "medium").otherwise("low")


def warnings(flags: Column, top_score: Column, intent: Column, laws: Column, rows: Column) -> Column:
    """Names of the warnings that apply: removed_claims, low_relevance, draft_review, few_sources."""
    tests = ((flags > 0, "removed_claims"), (F.coalesce(top_score, F.lit(0.0)) < 0.4, "low_relevance"), (intent == "drafting_request", "draft_review"), ((F.coalesce(F.size(laws), F.lit(0)) > 0) & (rows < 3), "few_sources"))
    return F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda n: n.isNotNull())


def procedural_steps(answer: Column, intent: Column) -> Column:
    """At most ten numbered or bulleted steps of over ten characters of an answer about procedure."""
    steps = F.regexp_extract_all(answer, F.lit(r"(?ms)(?:^|\n)\s*(?:\d+[.)]\s+|[-•]\s+)(.+?)(?=\n\s*(?:\d+[.)]|[-•])|\z)"), F.lit(1))
    clean = F.transform(F.filter(F.transform(steps, lambda s: F.trim(s)), lambda s: F.length(s) > 10), lambda s: F.replace(s, F.lit("\n"), F.lit(" ")))
    return F.when(intent == "procedure_query", F.slice(clean, 1, 10)).otherwise(F.array().cast("array<string>"))


def assemble(verified: DataFrame, fill: DataFrame, key: str, limit: int = 5, page_needed: bool = True) -> DataFrame:
    """One list for each answer: verified rows, then others in rank order until the list has ``limit``.

    Both have answer_id, ``key`` (what must not repeat), rank, source_url and page_number. Verified rows are never cut, and one of the others is added
    before the length is looked at: with ``limit`` or more verified rows there is one more.
    """
    rows = verified.withColumn("verified", F.lit(True)).unionByName(fill.withColumn("verified", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("answer_id", key).orderBy(F.desc("verified"), "rank")
    rows = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    place = Window.partitionBy("answer_id").orderBy(F.desc("verified"), "rank", key)
    count = F.sum(F.col("verified").cast("int")).over(Window.partitionBy("answer_id"))
    rows = rows.withColumn("position", F.row_number().over(place)).withColumn("n_verified", count)
    kept = rows.where(F.col("position") <= F.greatest(F.lit(limit), F.col("n_verified") + 1))
    return kept.withColumn("deep_link", deep_link(F.col("source_url"), F.col("page_number"), page_needed)).drop("n", "n_verified")
