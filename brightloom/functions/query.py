"""What a query text asks for, by rules: sections, laws, courts, years, intent, kind of draft, synonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.text import matches

# Patterns, keywords and synonyms of the rules, in their order.
SECTIONS = (
    r"(?i)\b(?:section|sec\.?|s\.)\s*(\d+[A-Za-z]?(?:\(\d+\))?(?:\([a-z]\))?)\b",
    r"(?i)\bBNS\s+(\d+[A-Za-z]?)\b",
    r"(?i)\bBNSS\s+(\d+[A-Za-z]?)\b",
    r"(?i)\bBSA\s+(\d+[A-Za-z]?)\b",
    r"(?i)\bIPC\s+(\d+[A-Za-z]?)\b",
    r"(?i)\bCrPC\s+(\d+[A-Za-z]?)\b",
    r"(?i)\bArticle\s+(\d+[A-Za-z]?)\b",
)
LAW_WORDS = (
    ("bns", "BNS"), ("bnss", "BNSS"), ("bharatiya nagarik suraksha sanhita", "BNSS"), ("bsa", "BSA"),
    ("bharatiya sakshya adhiniyam", "BSA"), ("ipc", "IPC"), ("indian penal code", "IPC"), ("crpc", "CrPC"), ("constitution", "Constitution"),
)
COURT_WORDS = (
    ("supreme court", "Supreme Court"), ("sc", "Supreme Court"), ("high court", "High Court"), ("hc", "High Court"),
    ("district court", "District Court"), ("sessions court", "District Court"), ("tribunal", "Tribunal"),
)
DRAFT_WORDS = (
    ("anticipatory bail", "anticipatory_bail"), ("bail application", "bail_application"), ("fir quashing", "fir_quashing_petition"),
    ("quashing petition", "fir_quashing_petition"), ("legal notice", "legal_notice"), ("written statement", "written_statement"),
    ("vakalatnama", "vakalatnama"), ("affidavit", "affidavit"), ("complaint", "complaint"), ("notice", "legal_notice"),
)
INTENT_WORDS = (
    ("provision_lookup", ("section", "bns", "bnss", "bsa", "ipc", "article")),
    ("drafting_request", ("draft", "write", "prepare", "application")),
    ("case_search", ("judgment", "case", "ruling", "held", "decided")),
    ("procedure_query", ("how to", "procedure", "file", "steps")),
)
SYNONYMS = (
    (r"(?i)\bipc\b", ("BNS", "Indian Penal Code")),
    (r"(?i)\bcrpc\b", ("BNSS", "Criminal Procedure Code")),
    (r"(?i)\b420\b", ("318",)),
    (r"(?i)\b302\b", ("103",)),
    (r"(?i)\b307\b", ("109",)),
    (r"(?i)\b376\b", ("64",)),
    (r"(?i)\b498a\b", ("85",)),
    (r"(?i)\b482\s+crpc\b", ("528 BNSS",)),
    (r"(?i)\b437\s+crpc\b", ("480 BNSS",)),
    (r"(?i)\b438\s+crpc\b", ("482 BNSS",)),
    (r"(?i)\bs\.\s*(\d+)", ("section $1",)),
    (r"(?i)\bv\.(?=\s|$)", ("versus",)),
)
SECTION_TEST = r"(?i)\b(?:section|sec\.?|s\.)\s*\d+|\bBNS\s+\d+|\bBNSS\s+\d+|\bBSA\s+\d+|\bIPC\s+\d+"
SCOPE_PREFIXES = ("summarize the key", "summarize", "what is", "explain", "from the case:", "from the document:", "in this case", "who were", "what are the")


def sections(query: Column) -> Column:
    """Distinct section numbers, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(F.array(*(matches(query, p, 1) for p in SECTIONS)))))


def _of_words(query: Column, words: tuple, whole: bool) -> Column:
    low = F.lower(query)
    hit = lambda w: low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])") if whole else F.contains(low, F.lit(w))
    all_of = F.array(*(F.when(hit(w), F.lit(v)) for w, v in words))
    return F.sort_array(F.array_distinct(F.filter(all_of, lambda v: v.isNotNull())))


def laws(query: Column, whole_words: bool = False, words: tuple[tuple[str, str], ...] = LAW_WORDS) -> Column:
    """Laws named, sorted; keywords count inside words too (so BNSS implies BNS) unless ``whole_words``.

    ``words`` is the caller's vocabulary: (lower-case keyword, law), which may name full titles that the abbreviations here leave out.
    """
    return _of_words(query, words, whole_words)


def courts(query: Column, whole_words: bool = False) -> Column:
    return _of_words(query, COURT_WORDS, whole_words)


def draft_type(query: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower(query), F.lit(w)), F.lit(v)) for w, v in DRAFT_WORDS))


def years(query: Column) -> Column:
    """struct(year_from, year_to) of the years 1900 to 2029 named; nulls if none is."""
    found = F.transform(matches(query, r"\b(19[0-9]{2}|20[0-2][0-9])\b", 1), lambda y: y.cast("int"))
    return F.struct(F.array_min(found).alias("year_from"), F.array_max(found).alias("year_to"))


def intent(query: Column) -> Column:
    low = F.lower(query)
    rules = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in INTENT_WORDS]
    return F.coalesce(*rules, F.lit("general_query"))


def word_count(query: Column) -> Column:
    return F.size(matches(query, r"[\p{L}\p{N}_]+"))


def names_section(query: Column) -> Column:
    return query.rlike(SECTION_TEST)


def expand_synonyms(query: Column) -> Column:
    """The query in quotation marks, then each synonym, joined by OR; the trimmed query where no rule matches."""
    terms = F.flatten(F.array(*(F.when(query.rlike(p), F.array(*(F.regexp_replace(F.regexp_extract(query, p, 0), p, t) if "$" in t else F.lit(t) for t in out))).otherwise(F.array().cast("array<string>")) for p, out in SYNONYMS)))
    return F.when(F.size(terms) > 0, F.array_join(F.concat(F.array(F.concat(F.lit('"'), query, F.lit('"'))), terms), " OR ")).otherwise(F.trim(query))


def clean_query(query: Column) -> Column:
    """Operator signs removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"[&|!<>():]", " "), r"\s+", " "))


def scoped_query(query: Column) -> Column:
    """Leading phrases such as 'what is' removed, one after another in their order; the query itself if under five characters remain."""
    clean = query
    for p in SCOPE_PREFIXES:
        clean = F.regexp_replace(clean, rf"(?is)^{p}[ :\-]*(.*?)[ :\-]*\z", "$1")  # names the column once, so the expression stays small
    return F.when(F.length(F.trim(clean)) < 5, query).otherwise(clean)


def vector_gate(exact: Column, lexical: Column, query: Column, least: int = 6) -> Column:
    """Whether vector search is worth it: not with three exact hits; always with under three others; not for a section query that hit; not for short queries."""
    return F.when(exact >= 3, False).when(lexical - exact < 3, True).when(names_section(query) & (exact > 0), False).when(word_count(query) < least, False).otherwise(True)


def understand(queries, text: str = "query", law_words: tuple[tuple[str, str], ...] = LAW_WORDS):
    """``queries`` with everything the rules find, with the caller's vocabulary of laws."""
    q = F.col(text)
    return queries.withColumns(
        {"cleaned_query": F.trim(q), "intent": intent(q), "intent_confidence": F.lit(0.6), "section_refs": sections(q), "law_filter": laws(q, words=law_words), "court_filter": courts(q), "draft_type": draft_type(q), "year_from": years(q)["year_from"], "year_to": years(q)["year_to"]}
    )
