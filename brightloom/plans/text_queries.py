"""Cleaning, sentences, chunks, metadata and query understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import query as Q
from brightloom.functions import text as T
from brightloom.functions.chunking import chunk_documents
from brightloom.plans.harness import chunks, documents, table
from brightloom.plans.registry import boundary_cut, literal, query


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\\r\\f\\v]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'),
'(?m)^\\s*Page\\s+\\d+\\s+of\\s+\\d+\\s*$', '', 'g'), '(?m)^\\s*\\d+\\s*$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, md5(regexp_replace(text, '([.!?])\\s+([A-Z\"''])', '\\1' || chr(1) || '\\2', 'g')) AS sentences FROM documents")
def sentence_split_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.answer_sentences(F.col("text")), "\x01")).alias("sentences"))


ABBREVIATED = "regexp_replace(regexp_replace(text, '(?i)(^|[^\\pL\\pN_])(Hon''ble|Dr|Mr|Mrs|Pvt|Ltd|Smt|Shri|Km|St|Art|Sec|Cl|Ch|Reg|Ord|Sch|viz|etc|i\\.e|e\\.g|vs?|s|r)\\.', '\\1\\2<DOT>', 'g'), '(^|[^\\pL\\pN_])([A-Z])\\.', '\\1\\2<DOT>', 'g')"


@query(f"SELECT doc_id, md5(replace(array_to_string(list_filter(list_transform(string_split(regexp_replace({ABBREVIATED}, '([.!?])\\s+([A-Z\"‘“”])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), chr(1)), '<DOT>', '.')) AS sentences FROM documents")
def sentence_split_chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.sentences(F.col("text")), "\x01")).alias("sentences"))


@query()
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text"))


#: What the rules look for, put before and behind the whole texts of all documents.
PHRASES = (
    "see AIR 2017 SC 4609.", "(2017) 10 SCC 1 and AIR 1999 SC 2", "IN THE SUPREME COURT OF INDIA JUDGMENT", "in the high court of Kerala, an order under the act", "under Section 318(2)(b) of the BNS",
    "318. Cheating.—Whoever deceives IPC IPC", "FACTS: the petitioner before the SC today", "ISSUES FOR CONSIDERATION:", "shall be punished with fine, BSA then BNSS 1999", "Article 21 and s. 12, draft an anticipatory bail application",
    "How to file a complaint 2001 2001", "MANU/SC/0123/2020 Supreme Court judgments from 2022 to 2024", "2017 (3) SCR 12 describe the escrow rule", "The Evidence Act, CrPC 41 and the Indian Penal Code", "gazette notification, the appeal is dismissed", "it is settled law that IPC 420", "",
)
N = len(PHRASES)
LEGAL = f"x AS (SELECT doc_id, {literal(PHRASES)}[1 + doc_id % {N}] || ' ' || coalesce(text, '') || ' ' || {literal(PHRASES)}[1 + (doc_id // {N}) % {N}] AS text FROM documents)"


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: every document between two phrases."""
    phrase = lambda n: F.element_at(F.array(*map(F.lit, PHRASES)), (1 + n % N).cast("int"))
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.concat_ws(" ", phrase(F.col("doc_id")), F.coalesce("text", F.lit("")), phrase(F.floor(F.col("doc_id") / N))).alias("text"))


def _cases(marks, text: str, other: str) -> str:
    """SQL for the first (name, pattern) that matches."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {literal(p)}) THEN {literal(n)}" for n, p in marks) + f" ELSE {other} END"


@query(f"WITH {LEGAL} SELECT doc_id, coalesce(" + ", ".join(f"nullif(trim(regexp_extract(text, {literal(p)}, 0)), '')" for p in T.CITATIONS) + ") AS citation FROM x")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", T.citation(F.col("text")).alias("citation"))


SPELT = "CASE doc_id % 3 WHEN 0 THEN citation WHEN 1 THEN '(' || replace(citation, ' ', '.') || ')' ELSE '  ' || replace(citation, ' ', ',  ') || '.' END"


@query(f"SELECT document_id, lower(trim(regexp_replace({SPELT}, '[().,\\s]+', ' ', 'g'))) AS citation FROM d")
def citation_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's citation, spelt in one of three ways."""
    d, c = documents(spark, sf_dir), F.col("citation")
    ways = F.when(F.col("doc_id") % 3 == 0, c).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("("), F.replace(c, F.lit(" "), F.lit(".")), F.lit(")"))).otherwise(F.concat(F.lit("  "), F.replace(c, F.lit(" "), F.lit(",  ")), F.lit(".")))
    return d.select("document_id", T.normal_citation(ways).alias("citation"))


@query(f"WITH {LEGAL} SELECT doc_id, {_cases([(n, p) for n, p, _ in T.COURT_MARKS], 'text', 'NULL')} AS court, CASE " + " ".join(f"WHEN regexp_matches(text, {literal(p)}) THEN " + (f"trim(regexp_extract(text, {literal(p)}, 0))" if named else "NULL") for _, p, named in T.COURT_MARKS) + " END AS court_name FROM x")
def court_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.court(F.col("text"))
    return legal(spark, sf_dir).select("doc_id", c["court"].alias("court"), c["court_name"].alias("court_name"))


@query(f"WITH {LEGAL} SELECT doc_id, {_cases(T.DOCUMENT_MARKS, 'text', literal('upload'))} AS document_type FROM x")
def doctype_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", T.document_type(F.col("text")).alias("document_type"))


LAW_COUNTS = [f"len(regexp_extract_all(text, {literal(p)}))" for _, p in T.LAW_MARKS]


@query(f"WITH {LEGAL} SELECT doc_id, CASE greatest({', '.join(LAW_COUNTS)}) WHEN 0 THEN NULL " + " ".join(f"WHEN {c} THEN {literal(n)}" for c, (n, _) in zip(LAW_COUNTS, T.LAW_MARKS, strict=True)) + " END AS law FROM x")
def law_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", T.law(F.col("text")).alias("law"))


@query(f"WITH {LEGAL}, y AS (SELECT doc_id, regexp_extract_all(left(text, 2000), {literal(T.YEAR)}, 1) AS ys FROM x), u AS (SELECT doc_id, unnest(ys) AS y, generate_subscripts(ys, 1) AS i FROM y), r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS n FROM u GROUP BY 1, 2) SELECT x.doc_id, CAST(y AS INTEGER) AS year FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND n = 1")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", T.year(F.col("text")).alias("year"))


@query(f"WITH {LEGAL} SELECT doc_id, array_to_string(list_transform(list_distinct(regexp_extract_all(text, '(?i)\\bArticle\\s+(\\d+[A-Z]?(?:\\(\\w+\\))*)\\b', 1)), lambda a: 'Article ' || a), '|') || '/' || array_to_string(list_filter({literal(T.TERMS)}, lambda k: contains(lower(text), k)), '|') AS keywords FROM x")
def keywords_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, then terms; no text names two different articles or more than fifteen keys."""
    k = T.keywords(F.col("text"))
    return legal(spark, sf_dir).select("doc_id", F.concat(F.array_join(F.filter(k, lambda w: F.startswith(w, F.lit("Article "))), "|"), F.lit("/"), F.array_join(F.filter(k, lambda w: ~F.startswith(w, F.lit("Article "))), "|")).alias("keywords"))


HEAD, BODY = f"regexp_matches(left(text, 500), {literal(T.HEADING)})", f"left(text, 1000), {literal(T.INLINE_SECTION)}"


@query(f"""WITH {LEGAL} SELECT doc_id, CASE WHEN {HEAD} THEN regexp_extract(left(text, 500), {literal(T.HEADING)}, 1) WHEN regexp_matches({BODY}) THEN regexp_extract({BODY}, 1) END AS section_ref,
CASE WHEN NOT {HEAD} AND contains(regexp_extract({BODY}, 0), '(') THEN trim(regexp_extract({BODY}, 0)) END AS subsection_ref FROM x""")
def section_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.section_ref(F.col("text"))
    return legal(spark, sf_dir).select("doc_id", r["section_ref"].alias("section_ref"), r["subsection_ref"].alias("subsection_ref"))


@query(f"WITH {LEGAL} SELECT doc_id, {_cases(T.CHUNK_MARKS, 'left(text, 800)', literal('passage'))} AS chunk_type FROM x")
def chunk_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", T.chunk_type(F.col("text")).alias("chunk_type"))


@query(f"WITH {LEGAL} SELECT doc_id, regexp_matches(left(trim(text), 60), {literal(T.BOUNDARY)}) AS boundary FROM x")
def boundary_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", T.is_boundary(F.col("text")).alias("boundary"))


def named_in(words, text: str = "lower(text)") -> str:
    """SQL for the sorted, distinct values of the words that a text contains."""
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN contains({text}, {literal(w)}) THEN {literal(v)} END" for w, v in words) + "], lambda v: v IS NOT NULL)))"


@query(f"WITH {LEGAL} SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(text, {literal(p)}, 1)" for p in Q.SECTIONS) + "]))), ',') AS sections FROM x")
def qu_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", F.array_join(Q.sections(F.col("text")), ",").alias("sections"))


@query(f"WITH {LEGAL} SELECT doc_id, array_to_string({named_in(Q.LAW_WORDS)}, ',') AS laws, array_to_string({named_in(Q.COURT_WORDS)}, ',') AS courts FROM x")
def qu_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", F.array_join(Q.laws(F.col("text")), ",").alias("laws"), F.array_join(Q.courts(F.col("text")), ",").alias("courts"))


@query(f"WITH {LEGAL} SELECT doc_id, CAST(list_min(y) AS INTEGER) AS year_from, CAST(list_max(y) AS INTEGER) AS year_to FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\\b(19[0-9][0-9]|20[0-2][0-9])\\b'), lambda z: CAST(z AS INTEGER)) AS y FROM x)")
def qu_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = Q.years(F.col("text"))
    return legal(spark, sf_dir).select("doc_id", y["year_from"].alias("year_from"), y["year_to"].alias("year_to"))


@query(f"WITH {LEGAL} SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {literal(w)})" for w in words) + f" THEN {literal(name)}" for name, words in Q.INTENT_WORDS) + " ELSE 'general_query' END AS intent FROM x")
def qu_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", Q.intent(F.col("text")).alias("intent"))


@query(f"WITH {LEGAL} SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), {literal(w)}) THEN {literal(v)}" for w, v in Q.DRAFT_WORDS) + " END AS draft_type FROM x")
def qu_draft_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", Q.draft_type(F.col("text")).alias("draft_type"))


def synonyms_of(pattern: str, out: tuple[str, ...]) -> str:
    """SQL for a rule's terms, of the first match where they take a group of it."""
    p = literal(pattern.replace(r"(?=\s|$)", r"(?:\s|$)"))
    terms = ", ".join(f"'section ' || regexp_extract(text, {p}, 1)" if "$" in t else literal(t) for t in out)
    return f"CASE WHEN regexp_matches(text, {p}) THEN [{terms}] ELSE [] END"


@query(f"WITH {LEGAL}, y AS (SELECT doc_id, text, flatten([{', '.join(synonyms_of(*rule) for rule in Q.SYNONYMS)}]) AS terms FROM x) SELECT doc_id, md5(CASE WHEN len(terms) > 0 THEN array_to_string(list_prepend('\"' || text || '\"', terms), ' OR ') ELSE trim(text) END) AS expanded FROM y")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", F.md5(Q.expand_synonyms(F.col("text"))).alias("expanded"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(text, '[&|!<>():]', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned, CAST(len(regexp_extract_all(text, '[\\pL\\pN_]+')) AS INTEGER) AS words FROM benchmark")
def query_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", Q.clean_query(F.col("text")).alias("cleaned"), Q.word_count(F.col("text")).alias("words"))


@query("SELECT chunk_id, CAST(CASE WHEN chunk_index * 7 < 10 + doc_id % 5 THEN 1 WHEN chunk_index * 7 < 30 THEN 2 ELSE 3 END AS INTEGER) AS page FROM c JOIN d USING (document_id)")
def page_for_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's page from a map of starts that differs by document."""
    rows = chunks(spark, sf_dir).join(documents(spark, sf_dir).select("document_id", "doc_id"), "document_id")
    pages = F.map_from_arrays(F.array(F.lit(0), (10 + F.col("doc_id") % 5).cast("int"), F.lit(30)), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return rows.select("chunk_id", T.page_of(F.col("chunk_index") * 7, pages).alias("page"))


@query(f"SELECT doc_id, md5({boundary_cut('text', '400')}) AS cut FROM documents")
def trim_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.trim_to_boundary(F.col("text"), F.lit(400))).alias("cut"))
