"""Claims, verification, confidence, assembly, summaries and the streaming path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.operators import grounding as G
from brightloom.operators import summary
from brightloom.operators.held import new_folder
from brightloom.plans.harness import chunks, documents, table
from brightloom.plans.registry import literal, query
from brightloom.plans.text_queries import PHRASES, N
from brightloom.streaming import state

#: Every document between two phrases, with a tag behind the first, as an answer.
ANSWERS = f"a AS (SELECT doc_id AS answer_id, {literal(PHRASES)}[1 + doc_id % {N}] || ' <CHUNK:' || left(md5(CAST(doc_id AS VARCHAR)), 8) || '> ' || coalesce(text, '') || ' ' || {literal(PHRASES)}[1 + (doc_id // {N}) % {N}] AS answer FROM documents)"
#: Matches of a pattern with where they start (from 0), and the tag next behind each in 200 characters, else the last before it.
HITS = """{name}h AS (SELECT answer_id, answer, regexp_extract_all(answer, {pattern}) AS hits, string_split_regex(answer, {pattern}) AS parts FROM a),
{name}p AS (SELECT answer_id, answer, i, hits[i] AS raw, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start FROM {name}h, LATERAL unnest(range(1, len(hits) + 1)) t(i)),
{name}t AS (SELECT *, regexp_extract_all(substring(answer, CAST(start + length(raw) + 1 AS BIGINT), 200), {tag}, 1) AS ahead, regexp_extract_all(substring(answer, CAST(greatest(1, start - 199) AS BIGINT), CAST(least(start, 200) AS BIGINT)), {tag}, 1) AS behind FROM {name}p)"""
CLAIMS = f"""{ANSWERS}, {HITS.format(name="s", pattern=literal(G.SECTION_CLAIM), tag=literal(G.TAG))}, {HITS.format(name="j", pattern=literal(G.JUDGMENT_CLAIM), tag=literal(G.TAG))},
u AS (SELECT answer_id, 'section' AS claim_type, i, trim(raw) AS raw_text, nullif(upper(regexp_extract(raw, {literal(G.SECTION_CLAIM)}, 2)), '') AS law, regexp_extract(raw, {literal(G.SECTION_CLAIM)}, 1) AS section_num, NULL AS citation, lower(coalesce(ahead[1], behind[-1])) AS tag FROM st
  UNION ALL SELECT answer_id, 'judgment', i, trim(raw), NULL, NULL, trim(raw), lower(coalesce(ahead[1], behind[-1])) FROM jt),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY answer_id, claim_type, coalesce(section_num, citation), coalesce(law, '') ORDER BY i) = 1),
cl AS (SELECT *, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY claim_type DESC, i) AS INTEGER) AS claim_id FROM f)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    phrase = lambda n: F.element_at(F.array(*map(F.lit, PHRASES)), (1 + n % N).cast("int"))
    tag = F.concat(F.lit("<CHUNK:"), F.substring(F.md5(i.cast("string")), 1, 8), F.lit(">"))
    return table(spark, sf_dir, "documents").select(i.alias("answer_id"), F.concat_ws(" ", phrase(i), tag, F.coalesce("text", F.lit("")), phrase(F.floor(i / N))).alias("answer"))


@query(f"{{WITH}}, {CLAIMS} SELECT answer_id, claim_id, claim_type, raw_text, law, section_num, tag FROM cl")
def claim_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.claims(_answers(spark, sf_dir)).select("answer_id", "claim_id", "claim_type", "raw_text", "law", "section_num", "tag")


#: For each chunk with a section a claim of it: tagged with its chunk, of a law that stands for the document's or of none, of a section that only the base or nobody has; for each document its citation.
VERIFIED = """k AS (SELECT c.*, d.law, d.citation FROM c JOIN d USING (document_id)),
g AS (SELECT document_id AS answer_id, chunk_index AS claim_id, 'section' AS claim_type, CASE chunk_index // 6 % 4 WHEN 0 THEN NULL WHEN 1 THEN CASE law WHEN 'BNS' THEN 'IPC' ELSE law END ELSE 'BSA' END AS law,
    CASE chunk_index // 6 % 5 WHEN 3 THEN CAST((CAST(section_ref AS INTEGER) + 1) AS VARCHAR) WHEN 4 THEN '9' || section_ref || '77' ELSE section_ref END AS section_num, NULL AS citation, CASE WHEN chunk_index // 6 % 3 = 0 THEN left(chunk_id, 8) END AS tag FROM k WHERE section_ref IS NOT NULL
  UNION ALL SELECT document_id, -1, 'judgment', NULL, NULL, CASE WHEN doc_id % 2 = 0 THEN lower(citation) ELSE citation || '0' END, NULL FROM d WHERE citation IS NOT NULL),
al AS (SELECT * FROM (VALUES ('BNS', ['BNS', 'IPC']), ('BNSS', ['BNSS', 'CRPC']), ('BSA', ['BSA', 'EVIDENCE ACT']), ('IPC', ['IPC', 'BNS'])) t(key, names)),
wc AS (SELECT g.*, coalesce(names, [upper(g.law)]) AS laws, regexp_replace(lower(trim(g.citation)), '[().,\\s]+', ' ', 'g') AS cite FROM g LEFT JOIN al ON key = upper(g.law)),
pairs AS (SELECT wc.answer_id, wc.claim_id, r.chunk_id, r.document_id, r.chunk_index AS rank, wc.tag IS NOT DISTINCT FROM left(r.chunk_id, 8) AS tagged, wc.law IS NULL OR list_contains(laws, upper(r.law)) OR section_num IS NULL AS lawful
  FROM wc JOIN k r ON r.document_id = wc.answer_id AND r.chunk_index < 24 AND (coalesce(wc.section_num = r.section_ref, false) OR coalesce(wc.cite = regexp_replace(lower(trim(r.citation)), '[().,\\s]+', ' ', 'g'), false))),
st AS (SELECT answer_id, claim_id, 0 AS stage, -rank AS o, chunk_id, document_id FROM pairs WHERE tagged
  UNION ALL SELECT answer_id, claim_id, 1, rank, chunk_id, document_id FROM pairs WHERE lawful
  UNION ALL SELECT answer_id, claim_id, 2, row_number() OVER (ORDER BY k.chunk_id), k.chunk_id, k.document_id FROM wc JOIN k ON (k.section_ref = wc.section_num OR starts_with(k.subsection_ref, wc.section_num)) AND (wc.law IS NULL OR list_contains(laws, upper(k.law)))
  UNION ALL SELECT answer_id, claim_id, 2, row_number() OVER (ORDER BY e.document_id), o.chunk_id, e.document_id FROM wc JOIN d e ON regexp_replace(lower(trim(e.citation)), '[().,\\s]+', ' ', 'g') = wc.cite LEFT JOIN (SELECT document_id, min(chunk_id) AS chunk_id FROM c WHERE chunk_type = 'final_order' GROUP BY 1) o ON o.document_id = e.document_id),
b AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY stage, o) = 1)"""


@query(f"{{WITH}}, {VERIFIED} SELECT answer_id, claim_id, CASE stage WHEN 0 THEN 'tag' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'base' END AS stage, chunk_id, document_id, CASE WHEN stage IS NULL THEN 'flagged' ELSE 'verified' END AS status FROM g LEFT JOIN b USING (answer_id, claim_id)")
def claim_verify_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every section and citation of the tables, verified against the first chunks of their document and all chunks and documents as the base."""
    d = documents(spark, sf_dir)
    k = chunks(spark, sf_dir, "law", "citation")
    n, none = F.floor(F.col("chunk_index") / 6), F.lit(None).cast("string")
    law = F.when(n % 4 == 0, none).when(n % 4 == 1, F.when(F.col("law") == "BNS", "IPC").otherwise(F.col("law"))).otherwise("BSA")
    section = F.when(n % 5 == 3, (F.col("section_ref").cast("int") + 1).cast("string")).when(n % 5 == 4, F.concat(F.lit("9"), "section_ref", F.lit("77"))).otherwise(F.col("section_ref"))
    claims = k.where("section_ref is not null").select(F.col("document_id").alias("answer_id"), F.col("chunk_index").alias("claim_id"), F.lit("section").alias("claim_type"), law.alias("law"), section.alias("section_num"), none.alias("citation"), F.when(n % 3 == 0, F.substring("chunk_id", 1, 8)).alias("tag"))
    cited = F.when(F.col("doc_id") % 2 == 0, F.lower("citation")).otherwise(F.concat("citation", F.lit("0")))
    judged = d.where("citation is not null").select(F.col("document_id").alias("answer_id"), F.lit(-1).alias("claim_id"), F.lit("judgment").alias("claim_type"), none.alias("law"), none.alias("section_num"), cited.alias("citation"), none.alias("tag"))
    retrieved = k.where("chunk_index < 24").select(F.col("document_id").alias("answer_id"), F.col("chunk_index").alias("rank"), "chunk_id", "document_id", "section_ref", "law", "citation")
    found = G.verify(claims.unionByName(judged), retrieved, k, d)
    return found.select("answer_id", "claim_id", "stage", "chunk_id", "document_id", "status")


@query("SELECT document_id, chunk_id FROM (SELECT document_id, lower(trim(regexp_replace(citation, '[().,\\s]+', ' ', 'g'))) AS cite FROM d WHERE citation IS NOT NULL) t LEFT JOIN (SELECT document_id, min(chunk_id) AS chunk_id FROM c WHERE chunk_type = 'final_order' GROUP BY 1) o USING (document_id)")
def citation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's citation as a claim, looked up among all documents with its final order."""
    d = documents(spark, sf_dir)
    claims = d.where("citation is not null").select(F.col("document_id").alias("answer_id"), F.lit(1).alias("claim_id"), F.lit("judgment").alias("claim_type"), F.lit(None).cast("string").alias("law"), F.lit(None).cast("string").alias("section_num"), F.col("citation").alias("citation"), F.lit(None).cast("string").alias("tag"))
    none = d.where("false").select(F.col("document_id").alias("answer_id"), F.lit(1).alias("rank"), F.col("document_id").alias("chunk_id"), "document_id", F.col("document_id").alias("section_ref"), "law", "citation")
    base = chunks(spark, sf_dir).select("chunk_id", "document_id", "section_ref", "subsection_ref", F.lit(None).cast("string").alias("law"), "chunk_type")
    return G.verify(claims, none, base, d).select("document_id", "chunk_id")


SAID = "t AS (SELECT conv_id, turn, md5(text) AS said, text, string_split(regexp_replace(text, '([.!?])\\s+([A-Z\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS sentences FROM conversations)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("said"), "text")


@query(f"WITH {SAID}, f AS (SELECT *, CASE WHEN turn % 3 = 0 THEN [] ELSE [lower(left(sentences[2], 12)), right(text, 6)] END AS flagged FROM t) SELECT conv_id, turn, said, md5(CASE WHEN len(flagged) > 0 THEN trim(array_to_string(list_filter(sentences, lambda s: len(list_filter(flagged, lambda x: contains(lower(s), lower(x)))) = 0), ' ')) ELSE text END) AS answer FROM f")
def strip_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything said, of which the beginning of the second sentence and the end are flagged in two turns of three."""
    second = F.coalesce(F.try_element_at(T.answer_sentences(F.col("text")), F.lit(2)), F.lit(None).cast("string"))
    marks = F.filter(F.array(F.lower(F.substring(second, 1, 12)), F.right("text", F.lit(6))), lambda m: m.isNotNull())
    flagged = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(marks)
    return _said(spark, sf_dir).select("conv_id", "turn", "said", F.md5(G.strip_flagged(F.col("text"), flagged)).alias("answer"))


@query(f"{{WITH}}, {ANSWERS}, b AS (SELECT answer_id, trim(regexp_replace(answer, '(?i)\\s*<CHUNK:[a-f0-9]{{4,8}}>', '', 'g')) AS clean FROM a) SELECT answer_id, length(clean) >= 120 AND ({' OR '.join(f'regexp_matches(clean, {literal(p)})' for p in G.CHECKABLE)}) AS needed FROM b")
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("answer_id", G.needs_audit(F.col("answer")).alias("needed"))


#: Five events as an answer: values of those under 70 as scores in order, types as documents, low values as verified and high ones as flagged claims.
SCORED = """e AS (SELECT event_id // 5 AS id, list_transform(list(value ORDER BY event_id) FILTER (WHERE value < 70), lambda v: v / 100) AS scores, count(DISTINCT event_type) AS documents, count(*) FILTER (WHERE value < 30) AS verified, count(*) FILTER (WHERE value > 80) AS flagged FROM events GROUP BY 1),
p AS (SELECT *, coalesce(len(scores), 0) AS m, list_slice(scores, 1, 3) AS top, least(coalesce(len(scores), 0), 3) AS n FROM e),
q AS (SELECT *, CASE WHEN n > 0 THEN least(list_sum(top) / n, 1.0) * (0.7 + 0.3 * n / 3) ELSE 0.15 END AS retrieval, least(documents / 3.0, 1.0) AS diversity, CASE WHEN verified + flagged > 0 THEN verified / (verified + flagged) ELSE 0.35 END AS share FROM p),
r AS (SELECT *, 0.45 * retrieval + 0.15 * diversity + 0.40 * share AS raw FROM q),
s AS (SELECT *, CASE WHEN flagged > 0 THEN least(raw, 0.6 - least(flagged - 1, 3) * 0.05) ELSE raw END AS capped FROM r),
v AS (SELECT *, round(greatest(0, least(1, capped) - 1e-9), 3) AS confidence FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    ordered = F.array_sort(F.collect_list(F.when(value < 70, F.struct("event_id", value.alias("v")))))
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 5).alias("id")).agg(ordered.alias("o"), F.count_distinct("event_type").alias("documents"), F.count_if(value < 30).alias("verified"), F.count_if(value > 80).alias("flagged"))
    return rows.withColumn("scores", F.transform("o", lambda x: x["v"] / 100))


@query(f"WITH {SCORED} SELECT id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS band, round(retrieval, 3) AS retrieval, round(diversity, 3) AS diversity, round(share, 3) AS share FROM v")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.confidence(*map(F.col, ("scores", "documents", "verified", "flagged")))
    return _scored(spark, sf_dir).select("id", c["confidence"].alias("confidence"), c["band"].alias("band"), c["retrieval_quality"].alias("retrieval"), c["source_diversity"].alias("diversity"), c["verification_ratio"].alias("share"))


@query(f"WITH {SCORED} SELECT id, concat_ws(',', CASE WHEN flagged > 0 THEN 'removed_claims' END, CASE WHEN coalesce(scores[1], 0) < 0.4 THEN 'low_relevance' END, CASE WHEN id % 3 = 0 THEN 'draft_review' END, CASE WHEN id % 2 = 0 AND m < 3 THEN 'few_sources' END) AS warnings FROM v")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    laws = F.when(F.col("id") % 2 == 0, F.array(F.lit("BNS"))).otherwise(F.array().cast("array<string>"))
    intent = F.when(F.col("id") % 3 == 0, "drafting_request").otherwise("case_search")
    return rows.select("id", F.array_join(G.warnings(F.col("flagged"), F.try_element_at("scores", F.lit(1)), intent, laws, F.size("scores")), ",").alias("warnings"))


@query("WITH t AS (SELECT conv_id, turn, md5(text) AS said, list_filter(list_transform(string_split(regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g'), chr(10)), lambda l: trim(l)), lambda l: length(l) > 10) AS lines FROM conversations) SELECT conv_id, turn, said, md5(CASE WHEN turn % 2 = 1 THEN array_to_string(lines[1:10], '|') ELSE '' END) AS steps FROM t")
def procedural_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything said as a list, a step for each line, numbered or with bullets; odd turns are about procedure."""
    lines = F.split(F.regexp_replace("text", r"\s*\n\s*", "\n"), "\n")
    marked = F.array_join(F.transform(lines, lambda line, i: F.concat(F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), line)), "\n")
    intent = F.when(F.col("turn") % 2 == 1, "procedure_query").otherwise("case_search")
    return _said(spark, sf_dir).select("conv_id", "turn", "said", F.md5(F.array_join(G.procedural_steps(F.concat(F.lit("Do this:\n"), marked), intent), "|")).alias("steps"))


ASSEMBLE = """WITH {w}, v AS (SELECT document_id AS answer_id, {key}, chunk_index AS rank, source_url, page_number, chunk_index < 2 AS verified FROM c JOIN d USING (document_id) WHERE {cond}),
u AS (SELECT *, row_number() OVER (PARTITION BY answer_id, {name} ORDER BY verified DESC, rank) AS n FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY verified DESC, rank, {name}) AS position, sum(CAST(verified AS INTEGER)) OVER (PARTITION BY answer_id) AS nv FROM u WHERE n = 1)
SELECT answer_id, {name}, verified, CAST(position AS INTEGER) AS position, {link} AS deep_link FROM p WHERE position <= greatest(5, nv + 1)"""


def _assembled(name: str, key: str, cond: str, link: str) -> str:
    from brightloom.plans.registry import WITH

    return ASSEMBLE.format(w=WITH.removeprefix("WITH "), name=name, key=key, cond=cond, link=link)


def _lists(spark: SparkSession, sf_dir: str, key: str, cond: str, page_needed: bool) -> DataFrame:
    rows = chunks(spark, sf_dir).join(documents(spark, sf_dir), "document_id").where(cond)
    rows = rows.select(F.col("document_id").alias("answer_id"), F.col(key).alias("key"), F.col("chunk_index").alias("rank"), "source_url", "page_number")
    return G.assemble(rows.where("rank < 2"), rows.where("rank >= 2"), "key", page_needed=page_needed)


@query(_assembled("section", "section_ref AS section", "section_ref IS NOT NULL", "CASE WHEN source_url IS NOT NULL THEN concat(source_url, '#page=', CAST(page_number AS VARCHAR)) END"))
def relevant_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir, "section_ref", "section_ref is not null", True).select("answer_id", F.col("key").alias("section"), "verified", "position", "deep_link")


@query(_assembled("chunk_type", "chunk_type", "citation IS NOT NULL AND document_type = 'judgment'", "CASE WHEN source_url IS NOT NULL THEN concat(source_url, '#page=', CAST(page_number AS VARCHAR)) END"))
def precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir, "chunk_type", "citation is not null and document_type = 'judgment'", False).select("answer_id", F.col("key").alias("chunk_type"), "verified", "position", "deep_link")


#: The tables know five kinds of these chunks; arguments and ratio stand for passages and sections here, so that every field is filled.
KINDS = "kc AS (SELECT *, CASE chunk_type WHEN 'passage' THEN 'arguments' WHEN 'section' THEN 'ratio' ELSE chunk_type END AS kind FROM c)"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("chunk_type", F.when(F.col("chunk_type") == "passage", "arguments").when(F.col("chunk_type") == "section", "ratio").otherwise(F.col("chunk_type")))


def _all_of(kind: str) -> str:
    return f"string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) FILTER (WHERE kind = '{kind}')"


@query(f"{{WITH}}, {KINDS} SELECT document_id, {', '.join(f'md5({_all_of(k)}) AS {f}' for k, f in summary.FIELDS.items())} FROM kc GROUP BY 1")
def summary_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_kind(_kinds(spark, sf_dir)).select("document_id", *(F.md5(f).alias(f) for f in summary.FIELDS.values()))


@query("SELECT document_id, coalesce(array_to_string(list_sort(list(DISTINCT section_ref) FILTER (WHERE section_ref IS NOT NULL)), ','), '') AS sections FROM c GROUP BY 1")
def sections_discussed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.sections_discussed(chunks(spark, sf_dir)).select("document_id", F.array_join("sections", ",").alias("sections"))


@query(f"""{{WITH}}, {KINDS}, i AS (SELECT document_id, unnest([left(content, 20), left(content, 20), right(content, 20)]) AS issue, chunk_index, unnest([1, 2, 3]) AS n FROM kc WHERE kind = 'issues'),
j AS (SELECT document_id, issue, min(chunk_index * 4 + n) AS o FROM i GROUP BY 1, 2), l AS (SELECT document_id, md5(array_to_string(list_slice(list(issue ORDER BY o), 1, 10), '|')) AS issues FROM j GROUP BY 1)
SELECT kc.document_id, coalesce(md5({_all_of("facts")}), md5('Not extracted.')) AS facts, coalesce(md5({_all_of("findings")}), md5('Not extracted.')) AS findings, md5({_all_of("ratio")}) AS ratio_decidendi,
coalesce(any_value(l.issues), md5('')) AS issues, coalesce(md5(arg_max(content, chunk_index) FILTER (WHERE kind = 'final_order')), md5('Not extracted.')) AS final_order FROM kc LEFT JOIN l ON l.document_id = kc.document_id GROUP BY 1""")
def map_reduce_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as a partial summary of its kind; a chunk of issues names two, one of them twice."""
    of = lambda kind: F.when(F.col("chunk_type") == kind, F.col("content"))
    issues = F.when(F.col("chunk_type") == "issues", F.array(F.left("content", F.lit(20)), F.left("content", F.lit(20)), F.right("content", F.lit(20))))
    parts = _kinds(spark, sf_dir).select("document_id", F.col("chunk_index").alias("position"), of("facts").alias("facts"), of("findings").alias("findings"), of("ratio").alias("ratio"), issues.alias("issues"), of("final_order").alias("final_order"))
    return summary.merge(parts).select("document_id", *(F.md5(c).alias(c) for c in ("facts", "findings", "ratio_decidendi")), F.md5(F.array_join("issues", "|")).alias("issues"), F.md5("final_order").alias("final_order"))


@query("SELECT CAST(user_id AS VARCHAR) AS document_id, count(*) AS n FROM events GROUP BY 1")
def stream_flush_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running counts of a stream over all arrivals, kept by key, once it has caught up."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").cast("string").alias("document_id"))
    folder = new_folder(spark, "flush-counts")
    run, kept = state.write_counts(stream, folder, f"{folder}/stream", every=None)
    run.awaitTermination()
    return kept.read()


@query("""WITH e AS (SELECT *, value < 20 AS put FROM events), p AS (SELECT event_id AS id, ts, put, last_value(CASE WHEN put THEN ts END IGNORE NULLS) OVER o AS put_ts, last_value(CASE WHEN put THEN event_type END IGNORE NULLS) OVER o AS found FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT id, CASE WHEN epoch_ms(ts) - epoch_ms(put_ts) < 7200000 THEN found END AS result FROM p WHERE NOT put""")
def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cache's traffic: those of a low value store their type under their user for two hours, the others look it up."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("value") < 20, F.col("event_type")).alias("result"))
    folder = new_folder(spark, "cache-expiry")
    run = state.cache_results(rows, 7200).writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/stream").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("id long, result string").parquet(f"{folder}/found")
