"""From files to chunks and from queries to records, on small tables."""

import pytest
from pyspark.sql import functions as F

from brightloom.functions.vectors import hashing_model
from brightloom.operators import answers, catalog, grounding, ingest, search, summary

CORPUS = "chunk_id string, document_id string, content string, chunk_index int, content_length int, chunk_type string, section_ref string, subsection_ref string, page_number int, law string, court string, year int, citation string, case_number string, court_name string"


def corpus(spark):
    row = lambda i, text, section, law, court, year: (f"c{i:07d}-x", f"d{i % 3}", text, i, len(text), "section" if section else "passage", section, None, 1, law, court, year, None, None, None)
    return spark.createDataFrame(
        [
            row(1, "Cheating is punished. More.", "318", "BNS", "Supreme Court", 2023),
            row(2, "Cheating under the old law.", "318", "IPC", None, 1999),
            row(3, "Bail may be granted by the court.", None, "BNSS", "High Court", 2005),
            row(4, "Bail and cheating together here.", None, "BNS", None, None),
            row(5, "Nothing of interest.", "31", "BNS", "Supreme Court", 2023),
        ],
        CORPUS,
    )


def test_retrieve_filters(spark):
    asked = spark.createDataFrame([(1, "section 318 BNS cheating"), (2, "bail in the High Court from 2001 to 2010"), (3, "zzz")], "query_id long, query string")
    got = search.retrieve(corpus(spark), asked).orderBy("query_id", "final_rank").collect()
    of = {q: [r.chunk_id[:8] for r in got if r.query_id == q] for q in (1, 2, 3)}
    assert of == {1: ["c0000001", "c0000004"], 2: ["c0000003"], 3: []}  # chunk 2 has another law, and 4 no year
    assert [r.final_score for r in got if r.chunk_id.startswith("c0000001")] == [1.0]
    packed = {r.query_id: r.context for r in search.contexts(search.retrieve(corpus(spark), asked)).collect()}
    assert packed[1].startswith("<CHUNK:c0000001> [§318 | BNS 2023") and "Bail and cheating" in packed[1]
    assert search.retrieve(corpus(spark).where("false"), asked).count() == 0


def test_retrieve_vectors(spark):
    model = hashing_model(16)
    vectors = ingest.embed_chunks(corpus(spark), model, 16).select("chunk_id", "embedding")
    asked = spark.createDataFrame([(1, "bail may be granted by the court")], "query_id long, query string")
    found = search.retrieve(corpus(spark), asked, vectors, model, 16).orderBy("final_rank").collect()
    assert found[0].chunk_id == "c0000003-x"


def test_retrieve_given_filters_reranker_and_full_text(spark):
    asked = spark.createDataFrame([(1, "section 318 BNS cheating", ["IPC"], 0), (2, "bail", None, 2000)], "query_id long, query string, given_laws array<string>, given_year_from int")
    got = search.retrieve(corpus(spark), asked).collect()
    assert {(r.query_id, r.chunk_id[:8]) for r in got} == {(1, "c0000002"), (2, "c0000003")}  # the caller's law holds, not the text's
    score = lambda pairs: [5.0 if "old" in c else -5.0 for _, c in pairs]
    asked = spark.createDataFrame([(1, "cheating")], "query_id long, query string")
    plain = [r.chunk_id[:8] for r in search.retrieve(corpus(spark), asked).orderBy("final_rank").collect()]
    found = [r.chunk_id[:8] for r in search.retrieve(corpus(spark), asked, reranker=score).orderBy("final_rank").collect()]
    assert sorted(found) == sorted(plain) and found[0] == "c0000002" != plain[0]
    words = spark.createDataFrame([(1, '"old law" cheating'), (2, "bail -cheating")], "query_id long, query string")
    full = search.retrieve(corpus(spark), words, full_text=True).collect()
    assert {(r.query_id, r.chunk_id[:8]) for r in full} == {(1, "c0000002"), (2, "c0000003")}


def test_embedding_failures(spark):
    calls = []

    def model(texts):
        calls.append(len(texts))
        if any("Bail" in t for t in texts):
            raise RuntimeError("no")
        return [[0.0] * (3 if "old" in t else 2) for t in texts]

    got = {r.chunk_id[:8]: r for r in ingest.embed_chunks(corpus(spark).coalesce(1), model, 2, batch=1).collect()}
    assert got["c0000001"].embedding == [0.0, 0.0] and got["c0000001"].error is None
    assert got["c0000002"].error == "3 components" and got["c0000003"].error == "RuntimeError: no" and got["c0000003"].embedding is None


def test_ingest_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("JUDGMENT. " + "The appeal under Section 12 is heard by this bench at length today. " * 6)
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.docx").write_bytes(b"broken")
    known = spark.createDataFrame([("b.txt",)], "original_filename string")
    documents, chunks = ingest.ingest_folder(spark, str(tmp_path), known)
    assert sorted(r.original_filename for r in documents.collect()) == ["a.txt", "c.docx"]
    assert chunks.count() == 1 and chunks.first().section_ref == "12"
    made = ingest.report(documents, documents, ingest.embed_chunks(chunks, hashing_model(4), 4), skipped=1).first()
    assert (made.total_files, made.ingested, made.partial, made.failed, made.skipped, made.total_chunks, made.documents_without_source_url) == (3, 1, 0, 1, 1, 1, 2)
    d, c = documents.withColumn("document_type", F.lit(None).cast("string")), chunks.withColumn("law", F.lit(None).cast("string"))
    kept = ingest.payloads(c, d).first()
    assert (kept.document_type, kept.law) == ("upload", "Other")


def test_parts_and_windows(spark):
    rows = spark.createDataFrame([("a", "FACTS: " + "x" * 60 + " HELD: " + "y" * 60), ("b", None), ("c", "")], "document_id string, text string")
    assert [(r.document_id, r.chunk_type) for r in ingest.judgment_parts(rows).orderBy("document_id", "position").collect()] == [("a", "facts"), ("a", "findings")]
    text = " ".join(f"Sentence {i} ends here." for i in range(20))
    found = ingest.summary_windows(spark.createDataFrame([("a", text), ("b", None)], "document_id string, text string"), 100, 30).orderBy("window").collect()
    assert {r.document_id for r in found} == {"a"} and all(len(r.text) <= 110 for r in found)
    assert all(f"Sentence {i} ends here." in " ".join(r.text for r in found) for i in range(20))


def test_prompts(spark):
    contexts = spark.createDataFrame([(1, "q one", "ctx"), (2, "q two", "")], "query_id long, query string, context string")
    history = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(1, 9)], "query_id long, turn int, role string, content string")
    got = {r.query_id: r.prompt for r in answers.prompts(contexts, history).collect()}
    assert got[1].startswith("CONVERSATION HISTORY:\nUSER: m3\nASSISTANT: m4\n") and got[1].endswith("SOURCES:\nctx\n\nQUERY:\nq one")
    assert got[2] == "SOURCES:\nNo relevant sources found.\n\nQUERY:\nq two"


def test_response(spark):
    rows = spark.createDataFrame([(1, "Section 318 BNS holds <CHUNK:c0000001>. Section 999 BNS too.", "case_search", ["BNS"]), (2, "Plain.", "general_query", None)], "query_id long, answer string, intent string, law_filter array<string>")
    found = spark.createDataFrame([(1, 1, "d1", 1.0), (1, 2, "d2", 0.9)], "query_id long, rank int, document_id string, final_score double")
    checked = spark.createDataFrame([(1, 1, "Section 318 BNS", "c1", "d1", "verified"), (1, 2, "Section 999 BNS", None, None, "flagged")], "answer_id long, claim_id int, raw_text string, chunk_id string, document_id string, status string")
    got = {r.query_id: r for r in answers.response(rows, found, checked).collect()}
    assert got[1].answer == "Section 318 BNS holds." and [c.chunk_id for c in got[1].citations] == ["c1"] and got[1].hallucination_flags == ["Section 999 BNS"]
    assert got[1].confidence == pytest.approx(0.6) and got[1].warnings == ["removed_claims", "few_sources"]
    assert got[2].confidence == pytest.approx(0.207, abs=0.001) and got[2].answer == "Plain." and got[2].hallucination_flags == []


def test_store_turns(spark):
    sessions = spark.createDataFrame([("s1", "u", "kept", 1, 1)], "session_id string, user_id string, title string, created_at long, updated_at long")
    turns = spark.createDataFrame([("s1", "u", "again", "a", 5), ("s2", "v", "first " * 30, "b", 7), ("s2", "v", "second", "c", 9)], "session_id string, user_id string, message string, answer string, at long")
    stored, messages = answers.store_turns(sessions, turns)
    got = {r.session_id: r for r in stored.collect()}
    assert (got["s1"].title, got["s1"].updated_at, got["s2"].created_at, got["s2"].updated_at) == ("kept", 5, 7, 9) and got["s2"].title == ("first " * 30)[:80].strip()
    assert sorted((r.session_id, r.created_at, r.role, r.content) for r in messages.collect())[:2] == [("s1", 5, "assistant", "a"), ("s1", 5, "user", "again")]


def test_tags_by_real_distance(spark):
    """A tag counts within 200 characters, whatever claims stand between; signs used as marks don't shift it."""
    far = "Section 12 BNS. " + "Section 13 BNS and so on. " * 9 + "<CHUNK:aaaa1111>"
    near = "a\u0001b\u0001 Section 12 BNS <CHUNK:bbbb2222> more"
    rows = spark.createDataFrame([(1, far), (2, near), (3, "<CHUNK:cccc3333> " + "x" * 150 + " Section 9 IPC"), (4, "<CHUNK:cccc3333> " + "x" * 250 + " Section 9 IPC")], "answer_id long, answer string")
    got = {(r.answer_id, r.section_num): r.tag for r in grounding.claims(rows).collect()}
    assert got == {(1, "12"): None, (1, "13"): None, (2, "12"): "bbbb2222", (3, "9"): "cccc3333", (4, "9"): None}


def test_subsection_in_the_base(spark):
    claims = grounding.claims(spark.createDataFrame([(1, "Section 318 BNS."), (2, "Section 31 BNS.")], "answer_id long, answer string"))
    none = spark.createDataFrame([], "answer_id long, rank int, chunk_id string, document_id string, section_ref string, law string, citation string")
    base = spark.createDataFrame([("k", "d", None, "318(2)", "BNS"), ("l", "e", None, "", "BNS")], "chunk_id string, document_id string, section_ref string, subsection_ref string, law string")
    got = grounding.verify(claims, none, base, spark.createDataFrame([], "document_id string, citation string")).collect()
    assert {(r.answer_id, r.stage, r.chunk_id) for r in got} == {(1, "base", "k"), (2, "base", "k")}


def test_small_rules(spark):
    row = spark.range(1).select(
        grounding.unsupported(F.lit("One is so. <CHUNK:aaaa> Two."), F.array(F.lit(" One is so. "), F.lit("Three."), F.lit(""))).alias("found"),
        *(summary.draft_confidence(F.lit(n)).alias(f"c{n}") for n in (0, 3, 12)),
        summary.issue_list(F.lit("1. First\n2. Second\n\nThird")).alias("issues"),
    ).first()
    assert row.found == ["One is so."] and (row.c0, row.c3, row.c12) == pytest.approx((0.2, 0.45, 0.6)) and row.issues == ["First", "Second", "Third"]
    users = spark.createDataFrame([(" A@x.org", True), ("b@x.org", False)], "email string, is_active boolean")
    assert catalog.active_user(users, "a@X.org ").count() == 1 and catalog.active_user(users, "b@x.org").count() == 0
    chunks = spark.createDataFrame([("d", 1, "two"), ("d", 0, "one"), ("e", 0, "x")], "document_id string, chunk_index int, content string")
    texts = {r.document_id: r.full_text for r in catalog.full_texts(chunks, spark.createDataFrame([("d", "Name")], "document_id string, title string")).collect()}
    assert texts == {"d": "Name\n====\n\none\n\ntwo", "e": "x"}
    in_order = [(r.document_id, r.chunk_index) for r in catalog.ordered_chunks(chunks).collect()]
    assert sorted(in_order) == [("d", 0), ("d", 1), ("e", 0)] and in_order.index(("d", 0)) < in_order.index(("d", 1))


def test_evaluation_of_a_golden_set(spark):
    golden = spark.createDataFrame([(1, ["31"], "a", 0.5), (2, ["9"], "b", 0.5), (3, [], "c", 0.5)], "query_id int, expected_sections array<string>, expected_intent string, min_confidence double")
    found = spark.createDataFrame([(1, "318"), (1, None), (2, "8")], "query_id int, section_ref string")
    records = spark.createDataFrame([(1, "a", 0.6, 10.0), (2, "x", 0.4, 20.0)], "query_id int, intent string, confidence double, latency_ms double")
    got = search.evaluate(golden, found, records).first()
    assert (got.section_hit_rate, got.intent_accuracy, got.confidence_rate, got.p50_ms) == (pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3), 15.0)


def test_claims_meet_one_chunk_of_a_section_and_law(spark):
    """A section named by many claims and held by many chunks makes no pairs of both: chunks are folded before the join."""
    claims = spark.createDataFrame([(f"a{i}", i, "section", "BNS", "7", None, None) for i in range(40)], "answer_id string, claim_id int, claim_type string, law string, section_num string, citation string, tag string")
    base = spark.createDataFrame([(f"c{i:03}", f"d{i}", "7", "7(1)", "IPC" if i % 2 else "BNS") for i in range(50)], "chunk_id string, document_id string, section_ref string, subsection_ref string, law string")
    none = spark.createDataFrame([], "answer_id string, rank int, chunk_id string, document_id string, section_ref string, law string, citation string")
    found = grounding.verify(claims, none, base, spark.createDataFrame([], "document_id string, citation string"))
    assert {(r.stage, r.chunk_id, r.document_id) for r in found.collect()} == {("base", "c000", "d0")} and found.count() == 40
    assert "Aggregate [section_ref" in found._jdf.queryExecution().optimizedPlan().toString()
