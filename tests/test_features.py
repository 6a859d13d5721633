"""Stored vectors, bucketed tables, keyed streams, uploads, sub-queries and prompts."""

import hashlib
import os
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.functions import query as Q
from brightloom.functions import text as T
from brightloom.functions.vectors import hashing_model
from brightloom.operators import answers, batches, dense, grounding, held, ingest, lexical, scoped, search
from brightloom.plans import harness
from brightloom.sources import files, tables
from brightloom.streaming import flush, state

DIR = "/root/testdata/sf0.001"


def test_coded_search_is_exact(spark, tmp_path):
    """What codes and bounds find is what brute force finds: several dimensions, null, zero and equal vectors, filters that differ by query."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 24))
    given = [(f"c{i:04d}", (centres[i % 5] + 0.4 * rng.normal(size=24)).tolist(), i % 3) for i in range(900)] + [(f"d{i}", rng.normal(size=8).tolist(), i % 3) for i in range(40)]
    given += [("e1", None, 0), ("e2", [0.0] * 24, 0), ("e3", given[0][1], 0), ("e4", [], 0)]
    rows = spark.createDataFrame(given, "chunk_id string, embedding array<double>, kind int").repartition(4)
    dense.write_vectors(rows, str(tmp_path / "v"))
    codes, vectors = dense.read_vectors(spark, str(tmp_path / "v"))
    assert codes.count() == 941 and codes.agg(F.max("error")).first()[0] < 0.02
    asked = [(q, (centres[q % 5] + 0.1 * rng.normal(size=24)).tolist(), [q % 3] if q % 2 else None) for q in range(12)] + [(50, given[905][1], None), (51, [0.0] * 24, None), (52, [1.0] * 5, None)]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>, kinds array<int>")
    fits = lambda of: of("kinds").isNull() | F.array_contains(of("kinds"), F.col("kind"))
    got = {}
    for r in dense.coded_search(codes, vectors, queries, 10, 0.1, keep=F.col("chunk_id") != "c0001", fits=fits).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, e, kinds in asked:
        u = np.array(e)
        ranked = sorted((-(u @ v) / np.linalg.norm(u) / np.linalg.norm(v), c) for c, x, k in given if x and len(x) == len(e) and any(x) and any(e) and c != "c0001" and (kinds is None or k in kinds) for v in [np.array(x)])
        assert got.get(q, []) == [c for s, c in ranked if -s >= 0.1][:10]
    same = dense.vector_search(rows, queries.select("query_id", "embedding"), 10, 0.1).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in same) == sorted((r.query_id, r["rank"], r.chunk_id) for r in dense.coded_search(codes, vectors, queries.select("query_id", "embedding"), 10, 0.1).collect())
    plan = dense.coded_search(codes, vectors, queries.select("query_id", "embedding"), 10, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "codes" in plan and plan.index("Join") < plan.index("MapInArrow")
    assert dense.coded_search(codes, vectors, queries.where("false"), 10).count() == 0


@pytest.mark.parametrize("cells", [64, 1 << 21])
def test_scan_search_equals_pairs(spark, monkeypatch, cells):
    """Blocks of vectors against all queries give the very scores of pairs: several dimensions, null, zero and many equal vectors, unknown metadata, filters that differ by query."""
    monkeypatch.setattr(dense, "CELLS", cells)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 24))
    given = [(f"c{i:04d}", (centres[i % 5] + 0.4 * rng.normal(size=24)).tolist(), i % 3) for i in range(400)] + [(f"d{i}", rng.normal(size=8).tolist(), None) for i in range(40)]
    given += [("e1", None, 0), ("e2", [0.0] * 24, 0), ("e4", [], 0), ("e5", [None] * 24, 0)] + [(f"f{(i * 7) % 60:02d}", given[3][1], 0) for i in range(60)]
    rows = spark.createDataFrame(given, "chunk_id string, embedding array<float>, kind int").repartition(3)
    asked = [(q, (centres[q % 5] + 0.1 * rng.normal(size=24)).tolist(), [q % 3] if q % 2 else None) for q in range(12)] + [(50, given[405][1], None), (51, [0.0] * 24, None), (52, [1.0] * 5, None), (53, given[3][1], [0]), (54, None, None)]
    queries = held.batch(spark.createDataFrame(asked, "query_id int, embedding array<float>, kinds array<int>"))
    fits = lambda of: of("kinds").isNull() | F.array_contains(of("kinds"), F.col("kind"))
    decided = batches.allowed(rows, ["kind"], queries.select("query_id", "kinds"), fits)
    key = lambda r: (r.query_id, r["rank"], r.chunk_id, r.score)
    want = sorted(map(key, dense.vector_search(rows, queries, 10, 0.1, pair=F.coalesce(fits(F.col), F.lit(False))).collect()))
    got = sorted(map(key, dense.scan_search(rows, queries, decided, 10, 0.1).collect()))
    assert got == want and [c for q, _, c, _ in got if q == 53] == [f"c{3:04d}", *(f"f{i:02d}" for i in range(9))] and any(q == 50 for q, *_ in got)
    assert dense.scan_search(rows, queries.where("false"), decided, 10).count() == 0


def test_vectors_that_carry_their_metadata_are_not_joined(spark, tmp_path, monkeypatch):
    """Vectors go to the queries where they are made; nulls of the metadata stay nulls."""
    model, asked = hashing_model(16), spark.createDataFrame([(1, "bail was granted by the court in the end"), (2, "is bail granted by the court IPC")], "query_id long, query string")
    rows = corpus(spark).withColumn("year", F.when(F.col("chunk_id") != "c4", F.col("year")))
    vectors = ingest.embed_chunks(rows, model, 16, carry=("law", "court", "year"))
    assert sorted(map(str, vectors.select("chunk_id", "law", "court", "year").collect())) == sorted(map(str, rows.select("chunk_id", "law", "court", "year").collect()))
    found, scan = [], dense.scan_search
    monkeypatch.setattr(dense, "scan_search", lambda rows, *more: found.append(rows._jdf.queryExecution().optimizedPlan().toString()) or scan(rows, *more))
    plain, carried = (sorted((r.query_id, r.chunk_id, r.final_rank) for r in search.retrieve(rows, asked, v, model, 16).collect()) for v in (vectors.select("chunk_id", "embedding"), vectors))
    assert plain == carried and plain and "Join" in found[0] and "Join" not in found[1]


def test_the_stand_in_hashes_a_word_once(monkeypatch):
    seen, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda word: seen.append(word) or md5(word))
    made = hashing_model(8)(["a b a", "b A", None])
    assert sorted(seen) == [b"a", b"b"] and made[0] != made[1] and made[2] == [0.0] * 8


def test_survivors_are_few(spark, tmp_path):
    """Of 3,000 vectors the codes leave little more than k for each query."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    dense.write_vectors(spark.createDataFrame(pa.table({"chunk_id": [f"c{i}" for i in range(3000)], "embedding": list(x)})), str(tmp_path / "v"))
    codes, _ = dense.read_vectors(spark, str(tmp_path / "v"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    held = {r.chunk_id: (np.array(r.codes) * r.scale, r.error) for r in codes.collect()}
    for q in range(20):
        low, up = zip(*((unit[q] @ c - e, unit[q] @ c + e) for c, e in held.values()), strict=True)
        assert sum(u >= np.sort(low)[-10] for u in up) <= 30


def test_bucketed_tables_join_without_a_shuffle(spark):
    d, c = harness.by_document(spark, DIR)
    plans = [
        c.groupBy("document_id").agg(F.count("*").alias("n")),
        d.join(c.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left"),
        d.hint("merge").join(c, "document_id"),
    ]
    for p in plans:
        p.collect()
        assert "hashpartitioning" not in p._jdf.queryExecution().executedPlan().toString()
    assert c.count() == harness.chunks(spark, DIR).count() and d.count() == harness.documents(spark, DIR).count()


def test_newest_of_repeated_keys(spark):
    rows = [("a", 2, "x"), ("a", 3, None), ("a", 3, "b"), ("b", None, "y")]
    for n in (1, 3):
        frame = spark.createDataFrame(rows, "id string, v int, t string").repartition(n)
        assert sorted(map(str, tables.newest(frame, "id").collect())) == sorted(map(str, spark.createDataFrame([("a", 3, "b"), ("b", None, "y")], "id string, v int, t string").collect()))


def test_counts_over_batches_and_a_restart(spark, tmp_path):
    """Each batch writes only what it changed; a base of all keys is made along the way; a restart goes on."""
    put = lambda ids: spark.createDataFrame([(i,) for i in ids], "document_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    for ids in ("aab", "bc", "c", "ad", "d"):
        put(ids)
        seen += ids
        stream = spark.readStream.schema("document_id string").parquet(str(tmp_path / "in"))
        run, _ = state.write_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), every=None)
        run.awaitTermination()
        kept = state.Changes(spark, str(tmp_path / "out"), "document_id", "document_id string, n long", base_every=2)
        assert {r.document_id: r.n for r in kept.read().collect()} == {i: seen.count(i) for i in set(seen)}
        last = max(int(f.split("=")[1]) for f in os.listdir(tmp_path / "out" / "changes"))
        assert {r.document_id for r in spark.read.parquet(str(tmp_path / f"out/changes/batch={last}")).collect()} == set(ids)
    changes = [(0, [("a", 1), ("b", 1)]), (1, [("b", 2)]), (2, [("c", 1)]), (3, [("a", 5)]), (4, [("b", 9)]), (4, [("b", 9)])]
    table = state.Changes(spark, str(tmp_path / "t"), "k", "k string, v int", base_every=2)
    for i, rows in changes:
        table.put(spark.createDataFrame(rows, "k string, v int"), i)
    assert {r.k: r.v for r in table.read().collect()} == {"a": 5, "b": 9, "c": 1} and sorted(os.listdir(tmp_path / "t" / "bases"))[-1] == "base=3"


def test_cache_entries_expire(spark, tmp_path):
    rows = [("k", 1, 0, "one"), ("k", 2, 50, None), ("k", 3, 99, "two"), ("k", 4, 150, None), ("k", 5, 199, None), ("j", 6, 10, None)]
    later = [("k", 7, 200, None), ("j", 8, 210, "three"), ("j", 9, 250, None)]
    last = [("j", 10, 5000, None), ("k", 11, 5000, "four"), ("k", 12, 5001, None)]
    for part in (rows, later, last):
        frame = spark.createDataFrame(part, "key string, id long, s long, result string").select("key", "id", F.timestamp_seconds(F.col("s") + 1000).alias("at"), "result")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, id long, at timestamp, result string").parquet(str(tmp_path / "in"))
        state.cache_results(stream, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.result for r in spark.read.schema("id long, result string").parquet(str(tmp_path / "out")).collect()}
    assert got == {2: "one", 4: "two", 5: None, 6: None, 7: None, 9: "three", 10: None, 12: "four"}


DDL = "chunk_id string, document_id string, content string, chunk_index int, section_ref string, subsection_ref string, deleted boolean"


def test_stream_into_the_index(spark, tmp_path):
    """Updates and deletions from a stream, a failure between two batches and its files archived: as if indexed anew, nothing lost, nothing twice."""
    chunk = lambda d, v, n=3: [(f"{d}-{v}-{i}", d, f"word{v} bail {d}", i, str(10 * v + i), None, False) for i in range(n)]
    batches = [chunk("a", 1) + chunk("b", 1), chunk("a", 2, 2) + chunk("c", 1), [(None, "b", None, None, None, None, True)], chunk("d", 1) + [(None, "c", None, None, None, None, True)]]
    path, broken = str(tmp_path / "index"), {2: True}
    plain = lexical.write_index.__globals__["_commit"]

    def failing(spark_, path_, number, segments, english, batch, sizes):
        if broken.pop(number, False):
            raise RuntimeError("lost")
        plain(spark_, path_, number, segments, english, batch, sizes)

    from brightloom.operators import index

    index._commit = failing
    try:
        for rows in batches:
            spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            for _ in range(2):  # again after a failure
                stream = flush.staged_stream(spark, str(tmp_path / "in"), DDL, 1, archive=str(tmp_path / "archive"))
                run = flush.index_stream(stream, path, str(tmp_path / "cp"), every=None)
                try:
                    run.awaitTermination()
                    break
                except Exception as e:
                    assert "lost" in str(e)
    finally:
        index._commit = plain
    want = [r[:-1] for r in chunk("a", 2, 2) + chunk("d", 1)]
    made = lexical.read_index(spark, path)
    assert not broken and sorted(r.chunk_id for r in made.live(made.chunks).collect()) == sorted(r[0] for r in want) and made.n == len(want)
    fresh = lexical.write_index(spark.createDataFrame(want, DDL.removesuffix(", deleted boolean")), str(tmp_path / "fresh"))
    asked = spark.createDataFrame([(1, "bail word2"), (2, "word1")], "query_id int, query string")
    assert sorted(map(str, lexical.bm25(made, asked).collect())) == sorted(map(str, lexical.bm25(fresh, asked).collect()))
    staged = [f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]
    archived = [f for _, _, names in os.walk(tmp_path / "archive") for f in names if f.endswith(".parquet")]
    assert len(set(staged) | set(archived)) == len(batches) and archived and not set(staged) & set(archived)


def test_uploads_of_any_size(spark, tmp_path):
    """Parts out of order, repeated and overlapping become files; an upload with a gap leaves none."""
    rng = np.random.default_rng(1)
    whole = {"u": rng.bytes(300_000), "v": b"short", "gap": rng.bytes(1000), "empty": b""}
    parts = [("u", a, bytearray(whole["u"][a : a + 70_000]), 300_000) for a in range(0, 300_000, 50_000)] * 2 + [("v", 0, bytearray(b"short"), 5), ("gap", 0, bytearray(whole["gap"][:400]), 1000), ("gap", 500, bytearray(whole["gap"][500:]), 1000), ("empty", 0, bytearray(b""), 0)]
    frame = spark.createDataFrame(parts[::-1], "upload_id string, start long, content binary, total long").repartition(5)
    made = {r.upload_id: r for r in files.write_uploads(frame, str(tmp_path / "up")).collect()}
    assert {k: (r.size, r.complete) for k, r in made.items()} == {"u": (300_000, True), "v": (5, True), "gap": (400, False), "empty": (0, True)}
    assert all((tmp_path / "up" / k).read_bytes() == whole[k] for k in ("u", "v", "empty")) and sorted(os.listdir(tmp_path / "up")) == ["empty", "u", "v"]


def corpus(spark):
    texts = {"c1": "bail was granted", "c2": "murder and bail", "c3": "the court adjourned", "c4": "murder murder"}
    rows = [(k, f"d{k}", t, i, len(t), "passage", None, None, 1, "BNS", "Supreme Court", 2020) for i, (k, t) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, content string, chunk_index int, content_length int, chunk_type string, section_ref string, subsection_ref string, page_number int, law string, court string, year int")


def test_sub_queries(spark):
    asked = spark.createDataFrame([(1, 0, "  "), (1, 1, "bail"), (1, 2, "murder"), (1, 5, "court"), (1, 6, "adjourned"), (2, 0, "adjourned"), (3, 0, None)], "query_id int, sub_query int, query string")
    plain = search.retrieve_multi(corpus(spark), asked).orderBy("query_id", "final_rank").collect()
    assert [r.chunk_id for r in plain if r.query_id == 1][0] == "c2" and {r.chunk_id for r in plain if r.query_id == 1} == {"c1", "c2", "c3", "c4"}
    assert [r.chunk_id for r in plain if r.query_id == 2] == ["c3"] and {r.query_id for r in plain} == {1, 2}
    asked_for = set()

    def score(pairs):
        assert all(q == "bail" or q in ("murder", "court", "adjourned") for q, _ in pairs)
        return [5.0 if "granted" in c else -5.0 for _, c in pairs]

    found = search.retrieve_multi(corpus(spark), asked, reranker=score).orderBy("query_id", "final_rank").collect()
    assert [r.chunk_id for r in found if r.query_id == 1][0] == "c1" and not asked_for


def test_prompts_by_intent_and_replies(spark):
    contexts = spark.createDataFrame([(1, "q1", "s1", "case_search"), (2, "q2", "", "other"), (3, "q3", "{query}", "drafting_request")], "query_id long, query string, context string, intent string")
    history = spark.createDataFrame([(1, 1, "user", "before")], "query_id long, turn int, role string, content string")
    templates = {"case_search": "CASES {history}|{context}|{query}", "general_query": "ANY {context}|{query}"}
    made = answers.prompts(contexts, history, templates=templates)
    assert {r.query_id: r.prompt for r in made.collect()} == {1: "CASES USER: before|s1|q1", 2: "ANY No relevant sources found.|q2", 3: "ANY q3|q3"}
    calls = []

    def model(prompts):
        calls.append(1)
        if any(p.startswith("CASES") for p in prompts):
            raise TimeoutError("slow")
        return [p.upper() for p in prompts]

    got = {r.query_id: (r.reply, r.error) for r in ingest.complete(made.coalesce(1), model, batch=1).collect()}
    assert got == {1: (None, "TimeoutError: slow"), 2: ("ANY NO RELEVANT SOURCES FOUND.|Q2", None), 3: ("ANY Q3|Q3", None)}


def test_metadata_of_scoped_hits_and_payloads(spark):
    d = spark.createDataFrame([("dc1", "judgment", "bns", 2020), ("dc2", None, None, None)], "document_id string, document_type string, law string, year int")
    hits = scoped.in_document(corpus(spark), spark.createDataFrame([(1, "dc1", "bail granted"), (2, "dc3", "court")], "query_id int, document_id string, query string"), documents=d)
    assert {(r.query_id, r.chunk_id, r.law, r.year) for r in hits.collect()} == {(1, "c1", "bns", 2020), (2, "c3", None, None)} and set(scoped.METADATA) <= set(hits.columns)
    kept = {r.chunk_id: r for r in ingest.payloads(corpus(spark).withColumn("chunk_type", F.lit(None).cast("string")), d).collect()}
    assert (kept["c1"].law, kept["c1"].is_landmark, kept["c1"].language, kept["c1"].chunk_type) == ("BNS", False, "en", "passage") and (kept["c2"].document_type, kept["c3"].law) == ("upload", "Other")
    assert len(kept["c1"].asDict()) == 23


def test_retrieve_with_codes(spark, tmp_path):
    model, asked = hashing_model(16), spark.createDataFrame([(1, "bail was granted by the court in the end")], "query_id long, query string")
    vectors = ingest.embed_chunks(corpus(spark), model, 16).select("chunk_id", "embedding")
    dense.write_vectors(vectors, str(tmp_path / "v"))
    codes, stored = dense.read_vectors(spark, str(tmp_path / "v"))
    plain, coded = (sorted((r.chunk_id, r.final_rank) for r in search.retrieve(corpus(spark), asked, v, model, 16, codes=c).collect()) for v, c in ((vectors, None), (stored, codes)))
    assert plain == coded and plain


@pytest.mark.parametrize(("text", "want"), [("IPC 302", '"IPC 302" OR BNS OR Indian Penal Code OR 103'), ("s. 12 bail", '"s. 12 bail" OR section 12'), ("A v. B", '"A v. B" OR versus'), ("plain words ", "plain words")])
def test_synonyms(spark, text, want):
    assert spark.range(1).select(Q.expand_synonyms(F.lit(text)).alias("x")).first().x == want


def test_rules_on_small_rows(spark):
    answers_ = spark.createDataFrame([(1, "Section 318 BNS defines cheating <CHUNK:a1b2c3d4>. See AIR 2017 SC 4609 <CHUNK:ffff0000>."), (2, "Section 482 BNSS grants bail. Section 999 BNS is invented. Section 482 BNSS again."), (4, "Tagged wrongly, section 12 <CHUNK:a1b2c3d4>; (2017) 10 SCC 1 is known.")], "answer_id long, answer string")
    retrieved = spark.createDataFrame([(1, 1, "a1b2c3d4-0001", "d1", "318", "BNS", None), (1, 2, "ffff0000-0002", "d2", None, None, "AIR 2017 SC 4609"), (2, 1, "eeee1111-0003", "d3", "482", "CrPC", None), (4, 1, "a1b2c3d4-0001", "d1", "318", "BNS", None)], "answer_id long, rank int, chunk_id string, document_id string, section_ref string, law string, citation string")
    base = spark.createDataFrame([("k1", "d9", "12", None, "IPC", "section"), ("k2", "d8", None, None, "Other", "final_order")], "chunk_id string, document_id string, section_ref string, subsection_ref string, law string, chunk_type string")
    books = spark.createDataFrame([("d8", "(2017) 10 SCC 1"), ("d9", None)], "document_id string, citation string")
    got = {(r.answer_id, r.claim_id): (r.stage, r.document_id, r.status) for r in grounding.verify(grounding.claims(answers_), retrieved, base, books).collect()}
    assert got == {(1, 1): ("tag", "d1", "verified"), (1, 2): ("tag", "d2", "verified"), (2, 1): ("fuzzy", "d3", "verified"), (2, 2): (None, None, "flagged"), (4, 1): ("base", "d9", "verified"), (4, 2): ("base", "d8", "verified")}
    scored = spark.createDataFrame([(1, [1.0, 0.9, 0.8], 3, 2, 0), (2, [0.9], 1, 0, 0), (3, [], 0, 0, 0), (4, [1.0, 1.0, 1.0], 3, 5, 1), (5, [1.0, 1.0, 1.0], 3, 9, 4)], "id long, scores array<double>, documents int, verified int, flagged int")
    c = grounding.confidence(*map(F.col, ("scores", "documents", "verified", "flagged")))
    assert [(r.confidence, r.band) for r in scored.orderBy("id").select(c["confidence"].alias("confidence"), c["band"].alias("band")).collect()] == [(0.955, "high"), (0.514, "medium"), (0.207, "low"), (0.6, "medium"), (0.45, "medium")]
    steps = "Do this:\n1. File the first petition\n2. short\n- Serve the notice on them"
    row = spark.range(1).select(
        grounding.procedural_steps(F.lit(steps), F.lit("procedure_query")).alias("steps"),
        grounding.strip_flagged(F.lit("Good one. Section 999 BNS says so. Last."), F.array(F.lit("section 999 bns"))).alias("kept"),
        T.page_of(F.lit(25), F.create_map(*map(F.lit, (0, 1, 10, 2, 30, 3)))).alias("page"),
        answers.parse_json(F.lit('```json\n{"a": 2}\n```'), "a int")["a"].alias("a"),
        T.normal_citation(F.lit(" (2017) 10 SCC, 1.")).alias("cite"),
        Q.vector_gate(F.lit(1), F.lit(10), F.lit("section 318 meaning of cheating in law")).alias("gate"),
    ).first()
    assert row.steps == ["File the first petition", "Serve the notice on them"] and row.kept == "Good one. Last." and (row.page, row.a, row.cite, row.gate) == (2, 2, "2017 10 scc 1", False)


def test_uploads_are_read_where_they_are_named(spark, tmp_path):
    """Digests of files of any size come from tasks that open them piece by piece; no folder is listed."""
    folder = tmp_path / "up"
    folder.mkdir()
    data = {"a": b"x" * 100_000, "b c%20": b"", "é": "é".encode() * 7}
    for name, content in data.items():
        (folder / name).write_bytes(content)
    (folder / ".half.3").write_bytes(b"left by an attempt")
    given = spark.createDataFrame([(n, f"{folder}/{n}") for n in data] + [("gap", None)], "upload_id string, path string")
    got = {r.upload_id: (r["size"], r.md5) for r in files.digests(given, 1000).collect()}
    assert got == {n: (len(c), hashlib.md5(c).hexdigest()) for n, c in data.items()}


def test_more_documents_make_more_buckets(spark, monkeypatch, tmp_path):
    """A bucket is what a task sorts and groups: their number grows with the stored documents, both tables have the same, and grouping needs no shuffle."""
    shutil.copytree(DIR, tmp_path / "t")
    table = tmp_path / "t" / "documents.parquet"
    size = sum(f.stat().st_size for f in (table.rglob("*.parquet") if table.is_dir() else [table]))
    for bucket, n in ((harness.BUCKET, 16), (size // 20 + 1, 20)):
        monkeypatch.setattr(harness, "BUCKET", bucket)
        monkeypatch.setattr(harness, "_INDEXES", {})
        d, c = harness.by_document(spark, str(tmp_path / "t"))
        for x in (d, c):
            plan = x.groupBy("document_id").count()._jdf.queryExecution().executedPlan().toString()
            assert f"{n} out of {n}" in plan and "Exchange" not in plan
        assert c.count() == harness.chunks(spark, DIR).count()


def test_cache_states_reach_workers_in_batches(spark, tmp_path):
    """No worker is asked for each key's state in turn."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, id long, at timestamp, result string").parquet(str(tmp_path / "in"))
    plan = state.cache_results(stream, 100)._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
