"""Text rules, chunking, packing, verification and scoring by hand-made cases and small models of the rules."""

import math
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.functions import chunking, text
from brightloom.functions.query import understand
from brightloom.functions.stem import stem
from brightloom.functions.vectors import cosine, embed, hashing_model, unit
from brightloom.operators import catalog, context, dense, fusion, grounding, lexical, summary
from brightloom.schemas import LAWS, known


def chunked(spark, raw, **more):
    rows = spark.createDataFrame([("d", raw)], "document_id string, text string")
    return chunking.chunk_documents(rows.withColumns({k: F.create_map(*(F.lit(x) for kv in v.items() for x in kv)) for k, v in more.items()})).orderBy("chunk_index").collect()


STATUTE = "318. Cheating.—Whoever, by deceiving any person, fraudulently induces the person so deceived to deliver any property to any person, or to consent that any person shall retain any property, is said to cheat. "
JUDGMENT = "FACTS: The petitioner was arrested on suspicion and kept in custody for many days without any charge being framed against the petitioner at all by police. " "ISSUES: Whether the arrest was lawful and whether the petitioner may be released on bail pending trial under the provisions that apply to the present case here. " "FINAL ORDER: The petition is allowed and the petitioner shall be released on bail forthwith on such terms as the trial court thinks fit to impose in this case."


def test_statute_chunk(spark):
    found = chunked(spark, STATUTE)
    assert [r.section_ref for r in found] == ["318"] and found[0].chunk_type == "section"


def test_judgment_chunks(spark):
    found = chunked(spark, JUDGMENT)
    assert len(found) == 3 and found[-1].chunk_type == "final_order"


def test_chunk_sizes(spark):
    long = " ".join(f"Sentence number {i} says something of medium length here." for i in range(150))
    found = chunked(spark, long, pages={0: 1, 3000: 2})
    assert all(150 <= r.content_length <= 2100 for r in found) and {r.page_number for r in found} == {1, 2}
    assert chunked(spark, "Too short.") == [] and chunked(spark, None) == []


def test_fold_properties():
    """Of random sentences: order, what chunks share, why each ends."""
    rng = random.Random(3)
    for _ in range(200):
        s = [("FACTS: " if rng.random() < 0.1 else "") + f"{i:03d}" + "x" * rng.choice((2, 15, 30, 60)) for i in range(rng.randrange(1, 30))]
        whole = " ".join(s)
        found = chunking.fold(s, whole, target=100)
        at, last = {x: i for i, x in enumerate(s)}, -1
        split = lambda c: [x for x in s if x in c]  # noqa: E731  sentences are numbered, so none holds another
        for c, start in found:
            part = split(c)
            assert c == " ".join(part) and whole[start:].startswith(part[0])
            first, new = at[part[0]], at[part[-1]]
            assert [at[x] for x in part] == list(range(first, new + 1)) and last - 1 <= first <= last + 1
            if first == last + 1 and last >= 0:
                assert part[0].startswith("FACTS:")
            if new + 1 < len(s):  # it ends for size or before a heading
                assert sum(map(len, part)) + len(s[new + 1]) > 100 or s[new + 1].startswith("FACTS:")
            last = new
        assert last == len(s) - 1 or len(s[-1]) < 20


def test_judgment_parts(spark):
    t = "Intro " * 30 + "FACTS: " + "a" * 60 + " HELD: " + "b" * 60 + " FINAL ORDER: " + "c" * 60
    given = [(1, t), (2, "nothing"), (3, None), (4, "  HELD: " + "h" * 60 + " FACTS: " + "f" * 3000 + " ISSUES: no HELD: " + "k" * 200), (5, "")]
    got = {r.i: r.p for r in spark.createDataFrame(given, "i int, t string").select("i", chunking.judgment_parts(F.col("t")).alias("p")).collect()}
    kinds = {i: [(x.chunk_type, len(x.content)) for x in p] if p is not None else None for i, p in got.items()}
    assert kinds[1] == [("passage", 179), ("facts", 67), ("findings", 66), ("final_order", 73)]
    assert kinds[2] == [("passage", 7)] and kinds[3] is None and kinds[5] == [("passage", 0)]
    assert kinds[4] == [("facts", 2500), ("findings", 206)]  # the first mark in turn is FACTS; what stands before it is under 100 characters


def plain_windows(lengths, size, overlap):
    """Sentence by sentence: the windows' sentence numbers."""
    out, held = [], []
    for i, n in enumerate(lengths):
        if held and sum(lengths[j] for j in held) + n > size:
            out.append(held)
            held = [j for j in held if sum(lengths[j : held[-1] + 1]) <= overlap]
        held = [*held, i]
    return [*out, held] if held else out


def test_windows():
    assert chunking.windows(["aa", "bb", "cc"], 4, 2) == ["aa bb", "bb cc"] and chunking.windows([]) == []
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice((1, 3, 9, 30, 80)) for _ in range(rng.randrange(0, 40))]
        size, overlap = rng.choice((20, 60, 100)), rng.choice((0, 5, 25))
        assert [list(range(*b)) for b in chunking.window_bounds(chunking.np.array(lengths, int), size, overlap)] == plain_windows(lengths, size, overlap)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("What does BNS Section 318 say about cheating?", {"section_refs": ["318"], "law_filter": ["BNS"], "intent": "provision_lookup"}),
        ("Draft an anticipatory bail application", {"draft_type": "anticipatory_bail", "intent": "drafting_request"}),
        ("Supreme Court judgments from 2022 to 2024", {"year_from": 2022, "year_to": 2024, "court_filter": ["Supreme Court"]}),
        ("How to file a complaint", {"intent": "procedure_query", "draft_type": "complaint"}),
    ],
)
def test_understand(spark, query, want):
    row = understand(spark.createDataFrame([(query,)], "query string")).first()
    assert {k: row[k] for k in want} == want


def test_clean_text(spark):
    raw = "Café\x0cx\n\n\n\ny\nPage 3 of 9\n 12 \nz  "
    got = spark.createDataFrame([(raw,), (None,)], "t string").select(text.clean_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == ["Café x\n\ny\n\nz", ""]


def plain_cut(t, n):
    """All places that a kind of separator may end, the last of the first kind that has one in the second half."""
    if len(t) <= n:
        return t
    for sep in (".\n", ". ", "?\n", "? ", "!\n", "! ", ".—", "—", ";\n", "; "):
        places = [i for i in range(n - len(sep) + 1) if t[i : i + len(sep)] == sep and 2 * i >= n - n % 2]
        if places:
            return t[: places[-1] + len(sep)].rstrip() + " [...]"
    words = [i for i in range(1, n) if t[i] == " "]
    return t[: words[-1]] + " [...]" if words else t[:n] + "[...]"


def test_trim_matches_model(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice(["ab", ". ", "; ", " ", "—", ".\n", "! "]) for _ in range(60)), rng.randrange(5, 90)) for _ in range(200)]
    got = spark.createDataFrame(rows, "t string, n int").select("t", "n", text.trim_to_boundary(F.col("t"), F.col("n")).alias("c")).collect()
    assert [r.c for r in got] == [plain_cut(r.t, r.n) for r in got]


def test_pack_budget(spark):
    rows = [("q", f"c{i}", "hhhhhhhhhh", "word " * 40, "passage", 1.0, i) for i in range(2)] + [("r", "c9", "h" * 300, "text", "ratio", 1.0, 1)]
    frame = spark.createDataFrame(rows, "query_id string, chunk_id string, header string, content string, chunk_type string, final_score double, rank int")
    got = {r.query_id: r for r in context.pack(frame, 330, chars_per_token=1).collect()}
    assert got["q"].blocks == 2 and len(got["q"].context) <= 340 and got["q"].context.endswith("[...]")
    assert (got["r"].blocks, got["r"].context) == (0, "")
    short = frame.withColumns({c: F.lit(None).cast("string") for c in ("citation", "law", "court_name")}).withColumns({"section_ref": F.lit("12"), "page_number": F.lit(3), "content": F.lit("One. Two three" + " x" * 200)})
    packed = {r.query_id: r.context for r in context.compress(short, 60).collect()}
    assert packed["r"] == "[§12 | p.3]\nOne. [...]"


def test_dedup_is_greedy(spark):
    rows = [("q", 1, "a", "Same  Text"), ("q", 2, "b", "same text"), ("q", 3, "c", "other"), ("r", 1, "a", "same text")]
    got = context.deduplicate(spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, content string")).collect()
    assert sorted((r.query_id, r.chunk_id) for r in got) == [("q", "a"), ("q", "c"), ("r", "a")]


def test_rrf_value(spark):
    rows = spark.createDataFrame([("q", "c", 1.0, 1)], "query_id string, chunk_id string, score double, rank int")
    assert math.isclose(fusion.rrf([(rows, 1.0)], digits=12).first().score, 1 / 61, abs_tol=1e-9)


def test_claim_flagged(spark):
    answers = spark.createDataFrame([(1, "Section 999 BNS is so.")], "answer_id long, answer string")
    none = spark.createDataFrame([], "answer_id long, rank int, chunk_id string, document_id string, section_ref string, subsection_ref string, law string, citation string")
    row = grounding.verify(grounding.claims(answers), none, none, none).first()
    assert (row.status, row.stage) == ("flagged", None)


def test_raw_claims(spark):
    answers = spark.createDataFrame([(1, "Section 482 BNSS; it uses. 5")], "answer_id long, answer string")
    assert [(r.section_num, r.law) for r in grounding.claims(answers).collect()] == [("482", "BNSS")]
    assert sorted((r.section_num, r.law) for r in grounding.claims(answers, raw=True).collect()) == [("482", "BNS"), ("5", None)]


def test_alias_rule(spark):
    """A retrieved chunk of another law counts only where the looser rule is asked for."""
    answers = spark.createDataFrame([(1, "Section 12 BNS applies.")], "answer_id long, answer string")
    got = spark.createDataFrame([(1, 1, "k", "d", "12", "BSA", None)], "answer_id long, rank int, chunk_id string, document_id string, section_ref string, law string, citation string")
    none = spark.createDataFrame([], "chunk_id string, document_id string, section_ref string, subsection_ref string, law string, citation string")
    claims = grounding.claims(answers)
    assert grounding.verify(claims, got, none, none).first().status == "flagged"
    assert grounding.verify(claims, got, none, none, fuzzy_any_law=True).first().stage == "fuzzy"


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 10], [5.0, 7.0], list(range(40)), [3, 1, 2, 9, 8, 7, 7]])
def test_quantile(spark, values):
    want = statistics.quantiles(values, n=20)[18] if len(values) >= 5 else max(values)
    got = spark.createDataFrame([([float(v) for v in values],)], "v array<double>").select(summary.quantile(F.col("v"), 20, 19).alias("q")).first().q
    assert math.isclose(got, want)


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control")])
def test_stem(word, want):
    assert stem(word) == want


def test_websearch():
    assert lexical.parse_websearch('bail -"high court" OR murder') == [[(True, ["bail"]), (False, ["high", "court"])], [(True, ["murder"])]]
    assert lexical.parse_websearch("  ") == []


def test_cover_density_order():
    near, far = [(2, "bail"), (4, "murder")], [(1, "bail"), (6, "murder")]
    rank = lambda line: lexical.cover_density(line, {"bail", "murder"})
    assert rank(near) > rank(far) > rank([(1, "bail")]) == 0


def test_websearch_over_an_index(spark, tmp_path):
    """Matching by places against each text's words one by one; also with stems."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("bail murder high court the running".split()) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    frame = spark.createDataFrame([(f"c{i:02d}", "d", t) for i, t in enumerate(texts)], "chunk_id string, document_id string, content string")
    asked = ["bail murder", '"high court" -bail', "bail OR \"murder the\"", "-bail", "", "zzz", '"bail bail"']
    made = lexical.index(frame)
    lexical.write_index(frame, str(tmp_path / "i"))
    for x in (made, lexical.read_index(spark, str(tmp_path / "i"))):
        got = {(r.query_id, r.chunk_id) for r in lexical.websearch(x, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).where("rank > 0").collect()}

        def holds(words, term):
            return any(words[k : k + len(term)] == term for k in range(len(words)))

        want = {(q, f"c{i:02d}") for q, query in enumerate(asked) for i, t in enumerate(texts) for a in lexical.parse_websearch(query) if any(w for w, _ in a) and all(holds(t.split(), term) == w for w, term in a)}
        assert got == want
    plan = lexical.bm25_scores(lexical.read_index(spark, str(tmp_path / "i")), spark.createDataFrame([(1, "bail")], "query_id int, query string"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lexeme), EqualTo(lexeme,bail)" in plan or "In(lexeme, [bail])" in plan
    english = lexical.index(frame, english=True)
    found = lexical.websearch(english, spark.createDataFrame([(1, "runs the")], "query_id int, query string")).collect()
    assert {r.chunk_id for r in found} == {f"c{i:02d}" for i, t in enumerate(texts) if "running" in t}
    fields = {"content": made, "other": made}
    both = lexical.multi_field(fields, spark.createDataFrame([(1, "bail")], "query_id int, query string"), {"content": 2.0, "other": 1.0}).collect()
    one = {r.chunk_id: r.score for r in lexical.bm25(made, spark.createDataFrame([(1, "bail")], "query_id int, query string")).collect()}
    assert all(math.isclose(r.score, 2 * one[r.chunk_id] + 0.3 * one[r.chunk_id], abs_tol=1e-5) for r in both) and both


def test_exact_sections(spark):
    rows = [("a", 1, "318", None), ("b", 2, "12A", None), ("c", 3, None, "318(2)"), ("d", 4, "31", None), ("e", 5, "", "")]
    frame = spark.createDataFrame(rows, "chunk_id string, chunk_index int, section_ref string, subsection_ref string")
    asked = spark.createDataFrame([(1, "318(2)(a)"), (2, "12a"), (3, "3"), (4, "Schedule I")], "query_id int, section string")
    got = {(r.query_id, r["rank"], r.chunk_id) for r in lexical.exact_sections(frame, asked).collect()}
    assert got == {(1, 1, "a"), (1, 2, "c"), (2, 1, "b"), (3, 1, "a"), (3, 2, "c"), (3, 3, "d")}


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = rows.select(cosine(F.col("a"), F.col("a")).alias("x"), cosine(F.col("a"), F.col("b")).alias("y"), unit(F.col("a")).alias("u")).first()
    assert (got.x, got.y, got.u) == (1.0, 0.0, [0.6, 0.8])
    texts = spark.createDataFrame([("some words",), (None,)], "t string")
    assert all(len(r.e) == 8 for r in texts.select(embed(F.col("t"), hashing_model(8), 8).alias("e")).collect())
    with pytest.raises(Exception, match="components"):
        texts.select(embed(F.col("t"), hashing_model(8), 9)).collect()


def test_query_batch_is_bounded(spark):
    with pytest.raises(ValueError, match="more than"):
        dense.bounded(spark.range(6), 5)


def test_progress_order(spark):
    d = spark.createDataFrame([("a", 0), ("b", 2), ("c", 0), ("d", 1)], "document_id string, indexed_chunk_count int")
    c = spark.createDataFrame([(x,) for x in "bbccdd"], "document_id string")
    s = spark.createDataFrame([("d",)], "document_id string")
    assert {r.document_id: r.stage for r in catalog.progress(d, c, s).collect()} == {"a": "parsing", "b": "complete", "c": "embedding", "d": "indexing"}


def test_known(spark):
    rows = spark.createDataFrame([("crpc",), ("BNS",), ("x",), (None,)], "law string").select(known(F.col("law"), LAWS, "Other").alias("law")).collect()
    assert [r.law for r in rows] == ["CrPC", "BNS", "Other", "Other"]


def test_workers_take_a_bounded_part_of_a_batch():
    """However many bytes a batch of rows holds, about so many are Python's strings at a time; every row is in one part, in order."""
    texts = ["x" * (i % 97) for i in range(500)] + ["y" * 5000, "", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    made = [p.column("text").to_pylist() for p in chunking.parts(batch, 1000)]
    assert [t for p in made for t in p] == texts and all(p for p in made) and len(made) > 20
    assert all(sum(map(len, p)) <= 1000 + 97 for p in made if "y" * 5000 not in p)
    assert list(chunking.parts(batch.slice(0, 0), 1000)) == []
