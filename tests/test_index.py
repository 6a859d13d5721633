"""The segmented index: pruned BM25, updates and deletions, section keys read by range, and batches of real size."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightloom.operators import batches, held, index, lexical, search

DDL = "chunk_id string, document_id string, content string, chunk_index int, section_ref string, subsection_ref string, law string, court string, year int"
WORDS = "bail court murder the of and section act law judge appeal order".split()


def rows(documents: range, seed: int = 1, chunks: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choices(WORDS, weights=range(1, 13), k=rng.randrange(0, 40)))
    return [(f"c{d}-{i}-{seed}", f"d{d}", line(), i, str(rng.randrange(1, 400)) if i % 3 == 0 else None, f"{rng.randrange(1, 400)}({i})" if i % 4 == 0 else None, rng.choice(["BNS", "IPC"]), "Supreme Court", 2000 + d % 20) for d in documents for i in range(chunks)]


def plain_bm25(given: list[tuple], query: str, k: int | None = 50) -> list[tuple[str, float]]:
    texts = {r[0]: r[2].split() for r in given}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    scores = {}
    for c, t in texts.items():
        for w in sorted(set(query.split())):
            if tf := t.count(w):
                scores[c] = scores.get(c, 0.0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def found(made, spark, asked: dict[int, str], k: int = 50) -> dict[int, list[tuple[str, float]]]:
    out = {q: [] for q in asked}
    for r in lexical.bm25(made, spark.createDataFrame(list(asked.items()), "query_id int, query string"), k).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.chunk_id, r.score))
    return out


ASKED = {1: "murder bail", 2: "the of order", 3: "zzz", 4: "judge", 5: ""}


def same(got: dict, given: list[tuple], k: int = 50) -> None:
    for q, query in ASKED.items():
        want = plain_bm25(given, query, k)
        assert [c for c, _ in got[q]] == [c for c, _ in want] and all(math.isclose(a, b) for (_, a), (_, b) in zip(got[q], want, strict=True))


def test_pruned_blocks(spark, tmp_path):
    """The k best are those of a full scan, though most blocks are not read."""
    given = rows(range(300)) + [(f"x{i}", "dx", "rare murder " + "bail " * (i % 5), i, None, None, "BNS", None, 2000) for i in range(40)]
    frame = spark.createDataFrame(given, DDL).repartition(5)
    made = lexical.write_index(frame, str(tmp_path / "i"))
    for k in (1, 10):
        same(found(made, spark, ASKED, k), given, k)
    asked = spark.createDataFrame([(1, "rare murder the"), (2, "rare bail of and")], "query_id int, query string")
    for r in lexical.bm25_blocks(made, asked, 10).collect():
        assert 0 < r.read < r.blocks / 4
    some = {r.chunk_id for r in lexical.bm25(made, asked, 10, keep=lambda s: s.where(F.substring("chunk_id", 1, 1) == "c")).collect()}
    assert len(some) > 10 and all(c.startswith("c") for c in some)
    plan = lexical.bm25_scores(made, asked)._jdf.queryExecution().toString()
    assert "In(lexeme, [" in plan and made.postings.agg(F.max("n")).first()[0] <= index.TILE


def test_updates_equal_a_rebuild(spark, tmp_path):
    """Documents replaced, deleted and added in several commits, then merged: at every step as if indexed anew."""
    path, frame = str(tmp_path / "i"), lambda given: spark.createDataFrame(given, DDL)
    held_now = {r[0]: r for r in rows(range(40))}
    lexical.write_index(frame(list(held_now.values())), path, carry=("law", "court", "year"))
    for step, (put, gone) in enumerate([(range(5, 9), ["d1", "d30"]), (range(38, 44), []), (range(0), ["d5", "d39", "nothing"]), (range(5, 6), ["d5"])], 2):
        new = rows(put, seed=step)
        made = index.update(spark, path, frame(new), spark.createDataFrame([(d,) for d in gone], "document_id string"), batch=step)
        touched = {r[1] for r in new} | set(gone)
        held_now = {k: r for k, r in held_now.items() if r[1] not in touched} | {r[0]: r for r in new}
        given = list(held_now.values())
        again = index.update(spark, path, frame(rows(range(90, 95))), batch=step)  # a repeated micro-batch changes nothing
        for x in (made, again, index.read_index(spark, path)):
            assert (x.n, x.words) == (len(given), sum(len(r[2].split()) for r in given))
        same(found(made, spark, ASKED), given)
        keys = made.live(made.keys).select("ref", "chunk_id").collect()
        assert Counter(map(tuple, keys)) == Counter((k, r[0]) for r in given for k in {x for x in (r[4], r[5]) if x})
    assert made.dead.count() > 0
    merged = index.merge(spark, path)
    assert merged.dead is None and merged.chunks.select("segment").distinct().count() == 1
    same(found(merged, spark, ASKED), given)
    fresh = lexical.write_index(frame(given), str(tmp_path / "fresh"), carry=("law", "court", "year"))
    flat = lambda x: sorted((r.lexeme, r.chunk_id, r.tf, r.dl, tuple(r.positions)) for r in x.entries(F.lit(True)).collect())
    assert flat(merged) == flat(fresh) and merged.chunks.columns == fresh.chunks.columns


def test_updates_merge_themselves(spark, tmp_path):
    path = str(tmp_path / "i")
    for step in range(1, 6):
        made = index.update(spark, path, spark.createDataFrame(rows(range(step, step + 2), seed=step), DDL), batch=step, merge_at=3)
    given = [r for step in range(1, 6) for r in rows(range(step, step + 2), seed=step) if r[1] == f"d{step}" or step == 5]
    same(found(made, spark, ASKED), given)
    assert made.chunks.select("segment").distinct().count() < 3


def test_empty_index(spark, tmp_path):
    made = lexical.write_index(spark.createDataFrame([], DDL), str(tmp_path / "i"))
    assert found(made, spark, ASKED) == {q: [] for q in ASKED}
    with pytest.raises(ValueError, match="no index"):
        index.read_index(spark, str(tmp_path / "none"))


def test_section_keys_are_read_by_range(spark, tmp_path):
    made = lexical.write_index(spark.createDataFrame(rows(range(30)), DDL), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "31(2)"), (2, "7")], "query_id int, section string")
    hits = lexical.exact_sections(made.keys, asked, 1000)
    want = {(q, r[0]) for q, n in ((1, "31"), (2, "7")) for r in rows(range(30)) if any((x or "").startswith(n) for x in r[4:6])}
    assert {(r.query_id, r.chunk_id) for r in hits.collect()} == want and hits.count() == len(want) > 10
    plan = hits._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ref,31)" in plan and "LessThan(ref,32)" in plan


def test_batches_of_real_size(spark, tmp_path):
    """1,200 questions of four sections each, and 4,096 of ten words: only the number of questions is bounded."""
    given = rows(range(20))
    corpus = spark.createDataFrame(given, DDL).withColumn("content_length", F.length("content")).withColumn("chunk_type", F.lit("section")).withColumn("page_number", F.lit(1))
    made = lexical.write_index(corpus, str(tmp_path / "i"), carry=("law", "court", "year"))
    asked = [(q, " ".join(f"section {1 + (q * 7 + j * 90) % 399}" for j in range(4))) for q in range(1200)]
    got = search.retrieve(corpus, spark.createDataFrame(asked, "query_id int, query string"), index=made, k=60)
    best = {(r.query_id, r.chunk_id) for r in got.where("final_score = 1.0").collect()}
    want = set()
    for q, _ in asked:
        for n in {str(1 + (q * 7 + j * 90) % 399) for j in range(4)}:
            hit = sorted((r[3], r[0]) for r in given if any((x or "").startswith(n) for x in r[4:6]))[:10]
            want |= {(q, c) for _, c in hit}
    assert best == want
    many = spark.createDataFrame([(q, " ".join(WORDS[(q + j) % 12] for j in range(9)) + f" w{q}") for q in range(held.QUERIES)], "query_id int, query string")
    counts = lexical.bm25(made, many, 3).groupBy("query_id").count().collect()
    assert len(counts) == held.QUERIES and {r["count"] for r in counts} == {3}
    with pytest.raises(ValueError, match="more than 4096"):
        search.retrieve(corpus, many.unionByName(many), index=made)


def test_postings_name_chunks_by_their_place(spark, tmp_path):
    """Entries carry no ids, words over several batches and an empty place stay right, and only section keys are shuffled to write them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        given = rows(range(60), seed=9)
        made = lexical.write_index(spark.createDataFrame(given, DDL).repartition(3), str(tmp_path / "i"))
        assert "chunk_id" not in made.postings.schema.simpleString()
        want = sorted((w, r[0], t.count(w), len(t), tuple(i for i, x in enumerate(t, 1) if x == w)) for r in given for t in [r[2].split()] for w in set(t))
        assert sorted((r.lexeme, r.chunk_id, r.tf, r.dl, tuple(r.positions)) for r in made.entries(F.lit(True)).collect()) == want
        blocks = made.postings.select("lexeme", "tile", F.size("entries").alias("size"), "n").collect()
        assert all(r.size == r.n <= index.TILE for r in blocks) and len({(r.lexeme, r.tile) for r in blocks}) == len(blocks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_posting_blocks_are_sorted_runs(spark, tmp_path, monkeypatch):
    """No sort that spills is in the plan; a worker gives whole sorted runs that end with a tile, whatever the batches, and a scan for many words compares lists so short that it skips blocks."""
    monkeypatch.setattr(index, "RUN", 300)
    words = [[f"w{(i * 7 + j) % 40}" for j in range(i % 9)] + ["é", ""][: i % 3] for i in range(700)]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array([len(w) for w in words[a:b]], pa.int32()), pa.array(words[a:b])], names=["row", "dl", "words"])
    runs = [[(r["lexeme"], r["tile"]) for r in x.to_pylist()] for x in index._blocks(batch(a, min(a + 50, 700)) for a in range(0, 700, 50))]
    assert len(runs) > 3 and all(r == sorted(r, key=lambda x: (x[0].encode(), x[1])) for r in runs)
    want = {(w, i // index.TILE) for i, x in enumerate(words) for w in x if w}
    assert {x for r in runs for x in r} == want and sum(map(len, runs)) == len(want)
    made = lexical.write_index(spark.createDataFrame(rows(range(5)), DDL), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, " ".join(f"x{i:02d}" for i in range(25)))], "query_id int, query string")
    plan = lexical.bm25_scores(made, asked)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[Or\((Or\()?In\(lexeme, \[x00", plan) and "positions" not in plan.split("PushedFilters")[1]


def test_dead_places_keep_no_words(spark, tmp_path):
    """What an update drops is a bit of its tile; frequencies and totals are those of what holds."""
    path, given = str(tmp_path / "i"), rows(range(40))
    lexical.write_index(spark.createDataFrame(given, DDL), path)
    docs = sorted({r[1] for r in given})
    for i in (0, 1, 2):
        made = index.update(spark, path, spark.createDataFrame([], DDL), spark.createDataFrame([(docs[i],)], "document_id string"))
    held_now = [r for r in given if r[1] not in docs[:3]]
    assert set(made.dead.columns) == {"segment", "tile", "slots", "n", "words"} and made.n == len(held_now) and made.words == sum(len(r[2].split()) for r in held_now)
    terms = spark.createDataFrame([(w,) for w in {w for r in given for w in r[2].split()}], "lexeme string")
    want = Counter(w for r in held_now for w in set(r[2].split()))
    assert {r.lexeme: r.df for r in index.document_frequencies(made, terms, F.lit(True)).collect()} == dict(want)
    same(found(made, spark, ASKED), held_now)


def test_fields_are_compared_by_place(spark, tmp_path):
    """Fields that number chunks alike give what a join by ids gives, and name only what the search leaves."""
    given = [(f"c{i:03d}", " ".join(f"w{(i * j) % 13}" for j in range(2, 14)), f"w{i % 13} w{i % 5}") for i in range(400)]
    frame = spark.createDataFrame(given, "chunk_id string, content string, head string").repartition(3)
    weights, asked = {"content": 1.0, "head": 2.0}, spark.createDataFrame([(1, "w1 w4"), (2, "w12"), (3, "none")], "query_id int, query string")
    alike = lexical.write_fields(frame, {"content": F.col("content"), "head": F.col("head")}, str(tmp_path / "f"))
    apart = {f: lexical.index(frame.select("chunk_id", F.col(f).alias("content"))) for f in weights}
    got, want = (sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in lexical.multi_field(x, asked, weights, 20).collect()) for x in (alike, apart))
    assert got == want and len(got) == 40
    assert len({x.numbering for x in alike.values()}) == 1 and len({x.numbering for x in apart.values()}) == 2


def filtered(spark, made, asked: list[tuple], k: int) -> dict[int, list[tuple[str, float]]]:
    """What each query (query_id, query, law, year) finds among the chunks of its law since its year."""
    frame = held.batch(spark.createDataFrame(asked, "query_id int, query string, law_filter string, since int"))
    fits = lambda of: (of("law_filter").isNull() | (F.col("law") == of("law_filter"))) & (F.col("year") >= of("since"))
    decided = batches.allowed(made.live(made.chunks), ["law", "year"], frame.drop("query"), fits)
    out = {q: [] for q, *_ in asked}
    for r in lexical.bm25_allowed(made, frame.select("query_id", "query"), k, decided).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.chunk_id, r.score))
    return out


@pytest.mark.parametrize("group", [1, 64])
def test_a_batch_with_filters(spark, tmp_path, monkeypatch, group):
    """Each query's best among what its filter allows, by the model, in groups of any size, with ties at the end of a list and after an update."""
    monkeypatch.setattr(lexical, "GROUP", group)
    given = rows(range(120)) + [(f"y{i:03d}", "dy", "murder bail", i, None, None, "BNS", None, 2019) for i in range(30)]
    lexical.write_index(spark.createDataFrame(given, DDL).repartition(3), str(tmp_path / "i"), carry=("law", "court", "year"))
    changed = rows(range(40, 60), seed=5)
    made = index.update(spark, str(tmp_path / "i"), spark.createDataFrame(changed, DDL), deleted=spark.createDataFrame([("d7",), ("d8",)], "document_id string"))
    left = [r for r in given if r[1] not in {"d7", "d8", *(f"d{i}" for i in range(40, 60))}] + changed
    asked = [(i, " ".join(WORDS[(i + j) % 12] for j in range(1 + i % 4)), [None, "BNS", "IPC", "BSA"][i % 4], 2000 + i % 21) for i in range(60)] + [(90, "murder bail", "BNS", 2019), (91, "", None, 0), (92, "zzz", None, 0)]
    got = filtered(spark, made, asked, 7)
    for q, query, law, since in asked:
        may = {r[0] for r in left if (law is None or r[6] == law) and r[8] >= since}
        want = [x for x in plain_bm25(left, query, None) if x[0] in may][:7]
        assert [c for c, _ in got[q]] == [c for c, _ in want] and all(math.isclose(a, b) for (_, a), (_, b) in zip(got[q], want, strict=True))
    assert [c for c, _ in got[90]][0] == "y000" and not got[91] and not got[92] and not got[3]


def test_a_search_looks_up_ids_of_the_best_only(spark, tmp_path, monkeypatch):
    """Filters act on scores as they are made: chunks that merely hold a word of a query are never joined to their ids."""
    given = rows(range(200))
    corpus = spark.createDataFrame(given, DDL).withColumns({"content_length": F.length("content"), "chunk_type": F.lit("section"), "page_number": F.lit(1)})
    made, looked, named = lexical.write_index(corpus, str(tmp_path / "i"), carry=("law", "court", "year")), [], index.Index.named
    monkeypatch.setattr(index.Index, "named", lambda self, scored: looked.append(scored.count()) or named(self, scored))
    asked = spark.createDataFrame([(q, f"{'BNS' if q % 2 else 'IPC'} {' '.join(WORDS[-1 - q % 6 :])}") for q in range(12)], "query_id int, query string")
    assert search.retrieve(corpus, asked, index=made, k=60).count() > 12 * 40
    assert 0 < sum(looked) < 12 * 3 * search.LEXICAL


def test_too_many_combinations_are_filtered_row_by_row(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame(rows(range(40)), DDL).withColumns({"content_length": F.length("content"), "chunk_type": F.lit("section"), "page_number": F.lit(1)})
    made = lexical.write_index(corpus, str(tmp_path / "i"), carry=("law", "court", "year"))
    asked = spark.createDataFrame([(1, "BNS murder bail from 2004 to 2012"), (2, "judge the"), (3, "IPC order")], "query_id int, query string")
    got = lambda: sorted((r.query_id, r.final_rank, r.chunk_id, r.final_score) for r in search.retrieve(corpus, asked, index=made, k=30).collect())
    some = got()
    monkeypatch.setattr(batches, "DECISIONS", 5)
    assert got() == some and len(some) > 60


def test_many_words_are_one_set(spark):
    """Some forty lists in one condition are more than the JVM compiles, and each block took 35 microseconds."""
    few, many = (lexical._one_of("lexeme", [f"w{i:04d}" for i in range(n)])._jc.toString() for n in (30, 400))
    assert few.count("in(lexeme") == 3 and many.count("in(lexeme") == 1
