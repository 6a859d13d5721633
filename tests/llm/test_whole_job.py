"""Rows that bounds and keys must not cost: null, repeated and hot ids, many languages."""

import itertools
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm import language, one_bit, quality, shared, simhash, toxicity
from brightloom.llm.vectors import search


def prose(seed: int, n: int = 60) -> str:
    return " ".join(f"w{seed}x{k * k % 97}" for k in range(n))


def test_near_duplicates_without_usable_ids(spark):
    given = [(None, prose(k)) for k in (1, 1, 2, 3, 4)] + [(7, prose(k)) for k in (5, 6, 6, 4)] + [(8, prose(6)), (9, prose(3)), (10, prose(7))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([("None", prose(1)), ("None", prose(2)), ("9", prose(3)), ("7", prose(4)), ("7", prose(5)), ("7", prose(6)), ("10", prose(7))])
    assert len({simhash.fingerprint(t) for _, t in want}) == 7
    first = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert first.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in first.collect()) == want
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(2, "n_chars"), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))


def many(n: int) -> list[tuple[int, str, str]]:
    """A row for each language, with over 300 n-grams of its own."""
    rng = np.random.default_rng(6)
    return [(k, " ".join(map("".join, rng.choice(list(string.ascii_lowercase), (120, 6)))), f"l{k}") for k in range(n)]


def plain_profile(texts: list[str]) -> list[str]:
    """The 300 most frequent n-grams of one to three letters of lower-case words between blanks, ties by their code points in one number: shorter first."""
    counts = Counter()
    for t in texts:
        words = ["".join(g) for k, g in itertools.groupby(t.lower(), lambda c: c.isalpha()) if k]
        line = f" {' '.join(words)} "
        counts.update(c for c in line if c != " ")
        counts.update(line[i : i + 2] for i in range(len(line) - 1))
        counts.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:300]


def spelt(profile) -> list[str]:
    return ["".join(chr(int(k) >> 21 * i & 0x1FFFFF) for i in (2, 1, 0) if int(k) >> 21 * i) for k in profile]


def plain_prediction(profiles: dict[str, list[str]], t: str):
    own, away = plain_profile([t]), []
    for name, of in profiles.items():
        at = {g: i for i, g in enumerate(of)}
        away.append((sum(abs(at[g] - i) if g in at else 300 for i, g in enumerate(own)), name))
    (first, name), (second, _) = sorted(away)[:2]
    return name, (second - first) / second


def test_over_a_thousand_languages(spark):
    given = [r for r in many(1600) if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    known = language.held(language.fit(spark.createDataFrame(given, "doc_id long, text string, lang string")))
    assert len(given) > 1000 and set(known) == {r[2] for r in given}
    plain = {lang: plain_profile([t]) for _, t, lang in given}
    assert all(spelt(known[lang]) == plain[lang] for lang in known)
    held = language.Profiles(known)
    assert all(held.predict(t) == plain_prediction(plain, t) and held.predict(t)[0] == lang for _, t, lang in given[::40])


def test_more_languages_than_a_worker_holds(spark):
    """Joined as tables the profiles give what they give when they are held, for odd texts, ties and texts of no language, too."""
    given = [r for r in many(60) if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    given += [(1000 + k, given[k][1], f"twin{k}") for k in range(12) if zlib.crc32(str(1000 + k).encode()) % 3 != 1]
    odd = [(5000, None, None), (5001, "", None), (5002, "12 34 !", None), (5003, "漢字漢字", None), (5004, "a", None), (None, "ab ab", None), (5000, given[0][1], None), (5000, given[0][1], None)]
    docs = spark.createDataFrame(given + odd, "doc_id long, text string, lang string").withColumn("doc", F.lit(3)).withColumn("far", F.lit(4)).repartition(3)
    known = language.fit(docs)
    rows = docs.select("doc_id", "text")
    few, many_ = (sorted(map(str, language.measured(rows, known, most).collect())) for most in (10_000, 5))
    assert few == many_ and len(few) == len(given) + len(odd)
    one = language.fit(docs.where("lang = 'l2'"))
    assert sorted(map(str, language.measured(rows, one, 0).collect())) == sorted(map(str, language.measured(rows, one).collect()))
    kept = language.keep_known(docs, known)
    assert kept.columns == docs.columns and {(r.doc, r.far) for r in kept.collect()} == {(3, 4)}
    assert language.measured(rows, known.where("false")).where("lang_pred <> 'und' or score <> 0 or far <> 1").count() == 0


def test_over_ten_thousand_languages(spark):
    given = [(k, f"{a}{b} {b}{c} {c}{a}{b}", f"l{k}") for k, (a, b, c) in enumerate(itertools.islice(itertools.product(string.ascii_lowercase + "àéîõüñç", repeat=3), 16_000)) if zlib.crc32(str(k).encode()) % 3 != 1]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string").repartition(4)
    known = language.fit(docs)
    assert known.count() == len(given) > language.LANGUAGES and language.held(known) is None
    asked = [(-1, given[5][1], None), (-2, None, None), (-3, "!", None), (-4, given[-1][1], None)]
    plain = {lang: plain_profile([t]) for _, t, lang in given}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.measured(spark.createDataFrame(asked, "doc_id long, text string, lang string").select("doc_id", "text"), known).collect()}
    assert got == {-1: plain_prediction(plain, asked[0][1]), -2: ("und", 0.0), -3: ("und", 0.0), -4: plain_prediction(plain, asked[3][1])}


def test_profiles_of_a_repeated_id(spark):
    """One id 3,000 times is one row of the sample, the same on every run, and takes no other id's place."""
    ids = [k for k in range(2, 260) if zlib.crc32(str(k).encode()) % 3 != 1]
    texts = {k: f"{prose(k)} {'abcdefghij'[k % 10] * 3}" for k in ids}
    hot = ids[0]
    given = [(hot, f"hot zz{k % 40}q", "en") for k in range(3000)] + [(k, texts[k], "en") for k in ids[1:]]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
    known = [language.held(language.fit(docs.repartition(n), 2000))["en"].tolist() for n in (1, 5)]
    assert known[0] == known[1]
    assert any(spelt(known[0]) == plain_profile([t, *(texts[k] for k in ids[1:])]) for t in {f"hot zz{k}q" for k in range(40)})


def test_sample_of_a_repeated_id(spark):
    given = [(3, prose(k)) for k in range(50)] + [(k, prose(100 + k)) for k in range(10, 40)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 1)] + [(k, k % 2, k % 2) for k in range(10, 40)], "doc_id long, quality int, toxic int")
    sample = shared.labelled_sample(docs, labels, "toxic", F.lit(True), 20).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == 20
    whole = [sorted(map(str, shared.labelled_sample(docs.repartition(n), labels, "toxic", F.lit(True), 100).collect())) for n in (1, 5)]
    assert len(whole[0]) == 31 and whole[0] == whole[1]
    texts = {t for i, t in given if i == 3}
    assert {r.text for r in shared.labelled_sample(docs, labels, "toxic", F.lit(True), 100).where("doc_id = 3").collect()} < texts
    one, other = (toxicity.fit(docs.repartition(n), labels) for n in (1, 5))
    assert one.inputs.tolist() == other.inputs.tolist() and one.bias == other.bias and (one.v == other.v).all()
    x = np.array([quality.statistics(prose(1))])
    assert quality.fit(docs.repartition(1), labels).score(x) == quality.fit(docs.repartition(5), labels).score(x)


def test_blocks_of_a_repeated_id(spark):
    """Every block holds about as many rows as it may, and the results are those of brute force; each row of a query's id is a query of its own."""
    rows = [(0 if k % 2 else k, [float(k)]) for k in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = shared.materialize(frame.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", F.lit(1).alias("dim"), F.lit(0).alias("list"), "embedding"), "index")
    queries = index.where("vec_id % 50 = 0 and embedding[0] % 2 = 0").select("row_id", "vec_id", "dim", F.array(F.lit(0)).alias("lists"), "embedding")

    def bound(q, r):
        assert len(r) <= 80 and len(q) <= 80
        s = q @ np.array(r["embedding"].tolist()).T
        yield s - 1, s + 1

    def exact(v):
        def best(query, places, ups):
            s = v[places] @ query
            order = np.lexsort((places, -s))[:300]
            return places[order], s[order]

        return best

    got = search(index, queries, 300, ["embedding"], bound, exact, "double", block=40, query_block=40).collect()
    want = []
    for q, (x,) in (r for r in rows if r[0] % 50 == 0 and r[1][0] % 2 == 0):
        ranked = sorted((-x * y, i) for i, (y,) in rows if i != q)[:300]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def recall(spark, x: np.ndarray, every: int, k: int, **settings) -> np.ndarray:
    """For each query, the share of its k nearest that ``neighbours`` finds."""
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(8)
    got = one_bit.neighbours(frame, k=k, every=every, **settings).toPandas()
    out = []
    for q in range(0, len(x), every):
        scores = x @ x[q]
        scores[q] = -np.inf
        least = np.partition(scores, -k)[-k]
        found = got[got.query_id == q].sort_values("rank")
        assert len(found) == k and np.allclose(found["score"], scores[found.vec_id]) and (np.diff(found["score"]) <= 1e-9).all()
        out.append((scores[found.vec_id] >= least - 1e-9).mean())
    return np.array(out)


def test_long_vectors_in_another_list(spark):
    """Two clusters, and 20 vectors a hundred times as long in the first: they are the nearest of queries in the second, too, and the lists don't hide them."""
    rng = np.random.default_rng(4)
    a, b = np.linalg.qr(rng.normal(size=(16, 16)))[0][:2]
    x = np.concatenate([a + 0.1 * rng.normal(size=(35_000, 16)), 0.6 * a + 0.8 * b + 0.1 * rng.normal(size=(35_000, 16))])
    x[rng.choice(35_000, 20, replace=False)] *= 100
    found = recall(spark, x[rng.permutation(len(x))], 1000, 20)
    assert found.min() >= 0.9 and found.mean() > 0.98


def test_recall_of_clusters(spark):
    """Forty clusters of different sizes and lengths, lists of about 500 rows: every list that may matter is looked into."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    of = rng.choice(40, 12_000, p=np.arange(1, 41) / 820)
    x = (centres[of] + 0.3 * rng.normal(size=(12_000, 32))) * np.exp(rng.normal(size=(12_000, 1)))
    assert recall(spark, x, 300, 20, list_rows=500).mean() > 0.95


def test_bounds_of_lists():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)) * np.exp(2 * rng.normal(size=(500, 1)))
    lists = one_bit.Lists(x[:200], 6)
    unit, lengths = one_bit.directions(x)
    of, away = lists.nearest(unit)
    for i in range(6):
        lists.radius[i], lists.longest[i] = away[of == i].max(initial=0), lengths[of == i].max(initial=0)
    ups, scores = lists.bounds(unit[:50]), unit[:50] @ x.T
    assert all((scores[:, of == i] <= ups[:, [i]]).all() for i in range(6))


def test_near_duplicates_send_no_growing_table_to_the_driver(spark, monkeypatch):
    """A fingerprint makes 56 rows, which Spark's estimate of a small table leaves out: none of these joins may be a broadcast."""
    plans = []
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "materialize", lambda df, tag: (plans.append(plan_of(df)), shared.materialize(df, tag))[1])
    docs = spark.createDataFrame([(k, prose(k % 30)) for k in range(60)], "doc_id long, text string")
    plans.append(plan_of(simhash.near_duplicates(docs)))
    plans.append(plan_of(simhash.first_of_groups(docs)))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)
