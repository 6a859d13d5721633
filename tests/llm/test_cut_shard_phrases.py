"""Fill-in-the-middle, sharding and collocations against brute force, the published algorithm and odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import fim, phrases, sharding

DDL = "doc_id long, text string, lang string, n long, form string, shard int, slot long, seen string, size long, k int, score double, row_id long, place long"
TEXTS = [
    (0, "plain ascii, then é and 漢字 and 😀😀 end"), (1, ""), (2, None), (3, "x<S>y"), (4, "ends in a < mark<"), (5, "<"), (6, "S>P>M> stray ends"), (7, "aé" * 3000), (8, "漢" * 5000 + "a" * 5000), (9, "😀"),
    (None, "no id at all"), (None, None), (7, "aé" * 3000), (7, "another text of the same id"), (-5, "negative, and some more"), (10**15, "a far id\n\twith\x0bwhite space"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 9, "f", 7, 7, "s", 1, 2, 0.5, 1, 1) for i, t in TEXTS + [(k, f"text {k} <{k}> é" * (k % 7)) for k in range(100, 300)]], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def plain_cut(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_fill_in_middle(docs, empty):
    given = docs.select("doc_id", "text").collect()
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    want = sorted((str(r.doc_id), *plain_cut(r.doc_id, r.text or "")) for r in given)
    assert got == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in fim.digest(made).collect())
    assert digests == sorted((str(r.doc_id), sha(plain_cut(r.doc_id, r.text or "")[4]), sha(r.text or "")) for r in given)
    assert fim.fill_in_middle(empty).count() == fim.digest(fim.fill_in_middle(empty)).count() == 0


def test_every_cut_is_restored(spark):
    """Texts of stray mark characters, in both orders of output, cut wherever the ids draw."""
    texts = ["<<P><P>"[:k] + "<" * j + ">S>" for k in range(3) for j in range(4)] + ["P>a<S", "M><", "<P", "é<é>"]
    frame = spark.createDataFrame([(i, t) for i in range(60) for t in texts], "doc_id long, text string")
    for first in (0, 100):
        made = fim.fill_in_middle(frame, plain=0, suffix_first=first)
        rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted((r.doc_id, r.back) for r in rows) == sorted((i, t) for i in range(60) for t in texts)
        assert {r.form for r in rows} <= {"plain", "psm" if first == 0 else "spm"}


def test_runs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50):
        text = "".join(rng.choice(list("ab é漢😀"), n))
        data = text.encode()
        for piece in (1, 7, 1 << 22):
            runs = fim.Runs(data, piece)
            assert runs.n == n and [runs.offset(u) for u in range(n + 1)] == [len(text[:u].encode()) for u in range(n + 1)]
            assert len(runs.classes) == len(re.findall("[ab ]+|é+|漢+|😀+", text))


def plain_jump(key: int, n: int) -> int:
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump(spark):
    """The published values, and the plain algorithm for odd keys and counts; a key only ever moves to the shard that is new."""
    keys = [0, 1, 42, 0xDEAD10CC, 256, -1, -(2**63), 2**63 - 1, 10**15, *range(5, 60)]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    counts = (1, 2, 3, 24, 25, 57, 200)
    for r in frame.select("key", *(sharding.shard_of(F.col("key"), n).alias(f"n{n}") for n in counts)).collect():
        assert [r[f"n{n}"] for n in counts] == [plain_jump(r["key"], n) for n in counts]
    assert plain_jump(42, 57) == 43 and plain_jump(0xDEAD10CC, 666) == 361 and plain_jump(256, 1024) == 520
    assert frame.where("key = 42").select(sharding.shard_of(F.col("key"), 57)).first()[0] == 43


def test_shard(spark, docs, empty):
    got = sharding.shard(docs)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows, given = got.collect(), docs.select("doc_id", "text").collect()
    data = lambda t: (t or "").encode()
    want = Counter((r.doc_id, len(data(r.text)) + 8, zlib.crc32(data(r.text)), plain_jump(r.doc_id or 0, 24), plain_jump(r.doc_id or 0, 25)) for r in given)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    assert all(r.grown_shard in (r.shard, 24) and r.law == "key" for r in rows)
    for s in {r.shard for r in rows}:
        of = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in of] == list(range(len(of)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in of]
        assert order == sorted(order)
    assert sharding.shard(empty).count() == 0


def test_shard_of_many_equal_rows(spark):
    """A third of all rows are one: its shard is numbered without a gap by several tasks, and other splits of the table give the same rows."""
    frame = spark.range(0, 30_000, 1, 7).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    first, again = (sorted(map(tuple, sharding.shard(f).collect())) for f in (frame, frame.repartition(3)))
    assert first == again and len(first) == 30_000
    slots = Counter((r[4], r[5]) for r in first)
    sizes = Counter(r[4] for r in first)
    assert set(slots.values()) == {1} and all(max(t for s, t in slots if s == k) == n - 1 for k, n in sizes.items())
    moved = sum(r[6] == 24 for r in first if r[0] != 5) / sum(r[0] != 5 for r in first)
    assert 0.03 < moved < 0.05 and len(sizes) == 24


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), 5, rows_a_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and all(r.shard == plain_jump(r.doc_id or 0, 5) for r in back.collect())


def plain_collocations(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    covered = {}
    for (lang, *w), a in found.items():
        for m in range(2, len(w)):
            for s in range(len(w) - m + 1):
                sub = (lang, *w[s : s + m])
                covered[sub] = max(covered.get(sub, 0), a)
    out = []
    for p, a in found.items():
        if covered.get(p, 0) >= a:
            continue
        cuts = [(1000 * a * n[p[0]] // (f[p[: 1 + k]] * f[(p[0], *p[1 + k :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, f[p[: 1 + k]], f[(p[0], *p[1 + k :])], n[p[0]], score))
    ranked = []
    for lang in {o[0] for o in out}:
        of = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(of, 1)]
    return sorted(ranked)


def sentences(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    words = "the The cat sat ON on mat ünd 漢 new york city a a x\x00y".split(" ")
    return "".join(f"{w}{rng.choice([' ', '  ', chr(9), '. ', ', ', chr(10)], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])}" for w in rng.choice(words, n, p=np.arange(1, len(words) + 1) / sum(range(1, len(words) + 1))))


ROWS = [("en", sentences(1, 4000)), ("en", sentences(2, 300)), (None, sentences(3, 2000)), ("und", sentences(4, 500)), ("fr", None), ("fr", ""), ("fr", "a b"), ("de", "eins zwei drei vier fünf sechs " * 60), ("de", "zwei " * 90), ("de", "eins zwei drei")]


@pytest.mark.parametrize("settings", [{}, {"width": 64, "depth": 1}, {"top": 5, "least": 20}, {"longest": 3}])
def test_collocations(spark, settings):
    """Exact at any width of the sketch: at 64 cells nearly every phrase survives the first pass."""
    least, longest, top = settings.get("least", 50), settings.get("longest", 5), settings.get("top", 2000)
    rows = ROWS + [ROWS[0], ROWS[9]]
    frame = spark.createDataFrame([(lang, t, 1, "x", 2) for lang, t in rows], "lang string, text string, doc_id long, phrase string, a long").repartition(4)
    got = phrases.collocations(frame, **{"least": least} | settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(rows, least, longest, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(frame).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " .,; ")], "lang string, text string")).count() == 0


def test_long_pieces_are_cut_without_loss():
    """Runs of a piece carry the words that phrases need past their end; each phrase is counted once."""
    import pyarrow as pa

    words = [f"w{k * k % 5}" for k in range(200)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [" ".join(words) + ". " + " ".join(words[:30]), "w1 w2"]})
    every = np.full((2, 8), 255, np.uint8)
    for most in (7, 64, 1000):
        names, found, n = [], Counter(), 0
        for chunk in phrases.chunks(iter([batch]), names, 5, most):
            n += int(chunk.own.sum())
            for k, places, counts in phrases.survivors(chunk, names, every, 5):
                for p, c in zip(places, counts, strict=True):
                    found[(names[chunk.langs[p]], *(w.decode() for w in chunk.words[p : p + k]))] += int(c)
        want = Counter(("en", *s[i : i + k]) for s in (words, words[:30]) for k in range(1, 6) for i in range(len(s) - k + 1)) + Counter([("de", "w1"), ("de", "w2"), ("de", "w1", "w2")])
        assert found == want and n == 232


def test_sketch_never_counts_too_low():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 400, 20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ** np.uint64(3)
    sketch = np.zeros((2, 128), np.uint8)
    for some in np.array_split(hashes, 7):
        phrases.add(sketch, some)
    for h, n in zip(*np.unique(hashes, return_counts=True), strict=True):
        assert min(sketch[r, phrases.cells(np.array([h]), r, 128)[0]] for r in range(2)) >= min(n, 255)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r of some 10^27, as exact as whole numbers."""
    cases = [(10**12 + 7, 9 * 10**14 + 1, 3 * 10**12 + 11, 2 * 10**12 + 3), (100, 10**13, 10**13 - 1, 10**13 - 7), (10**11, 10**13, 10**11, 10**11)]
    frame = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = [r.score for r in frame.withColumn("score", phrases.score_of("a", "n", "l", "r")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in cases]
