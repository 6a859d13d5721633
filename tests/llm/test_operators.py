"""Each operator on a small table of odd rows, against brute force."""

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from brightloom.llm import components, language, licenses, mixing, one_bit, packing, quality, simhash, sstable, token_ids, token_shards, toxicity, va_file
from brightloom.llm.queries import tokenizer
from brightloom.llm.vectors import search

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, fp long, size long, row_id long, predicted int, ids string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards boil one enormous kettle of soup".split()


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


def rows() -> list[tuple]:
    base = text(1, 120)
    texts = [
        (0, base), (1, base), (2, base.replace(" soup", " stew", 1)), (3, text(2, 50)), (4, ""), (5, None), (6, "  \t\n "), (7, "one"), (8, "One two"),
        (9, text(3, 60_000)), (10, "Éa ñandú über! 12 <|endoftext|> x\x1cy"), (11, base), (11, base), (None, text(4, 40)), (None, None), (12, "a b　c  d\n\n e"),
        (13, "Released under the MIT License. Apache License, Version 2.0! CC BY-NC 4.0"), (14, "tie " * 30), (15, text(5, 9)), (-3, text(6, 2500)),
    ]
    return [(i, t, ["en", "fr", None][k % 3], ["b", "a", None, "hot", "hot"][k % 5], len(t or ""), 9.0, 7, 5, 3, 1, 2, "x") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(16)] + [(3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_fingerprint(t: str | None) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items: list, linked) -> list:
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    given = [(r[0], r[1]) for r in rows()]
    fps = [plain_fingerprint(t) for _, t in given]
    group = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {g: min((i for (i, _), h in zip(given, group, strict=True) if h == g and i is not None), default=None) for g in group}
    want = sorted(((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(given, fps, group, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_pieces(monkeypatch):
    t = text(8, 3000)
    whole = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(t) == whole == plain_fingerprint(t)


@pytest.mark.parametrize("share", [3, 4096])
def test_simhash_links(spark, share):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    fps = {int(s) ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False))) for s in seeds for _ in range(25)} | {0, -1, 7, -8}
    fps = sorted(fps)
    found = components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), share)).collect()
    got = {r.node: r.root for r in found}
    group = plain_components(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    least = {}
    for f, g in zip(fps, group, strict=True):
        least[g] = min(least.get(g, f), f)
    assert {f: got.get(f, f) for f in fps} == {f: least[g] for f, g in zip(fps, group, strict=True)}


def test_simhash_crowded_cells(spark):
    """Fingerprints that share halves fill cells by the hundred; every link is found, whatever the cells hold."""
    rng = np.random.default_rng(1)
    halves = [rng.integers(0, 1 << 32, n, dtype=np.uint64) for n in (120, 60)]
    fps = (halves[0][:, None] << np.uint64(32) | halves[1][None, :]).ravel()
    moved = fps[::3].copy()
    for _ in range(3):
        moved ^= np.uint64(1) << rng.integers(0, 64, len(moved), dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, moved]))
    got = simhash.links(spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})), 100).distinct().toPandas()
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    ids = fps.view(np.int64)
    assert len(a) > 1000 and sorted(zip(got.a, got.b, strict=True)) == sorted(zip(np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), strict=True))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(40)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(100, 140), 200], 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, empty):
    """Every column of every piece against ids made of whole texts, and pieces that fill sequences without gaps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    coded = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, *_ in rows()]
    want = sorted(((i, at, len(x := ids[at : at + 2048]), zlib.crc32(x.tobytes()), len(ids)) for i, ids in coded for at in range(0, len(ids), 2048)), key=repr)
    got = packing.packed_digest(docs, tokenizer("word_bpe_49k.json"), 1).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == want
    for size, given in ((2048, got), (7, packing.packed(docs, tokenizer("word_bpe_49k.json"), 1, size=7).collect())):
        held = {}
        for r in given:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(held) == list(range(len(held)))
        for parts in held.values():
            ends = np.cumsum([0, *(n for _, n in sorted(parts))])
            assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= size
    assert sorted((str(r.doc_id), r.start, r.ids) for r in given) == sorted((str(i), at, ids[at : at + 7].tolist()) for i, ids in coded for at in range(0, len(ids), 7))
    assert packing.packed_digest(empty, tokenizer("word_bpe_49k.json"), 1).count() == packing.packed(empty, tokenizer("word_bpe_49k.json"), 1).count() == 0


@pytest.mark.parametrize("bucket", [3, 100_000])
def test_pack_ranks(spark, monkeypatch, bucket):
    """A length that a third of all pieces have is dealt to buckets; each piece has a place of its own."""
    monkeypatch.setattr(packing, "BUCKET", bucket)
    given = [(k, 0, 5 if k % 3 else 1 + k % 16) for k in range(200)]
    frame = packing.materialize(spark.createDataFrame(given, "row_id long, start long, length long").repartition(3), "pieces")
    found = {r.row_id: (r.sequence_id, r.offset) for r in packing.pack(frame, 16).collect()}
    used = sorted((*found[k], n) for k, _, n in given)
    assert len(used) == len({x[:2] for x in used}) == 200
    for (s, o, n), (s2, o2, _) in zip(used, used[1:]):
        assert (s2, o2) == ((s, o + n) if s2 == s else (s + 1, 0)) and o + n <= 16


def test_patterns():
    """The longest first, each to the pack with the most room, as item by item."""
    rng = np.random.default_rng(5)
    for size, counts in ((16, {16: 3, 9: 4, 8: 2, 7: 5, 1: 40}), (64, {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 65), 30, replace=False), rng.integers(1, 50, 30), strict=True)}), (8, {}), (8, {5: 1}), (16, {3: 1000, 16: 2}), (16, {1: 35})):
        placed, n = packing.patterns(counts, size)
        seen, packs = {}, {}
        for length, lo, hi, base, offset in placed:
            for k in range(hi - lo):
                seen[(length, lo + k)] = seen.get((length, lo + k), 0) + 1
                packs.setdefault(base + k, []).append((offset, length))
        assert seen == {(k, r): 1 for k, c in counts.items() for r in range(c)} and sorted(packs) == list(range(n))
        plain = []
        for length in (k for k in sorted(counts, reverse=True) for _ in range(counts[k])):
            least = min((p for p in plain if sum(p) + length <= size and length < size), key=sum, default=None)
            if least is None or sum(min(plain, key=sum)) + length > size:
                plain.append([length])
            else:
                least.append(length)
        assert sorted(sum(p) for p in plain) == sorted(sum(x for _, x in p) for p in packs.values())
        for parts in packs.values():
            ends = np.cumsum([0, *(x for _, x in sorted(parts))])
            assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= size


def test_token_shards(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    coded = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows()]
    shards = token_shards.write_shards(docs, str(tmp_path / "s"), tokenizer("byte_bpe_50k.json"), 2, shard_bytes=20_000)
    assert shards.count() > 1
    read = token_shards.read_shards(shards).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((i for i, _ in coded), key=lambda i: (i is not None, i))
    assert sorted((str(r.doc_id), r.ids) for r in read) == sorted((str(i), ids) for i, ids in coded)
    starts = np.cumsum([0, *(len(r.ids) for r in read)])[:-1]
    assert [r.start for r in read] == starts.tolist()
    digest = {(r.start, r.n_tokens, r.ids_crc32) for r in token_shards.digest_shards(shards).collect()}
    assert digest == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read}
    paths = [r.path for r in shards.collect()]
    for i in (None, 11, 9, 77):
        found = [x.tolist() for p in paths for x in token_shards.lookup(p, i)]
        assert sorted(found) == sorted(ids for j, ids in coded if j == i)
    assert token_shards.token_ids(spark, empty, tokenizer("byte_bpe_50k.json"), 2).count() == 0
    again = token_shards.write_shards(docs.repartition(5), str(tmp_path / "again"), tokenizer("byte_bpe_50k.json"), 2)
    assert [(r.doc_id, r.ids) for r in token_shards.read_shards(again).orderBy("start").collect()] == [(r.doc_id, r.ids) for r in read]  # equal and null ids, too, have one order


@pytest.mark.parametrize("file, blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_librarys(file, blanks, monkeypatch):
    """Special tokens' strings, texts without a blank, and a cache that is full after every text; ``plain`` makes the strings ordinary text."""
    from tokenizers import Tokenizer

    library, plain = Tokenizer.from_file(tokenizer(file)), Tokenizer.from_file(tokenizer(file))
    plain.encode_special_tokens = True
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>", "<|end of text|>", "漢字" * 5000, "无空格的长文，" * 300, "word " * 50, "x" * 3000, "x" * 3000 + ".", " lead. and  trail. ", "don't we'll O'Neil's"]
    for limit in (200 << 20, 1):
        monkeypatch.setattr(token_ids, "CACHE_BYTES", limit)
        for of, some in ((library, token_ids.Encoder(tokenizer(file), blanks, 2)), (plain, token_ids.Encoder(tokenizer(file), blanks, 2, plain=True))):
            for t in texts * 2:
                assert np.frombuffer(some.encode(t), some.dtype).tolist() == [*of.encode(t, add_special_tokens=False).ids, 2]
            assert all(len(w) <= token_ids.LONG_WORD for w in some.cache) and some.held == sum(token_ids.ENTRY_BYTES + 4 * len(w) for w in some.cache)
    assert library.encode("hello <|endoftext|> world", add_special_tokens=False).ids != plain.encode("hello <|endoftext|> world", add_special_tokens=False).ids


@pytest.mark.parametrize("file, blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_a_batch_are_the_librarys(file, blanks, monkeypatch):
    """Texts are encoded in turns, whatever white space they hold; a turn's new words are learned at once, not text by text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(file))
    bits = [" ", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "a", "The,", "é"]
    texts = [None, "", *(f"{x}{y}{z}" for x in bits for y in bits for z in bits), *(t for _, t, *_ in rows()), "x" * 3000, " J\u030c", "\x1f<|a", None]
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    calls, learn = [], token_ids.Encoder._learn
    monkeypatch.setattr(token_ids.Encoder, "_learn", lambda self, words: calls.append(len(words)) or learn(self, words))
    for turn, long, cache, at_once in ((4 << 20, 128 << 20, 200 << 20, 4096), (100, 128 << 20, 1, 3), (1000, 900, 200 << 20, 4096)):
        for name, value in (("TURN_BYTES", turn), ("LONG_TURN", long), ("CACHE_BYTES", cache), ("LEARNT", at_once)):
            monkeypatch.setattr(token_ids, name, value)
        some = token_ids.Encoder(tokenizer(file), blanks, 2)
        calls.clear()
        for kind in (pa.string(), pa.large_string()):
            assert [np.frombuffer(x, some.dtype).tolist() for x in some.encode_all(pa.array([*texts, *texts[:9]], kind).slice(0, len(texts)))] == want
        assert len(calls) == 2 or turn < 4 << 20  # the second time for the long word, which is not kept
        assert all(len(w) <= token_ids.LONG_WORD for w in some.cache) and list(some.encode_all(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("limit", [1, 8 << 20])
def test_packing_gives_pieces_back_by_bytes(docs, monkeypatch, limit):
    """A worker holds some bytes of ids, not a batch of rows; the pieces are the same."""
    whole = sorted(map(tuple, packing.packed_digest(docs, tokenizer("word_bpe_49k.json"), 1).drop("sequence_id", "offset").collect()), key=repr)
    monkeypatch.setattr(packing, "BATCH_BYTES", limit)
    assert sorted(map(tuple, packing.packed_digest(docs, tokenizer("word_bpe_49k.json"), 1).drop("sequence_id", "offset").collect()), key=repr) == whole


def test_publish_after_a_lost_attempt(tmp_path):
    class NoReplace:
        """A file system that renames onto no file."""

        def move(self, a, b):
            raise OSError("exists")

        def __getattr__(self, name):
            return getattr(token_shards.pafs.LocalFileSystem(), name)

    for name, data in (("a", b"new"), ("b", b"old"), ("c", b"other")):
        (tmp_path / name).write_bytes(data)
    token_shards.publish(NoReplace(), str(tmp_path / "a"), str(tmp_path / "b"), 3)
    assert not (tmp_path / "a").exists() and (tmp_path / "b").read_bytes() == b"old"
    with pytest.raises(OSError, match="exists"):
        token_shards.publish(NoReplace(), str(tmp_path / "b"), str(tmp_path / "c"), 3)


def test_sstable_lookup():
    w = sstable.Writer(2)
    keys = sorted([-5, 0, 1, 1, 1, *range(10, 9000, 7)])
    for n, k in enumerate(keys):
        w.add(sstable.key_of(k), n.to_bytes(2, "little") * (k % 5))
    data = w.done()
    reader = sstable.Reader(lambda n, at: data[at : at + n], len(data))
    assert [sstable.id_of(k) for k, _ in reader.scan()] == keys
    for k in (-5, 1, 10, 17, 8998, 11, 99_999):
        assert reader.get(sstable.key_of(k)) == [n.to_bytes(2, "little") * (k % 5) for n, j in enumerate(keys) if j == k]
    bad = data[:100] + bytes([data[100] ^ 1]) + data[101:]
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(lambda n, at: bad[at : at + n], len(bad)).scan())


def test_mixing(docs, empty, spark):
    got = mixing.mix(docs).toPandas()
    sizes = {k: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for k, r in enumerate(rows())}
    assert sorted(got["size"]) == sorted(sizes.values())
    by = {}
    for k, r in enumerate(rows()):
        by[r[3]] = by.get(r[3], 0) + sizes[k]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total, weights = 1.5 * sum(by.values()), dict(zip(names, (5, 2, 1, 5), strict=True))
    goal, free = {}, set(names)
    while True:
        part = {n: total * weights[n] / sum(weights[m] for m in free) for n in free}
        over = {n for n in free if part[n] > 2 * by[n]}
        if not over:
            goal |= part
            break
        for n in over:
            goal[n] = 2 * by[n]
            total -= goal[n]
        free -= over
    assert sorted({round(t, 6) for t in got.target}) == sorted({round(t, 6) for t in goal.values()})
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    for t, g in got.groupby("target"):
        assert abs(g.taken.sum() - t) <= mixing.BLOCK
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert again.groupby("target").taken.sum().to_dict() == got.groupby("target").taken.sum().to_dict()
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.size(F.filter(F.split("text", r"[\x20\x09-\x0d]+"), lambda w: w != "")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == got.taken.sum()


def test_small_sources(spark):
    """Sources and shards under one block take their words, too."""
    given = [(0, "one two three four five six seven", "tiny"), (1, "a", "one"), *((k, text(k, 40), "big") for k in range(2, 40)), (50, "", "none")]
    got = mixing.mix(spark.createDataFrame(given, "doc_id long, text string, source string")).toPandas().merge(pd.DataFrame(given, columns=["doc_id", "_", "source"]))
    taken, target = got.groupby("source").taken.sum(), got.groupby("source").target.first()
    assert taken["tiny"] == target["tiny"] == 14 and taken["one"] == target["one"] == 2 and taken["none"] == target["none"] == 0
    assert abs(taken["big"] - target["big"]) <= 2 and (got.taken <= 2 * got["size"]).all()
    rng = np.random.default_rng(2)
    for _ in range(50):
        ring = rng.integers(0, 60, rng.integers(1, 9))
        quota = int(rng.integers(0, 2 * ring.sum() + 1))
        words = mixing.shard_words(ring, quota)
        assert words.sum() == quota and (0 <= words).all() and (words <= 2 * ring).all()


def test_mixed_documents_keep_columns(spark):
    """Columns named as the operator's own keep their values; long ids beside nulls stay exact."""
    names = "size row_id key turns runs taken ring at shard draw lo hi target quota of hash doc".split()
    given = [(None if k == 3 else (1 << 60) + k, text(k, 30), "ab"[k % 2], *(k * 100 + j for j in range(len(names)))) for k in range(12)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    known = {r[3]: r for r in given}
    rows = mixed.collect()
    assert rows and all((r.doc_id, *r[3:]) == (known[r["size"]][0], *known[r["size"]][3:]) and r.text in known[r["size"]][1] for r in rows)
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in rows) == taken


def test_mixing_deals_equal_rows(spark):
    """A row repeated through most of a table goes to several shards in runs, the same however the table is split, and no row is lost."""
    given = [(7, text(1, 900), "a")] * 90 + [(k, text(k, 400), "ab"[k % 2]) for k in range(10, 40)] + [(8, None, "a")] * 9
    takes = []
    for n in (3, 11):
        docs = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(n)
        sized = mixing.materialize(mixing.keyed(docs), "test")
        runs = mixing.in_runs(sized, 4).groupBy("doc_id", "run").count().toPandas()
        hot = runs[runs.doc_id == 7].sort_values("run")
        assert hot.run.tolist() == list(range(23)) and hot["count"].tolist() == [4] * 22 + [2]
        assert (runs[runs.doc_id != 7].run == 0).all() and runs["count"].sum() == len(given)
        got = mixing.allocate(sized, copies=4).toPandas()
        assert len(got) == len(given)
        assert all(abs(g.taken.sum() - t) <= mixing.BLOCK and (g.taken <= 2 * g["size"]).all() for t, g in got.groupby("target"))
        takes.append(sorted(zip(got.doc_id, got.taken, strict=True)))
    assert takes[0] == takes[1]


def test_mixing_of_many_sources(spark):
    """Sources apportioned as a table get what the driver's list gives: weights by order, limits, blocks, ties, null last, sources without words."""
    rng = np.random.default_rng(8)
    for lengths in (rng.integers(0, 200, 90), np.full(90, 64), np.zeros(4, int), rng.integers(300, 9000, 40)):
        given = [(k, " ".join(["w"] * int(n)), None if k % 29 == 7 else f"s{(k % 37) ** 2 % 41:02d}") for k, n in enumerate(lengths)]
        sized = mixing.materialize(mixing.keyed(spark.createDataFrame(given, "doc_id long, text string, source string")), "test")
        totals = sized.groupBy("source").agg(mixing.F.sum("size").alias("s"), mixing.F.count("*").alias("n"))
        for share in (1.5, 2.5) if lengths[0] == 64 else (1.5,):
            plan = mixing.planned(spark, totals.collect(), mixing.WEIGHTS, share, mixing.BLOCK).drop("often")
            many = mixing.planned_table(totals, mixing.WEIGHTS, share, mixing.BLOCK).drop("often")
            pick = lambda t: sorted((r.of is None, r.of or "", r.source_size, round(r.target, 6), r.quota, r.shards) for r in t.collect())
            assert pick(plan) == pick(many)
    order = ["doc_id", "size", "source_size", "turns", "taken"]
    few, many = (mixing.allocate(sized, sources=n).orderBy("doc_id").select(*order).collect() for n in (100, 3))
    assert few == many and len(many) == len(given)


def test_mixing_marks_hot_sources(spark):
    """Beyond the bound only sources with many rows are marked for a broadcast; no row is lost on either way."""
    given = [(k, "a b c", "hot" if k % 3 else f"s{k}") for k in range(300)]
    sized = mixing.materialize(mixing.keyed(spark.createDataFrame(given, "doc_id long, text string, source string")), "test")
    totals = sized.groupBy("source").agg(mixing.F.sum("size").alias("s"), mixing.F.count("*").alias("n"))
    plan = {r.of: r for r in mixing.planned_table(totals, mixing.WEIGHTS, mixing.SHARE, mixing.BLOCK, 3).collect()}
    assert len(plan) == 101 and [o for o, r in plan.items() if r.often] == ["hot"] and all(r.source_size == 3 and r.target <= 6 for o, r in plan.items() if o != "hot")
    got = mixing.allocate(sized, sources=3).toPandas()
    assert len(got) == 300 and sorted(got.doc_id) == list(range(300)) and (got.taken <= 2 * got["size"]).all()


def test_mixing_sql(docs):
    """size, source_size and target by SQL (the targets by the rounds that raise the share of a weight until no source is above twice its size)."""
    import duckdb

    given = pd.DataFrame([(k, r[1], r[3]) for k, r in enumerate(rows())], columns=["n", "text", "source"])
    con = duckdb.connect()
    con.register("d", given)
    want = con.execute("""WITH RECURSIVE s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS size FROM d GROUP BY 1),
        w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s), total AS (SELECT 1.5 * sum(size) AS t FROM s),
        r(i, share) AS (SELECT 0, (SELECT t FROM total) / (SELECT sum(weight) FROM w) UNION ALL
          SELECT i + 1, ((SELECT t FROM total) - (SELECT coalesce(sum(2 * size), 0) FROM w WHERE share * weight > 2 * size)) / (SELECT sum(weight) FROM w WHERE share * weight <= 2 * size) FROM r
          WHERE i < 10 AND EXISTS (SELECT 1 FROM w WHERE share * weight <= 2 * size))
        SELECT size AS source_size, least(2 * size, weight * (SELECT max(share) FROM r)) AS target FROM w""").fetchall()
    got = {(r.source_size, round(r.target, 6)) for r in mixing.mix(docs).collect()}
    assert got == {(int(s), round(float(t), 6)) for s, t in want}


def test_apportion():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        votes, most, seats = rng.integers(0, 50, n).astype(float), rng.integers(0, 20, n), int(rng.integers(0, 40))
        want = np.zeros(n, int)
        for _ in range(min(seats, int(most[votes > 0].sum()))):
            q = [(-votes[i] / (2 * want[i] + 1), i) for i in range(n) if want[i] < most[i] and votes[i] > 0]
            want[min(q)[1]] += 1
        assert mixing.apportion(votes, seats, most).tolist() == want.tolist()


def test_licenses(docs, empty):
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    got = licenses.license_scan(docs).toPandas()
    want = []
    for i, t, *_ in rows():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        want.append((i, len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({n for _, n in hits}))))
    nan = lambda x: None if x is None or x != x else int(x)
    assert sorted(map(repr, want)) == sorted(repr((nan(r.doc_id), r.n_words, r.n_base, nan(r.first_word), nan(r.last_word), r.base_labels)) for r in got.itertuples())
    assert got.score.between(0, 1).all() and licenses.license_scan(empty).count() == 0


def test_license_automaton():
    rng = np.random.default_rng(9)
    texts = [rng.integers(1, 4, int(n)).tolist() for n in rng.integers(1, 25, 4)]
    a = licenses.Automaton(texts)
    stream, v, n = rng.integers(1, 5, 300).tolist(), 0, 0
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for k, word in enumerate(stream):
        v, n = a.step(v, n, word)
        assert n == max((m for m in range(1, k + 2) if tuple(stream[k + 1 - m : k + 1]) in subs), default=0)
        if n:
            run = stream[k + 1 - n : k + 1]
            assert sorted(a.ends[v]) == sorted((t, e) for t, s in enumerate(texts) for e in range(len(s)) if s[max(0, e - n + 1) : e + 1] == run and e >= n - 1)


def plain_cover(template, words, gap=licenses.GAP):
    """The most words of a template that places in order in a file and the template cover, neighbours at most ``gap`` apart in both, by trying all pairs of equal words."""
    best = {}
    for f, w in enumerate(words):
        for p, v in enumerate(template):
            if w == v:
                best[f, p] = 1 + max((n for (g, q), n in best.items() if g < f and q < p and f - g - 1 <= gap and p - q - 1 <= gap), default=0)
    return max(best.values(), default=0)


def test_license_chains_lose_no_anchor():
    """Many chains of one template open at once; the oldest is still continued."""
    words = [f"w{k}" for k in range(40)]
    scanner = licenses.Scanner({}, [("x", " ".join(words))])
    file = words[:20] + [w for k in range(3) for w in words[36:40]] + words[20:]
    found = scanner.scan(" ".join(words[:20] + ["noise"] * 5 + words[20:]))["spans"]
    assert [(s[0], s[1], s[2]) for s in found] == [("x", 0, 45)] and found[0][3] == 1.0
    ends = [(0, 0, 20), *((20 + k, 30 + k % 3, 4) for k in range(0, 4)), (25, 20, 20)]
    spans = list(scanner._chains(0, [*ends, *((21 + k % 4, 5 + k, 4) for k in range(24))]))
    assert (0, 45, 1.0) in spans and scanner.scan(" ".join(file))["spans"] == []
    rng = np.random.default_rng(4)
    for _ in range(30):  # runs of four words and more in both, so that each anchor is one the scan makes
        gone = set(rng.integers(0, 9, 2).tolist())
        kept = [k for k in range(40) if k // 8 not in gone]
        file = [words[k] for k in kept]
        got = licenses.Scanner({}, [("x", " ".join(words))]).scan(" ".join(file))["spans"]
        cover = plain_cover(words, file) / 40
        assert (got[0][3] == pytest.approx(cover)) if cover >= licenses.COVER else got == []


def test_license_template_within_another():
    found = licenses.Scanner().scan("Licensed under the Apache License, Version 2.0 (the \"License\")")
    assert [(s[0], s[1], s[2], s[3]) for s in found["spans"]] == [("apache-2", 0, 8, 1.0)]


def test_license_spans():
    mit = dict(licenses.TEMPLATES[:1])["mit"]
    worn = mit.replace("free of charge", "without cost").upper() + " tail"
    found = licenses.Scanner().scan("intro words " + worn)
    assert [(s[0], s[1]) for s in found["spans"]] == [("mit", 2)] and 0.8 <= found["spans"][0][3] < 1
    assert licenses.Scanner().scan("this work is licensed under the gnu general public license version 3")["spans"][0][0] == "gpl-3"
    assert licenses.Scanner().scan("under the permission of any person to use and sell copies")["spans"] == []


def test_toxicity(spark, docs, labels, empty):
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == len(rows()) and got.score.between(0, 1).all() and ((got.score >= 0.5) == got.predicted).all()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(16)}
    assert all(held[int(r.doc_id)] == r.held_out for r in got.itertuples() if 0 <= (r.doc_id if r.doc_id == r.doc_id else -1) < 16)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert set(toxicity.toxicity(docs, labels.where("false")).toPandas().score) == {0.5}
    insults = [(k, f"{text(k, 30)} {'you blockhead' if k % 4 == 0 else 'hello'} {text(k + 500, 20)}") for k in range(400)]
    frame = spark.createDataFrame(insults, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(frame, marks).where("held_out").toPandas()
    assert ((found.doc_id % 4 == 0) == found.predicted).mean() > 0.95


def test_pairs_that_neither_word_shows(spark):
    """An insult and a group are as frequent in either class; only the two together, or neither, are marked. The fit finds the pair."""
    kinds = [("", 1), ("blockhead", 0), ("cobblers", 0), ("blockhead cobblers", 1)]
    given = [(k, f"{text(k, 15)} {kinds[k % 4][0]} {text(k + 900, 15)}") for k in range(800)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1, kinds[k % 4][1]) for k in range(800)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(frame, marks)
    bucket = lambda w: zlib.crc32(w.encode()) % (1 << toxicity.BITS)
    assert {bucket("blockhead"), bucket("cobblers")} <= set(machine.inputs.tolist())
    found = toxicity.toxicity(frame, marks).where("held_out").toPandas()
    assert (found.predicted == [kinds[k % 4][1] for k in found.doc_id]).mean() > 0.95


def test_toxicity_scores(spark):
    """Scores against the machine's formula with every pair written out, over terms found anew."""
    given = [(k, f"{text(k, 12)} {'blockhead' if k % 4 == 0 else 'hello'}") for k in range(200)] + [(900, None), (901, "")]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    machine = toxicity.fit(frame, spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int"))
    assert len(machine.inputs) > 3
    place = {int(b): i for i, b in enumerate(machine.inputs)}
    for r in toxicity.score(frame, machine).collect():
        words = set(re.findall(r"[a-z]+", dict(given)[r.doc_id] or ""))
        have = sorted({place[b] for w in words for term in (w, "4^" + w[:4], "5^" + w[:5]) if (b := zlib.crc32(term.encode()) % (1 << toxicity.BITS)) in place})
        z = machine.bias + sum(machine.w[i] for i in have) + sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(have) for j in have[n + 1 :])
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_pairwise():
    """Neither term alone, but both together, say 1."""
    r = [np.array(x, np.int64) for x in ([0], [1], [0, 1], [2])] * 60
    y = np.array([0, 0, 1, 0] * 60, float)
    m = toxicity.Machine(np.arange(3)).fit(r, y)
    s = m.score(r[:4])
    assert s[2] > 0.5 > max(s[0], s[1], s[3])
    z = m.bias + m.w[0] + m.w[1] + m.v[0] @ m.v[1]
    assert math.isclose(s[2], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality(spark, docs, labels, empty):
    got = quality.quality(docs, labels).toPandas()
    assert len(got) == len(rows()) and got.score.between(0, 1).all() and ((got.score >= 0.7) == got.predicted).all()
    assert quality.quality(empty, labels).count() == 0
    junk = [(k, " ".join(w.upper() + "!!" for w in text(k, 40).split()) if k % 3 == 0 else text(k, 60)) for k in range(300)]
    frame = spark.createDataFrame(junk, "doc_id long, text string")
    found = quality.quality(frame, spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")).where("held_out").toPandas()
    assert ((found.doc_id % 3 > 0) == found.predicted).mean() > 0.95


def test_statistics():
    for t in ("Two words", "", None, "A b, b b!\n\nA|{x} 12 ñé\nA b", "ONE"):
        raw, words, lines = (t or "").encode(), (t or "").split(), (t or "").split("\n")
        share = lambda chars: math.sqrt(sum(raw.count(c) for c in chars) / max(1, len(raw)))
        n, kinds = len(words), sorted(set(words))
        sizes = [len(w) for w in kinds]
        mean = sum(sizes) / max(1, len(sizes))
        want = [
            math.log1p(len(raw)), math.log1p(n), math.log1p(len(raw) / max(1, n)), math.log1p(math.sqrt(sum((s - mean) ** 2 for s in sizes) / max(1, len(sizes)))), math.log1p(max(sizes, default=0)),
            math.log1p(len(kinds)) / math.log1p(max(2, n)), math.sqrt(max(map(words.count, kinds), default=0) / max(1, n)), math.sqrt(sum(words[i] == words[i + 1] for i in range(n - 1)) / max(1, n)), math.sqrt(len(set(lines)) / len(lines)),
            share(range(65, 91)), share(range(48, 58)), share(b"\n"), share(b".,;:'\"-?"), share(b"!"), share(b"|"), share(b"#$%&*+/<=>@[\\]^_`{}~()"),
        ]
        assert np.allclose(quality.statistics(t), want)


def test_discriminant():
    rng = np.random.default_rng(2)
    x, y = np.r_[rng.normal(0, 1, (80, 3)), rng.normal(1.5, 2, (120, 3))], np.r_[np.zeros(80, int), np.ones(120, int)]
    m = quality.Discriminant(x, y, 0.3, 0.1)
    z = m._standard(x)
    own = [z[y == c] for c in (0, 1)]
    covs = [np.cov(o.T, bias=True) for o in own]
    both = 0.4 * covs[0] + 0.6 * covs[1]
    logs = []
    for o, c, s in zip(own, covs, (0.4, 0.6), strict=True):
        c = 0.7 * c + 0.3 * both
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(3)
        d = z - o.mean(0)
        logs.append(np.log(s) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_language(spark, docs, empty):
    got = language.language(docs).toPandas()
    assert len(got) == len(rows()) and got.score.between(0, 1).all()
    no_letter = {4, 5, 6}
    assert set(got[got.doc_id.isin(no_letter)].lang_pred) == {"und"} and set(got[~got.doc_id.isin(no_letter) & got.doc_id.notna()].lang_pred) <= {"en", "fr"}
    assert language.language(empty).count() == 0
    both = [(k, text(k, 40) if k % 2 else " ".join(np.random.default_rng(k).choice("le chat noir mange du poisson avec une grande faim dans la maison".split(), 40)), "en" if k % 2 else "fr") for k in range(200)]
    found = language.language(spark.createDataFrame(both, "doc_id long, text string, lang string")).where("held_out").toPandas()
    assert (found.lang_pred == np.where(found.doc_id % 2, "en", "fr")).mean() > 0.97


def test_far_texts_go(spark):
    """Rank-order distances decide: texts of no learned language go, and lang becomes what was found."""
    near = [(k, text(k, 40), "en", "s", 1) for k in range(40)]
    odd = [(100, "Ελληνικά γράμματα μόνο εδώ σήμερα", None, "s", 1), (101, "", "en", "s", 1), (102, None, "en", "s", 1), (103, "123 !!", None, "s", 1), (104, text(104, 40), None, "s", 1), (104, text(104, 40), None, "s", 1)]
    frame = spark.createDataFrame(near + odd, "doc_id long, text string, lang string, source string, score long")
    profiles = language.fit(frame)
    kept = language.keep_known(frame, profiles).collect()
    assert sorted(r.doc_id for r in kept) == [*range(40), 104, 104] and {r.lang for r in kept} == {"en"} and {r.score for r in kept} == {1}
    held = language.Profiles(language.held(profiles))
    assert held.measure(odd[0][1])[2] > language.FAR > held.measure(near[0][1])[2]
    assert language.keep_known(frame.where("false"), profiles).count() == 0


def vectors(spark, n=300, dim=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    data = [(k, x[k].tolist(), 1.0) for k in range(n)] + [(n, None, 1.0), (n + 1, [0.0] * dim, 1.0), (n + 2, [float("nan")] * dim, 1.0), (n + 3, [None] * dim, 1.0), (None, x[0].tolist(), 1.0), (n + 4, [1.0, 2.0], 1.0), (n + 5, x[0].tolist(), 1.0), (n + 6, x[0].tolist(), 1.0), (n + 7, [], 1.0)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, score double")


def best_by_product(good, q, k):
    return sorted(((-float(good[q] @ v), j) for j, v in good.items() if j != q and len(v) == len(good[q])))[:k]


@pytest.mark.parametrize("settings", [{}, {"list_rows": 60}, {"block": 16 * 9, "query_block": 16 * 2}])
def test_neighbours(spark, settings):
    data, frame = vectors(spark)
    got = one_bit.neighbours(frame, **settings).toPandas()
    good = {i: np.array(e, float) for i, e, _ in data if i is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)}
    hit = total = 0
    for q in (i for i in good if i % 20 == 0):
        want, own = best_by_product(good, q, 20), got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and len(own) == len(want)
        assert own.score.tolist() == [(good[q] * good[j]).sum() for j in own.vec_id]
        assert [(-s, j) for s, j in zip(own.score, own.vec_id, strict=True)] == sorted((-s, j) for s, j in zip(own.score, own.vec_id, strict=True))
        hit += len({j for _, j in want} & set(own.vec_id))
        total += len(want)
    assert hit / total >= 0.9
    assert one_bit.neighbours(frame.where("false")).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324, 1e308])
def test_neighbours_of_any_length(spark, size):
    """Finite vectors take part however long they are; scores that leave the range of doubles are infinite or zero and tie."""
    rng = np.random.default_rng(8)
    rows = [(k, np.clip(rng.normal(size=8) * size, -1.7e308, 1.7e308).tolist()) for k in range(60)]
    rows = [(k, x if any(x) else [size] * 8) for k, x in rows]
    got = one_bit.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert sorted(got.query_id) == [0] * 20 + [20] * 20 + [40] * 20
    whole = {k: one_bit.scaled(np.array([x]))[0][0] for k, x in rows}
    for q in (0, 20, 40):
        own = got[got.query_id == q].sort_values("rank")
        products = [float(whole[q] @ whole[j]) for j in own.vec_id]
        assert own.score.tolist() == ([math.copysign(math.inf, s) for s in products] if size > 1 else [0.0] * 20)
        assert own.vec_id.tolist() == [j for _, j in sorted(zip(-own.score, own.vec_id, strict=True))]


@pytest.mark.parametrize("times", [1, 100_000, 1e9, 1e300])
def test_exact_neighbours(spark, times):
    """With components of any size; what exceeds a long is held at its ends."""
    data, frame = vectors(spark, 120)
    frame = frame.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * times))
    hold = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    integer = lambda x: hold(math.floor(256 * (float(np.float32(x)) * times))) if abs(x) * times < 1e300 else (hold(math.copysign(1 << 70, x).__int__()))
    whole = {i: [integer(x) for x in e] for i, e, _ in data if i is not None and e and None not in e and np.isfinite(np.array(e, float)).all()}
    for settings in ({}, {"block": 16 * 25, "query_block": 16}):
        got = va_file.exact_neighbours(frame, **settings).toPandas()
        for q in (i for i in whole if i % 50 == 0):
            want = sorted((-hold(sum(a * b for a, b in zip(whole[q], v, strict=True))), j) for j, v in whole.items() if j != q and len(v) == len(whole[q]))[:5]
            own = got[got.query_id == q].sort_values("rank")
            assert [(-int(s), j) for s, j in zip(own.score, own.vec_id, strict=True)] == want
    assert va_file.exact_neighbours(frame.where("false")).count() == 0


def test_cells_bound_products():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-900, 900, (300, 12)), rng.integers(-900, 900, (70, 12))
    x[0, 0] = 10**9
    marks = np.array([-500, -20, 0, 7, 300])
    for lows, ups in va_file.bounds(q.astype(float), *va_file.approximate(x, marks), marks):
        exact = (q[: len(lows)] @ x.T) if len(lows) == 64 else q[64:] @ x.T
        assert (lows <= exact).all() and (exact <= ups).all()


def test_one_bit_bounds():
    """The estimate's error stays below its bound for nearly all pairs, and is what the unpacked signs give."""
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(2000, 60)), rng.normal(size=(3, 60))
    codes, lengths, kept = one_bit.encode(x)
    low, up = next(one_bit.bounds(q, codes, lengths, kept))
    unit = q / np.linalg.norm(q, axis=1)[:, None]
    signs = np.unpackbits(codes, axis=1, count=60) * 2.0 - 1
    assert np.allclose((low + up) / 2, (unit @ one_bit.rotation(60)) @ signs.T * lengths / (kept * np.sqrt(60)), atol=1e-4)
    exact = unit @ x.T
    assert ((low <= exact) & (exact <= up)).mean() > 0.85
