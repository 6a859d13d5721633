"""Phrase collocations by merged count-min sketches and an exact count of what they leave.

First pass: the words and the phrases of up to five words of every task's texts go to a count-min sketch, whose counters stop at 255, as all that is asked of
them is whether they reach the least count. Sketches are merged by adding them, slice by slice, in a tree; what stays of the sum is one bit a cell. A sketch
never counts too low, so nothing frequent is lost. Second pass: survivors, and only they, are counted exactly, by their text. Scores, and which
phrases stand inside longer ones as frequent as they are, come from joins of the exact counts with themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.shared import materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text for each cell of a row of the sketch; cells of a row, at least and at most: beyond the most, more phrases survive to the exact count.
BYTES_A_CELL, CELLS = 96, (1 << 16, 1 << 26)
#: Rows of a sketch; cells that are merged in one group; sketches that are merged at a time.
DEPTH, SLICE, FAN = 2, 1 << 16, 32
#: Words that are taken at a time, about.
WORDS = 1 << 17
#: Sketches for each core, so that what is merged grows with their cells alone.
SKETCHES_A_CORE = 1
_FULL = 255
_NEXT, _ROWS = np.uint64(0x5851F42D4C957F2D), np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Lower-case A to Z, a blank for each tab, a line feed for each mark that ends a piece.
_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Chunk:
    """Words of some texts, as numbers in ``known``, each with the run (a piece, or a part of a long one) and the language that it stands in. ``own``: whether phrases that begin there count here."""

    def __init__(self, words: list[bytes], lengths: list[int], owned: list[int], langs: list[int]):
        known: dict[bytes, int] = {}
        self.words, self.numbers = words, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        self.known, self.runs = list(known), np.repeat(np.arange(len(lengths)), lengths)
        self.langs = np.repeat(np.array(langs, np.int64), lengths)
        self.own = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat(owned, lengths)

    def ends_inside(self, places: np.ndarray, k: int) -> np.ndarray:
        """Those of ``places`` from which k words stand in one run."""
        places = places[places + k <= len(self.words)]
        return places[self.runs[places + k - 1] == self.runs[places]]

    def hashes(self, names: list[str]) -> Iterator[np.ndarray]:
        """For each length from 1, hashes of the language and the words that begin at every place (of no meaning where the run ends before)."""
        words = np.array([xxhash.xxh64_intdigest(w) for w in self.known], np.uint64)[self.numbers]
        found = words + np.array([xxhash.xxh64_intdigest(n) for n in names], np.uint64)[self.langs] * _NEXT
        while True:
            yield found
            words = np.append(words[1:], np.zeros(1, np.uint64))
            found = found * _NEXT + words


def chunks(batches: Iterator[pa.RecordBatch], names: list[str], longest: int = LONGEST, most: int = WORDS) -> Iterator[Chunk]:
    """The words of the texts (lang, text) in chunks of about ``most``. A longer piece is cut to runs that carry the next longest - 1 words along. Languages are added to ``names``."""
    numbers: dict[str, int] = {}
    words: list[bytes] = []
    lengths: list[int] = []
    owned: list[int] = []
    langs: list[int] = []
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in numbers:
                numbers[lang] = len(names)
                names.append(lang)
            for piece in (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_BYTES).split(b"\n"):
                found = piece.split()
                for at in range(0, len(found), most):
                    run = found[at : at + most + longest - 1] if len(found) > most else found
                    words += run
                    lengths.append(len(run))
                    owned.append(min(most, len(found) - at))
                    langs.append(numbers[lang])
                    if len(words) >= most:
                        yield Chunk(words, lengths, owned, langs)
                        words, lengths, owned, langs = [], [], [], []
    if words:
        yield Chunk(words, lengths, owned, langs)


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell, of ``width``, of each hash in a row of a sketch: the upper half of its product with the row's factor, scaled."""
    return (((hashes * _ROWS[row]) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.uint32)


def add(sketch: np.ndarray, hashes: np.ndarray) -> None:
    """Count ``hashes`` in every row of a sketch; counters stop at 255."""
    for r, row in enumerate(sketch):
        found = np.sort(cells(hashes, r, len(row)))
        first = np.flatnonzero(np.diff(found, prepend=-1))
        row[found[first]] = np.minimum(row[found[first]] + np.diff(first, append=len(found)), _FULL)


def _partial(docs: DataFrame, width: int, depth: int, longest: int) -> DataFrame:
    """part, row, slice and cells of every task's sketch, and lang and n (words) of what it read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        sketch, n = np.zeros((depth, width), np.uint8), np.zeros(0, np.int64)
        for chunk in chunks(batches, names, longest):
            own = np.flatnonzero(chunk.own)
            n = np.bincount(chunk.langs[own], minlength=len(names)) + np.pad(n, (0, len(names) - len(n)))
            for k, h in zip(range(1, longest + 1), chunk.hashes(names), strict=False):
                add(sketch, h[chunk.ends_inside(own, k)])
        part, size = TaskContext.get().partitionId(), min(SLICE, width)
        yield pa.RecordBatch.from_pydict({"part": [part] * len(n), "row": [-1] * len(n), "slice": [0] * len(n), "cells": [None] * len(n), "lang": names[: len(n)], "n": n.tolist()}, schema)
        for r in range(depth):
            for s in range(width // size):
                some = sketch[r, s * size : (s + 1) * size]
                if some.any():
                    yield pa.RecordBatch.from_pydict({"part": [part], "row": [r], "slice": [s], "cells": [some.tobytes()], "lang": [None], "n": [None]}, schema)

    schema = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("slice", pa.int32()), ("cells", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])
    tasks = SKETCHES_A_CORE * docs.sparkSession.sparkContext.defaultParallelism
    return materialize(docs.coalesce(tasks).mapInArrow(run, "part int, row int, slice int, cells binary, lang string, n long"), "phrase-sketches")


def _merged(parts: DataFrame, tasks: int, width: int, depth: int, least: int) -> np.ndarray:
    """For each row of the summed sketches, a bit for each cell: whether it reaches ``least``. ``depth`` * ``width`` bits, at most 16 MB by the settings, come to the driver."""

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(min(SLICE, width), np.int64)
        for c in rows["cells"]:
            found += np.frombuffer(c, np.uint8)
        return pd.DataFrame([(*key, np.minimum(found, _FULL).astype(np.uint8).tobytes())], columns=["part", "row", "slice", "cells"])

    parts = parts.where("row >= 0").select("part", "row", "slice", "cells")
    while tasks > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part", "row", "slice").applyInPandas(total, "part int, row int, slice int, cells binary")
        tasks = -(-tasks // FAN)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cells=[np.packbits(np.frombuffer(c, np.uint8) >= least, bitorder="little").tobytes() for c in batch["cells"]])[["row", "slice", "cells"]]

    held, size = np.zeros((depth, width // 8), np.uint8), min(SLICE, width) // 8
    for r in parts.mapInPandas(bits, "row int, slice int, cells binary").toArrow().to_pylist():
        held[r["row"], r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["cells"], np.uint8)
    return held


def survivors(chunk: Chunk, names: list[str], bits: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: the length, a place of every distinct phrase of the chunk that may be frequent, and its exact count in the chunk.

    A phrase may be frequent if all its cells are, and so may the two phrases that it has without its last and its first word.
    """
    of, alive = chunk.langs, np.ones(len(chunk.words) + 1, bool)
    places = np.arange(len(chunk.words))
    for k, h in zip(range(1, longest + 1), chunk.hashes(names), strict=False):
        if k > 1:
            places = chunk.ends_inside(places[alive[places + 1]], k)
        for r, row in enumerate(bits):
            at = cells(h[places], r, 8 * len(row))
            places = places[(row[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        alive[:] = False
        alive[places] = True
        _, first, number = np.unique(of[places] * len(chunk.known) + chunk.numbers[places + k - 1], return_index=True, return_inverse=True)
        of = np.zeros(len(chunk.words), np.int64)
        of[places] = number
        counts = np.bincount(number[chunk.own[places]], minlength=len(first))
        yield k, places[first[counts > 0]], counts[counts > 0]


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, width: int | None = None, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Stored tables of lang, words (how many), phrase and a (its occurrences) of all words and phrases that occur ``least`` times or more in a language, and of lang and n, its words.

    ``docs`` (lang, text). ``width`` is the cells of a sketch's row, a multiple of 8 and, above ``SLICE``, of that; by default it follows the bytes of the texts within ``CELLS``. Counts are exact at any width.
    ``least`` is at most 255, ``depth`` at most 4.
    """
    if not 1 <= least <= _FULL or not 1 <= depth <= len(_ROWS):
        raise ValueError(f"a least count of 1 to {_FULL} and 1 to {len(_ROWS)} rows are possible")
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = width or min(max(CELLS[0], -(-size // (BYTES_A_CELL * SLICE)) * SLICE), CELLS[1])
    parts = _partial(docs, width, depth, longest)
    held = docs.sparkSession.sparkContext.broadcast(_merged(parts, (parts.agg(F.max("part")).first()[0] or 0) + 1, width, depth, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for chunk in chunks(batches, names, longest):
            for k, places, counts in survivors(chunk, names, held.value, longest):
                texts = [b" ".join(chunk.words[p : p + k]) for p in places.tolist()]
                found = (pa.array([names[i] for i in chunk.langs[places].tolist()], pa.string()), pa.array(np.full(len(places), k, np.int32)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(found), names=["lang", "words", "phrase", "a"])

    counted = docs.mapInArrow(run, "lang string, words int, phrase string, a long").groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return materialize(counted, "phrase-counts"), parts.where("row < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def score_of(a: str, n: str, first: str, rest: str) -> Column:
    """floor(1000 * a * n / (first * rest)) of columns of longs, exact: products of two take 38 digits as decimals."""
    number = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"({number(f'1000 * {a}')} * {number(n)}) div ({number(first)} * {number(rest)})")


def _joined(words: str, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, width: int | None = None, depth: int = DEPTH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of two to ``longest`` words that occur ``least`` times or more.

    A null lang is `und`; null and empty texts have no words; repeated rows and ids count each time; other columns are ignored; an empty table gives an empty one. The score is that of the
    cut with the lowest, floor(1000 * a * n / (l * r)), ties to the shortest first part; equal scores are ordered by a, then by the phrase's bytes. A phrase that stands inside a longer one
    that occurs as often is left out.
    """
    counts, sizes = frequent(docs, least, longest, width, depth)
    phrases = counts.where("words > 1").withColumn("split", F.split("phrase", " "))
    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    parts = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: _joined("split", s, m))))
    inside = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "words", "split", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined("split", F.lit(1), F.col("k")).alias("first"), _joined("split", F.col("k") + 1, F.col("words")).alias("rest"))
    known = lambda part, count: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(count))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    cuts = cuts.withColumn("score", score_of("a", "n", "l", "r"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH p AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, k, array_to_string(words[s:s + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM p, range(1, 6) r(k) WHERE len(words) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM p GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1
), inside AS (
  SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, words, a, k, m, unnest(range(1, k - m + 2)) AS s FROM c, range(2, 5) r(m) WHERE m < k) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, i, array_to_string(words[1:i], ' ') AS first, array_to_string(words[i + 1:], ' ') AS rest
  FROM c LEFT JOIN inside USING (lang, phrase), range(1, 5) r(i) WHERE i < c.k AND (longer IS NULL OR longer < c.a)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n, CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score, i
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
