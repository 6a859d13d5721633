"""SimHash near-duplicates by a range join of segment bit counts.

A fingerprint's 32 segments of two bits are mapped to their bit counts (0, 1 or 2). The Manhattan distance of two such
vectors is at most the Hamming distance of the fingerprints, so fingerprints that differ in at most 3 bits
lie within 3 of each other and agree in all counts of at least five of eight groups of four segments. Each choice of five groups
is a grid whose cells hold what agrees there; fingerprints that share a cell are compared by the distance of the whole vectors, and those that
remain are verified bit by bit.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brightloom.llm.components import components
from brightloom.llm.shared import forget, joined, materialize

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Bytes of a text that are shingled at a time.
PIECE = 1 << 20
#: Fingerprints of a cell that one task compares with the whole cell, about: a fuller cell is dealt to several.
SHARE = 4096
#: For each choice of five of eight bytes, ones in the other three, whose counts do not matter: no segment counts three bits, so cells of different grids differ.
GRIDS = tuple(sum(0xFF << 8 * g for g in out) for out in itertools.combinations(range(8), 3))
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set, bit 0 first: eight counters of a byte in each word."""
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(h), 255):
        for i in range(8):
            counts[i] += ((h[at : at + 255] >> np.uint64(i)) & _LANES).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    return counts.T.reshape(64)


def _byte_lane_counts(h: np.ndarray) -> np.ndarray:
    whole = len(h) // 255 * 255
    counts = _bit_counts(h[whole:])
    if whole:
        blocks = h[:whole].reshape(-1, 255)
        for i in range(8):
            sums = ((blocks >> np.uint64(i)) & _LANES).sum(axis=1, dtype=np.uint64)
            counts[i::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | None) -> int:
    """64 bits, each set if over half of the 3-word shingles' XXH64 (seed 42) set it; no word, as in a null text: zero."""
    data = (text or "").encode().lower()
    counts, n, words = np.zeros(64, np.int64), 0, []
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + PIECE)
        end = blank.start() if blank else len(data)
        words += data[at:end].split()
        at = end
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
            h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
            counts, n = counts + _byte_lane_counts(h), n + len(h)
            words = words[1 - SHINGLE :]
    if not n and words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and ``others`` of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])
        forget()

    given = docs.select(F.col("doc_id").cast("long"), "text", *others)
    return given.mapInArrow(run, StructType([given.schema[0], StructField("fp", LongType()), *given.schema[2:]]))


def _segment_counts(x: Column) -> Column:
    """The bit counts of the two-bit segments of x, in two bits each."""
    low = F.lit(0x5555555555555555)
    first, second = x.bitwiseAND(low), F.shiftrightunsigned(x, 1).bitwiseAND(low)
    return first.bitwiseXOR(second).bitwiseOR(F.shiftleft(first.bitwiseAND(second), 1))


def _manhattan(x: Column, y: Column) -> Column:
    """The sum over the two-bit counters of |x - y|: each differs by 0, 1 or 2, which is the bits of the xor of their unary forms."""
    ones = F.lit(0x5555555555555555)

    def unary(c: Column) -> Column:  # 0, 1, 2 -> 00, 01, 11
        high = F.shiftrightunsigned(c, 1).bitwiseAND(ones)
        return c.bitwiseOR(high)

    return F.bit_count(unary(x).bitwiseXOR(unary(y)))


def links(fps: DataFrame, share: int = SHARE) -> DataFrame:
    """Links (a, b), a < b, of the distinct fingerprints ``fps`` (fp) that differ in at most 3 bits; a link may come several times.

    Each fingerprint makes a row for each grid, whatever their number. Cells are counted by partial sums, and rows alone in theirs go; a cell of
    more than ``share`` fingerprints is dealt by hash to so many more tasks, each of which compares its part with the whole cell.
    """
    grids = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in GRIDS))
    cells = fps.select("fp", _segment_counts(F.col("fp")).alias("counts")).select("fp", F.explode(F.transform(grids, lambda m: F.col("counts").bitwiseOR(m))).alias("cell"))
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / share).alias("parts"))
    shared = materialize(joined(cells, crowded, "cell").select("fp", "cell", "parts"), "cells")
    left = shared.select(F.col("fp").alias("a"), "cell", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
    right = shared.select(F.col("fp").alias("b"), "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    near = _manhattan(_segment_counts(F.col("a")), _segment_counts(F.col("b"))) <= DISTANCE
    return joined(left, right, ["cell", "part"]).where((F.col("a") < F.col("b")) & near & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")


def _rooted(groups: DataFrame) -> DataFrame:
    """fp, first and root (the smallest fingerprint reachable over links) of every row of ``groups`` (fp, first), whose fingerprints are distinct."""
    roots = components(links(groups.select("fp")))
    return joined(groups, roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of every row.

    Null and empty texts have the fingerprint zero and are linked like others. Repeated ids stay as rows; a null
    id never is a component_id unless its component has no other. Other columns are ignored; an empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    labelled = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined(labelled, least, "root").select("fp", "component_id")
    return joined(rows, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each component of near-duplicates: the smallest doc_id, null ids last, then by a hash of the row.

    Rows are told apart by a number of their own, so that null and repeated ids cost no component its row.
    """
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("near_row")), "numbered")
    given = numbered.select("doc.doc_id", "doc.text", F.xxhash64(*(F.col("doc")[c] for c in docs.columns)).alias("hash"), "near_row")
    rows = materialize(fingerprints(given, F.col("hash"), F.col("near_row")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "near_row")
    first = _rooted(rows.groupBy("fp").agg(F.min(order).alias("first"))).groupBy("root").agg(F.min("first").alias("first"))
    return joined(numbered, first.select("first.near_row"), "near_row", "left_semi").select("doc.*")
