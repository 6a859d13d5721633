"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are encoded once and stored as the pieces that sequences take: a document's whole multiples of the sequence size, which fill sequences
of their own, and its rest. Only the pieces' lengths are shuffled. The driver sees the histogram of lengths
(at most ``size`` rows) and places lengths longest first: each goes to the pack with the most room,
and packs that are alike are held as one pattern with a count. The patterns, as rank intervals, are joined back to the pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.shared import materialize
from brightloom.llm.token_ids import encoder

SIZE = 2048
#: The rank intervals number a few for each length up to the sequence size; so many at most are broadcast.
BROADCAST_ROWS = 200_000
#: Pieces of a bucket, about: what one task numbers of a length is a part of them.
BUCKET = 100_000
#: Bytes of ids that a worker gives back at once, about.
BATCH_BYTES = 8 << 20


def encode(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, blanks: bool = False) -> DataFrame:
    """The stored pieces of ``docs`` (doc_id, text): row_id, doc_id, start, length, ids (unsigned 32-bit little-endian bytes) and doc_tokens; a null text counts as empty."""
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, blanks, end_id)
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        held = 0
        for batch in batches:
            for row_id, doc_id, coded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), code.encode_all(batch.column(2)), strict=True):
                ids = np.frombuffer(coded, code.dtype).astype("<u4")
                out += [(row_id, doc_id, at, len(part), part.tobytes(), len(ids)) for at in range(0, len(ids), size) for part in [ids[at : at + size]]]
                held += ids.nbytes
                if held >= BATCH_BYTES:
                    yield made()
                    out, held = [], 0
        if out:
            yield made()

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text")
    return materialize(rows.mapInArrow(run, "row_id long, doc_id long, start long, length long, ids binary, doc_tokens long"), "pack-pieces")


def patterns(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place ``counts`` (items by length) into packs.

    Returns rows (length, first rank, last rank + 1, sequence of the first rank, offset in the sequence) and the number of sequences.
    Items of one length are told apart by rank alone.
    """
    packs: dict[int, list[tuple[int, list]]] = {}  # by fill: count and slots (length, rank, offset) of alike packs
    room: list[int] = []  # fills as a heap: the shortest first

    def put(fill: int, count: int, slots: list) -> None:
        if fill not in packs:
            packs[fill] = []
            heapq.heappush(room, fill)
        packs[fill].append((count, slots))

    done: list[tuple[int, list]] = []
    for n, count in sorted(counts.items(), reverse=True):
        rank = 0
        while count:
            while room and not packs[room[0]]:
                del packs[heapq.heappop(room)]
            if room and room[0] + n <= size:
                fill = room[0]
                have, slots = packs[fill].pop()
                take = min(have, count)
                if take < have:
                    packs[fill].append((have - take, [(a, r + take, o) for a, r, o in slots]))
                each = 1
            else:  # new packs take as many as they hold, the last one the others
                each = min(size // n, count)
                fill, slots, take = 0, [], count // each
            slots = [*slots, *((n, rank + j * take, fill + j * n) for j in range(each))]
            if fill + n * each == size:
                done.append((take, slots))
            else:
                put(fill + n * each, take, slots)
            rank, count = rank + take * each, count - take * each
    rows, base = [], 0
    for count, slots in [*done, *(x for fill in sorted(packs) for x in packs[fill])]:
        rows += [(n, r, r + count, base, o) for n, r, o in slots]
        base += count
    return rows, base


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """row_id, start, sequence_id and offset of every row of the stored ``pieces`` (row_id, start, length of at most ``size``)."""
    # A common length is dealt to many buckets, each of which holds about BUCKET pieces of all lengths.
    buckets = max(1, -(-pieces.count() // BUCKET))
    items = pieces.select("row_id", "start", "length", F.pmod(F.xxhash64("row_id", "start"), F.lit(buckets)).alias("bucket"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = items.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    held = materialize(held.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))), "pack-ranks")
    counts = {r["length"]: r["c"] for r in held.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `size` rows
    rows, _ = patterns(counts, size)
    plan = pieces.sparkSession.createDataFrame(rows, "of long, lo long, hi long, base long, offset long")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan
    ranked = items.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_id", "start"))).join(held.select("length", "bucket", "first"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("k") - 1)
    found = ranked.join(plan, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select("row_id", "start", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, blanks: bool = False) -> DataFrame:
    """Encode and pack ``docs`` (doc_id, text): one row for each piece with its ids (array). Every id of every row lies in one piece, whatever ids repeat or are null; an empty table gives none."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column("ids")], pa.list_(pa.int64()))
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)

    pieces = encode(docs, tokenizer, end_id, size, blanks)
    return _placed(pieces, pack(pieces, size)).mapInArrow(unpack, "doc_id long, start long, length long, ids array<long>, doc_tokens long, sequence_id long, offset long")


def packed_digest(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, blanks: bool = False) -> DataFrame:
    """As ``packed``, with ids_crc32 in place of the ids, taken of the stored pieces, so that no ids are shuffled."""
    pieces = encode(docs, tokenizer, end_id, size, blanks)
    return _placed(pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32"), pack(pieces, size))


def _placed(pieces: DataFrame, places: DataFrame) -> DataFrame:
    return pieces.join(places, ["row_id", "start"]).select("doc_id", "start", "length", *[c for c in pieces.columns if c.startswith("ids")], "doc_tokens", "sequence_id", "offset")
