"""A stored index of chunks in segments: posting blocks, section keys, and the rows of older segments that no longer hold.

A segment has three tables. ``chunks``: chunk_id, what was carried, words, dl (how many) and row (a number); chunks lie in the order in which they come, those of a task in order of their documents, and
each TILE of row numbers are a tile. ``postings``: a block for each lexeme and tile (n chunks, the largest tf and the smallest dl among them, and the entries, which name a chunk by its place in the tile),
in runs of about RUN words, each sorted by lexeme and tile, so that blocks are bounded without their entries being read, and a common lexeme has many files. Ids are looked up for what a search leaves (``named``). ``keys``: a row for each section and subsection of a chunk, sorted by the reference.

An update writes one more segment and, for the tiles of every older one, the places of the chunks that no longer hold (``dead``). A commit is a row appended to ``commits`` that names the segments in use, so readers see the
index before or after it. ``merge`` makes one segment of all. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions.stem import stem_words
from brightloom.functions.text import matches
from brightloom.operators.held import new_folder

#: Chunks of a tile (a long has a bit for each), and segments from which on an update merges them all.
TILE, SEGMENTS = 64, 8
#: Words of a sorted run of posting blocks, and blocks of a page, so that a search reads of every run the pages of its words.
RUN, PAGE = 1 << 20, 2000
_TOKEN = r"[\p{L}\p{N}_]+"
_ENTRY = "struct<slot:tinyint,tf:int,dl:int,positions:array<int>>"
_POSTINGS = f"lexeme string, tile long, n int, most int, least int, entries array<{_ENTRY}>"
_COMMIT = "number int, segments array<int>, english boolean, batch long, n long, words long"
# Frequent English words that carry no lexeme.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so that the their them then there these they "
    "this to was we were what which who will with you your"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return matches(F.lower(text), _TOKEN)


def lexemes(text: Column, english: bool = False) -> Column:
    """Tokens; with ``english`` stemmed (Porter 1980) and without stop words, whose places stay empty strings so that positions hold."""
    return stem_words(F.transform(tokens(text), lambda t: F.when(F.array_contains(F.array(*map(F.lit, STOP_WORDS)), t), "").otherwise(t))) if english else tokens(text)


@dataclass
class Index:
    """Tables of all segments in use, each with its segment's number; ``dead`` (segment, tile, slots: a bit for each place, n chunks and their words) is None if every chunk holds."""

    chunks: DataFrame
    postings: DataFrame
    keys: DataFrame
    dead: DataFrame | None
    english: bool
    #: Chunks that hold, and their words.
    n: int
    words: int
    #: Indexes in which this is equal number their chunks alike.
    numbering: str

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (segment, row) without those that no longer hold."""
        if self.dead is None:
            return rows
        gone = self.dead.select("segment", F.col("tile").alias("_tile"), "slots")
        tiled = rows.withColumn("_tile", F.expr(f"row div {TILE}")).join(gone, ["segment", "_tile"], "left")
        return tiled.where(F.col("slots").isNull() | (F.getbit("slots", (F.col("row") % TILE).cast("int")) == 0)).select(*rows.columns)

    def entries(self, lexeme: Column) -> DataFrame:
        """segment, lexeme, chunk_id, tf, dl and positions of the chunks that hold a lexeme for which the condition is true."""
        return self.places(lexeme).join(self.chunks.select("segment", "row", "chunk_id"), ["segment", "row"]).drop("row")

    def places(self, lexeme: Column) -> DataFrame:
        """As ``entries``, with the row in place of the chunk_id."""
        found = self.postings.where(lexeme).select("segment", "lexeme", "tile", F.inline("entries"))
        return self.live(found.select("segment", row_of(), "lexeme", "tf", "dl", "positions"))

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` (segment, row) with their chunk_id and what was carried in place of both."""
        return self.chunks.drop("words", "dl").join(rows, ["segment", "row"]).drop("segment", "row")


def row_of() -> Column:
    """A chunk's row number by its tile and its place there."""
    return (F.col("tile") * TILE + F.col("slot")).alias("row")


def _folded(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The posting blocks, sorted by lexeme and tile, of whole tiles' chunks (row, dl, words), which come in order."""
    row, dl, words = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False), rows.column(2)
    flat, lengths = words.flatten().dictionary_encode(), np.diff(words.offsets.to_numpy())
    order = pc.sort_indices(flat.dictionary)
    spelt, sorted_code = flat.dictionary.take(order), np.empty(len(order), np.int64)
    sorted_code[order.to_numpy()] = np.arange(len(order))
    at = np.repeat(np.arange(len(row), dtype=np.int32), lengths)
    place = (np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)
    code = sorted_code[flat.indices.to_numpy(zero_copy_only=False)]
    tile = row // TILE
    nth = np.cumsum(np.diff(tile, prepend=tile[0]) != 0)
    key = code * (nth[-1] + 1) + nth[at]
    some = np.flatnonzero(code != (0 if len(spelt) and spelt[0].as_py() == "" else -1))
    some = some[np.argsort(key[some], kind="stable")]  # words come in order of row and place, which holds within a key
    key, at, place, code = key[some], at[some], place[some], code[some]
    new = np.diff(key, prepend=-1) != 0
    block_at, entry_at = np.flatnonzero(new), np.flatnonzero(new | (np.diff(at, prepend=-1) != 0))
    first = np.searchsorted(entry_at, block_at)
    tf, of = np.diff(np.append(entry_at, len(key))).astype(np.int32), dl[at[entry_at]].astype(np.int32)
    most, least = (f.reduceat(x, first) if len(first) else x[:0] for f, x in ((np.maximum, tf), (np.minimum, of)))
    places = pa.ListArray.from_arrays(pa.array(np.append(entry_at, len(key)), pa.int32()), pa.array(place, pa.int32()))
    entries = pa.StructArray.from_arrays([pa.array(row[at[entry_at]] % TILE, pa.int8()), pa.array(tf), pa.array(of), places], names=["slot", "tf", "dl", "positions"])
    columns = [spelt.take(pa.array(code[block_at])), pa.array(tile[at[block_at]], pa.int64()), pa.array(np.diff(np.append(first, len(entry_at))), pa.int32()), pa.array(most), pa.array(least), pa.ListArray.from_arrays(pa.array(np.append(first, len(entry_at)), pa.int32()), entries)]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "tile", "n", "most", "least", "entries"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting blocks of chunks (row, dl, words) that come in order, in sorted runs: a run ends with a tile, and the last tile of a batch, which may go on, is folded with the next rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy(zero_copy_only=False) // TILE
        last = int(np.flatnonzero(np.append(True, tile != tile[-1]))[-1])  # where the run of the last tile begins
        size += len(batch.column(2).flatten())
        held.append(batch)
        if size >= RUN and (last or len(held) > 1 and held[-2].column(0)[-1].as_py() // TILE != tile[0]):
            whole = held[:-1] + ([batch.slice(0, last)] if last else [])
            yield from _in_parts(_folded(pa.concat_batches(whole)))
            held = [batch.slice(last)]
            size = len(held[0].column(2).flatten())
    if held:
        yield from _in_parts(_folded(pa.concat_batches(held)))


def _in_parts(rows: pa.RecordBatch, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A run's blocks, so many at a time, as one batch is held whole on both sides."""
    return (rows.slice(i, size) for i in range(0, rows.num_rows, size))


def _totals(dead: DataFrame) -> tuple[int, int]:
    return tuple(dead.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())


def _write_postings(stored: DataFrame, path: str) -> None:
    """The posting blocks of stored chunks (row, dl, words)."""
    # A file is read by one or more tasks, each of which sees its tiles in order; a tile that two tasks share makes two blocks of a lexeme, which are as good as one.
    # Blocks stay with their chunks and are sorted run by run where they are made: nothing is shuffled, and no sort of them spills.
    blocks = stored.select("row", "dl", "words").mapInArrow(_blocks, _POSTINGS)
    blocks.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", str(PAGE)).parquet(path)


def _write_segment(rows: DataFrame, path: str) -> tuple[int, int]:
    """A segment of ``rows`` (chunk_id, words and what is carried), which stay where they are; how many chunks and words it has. Only section keys are shuffled."""
    spark = rows.sparkSession
    placed = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dl", F.size("words"))
    placed.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    _write_postings(stored, f"{path}/postings")
    section_keys(stored.drop("words")).repartitionByRange("ref").sortWithinPartitions("ref").write.mode("overwrite").parquet(f"{path}/keys")
    return tuple(stored.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())


def section_keys(chunks: DataFrame) -> DataFrame:
    """ref (lower case) and the columns of ``chunks``, a row for each different section_ref and subsection_ref of a chunk."""
    refs = [F.lower(c) for c in ("section_ref", "subsection_ref") if c in chunks.columns]
    both = F.array_distinct(F.filter(F.array(*refs), lambda r: r != "")) if refs else F.array().cast("array<string>")
    return chunks.select(F.explode(both).alias("ref"), *chunks.columns)


def _words(chunks: DataFrame, english: bool, carry: tuple[str, ...]) -> DataFrame:
    kept = dict.fromkeys(c for c in ("document_id", "chunk_index", "section_ref", "subsection_ref", *carry) if c in chunks.columns)
    order = [c for c in ("document_id", "chunk_index", "chunk_id") if c in chunks.columns]
    return chunks.sortWithinPartitions(*order).select("chunk_id", *kept, lexemes(F.coalesce("content", F.lit("")), english).alias("words"))


def _last(spark: SparkSession, path: str) -> dict | None:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits").agg(F.max_by(F.struct("*"), "number").alias("c")).first()["c"]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _commit(spark: SparkSession, path: str, number: int, segments: list[int], english: bool, batch: int | None, sizes: tuple[int, int]) -> None:
    spark.createDataFrame([(number, segments, english, batch, *sizes)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def write_index(chunks: DataFrame, path: str, english: bool = False, carry: tuple[str, ...] = ()) -> Index:
    """Index ``chunks`` (chunk_id, content and maybe document_id, chunk_index, section_ref, subsection_ref and ``carry``) anew, in place of what the index held. A word counts in dl though it is a stop word."""
    spark, last = chunks.sparkSession, _last(chunks.sparkSession, path)
    number = last["number"] + 1 if last else 1
    sizes = _write_segment(_words(chunks, english, carry), f"{path}/v{number}/s{number}")
    _commit(spark, path, number, [number], english, last["batch"] if last else None, sizes)
    return read_index(spark, path)


def write_fields(chunks: DataFrame, fields: dict[str, Column], path: str) -> dict[str, Index]:
    """An index for each of several texts of ``chunks`` (chunk_id and what the texts are made of), by their names. They number chunks alike, so that their scores are compared without ids, and take no updates."""
    spark, found = chunks.sparkSession, {}
    words = (lexemes(F.coalesce(text, F.lit(""))).alias(f"words_{i}") for i, text in enumerate(fields.values()))
    chunks.select("chunk_id", *words).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    read = spark.read.parquet(f"{path}/chunks")
    for i, name in enumerate(fields):
        stored = read.select("chunk_id", "row", F.col(f"words_{i}").alias("words"), F.size(f"words_{i}").alias("dl"))
        _write_postings(stored, f"{path}/postings_{i}")
        n, total = stored.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        segment = F.lit(1).alias("segment")
        keys = stored.where("false").select(F.lit("").alias("ref"), "chunk_id", segment)
        found[name] = Index(stored.select("*", segment), spark.read.parquet(f"{path}/postings_{i}").select("*", segment), keys, None, False, n, total, path)
    return found


def index(chunks: DataFrame, english: bool = False, carry: tuple[str, ...] = ()) -> Index:
    """The index of ``chunks`` in a new folder of the shared one."""
    return write_index(chunks, new_folder(chunks.sparkSession, "index"), english, carry)


def read_index(spark: SparkSession, path: str) -> Index:
    """The index as it was last committed."""
    last = _last(spark, path)
    if last is None:
        raise ValueError(f"there is no index in {path}")
    number, made = last["number"], last["segments"]
    read = lambda part: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(f"{path}/v{s}/s{s}/{part}").withColumn("segment", F.lit(s)) for s in made))
    dead = spark.read.parquet(f"{path}/v{number}/dead") if len(made) > 1 else None
    return Index(read("chunks"), read("postings"), read("keys"), dead, last["english"], last["n"], last["words"], f"{path}/v{number}")


def update(spark: SparkSession, path: str, chunks: DataFrame, deleted: DataFrame | None = None, batch: int | None = None, carry: tuple[str, ...] = (), merge_at: int = SEGMENTS) -> Index:
    """Index the documents of ``chunks`` in place of what the index has of them, and drop those of ``deleted`` (document_id).

    A document is deleted by a row in ``deleted`` or replaced whole by its rows in ``chunks``; one in both is replaced. ``batch`` is the number of a stream's micro-batch: one that was committed
    before changes nothing, so a batch that is repeated after a failure counts once. The index goes on carrying what it carries; ``carry`` is for one that is yet to be made. From ``merge_at``
    segments on all are merged.
    """
    last = _last(spark, path)
    if last is None:
        return write_index(chunks, path, carry=carry) if batch is None else _first(chunks, path, batch, carry)
    if batch is not None and last["batch"] is not None and batch <= last["batch"]:
        return read_index(spark, path)
    old, number = read_index(spark, path), last["number"] + 1
    folder = f"{path}/v{number}"
    n, words = _write_segment(_words(chunks, last["english"], tuple(old.chunks.drop("chunk_id", "segment", "row", "dl", "words").columns)), f"{folder}/s{number}")
    gone = spark.read.parquet(f"{folder}/s{number}/chunks").select("document_id")
    gone = (gone if deleted is None else gone.unionByName(deleted.select("document_id"))).distinct()
    # Chunks' ids and numbers are joined, never their words: document frequencies are lowered by the places in the blocks that are read.
    dead = old.live(old.chunks.select("document_id", "segment", "row", "dl")).join(gone, "document_id", "left_semi")
    dead = dead.select("segment", F.expr(f"row div {TILE}").alias("tile"), F.expr(f"shiftleft(1L, cast(row % {TILE} AS int))").alias("slots"), F.lit(1).cast("long").alias("n"), F.col("dl").cast("long").alias("words"))
    dead = dead if old.dead is None else old.dead.unionByName(dead)
    dead.groupBy("segment", "tile").agg(F.bit_or("slots").alias("slots"), F.sum("n").alias("n"), F.sum("words").alias("words")).write.mode("overwrite").parquet(f"{folder}/dead")
    lost, lost_words = _totals(spark.read.parquet(f"{folder}/dead"))
    before, words_before = (0, 0) if old.dead is None else _totals(old.dead)
    sizes = (last["n"] + n - (lost - before), last["words"] + words - (lost_words - words_before))
    _commit(spark, path, number, [*last["segments"], number], last["english"], last["batch"] if batch is None else batch, sizes)
    return merge(spark, path) if len(last["segments"]) + 1 >= merge_at else read_index(spark, path)


def _first(chunks: DataFrame, path: str, batch: int, carry: tuple[str, ...]) -> Index:
    sizes = _write_segment(_words(chunks, False, carry), f"{path}/v1/s1")
    _commit(chunks.sparkSession, path, 1, [1], False, batch, sizes)
    return read_index(chunks.sparkSession, path)


def merge(spark: SparkSession, path: str) -> Index:
    """One segment of all chunks that hold. Older segments' files stay for those who read them."""
    last, old = _last(spark, path), read_index(spark, path)
    number = last["number"] + 1
    rows = old.live(old.chunks).drop("segment", "row", "dl")
    sizes = _write_segment(rows, f"{path}/v{number}/s{number}")
    _commit(spark, path, number, [number], last["english"], last["batch"], sizes)
    return read_index(spark, path)


def document_frequencies(made: Index, terms: DataFrame, among: Column) -> DataFrame:
    """lexeme and df (chunks that hold it) of the lexemes of ``terms`` that occur; ``among`` is a condition on lexeme that the scans can use. Blocks' counts are summed, and lowered by the entries that no longer hold."""
    counts = made.postings.where(among)
    if made.dead is None:
        counts = counts.select("lexeme", F.col("n").cast("long").alias("n"))
    else:
        places = counts.select("lexeme", "segment", "tile", "n", F.col("entries.slot").alias("places"))
        lost = F.size(F.filter("places", lambda p: F.getbit("slots", p.cast("int")) == 1))
        counts = places.join(made.dead.select("segment", "tile", "slots"), ["segment", "tile"], "left").select("lexeme", (F.col("n") - F.when(F.col("slots").isNull(), 0).otherwise(lost)).cast("long").alias("n"))
    return counts.join(terms.select("lexeme"), "lexeme", "left_semi").groupBy("lexeme").agg(F.sum("n").alias("df")).where("df > 0")
