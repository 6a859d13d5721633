"""Token-id output: documents keyed by identifier in sorted-string-table shards.

Texts are dealt by ranges of doc_id, sorted within a task, encoded and written as files of the format in
``sstable`` to a folder that all machines share; nothing passes through the driver but one row for a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.llm import sstable
from brightloom.llm.shared import materialize, new_path
from brightloom.llm.token_ids import encoder

#: Bytes of blocks after which a task starts its next file.
SHARD_BYTES = 32 << 20
#: Shards that a task reads, about.
RUN = 8


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, made: str, name: str, size: int) -> None:
    """Give a finished file its name. Where a lost attempt has done so before and the file system does not replace, that file, of the same bytes, stays."""
    try:
        fs.move(made, name)
    except OSError:
        known = fs.get_file_info(name)
        if known.type != pafs.FileType.File or known.size != size:
            raise
        fs.delete_file(made)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, blanks: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards in ascending doc_id order; returns one row for each shard.

    A null text counts as empty (the end id alone). Null ids come first, rows of one id stand side by side in the order of their texts' hashes; every
    row is written. An empty table makes no shard. A file is written under a name of the task's attempt, then renamed;
    a repeated task makes the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, (fs, root) = encoder(tokenizer, blanks, end_id), filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        made: list[dict] = []
        out = sstable.Writer(code.width)

        def close() -> None:
            nonlocal out
            name, data = f"part-{part:06d}-{len(made):05d}.sst", out.done()
            with fs.open_output_stream(f"{root}/.{name}.{attempt}") as f:
                f.write(data)
            publish(fs, f"{root}/.{name}.{attempt}", f"{root}/{name}", len(data))
            made.append({"part": part, "shard": len(made), "path": f"{folder}/{name}", "entries": out.n, "ids": out.ids, "bytes": len(data)})
            out = sstable.Writer(code.width)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), code.encode_all(batch.column(1)), strict=True):
                out.add(sstable.key_of(doc_id), coded)
                if out.size >= shard_bytes:
                    close()
        if out.n:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    # Equal ids, too, are dealt to several tasks and have one order: by a hash of the text, then the text.
    order = (F.col("doc_id").asc_nulls_first(), F.col("hash"))
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash")).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("hash")
    return materialize(dealt.mapInArrow(write, "part long, shard long, path string, entries long, ids long, bytes long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), ids (array), whole and in order."""
    return _scan(shards, True)


def digest_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    return _scan(shards, False)


def _scan(shards: DataFrame, whole: bool) -> DataFrame:
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    count = shards.count()
    # A task reads a run of shards, but no core is left without one.
    n = max(1, min(count, max(shards.sparkSession.sparkContext.defaultParallelism, -(-count // RUN))))
    placed = shards.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")).repartition(n)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), *([("ids", pa.list_(pa.int64()))] if whole else [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    got, start = sstable.Reader(f.read_at, f.size()), row["start"]
                    rows: list[tuple] = []
                    for key, value in got.scan():
                        ids = np.frombuffer(value, f"<u{got.width}")
                        rows.append((sstable.id_of(key), start, *((ids,) if whole else (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return placed.mapInArrow(read, "doc_id long, start long, " + ("ids array<long>" if whole else "n_tokens long, ids_crc32 long"))


def lookup(path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row with ``doc_id`` in one shard file, by Bloom filter and binary search."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        got = sstable.Reader(f.read_at, f.size())
        return [np.frombuffer(v, f"<u{got.width}") for v in got.get(sstable.key_of(doc_id))]


def token_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the shards to a new folder of the shared one and return the digest of what is read back."""
    return digest_shards(write_shards(docs, new_path(spark, "tokens"), tokenizer, end_id))
