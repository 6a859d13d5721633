"""Micro-batches that move staged chunks into the index, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brightloom.operators import index
from brightloom.sources.tables import split_vectors


def staged_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 100, archive: str | None = None) -> DataFrame:
    """Staged chunks as files arrive; the oldest files first, so many a batch at most. With ``archive`` the files of batches that are committed are moved there, so that what is staged is what is yet to be indexed."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger)
    return (source.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else source).parquet(path)


def flush(stream: DataFrame, folder: str, quarantine: str, checkpoint: str, dim: int, every: str | None = "30 seconds") -> StreamingQuery:
    """Write each micro-batch to a folder of its own below ``folder``; vectors of another size go to ``quarantine``.

    A batch that is repeated after a failure overwrites its folder, and a chunk staged twice in it counts once, so the sink
    is idempotent; the checkpoint takes the place of claims and locks. ``every`` None takes all there is and stops.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        # Of a chunk staged twice the one that was created first holds.
        first = Window.partitionBy("chunk_id").orderBy("created_at")
        once = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        good, bad = split_vectors(once, dim)
        good.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The index, one row for each chunk: of a chunk flushed twice the latest batch holds."""
    rows = spark.read.parquet(folder)
    newest = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*rows.columns), "batch").alias("x"))
    return newest.select("x.*")


def index_stream(stream: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds", carry: tuple[str, ...] = ()) -> StreamingQuery:
    """Keep the text index in ``path`` up to date with a stream of chunks (as ``index.write_index`` takes them, with a boolean column deleted).

    Each micro-batch is one update: a document is replaced by its chunks, or dropped where a row says deleted. A batch that is repeated after a failure changes nothing, as the index
    knows the last one that it has.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        gone = F.coalesce("deleted", F.lit(False))
        index.update(batch.sparkSession, path, batch.where(~gone).drop("deleted"), batch.where(gone).select("document_id"), batch_id, carry)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counts_by_document(stream: DataFrame) -> DataFrame:
    """Running number of chunks of each document, for update or complete mode."""
    return stream.groupBy("document_id").agg(F.count("*").alias("n"))
