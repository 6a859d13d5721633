"""Vector retrieval: cosine search with filters, exact or over stored codes of a byte a component, and the similarity cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from brightloom.functions.vectors import dot, norm, unit
from brightloom.operators.batches import CELLS, Allowed, Best, in_parts
from brightloom.operators.held import batch, bounded
from brightloom.operators.lexical import top_k

#: Largest code of a component, and what single precision may add to a bound.
LARGEST, SLACK = 127, 1e-5


def vector_search(vectors: DataFrame, queries: DataFrame, k: int | None = 30, threshold: float = 0.0, keep: Column | None = None, pair: Column | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of each query's k nearest by cosine; ties to the smaller chunk_id.

    Filters act before any similarity is computed. Vectors of a query's dimension only are compared; null ones never. One scan serves the
    whole batch of queries, which must be small (it is checked); each task keeps its k best of every query before the shuffle. ``pair`` is a
    condition over the columns of vectors and queries, for filters that differ by query. ``k`` None keeps all that reach the threshold.
    """
    rows = vectors if keep is None else vectors.where(keep)
    rows = rows.withColumn("size", norm(F.col("embedding"))).where("size > 0")
    asked = queries.withColumnRenamed("embedding", "q").where(norm(F.col("q")) > 0).withColumn("q_size", norm(F.col("q")))
    pairs = rows.join(bounded(asked), F.size("embedding") == F.size("q"))
    pairs = pairs if pair is None else pairs.where(pair)
    scores = pairs.select("query_id", "chunk_id", (dot(F.col("embedding"), F.col("q")) / (F.col("size") * F.col("q_size"))).alias("score"))
    return top_k(scores.where(F.col("score") >= threshold), k, "score")


class _Scan:
    """A batch's queries by dimension, with the filter of each, and a block of vectors at a time compared with all of them."""

    def __init__(self, given: list, kinds: np.ndarray, fits: np.ndarray, k: int, threshold: float):
        self.n, self.kinds, self.fits, self.k, self.threshold = len(given), kinds, fits, k, threshold
        asked = [np.array([np.nan if x is None else x for x in r["embedding"]], float) for r in given]
        self.of = {d: np.array([i for i, q in enumerate(asked) if len(q) == d]) for d in {len(q) for q in asked}}
        self.q = {d: np.array([asked[i] for i in at]) for d, at in self.of.items()}

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """q, chunk_id and score of each query's k best in this task, of vectors (chunk_id, embedding, _class)."""
        best, kind = Best(self.n, self.k, by_id=True), None
        for b in batches:
            kind, lengths = b.schema.field(0).type, b.column(1).value_lengths().fill_null(-1).to_numpy()
            for d, at in self.of.items():
                some = np.flatnonzero(lengths == d)
                for part in np.array_split(some, -(-len(some) * max(d, len(at)) // CELLS)) if len(some) else ():
                    rows = b.take(pa.array(part))
                    x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), d)
                    self._add(best, rows.column(0).to_numpy(zero_copy_only=False), x, rows.column(2).to_numpy(), self.q[d], at)
        if found := best.cut():
            q, score, ids = found
            yield from in_parts(pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, kind), pa.array(score)], names=["q", "chunk_id", "score"]))

    def _add(self, best: Best, ids: np.ndarray, x: np.ndarray, classes: np.ndarray, asked: np.ndarray, at: np.ndarray) -> None:
        size, q_size = _length(x), _length(asked)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            near = (x @ asked.T) / (size[:, None] * q_size)  # summed in another order than exact scores, so with some slack
            row, j = np.nonzero((near >= np.maximum(best.floor[at], self.threshold) - 1e-9) & (size > 0)[:, None] & (q_size > 0) & self.fits[:, classes][self.kinds[at]].T)
            for a in range(0, len(row), CELLS):
                r, c = row[a : a + CELLS], j[a : a + CELLS]
                score = _summed(x, asked, r, c) / (size[r] * q_size[c])
                some = score >= np.maximum(best.floor[at[c]], self.threshold)
                best.add(at[c][some], score[some], ids[r[some]])


def _summed(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of x and j of y, added up one component after the other as ``dot`` does, so that both give the same bits."""
    total = np.zeros(len(i))
    for d in range(x.shape[1]):
        total += x[i, d] * y[j, d]
    return total


def _length(x: np.ndarray) -> np.ndarray:
    every = np.arange(len(x))
    return np.sqrt(_summed(x, x, every, every))


def scan_search(vectors: DataFrame, queries: DataFrame, filters: Allowed, k: int = 30, threshold: float = 0.0) -> DataFrame:
    """As ``vector_search`` with a filter for each query, for vectors (chunk_id, embedding and the metadata that ``filters`` decides on) that are not stored: a task compares a block with all queries at once and gives back its k best of each."""
    spark, asked = queries.sparkSession, batch(queries.select("query_id", "embedding").where(F.size("embedding") > 0))
    given = asked.collect()  # at most as many as a batch may have
    scan = _Scan(given, filters.of(given), filters.fits, k, threshold)
    rows = filters.numbered(vectors.select("chunk_id", "embedding", *filters.columns))
    found = rows.mapInArrow(scan.best, StructType([StructField("q", IntegerType()), vectors.schema["chunk_id"], StructField("score", DoubleType())]))
    numbers = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(given)], StructType([StructField("q", IntegerType()), asked.schema["query_id"]]))
    return top_k(found.join(F.broadcast(numbers), "q").select("query_id", "chunk_id", "score"), k, "score")


def encode(vectors: DataFrame) -> DataFrame:
    """``vectors`` (chunk_id, embedding and others) with dim, and in place of the embedding the direction's codes (a signed byte a component), their scale, and error: how far the codes lie from the direction. Null and zero vectors go."""
    rows = vectors.where(F.size("embedding") > 0).withColumn("_unit", unit(F.transform("embedding", lambda x: x.cast("double")))).where(F.exists("_unit", lambda x: x != 0))
    rows = rows.withColumn("scale", F.array_max(F.transform("_unit", lambda x: F.abs(x))) / LARGEST)
    rows = rows.withColumn("codes", F.transform("_unit", lambda x: F.rint(x / F.col("scale")).cast("tinyint")))
    away = F.zip_with("_unit", "codes", lambda x, c: x - c * F.col("scale"))
    return rows.withColumns({"dim": F.size("embedding"), "error": norm(away)}).drop("_unit", "embedding")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Store codes and vectors, each sorted by chunk_id, so that a search reads all codes and few vectors."""
    vectors.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{path}/vectors")
    encode(vectors.sparkSession.read.parquet(f"{path}/vectors")).write.mode("overwrite").parquet(f"{path}/codes")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """codes and vectors."""
    return spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors").select("chunk_id", "embedding")


class _Asked:
    """A batch's query directions by dimension, with the filter of each and the score below which nothing matters to it."""

    def __init__(self, rows: list, filters: list[tuple]):
        self.ids = [r["query_id"] for r in rows]
        units = [np.array(r["embedding"], float) for r in rows]
        self.of = {d: np.array([i for i, u in enumerate(units) if len(u) == d]) for d in {len(u) for u in units}}
        self.units = {d: np.array([units[i] / np.linalg.norm(units[i]) for i in at], np.float32) for d, at in self.of.items()}
        kinds = {f: i for i, f in enumerate(dict.fromkeys(filters))}
        self.filter = np.array([kinds[f] for f in filters], int)
        self.floors = np.full(len(rows), -np.inf)

    def bounds(self, b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each query that a batch of codes may concern: its number, the rows, and the lower and upper bounds of their cosines."""
        dims, scale, error = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "scale", "error"))
        codes, allowed = b.column("codes"), b.column("allowed") if "allowed" in b.schema.names else None
        for d, asked in self.of.items():
            rows = np.flatnonzero(dims == d)
            if not len(rows):
                continue
            c = codes.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d).astype(np.float32)
            scores, slack = (c @ self.units[d].T) * scale[rows, None], error[rows] + SLACK
            fits = None
            if allowed is not None:
                fits = np.zeros((len(rows), int(self.filter.max()) + 1), bool)
                lists = allowed.take(pa.array(rows))
                fits[np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
            for j, q in enumerate(asked):
                some = np.arange(len(rows)) if fits is None else np.flatnonzero(fits[:, self.filter[q]])
                yield int(q), rows[some], scores[some, j] - slack[some], scores[some, j] + slack[some]


def coded_search(codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 30, threshold: float = 0.0, keep: Column | None = None, fits: Callable[[Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """As ``vector_search``, over what ``write_vectors`` stores: codes bound every cosine from both sides, and only vectors whose upper bound reaches a query's k-th lower bound are read and compared exactly.

    ``keep`` is a condition over the columns of ``codes``; ``fits`` makes one of a function that gives a query's column by name, for filters that differ by query. The batch of queries is bounded (it is
    checked) and every task holds it; a task keeps the k largest lower bounds of each query.
    """
    spark, others = queries.sparkSession, [c for c in queries.columns if c not in ("query_id", "embedding")] if fits else []
    asked = batch(queries.where(norm(F.col("embedding")) > 0).select("query_id", "embedding", *others))
    given = asked.collect()  # at most as many as a batch may have
    filters = [tuple(repr(r[c]) for c in others) for r in given]
    held = _Asked(given, filters)
    rows = (codes if keep is None else codes.where(keep)).where(F.col("dim").isin(*held.of)) if given else codes.where("false")
    if fits and given:
        kinds = {f: r for f, r in zip(reversed(filters), reversed(given), strict=True)}
        kind = StructType([asked.schema[c] for c in others])
        one = spark.createDataFrame([([tuple(kinds[f][c] for c in others) for f in dict.fromkeys(filters)],)], StructType([StructField("_filters", ArrayType(kind))]))
        numbered = F.transform("_filters", lambda f, i: F.when(fits(lambda c: f[c]), i))
        rows = rows.crossJoin(F.broadcast(one)).withColumn("allowed", F.filter(numbered, lambda i: i.isNotNull())).drop("_filters")  # one row
    shown = rows.select("chunk_id", "dim", "scale", "error", "codes", *(["allowed"] if fits and given else []))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.float32)] * len(held.ids)
        for b in batches:
            for q, _, low, _ in held.bounds(b):
                best[q] = np.sort(np.concatenate([best[q], low.astype(np.float32)]))[-k:]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), [len(x) for x in best]), pa.int32()), pa.array(np.concatenate(best or [np.zeros(0)]), pa.float64())], names=["q", "low"])

    ranked = shown.mapInArrow(lowest, "q int, low double").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("n") <= k)
    for r in ranked.where(F.col("n") == k).collect():
        held.floors[r["q"]] = r["low"]
    held.floors = np.maximum(held.floors, threshold) - SLACK
    floors = spark.sparkContext.broadcast(held)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(q, rows[up >= floors.value.floors[q]]) for q, rows, _, up in floors.value.bounds(b)]
            at = np.concatenate([x for _, x in found] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in found], [len(x) for _, x in found]).astype(np.int32), pa.int32()), b.column("chunk_id").take(pa.array(at, pa.int64()))], names=["q", "chunk_id"])

    numbers = spark.createDataFrame([(i, q) for i, q in enumerate(held.ids)], StructType([StructField("q", IntegerType()), asked.schema["query_id"]]))
    left = shown.mapInArrow(survivors, StructType([StructField("q", IntegerType()), codes.schema["chunk_id"]])).join(F.broadcast(numbers), "q").drop("q")
    pairs = vectors.join(left, "chunk_id").join(F.broadcast(asked.select("query_id", F.col("embedding").alias("_q"))), "query_id")
    scores = pairs.select("query_id", "chunk_id", (dot(F.col("embedding"), F.col("_q")) / (norm(F.col("embedding")) * norm(F.col("_q")))).alias("score"))
    return top_k(scores.where(F.col("score") >= threshold), k, "score")


def cache_probe(queries: DataFrame, cache: DataFrame, similarity: float = 0.94, newest: int = 200, now: Column | None = None, ttl: int = 3600) -> DataFrame:
    """query_id, key, result and similarity of the newest of the ``newest`` entries that is near enough and has the same laws.

    Entries older than ``ttl`` seconds at ``now`` (a timestamp) are left out.
    """
    alive = cache if now is None else cache.where(F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(ttl)))
    recent = alive.orderBy(F.desc("cached_at"), "key").limit(newest).select("key", "result", "cached_at", F.col("embedding").alias("e"), norm(F.col("embedding")).alias("e_size"), F.sort_array("law_filter").alias("laws"))
    asked = queries.select("query_id", "embedding", norm(F.col("embedding")).alias("size"), F.sort_array("law_filter").alias("laws"))
    lengths = F.col("size") * F.col("e_size")
    alike = F.when(lengths > 0, dot(F.col("embedding"), F.col("e")) / lengths).otherwise(0.0)
    near = asked.join(F.broadcast(recent), "laws").withColumn("similarity", F.round(alike, 6)).where(F.col("similarity") >= similarity)
    order = Window.partitionBy("query_id").orderBy(F.desc("cached_at"), "key")
    return near.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", "key", "result", "similarity")


def cache_store(cache: DataFrame, entries: DataFrame, keep: int = 400) -> DataFrame:
    """The cache with new entries, of which the newest ``keep`` stay; an entry with a known key replaces it."""
    rows = cache.join(entries, "key", "left_anti").unionByName(entries)
    return rows.orderBy(F.desc("cached_at"), "key").limit(keep)
