"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's direction is rotated and each component kept as its sign: a code of one bit a dimension. Two scalars
go with it: the vector's length, and the inner product of its rotated direction with the code's. Their
quotient corrects the inner product of code and rotated query to an estimate of the true one, whose error is,
with the confidence that ``EPSILON`` stands for, at most EPSILON * sqrt((1 - c^2) / c^2 / (dim - 1)) * lengths. Estimates come
from the packed bytes alone: for each query a table gives every byte's part of the inner product. Only vectors whose upper bound reaches the
k-th best lower bound are compared exactly.

A dimension's rows are cut into lists of about ``LIST_ROWS`` by the nearest of centroids that a bounded sample gives. Every row is in a list, which knows how far its directions lie from
its centroid and how long its vectors are at most; that bounds what a query may find there. A query's floor comes from the list with the greatest bound and from the nearest one, and it
looks into every list whose bound reaches the floor, so lists cost no recall, whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.shared import materialize
from brightloom.llm.vectors import BATCH, matrix, search, top, usable

EPSILON, SEED, TOP, EVERY = 1.5, 13, 20, 20
#: Rows of a list, about; lists at most; sample rows a list, and components of the sample at most, which bound what the driver holds; rounds of the fit.
LIST_ROWS, LISTS, SAMPLE, SAMPLE_COMPONENTS, ROUNDS = 1 << 16, 1024, 64, 1 << 23, 8
#: Lengths from which on bounds could overflow: such vectors are always read exactly.
_HUGE, _TINY = 1e300, 1e-300
#: For each byte, the signs that its bits stand for, the highest first.
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1).astype(np.float32)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which loses nothing, so that the largest component is between a half and 1; and the exponents."""
    x = np.asarray(x, float)
    exponents = np.frexp(np.abs(x).max(1))[1]
    return np.ldexp(x, -exponents[:, None]), exponents


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths (infinite beyond the range of doubles), however long or short the vectors are."""
    x, exponents = scaled(x)
    lengths = np.linalg.norm(x, axis=1)
    with np.errstate(over="ignore"):
        return x / lengths[:, None], np.ldexp(lengths, exponents)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of rotated directions with their codes' directions."""
    unit, lengths = directions(vectors)
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), lengths, np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def bounds(queries: np.ndarray, codes: np.ndarray, lengths: np.ndarray, kept: np.ndarray, epsilon: float = EPSILON) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper bounds of the inner products of each query's direction with the coded vectors, for a batch of queries at a time."""
    dim, width = queries.shape[1], codes.shape[1]
    turned = np.zeros((len(queries), 8 * width), np.float32)
    turned[:, :dim] = directions(queries)[0] @ rotation(dim)
    held = np.minimum(lengths, _HUGE)
    scale = held / (kept * np.sqrt(dim))
    slack = (epsilon * np.sqrt(np.maximum(0, 1 - kept**2) / kept**2 / max(1, dim - 1)) + 1e-5) * held + _TINY
    slack[lengths > _HUGE] = np.inf
    for at in range(0, len(queries), BATCH):
        tables = turned[at : at + BATCH].reshape(-1, width, 8) @ _SIGNS.T
        estimates = np.zeros((len(tables), len(codes)), np.float32)
        for j in range(width):
            estimates += tables[:, j].take(codes[:, j], axis=1)
        estimates = estimates * scale
        yield estimates - slack, estimates + slack


class Lists:
    """Centroids of the directions of a dimension's vectors; once the lists are made, the radius and the greatest length of each."""

    def __init__(self, sample: np.ndarray, n: int):
        unit = directions(sample)[0]
        self.centroids = unit[np.linspace(0, len(unit) - 1, min(n, len(unit))).astype(int)]
        for _ in range(ROUNDS):
            of = self.nearest(unit)[0]
            sums, counts = np.zeros_like(self.centroids), np.bincount(of, minlength=len(self.centroids))
            np.add.at(sums, of, unit)
            self.centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centroids)
        self.radius, self.longest = np.zeros(len(self.centroids)), np.zeros(len(self.centroids))

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each direction, and how far it lies from the centroid."""
        half, of, away = (self.centroids**2).sum(1) / 2, [np.zeros(0, int)], [np.zeros(0)]
        for some in np.split(unit, range(4096, len(unit), 4096)):
            of.append(np.argmax(some @ self.centroids.T - half, axis=1))
            away.append(np.linalg.norm(some - self.centroids[of[-1]], axis=1))
        return np.concatenate(of), np.concatenate(away)

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """For each query's direction and each list, what no inner product with a vector of the list exceeds."""
        most = unit @ self.centroids.T + self.radius + 1e-9
        with np.errstate(over="ignore", invalid="ignore"):
            return np.where((most > 0) & (self.longest > 0), most * self.longest, 0.0) + _TINY


def fit(rows: DataFrame, list_rows: int = LIST_ROWS) -> dict[int, Lists]:
    """Lists for each dimension of more than ``list_rows`` rows, from the rows with the smallest hashes: at most LISTS * SAMPLE, and SAMPLE_COMPONENTS components."""
    found = {}
    for r in rows.groupBy("dim").count().where(F.col("count") > list_rows).collect():  # dimensions so common are few
        n = min(LISTS, -(-r["count"] // list_rows))
        some = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(max(n, min(n * SAMPLE, SAMPLE_COMPONENTS // r["dim"])))
        found[r["dim"]] = Lists(matrix(some.select("embedding").toPandas()["embedding"]), n)
    return found


def index(vectors: DataFrame, list_rows: int = LIST_ROWS) -> tuple[DataFrame, dict[int, Lists]]:
    """A stored table of row_id, vec_id, dim, list, code, length, kept, away (from the centroid) and embedding of every usable row, and the lists of the dimensions that have more than one."""
    rows = usable(vectors, zero=False)
    lists = fit(rows, list_rows)
    held = vectors.sparkSession.sparkContext.broadcast(lists)  # at most LISTS centroids for a dimension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                x, of = matrix(some["embedding"]), held.value.get(dim)
                codes, lengths, kept = encode(x)
                near, away = of.nearest(directions(x)[0]) if of else (0, 0.0)
                yield some.assign(list=near, code=[c.tobytes() for c in codes], length=lengths, kept=kept, away=away)[["row_id", "vec_id", "dim", "list", "code", "length", "kept", "away", "embedding"]]

    kind = rows.schema["embedding"].dataType.simpleString()
    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    stored = materialize(numbered.mapInPandas(run, f"row_id long, vec_id long, dim int, list int, code binary, length double, kept double, away double, embedding {kind}"), "one-bit-index")
    if lists:
        for r in stored.where(F.col("dim").isin(*lists)).groupBy("dim", "list").agg(F.max("away").alias("radius"), F.max("length").alias("longest")).collect():  # at most LISTS a dimension
            lists[r["dim"]].radius[r["list"]], lists[r["dim"]].longest[r["list"]] = r["radius"], r["longest"]
    return stored, lists


def looking(queries: DataFrame, lists: dict[int, Lists]) -> DataFrame:
    """``queries`` (row_id, vec_id, dim, embedding and maybe floor) with lists: those whose bound reaches the floor; without a floor column that with the greatest bound and the nearest. A dimension that is not cut has list 0."""
    if not lists:
        return queries.withColumn("lists", F.array(F.lit(0)))
    held, floors = queries.sparkSession.sparkContext.broadcast(lists), "floor" in queries.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                of = held.value.get(dim)
                if of is None:
                    yield some.assign(lists=[[0]] * len(some))
                    continue
                unit = directions(matrix(some["embedding"]))[0]
                ups = of.bounds(unit)
                if floors:
                    found = [np.flatnonzero(up >= floor) if floor == floor else np.arange(len(up)) for up, floor in zip(ups, some["floor"].to_numpy(), strict=True)]
                else:
                    found = [np.unique(x) for x in zip(ups.argmax(1), of.nearest(unit)[0], strict=True)]
                yield some.assign(lists=found)

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInPandas(run, f"row_id long, vec_id long, dim int, embedding {kind}, {'floor double, ' if floors else ''}lists array<int>")


def reader(vectors: np.ndarray, k: int = TOP) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from a query and places to the k best of them by inner product, each row by itself, so that equal vectors tie wherever they stand."""
    rows, exponents = scaled(vectors)

    def best(query: np.ndarray, places: np.ndarray, ups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.sort(places)
        q, own = scaled(query[None])
        with np.errstate(over="ignore", under="ignore"):
            scores = np.ldexp((rows[places] * q).sum(1), exponents[places] + own)
        found = top(scores, k)
        return places[found], scores[found]

    return best


def neighbours(vectors: DataFrame, k: int = TOP, every: int = EVERY, epsilon: float = EPSILON, list_rows: int = LIST_ROWS, **blocks: int) -> DataFrame:
    """query_id, rank, vec_id and score (inner product of the original vectors) of the k nearest rows found for every row whose id ``every`` divides.

    Scores beyond the range of doubles are infinite or zero and tie by vec_id; vectors of any finite length take part. Rows of one id don't meet each other; each is a
    query and a candidate of its own. Null, empty, zero and non-finite vectors and null ids take no part, other columns are ignored, and an empty table gives an empty one.
    """

    def bound(queries: np.ndarray, r: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), -1)
        return bounds(queries, codes, r["length"].to_numpy(), r["kept"].to_numpy(), epsilon)

    rows, lists = index(vectors, list_rows)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("row_id", "vec_id", "dim", "embedding")
    wider = (lambda asked: looking(asked.drop("lists"), lists)) if lists else None
    return search(rows, looking(queries, lists), k, ["code", "length", "kept"], bound, lambda v: reader(v, k), "double", wider=wider, **blocks)
