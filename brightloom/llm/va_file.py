"""Exact top-k by a vector-approximation file.

Each component of the integer vectors is kept as the number of its cell, a byte. Cells are cut at quantiles of a bounded sample; the first and
the last reach to the vector's own least and largest component, which are kept with it. The file of cells is scanned alone and bounds every row's inner product from
both sides; rows are then read exactly in the order of their bounds, best first, until the k-th best exact score is certain to be above
all that is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.shared import materialize
from brightloom.llm.vectors import BATCH, matrix, search, top, usable

CELLS, SCALE, TOP, EVERY = 256, 256, 5, 50
#: Rows that the cells' marks are taken from, at most; any marks give right results.
SAMPLE = 4096
#: Exact vectors read at a time.
READ = 64
_LONG = np.iinfo(np.int64)
#: Scores are held within a long, and so are their bounds.
_HELD = (-(2.0**63), 2.0**63)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and embedding as floor(256 * x) of every usable row; zero vectors take part. What exceeds a long is held at its end."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return usable(vectors, zero=True).select("vec_id", "dim", scaled.alias("embedding"))


def marks(rows: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Where cells end, from quantiles of the components of at most ``SAMPLE`` rows with the smallest hashes: cell i holds the integers from mark i - 1 to below mark i."""
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE).select(F.explode("embedding").alias("x"))
    found = sample.agg(F.percentile_approx("x", F.array(*(F.lit(i / cells) for i in range(1, cells))), 10_000)).first()[0]
    return np.unique(np.array(found or [0], np.int64))


def approximate(rows: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of integer vectors, and each vector's least and largest component, to which its first and last cell reach."""
    return np.searchsorted(marks, rows, side="right").astype(np.uint8), rows.min(1), rows.max(1)


def bounds(queries: np.ndarray, cells: np.ndarray, least: np.ndarray, largest: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper bounds of inner products with all vectors of the cells; what rounding may take is added."""
    ends = marks.astype(float)
    low, high = np.concatenate([[-np.inf], ends])[cells], np.concatenate([ends - 1, [np.inf]])[cells]
    low, high = np.maximum(low, least[:, None].astype(float)), np.minimum(high, largest[:, None].astype(float))
    middle, half = (low + high) / 2, (high - low) / 2
    sizes = (cells.shape[1] + 8) * 2.0**-51 * np.linalg.norm(np.abs(middle) + half, axis=1)
    for at in range(0, len(queries), BATCH):
        some = queries[at : at + BATCH]
        centre, away = some @ middle.T, np.abs(some) @ half.T + np.linalg.norm(some, axis=1)[:, None] * sizes
        yield np.clip(centre - away, *_HELD), np.clip(centre + away, *_HELD)


def reader(vectors: np.ndarray, k: int = TOP) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from a query, places and their upper bounds to the k best places, read in the order of the bounds.

    Where sums may exceed a long they are made of whole Python numbers and held at its ends.
    """
    largest = float(np.abs(vectors.astype(float)).max()) * vectors.shape[1]

    def best(query: np.ndarray, places: np.ndarray, ups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((places, -ups))
        safe = largest * float(np.abs(query.astype(float)).max()) < 2.0**62
        seen, scores = places[:0], np.zeros(0, np.int64)
        for at in range(0, len(order), READ):
            some = order[at : at + READ]
            if len(scores) >= k and ups[some[0]] < scores[-1]:
                break
            near = places[some]
            exact = vectors[near] @ query if safe else np.array([min(max(s, _LONG.min), _LONG.max) for s in vectors[near].astype(object) @ query.astype(object)], np.int64)
            seen, scores = np.concatenate([seen, near]), np.concatenate([scores, exact])
            keep = np.lexsort((seen, ~scores))[:k]  # ~ turns the order without overflow
            seen, scores = seen[keep], scores[keep]
        return seen, scores

    return best


def exact_neighbours(vectors: DataFrame, k: int = TOP, every: int = EVERY, **blocks: int) -> DataFrame:
    """query_id, rank, vec_id and score (integer inner product) of the k best rows for every row whose id ``every`` divides; scores beyond a long are held at its ends.

    Rows of one id don't meet each other; each is a query and a candidate of its own. Null, empty and non-finite vectors and null ids take no part, other columns are ignored, and an empty
    table gives an empty one.
    """
    rows = integers(vectors)
    ends = marks(rows)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in batch.groupby("dim"):
                cells, least, largest = approximate(matrix(some["embedding"], np.int64), ends)
                yield some.assign(list=0, cells=[c.tobytes() for c in cells], least=least, largest=largest)[["row_id", "vec_id", "dim", "list", "cells", "least", "largest", "embedding"]]

    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    index = materialize(numbered.mapInPandas(code, "row_id long, vec_id long, dim int, list int, cells binary, least long, largest long, embedding array<long>"), "va-file")
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).select("row_id", "vec_id", "dim", F.array(F.lit(0)).alias("lists"), "embedding")

    def bound(asked: np.ndarray, r: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return bounds(asked, np.frombuffer(b"".join(r["cells"]), np.uint8).reshape(len(r), -1), r["least"].to_numpy(), r["largest"].to_numpy(), ends)

    return search(index, queries, k, ["cells", "least", "largest"], bound, lambda v: reader(v, k), "long", **blocks)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
