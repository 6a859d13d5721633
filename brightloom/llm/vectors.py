"""A stated set of query rows against all rows of a table, in two passes: bounds from stored codes first, exact vectors for what they leave.

Rows lie in lists (one, unless an index makes more), lists in blocks. The first pass brings the codes of one block of the list that a query looks into to one task and
takes of their lower bounds the k-th largest, the query's floor. The second pass goes over all blocks of all lists that may reach the floor: a task has a block's codes and exact
vectors, and computes with the vectors of those rows whose upper bounds reach the floor. What leaves a task are at most k rows for each of its queries, however many rows the bounds leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from brightloom.llm.shared import materialize

#: Components (rows times dimensions) of a block of rows and of a block of queries, about: what one task holds at a time.
BLOCK, QUERY_BLOCK = 1 << 20, 1 << 22
#: Queries that are bounded at a time.
BATCH = 64
_KEYS = ["dim", "list", "block", "query_block"]


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, dim and embedding (as it is) of the rows that take part.

    Rows whose id or embedding is null, or whose embedding is empty or holds a null or non-finite component, take none; nor do zero vectors unless
    ``zero``. Repeated ids are rows of their own.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return kept if zero else kept.where(F.exists("embedding", lambda c: c != 0))


def matrix(column: pd.Series, kind: type = float) -> np.ndarray:
    return np.array(column.tolist(), dtype=kind)


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    codes: list[str],
    bound: Callable[[np.ndarray, pd.DataFrame], Iterator[tuple[np.ndarray, np.ndarray]]],
    exact: Callable[[np.ndarray], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]],
    score: str,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
    wider: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for every row of ``queries``; ties to the smaller vec_id.

    ``index`` (stored: row_id, vec_id, dim, list, embedding and ``codes``); ``queries`` (stored: row_id, vec_id, dim, embedding and lists, those of which the first block makes
    the floor). ``wider`` makes of queries with their floor (null if no block had k rows) all lists that they must look into; without it these are the same.
    ``bound`` yields, for a matrix of queries and the codes of a block, the lower and upper bounds of batches of queries, a row each.
    ``exact`` makes of a block's vectors a function that gives, for a query, the places of the rows that its floor leaves and their upper bounds, the places and
    scores of at most k. A row does not meet queries of its own vec_id, nor vectors of another dimension. Rows and queries are dealt to
    blocks by a hash of their stored row numbers, so a block holds about as much at any size and however often an id repeats.
    """
    kind = index.schema["vec_id"].dataType.simpleString()
    parts = lambda of: F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") / of)).cast("long")
    blocks = materialize(index.groupBy("dim", "list").agg(parts(block).alias("blocks")), "vector-blocks")
    dealt = lambda seed, n: F.pmod(F.xxhash64("row_id", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def together(asked: DataFrame, columns: list[str], first: bool) -> PandasCogroupedOps:
        """A group for each block (only the first of a list, or all) and block of queries that look into the list: the queries, and the block's ``columns``."""
        asked = asked.withColumn("list", F.explode("lists"))
        sizes = asked.groupBy("dim", "list").agg(parts(query_block).alias("query_blocks")).join(blocks, ["dim", "list"])
        rows = index.select("row_id", "vec_id", "dim", "list", *columns).join(sizes, ["dim", "list"]).withColumn("block", dealt(1, "blocks"))
        rows = (rows.where("block = 0") if first else rows).withColumn("query_block", each("query_blocks"))
        asked = asked.join(sizes, ["dim", "list"]).withColumn("query_block", dealt(2, "query_blocks")).withColumn("block", F.lit(0).cast("long") if first else each("blocks"))
        # Both sides come from one stored table; columns of names of their own keep Spark from taking one side's for the other's.
        keyed = lambda t, *names: t.select(*(F.col(c).alias(c) for c in (*names, *_KEYS))).groupBy(*_KEYS)
        return keyed(asked, "row_id", "vec_id", "embedding", "floor").cogroup(keyed(rows, "row_id", "vec_id", *columns))

    def bounded(q: pd.DataFrame, r: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """For each query: its number, the places of the rows of other ids, their upper bounds, and the k-th largest lower one."""
        ids, own, at = r["vec_id"].to_numpy(), q["vec_id"].to_numpy(), 0
        for lows, ups in bound(matrix(q["embedding"]), r):
            for i, (low, up) in enumerate(zip(lows, ups, strict=True), at):
                other = np.flatnonzero(ids != own[i])
                low = low[other]
                yield i, other, up[other], float(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else -np.inf
            at += len(lows)

    def floor(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = [(q["row_id"].iloc[i], low) for i, _, _, low in bounded(q, r) if low > -np.inf] if len(q) and len(r) else []
        return pd.DataFrame(found, columns=["row_id", "floor"])

    def read(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(r):
            r = r.sort_values(["vec_id", "row_id"], ignore_index=True)  # of equal scores the first rows are the smaller ids
            ids, best = r["vec_id"].to_numpy(), exact(np.stack(r["embedding"].to_numpy()))
            numbers, own, vectors, floors = (q[c].to_numpy() for c in ("row_id", "vec_id", "embedding", "floor"))
            for i, places, ups, low in bounded(q, r):
                near = ups >= max(low, floors[i]) if floors[i] == floors[i] else ups >= low
                at, scores = best(vectors[i], places[near], ups[near])
                out.append((np.full(len(at), numbers[i]), np.full(len(at), own[i]), ids[at], scores))
        names = ("row_id", "query_id", "vec_id", "score")
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names})

    unknown = queries.withColumn("floor", F.lit(None).cast("double"))
    floors = together(unknown, codes, True).applyInPandas(floor, "row_id long, floor double").groupBy("row_id").agg(F.max("floor").alias("floor"))
    asked = queries.join(materialize(floors, "vector-floors"), "row_id", "left")  # a number for each query
    asked = asked if wider is None else materialize(wider(asked), "vector-queries")
    scored = together(asked, [*dict.fromkeys([*codes, "embedding"])], False).applyInPandas(read, f"row_id long, query_id {kind}, vec_id {kind}, score {score}")
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest, largest first, ties to the smaller index."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))][:k]
