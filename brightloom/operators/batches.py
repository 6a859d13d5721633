"""What a scan for a batch of queries decides and keeps: filters by the few combinations of metadata that chunks have, and the best of each query so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from brightloom.operators.held import BROADCAST_ROWS

#: Decisions (a filter and a combination of metadata) that a task holds, at most, and scores (a query and a row) that it makes at once.
DECISIONS, CELLS = 1 << 24, 1 << 21


class Allowed:
    """Which queries of a batch may find rows of which metadata. ``fits``: a row for each different filter, a column for each combination of ``columns``; the last column, of no combination, is false."""

    def __init__(self, columns: list[str], combinations: DataFrame, kinds: dict, fits: np.ndarray):
        self.columns, self.combinations, self.kinds, self.fits = columns, combinations, kinds, fits

    def numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of their combination as _class in place of its columns; -1 where it is unknown."""
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.columns))
        found = rows.join(F.broadcast(self.combinations), same, "left")  # counted
        return found.select(*(c for c in rows.columns if c not in self.columns), F.coalesce("_class", F.lit(-1)).alias("_class"))

    def of(self, given: list) -> np.ndarray:
        """For each of ``given`` queries the number of its filter."""
        return np.array([self.kinds[r["query_id"]] for r in given], int)


def allowed(rows: DataFrame, columns: list[str], asked: DataFrame, fits: Callable[[Callable[[str], Column]], Column]) -> Allowed | None:
    """The filters of a stored batch (query_id and what a filter is made of) for all ``columns`` that ``rows`` have; None where a task could not hold them. ``fits`` makes a condition of a function that gives a query's column by name."""
    spark, others = rows.sparkSession, [c for c in asked.columns if c != "query_id"]
    given = asked.collect()  # at most as many as a batch may have
    filters = [tuple(repr(r[c]) for c in others) for r in given]
    kinds = {f: i for i, f in enumerate(dict.fromkeys(filters))}
    found = rows.select(*columns).distinct().limit(BROADCAST_ROWS + 1).collect()
    if len(found) > BROADCAST_ROWS or len(found) * len(kinds) > DECISIONS:
        return None
    shape = StructType([StructField("_class", IntegerType()), *(StructField(f"_{c}", rows.schema[c].dataType) for c in columns)])
    combinations = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], shape)
    out = np.zeros((len(kinds), len(found) + 1), bool)
    if kinds and found:
        example = {f: r for f, r in zip(reversed(filters), reversed(given), strict=True)}
        kind = StructType([asked.schema[c] for c in others])
        one = spark.createDataFrame([([tuple(example[f][c] for c in others) for f in kinds],)], StructType([StructField("_filters", ArrayType(kind))]))
        numbered = F.filter(F.transform("_filters", lambda f, i: F.when(fits(lambda c: f[c]), i)), lambda i: i.isNotNull())
        named = combinations.select("_class", *(F.col(f"_{c}").alias(c) for c in columns))
        for r in named.crossJoin(F.broadcast(one)).select("_class", numbered.alias("kinds")).collect():  # one row to each combination
            out[r["kinds"], r["_class"]] = True
    return Allowed(columns, combinations, {r["query_id"]: kinds[f] for r, f in zip(given, filters, strict=True)}, out)


class Best:
    """The rows that reach each query's k-th score so far. Rows that tie there all stay or, with ``by_id`` (then the first key is the id), those with the smaller ids."""

    def __init__(self, queries: int, k: int, by_id: bool = False):
        self.k, self.by_id, self.floor = k, by_id, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.limit = 0, max(1 << 16, 4 * queries * k)

    def add(self, q: np.ndarray, score: np.ndarray, *keys: np.ndarray) -> None:
        if len(q):
            self.parts.append((q, score, *keys))
            self.size += len(q)
            if self.size > self.limit:
                self.cut()
                self.limit = max(self.limit, 2 * self.size)

    def cut(self) -> tuple[np.ndarray, ...]:
        """What is left: q, score and the keys."""
        if not self.parts:
            return ()
        all_of = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        order = np.lexsort((-all_of[1], all_of[0]))
        all_of = [x[order] for x in all_of]
        q, score = all_of[:2]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        counts = np.diff(np.append(first, len(q)))
        full = counts >= self.k
        self.floor[q[first[full]]] = score[first[full] + self.k - 1]
        keep = score >= self.floor[q]
        if self.by_id:
            tied = keep & (score == self.floor[q])
            for i in np.flatnonzero(full):  # of those at the k-th score as many stay as the better ones leave room for
                a, b = first[i], first[i] + counts[i]
                at = a + np.flatnonzero(tied[a:b])
                room = self.k - int(keep[a:b].sum() - len(at))
                if len(at) > room:
                    keep[sorted(at, key=lambda j: all_of[2][j])[room:]] = False
        all_of = [x[keep] for x in all_of]
        self.parts, self.size = [tuple(all_of)], len(all_of[0])
        return self.parts[0]


def in_parts(rows: pa.RecordBatch, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows, so many at a time, as one batch is held whole on both sides."""
    return (rows.slice(i, size) for i in range(0, rows.num_rows, size))
