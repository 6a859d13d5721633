"""Small and middling results that several steps read: stored in the folder that all machines share, and broadcast only once they are counted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries of a batch, at most, and stored rows up to which a table is broadcast.
QUERIES, BROADCAST_ROWS = 4096, 20_000
_LOCAL: dict[str, str] = {}


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``); only a local master may do without the setting and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="brightloom-"))
    return f"{base.rstrip('/')}/brightloom/{tag}-{uuid.uuid4().hex}"


def hold(df: DataFrame, tag: str = "held") -> DataFrame:
    """``df`` written to the shared folder and read from there, so that what made it isn't computed again for every step."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table for a join: broadcast if it has at most ``rows`` rows, which its files' footers tell; else the join shuffles."""
    return F.broadcast(stored) if stored.limit(rows + 1).count() <= rows else stored


def values(stored: DataFrame, column: str, rows: int = BROADCAST_ROWS) -> list | None:
    """The values, one a row, of a column of a stored table of at most ``rows`` rows; None if it has more, and then it should not be broadcast."""
    found = [r[0] for r in stored.select(column).limit(rows + 1).collect()]
    return found if len(found) <= rows else None


def batch(queries: DataFrame, limit: int = QUERIES) -> DataFrame:
    """A batch of queries, stored, after a check that there are at most ``limit``. Only queries are bounded; what they expand to is not."""
    stored = hold(queries, "queries")
    if stored.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} queries in one batch: search in several")
    return stored


def bounded(queries: DataFrame, limit: int = QUERIES) -> DataFrame:
    """A batch of queries for a broadcast."""
    return F.broadcast(batch(queries, limit))
