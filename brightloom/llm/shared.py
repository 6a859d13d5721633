"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: What this Python worker keeps for tasks that follow.
_KEPT: dict[Hashable, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a ``local`` master, as in tests, may do without it and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="brightloom-"))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/brightloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint the files outlive a lost executor, and what follows (row ids, ranks)
    sees one fixed set of rows. The files stay until the shared folder is cleaned.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: both are sorted, none is sent to the driver, however small Spark takes it to be (it does not count what an explode adds)."""
    return left.join(right.hint("merge"), on, how)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, made once for a Python worker, so that tasks which follow find it; ``forget`` lets go of it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Free what a Python worker keeps for other work than its task's, and what Arrow holds unused: workers outlive their stages."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents (doc_id, text, label) for fitting a classifier, one for each id.

    Rows whose label is null or not 0/1, or whose id or text is null, are left out; where an id has several
    labels the largest holds, where it has several texts the one with the smallest hash. The ids with the smallest hashes
    are taken, so that the sample is the same on every run; ``limit`` bounds what is broadcast here and what the caller may collect.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("one")
    return found.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.label")
