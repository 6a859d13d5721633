"""Writing tables that have no MERGE: upserts, inserts that skip known keys, cascades, and versioned swaps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Buckets of the tables that are kept by document.
BUCKETS = 16


def newest(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: of repeated ones that whose other columns come last in order, so that the same row stays on every run."""
    others = [c for c in rows.columns if c != key and not rows.schema[c].dataType.typeName().startswith("map")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*others) if others else F.col(key)).alias("_row")).select("_row.*")


def upsert(table: DataFrame, rows: DataFrame, key: str, update: list[str]) -> DataFrame:
    """``table`` with new keys added; of known keys only the columns ``update`` change. A key repeated in ``rows`` counts once, as ``newest`` says."""
    new = newest(rows, key)
    changes = new.select(key, *(F.col(c).alias(f"_{c}") for c in update), F.lit(True).alias("_hit"))
    kept = table.join(changes, key, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in update}).select(*table.columns)
    return kept.unionByName(new.join(table.select(key), key, "left_anti").select(*table.columns))


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows to append: those with keys that ``table`` does not have, one of each, as ``newest`` says."""
    return newest(rows, key).join(table.select(key), key, "left_anti")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the documents in ``ids`` (document_id)."""
    return {name: t.join(ids.select("document_id"), "document_id", "left_anti") for name, t in tables.items()}


def split_vectors(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has ``dim`` components, and the rest for a quarantine table."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks by law, Other where there is none, so that a filter on law reads only its folders."""
    chunks.withColumn("law", F.coalesce("law", F.lit("Other"))).write.mode("append").partitionBy("law").parquet(path)


def write_bucketed(rows: DataFrame, name: str, path: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Store ``rows`` as the table ``name`` in ``path``, bucketed by ``key`` and sorted by ``order`` within a bucket, and return it.

    Tables with the same number of buckets join on the key, and one of them is grouped by it, without a shuffle. A bucket is one file, as each is dealt to one task first.
    """
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(*order).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


class VersionedTable:
    """Versions of a table in folders v1, v2, ... of ``path``; the largest number in the append-only table ``versions`` is in use.

    Adding a row there is one atomic commit, so readers see the old version or the new one; the old one's files stay for those who read them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The version in use, 0 if there is none."""
        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/versions").agg(F.max("version")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return 0
            raise

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version()}")

    def swap(self, rows: DataFrame, expected: int, gate: float = 0.99) -> bool:
        """Write a new version; take it into use if it has rows and at least ``gate`` of those expected."""
        n = self.version() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        count = self.spark.read.parquet(f"{self.path}/v{n}").count()
        if not count or count < gate * expected:
            return False
        self.spark.createDataFrame([(n,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return True
