"""Sharding by jump consistent hashing.

The published algorithm (Lamping and Veach, 2014): a key seeds a linear congruential generator, each of whose numbers says at which count of
shards the key jumps next; the last jump before the number of shards names its shard. No ring is kept. With one more shard a key stays or goes to the new one.
All of it, and the numbering within shards, are Spark's own functions. Its 64-bit products are made of two halves and 16-bit factors, as Spark's
longs don't wrap around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.llm.shared import materialize

SHARDS = 24
# Fixed value: the generator's multiplier.
MULTIPLIER = 2862933555777941757
_HALF, _QUARTER = (1 << 32) - 1, (1 << 16) - 1


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32, for x and factor below 2^32."""
    return (x * (factor & _QUARTER) + F.shiftleft((x * (factor >> 16)).bitwiseAND(_QUARTER), 16)).bitwiseAND(_HALF)


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of (high * 2^32 + low) * MULTIPLIER + 1 modulo 2^64."""
    up, down = MULTIPLIER >> 32, MULTIPLIER & _HALF
    upper = low * (down >> 16)
    lower = low * (down & _QUARTER) + F.shiftleft(upper.bitwiseAND(_QUARTER), 16) + 1
    carry = F.shiftright(lower, 32) + F.shiftright(upper, 16)
    return (_times(high, down) + _times(low, up) + carry).bitwiseAND(_HALF), lower.bitwiseAND(_HALF)


def jumps(key: Column, shards: int) -> Column:
    """The shards that a key (long) has been in, first to last, as their number grew from 1 to ``shards``; the last is its shard."""
    high, low = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_HALF))
    # ``at``: where the key is to jump next; a key makes less than ``shards`` jumps, mostly about their logarithm.
    start = F.struct(high.alias("high"), low.alias("low"), F.lit(0).cast("long").alias("at"), F.array().cast("array<int>").alias("seen"))

    def jump(s: Column, _: Column) -> Column:
        up, down = _next(s["high"], s["low"])
        draw = F.shiftright(up, 1) + 1  # the upper 31 bits, from 1
        at = F.floor((s["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long")
        moved = F.struct(up.alias("high"), down.alias("low"), at.alias("at"), F.concat(s["seen"], F.array(s["at"].cast("int"))).alias("seen"))
        return F.when(s["at"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["seen"])


def shard_of(key: Column, shards: int) -> Column:
    """The shard, from 0, of a key among ``shards``."""
    return F.element_at(jumps(key, shards), -1)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every row of ``docs`` (doc_id, text), whatever other columns it has.

    Rows of one id lie in one shard, a null id where 0 does. A null text has no bytes: size 8, crc32 0. Slots follow doc_id (null first), crc32 and size;
    rows equal in all three have slots side by side. An empty table gives an empty one.

    Rows without texts are dealt by ranges of shard and order, numbered in place, and brought to their slot by the counts of shards in
    the ranges before: a shard's rows never meet in one task, and rows that are equal in all are split by row number.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    seen = jumps(F.coalesce("doc_id", F.lit(0).cast("long")), shards + 1)
    rows = rows.select("*", seen.alias("seen")).select("doc_id", "size", "text_crc32", F.element_at("seen", -1).alias("grown_shard"), F.element_at(F.filter("seen", lambda s: s < shards), -1).alias("shard"), F.monotonically_increasing_id().alias("row_id"))
    stored = materialize(rows, "shard-rows")
    order = (F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("row_id"))
    placed = materialize(stored.repartitionByRange(*order).sortWithinPartitions(*order).drop("row_id").withColumn("place", F.monotonically_increasing_id()), "shard-places")
    # The upper bits of a place are its range. A range holds few shards, so there are no more rows here than ranges and shards together.
    ranges = placed.groupBy("shard", F.shiftright("place", 33).alias("range")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("shard", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(ranges), ["shard", "range"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_a_file: int = 1_000_000) -> None:
    """Store ``docs``, all columns, as Parquet in a folder for each shard (shard=0 and so on), in files of about ``rows_a_file`` rows or fewer.

    A shard is dealt to as many tasks as its share of the rows needs, so that it is never one task's.
    """
    n = max(1, -(-docs.count() // (shards * rows_a_file)))
    dealt = docs.withColumn("shard", shard_of(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), shards))
    dealt.repartition(n * shards, "shard", F.pmod(F.monotonically_increasing_id(), F.lit(n))).write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path)


ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(doc_id, 0) AS k, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(text, '') AS text FROM documents
), j(k, state, b, upcoming) AS (
  SELECT k, CAST(k AS HUGEINT) + CASE WHEN k < 0 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END, CAST(-1 AS BIGINT), CAST(0 AS BIGINT)
  FROM (SELECT DISTINCT k FROM t)
  UNION ALL
  SELECT k, moved, upcoming, CAST(floor((upcoming + 1) * (CAST(2147483648 AS DOUBLE) / CAST(moved // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT k, (state * CAST(2862933555777941757 AS HUGEINT) + 1) % CAST(18446744073709551616 AS HUGEINT) AS moved, upcoming FROM j WHERE upcoming < 25)
), s AS (
  SELECT k, CAST(max(b) FILTER (WHERE b < 24) AS INTEGER) AS shard, CAST(max(b) AS INTEGER) AS grown_shard FROM j GROUP BY k
), tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS of
), c AS (
  SELECT text, xor(list_reduce(bytes, lambda c, b: xor(c // 256, of[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM (SELECT text, list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || hexed[2 * i + 1:2 * i + 2] AS BIGINT)) AS bytes FROM (SELECT text, hex(encode(text)) AS hexed FROM (SELECT DISTINCT text FROM t))), tab
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM t JOIN s USING (k) JOIN c USING (text)
"""
