"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

All targets are cut into blocks of ``block`` words. Blocks go one by one to the source with the highest
quotient target / (2 * blocks so far + 1); a source's blocks go to its shards in the same way, by the
shards' sizes. Both are found at once from the quotient at which the blocks run out. A shard's documents stand in a
seeded order; its words form a ring, on which its blocks are the run of that many words from a seeded
place, going round once more where it takes more words than it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.llm.shared import materialize

#: Weights of the sources in order of their names, repeated; and all words that the mix takes as a share of all there are.
WEIGHTS, SHARE, REPEAT = (5, 2, 1), 1.5, 2.0
BLOCK = 16
#: Words of a shard, about, and shards of a source, at most: what one task orders and apportions is bounded.
SHARD_WORDS, SHARDS = 1 << 15, 1 << 14
#: Equal rows that stand in one shard, at most; more are dealt to several.
COPIES = 4096
#: Sources whose totals the driver apportions and whose quotas are broadcast, at most; more are apportioned as a table, with the same results.
SOURCES = 10_000
SEED = 20_240_501


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, repeat: float = REPEAT) -> np.ndarray:
    """share * all sizes by weight, at most ``repeat`` times a source's size; the excess is shared by weight among the rest."""
    goal, want, free = np.zeros(len(sizes)), share * sizes.sum(), np.ones(len(sizes), bool)
    while free.any():
        part = want * weights / weights[free].sum()
        over = free & (part > repeat * sizes)
        if not over.any():
            goal[free] = part[free]
            break
        goal[over] = repeat * sizes[over]
        want -= goal[over].sum()
        free &= ~over
    return goal


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Lague seats by highest quotients votes / (2k + 1), none above ``most``; ties to the earlier party."""
    votes, most = np.asarray(votes, float), np.where(np.asarray(votes) > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))
    given = lambda q: np.minimum(most, np.floor((votes / q + 1) / 2).astype(np.int64))  # noqa: E731  quotients of q and more
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = votes[votes > 0].min() / (2.0 * most.max() + 1), votes.max() * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        if mid in (low, high):
            break
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    got = given(high)
    left = seats - int(got.sum())
    if left:  # quotients between low and high are ties
        quotients = np.where(got < most, votes / (2 * got + 1), -1)
        while left > 0:
            order = np.lexsort((np.arange(len(votes)), -quotients))[:left]
            order = order[quotients[order] > 0]
            got[order] += 1
            left -= len(order)
            quotients = np.where(got < most, votes / (2 * got + 1), -1)
    return got


def words_of(text: Column) -> Column:
    """The number of runs of characters other than blank and U+0009 to U+000D; a null text has 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(t.encode().split()) if t else 0 for t in texts], dtype="int64")

    return count(text)


def keyed(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, source, size (in words), row_id and key (a hash of id, source and text, or of row_id where there is no word to take) of ``docs``, with ``others``."""
    rows = docs.select(*others, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), words_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("source").isNull(), "source", "text").alias("hash"))
    return rows.withColumn("key", F.when(F.col("size") > 0, F.col("hash")).otherwise(F.xxhash64("row_id"))).drop("hash")


def in_runs(sized: DataFrame, most: int = COPIES) -> DataFrame:
    """``sized`` with run: rows of one key are numbered, and each ``most`` of them are a run, from 0.

    They are counted by the part of the table that they were numbered in (the upper bits of row_id), so that no task numbers all of them; which of the equal rows gets which number tells
    nothing. Keys with ``most`` rows or fewer, as nearly all have, are one run.
    """
    part, by_key = F.shiftright("row_id", 33), Window.partitionBy("key")
    counts = sized.groupBy("key", part.alias("part")).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(by_key))
    before = F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    often = materialize(counts.withColumn("before", before).where(F.col("all") > most).select("key", "part", "before"), "mix-copies")
    one = F.lit(0).cast("long")
    if often.isEmpty():
        return sized.withColumn("run", one)
    n = F.col("before") + F.row_number().over(Window.partitionBy("key", "part").orderBy("row_id")) - 1
    copies = sized.withColumn("part", part).join(often, ["key", "part"]).withColumn("run", F.floor(n / most)).drop("part", "before")
    return sized.join(often.select("key").distinct(), "key", "left_anti").withColumn("run", one).unionByName(copies)


def quotas(goal: np.ndarray, most: np.ndarray, block: int, total: float) -> np.ndarray:
    """Words for each party: Sainte-Lague seats of ``block`` words, a party's last one shorter where it would go over ``most`` words."""
    seats = apportion(goal, round(total / block), -(-most // block))
    return np.minimum(seats * block, most).astype(np.int64)


def shard_words(ring: np.ndarray, quota: int, block: int = BLOCK) -> np.ndarray:
    """A source's ``quota`` of words dealt to its shards (their words: ``ring``) in blocks; what shorter last blocks leave over, or a last block has too much, is evened out."""
    most = (REPEAT * ring).astype(np.int64)
    got = quotas(ring, most, block, -(-quota // block) * block)
    for sign, room in ((1, most - got), (-1, got)):
        left, order = max(0, sign * int(quota - got.sum())), np.argsort(-room, kind="stable")
        before = np.cumsum(room[order]) - room[order]
        got[order] += sign * np.clip(left - before, 0, room[order])
    return got


def _taken_before(x: Column) -> Column:
    """Words taken of the ring's first x: whole turns, and the run of ``rest`` words from ``at`` that may wrap around."""
    end = F.col("at") + F.col("rest")
    upto = lambda y: F.greatest(F.lit(0), F.least(x, y) - F.col("at"))
    wrapped = F.least(x, F.greatest(F.lit(0), end - F.col("ring")))
    return x * F.col("turns") + upto(F.least(end, F.col("ring"))) + wrapped


PLAN = "of string, source_size long, target double, quota long, shards long, often boolean"


def planned(spark: SparkSession, totals: list[Row], weights: tuple[int, ...], share: float, block: int) -> DataFrame:
    """The target, quota and number of shards of each source, from a list of their totals (source, s words, n rows)."""
    totals = sorted(totals, key=lambda t: (t.source is None, t.source))
    sizes = np.array([t.s for t in totals], float)
    goal = targets(sizes, np.resize(np.array(weights, float), len(totals)), share)
    block = int(max(1, min([block, *(goal[goal > 0] // block)])))  # so that the smallest source, too, comes near its target
    seats = quotas(goal, np.floor(REPEAT * sizes).astype(np.int64), block, goal.sum())
    shards = [min(SHARDS, max(1, -(-max(t.s, t.n) // SHARD_WORDS))) for t in totals]
    return spark.createDataFrame([(t.source, t.s, float(g), int(q), k, True) for t, g, q, k in zip(totals, goal, seats, shards, strict=True)], PLAN)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with place: their number from 0 in an order without ties. They are sorted by ranges; only the ranges' counts meet in one task."""
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-order")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranges = ranges.select("range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(ranges), "range").withColumn("place", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def planned_table(totals: DataFrame, weights: tuple[int, ...], share: float, block: int, sources: int = SOURCES, ways: int = 32) -> DataFrame:
    """What ``planned`` gives, for sources of any number: the driver sees sums over them alone.

    The share of a weight rises in rounds until no source is above its limit, as in ``targets``; the quotient at which the blocks run out is
    searched for by the sums of seats at ``ways`` quotients a pass; sources that tie for the last blocks get them in their order.
    ``often`` marks sources with more than one in ``sources`` of all rows, so fewer than that.
    """
    ranked = numbered(totals, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "mix-sources")
    words, rows, free = ranked.agg(F.sum("s"), F.sum("n"), F.sum("weight")).first()
    want, held, part = share * words, 0, F.lit(0.0)
    while free:
        part = F.lit(want) * F.col("weight") / F.lit(free)
        over = part > REPEAT * F.col("s")
        now, capped, left = ranked.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("s"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if now == held:
            break
        want, held, free = share * words - REPEAT * capped, now, left
    limit = REPEAT * F.col("s")
    ranked = materialize(ranked.withColumn("goal", F.least(part, limit) if free else limit), "mix-targets")

    smallest = ranked.where("goal > 0").agg(F.min("goal")).first()[0]
    block = int(max(1, min(block, smallest // block))) if smallest is not None else block
    most = F.when(F.col("goal") > 0, F.ceil(F.floor(limit) / block)).otherwise(0)
    given = lambda q: F.least(most, F.floor((F.col("goal") / F.lit(q) + 1) / 2))  # noqa: E731  quotients of q and more
    room, top, full = ranked.agg(F.sum(most), F.max("goal"), F.max(most)).first()
    seats, got = min(round((share * words if free else REPEAT * words) / block), room), F.lit(0)
    if seats > 0:
        low, high = smallest / (2.0 * full + 1), top * 2
        while between := sorted({q for q in np.geomspace(low, high, ways + 2)[1:-1].tolist() if low < q < high}):
            sums = ranked.agg(*(F.sum(given(q)) for q in between)).first()
            low = max([low, *(q for q, n in zip(between, sums, strict=True) if n >= seats)])
            high = min([high, *(q for q, n in zip(between, sums, strict=True) if n < seats)])
            if seats in sums:
                high = low  # no ties: the blocks run out at this quotient
        got = given(high)
        left = seats - ranked.agg(F.sum(got)).first()[0]
        if left:  # quotients between low and high are ties
            quotient = F.col("goal") / (2 * got + 1)
            ties = numbered(ranked.where(given(low) > got).select("place", quotient.alias("quotient")).withColumnRenamed("place", "of"), F.desc("quotient"), F.col("of"))
            last = ties.where(F.col("place") == left - 1).first()
            wins = (given(low) > got) & ((quotient > last["quotient"]) | ((quotient == last["quotient"]) & (F.col("place") <= last["of"])))
            got = got + wins.cast("int")
    shards = F.least(F.lit(SHARDS), F.greatest(F.lit(1), F.ceil(F.greatest("s", "n") / SHARD_WORDS)))
    plan = ranked.select(F.col("source").alias("of"), F.col("s").alias("source_size"), F.col("goal").alias("target"), F.least(got * block, F.floor(limit)).cast("long").alias("quota"), shards.cast("long").alias("shards"), (F.col("n") * sources > rows).alias("often"))
    return materialize(plan, "mix-plan")


def allocate(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = SEED, copies: int = COPIES, sources: int = SOURCES) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target, turns, and up to two runs [lo, hi) of the document's words, with taken, of every row.

    ``sized`` (row_id, key, doc_id, source, size) must be a stored table: it is read more than once. A null source
    is one more source, after all others. A block has ``block`` words, or fewer where the smallest target is under so many blocks. Empty documents take nothing. Documents are drawn by key, a hash of id, source and text, so that the
    mix does not depend on how the table is split; equal rows are told apart by row_id, and where there are over ``copies`` of them they go to several shards.
    With more than ``sources`` sources their quotas are found by sums over a table of them; any number will do.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    few = totals.limit(sources + 1).collect()
    plan = planned(sized.sparkSession, few, weights, share, block) if len(few) <= sources else planned_table(totals, weights, share, block, sources)
    sized = in_runs(sized, copies)
    of_plan = lambda rows, plan: rows.join(plan, rows["source"].eqNullSafe(plan["of"])).drop("of", "often")
    if len(few) <= sources:
        dealt = of_plan(sized, F.broadcast(plan))
    else:  # sources with many rows are few: they go to where the rows are, the others' rows are shuffled
        often = F.broadcast(plan.where("often"))
        dealt = of_plan(sized, often).unionByName(of_plan(sized.join(often, sized["source"].eqNullSafe(often["of"]), "left_anti"), plan.where("NOT often")))
    dealt = dealt.withColumn("draw", F.xxhash64(F.lit(seed), "key")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "key", "run"), F.col("shards")))

    def dealt_out(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        ring = rows["ring"].to_numpy()
        got = shard_words(ring, int(rows["quota"].iloc[0]), block)
        draw = pd.util.hash_array(rows["shard"].to_numpy() + seed).astype(np.uint64)
        return pd.DataFrame({"of": rows["source"], "shard": rows["shard"], "ring": ring, "turns": got // np.maximum(ring, 1), "rest": got % np.maximum(ring, 1), "at": (draw % np.maximum(ring, 1).astype(np.uint64)).astype(np.int64)})

    rings = dealt.groupBy("source", "shard").agg(F.sum("size").alias("ring"), F.first("quota").alias("quota"))
    rings = materialize(rings.groupBy("source").applyInPandas(dealt_out, "of string, shard long, ring long, turns long, rest long, at long"), "mix-shards")  # at most SHARDS rows a group
    before = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("lo", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("in", F.col("shard"))
    placed = placed.drop("shard").join(rings, placed["source"].eqNullSafe(rings["of"]) & (placed["in"] == rings["shard"]))
    end = F.col("at") + F.col("rest")
    clip = lambda lo, hi: F.struct((F.greatest(F.col("lo"), lo) - F.col("lo")).alias("lo"), (F.least(F.col("lo") + F.col("size"), hi) - F.col("lo")).alias("hi"))
    runs = F.filter(F.array(clip(F.col("at"), F.least(end, F.col("ring"))), clip(F.lit(0).cast("long"), end - F.col("ring"))), lambda r: r["hi"] > r["lo"])
    taken = _taken_before(F.col("lo") + F.col("size")) - _taken_before(F.col("lo"))
    return placed.select("row_id", "doc_id", "source", "size", "source_size", "target", "turns", runs.alias("runs"), taken.alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source), whatever other columns it has.

    A null or empty text has size 0 and takes nothing; a null source is a source of its own. Repeated rows take their parts one by one, as other rows do. An empty table gives an empty one.
    """
    return allocate(materialize(keyed(docs), "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row with the whole text for each turn, and a row for each run of a document's words; n_chars follows the text, other columns stay as they are.

    Rows of which nothing is taken, as of null and empty texts, go.
    """
    stored = materialize(keyed(docs, F.struct(*docs.columns).alias("doc")), "mix-documents")
    found = allocate(stored.drop("doc")).where("taken > 0").select("row_id", "turns", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, texts = batch.column("doc"), [], []
            names = [f.name for f in doc.type]
            for i, (text, turns, runs, size) in enumerate(zip(doc.field("text"), *(batch.column(c).to_pylist() for c in ("turns", "runs", "size")), strict=True)):
                text = text.as_py()
                pieces = [text] * turns + [text if r["hi"] - r["lo"] == size else run_of(text, r["lo"], r["hi"]) for r in runs]
                at += [i] * len(pieces)
                texts += pieces
            fields = doc.take(pa.array(at, pa.int64())).flatten()
            fields[names.index("text")] = pa.array(texts, doc.type.field("text").type)
            yield pa.RecordBatch.from_arrays(fields, names)

    rows = stored.select("row_id", "doc", "size").join(found, "row_id").mapInArrow(cut, docs.schema)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def run_of(text: str, lo: int, hi: int) -> str:
    """The words lo up to hi of a text, with what stands between them."""
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
    return text[places[lo][0] : places[hi - 1][1]]
