"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams of one to three letters (a blank stands at
either end of a word). A document's own list is compared to each profile by out-of-place distance: the sum, over the
document's n-grams, of how far their ranks lie apart, or the profile's length where one is missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from brightloom.llm.shared import forget, id_remainder, materialize

#: N-grams in a profile.
LENGTH = 300
#: Labelled rows of a language that its profile is made from, at most: dealt by hash to so many shares, each gives an equal part.
FIT_ROWS, SHARES = 2_000, 125
#: Picked ids up to which they are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Languages up to which the driver and each Python worker hold all profiles; more are joined as tables.
LANGUAGES = 10_000
#: Distance to the nearest profile, as a share of the greatest possible, beyond which a text is in no learned language. Short and worn texts of one
#: lie below two thirds, other alphabets and random letters above nine tenths.
FAR = 0.75
_LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of a text's lower-case words; a key packs up to three code points in 21 bits each."""
    words = _LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):  # signs such as a half count as word characters
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 32]
    keys, counts = zip(*(np.unique(k, return_counts=True) for k in (c[c != 32], two, three)), strict=True)
    return np.concatenate(keys), np.concatenate(counts)


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent keys, most frequent first, ties to the smaller key."""
    if len(keys) > LENGTH:
        least = np.partition(counts, len(counts) - LENGTH)[len(counts) - LENGTH]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:LENGTH]


def fit(docs: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """A stored table of lang and grams (its profile, most frequent first), from rows with a lang whose crc32(doc_id) mod 3 is not 1, at most ``limit`` of each.

    One row stands for an id in a language, that with the smallest hash of its text, and ids with the smallest hashes are taken, so the profiles are the same
    on every run. Rows without id, text or lang are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 3) != 1))
    ids = rows.groupBy("doc_id", "lang").agg(F.min(F.xxhash64("text")).alias("of")).withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES)))
    order = Window.partitionBy("lang", "share").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= -(-limit // SHARES)).select("doc_id", "lang", "of")
    picked = materialize(picked, "language-sample")
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_IDS else picked
    taken = rows.join(picked, ["doc_id", "lang"]).where(F.xxhash64("text") == F.col("of")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                of = sums.setdefault(lang, {})
                for k, n in zip(*(x.tolist() for x in grams(text.as_py())), strict=True):
                    of[k] = of.get(k, 0) + n
        for lang, of in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of)), pa.array(list(of), pa.int64()), pa.array(list(of.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = taken.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= LENGTH)
    return materialize(top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "gram")))["gram"].alias("grams")), "language-profiles")  # at most LENGTH a row


def held(known: DataFrame) -> dict[str, np.ndarray] | None:
    """Profiles by language, or None if there are more than ``LANGUAGES``, which no worker should hold."""
    found = known.limit(LANGUAGES + 1).toArrow()
    if found.num_rows > LANGUAGES:
        return None
    return {lang: np.array(of, np.int64) for lang, of in sorted(zip(found["lang"].to_pylist(), (g.values.to_numpy() for g in found["grams"]), strict=True), key=lambda x: x[0])}


class Profiles:
    """All languages' n-grams in one sorted table, each with the languages that have it and its ranks there."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = list(profiles)
        of = [np.zeros(0, np.int64), *profiles.values()]
        grams, order = np.concatenate(of), np.argsort(np.concatenate(of), kind="stable")
        self.keys, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))
        self.langs = np.repeat(np.arange(-1, len(self.names), dtype=np.int32), [len(x) for x in of])[order]
        self.ranks = np.concatenate([np.arange(len(x), dtype=np.int32) for x in of])[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties to the first by name, and by what share it is nearer than the second (1 if there is no second)."""
        return self.measure(text)[:2]

    def measure(self, text: str | None) -> tuple[str, float, float]:
        """As ``predict``, and the nearest profile's distance as a share of what it is if none of the text's n-grams is in the profile."""
        own = ranked(*grams(text))
        if not len(own) or not self.names:
            return "und", 0.0, 1.0
        at = np.searchsorted(self.keys, own)
        known = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == own)
        first, n = self.first[at[known]], np.diff(self.first)[at[known]]
        of = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        near = LENGTH - np.abs(self.ranks[of] - np.repeat(known, n))
        away = LENGTH * len(own) - np.bincount(self.langs[of], near, len(self.names))
        best = int(away.argmin())
        share = float(away[best] / (LENGTH * len(own)))
        if len(away) == 1:
            return self.names[0], 1.0, share
        second = np.partition(away, 1)[1]
        return self.names[best], float((second - away[best]) / second) if second else 0.0, share


def measured(docs: DataFrame, known: DataFrame, most: int | None = None, within: str | None = None) -> DataFrame:
    """``docs`` (text and others, or a struct ``within`` that holds the text) with lang_pred, score and far (the nearest profile's distance as a share of the greatest): und, 0 and 1 if the text is null or has no letter, or no language was learned.

    Up to ``most`` languages (``LANGUAGES``) every worker holds all profiles; beyond, texts and profiles meet by their n-grams in a join.
    """
    most = LANGUAGES if most is None else most
    few = held(known) if known.limit(most + 1).count() <= most else None
    kind = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("far", DoubleType())])
    if few is None:
        return _by_join(docs, known, f"{within}.text" if within else "text")
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(few))  # at most LANGUAGES * LENGTH n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [shared.value.measure(t.as_py()) for t in (batch.column(within).field("text") if within else batch.column("text"))]
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64()), strict=True))], names=kind.names)
        forget()

    return docs.mapInArrow(run, kind)


def _by_join(docs: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """As ``measured`` for any number of languages: of each text and language the n-grams that they share are summed up; languages that share none are as far as can be."""
    stored = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row_id")), "language-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranked(*grams(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["row_id", "grams"])

    own = materialize(stored.select("row_id", f"doc.{text}").mapInArrow(run, "row_id long, grams array<long>"), "language-grams")
    of = own.select("row_id", F.posexplode("grams").alias("place", "gram"))
    at = known.select("lang", F.posexplode("grams").alias("rank", "gram"))
    near = of.join(at, "gram").groupBy("row_id", "lang").agg(F.sum(LENGTH - F.abs(F.col("place") - F.col("rank"))).alias("near"))
    # The two nearest of each text; a language that shares nothing is like one with near 0, and of all the first by name counts.
    first, n = known.agg(F.min("lang").alias("first"), F.count("*").alias("n")).first()
    nearest = Window.partitionBy("row_id").orderBy(F.desc("near"), "lang")
    two = near.withColumn("k", F.row_number().over(nearest)).where("k <= 2").groupBy("row_id").agg(F.max_by("lang", -F.col("k")).alias("lang"), F.max("near").alias("near"), F.when(F.count("*") > 1, F.min("near")).otherwise(0).alias("next"))
    most = F.size("grams") * LENGTH
    best, second = most - F.coalesce("near", F.lit(0)), most - F.coalesce("next", F.lit(0))
    some = (most > 0) & F.lit(n > 0)
    score = F.when(F.lit(n == 1), 1.0).when(second > 0, (second - best) / second).otherwise(0.0)
    found = own.join(two, "row_id", "left").select("row_id", F.when(some, F.coalesce("lang", F.lit(first))).otherwise("und").alias("lang_pred"), F.when(some, score).otherwise(0.0).alias("score"), F.when(some, best / most).otherwise(1.0).alias("far"))
    return stored.join(found, "row_id").select("doc.*", "lang_pred", "score", "far")


def language(docs: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``, whatever other columns it has.

    `und` and 0 where the text is null or has no letter, or where no language was learned. Rows are judged one by one, so repeated ones get the same. An empty table gives an empty one.
    """
    found = measured(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, limit))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, known: DataFrame, far: float = FAR) -> DataFrame:
    """The rows of ``docs``, all columns, whose nearest profile is no farther than ``far``; lang, if it is a column, becomes that profile's language.

    Null and empty texts, those without a letter, and those that hardly share an n-gram with any learned language go.
    """
    kept = measured(docs.select(F.struct(*docs.columns).alias("doc")), known, within="doc").where((F.col("lang_pred") != "und") & (F.col("far") <= far))
    return kept.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col("doc")[c].alias(c) for c in docs.columns))
