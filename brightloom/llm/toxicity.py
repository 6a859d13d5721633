"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and their first four and five letters, hashed to buckets. Buckets whose
document counts differ between the classes are the machine's inputs, and so are both buckets of a common pair that tells the classes
apart better than either alone; it adds to their linear weights a learned product for each pair, so a pair of terms can say what neither says alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.shared import id_remainder, labelled_sample, materialize

BITS = 18
#: Labelled rows that the machine is fitted on, at most.
FIT_ROWS = 20_000
#: Buckets that become inputs, at most, and the chi-square from which on one may.
INPUTS, CHI_SQUARE = 4096, 25.0
#: Most frequent buckets whose pairs are looked at; chi-square that a pair must reach, and how many times that of either bucket.
PAIRED, PAIR_CHI_SQUARE, PAIR_GAIN = 1024, 50.0, 1.5
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 30, 256, 0.05, 1e-4
_WORD = re.compile(r"[^\W\d_]+")
_MASK = (1 << BITS) - 1
#: Words that a worker's cache holds before it starts anew, and the longest that it keeps: some 100 MB in all.
_CACHE_WORDS, _LONG_WORD = 400_000, 64


class Terms:
    """Buckets of texts, with a cache of words."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall((text or "").lower()))
        if not words:
            return np.zeros(0, np.int64)
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        for w in words.difference(self.cache):
            at = [zlib.crc32(t.encode()) & _MASK for t in (w, f"4^{w[:4]}", f"5^{w[:5]}")]
            self.cache[w] = at[0] | at[1] << BITS | at[2] << 2 * BITS
        packed = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        for w in [w for w in words if len(w) > _LONG_WORD]:
            del self.cache[w]
        return np.unique(np.concatenate([packed & _MASK, packed >> BITS & _MASK, packed >> 2 * BITS]))


class Machine:
    """sigmoid(bias + sum of w_i + sum over pairs of v_i . v_j), over the inputs that a text has."""

    def __init__(self, inputs: np.ndarray):
        self.inputs = np.sort(inputs)
        rng = np.random.default_rng(7)
        self.bias, self.w = 0.0, np.zeros(len(inputs))
        self.v = rng.normal(0, 0.02, (len(inputs), FACTORS))

    def chosen(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.inputs):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.inputs, buckets), len(self.inputs) - 1)
        return at[self.inputs[at] == buckets]

    def raw(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        of, at = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        s, q = np.zeros((len(rows), FACTORS)), np.zeros(len(rows))
        np.add.at(s, of, self.v[at])
        np.add.at(q, of, (self.v[at] ** 2).sum(1))
        z = self.bias + np.bincount(of, self.w[at], len(rows)) + 0.5 * ((s**2).sum(1) - q)
        return z, s, of, at

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -35, 35)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> Machine:
        """Minimise the log loss and an L2 penalty by AdaGrad over shuffled batches."""
        rng, past = np.random.default_rng(11), [1e-8, np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8)]
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(EPOCHS if len(rows) else 0):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                z, s, of, at = self.raw([rows[i] for i in some])
                g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[some]) / len(some)
                gw, gv = DECAY * self.w, DECAY * self.v
                gw += np.bincount(at, g[of], len(self.w)) if len(at) else 0
                np.add.at(gv, at, g[of][:, None] * (s[of] - self.v[at]))
                for i, grad in enumerate((g.sum(), gw, gv)):
                    past[i] = past[i] + grad**2
                    step = RATE * grad / np.sqrt(past[i])
                    if i == 0:
                        self.bias -= float(step)
                    elif i == 1:
                        self.w -= step
                    else:
                        self.v -= step
        return self


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Machine:
    """Fit on at most ``limit`` labelled rows whose crc32(doc_id) mod 5 is not 0. Without any label every score is a half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.int64())), batch.column(2).cast(pa.int64())], names=["doc_id", "terms", "label"])

    sample = labelled_sample(docs, labels, "toxic", id_remainder(F.col("doc_id"), 5) != 0, limit)
    sample = materialize(sample.mapInArrow(run, "doc_id long, terms array<long>, label long"), "toxic-terms")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n1 < n:
        return Machine(np.zeros(0, np.int64))
    counts = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("a"), F.sum("label").alias("b")).where("a >= 3")
    counts = counts.withColumn("chi", F.when(F.col("a") < n, chi_square(F.col("a").cast("double"), F.col("b").cast("double"), n, n1)).otherwise(0.0)).persist()  # what every row has tells nothing
    strong = [r["term"] for r in counts.where(F.col("chi") >= CHI_SQUARE).orderBy(F.desc("chi"), "term").limit(INPUTS).collect()]
    common = {r["term"]: r["chi"] for r in counts.where(F.col("a") < n).orderBy(F.desc("a"), "term").limit(PAIRED).collect()}
    counts.unpersist()
    known = sorted({*strong, *common})  # at most INPUTS + PAIRED
    wanted = sample.select("doc_id", "label", F.array_intersect("terms", F.lit(known) if known else F.array().cast("array<long>")).alias("terms")).toPandas()  # at most `limit` rows
    wanted = wanted.sort_values("doc_id")  # the order of the rows must not matter
    rows, y = [np.array(t, np.int32) for t in wanted.pop("terms")], wanted["label"].to_numpy(float)
    machine = Machine(np.array(sorted({*strong, *paired(rows, y, common)}), np.int64))
    return machine.fit([machine.chosen(r) for r in rows], y)


def chi_square(a, b, n: float, n1: float):
    """Of n rows, n1 of label 1: how far b such rows among a that have something are from what chance gives (columns or arrays; 0 < a < n)."""
    lift = n * b - a * n1
    return n * lift * lift / (a * (n - a) * float(n1) * float(n - n1))


def paired(rows: list[np.ndarray], y: np.ndarray, common: dict[int, float]) -> set[int]:
    """The buckets of ``common`` (with their own chi-squares) in pairs that tell the classes apart better than either."""
    names = np.array(sorted(common), np.int64)
    if len(names) < 2:
        return set()
    both, both1 = np.zeros((2, len(names), len(names)))
    for k in range(0, len(rows), 1024):  # so many rows at a time as a table of names
        has = np.zeros((len(rows[k : k + 1024]), len(names)), np.float32)
        for i, r in enumerate(rows[k : k + 1024]):
            at = np.minimum(np.searchsorted(names, r), len(names) - 1)
            has[i, at[names[at] == r]] = 1
        of = has[y[k : k + 1024] == 1]
        both += has.T @ has
        both1 += of.T @ of
    own = np.array([common[int(t)] for t in names])
    inner = np.clip(both, 0.5, len(y) - 0.5)  # pairs that no row or every row has say nothing
    chi = np.where((both >= 3) & (both < len(y)), chi_square(inner, both1, len(y), float(y.sum())), 0.0)
    good = (chi >= PAIR_CHI_SQUARE) & (chi >= PAIR_GAIN * np.maximum(own[:, None], own[None, :]))
    np.fill_diagonal(good, False)
    return set(names[good.any(1)].tolist())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row. A null or empty text has no term and gets the machine's bias."""
    broadcast = docs.sparkSession.sparkContext.broadcast(machine)  # at most INPUTS * (FACTORS + 2) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held = Terms(), broadcast.value
        for batch in batches:
            rows = [held.chosen(terms(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.score(rows))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row of ``docs``, whatever other columns it has.

    A null text is scored as an empty one. Repeated rows get the same score; for the fit an id counts once. An empty table gives an empty one.
    """
    scored = score(docs, fit(docs, labels, limit))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
