"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class is a normal density whose covariance is shrunk towards the pooled one and its diagonal; the
score is the logistic of the difference of the log densities (Mahalanobis distances by cached Cholesky
factors, log determinants and class shares).
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.shared import forget, id_remainder, labelled_sample

#: Labelled rows that the discriminant is fitted on, at most.
FIT_ROWS = 20_000
#: Shares of the pooled covariance and of its diagonal that are tried on a fifth of the sample.
SHRINKAGES = ((0.0, 0.02), (0.1, 0.05), (0.3, 0.1), (0.6, 0.1))
#: Standard deviations at which a statistic is cut off.
CLIP = 4.0
THRESHOLD = 0.7
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-?", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~()"), 1):
    _CLASS[list(_chars)] = _k


def statistics(text: str | None) -> list[float]:
    """Sixteen numbers about a text: sizes as logarithms, shares as square roots. Null counts as empty."""
    text = text or ""
    raw = text.encode()
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n, counts = len(words), Counter(words)
    most = max(counts.values(), default=0)
    long = [len(w) for w in counts]
    return [
        np.log1p(len(raw)),
        np.log1p(n),
        np.log1p(len(raw) / max(1, n)),
        np.log1p(np.std(long) if long else 0.0),
        np.log1p(max(long, default=0)),
        np.log1p(len(counts)) / np.log1p(max(2, n)),
        np.sqrt(most / max(1, n)),
        np.sqrt(sum(map(operator.eq, words, words[1:])) / max(1, n)),
        np.sqrt(len(set(lines)) / len(lines)),
        *np.sqrt(kinds[[1, 2, 4, 5, 6, 7, 8]]),
    ]


class Discriminant:
    """Two shrunken normal densities over standardised and cut-off statistics."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float, diagonal: float):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._standard(x)
        own = [z[y == c] for c in (0, 1)]
        covs = [np.cov(o.T, bias=True) if len(o) > 1 else np.eye(z.shape[1]) for o in own]
        shares = np.array([len(o) for o in own]) / len(z)
        both = sum(s * c for s, c in zip(shares, covs, strict=True))
        self.centres, self.factors, self.offsets = [], [], []
        for o, c, s in zip(own, covs, shares, strict=True):
            c = (1 - pooled) * c + pooled * both
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            self.centres.append(o.mean(0))
            self.factors.append(np.linalg.inv(factor))
            self.offsets.append(np.log(s) - np.log(np.diag(factor)).sum())

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._standard(x)
        d = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.centres, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -35, 35)))


class Constant:
    """Stands in where the sample lacks a class: every document gets that share."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label").cast(pa.int64())], names=["x", "label"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Discriminant | Constant:
    """Fit on at most ``limit`` labelled rows whose crc32(doc_id) mod 4 is not 2."""
    sample = labelled_sample(docs, labels, "quality", id_remainder(F.col("doc_id"), 4) != 2, limit)
    rows = sample.mapInArrow(_measure, "x array<double>, label long").toPandas()  # at most `limit` rows of 16 numbers
    y = rows["label"].to_numpy(int)
    if min(np.bincount(y, minlength=2)) < 5:
        return Constant(float(y.mean()) if len(y) else 0.5)
    x = np.array(rows["x"].tolist())
    order = np.lexsort(np.c_[x, y].T)  # the order of the rows must not matter
    x, y, last = x[order], y[order], np.arange(len(y)) % 5 == 4
    loss = {}
    for how in SHRINKAGES:
        p = np.clip(Discriminant(x[~last], y[~last], *how).score(x[last]), 1e-6, 1 - 1e-6)
        loss[how] = -np.mean(np.where(y[last] == 1, np.log(p), np.log(1 - p)))
    return Discriminant(x, y, *min(loss, key=loss.get))


def score(docs: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """doc_id and score of every row; a null text is scored as an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two 16 x 16 matrices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) of every row of ``docs``, whatever other columns it has.

    A null text is scored as an empty one. Repeated rows get the same score; for the fit an id counts once. Without labels of both classes all get the constant score of what is known. An empty table gives an empty one.
    """
    scored = score(docs, fit(docs, labels, limit))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column("text")])
                yield batch.filter(pa.array(held.value.score(x) >= THRESHOLD))

    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(run, docs.schema)
