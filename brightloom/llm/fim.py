"""Fill-in-the-middle by run-length class encoding.

A unit is a code point; its class is the number of bytes that UTF-8 gives it. A text is kept as its maximal runs of one class, each with the
units before it. A cut after u units is found by binary search of the run that holds it; its byte is that run's first byte and the units
past the run's beginning times the class. Texts are cut as bytes, so no character is decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Of a hundred texts so many stay plain, and of a hundred that are cut so many are written suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Before the id in what is hashed to draw the cuts.
SEED = "1:"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes of a text that are classed at a time.
PIECE = 1 << 22


class Runs:
    """A text's maximal runs of code points of one class: class, units before and bytes before each."""

    def __init__(self, data: bytes | memoryview, piece: int = PIECE):
        """``data`` is UTF-8. Long texts are classed piece by piece; a run that goes on over the end of one is one run."""
        classes, units, offsets, n = [], [], [], 0
        for at in range(0, len(data), piece):
            some = np.frombuffer(data, np.uint8, min(piece, len(data) - at), at)
            leads = np.flatnonzero((some & 0xC0) != 0x80)
            lead = some[leads]
            of = 1 + (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
            first = np.flatnonzero(np.diff(of, prepend=classes[-1][-1] if classes else 0))
            if len(first):
                classes.append(of[first])
                units.append(n + first)
                offsets.append(at + leads[first])
            n += len(leads)
        self.n = n
        self.classes, self.units, self.offsets = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (classes, units, offsets))

    def offset(self, u: int) -> int:
        """The byte after the first ``u`` units, of at most n."""
        if u == 0:
            return 0
        run = int(np.searchsorted(self.units, u - 1, side="right")) - 1
        return int(self.offsets[run]) + (u - int(self.units[run])) * int(self.classes[run])


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits, from the hash of the seed and the decimal id; a null id has no digits."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4))


def transformed(data: bytes, drawn: tuple[int, int, int, int], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, units of prefix and middle (None if plain) and the output of a text."""
    runs, (h1, h2, h3, h4) = Runs(data), drawn
    if not data or h3 % 100 >= 100 - plain or any(m in data for m in _MARKS):
        return runs.n, "plain", None, None, data
    low, high = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    a, b = runs.offset(low), runs.offset(high)
    pre, suf, mid = _MARKS
    if h4 % 100 < suffix_first:
        return runs.n, "spm", low, high - low, b"".join((suf, data[b:], pre, data[:a], mid, data[a:b]))
    return runs.n, "psm", low, high - low, b"".join((pre, data[:a], suf, data[b:], mid, data[a:b]))


def fill_in_middle(docs: DataFrame, seed: str = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the whole text) of every row of ``docs`` (doc_id, text), whatever other columns it has.

    A null text counts as empty; empty texts and those that hold a mark stay plain. A null id is drawn from the seed alone; rows of one id and text are
    cut alike. An empty table gives an empty one. Each row is cut by itself: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            found = [transformed(t.as_buffer().to_pybytes() if t.is_valid else b"", draws(i, seed), plain, suffix_first) for i, t in zip(ids.to_pylist(), batch.column(1), strict=True)]
            n, form, prefix, middle, output = zip(*found, strict=True) if found else ((),) * 5
            counts = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays([ids, counts[0], pa.array(form, pa.string()), *counts[1:], pa.array(output, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    given = docs.select(F.col("doc_id").cast("long"), "text")
    numbers = [StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")]
    return given.mapInArrow(run, StructType([given.schema[0], numbers[0], StructField("form", StringType()), *numbers[1:], StructField("output", StringType())]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. A text that is cut holds no mark, and no mark can arise across a cut's ends, so the marks tell the parts."""
    parts = F.split(output, "<[PSM]>")
    part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with SHA-256 of the outputs and of the texts restored from them, in place of the outputs."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), h AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
