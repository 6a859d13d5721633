import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm.shared import materialize, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), "test")
        seen.append((name, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    kept = dict(seen)
    near = kept["SimHash near-dedup"]
    assert near.count() == near.select("doc_id").distinct().count() and 0 < near.count() < kept["quality classifier"].count()
    pieces = docs.toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


ODD = [(0, "é"), (None, None), (None, ""), (3, "  "), (7, "twelve ravens"), (7, "twelve ravens"), (7, "eleven ravens"), (8, "long " * 50_000)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, name):
    """Nulls, empty and long texts, repeated and tied rows, an empty table and clashing columns, for each stage by itself."""
    stage = dict(corpus_pipeline.STAGES)[name]
    real = table(spark, DIR, "documents")
    extra = {n: F.lit(5) for n in ("score", "label", "fp", "size", "row_id", "key", "near_row", "hash", "bucket", "length")}
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in ODD], real.schema)
    docs = materialize(real.unionByName(odd).withColumns(extra), "odd")
    got = stage(spark, docs, DIR)
    rows, none = got.collect(), stage(spark, materialize(docs.where("false"), "none"), DIR)
    assert none.columns == got.columns and none.count() == 0
    if name == "packing":
        assert sum(r.length for r in rows if r.start == 0) > 0 and len([r for r in rows if r.start == 0]) == docs.count()
        return
    assert got.columns == docs.columns and all(r[n] == 5 for r in rows for n in extra)
    kept = sorted(str((r.doc_id, r.text)) for r in rows if str((r.doc_id, r.text)) in {str(x) for x in ODD})
    if name == "language ID":
        assert not {str(x) for x in ODD if not (x[1] or "").strip()} & set(kept) and all(r.lang for r in rows)
    if name == "SimHash near-dedup":
        assert str((7, "twelve ravens")) in kept and len(kept) == len(set(kept)) and len([r for r in rows if not (r.text or "").strip()]) == 1
    if name == "mixing sources to target weights":
        assert all((r.text or "").strip() for r in rows)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DIR).toPandas()
    assert len(rows) and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns)
