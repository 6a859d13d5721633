"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import hashlib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from brightloom.functions import text as T
from brightloom.plans import harness, registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    found = registry.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


def plain_chunks(s, opens, target=1400):
    """Chunks of sentences by their definition: grown until the next would take one over the size, or opens a section; two sentences are shared after the first cause."""
    out, first, new = [], 0, 0
    size = lambda a, b: sum(map(len, s[a:b]))
    while new < len(s):
        stop = new + 1
        while stop < len(s) and size(first, stop + 1) <= target and not (opens[stop] and size(first, stop) >= 20):
            stop += 1
        full = stop < len(s) and size(first, stop + 1) > target
        if stop < len(s) or size(first, stop) >= 20:
            out.append(" ".join(s[first:stop]))
        first, new = (max(first, stop - 2) if full else stop), stop
    return out


def test_chunks_of_all_documents(spark):
    """Every chunk of the whole table against the definition."""
    d = harness.table(spark, DIR, "documents")
    s = T.sentences(F.coalesce("text", F.lit("")))
    given = d.where("length(trim(text)) >= 150").select(F.col("doc_id").cast("string").alias("i"), s.alias("s"), F.transform(s, T.is_boundary).alias("opens")).collect()
    want = sorted((r.i, c) for r in given for c in (x.strip(" ") for x in plain_chunks(list(r.s), list(r.opens))) if len(c) >= 150)
    assert sorted((r.document_id, r.content) for r in registry.QUERIES["chunk_document"](spark, DIR).collect()) == want and len(want) > 300


def test_windows_of_all_documents(spark):
    given = harness.table(spark, DIR, "documents").select(F.col("doc_id").cast("string").alias("i"), T.summary_sentences(F.coalesce("text", F.lit(""))).alias("s")).collect()
    want = []
    for r in given:
        s, held, n = [x for x in r.s if x], [], 0
        for i, x in enumerate(s):
            if held and sum(len(s[j]) for j in held) + len(x) > 2000:
                want.append((r.i, n, " ".join(s[j] for j in held)))
                n, held = n + 1, [j for j in held if sum(len(s[m]) for m in range(j, held[-1] + 1)) <= 300]
            held = [*held, i]
        if held:
            want.append((r.i, n, " ".join(s[j] for j in held)))
    got = registry.QUERIES["summary_text_windows"](spark, DIR).collect()
    assert sorted((r.document_id, r.window, r.chars, r.text_md5) for r in got) == sorted((i, n, len(t), hashlib.md5(t.encode()).hexdigest()) for i, n, t in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_subpackage():
    root = os.path.dirname(registry.__file__.replace("/plans", ""))
    for folder, _, files in os.walk(root):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "brightloom.llm" not in open(os.path.join(folder, f)).read()
