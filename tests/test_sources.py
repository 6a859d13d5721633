"""Files, sinks, versions and streams."""

import zipfile

from pyspark.sql import functions as F

from brightloom.schemas import STAGED_CHUNKS
from brightloom.sources import files, tables
from brightloom.streaming import flush


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("JUDGMENT in AIR 2017 SC 46 café \xff".encode("latin-1"))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "skip.csv").write_text("x")
    with zipfile.ZipFile(tmp_path / "sub" / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Section 12 https://x.org/kanoon</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    found = files.find_files(spark, str(tmp_path))
    parsed = {r.file_name: r for r in files.parse_files(found).collect()}
    assert sorted(parsed) == ["a.txt", "b.docx", "bad.docx", "scan.pdf"]
    assert parsed["b.docx"].pages == ["Section 12 https://x.org/kanoon\ntwo"] and parsed["b.docx"].source_url == "https://x.org/kanoon"
    assert parsed["bad.docx"].method == parsed["scan.pdf"].method == "failed"
    docs = {r.original_filename: r for r in files.to_documents(files.parse_files(found)).collect()}
    assert (docs["a.txt"].citation, docs["a.txt"].document_type, docs["a.txt"].year) == ("AIR 2017 SC 46", "judgment", 2017)
    manifest = spark.createDataFrame([("a.txt", "u1"), ("sub/b.docx", "u2")], "name string, url string")
    urls = {r.file_name: r.source_url for r in files.with_urls(files.parse_files(found), manifest, str(tmp_path)).collect()}
    assert urls["a.txt"] == "u1" and urls["b.docx"] == "u2"
    assert files.not_yet_read(found, spark.createDataFrame([("a.txt",)], "original_filename string")).count() == 3


def test_cascade(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"data")
    readers = {"pdf": [("thin", lambda b: ["few words"], None), ("broken", lambda b: 1 / 0, None), ("full", lambda b: ["w " * 3000], None), ("never", lambda b: 1 / 0, 1.0)]}
    assert files.parse_files(files.find_files(spark, str(tmp_path)), readers).first().method == "full"


def test_page_map(spark):
    row = spark.createDataFrame([(["abc", "de", "f"],)], "pages array<string>").select(files.page_map().alias("m")).first()
    assert row.m == {0: 1, 5: 2, 9: 3}


def test_golden_set(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"query": "q", "expected_law": null, "expected_sections": ["1"], "expected_intent": "x", "min_confidence": 0.5}]')
    assert files.golden_set(spark, str(tmp_path / "g.json")).first().expected_sections == ["1"]


def test_parts(spark):
    rows = spark.createDataFrame([("u", 2, bytearray(b"cd"), 4), ("u", 0, bytearray(b"ab"), 4), ("v", 0, bytearray(b"x"), 2)], "upload_id string, start long, content binary, total long")
    got = {r.upload_id: (bytes(r.content), r.complete) for r in files.assemble_parts(rows).collect()}
    assert got == {"u": (b"abcd", True), "v": (b"x", False)}
    assert sorted(map(tuple, files.part_ranges(rows).collect())) == [("u", 0, 2, 0), ("u", 2, 4, 0), ("v", 0, 1, 0)]
    assert files.part_ranges(rows.where("start > 0")).first().gap == 2


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "id string, x int, y int")
    rows = spark.createDataFrame([("b", 9, 9), ("c", 3, 3), ("c", 3, 3)], "id string, x int, y int")
    assert sorted(map(tuple, tables.upsert(t, rows, "id", ["x"]).collect())) == [("a", 1, 1), ("b", 9, 2), ("c", 3, 3)]
    assert [tuple(r) for r in tables.insert_new(t, rows, "id").collect()] == [("c", 3, 3)]
    d = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert tables.delete_documents({"d": d}, d.where("document_id = 'a'"))["d"].count() == 1


def test_partitions_prune(spark, tmp_path):
    rows = spark.createDataFrame([("1", "BNS"), ("2", None)], "chunk_id string, law string")
    tables.write_chunks(rows, str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c")).where("law = 'Other'")
    assert [r.chunk_id for r in read.collect()] == ["2"] and "PartitionFilters: [isnotnull(law" in read._jdf.queryExecution().toString()


def test_versions(spark, tmp_path):
    t = tables.VersionedTable(spark, str(tmp_path / "index"))
    assert t.swap(spark.range(100), 100) and t.read().count() == 100
    assert not t.swap(spark.range(98), 100) and t.version() == 1
    assert not t.swap(spark.range(0), 0)
    assert t.swap(spark.range(99), 100) and t.read().count() == 99


def test_flush(spark, tmp_path):
    def stage(name, rows):
        spark.createDataFrame(rows, "chunk_id string, document_id string, n int").withColumn("embedding", F.array_repeat(F.lit(0.5).cast("float"), F.col("n"))).select("chunk_id", "document_id", "embedding", F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(False).alias("indexed"), F.lit(False).alias("processing"), F.current_timestamp().alias("created_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "staged"))

    paths = [str(tmp_path / x) for x in ("index", "bad", "cp")]
    run = lambda: flush.flush(flush.staged_stream(spark, str(tmp_path / "staged"), STAGED_CHUNKS), *paths, dim=4, every=None).awaitTermination()
    stage("one", [("a", "d", 4), ("a", "d", 4), ("b", "d", 3)])
    run()
    stage("two", [("a", "d", 4), ("c", "e", 4)])
    run()
    assert sorted(r.chunk_id for r in flush.indexed(spark, paths[0]).collect()) == ["a", "c"]
    assert [r.chunk_id for r in spark.read.parquet(paths[1]).collect()] == ["b"]


def test_stream_counts_equal_batch(spark, tmp_path):
    spark.createDataFrame([(x,) for x in "aabcc"], "document_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id string").parquet(str(tmp_path / "in"))
    q = flush.counts_by_document(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.document_id: r.n for r in spark.table("counted").collect()} == {"a": 2, "b": 1, "c": 2}
