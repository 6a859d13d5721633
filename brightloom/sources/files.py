"""Reading files into documents: text, DOCX and PDF by extension, with a cascade of extractors."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.functions import text as T

EXTENSIONS = ("pdf", "txt", "docx", "doc")
#: Quality under which the next extractor of a cascade is tried.
ENOUGH = 0.6
#: Bytes of an upload that are written at a time: Arrow batches hold a thousand of these pieces or what the session says, whichever is less.
PIECE = 1 << 15
SCHEMA = "path string, file_name string, pages array<string>, source_url string, method string"


def find_files(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """path, content and modificationTime of the files with a known extension."""
    pattern = "*.{" + ",".join([*EXTENSIONS, *(e.upper() for e in EXTENSIONS)]) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(directory)


def read_txt(data: bytes) -> list[str]:
    return [data.decode("utf-8", errors="replace")]


def read_docx(data: bytes) -> list[str]:
    """Paragraphs joined by newlines, as one page."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))]


def read_pdf(data: bytes) -> list[str]:
    """Pages by pdfplumber, where it is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages]


def quality(pages: list[str], full_page: int = 2500) -> float:
    """Words a page as a share of ``full_page``, at most 1."""
    return min(1.0, sum(len(p.split()) for p in pages) / len(pages) / full_page) if pages else 0.0


Extractor = tuple[str, Callable[[bytes], list[str]], float | None]
#: By extension: extractors in the order in which they are tried, each with a fixed quality or None to measure it.
READERS: dict[str, list[Extractor]] = {"txt": [("txt", read_txt, 1.0)], "docx": [("docx", read_docx, 1.0)], "doc": [("docx", read_docx, 1.0)], "pdf": [("pdfplumber", read_pdf, None)]}


def parse_files(files: DataFrame, readers: dict[str, list[Extractor]] = READERS, enough: float = ENOUGH) -> DataFrame:
    """One row for each file: pages, the first http link and the method.

    Extractors are tried until one reaches ``enough``; the best holds. A file that none can read has no pages and the method failed; an
    unknown extension gives the method unsupported. Recognition of scanned pages is one more extractor, for callers that have a model.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                best: tuple[float, list[str], str] = (-1.0, [], "failed" if kind in readers else "unsupported")
                for method, read, fixed in readers.get(kind, []):
                    try:
                        pages = read(data)
                    except Exception:  # a damaged file is a result, not the end of the job
                        continue
                    score = quality(pages) if fixed is None else fixed
                    best = max(best, (score, pages, method), key=lambda x: x[0])
                    if score >= enough:
                        break
                link = re.search(r"https?://\S+", " ".join(best[1]))
                rows.append((path, path.rsplit("/", 1)[-1], best[1], link[0] if link else None, best[2]))
            yield pd.DataFrame(rows, columns=["path", "file_name", "pages", "source_url", "method"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def page_map(pages: str = "pages"):
    """Start of each page in the text of all pages joined by blank lines, to its number from 1."""
    none = F.array().cast("array<struct<start:int,next:int>>")
    # Each page starts where the one before ends, two characters on.
    next_start = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1))["next"], F.lit(0))
    places = F.aggregate(F.col(pages), none, lambda done, p: F.concat(done, F.array(F.struct(next_start(done).alias("start"), (next_start(done) + F.length(p) + 2).alias("next")))))
    return F.map_from_entries(F.transform(places, lambda x, i: F.struct(x["start"], i + 1)))


def to_documents(parsed: DataFrame) -> DataFrame:
    """Documents with cleaned text and the metadata that it shows."""
    joined = F.array_join("pages", "\n\n")
    rows = parsed.select(F.md5("path").alias("document_id"), F.col("file_name").alias("original_filename"), "source_url", "method", T.clean_text(joined).alias("text"), page_map().alias("page_map"), F.size("pages").alias("pages"))
    t = F.col("text")
    return rows.withColumns({"document_type": T.document_type(t), "law": T.law(t), "citation": T.citation(t), "court": T.court(t)["court"], "court_name": T.court(t)["court_name"], "year": T.year(t), "keywords": T.keywords(t)})


def with_urls(documents: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """source_url from a manifest (name, url): by file name, else by path below ``root``, else what the file says."""
    by_name = manifest.select(F.col("name").alias("file_name"), F.col("url").alias("_by_name"))
    by_path = manifest.select(F.col("name").alias("_relative"), F.col("url").alias("_by_path"))
    rows = documents.withColumn("_relative", F.regexp_replace("path", "^(file:)?" + re.escape(root.rstrip("/")) + "/", ""))
    return rows.join(by_name, "file_name", "left").join(by_path, "_relative", "left").withColumn("source_url", F.coalesce("_by_name", "_by_path", "source_url")).drop("_by_name", "_by_path", "_relative")


def not_yet_read(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose name no document has."""
    return files.withColumn("original_filename", F.element_at(F.split("path", "/"), -1)).join(documents.select("original_filename"), "original_filename", "left_anti")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries: query, expected_law, expected_sections, expected_intent and min_confidence from a JSON list."""
    return spark.read.schema("query string, expected_law string, expected_sections array<string>, expected_intent string, min_confidence double").json(path, multiLine=True)


def assemble_parts(parts: DataFrame) -> DataFrame:
    """upload_id, content and complete of upload parts (upload_id, start, content, total), joined in the order of their starts.

    An upload that is to be one value must fit in one; ``write_uploads`` makes files of larger ones.
    """
    rows = parts.groupBy("upload_id").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("start", "content"))).alias("p"))
    content = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["content"])), ""))
    return rows.withColumn("content", content).select("upload_id", "content", (F.length("content") == F.col("total")).alias("complete"))


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digests(written: DataFrame, piece: int = 32 * PIECE) -> DataFrame:
    """upload_id, size and md5 (hex) of the files that uploads (upload_id, path) were written to; those without a file give no row.

    Tasks open the paths that their rows name and read them piece by piece: no folder is listed on the driver, however many files it has, and no file is held whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = None, None
        for batch in batches:
            made = []
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, file = path.rsplit("/", 1)
                if folder != root:
                    (fs, base), root = _system(folder), folder
                md5, size = hashlib.md5(), 0
                with fs.open_input_stream(f"{base}/{file}") as f:
                    while data := f.read(piece):
                        md5.update(data)
                        size += len(data)
                made.append((name, size, md5.hexdigest()))
            ids, sizes, sums = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["upload_id", "size", "md5"])

    return written.where(F.col("path").isNotNull()).select("upload_id", "path").mapInArrow(read, "upload_id string, size long, md5 string")


def write_uploads(parts: DataFrame, folder: str, piece: int = PIECE) -> DataFrame:
    """Write each upload of ``parts`` (upload_id, start, content, total) to a file of its name in ``folder``, whatever its size; upload_id, path, size and complete of each.

    A task has the parts of its uploads in the order of their starts, which Spark sorts and spills, and writes them one after another in pieces of at most ``piece`` bytes; no upload is ever held whole. What two parts
    both have is written once. A file is written under a name of the task's attempt and renamed when all bytes up to the total are there, so a repeated task or a reader never meets half a file; an upload with a gap
    leaves none (path null, size up to the gap).
    """
    rows = parts.select(F.col("upload_id").cast("string").alias("upload_id"), F.col("start").cast("long").alias("start"), "content", F.col("total").cast("long").alias("total"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length("content") - 1), F.lit(piece))).alias("at")
    dealt = rows.repartition("upload_id").sortWithinPartitions("upload_id", "start").select("upload_id", "start", "content", "total", at)
    cut = dealt.select("upload_id", (F.col("start") + F.col("at")).alias("start"), F.substring(F.col("content"), F.col("at") + 1, F.lit(piece)).alias("content"), "total")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _system(folder)
        fs.create_dir(root, recursive=True)
        attempt, name, out, size, total, made = TaskContext.get().taskAttemptId(), None, None, 0, 0, []

        def close() -> None:
            if out is None:
                return
            out.close()
            whole = size >= total
            if whole:
                fs.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            else:
                fs.delete_file(f"{root}/.{name}.{attempt}")
            made.append({"upload_id": name, "path": f"{folder}/{name}" if whole else None, "size": size, "complete": whole})

        for batch in batches:
            for key, start, content, all_ in zip(*(batch.column(i) for i in range(4)), strict=True):
                if key.as_py() != name:
                    close()
                    name, size, total = key.as_py(), 0, all_.as_py()
                    out = fs.open_output_stream(f"{root}/.{name}.{attempt}")
                known = size - start.as_py()
                if known >= 0 and content.as_buffer().size > known:  # else a gap is before it, or it is written already
                    out.write(content.as_buffer()[known:])
                    size += content.as_buffer().size - known
        close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("upload_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("complete", pa.bool_())]))

    return cut.mapInArrow(write, "upload_id string, path string, size long, complete boolean")


def part_ranges(parts: DataFrame) -> DataFrame:
    """upload_id, start, stop and gap (bytes missing before it) of every part, in place: an upload of any size is whole if no part has a gap and the last stop is its total."""
    before = Window.partitionBy("upload_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("stop", F.col("start") + F.length("content"))
    return rows.select("upload_id", "start", "stop", F.greatest(F.lit(0).cast("long"), F.col("start") - F.coalesce(F.max("stop").over(before), F.lit(0))).alias("gap"))
