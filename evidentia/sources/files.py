"""Files of a folder, their hashes and their pages."""

from __future__ import annotations

import hashlib
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.sources.blobs import opened, store


#: Bytes of a file that are hashed at once.
BLOCK = 4 << 20
#: Rows of a listing that a task holds at once.
LISTED = 8_192
#: Stores whose folders tasks list; those of others are listed by Spark's reader, on the driver.
LISTABLE = {"", "file", "s3", "s3a", "s3n", "gs"}


def list_pdfs(spark: SparkSession, folder: str, with_hash: bool = False, levels: int = 0) -> DataFrame:
    """(path, file_name, length[, sha256]) of the files whose name ends in .pdf, case aside; contents are read only to hash.

    Tasks list the folder and stream what they find, so the driver holds no names, however many there are. One task lists a
    folder, so very many files had better lie in subfolders: levels: how many levels of them are above the files.
    Names that begin with a dot or underscore are left out, as Spark's readers do.
    """
    scheme, colon, _ = folder.partition(":")
    if (scheme if colon and "/" not in scheme else "") in LISTABLE:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folders = spark.createDataFrame([(folder.rstrip("/"),)], "path string")
        for _ in range(levels):
            folders = folders.mapInArrow(_listing(True), "path string").repartition(parts, "path")
        rows = folders.mapInArrow(_listing(False), "path string, file_name string, length long")
        return hashed(rows.repartition(parts, "path")) if with_hash else rows
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder + "/*" * levels)
    rows = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    return hashed(rows) if with_hash else rows


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, whether it is a folder, length) of each file and folder in a folder, one by one where the store can."""
    where, base = store(folder)
    if isinstance(where, afs.LocalFileSystem):
        with os.scandir(base) as found:
            for e in found:
                if e.is_dir() or e.is_file():
                    yield e.name, e.is_dir(), e.stat().st_size
    else:
        for e in where.get_file_info(afs.FileSelector(base)):
            yield e.base_name, e.type == afs.FileType.Directory, e.size or 0


def _listing(folders: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The subfolders, or the PDFs, of the folders in the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                own = ((n, size) for n, is_folder, size in _entries(folder) if is_folder == folders and n[0] not in "._" and (folders or n.lower().endswith(".pdf")))
                while some := list(itertools.islice(own, LISTED)):
                    columns = {"path": pa.array([f"{folder}/{n}" for n, _ in some], pa.string())}
                    if not folders:
                        columns |= {"file_name": pa.array([n for n, _ in some], pa.string()), "length": pa.array([size for _, size in some], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def hashed(files: DataFrame, path: str = "path", name: str = "sha256") -> DataFrame:
    """``files`` with the SHA-256 of each file's bytes, read block by block by the task that has the row, at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column(b.schema.names.index(path)).to_pylist():
                sha = hashlib.sha256()
                with opened(p) as file:
                    while block := file.read(BLOCK):
                        sha.update(block)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, name])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField(name, T.StringType())]))


def pages(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(file_name, page_number, page_text, page_char_length) of PDFs. extract: the text of each page of a file's bytes."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts = extract(content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32())],
                    ["file_name", "page_number", "page_text", "page_char_length"],
                )

    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").mapInArrow(run, "file_name string, page_number int, page_text string, page_char_length int")


def full_text(pages_: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, full_text): pages in order, each followed by a blank line."""
    own = F.array_sort(F.collect_list(F.struct("page_number", "page_text")))
    return pages_.groupBy(key).agg(F.array_join(F.transform(own, lambda p: F.concat(p.page_text, F.lit("\n\n"))), "").alias("full_text"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, document_key, expected_document, expected_sources) of an evaluation file (a byte order mark is no harm)."""
    from evidentia.schemas import EVALUATION

    rows = spark.read.option("encoding", "UTF-8").schema(EVALUATION).json(path, multiLine=True, mode="FAILFAST")
    rows = rows.select("documents", F.explode("questions").alias("q"))
    return rows.select("q.id", "q.question", "q.document_key", F.try_element_at("documents", "q.document_key").document_name.alias("expected_document"), "q.expected_sources")


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes as they are."""
    return hashed(spark.read.format("binaryFile").load(path).select("path")).first().sha256


def write_files(rows: DataFrame, folder: str, name: str = "file_name", content: str = "content", folders: int = 0) -> DataFrame:
    """Write each row's text or bytes as a file; (name, path, length). A task that runs again writes the same files again.

    folders: how many subfolders they are dealt to, by a hash of the name (none: they lie in the folder itself).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = store(folder)
        where.create_dir(base, recursive=True)
        made = {""}
        for b in batches:
            names, paths, sizes = b.column(0).to_pylist(), [], []
            for n, value in zip(names, b.column(1), strict=True):
                data = value.as_py() or b""
                data = data.encode() if isinstance(data, str) else data
                under = f"/{zlib.crc32(n.encode()) % folders:05d}" if folders else ""
                if under not in made:
                    where.create_dir(base + under, recursive=True)
                    made.add(under)
                with where.open_output_stream(f"{base}{under}/{n}") as out:
                    out.write(data)
                paths.append(f"{folder}{under}/{n}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], [name, "path", "length"])

    return rows.select(F.col(name).cast("string"), content).mapInArrow(run, f"{name} string, path string, length long")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question) of a file of JSON lines; ids that are missing or repeat, and blank questions, raise an error."""
    rows = spark.read.schema("question_id string, question string").json(path, mode="FAILFAST")
    n = F.count("*").over(W.partitionBy("question_id"))
    problem = F.when(F.col("question_id").isNull(), "a question has no id").when(n > 1, "a question's id repeats").when(F.trim(F.coalesce("question", F.lit(""))) == "", "a question is blank")
    return rows.withColumn("question", F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("question")))
