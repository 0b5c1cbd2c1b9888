"""Pages of files as a data source, in batch and stream; hashes of files in blocks."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

from evidentia.sources import files, pages
from evidentia.sources.blobs import store

EXTRACTOR = "evidentia.sources.pages:form_feed"


def write(folder, name, texts, at):
    path = folder / name
    path.write_bytes("\f".join(texts).encode())
    os.utime(path, ns=(at, at))
    return path


def load(spark, folder, **options):
    reader = pages.register(spark).read.format("pages").option("extractor", EXTRACTOR)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(folder))


@pytest.fixture()
def folder(tmp_path):
    write(tmp_path, "a.pdf", ["one", "", "three é日"], 10)
    write(tmp_path, "B.PDF", [""], 20)
    write(tmp_path, "long name.pdf", [f"page {k} " * 50 for k in range(200)], 30)
    write(tmp_path, "other.txt", ["x"], 40)
    (tmp_path / "inner").mkdir()
    write(tmp_path / "inner", "c.pdf", ["inside"], 50)
    return tmp_path


WANT = {("a.pdf", 1, "one"), ("a.pdf", 2, ""), ("a.pdf", 3, "three é日"), ("B.PDF", 1, ""), *(("long name.pdf", k + 1, f"page {k} " * 50) for k in range(200))}


@pytest.mark.parametrize("most, partitions", [(1 << 25, 1), (7_000, 14), (100, None)])
def test_pages_of_a_folder(spark, folder, most, partitions):
    df = load(spark, folder, bytesPerPartition=most)
    rows = df.collect()
    assert {(r.file_name, r.page_number, r.page_text) for r in rows} == WANT and len(rows) == len(WANT)
    assert all(r.page_char_length == len(r.page_text) and r.path == f"{folder}/{r.file_name}" for r in rows)
    if partitions:
        assert df.select(F.spark_partition_id()).distinct().count() == partitions
    inner = load(spark, f"file://{folder}", recursive="true", bytesPerPartition=most).filter("file_name = 'c.pdf'").collect()
    assert [(r.path, r.page_text) for r in inner] == [(f"file://{folder}/inner/c.pdf", "inside")]


def test_blocks_that_end_anywhere(monkeypatch, tmp_path):
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(pages.FormFeed, "BLOCK", size)
        path = write(tmp_path, "x.pdf", ["ab", "", "é日", "d" * 9, ""], 1)
        with open(path, "rb") as f:
            assert pages.form_feed.count(f) == 5
        for first in range(5):
            for last in range(first + 1, 7):
                with open(path, "rb") as f:
                    assert list(pages.form_feed.texts(f, first, last)) == ["ab", "", "é日", "d" * 9, ""][first:last]


def test_filters_reach_the_source(spark, folder):
    df = load(spark, folder).filter("file_name in ('a.pdf', 'none.pdf') and page_number between 2 and 3 and page_text <> ''")
    assert [(r.file_name, r.page_number) for r in df.collect()] == [("a.pdf", 3)]
    reader = pages.PagesReader({"path": str(folder), "extractor": EXTRACTOR})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    rest = StringContains(("page_text",), "x")
    assert list(reader.pushFilters([In(("file_name",), ("a.pdf", "B.PDF")), EqualTo(("file_name",), "a.pdf"), GreaterThan(("page_number",), 1), LessThanOrEqual(("page_number",), 2), rest])) == [rest]
    (own,) = reader.partitions()
    assert own.own == [(f"{folder}/a.pdf", 0, 1)]
    assert [r["page_number"] for b in reader.read(own) for r in b.to_pylist()] == [2]


def test_nothing_and_bad_options(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0
    with pytest.raises(Exception, match="names a folder"):
        pages.register(spark).read.format("pages").load().count()
    write(tmp_path, "a.pdf", ["x"], 1)
    if "pypdf" not in sys.modules:
        with pytest.raises(Exception, match="needs the pypdf library"):
            pages.register(spark).read.format("pages").load(str(tmp_path)).count()


def test_stream_takes_each_file_once(spark, folder, tmp_path_factory):
    out, checkpoint = (str(tmp_path_factory.mktemp(n)) for n in ("out", "checkpoint"))

    def go():
        stream = pages.register(spark).readStream.format("pages").option("extractor", EXTRACTOR).option("bytesPerPartition", 5_000).load(str(folder))
        own = stream.select("file_name", "page_number", "page_text").writeStream.format("parquet").option("checkpointLocation", checkpoint)
        own.trigger(availableNow=True).start(out).awaitTermination(180)
        rows = spark.read.parquet(out).collect()
        assert len(rows) == len(set(rows))
        return {tuple(r) for r in rows}

    assert go() == WANT
    assert go() == WANT
    write(folder, "z.pdf", ["new", "er"], 60)
    assert go() == WANT | {("z.pdf", 1, "new"), ("z.pdf", 2, "er")}


def test_hash_of_a_file_that_no_cell_holds(spark, tmp_path):
    size = (2 << 30) + 12_345  # sparse: it takes no room
    with open(tmp_path / "big.pdf", "wb") as f:
        f.truncate(size)
    write(tmp_path, "small.pdf", ["x y"], 1)
    want, left, zeros = hashlib.sha256(), size, bytes(1 << 24)
    while left:
        want.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    got = {r.file_name: (r.length, r.sha256) for r in files.list_pdfs(spark, str(tmp_path), True).collect()}
    assert got == {"big.pdf": (size, want.hexdigest()), "small.pdf": (3, hashlib.sha256(b"x y").hexdigest())}


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a b.txt", "é"), ("c", None)], "file_name string, content string")
    got = files.write_files(rows, f"file://{tmp_path}/new").collect()
    assert {(r.file_name, r.length) for r in got} == {("a b.txt", 2), ("c", 0)} and (tmp_path / "new" / "a b.txt").read_text() == "é"
    assert files.write_files(rows.withColumn("content", F.encode("content", "utf-8")), f"{tmp_path}/new").count() == 2
    assert store("file:/x/y")[1] == store("file:///x/y")[1] == store("/x/y")[1] == "/x/y"
