"""Files of chosen names and bytes, written by tasks and read back by Spark's own readers."""

import os

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellselect.sources import files
from cellselect.sources.named_files import NamedFilesWriter, bmp, write_named


def read(spark, path):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").collect()
    return {r.path.split(path, 1)[1].lstrip("/"): bytes(r.content) for r in rows}


def test_round_trip(spark, tmp_path):
    rows = [(f"d{i % 3}/f {i}.bin", bytes([i]) * i) for i in range(60)] + [("empty", None), ("é/ü.jpg", b"\x00\xff")]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(7)
    write_named(df, str(tmp_path / "out"))
    got = {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {n: c or b"" for n, c in rows}  # and no half files
    assert len(read(spark, str(tmp_path / "out"))) == sum(bool(c) for _, c in rows)  # the reader leaves empty files out


def test_a_second_write_replaces_files_of_its_names(spark, tmp_path):
    out = f"file:{tmp_path}/out"
    one = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")
    write_named(one, out)
    write_named(one.where("name = 'a'").withColumn("content", F.lit(b"3")), out)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a": b"3", "b": b"2"}


@pytest.mark.parametrize("name", [None, "", "/etc/x", "../x", "a/../../x"])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    with pytest.raises(PySparkException, match="not a name below the folder"):
        write_named(spark.createDataFrame([(name, b"x")], "name string, content binary"), str(tmp_path / "out"))


def test_pictures_decode(spark, tmp_path):
    pixels = bytes(range(8 * 3 * 3))
    df = spark.createDataFrame([("p.bmp", pixels)], "name string, data binary")
    write_named(df.select("name", bmp(F.col("data"), 8, 3).alias("content")), str(tmp_path))
    row = files.read_images(spark, str(tmp_path)).first()
    assert (row.height, row.width, row.nChannels, bytes(row.data), row.error) == (3, 8, 3, pixels, None)
    with pytest.raises(ValueError):
        bmp(F.col("data"), 7, 3)


def test_no_rows(spark, tmp_path):
    write_named(spark.createDataFrame([], "name string, content binary"), str(tmp_path / "none"))
    assert not list(tmp_path.rglob("*.bin"))


def test_empty_files_share_inodes(spark, tmp_path):
    """A disk has a fixed number of inodes; names without content need none each. Files with content have their own."""
    rows = [(f"d{i % 3}/f{i}", b"x" if i % 50 == 0 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    for _ in range(2):  # the same again, as by a repeated task
        write_named(df, f"file:{tmp_path}/out", link_empty=True)
    found = {p.relative_to(tmp_path / "out").as_posix(): p for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert {n: p.read_bytes() for n, p in found.items()} == {n: c or b"" for n, c in rows}  # and no hidden ones
    assert len({p.stat().st_ino for p in found.values()}) <= 20 + 4
    write_named(df.where("content is null").limit(1).withColumn("content", F.lit(b"new")), str(tmp_path / "out"), link_empty=True)
    assert sorted(p.read_bytes() for p in found.values()) == [b""] * 979 + [b"new"] + [b"x"] * 20


@pytest.mark.parametrize("most", [0, 10])
def test_empty_files_where_links_are_few_or_none(tmp_path, monkeypatch, most):
    link = os.link

    def few(src, dst):
        if os.stat(src).st_nlink > most:
            raise OSError(31 if most else 1, "no more links")
        link(src, dst)

    monkeypatch.setattr(os, "link", few)
    names = [f"d/{i}" for i in range(95)] + ["d/7"]
    batch = pa.record_batch([pa.array(names), pa.array([b""] * 96, pa.binary())], ["name", "content"])
    assert NamedFilesWriter(str(tmp_path), link_empty=True).write(iter([batch])).files == 96
    assert {p.name for p in tmp_path.iterdir()} == {"d"} and {p.name for p in (tmp_path / "d").iterdir()} == {str(i) for i in range(95)}
    assert len({p.stat().st_ino for p in (tmp_path / "d").iterdir()}) == (10 if most else 95)
