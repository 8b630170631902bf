"""A sink that writes one file of chosen name and bytes per row, which Spark's own writers cannot, and the way
back: names and bytes of a folder's files, listed and read by tasks."""

from __future__ import annotations

import contextlib
import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _open(path: str):
    """(file system, path on it) of a URI or a plain path."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: int


class EmptyFile:
    """A hidden empty file of a folder, to which names are given as hard links: a name takes no inode, of which a disk
    has a fixed number. When the file system allows it no more names (65,000 on ext4), a new file follows; where there
    are no such links, ``name`` says so."""

    def __init__(self, root: str, usable: bool):
        self.root, self.usable, self.file = root, usable, None

    def name(self, path: str) -> bool:
        """Whether ``path`` is a new name of it; a name that exists stays as it is."""
        while self.usable:
            fresh = self.file is None
            try:
                if fresh:
                    self.file = f"{self.root}/.{uuid.uuid4().hex}"
                    open(self.file, "xb").close()
                os.link(self.file, path)
                return True
            except FileExistsError:
                return False
            except OSError:
                self.usable = not fresh
                self.close()
        return False

    def close(self) -> None:
        if self.file is not None:
            with contextlib.suppress(OSError):
                os.unlink(self.file)
            self.file = None


class NamedFilesWriter(DataSourceArrowWriter):
    """A file is written under a name of its own and moved to its place when it is whole: a repeated or
    speculative task replaces a file by the same one, and a lost task leaves no half file under a name. An empty
    file is whole at once; it takes no block of a disk and, with ``link_empty``, no inode."""

    def __init__(self, path: str, link_empty: bool = False):
        self.path, self.link_empty = path, link_empty

    def write(self, iterator: Iterator) -> Written:
        system, root = _open(self.path)
        made: set[str] = set()
        n = 0
        with contextlib.closing(EmptyFile(root, self.link_empty and is_local(self.path))) as empty:
            for batch in iterator:
                for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist()):
                    folder = f"{root}/{name}".rsplit("/", 1)[0]
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    n += 1
                    if not content:
                        if not empty.name(f"{root}/{name}"):
                            system.open_output_stream(f"{root}/{name}").close()
                        continue
                    part = f"{folder}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(content)
                    system.move(part, f"{root}/{name}")
        return Written(n)


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(path)`` for columns (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("named files are added to a folder, mode('append'); files of the same names are replaced")
        return NamedFilesWriter(self.options["path"], self.options.get("link_empty") == "true")


def write_named(df: DataFrame, path: str, link_empty: bool = False) -> None:
    """Write (name, content): ``name`` is a path below ``path``. Rows without a name, with an empty one or one that
    leaves the folder are an error; null content is an empty file; of rows with one name any stays. ``link_empty``:
    empty files are hard links of a few, for more names than a disk has inodes; who writes to one in place writes to all."""
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    bad = F.col("name").isNull() | (F.col("name") == "") | F.col("name").startswith("/") | F.col("name").contains("..")
    name = F.when(bad, F.raise_error(F.concat(F.lit("not a name below the folder: "), F.coalesce("name", F.lit("null")))).cast("string")).otherwise(F.col("name"))
    rows = df.select(name.alias("name"), F.coalesce("content", F.lit(b"")).cast("binary").alias("content"))
    rows.write.format("named_files").mode("append").option("link_empty", link_empty).save(path)


def is_local(path: str) -> bool:
    """Whether tasks reach a path without Spark's own file systems (a disk or a mount that all share)."""
    return "://" not in path or path.startswith("file:")


def local_path(path: str) -> str:
    return _open(path)[1].rstrip("/") or "/"


def _entries(folder: str, glob: str, nested: bool) -> Iterator[tuple[str, bool]]:
    """(path, is a folder) of a folder's files that match and, with ``nested``, of its folders; hidden ones are
    left out. Names stream: no folder is held whole."""
    with os.scandir(folder) as found:
        for e in found:
            if e.name.startswith("."):
                continue
            if e.is_dir():
                if nested:
                    yield e.path, True
            elif fnmatch.fnmatchcase(e.name, glob):
                yield e.path, False


def _paths(rows: Iterator[tuple[int, str, bool]], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    names, held = ["priority", "path", "folder"], []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), (pa.int32(), pa.string(), pa.bool_()))], names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), (pa.int32(), pa.string(), pa.bool_()))], names)


def list_named(spark: SparkSession, roots: dict[int, str], glob: str, nested: bool = False) -> DataFrame:
    """(priority, path) of the files below local or mounted folders, empty ones included; with ``nested`` also in
    folders below them. A task lists a root and streams its names; its folders are dealt to many tasks. Neither
    the driver nor a task holds a listing, and no file is opened."""
    schema = "priority int, path string, folder boolean"

    def top(batches):
        for b in batches:
            yield from _paths((i, p, d) for i, r in zip(b["priority"].to_pylist(), b["root"].to_pylist()) for p, d in _entries(r, glob, nested))

    def below(i: int, path: str, folder: bool) -> Iterator[tuple[int, str, bool]]:
        if not folder:
            yield i, path, False
            return
        for p, d in _entries(path, glob, True):
            yield from below(i, p, d)

    def walk(batches):
        for b in batches:
            yield from _paths(r for row in zip(*(c.to_pylist() for c in b.columns)) for r in below(*row))

    start = spark.createDataFrame([(i, local_path(r)) for i, r in roots.items()], "priority int, root string")
    files = start.repartition(max(len(roots), 1), "priority").mapInArrow(top, schema)
    if nested:
        files = files.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(walk, schema)
    return files.select("priority", "path")


def read_named(paths: DataFrame) -> DataFrame:
    """(path) → (path, content): the files' bytes, read by many tasks whatever their number and sizes."""
    spark = paths.sparkSession

    def read(batches):
        for b in batches:
            held, size = [], 0
            for path in b["path"].to_pylist():
                with open(path, "rb") as f:
                    held.append((path, f.read()))
                size += len(held[-1][1])
                if size >= 1 << 23:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.binary()))], ["path", "content"])
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.binary()))], ["path", "content"])

    return paths.select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(read, "path string, content binary")


def bmp(data, width: int, height: int):
    """Column of BMP file bytes for a column of top-down 24-bit BGR pixels of one size, four pixels wide or a
    multiple of that (rows need no padding)."""
    if width % 4:
        raise ValueError("widths that are no multiple of four need padding")
    size = 54 + 3 * width * height
    head = (b"BM" + size.to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + width.to_bytes(4, "little")
            + height.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24))
    rows = [F.substring(data, 3 * width * r + 1, 3 * width) for r in reversed(range(height))]
    return F.concat(F.lit(head), *rows)
