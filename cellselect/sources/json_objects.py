"""One large JSON file read by many tasks: cut into the objects of its top-level arrays.

Spark's text reader cuts the file after closing braces, in splits that any store can serve. Where a
split starts, nobody knows yet whether it stands inside a string or how deep; so a first pass tells for
each split what it does to both under either assumption, these few numbers are put together in file
order, and the second pass cuts the objects out. Only objects that cross splits are put together after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HEAD, _MIDDLE, _TAIL, _WHOLE = range(4)
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """((file, split), bytes) of consecutive rows of one split, their braces put back."""
    for batch in batches:
        keys = list(zip(batch["path"].to_pylist(), batch["split"].to_pylist()))
        texts = batch["value"].cast(pa.binary()).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], np.frombuffer(b"}".join([*texts[start:i], b""]), np.uint8)
                start = i


def _quotes(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a quote that no backslash escapes. A split ends after a brace, never in an escape."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != 92, at, -1))  # last byte up to here that is no backslash
    run = np.zeros(len(data), np.int64)
    run[1:] = (at - plain)[:-1]
    return (data == 34) & (run % 2 == 0)


def json_objects(spark: SparkSession, path: str, depth: int = 2) -> DataFrame:
    """(path, value): text of every object that opens at nesting ``depth`` (2: the elements of arrays in the root
    object, and objects inside objects there; choose among them by their fields).

    Files are whole JSON documents of any size, on any number of lines. A file that ends inside an object
    or a string is an error.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))

    def effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, outside, inside = None, 0, 0, 0

        def told():
            return pa.record_batch([pa.array([x]) for x in (*now, odd, outside, inside)], names=["path", "split", "odd", "outside", "inside"])

        for key, data in _runs(batches):
            if key != now:
                if now is not None:
                    yield told()
                now, odd, outside, inside = key, 0, 0, 0
            quoted = (odd + np.cumsum(_quotes(data))) % 2 == 1
            step = _STEP[data]
            outside, inside = outside + int(step[~quoted].sum()), inside + int(step[quoted].sum())
            odd = int(quoted[-1]) if len(data) else odd
        if now is not None:
            yield told()

    starts: dict[tuple[str, int], tuple[int, int]] = {}
    file = None
    for r in sorted(rows.mapInArrow(effect, "path string, split long, odd long, outside long, inside long").collect()):  # a row per split
        if r["path"] != file:
            file, quoted, level = r["path"], 0, 0
        starts[r["path"], r["split"]] = (quoted, level)
        level += r["inside"] if quoted else r["outside"]
        quoted ^= r["odd"]
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, began = None, [], False

        def out(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            kinds, texts = zip(*found)
            return pa.record_batch([pa.array([now[0]] * len(found)), pa.array([now[1]] * len(found), pa.int64()), pa.array(kinds, pa.int32()),
                                    pa.array([t.decode("utf-8") for t in texts])], names=["path", "split", "kind", "value"])

        for key, data in _runs(batches):
            if key != now:
                if held:
                    yield out([(_TAIL if began else _MIDDLE, b"".join(held))])
                now = key
                quoted, level = shared.value[key]
                open_, held, began = level > depth, [], False
            strings = (quoted + np.cumsum(_quotes(data))) % 2 == 1
            step = np.where(strings, 0, _STEP[data])
            after = level + np.cumsum(step)
            edges = np.flatnonzero(((data == 123) & (step == 1) & (after == depth + 1)) | ((data == 125) & (step == -1) & (after == depth)))
            raw, at, found = data.tobytes(), 0, []
            for i in edges.tolist():
                if raw[i] == 123:
                    at, open_, began = i, True, True
                elif open_:
                    found.append((_WHOLE if began else _HEAD, b"".join([*held, raw[at:i + 1]])))
                    open_, held, began = False, [], True
            if open_:
                held.append(raw[at:])
            if len(data):
                quoted, level = int(strings[-1]), int(after[-1])
            if found:
                yield out(found)
        if held:
            yield out([(_TAIL if began else _MIDDLE, b"".join(held))])

    parts = rows.mapInArrow(cut, "path string, split long, kind int, value string")
    before = Window.partitionBy("path").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, -1)
    crossing = parts.where(F.col("kind") < _WHOLE).withColumn(  # a piece or two per split
        "first", F.last(F.when(F.col("kind") == _TAIL, F.col("split")), True).over(before))
    crossing = crossing.withColumn("first", F.when(F.col("kind") == _TAIL, F.col("split")).otherwise(F.col("first")))
    joined = crossing.groupBy("path", "first").agg(F.sort_array(F.collect_list(F.struct("split", "kind", "value"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["value"]), "")
    ended = F.exists("p", lambda x: x["kind"] == _HEAD)
    value = F.when(ended, whole).otherwise(F.raise_error(F.concat(F.lit("the file ends inside an object: "), F.col("path"))).cast("string"))
    return parts.where(F.col("kind") == _WHOLE).select("path", "value").unionByName(joined.select("path", value.alias("value")))
