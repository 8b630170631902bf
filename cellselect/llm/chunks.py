"""Global facts about hashed keys, joined back to the documents they come from.

Documents are dealt by a hash of their id into chunks of a bounded text size. A chunk reduces its keys
to one sorted distinct list (so a key that a third of all rows hold counts once per chunk), cut by
hash range into buckets. One task per bucket merges the lists and answers each chunk in the order of
its own list: with a bit ("some other chunk has it too"), a total or "an earlier document has it".
The chunk reads its documents again and lays the answer over the same list. Rows are few and wide
(chunks x buckets), answers need no keys, and nothing depends on task placement.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTING = "chunk int, bucket int, keys binary, vals binary"
REPLY = "chunk int, bucket int, reply binary"
POSTING_SCHEMA = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
REPLY_SCHEMA = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("reply", pa.binary())])


def plan(df: DataFrame, size: int, chunk_size: int) -> tuple[int, int]:
    """(chunks, buckets) for data of ``size`` units, at least as many as the session's shuffle partitions.

    A chunk holds ``chunk_size`` units, or more where the data is so large that a chunk would have only
    a handful of keys for each bucket: chunks then grow with the square root of the data, and rows of
    (chunk, bucket) keep some twenty keys each. A bucket holds about four chunks' worth of keys.
    """
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    per_chunk = max(chunk_size, int(10 * max(size, 1) ** 0.5))
    return max(least, -(-int(size) // per_chunk)), max(least, -(-int(size) // (4 * per_chunk)))


def with_chunk(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return df.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Hash range of each 64-bit key; grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def post(chunk: int, keys: np.ndarray, vals: np.ndarray | None, buckets: int, width: int = 8) -> pa.Table:
    """Posting rows of one chunk's sorted distinct keys; ``width`` low bytes of a key are sent."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    raw = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    wide = 0 if vals is None else vals.dtype.itemsize
    data = b"" if vals is None else vals.tobytes()
    some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    return pa.table({
        "chunk": pa.array([chunk] * len(some), pa.int32()),
        "bucket": pa.array(some, pa.int32()),
        "keys": pa.array([raw[cut[b] * width:cut[b + 1] * width] for b in some], pa.binary()),
        "vals": pa.array([data[cut[b] * wide:cut[b + 1] * wide] for b in some], pa.binary()),
    }, schema=POSTING_SCHEMA)


def _merged(table: pa.Table, width: int):
    parts = [np.frombuffer(x, np.uint8) for x in table["keys"].to_pylist()]
    sizes = np.array([len(p) // width for p in parts])
    raw = np.concatenate(parts).reshape(-1, width)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :width] = raw
    keys = keys.view(np.uint64).ravel()
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.cumsum(new) - 1
    return sizes, order, np.flatnonzero(new), group


def _answer(table: pa.Table, sizes: np.ndarray, values: list[bytes]) -> pa.Table:
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "reply": pa.array(values, pa.binary())},
                    schema=REPLY_SCHEMA)


def _vals(table: pa.Table, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in table["vals"].to_pylist()])


def seen_elsewhere(postings: DataFrame, width: int) -> DataFrame:
    """One bit per key: two or more chunks have it, or one that has it in several documents (its
    ``vals`` byte is 1). With a ``width`` under 8 a bit may be set without cause, never missing."""

    def merge(table: pa.Table) -> pa.Table:
        sizes, order, starts, group = _merged(table, width)
        many = np.maximum.reduceat(_vals(table, np.uint8)[order], starts) > 0
        many |= np.diff(np.r_[starts, len(order)]) > 1
        flags = np.empty(len(order), bool)
        flags[order] = many[group]
        return _answer(table, sizes, [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])])

    return postings.groupBy("bucket").applyInArrow(merge, REPLY)


def totals(postings: DataFrame) -> DataFrame:
    """The sum over all chunks of each key's ``vals`` (int64), as int64."""

    def merge(table: pa.Table) -> pa.Table:
        sizes, order, starts, group = _merged(table, 8)
        total = np.add.reduceat(_vals(table, np.int64)[order], starts)
        out = np.empty(len(order), np.int64)
        out[order] = total[group]
        return _answer(table, sizes, [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])])

    return postings.groupBy("bucket").applyInArrow(merge, REPLY)


def seen_before(postings: DataFrame) -> DataFrame:
    """One bit per key: another chunk has it in a document with a smaller id than this chunk's
    smallest (``vals``, int64)."""

    def merge(table: pa.Table) -> pa.Table:
        sizes, order, starts, group = _merged(table, 8)
        ids = _vals(table, np.int64)
        least = np.minimum.reduceat(ids[order], starts)
        flags = np.empty(len(order), bool)
        flags[order] = least[group] < ids[order]
        return _answer(table, sizes, [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])])

    return postings.groupBy("bucket").applyInArrow(merge, REPLY)


def read_reply(buckets: list[int], replies: list[bytes], keys: np.ndarray, n_buckets: int, dtype=None) -> np.ndarray:
    """The answer for each of the chunk's sorted distinct keys: bits (``dtype`` None) or numbers."""
    cut = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
    out = np.zeros(len(keys), bool if dtype is None else dtype)
    for b, reply in zip(buckets, replies):
        n = cut[b + 1] - cut[b]
        raw = np.frombuffer(reply, np.uint8 if dtype is None else dtype)
        out[cut[b]:cut[b + 1]] = np.unpackbits(raw, count=n) if dtype is None else raw
    return out
