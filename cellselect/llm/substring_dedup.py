"""Repeated word windows across documents, found by level-wise doubling.

The first level takes short windows and asks, with short hashes, which of them two documents have.
Only places where both halves of a window of (at most) twice that length survive are extended; the
next level asks about those with full hashes, and so on until the wanted length is reached or no
candidate survives. At the wanted length the question is whether a document with a smaller id has
the window; the words it covers are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellselect.llm import chunks as C
from cellselect.llm.ngram_join import classes, word_keys
from cellselect.llm.words import words_of
from cellselect.session import shared_dir

_SIDE = ["chunk", "level", "bucket", "doc_id", "k1", "reply"]


def levels(window: int) -> list[int]:
    """Window lengths: about half of the wanted one, then doubled up to it."""
    return [window] if window < 4 else [-(-window // 2), window]


@dataclass
class _Level:
    """Windows of one length that are candidates: where they start and their place in ``keys``."""

    row: np.ndarray
    pos: np.ndarray
    keys: np.ndarray
    inverse: np.ndarray
    many: np.ndarray
    least: np.ndarray


class _Chunk:
    """The representative documents of a chunk and the answers known so far."""

    def __init__(self, docs: pa.Table, side: pa.Table, lower: bool):
        ask, told = side.filter(pa.compute.equal(side["level"], -1)), side.filter(pa.compute.greater(side["level"], -1))
        wanted = dict(zip(ask["doc_id"].to_pylist(), ask["k1"].to_pylist()))
        self.told = {}
        for level, bucket, reply in zip(*(told[c].to_pylist() for c in ("level", "bucket", "reply"))):
            self.told.setdefault(level, ([], []))
            self.told[level][0].append(bucket)
            self.told[level][1].append(reply)
        ids = docs["doc_id"].to_numpy()
        self.parts = []  # (Words, wanted rows in it, their doc ids)
        for row, stop, words in words_of(docs["text"].combine_chunks(), lower):
            k1 = words.whole().view(np.int64)
            mine = [i for i in range(stop - row) if wanted.get(int(ids[row + i])) == int(k1[i])
                    and wanted.pop(int(ids[row + i])) is not None]
            self.parts.append((words, np.array(mine, np.int64), ids[row:stop]))

    def level(self, length: int, shorter: tuple[int, list[np.ndarray]] | None) -> _Level:
        """Candidates of ``length``: all windows, or those whose two shorter windows survive."""
        hashes, rows, poss, owner = [], [], [], []
        for p, (words, mine, ids) in enumerate(self.parts):
            keep_doc = np.zeros(len(ids), bool)
            keep_doc[mine] = True
            h, doc, pos = words.windows(length)
            ok = keep_doc[doc]
            if shorter is not None:
                half, alive = shorter
                at = words.first[:-1][doc] + pos
                ok &= alive[p][at] & alive[p][at + length - half]
            hashes.append(h[ok])
            rows.append(words.first[:-1][doc[ok]] + pos[ok])
            poss.append(np.full(ok.sum(), p))
            owner.append(ids[doc[ok]])
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        keys, inverse = np.unique(hashes, return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, owner)
        most = np.full(len(keys), np.iinfo(np.int64).min)
        np.maximum.at(most, inverse, owner)
        self.owner = owner
        return _Level(np.concatenate(poss) if poss else np.zeros(0, int), np.concatenate(rows) if rows else np.zeros(0, int),
                      keys, inverse, (most > least), least)

    def marks(self, level: _Level, flags: np.ndarray) -> list[np.ndarray]:
        """Per part, which word positions start a flagged window."""
        out = [np.zeros(len(words.start) + 1, bool) for words, _, _ in self.parts]
        for p in range(len(self.parts)):
            mine = level.row == p
            out[p][level.pos[mine]] = flags[mine]
        return out


def _walk(chunk: _Chunk, lengths: list[int], buckets: int):
    """Replay the answered levels; gives the first unanswered level, or None and the final marks."""
    alive = None
    for i, length in enumerate(lengths):
        level = chunk.level(length, alive)
        if i not in chunk.told and not (i == 0 and not len(level.keys)):
            return i, level, None
        told = chunk.told.get(i, ([], []))
        hit = C.read_reply(*told, level.keys, buckets)
        if i + 1 == len(lengths):
            flags = hit[level.inverse] | (chunk.owner > level.least[level.inverse])
            return None, level, chunk.marks(level, flags)
        alive = (length, chunk.marks(level, hit[level.inverse]))
    return None, None, None


def _plan(docs: DataFrame, window: int, lower: bool, chunk_words: int, width: int):
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    keys = classes(word_keys(docs, lower)).checkpoint()
    words = keys.agg(F.sum("n_words")).first()[0] or 0
    n, buckets = C.plan(docs, words, chunk_words)
    lengths = levels(window)
    reps = keys.where((F.col("rep") == F.col("doc_id")) & (F.col("n_words") >= window))
    side = C.with_chunk(reps.select("doc_id", "k1"), n).select(
        "chunk", F.lit(-1).alias("level"), F.lit(-1).alias("bucket"), "doc_id", "k1", F.lit(None).cast("binary").alias("reply"))
    text = C.with_chunk(docs, n)
    for i in range(len(lengths)):
        last = i + 1 == len(lengths)
        postings = text.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(
            _sender(i, last, lengths, buckets, lower, width), C.POSTING)
        replies = C.seen_before(postings) if last else C.seen_elsewhere(postings, width)
        side = side.unionByName(replies.select("chunk", F.lit(i).alias("level"), "bucket", F.lit(None).cast("long").alias("doc_id"),
                                               F.lit(None).cast("long").alias("k1"), "reply"))
    return keys, text, side, lengths, n, buckets


def _sender(i: int, last: bool, lengths: list[int], buckets: int, lower: bool, width: int):
    def send(key, left, right):
        chunk = _Chunk(left, right, lower)
        at, level, _ = _walk(chunk, lengths, buckets)
        if at != i:  # nothing survived an earlier level in this chunk
            return C.POSTING_SCHEMA.empty_table()
        return C.post(key[0].as_py(), level.keys, level.least if last else level.many.astype(np.uint8), buckets,
                      8 if last else width)
    return send


def drop_repeats(docs: DataFrame, window: int = 13, lower: bool = False, chunk_words: int = 1_000_000,
                 width: int = 5) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per distinct doc_id.

    Removes each word covered by a ``window``-word window whose words also start in a document with a
    smaller doc_id; windows are judged on the input. ``kept_text`` joins the kept words by one space.
    Null or empty text has no words; texts under ``window`` words keep all. Rows without doc_id are
    left out, repeated rows give one result, a doc_id with several texts counts with one of them,
    other columns are ignored.
    """
    keys, text, side, lengths, n, buckets = _plan(docs, window, lower, chunk_words, width)
    own = C.with_chunk(keys.where("n_words > 0").select("doc_id", "k1", "rep", "n_words"), n).select(
        "chunk", F.lit(-2).alias("level"), F.lit(-1).alias("bucket"), "doc_id", "k1", F.lit(None).cast("binary").alias("reply"),
        (F.col("rep") < F.col("doc_id")).alias("copy"))
    side = side.withColumn("copy", F.lit(None).cast("boolean")).unionByName(own)

    def cut(key, left, right):
        mine = right.filter(pa.compute.equal(right["level"], -2))
        copy = dict(zip(mine["doc_id"].to_pylist(), zip(mine["k1"].to_pylist(), mine["copy"].to_pylist())))
        chunk = _Chunk(left, right, lower)
        _, _, marks = _walk(chunk, lengths, buckets)
        marks = marks or [np.zeros(len(w.start) + 1, bool) for w, _, _ in chunk.parts]
        out_id, out_words, out_removed, out_text = [], [], [], []
        for (words, rows, ids), mark in zip(chunk.parts, marks):
            step = np.zeros(len(words.start) + window + 1, np.int64)
            at = np.flatnonzero(mark)
            step[at] += 1
            step[at + window] -= 1
            gone = np.cumsum(step)[:len(words.start)] > 0
            k1 = words.whole().view(np.int64)
            raw = words.data.tobytes()
            for i, doc_id in enumerate(ids.tolist()):
                known = copy.get(doc_id)
                if known is None or known[0] != int(k1[i]):
                    continue
                del copy[doc_id]
                a, b = words.first[i], words.first[i + 1]
                drop = np.full(b - a, known[1] and b - a >= window) | gone[a:b]
                out_id.append(doc_id)
                out_words.append(b - a)
                out_removed.append(int(drop.sum()))
                out_text.append(b" ".join([raw[s:e] for s, e in zip(words.start[a:b][~drop].tolist(), words.end[a:b][~drop].tolist())]).decode())
        return pa.table({"doc_id": pa.array(out_id, pa.int64()), "n_words": pa.array(out_words, pa.int64()),
                         "n_removed": pa.array(out_removed, pa.int64()), "kept_text": pa.array(out_text, pa.large_string()).cast(pa.string())})

    done = text.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_text string")
    none = keys.where("n_words = 0").select("doc_id", F.lit(0).cast("long").alias("n_words"),
                                            F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text"))
    return done.unionByName(none)
