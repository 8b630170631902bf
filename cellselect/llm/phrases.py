"""Collocations: phrases of two to five words that occur oftener than their parts explain.

Every word of every text is a suffix pointer. Two counting passes (words, then pairs of words that are
common) show which leading words can still reach the wanted count; a suffix ends where its next pair
cannot. What is left is routed by its two leading words, so that all occurrences of a phrase meet in one
task, and sorted there by multikey three-way quicksort down to five words: the size of an equal
partition is the count of its phrase, and partitions below the wanted count are given up. Suffixes of a
leading pair so frequent that one task should not hold them are spread by all their words; their
partitions' sizes are then added up.

Both filters are bit arrays of a bounded size over all common words and pairs; a false hit only lets a
suffix travel that is given up later. Words are known by 64-bit hashes until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellselect.llm import words as W
from cellselect.session import shared_dir

LONGEST = 5
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
#: A-Z lowered; what ends a piece is a space to the word cutter.
_PLAIN = np.where(_BREAK, 32, W._LOWER).astype(np.uint8)
#: Bytes of text cut into words at once; the working arrays are some 60 times as large.
_BLOCK_BYTES = 1 << 19
#: Suffixes that a task gathers before it merges equal ones and sends them.
_FLUSH = 300_000
_FILTER_BITS = (1 << 16, 1 << 28)
_SUFFIX = [f"w{i}" for i in range(1, LONGEST + 1)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, W.Words, np.ndarray]]:
    """(row, key of the language, words, joined) of a batch: ``row`` and the key for every word; ``joined``
    where the next word stands in the same piece."""
    keys = batch["lang_key"].to_numpy().view(np.uint64)
    for first, stop, data, offsets in W.blocks(batch["text"], _BLOCK_BYTES):
        words = W.split(_PLAIN[data], offsets, False)
        row = np.repeat(np.arange(first, stop), words.counts)
        breaks = np.r_[0, np.cumsum(_BREAK[data])]
        joined = np.zeros(len(row), bool)
        joined[:-1] = (row[1:] == row[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])
        yield row, keys[row], words, joined


def _pair_keys(lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix((W.mix(lang ^ a) + b) * _STEP)


def _word_keys(lang: np.ndarray, a: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(lang) + a)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, n): occurrences of every word."""
    def run(batches):
        for batch in batches:
            lang = batch["lang"]
            for row, key, words, _ in _blocks(batch):
                _, at, n = np.unique(_word_keys(key, words.hash), return_index=True, return_counts=True)
                size = words.end[at] - words.start[at]
                ends = np.cumsum(size)
                text = words.data[np.repeat(words.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
                spelt = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
                yield pa.record_batch([lang.take(pa.array(row[at])), spelt, pa.array(words.hash[at].view(np.int64)), pa.array(n)],
                                      names=["lang", "word", "hash", "n"])

    return docs.mapInArrow(run, "lang string, word string, hash long, n long").groupBy("lang", "word").agg(
        F.first("hash").alias("hash"), F.sum("n").alias("n"))


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits over (key), 16 a key within the bounds; two are set for each key. Built in blocks."""
    bits = int(np.clip(1 << (16 * max(keys.count(), 1) - 1).bit_length(), *_FILTER_BITS))
    block = min(bits, 1 << 22)

    def spots(batches):
        for batch in batches:
            at = np.concatenate(_spots(batch["key"].to_numpy().view(np.uint64), bits))
            yield pa.record_batch([pa.array((at // block).astype(np.int64)), pa.array(at % block)], names=["block", "at"])

    def pack(key, rows):
        flags = np.zeros(block, bool)
        flags[rows["at"].to_numpy()] = True
        return pa.table({"block": [key[0].as_py()], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    spread = keys.select("key").mapInArrow(spots, "block long, at long").distinct()
    for r in spread.groupBy("block").applyInArrow(pack, "block long, bits binary").toLocalIterator():
        out[r["block"] * (block // 8):(r["block"] + 1) * (block // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _spots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h & np.uint64(bits - 1)).astype(np.int64) for h in (W.mix(keys), W.mix(keys ^ _STEP))]


def _probe(data: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for at in _spots(keys, 8 * len(data)):
        hit &= (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def _common_pairs(key: np.ndarray, words: W.Words, joined: np.ndarray, word_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the pairs inside a piece whose words both may be common."""
    known = _probe(word_bits, _word_keys(key, words.hash))
    at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:])
    return at, _pair_keys(key[at], words.hash[at], words.hash[at + 1])


def count_pairs(docs: DataFrame, word_bits: np.ndarray) -> DataFrame:
    """(key, n): occurrences of every pair of common words inside a piece."""
    shared = docs.sparkSession.sparkContext.broadcast(word_bits)

    def run(batches):
        for batch in batches:
            for _, key, words, joined in _blocks(batch):
                keys, n = np.unique(_common_pairs(key, words, joined, shared.value)[1], return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select("lang_key", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, word_bits: np.ndarray, pair_bits: np.ndarray, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, rows): suffixes of two to five words, equal ones of a flush merged, as the columns of an
    unsigned 64-bit matrix (language, words, 0 for none, weight). Buckets from ``buckets`` on hold suffixes
    that start with one of the ``hot`` pairs, dealt by all their words."""
    shared = docs.sparkSession.sparkContext.broadcast((word_bits, pair_bits, hot))

    def cut(key, words, joined):
        word_bits, pair_bits, hot = shared.value
        at, keys = _common_pairs(key, words, joined, word_bits)
        good = np.zeros(len(words.hash) + LONGEST, bool)
        ok = _probe(pair_bits, keys)
        good[at[ok]] = True
        at, keys = at[ok], keys[ok]
        rows = np.zeros((len(at), LONGEST + 2), np.uint64)
        rows[:, 0], rows[:, 1], rows[:, -1] = key[at], words.hash[at], 1
        alive, code = np.ones(len(at), bool), W.mix(key[at] + words.hash[at])
        for d in range(1, LONGEST):
            alive = alive & good[at + d - 1]
            rows[alive, d + 1] = words.hash[at[alive] + d]
            code = W.mix(code * _STEP + rows[:, d + 1])
        spot = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
        is_hot = hot[spot] == keys if len(hot) else np.zeros(len(keys), bool)
        route = np.where(is_hot, code, keys) % np.uint64(buckets) + np.where(is_hot, np.uint64(buckets), np.uint64(0))
        return rows, code, route

    def flush(parts):
        rows, code, route = (np.concatenate(x) for x in zip(*parts))
        _, at, place = np.unique(code, return_index=True, return_inverse=True)
        weight = np.bincount(place, weights=rows[:, -1].astype(np.int64), minlength=len(at)).astype(np.uint64)
        order = np.argsort(route[at], kind="stable")
        rows, route = rows[at[order]], route[at[order]]
        rows[:, -1] = weight[order]
        edge = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
        packed = [np.ascontiguousarray(x.T).tobytes() for x in np.split(rows, edge[1:])]
        return pa.record_batch([pa.array(route[edge].astype(np.int64)), pa.array(packed, pa.binary())], names=["bucket", "rows"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, key, words, joined in _blocks(batch):
                parts.append(cut(key, words, joined))
                held += len(parts[-1][1])
                if held >= _FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return docs.select("lang_key", "text").mapInArrow(run, "bucket long, rows binary")


def quicksort_counts(columns: np.ndarray, least: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, words, count) of every phrase: multikey three-way quicksort of pointers to the columns of
    ``columns`` (language, words, weight), depth 0 being the language.

    A partition around a pivot symbol falls into smaller, equal and larger; the equal one goes on at the
    next word. Partitions lighter than ``least`` are given up, unless ``whole`` is false: then only those of
    full length, as the others' missing parts lie in other tasks.
    """
    symbols, weight = columns[:-1], columns[-1].astype(np.int64)
    length = (symbols[1:] != 0).sum(0)
    found: list[tuple[int, int, int]] = []
    stack = [(np.arange(columns.shape[1]), 0)]
    while stack:
        pointers, depth = stack.pop()
        floor = least if whole or depth == LONGEST else 1
        column = symbols[depth][pointers]
        pivot = np.sort(column[:: max(1, len(column) // 9)])
        pivot = pivot[len(pivot) // 2]
        same = column == pivot
        equal = pointers[same]
        n = int(weight[equal].sum())
        if n >= floor:
            if depth > 1:
                found.append((int(equal[0]), depth, n))
            if depth < LONGEST:
                longer = equal[length[equal] > depth]
                if len(longer) and int(weight[longer].sum()) >= (least if whole or depth + 1 == LONGEST else 1):
                    stack.append((longer, depth + 1))
        if len(equal) < len(pointers):
            below = column < pivot
            for side in (pointers[below], pointers[~below & ~same]):
                if len(side) and int(weight[side].sum()) >= floor:
                    stack.append((side, depth))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def frequent_phrases(routed: DataFrame, least: int, buckets: int) -> DataFrame:
    """(lang_key, words, n): phrases of two to five words (as hashes) that occur ``least`` times or more."""
    def mine(key, table):
        parts = [np.frombuffer(x, np.uint64).reshape(LONGEST + 2, -1) for x in table["rows"].to_pylist()]
        columns = np.concatenate(parts, 1)
        at, depth, n = quicksort_counts(columns, least, key[0].as_py() < buckets)
        out = columns[:-1, at].copy()
        for d in range(1, LONGEST + 1):
            out[d, depth < d] = 0
        return pa.table([pa.array(c.view(np.int64)) for c in out] + [pa.array(n)], names=["lang_key", *_SUFFIX, "n"])

    rows = routed.groupBy("bucket").applyInArrow(mine, "lang_key long, " + ", ".join(f"{c} long" for c in _SUFFIX) + ", n long")
    return (rows.groupBy("lang_key", *_SUFFIX).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            .select("lang_key", F.filter(F.array(*_SUFFIX), lambda w: w != 0).alias("words"), "n"))


def collocations(docs: DataFrame, least: int = 100, top: int | None = 2000, hot_weight: int = 1 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` collocations (all with None).

    Texts are lower-cased (A-Z), cut at ``. , ; : ! ?`` and U+000A..U+000D into pieces, and pieces at spaces
    and tabs into words; ``n`` counts a language's words, and a phrase's count its contiguous occurrences
    within pieces. Candidates are phrases of two to five words with ``least`` occurrences (a). A cut into two
    parts with counts l and r scores floor(1000 a n / (l r)), in exact arithmetic of 38 digits; the lowest
    cut counts, ties at the shortest first part. A candidate inside a longer one that is as frequent is left
    out. Ranked by score, a (both falling) and the phrase's bytes.

    Null lang is ``und``; null, empty and wordless texts add nothing; ids and other columns are not looked at,
    so every row counts, repeated ones each time. An empty table has no collocations.
    """
    shared_dir(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.col("text").cast("string").alias("text"))
    every = count_words(docs).checkpoint()
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))  # one row per language
    words = every.where(F.col("n") >= least).select("lang", F.xxhash64("lang").alias("lang_key"), "word", "hash", "n").checkpoint()
    word_bits = bit_filter(_keyed(words))
    pairs = count_pairs(docs, word_bits).where(F.col("n") >= least).checkpoint()
    pair_bits = bit_filter(pairs)
    size, in_pairs = (r[0] or 0 for r in (every.agg(F.sum("n")).first(), pairs.agg(F.sum("n")).first()))
    heavy = pairs.where(F.col("n") > max(hot_weight, size >> 12)).toArrow()["key"].to_numpy().view(np.uint64)  # under 4,096 pairs
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), in_pairs >> 20)
    found = frequent_phrases(suffixes(docs, word_bits, pair_bits, np.sort(heavy), buckets), least, buckets).checkpoint()
    return _ranked(found, words, totals, top)


def _keyed(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(_word_keys(*(batch[c].to_numpy().view(np.uint64) for c in ("lang_key", "hash"))).view(np.int64))], names=["key"])

    return words.select("lang_key", "hash").mapInArrow(run, "key long")


def _ranked(found: DataFrame, words: DataFrame, totals: DataFrame, top: int | None) -> DataFrame:
    """Scores, containment, spelling and ranks of the candidates (lang_key, words, n)."""
    size, w = F.size("words"), F.col("words")
    counts = found.unionByName(words.select("lang_key", F.array("hash").alias("words"), "n"))
    gone = (found.where(size > 2).select("lang_key", "n", F.explode(F.array(F.slice(w, F.lit(1), size - 1), F.slice(w, F.lit(2), size - 1))).alias("words"))
            .distinct())
    left = found.join(gone, ["lang_key", "words", "n"], "left_anti").withColumnRenamed("n", "a")
    cuts = (left.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
            .withColumn("head", F.slice(w, F.lit(1), F.col("k"))).withColumn("tail", F.slice(w, F.col("k") + 1, size - F.col("k"))))
    part = lambda side, name: counts.select(F.col("lang_key").alias("lk"), F.col("words").alias(side), F.col("n").alias(name))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(part(side, name).withColumnRenamed(side, "part"), F.expr(f"lang_key = lk and {side} = part")).drop("lk", "part", side)
    spell = words.select("lang_key", "hash", "lang", "word")
    named = (left.select("lang_key", "words", F.posexplode("words").alias("i", "hash")).join(spell, ["lang_key", "hash"])
             .groupBy("lang_key", "words").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelt"))
             .select("lang_key", "words", "lang", F.array_join(F.col("spelt.word"), " ").alias("phrase")))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (cuts.join(named, ["lang_key", "words"]).join(totals, "lang")
              .withColumn("up", (F.lit(1000).cast("decimal(4,0)") * exact("a")).cast("decimal(19,0)") * exact("n"))
              .withColumn("down", exact("l") * exact("r")).withColumn("score", F.expr("up div down"))
              .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
              .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # the best of every slice first, so that no task ranks all of a language
        scored = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(32)))
        scored = (scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order)))
                  .where(F.col("rank") <= top).drop("slice", "rank"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (out if top is None else out.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
