"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are taken over all training rows, quantised to powers of two, and an
n-gram of level q enters the filter q times, as (n-gram, 1) .. (n-gram, q). A reader probes level
after level until one is missing: frequent n-grams need more probes, rare ones one. The filter is cut
by hash range into parts, one per counting task, and its total size is bounded by ``filter_bits``:
where the n-grams do not fit, a part holds the frequent levels only, and the level of every rarer
n-gram goes back to the chunks that ask for it. No counted n-gram is missing from a score. The whole
filter is broadcast; scores come from interpolated probabilities of pairs and words.

Counting works on chunks (see ``chunks``): a chunk sends each distinct word and pair once, with its
training count (0 for those of held-out rows alone). Of words it learns the exact total, of pairs,
which travel as 5-byte short hashes, the levels that their part has left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellselect.llm import chunks as C
from cellselect.llm.langid import held_out
from cellselect.llm.words import _range_hash, mix, words_of
from cellselect.session import shared_dir

WORDS, PAIRS = 0, 1
_SHORT = np.uint64((1 << 40) - 1)
_END = np.uint64(0x2545F4914F6CDD1D)
_PAIR_BASE = 0xC2B2AE3D27D4EB4F
_OUT = "kind int, chunk int, bucket int, reply binary, number long, distinct long"


@dataclass
class _Tokens:
    """Tokens of a chunk: words, and one end after each document."""

    row: np.ndarray       # document of each token
    token: np.ndarray     # hash of each token
    pair: np.ndarray      # hash of (token before, token); the document's start stands before the first
    ids: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> _Tokens:
        tokens, pairs, rows = [], [], []
        for row, stop, words in words_of(table["text"].combine_chunks(), True):
            n = words.counts
            token = np.full(len(words.hash) + stop - row, _END, np.uint64)
            doc = np.repeat(np.arange(stop - row), n)
            token[np.arange(len(doc)) + doc] = words.hash
            before = np.r_[_END, token[:-1]]
            pairs.append(_range_hash(np.stack([before, token], 1).ravel(), 2 * np.arange(len(token)), 2 * np.arange(len(token)) + 2, _PAIR_BASE))
            tokens.append(token)
            rows.append(np.repeat(np.arange(row, stop), n + 1))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return _Tokens(cat(rows, np.int64), cat(tokens, np.uint64), cat(pairs, np.uint64), table["doc_id"].to_pylist(),
                       table["held_out"].to_numpy())


def _post(chunk: int, kind: int, keys: np.ndarray, count: np.ndarray, buckets: int) -> pa.Table:
    """Postings with compressed counts: most are 1."""
    width = 8 if kind == WORDS else 5
    rows = C.post(chunk, keys, count.astype(np.int64), buckets, width)
    pack = zstandard.ZstdCompressor(level=1)
    vals = pa.array([pack.compress(v) for v in rows["vals"].to_pylist()], pa.binary())
    return pa.table([pa.array([kind] * rows.num_rows, pa.int32()), rows["chunk"], rows["bucket"], rows["keys"], vals],
                    names=["kind", "chunk", "bucket", "keys", "vals"])


def _count(table: pa.Table, width: int):
    unpack = zstandard.ZstdDecompressor()
    sizes, order, starts, group = C._merged(table, width)
    vals = np.concatenate([np.frombuffer(unpack.decompress(v), np.int64) for v in table["vals"].to_pylist()])
    total = np.add.reduceat(vals[order], starts)
    return sizes, order, starts, group, total


def level(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, 2 for 2..3, 3 for 4..7 and so on; 0 for none."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def level_count(q: np.ndarray) -> np.ndarray:
    """Count a level stands for: the middle (on a log scale) of its counts."""
    return np.where(q > 1, 2.0 ** (q - 0.5), q.astype(float))


def _places(keys: np.ndarray, q: int, bits: int, probes: int) -> np.ndarray:
    """Bit places of (key, q): one row per probe, by double hashing."""
    a = mix(keys ^ np.uint64(q * 0x9FB21C651E98DF25 % 2**64))
    b = mix(a ^ np.uint64(0x6C62272E07BB0142)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(probes)])


def build_part(keys: np.ndarray, count: np.ndarray, most_bits: int, bits_per_item: int, probes: int) -> bytes:
    """One part of the filter: 8 bytes lowest level kept, then the bits."""
    q = level(count)
    least = 1
    while int(np.maximum(q - least + 1, 0).sum()) * bits_per_item > most_bits:
        least += 1
    items = int(np.maximum(q - least + 1, 0).sum())
    bits = max(64, -(-items * bits_per_item // 64) * 64)
    flags = np.zeros(bits, bool)
    for at in range(least, int(q.max(initial=0)) + 1):
        flags[_places(keys[q >= at], at, bits, probes)] = True
    return np.int64(least).tobytes() + np.packbits(flags).tobytes()


def least_level(part: bytes) -> int:
    return int(np.frombuffer(part[:8], np.int64)[0])


def below(part: bytes, q: np.ndarray) -> np.ndarray:
    """How far a level lies below the lowest one of the part; 0: the part knows it."""
    return np.maximum(least_level(part) - q, 0).astype(np.uint8)


@dataclass
class Filter:
    """Log-frequency Bloom filter in parts by hash range."""

    parts: dict[int, bytes]
    buckets: int
    probes: int
    tokens: int
    distinct: int

    def left_out(self, keys: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Codes of ``below`` for sorted keys of levels ``q``."""
        cut = np.searchsorted(C.bucket_of(keys, self.buckets), np.arange(self.buckets + 1))
        out = np.zeros(len(keys), np.uint8)
        for b, part in self.parts.items():
            out[cut[b]:cut[b + 1]] = below(part, q[cut[b]:cut[b + 1]])
        return out

    def levels(self, keys: np.ndarray, left_out: np.ndarray | None = None) -> np.ndarray:
        """Level of each 64-bit hash: the last of the levels found one after the other, 0 for none;
        where ``left_out`` (codes of ``below``) is not 0, the level it tells."""
        found = np.zeros(len(keys), np.int64)
        order = np.argsort(keys, kind="stable")
        cut = np.searchsorted(C.bucket_of(keys[order], self.buckets), np.arange(self.buckets + 1))
        for b, part in self.parts.items():
            mine = order[cut[b]:cut[b + 1]]
            if not len(mine):
                continue
            at, data = least_level(part), np.frombuffer(part, np.uint8, offset=8)
            if left_out is not None:
                found[mine] = np.where(left_out[mine] > 0, at - left_out[mine].astype(np.int64), 0)
                mine = mine[left_out[mine] == 0]
            while len(mine):
                spots = _places(keys[mine] & _SHORT, at, 8 * len(data), self.probes)
                hit = np.ones(len(mine), bool)
                for row in spots:
                    hit &= (data[row >> np.uint64(3)] >> (np.uint8(7) - (row & np.uint64(7)).astype(np.uint8))) & 1 == 1
                mine = mine[hit]
                found[mine] = at
                at += 1
        return found


def _gather(text: DataFrame, buckets: int, most_bits: int, bits_per_item: int, probes: int) -> DataFrame:
    """Per chunk and bucket the exact word totals and, where the part has left out levels, the codes of
    the pairs; per bucket the filter part and the sums."""

    def send(key, table):
        tokens = _Tokens.of(table)
        train = ~tokens.held[tokens.row]
        words, at = np.unique(tokens.token, return_inverse=True)
        counts = np.bincount(at, weights=train, minlength=len(words))
        pairs, at = np.unique(tokens.pair, return_inverse=True)
        n = np.bincount(at, weights=train, minlength=len(pairs))
        return pa.concat_tables([_post(key[0].as_py(), WORDS, words, counts, buckets), _post(key[0].as_py(), PAIRS, pairs, n, buckets)])

    def merge(key, table):
        kind, bucket = key[0].as_py(), key[1].as_py()
        sizes, order, starts, group, total = _count(table, 8 if kind == WORDS else 5)
        if kind == WORDS:
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])[order[starts]] & _SHORT
        else:
            raw = np.zeros((len(order), 8), np.uint8)
            raw[:, :5] = np.concatenate([np.frombuffer(x, np.uint8) for x in table["keys"].to_pylist()]).reshape(-1, 5)
            keys = raw.view(np.uint64).ravel()[order[starts]]
        part = build_part(keys, total, most_bits // (2 * buckets), bits_per_item, probes)
        replies, chunk = [], []
        if kind == WORDS or least_level(part) > 1:
            told = total if kind == WORDS else below(part, level(total))
            out = np.empty(len(order), told.dtype)
            out[order] = told[group]
            pack = zstandard.ZstdCompressor(level=1)
            replies = [pack.compress(x.tobytes()) for x in np.split(out, np.cumsum(sizes)[:-1])]
            chunk = table["chunk"].to_pylist()
        rows = len(replies)
        return pa.table({
            "kind": pa.array([kind] * (rows + 1), pa.int32()), "chunk": pa.array([*chunk, -1], pa.int32()),
            "bucket": pa.array([bucket] * (rows + 1), pa.int32()), "reply": pa.array([*replies, part], pa.binary()),
            "number": pa.array([0] * rows + [int(total.sum())], pa.int64()),
            "distinct": pa.array([0] * rows + [int((total > 0).sum())], pa.int64())})

    postings = text.groupBy("chunk").applyInArrow(send, "kind int, chunk int, bucket int, keys binary, vals binary")
    return postings.groupBy("kind", "bucket").applyInArrow(merge, _OUT)


def _score(tokens: _Tokens, c1: np.ndarray, c2: np.ndarray, words: Filter, weight: float):
    """log10 P(token | token before): interpolation of the pair's and the word's share, both from
    levels. A pair never counts more than the word before it."""
    before = np.r_[c1[-1:], c1[:-1]]  # the end of the document before stands where a document starts
    one = (c1 + 1) / (words.tokens + words.distinct + 1)
    two = np.where(before > 0, np.minimum(c2, before) / np.maximum(before, 1), 0.0)
    seen = before > 0
    return np.log10(np.where(seen, weight * two + (1 - weight) * one, one))


def score(docs: DataFrame, modulus: int = 7, rest: int = 2, weight: float = 0.6, filter_bits: int = 1 << 28,
          bits_per_item: int = 10, probes: int = 4, chunk_words: int = 1_500_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Learns from the rows outside the held-out part (crc32 of the doc_id modulo ``modulus`` is ``rest``).
    Tokens: words with A-Z lowered, then one end. ``base_score`` uses exact add-one word shares,
    ``score`` the filter's. Null text is empty (its end is scored); a null doc_id counts as training
    text; repeated rows count and are scored as often as they occur; other columns are ignored. Without
    training tokens every share is 1. The broadcast filter has at most about ``filter_bits`` bits;
    n-grams that do not fit are scored by the levels sent to each chunk.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text", held_out(modulus, rest).alias("held_out"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n, buckets = C.plan(docs, chars // 6, chunk_words)
    text = C.with_chunk(docs, n)
    gathered = _gather(text, buckets, filter_bits, bits_per_item, probes).checkpoint()
    parts = gathered.where("chunk < 0").select("kind", "bucket", "reply", "number", "distinct").collect()  # bounded by filter_bits
    filters = [Filter({r["bucket"]: bytes(r["reply"]) for r in parts if r["kind"] == k}, buckets, probes,
                      sum(r["number"] for r in parts if r["kind"] == k), sum(r["distinct"] for r in parts if r["kind"] == k))
               for k in (WORDS, PAIRS)]
    shared = spark.sparkContext.broadcast(filters)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def rate(key, left, right):
        words, pairs = shared.value
        tokens = _Tokens.of(left)
        unpack = zstandard.ZstdDecompressor()

        def told(kind, keys, dtype):
            mine = right.filter(pa.compute.equal(right["kind"], kind))
            return C.read_reply(mine["bucket"].to_pylist(), [unpack.decompress(x) for x in mine["reply"].to_pylist()], keys, buckets, dtype)

        keys, at = np.unique(tokens.token, return_inverse=True)
        total_of = told(WORDS, keys, np.int64)
        count = total_of[at]
        base = np.log10((count + 1) / (words.tokens + words.distinct + 1))
        c1 = level_count(words.levels(keys, words.left_out(keys, level(total_of))))[at]
        keys, at = np.unique(tokens.pair, return_inverse=True)
        c2 = level_count(pairs.levels(keys, told(PAIRS, keys, np.uint8)))[at]
        model = _score(tokens, c1, c2, words, weight)
        rows = left.num_rows
        total = lambda w: np.bincount(tokens.row, weights=w, minlength=rows)
        return pa.table({
            "doc_id": left["doc_id"], "held_out": left["held_out"],
            "n_tokens": pa.array(np.bincount(tokens.row, minlength=rows), pa.int64()),
            "n_known": pa.array(total(count > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, words.tokens), pa.int64()),
            "base_score": pa.array(total(base)), "score": pa.array(total(model))})

    replies = gathered.where("chunk >= 0").select("chunk", "kind", "bucket", "reply")
    return text.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(rate, schema)
