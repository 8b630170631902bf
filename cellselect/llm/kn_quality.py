"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model learns from three quarters of the trusted documents over the words of that part.
It is kept as counts of triples and pairs, cut into shards by the two leading words, so that a triple
and the pair it begins with lie together. Documents, as arrays of word numbers, are dealt into chunks; a
chunk asks each shard once about its distinct pairs and the words that follow them there, and gets counts
back, small numbers from which it works out discounted probabilities and back-off weights; so a frequent n-gram counts once per chunk. A Bloom filter over the model's keys keeps questions without an
answer from travelling; too small a filter only lets more of them through. A quarter of the documents goes
through at a time, which bounds the disk that questions and answers take. A document passes where its
perplexity is at most a quantile of its language's trusted documents that the model has not seen.

Words are numbered by falling frequency, so their numbers are short; sorted keys travel as a trie and all
numbers of a list byte plane by byte plane, compressed. Keys are made of word numbers, not hashes: no two
n-grams share one. Word numbers have 16 bits in a key, or 21 where the vocabulary needs them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellselect.llm import chunks as C
from cellselect.llm.words import mix, words_of
from cellselect.session import scratch_path, shared_dir

UNKNOWN, START, STOP, FIRST_WORD = 0, 1, 2, 3
#: Most words that 21-bit numbers can tell apart.
MOST_WORDS = (1 << 21) - FIRST_WORD
#: Summed counts of a shard: see ``_trie`` and ``_packed``.
_COUNTS = "bucket int, keys binary, n binary"
_QUESTION = "chunk int, bucket int, pairs binary, many binary, last binary"
_ANSWER = "chunk int, bucket int, pairs binary, ones binary, twos binary, more binary, excess binary, triples binary"
#: Bits of the filter: 8 a key within these bounds.
_FILTER_BITS = (1 << 16, 1 << 28)
#: Rounds of documents: what they shuffle is on disk a round at a time.
_ROUNDS = 4
#: Bytes of encoded documents whose n-grams are counted at once.
_RUN_BYTES = 1 << 21


#: Removes the shuffle files of a query at its end.
_END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(rows: DataFrame, path: str) -> DataFrame:
    """``rows``, computed once into a table of the shared folder: a checkpoint keeps its rows whole, a table
    takes less space, and the shuffles behind it end with its writing."""
    spark = rows.sparkSession
    before = spark.conf.get(_END_SHUFFLES, "false")
    spark.conf.set(_END_SHUFFLES, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_END_SHUFFLES, before)
    return spark.read.parquet(path)


def _vocabulary(trusted: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Hashes of the ``size`` most frequent words, by falling frequency; the number of other words (at least 1),
    over which the unknown word's probability is spread."""
    def count(batches):
        for batch in batches:
            for _, _, words in words_of(batch["text"], True):
                keys, n = np.unique(words.hash, return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])

    counts = trusted.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = _written(counts, scratch_path(trusted.sparkSession, "words"))
    top = counts.orderBy(F.desc("n"), "word").limit(size).toArrow()
    return top["word"].to_numpy().view(np.uint64), max(1, counts.count() - top.num_rows)


def _bits(n_words: int) -> int:
    """Bits of a word number."""
    return 16 if n_words + FIRST_WORD <= 1 << 16 else 21


def _short(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each number there): numbers of up to 21 bits in one to three bytes of seven bits, low ones
    first; the high bit says that another byte follows."""
    size = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14)
    end = np.cumsum(size)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    for i in range(3):
        some = size > i
        out[end[some] - size[some] + i] = (x[some] >> 7 * i & 127) | np.where(size[some] > i + 1, 128, 0)
    return out, end


def _long(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, position of the last byte of each) of ``_short`` bytes."""
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1][:len(last)]
    x = (raw[first] & 127).astype(np.uint64)
    for i in (1, 2):
        some = last - first >= i
        x[some] |= (raw[first[some] + i] & 127).astype(np.uint64) << np.uint64(7 * i)
    return x, last


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs, byte plane by byte plane, compressed."""
    x = x.astype(np.min_scalar_type(x.max() if len(x) else 0))
    planes = x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
    return x.itemsize.to_bytes(1, "little") + len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes) -> np.ndarray:
    wide, n = data[0], int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[9:], n * wide, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, n).T).view(f"u{wide}").ravel().astype(np.uint64)


def _trie(keys: np.ndarray, bits: int, depth: int) -> bytes:
    """Sorted distinct keys of ``depth`` words as a trie: steps between the first words, then at each depth
    how many words follow each node, and these words."""
    levels = []
    for _ in range(depth - 1):
        heads = keys >> np.uint64(bits)
        at = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]][:len(heads)])
        levels += [keys & np.uint64((1 << bits) - 1), np.diff(at, append=len(heads))]
        keys = heads[at]
    parts = [_packed(x) for x in [np.diff(keys, prepend=np.uint64(0)), *levels[::-1]]]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _keys(data: bytes, bits: int) -> np.ndarray:
    """Keys of a ``_trie``."""
    parts, at = [], 0
    while at < len(data):
        stop = at + 8 + int.from_bytes(data[at:at + 8], "little")
        parts.append(_unpacked(data[at + 8:stop]))
        at = stop
    keys = np.cumsum(parts[0], dtype=np.uint64)
    for many, last in zip(parts[1::2], parts[2::2]):
        keys = _pair(np.repeat(keys, many.astype(np.int64)), last, bits)
    return keys


def _numbered(docs: DataFrame, vocabulary: np.ndarray):
    """Broadcast (sorted hashes, numbers) of the words."""
    order = np.argsort(vocabulary)
    return docs.sparkSession.sparkContext.broadcast((vocabulary[order], order.astype(np.uint32) + np.uint32(FIRST_WORD)))


def encode(docs: DataFrame, vocabulary, keep: tuple[str, ...] = ("doc_id", "row", "lang")) -> DataFrame:
    """(keep, ids): word numbers of each text (see ``_short``) by the hashes of the vocabulary, or by ``_numbered``;
    ``row``, the text's hash, tells the rows of a doc_id apart."""
    shared = _numbered(docs, vocabulary) if isinstance(vocabulary, np.ndarray) else vocabulary
    kinds = {"chunk": "chunk int", "doc_id": "doc_id long", "row": "row long", "lang": "lang string"}

    def run(batches):
        known, numbers = shared.value
        for batch in batches:
            for row, stop, words in words_of(batch["text"], True):
                ids = np.zeros(len(words.hash), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
                    ids = np.where(known[at] == words.hash, numbers[at], UNKNOWN).astype(np.int64)
                raw, end = _short(ids)
                cut = np.r_[0, end][words.first].tolist()
                data = raw.tobytes()
                yield pa.record_batch([*(batch[c][row:stop] for c in keep), pa.array([data[i:j] for i, j in zip(cut, cut[1:])], pa.binary())],
                                      names=[*keep, "ids"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(kinds[c] for c in keep), "ids binary"]))


def _trigrams(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, w1, w2, w3) of every word and end, starts padded."""
    numbers, last = _long(np.frombuffer(b"".join(ids), np.uint8))
    stops = np.searchsorted(last, np.cumsum([len(x) for x in ids], dtype=np.int64))
    sizes = np.diff(stops, prepend=0) + 3
    flat = np.full(sizes.sum(), STOP, np.uint64)
    first = np.cumsum(sizes) - sizes
    flat[first] = flat[first + 1] = START
    doc = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(flat)) - first[doc]
    flat[(place >= 2) & (place < sizes[doc] - 1)] = numbers
    at = np.flatnonzero(place >= 2)
    return doc[at], flat[at - 2], flat[at - 1], flat[at]


def _pair(a, b, bits: int):
    return (a << np.uint64(bits)) | b


def _flagged(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Keys of pairs that no triple has."""
    return pairs | np.uint64(1 << 3 * bits)


def _shard(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return C.bucket_of(mix(pairs), buckets).astype(np.int32)


def _discounts(n: dict[int, int]) -> list[float]:
    """0 and D1, D2, D3+ from the counts of counts."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))]


def _cut(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array(d)[np.minimum(n, 3).astype(np.int64)]


def _posted(keys: np.ndarray, n: np.ndarray, shard: np.ndarray, buckets: int, bits: int, depth: int) -> pa.RecordBatch:
    """Counts of sorted keys as one row per shard."""
    order = np.argsort(shard, kind="stable")
    keys, n = keys[order], n[order]
    cut = np.searchsorted(shard[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.record_batch([pa.array(some.astype(np.int32)), pa.array([_trie(keys[cut[i]:cut[i + 1]], bits, depth) for i in some], pa.binary()),
                            pa.array([_packed(n[cut[i]:cut[i + 1]]) for i in some], pa.binary())], names=["bucket", "keys", "n"])


def _summed(rows: DataFrame, bits: int, depth: int) -> DataFrame:
    """One row per shard: its distinct keys and the sums of their counts."""
    def merge(key, rows):
        keys, place = np.unique(np.concatenate([_keys(x, bits) for x in rows["keys"].to_pylist()]), return_inverse=True)
        n = np.zeros(len(keys), np.uint64)
        np.add.at(n, place, np.concatenate([_unpacked(x) for x in rows["n"].to_pylist()]))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([_trie(keys, bits, depth)], pa.binary()),
                         "n": pa.array([_packed(n)], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(merge, _COUNTS)


def _each(batches, bits: int):
    """(keys, counts) of every row."""
    for batch in batches:
        for keys, n in zip(batch["keys"].to_pylist(), batch["n"].to_pylist()):
            yield _keys(keys, bits), _unpacked(n)


def _counts_of_counts(counts: DataFrame) -> dict[int, int]:
    """How many keys have 1, 2, 3, 4 and more (5) occurrences."""
    def run(batches):
        for batch in batches:
            for data in batch["n"].to_pylist():
                yield pa.record_batch([pa.array(range(6), pa.int64()), pa.array(np.bincount(np.minimum(_unpacked(data), 5).astype(np.int64), minlength=6))], names=["n", "c"])

    return {r["n"]: r["c"] for r in counts.select("n").mapInArrow(run, "n long, c long").groupBy("n").agg(F.sum("c").alias("c")).collect()}


@dataclass
class Model:
    """``shards``: (size, bucket, keys, n), counts of triples (size 3) and adjusted counts of pairs (size 2) by
    their two leading words; discounts of both; per word number its unigram probability, its back-off weight
    and one by the sum of the pairs it begins (``unigram``, bounded by the vocabulary)."""

    shards: DataFrame
    buckets: int
    bits: int
    d3: list[float]
    d2: list[float]
    unigram: np.ndarray
    n_keys: int


def _contents(rows: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(triples, their counts, pairs, counts) of a shard; a pair's counts are its own, and how many triples
    that it begins occur once, twice and oftener, and their occurrences beyond 1, 2 and 3."""
    have = {2: (np.zeros(0, np.uint64),) * 2, 3: (np.zeros(0, np.uint64),) * 2}
    for size, keys, n in zip(*(rows[c].to_pylist() for c in ("size", "keys", "n"))):
        have[size] = _keys(keys, bits), _unpacked(n)
    (two, n2), (three, n3) = have[2], have[3]
    context = three >> np.uint64(bits)
    pairs = np.union1d(two, context)
    counts = np.zeros((5, len(pairs)), np.uint64)
    counts[0, np.searchsorted(pairs, two)] = n2
    place, kind = np.searchsorted(pairs, context), np.minimum(n3, 3)
    for i in (1, 2, 3):
        counts[i] = np.bincount(place[kind == i], minlength=len(pairs))
    np.add.at(counts[4], place, n3 - kind)
    return three, n3, pairs, counts


def _weights(counts: np.ndarray, inverse: np.ndarray, d3: list[float], d2: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs' alphas and gammas, and the sums of the triples that they begin (at least 1)."""
    own, ones, twos, more, excess = counts.astype(np.float64, copy=False)
    total = ones + 2 * twos + 3 * more + excess
    cut = d3[1] * ones + d3[2] * twos + d3[3] * more
    return (own - _cut(own, d2)) * inverse, np.where(total > 0, cut / np.maximum(total, 1), 1.0), np.maximum(total, 1)


def learn(trusted: DataFrame, vocabulary: np.ndarray, buckets: int) -> Model:
    """Model of (doc_id, text)."""
    spark, bits, words = trusted.sparkSession, _bits(len(vocabulary)), len(vocabulary) + FIRST_WORD
    wide, low = np.uint64(bits), np.uint64((1 << bits) - 1)

    def triples(batches):
        for batch in batches:
            ids = batch["ids"].to_pylist()
            run = np.cumsum([len(x) for x in ids], dtype=np.int64) // _RUN_BYTES
            edges = np.flatnonzero(np.diff(run, prepend=-1)).tolist()
            for i, j in zip(edges, [*edges[1:], len(ids)]):
                _, a, b, c = _trigrams(ids[i:j])
                keys, n = np.unique(_pair(_pair(a, b, bits), c, bits), return_counts=True)
                yield _posted(keys, n.astype(np.uint64), _shard(keys >> wide, buckets), buckets, bits, 3)

    def pairs(batches):
        for keys, n in _each(batches, bits):
            # words before the pair, or its occurrences at a text's start
            seen = np.where(keys >> wide & low == START, n, np.uint64(1))
            keys, place = np.unique(keys & np.uint64((1 << 2 * bits) - 1), return_inverse=True)
            out = np.zeros(len(keys), np.uint64)
            np.add.at(out, place, seen)
            yield _posted(keys, out, _shard(keys, buckets), buckets, bits, 2)

    def by_word(batches):
        """Per word 8 * number + 0: pairs it ends; + 1: the sum of those it begins; + 2, 3, 4: how many of
        them have 1, 2, 3 or more."""
        for keys, n in _each(batches, bits):
            first, last, one = keys >> wide << np.uint64(3), (keys & low) << np.uint64(3), np.ones(len(keys), np.uint64)
            keys, place = np.unique(np.concatenate([last, first | np.uint64(1), first + np.minimum(n, np.uint64(3)) + np.uint64(1)]), return_inverse=True)
            out = np.zeros(len(keys), np.uint64)
            np.add.at(out, place, np.concatenate([one, n, one]))
            yield _posted(keys, out, _shard(keys >> np.uint64(3), buckets), buckets, 3, 2)

    three = _written(_summed(encode(trusted, vocabulary, ("doc_id",)).mapInArrow(triples, _COUNTS), bits, 3), scratch_path(spark, "triples"))
    two = _written(_summed(three.mapInArrow(pairs, _COUNTS), bits, 2), scratch_path(spark, "pairs"))
    some3, some2 = _counts_of_counts(three), _counts_of_counts(two)
    d3, d2 = _discounts(some3), _discounts(some2)
    sums = np.zeros(8 * words, np.int64)
    for r in _summed(two.mapInArrow(by_word, _COUNTS), 3, 2).toLocalIterator():  # at most five numbers per word of the vocabulary
        sums[_keys(r["keys"], 3).astype(np.int64)] = _unpacked(r["n"])
    n1, totals, *ns = sums.reshape(words, 8).T[:5].astype(np.float64)
    d1 = _discounts({i: int((n1 == i).sum()) for i in (1, 2, 3, 4)})
    cut, total = _cut(n1, d1), max(n1.sum(), 1.0)
    totals = np.maximum(totals, 1.0)
    back = np.where(sum(ns) > 0, sum(d * n for d, n in zip(d2[1:], ns)) / totals, 1.0)
    unigram = np.stack([(n1 - cut) / total + (cut.sum() / total if n1.sum() else 1.0) / words, back, 1 / totals], 1).astype(np.float32)
    shards = three.select(F.lit(3).alias("size"), "*").unionByName(two.select(F.lit(2).alias("size"), "*"))
    return Model(shards, buckets, bits, d3, d2, unigram, sum(some3.values()) + sum(some2.values()))


def train(trusted: DataFrame, vocabulary: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Model of (doc_id, text): table (key, alpha, gamma) of pairs and triples; per word number its
    unigram probability and back-off weight (bounded by the vocabulary)."""
    model = learn(trusted, vocabulary, 8)
    bits, d3, d2, ones = model.bits, model.d3, model.d2, model.shards.sparkSession.sparkContext.broadcast(model.unigram)

    def spell(rows):
        three, n3, two, counts = _contents(rows, bits)
        alpha, gamma, total = _weights(counts, ones.value[(two >> np.uint64(bits)).astype(np.int64), 2], d3, d2)
        first = (n3 - _cut(n3, d3)) / total[np.searchsorted(two, three >> np.uint64(bits))]
        return pa.table({"key": np.concatenate([three, _flagged(two, bits)]).view(np.int64), "alpha": np.concatenate([first, alpha]),
                         "gamma": np.concatenate([np.ones(len(three)), gamma])})

    return model.shards.groupBy("bucket").applyInArrow(spell, "key long, alpha double, gamma double"), model.unigram


def _spots(keys: np.ndarray, shard, size: int) -> list[np.ndarray]:
    h = mix(keys)
    return [shard * np.int64(size) + (x % np.uint64(size)).astype(np.int64) for x in (h, mix(h))]


def _filter(model: Model) -> np.ndarray:
    """Bits over the model's keys, two probes; each shard has a range of its own and sets it by itself."""
    buckets, bits = model.buckets, model.bits
    size = max(8, int(np.clip(8 * model.n_keys, *_FILTER_BITS)) // buckets // 8 * 8)

    def part(batches):
        for batch in batches:
            for kind, bucket, data in zip(*(batch[c].to_pylist() for c in ("size", "bucket", "keys"))):
                keys = _keys(data, bits)
                keys = _flagged(keys, bits) if kind == 2 else np.concatenate([keys, _flagged(np.unique(keys >> np.uint64(bits)), bits)])
                flags = np.zeros(size, bool)
                for at in _spots(keys, 0, size):
                    flags[at] = True
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bucket", "bits"])

    out = np.zeros((buckets, size // 8), np.uint8)
    for r in model.shards.select("size", "bucket", "keys").mapInArrow(part, "bucket int, bits binary").toLocalIterator():
        out[r["bucket"]] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _plan(cores: int, size: int, chunk_words: int) -> tuple[int, int]:
    """(chunks, shards) for about ``size`` words: as ``chunks.plan``, but no more than the cores need where the
    data is small, as fewer chunks ask for fewer n-grams twice."""
    per_chunk = max(chunk_words, int(10 * max(size, 1) ** 0.5))
    return max(_ROUNDS * cores, -(-size // per_chunk)), max(2 * cores, -(-size // (4 * per_chunk)))


def perplexities(docs: DataFrame, vocabulary: np.ndarray, model: Model, others: int, n_chunks: int) -> DataFrame:
    """(doc_id, row, lang, n_tokens, log_ppl): mean of -log10 P over words and end, for (doc_id, row, lang, text).

    The chunks go through in ``_ROUNDS`` rounds of about the same size, whose shuffles end with them."""
    sc = docs.sparkSession.sparkContext
    known, ones = sc.broadcast(_filter(model)), sc.broadcast(model.unigram)
    docs = C.with_chunk(docs, n_chunks)
    spelt = _numbered(docs, vocabulary)
    encoded = [encode(docs.where(F.col("chunk") % _ROUNDS == i), spelt, ("chunk", "doc_id", "row", "lang")) for i in range(_ROUNDS)]
    bits, buckets, d3, d2 = model.bits, model.buckets, model.d3, model.d2

    def may_have(keys, shard):
        data = known.value
        hit = np.ones(len(keys), bool)
        for spot in _spots(keys, shard, 8 * data.shape[1]):
            hit &= (data.ravel()[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
        return hit

    def keys_of(docs: pa.Table):
        """Words of the chunk and the places of their pairs and triples among the distinct ones; the pairs
        worth asking for, by shard, and where each shard starts; the same of the triples."""
        doc, a, b, c = _trigrams(docs["ids"].to_pylist())
        start = _pair(np.array([START], np.uint64), np.array([START], np.uint64), bits)
        pairs, pair = np.unique(np.concatenate([_pair(b, c, bits), start]), return_inverse=True)
        triples, triple = np.unique(_pair(_pair(a, b, bits), c, bits), return_inverse=True)
        shard = _shard(pairs, buckets)
        hit = may_have(_flagged(pairs, bits), shard)
        context = np.searchsorted(pairs, triples >> np.uint64(bits))
        ask2, ask3 = np.flatnonzero(hit), np.flatnonzero(hit[context])
        ask3 = ask3[may_have(triples[ask3], shard[context[ask3]])]
        ask2, ask3 = ask2[np.argsort(shard[ask2], kind="stable")], ask3[np.argsort(shard[context[ask3]], kind="stable")]
        edges = np.arange(buckets + 1)
        cut2, cut3 = np.searchsorted(shard[ask2], edges), np.searchsorted(shard[context[ask3]], edges)
        return (doc, b, c, pair, triple), (pairs, ask2, cut2), (triples, ask3, cut3), context

    def ask(key, docs):
        _, (pairs, ask2, cut2), (triples, ask3, cut3), context = keys_of(docs)
        many = np.bincount(context[ask3], minlength=len(pairs))[ask2]
        last = triples[ask3] & np.uint64((1 << bits) - 1)
        some = np.flatnonzero(np.diff(cut2))
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()), "bucket": pa.array(some.astype(np.int32)),
            "pairs": pa.array([_trie(pairs[ask2[cut2[i]:cut2[i + 1]]], bits, 2) for i in some], pa.binary()),
            "many": pa.array([_packed(many[cut2[i]:cut2[i + 1]]) for i in some], pa.binary()),
            "last": pa.array([_packed(last[cut3[i]:cut3[i + 1]]) for i in some], pa.binary())})

    def found(have, counts, want):
        out = np.zeros((len(counts), len(want)), np.uint64)
        if len(have):
            at = np.minimum(np.searchsorted(have, want), len(have) - 1)
            ok = have[at] == want
            out[:, ok] = counts[:, at[ok]]
        return [_packed(x) for x in out]

    def answer(left, right):
        if not left.num_rows:
            return pa.table({f: [] for f in names}, schema=schema)
        three, n3, two, counts = _contents(right, bits)
        replies = []
        for pairs, many, last in zip(*(left[c].to_pylist() for c in ("pairs", "many", "last"))):
            pairs = _keys(pairs, bits)
            triples = _pair(np.repeat(pairs, _unpacked(many).astype(np.int64)), _unpacked(last), bits)
            replies.append(found(two, counts, pairs) + found(three, n3[None], triples))
        return pa.table([left["chunk"], left["bucket"], *(pa.array(x, pa.binary()) for x in zip(*replies))], names=names)

    names = [x.split()[0] for x in _ANSWER.split(", ")]
    schema = pa.schema([(x, pa.int32() if i < 2 else pa.binary()) for i, x in enumerate(names)])
    def rate(left, right):
        (doc, b, c, pair, triple), (pairs, ask2, cut2), (triples, ask3, cut3), context = keys_of(left)
        counts, n3 = np.zeros((5, len(pairs))), np.zeros(len(triples))
        for i, *reply in zip(*(right[x].to_pylist() for x in names[1:])):
            for out, data in zip(counts, reply):
                out[ask2[cut2[i]:cut2[i + 1]]] = _unpacked(data)
            n3[ask3[cut3[i]:cut3[i + 1]]] = _unpacked(reply[-1])
        alpha2, gamma, total = (x.astype(np.float32) for x in _weights(counts, ones.value[(pairs >> np.uint64(bits)).astype(np.int64), 2], d3, d2))
        alpha3 = ((n3 - _cut(n3, d3)) / total[context]).astype(np.float32)
        before = np.r_[pair[-1:], pair[:-2]]  # the pair of the two words before; a document starts with two starts
        before[np.r_[True, doc[1:] != doc[:-1]]] = pair[-1]
        low = alpha2[pair[:-1]] + ones.value[b.astype(np.int64), 1] * ones.value[c.astype(np.int64), 0]
        p = alpha3[triple] + gamma[before] * low
        p = np.where(c == UNKNOWN, p / others, p)
        n = np.bincount(doc, minlength=left.num_rows)
        bits_ = np.bincount(doc, weights=-np.log10(p), minlength=left.num_rows)
        return pa.table({"doc_id": left["doc_id"], "row": left["row"], "lang": left["lang"], "n_tokens": pa.array(n, pa.int64()), "log_ppl": pa.array(bits_ / np.maximum(n, 1))})

    def rated(parts):
        replies = parts.groupBy("chunk").applyInArrow(ask, _QUESTION).groupBy("bucket").cogroup(model.shards.groupBy("bucket")).applyInArrow(answer, _ANSWER)
        return parts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(rate, "doc_id long, row long, lang string, n_tokens long, log_ppl double")

    return reduce(DataFrame.unionByName, [_written(rated(parts), scratch_path(docs.sparkSession, "rated")) for parts in encoded])


def quality(docs: DataFrame, labels: DataFrame, docs_per_lang: int | None = None, vocabulary_size: int = MOST_WORDS, quantile: float = 0.98,
            chunk_words: int = 500_000) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, kept) per distinct doc_id of ``docs``.

    Trusted: ``labels`` with quality 1 and toxic 0. Three quarters of them, chosen by a hash of the id, train the
    model (where the caller names ``docs_per_lang``, at most about so many per language); all others of a
    language set its threshold, the ``quantile`` of their perplexities (to 1/1000 of log10). The
    vocabulary has every word of the training text, or the ``vocabulary_size`` most frequent ones. A language
    without any takes that of all. Null lang is a language of its own; null or empty text has its end
    only; rows without doc_id are left out; a doc_id with several rows counts, and trains, with the one whose
    text has the smallest 64-bit hash (null last), of equal texts with the smallest lang; without trusted
    rows everything is kept.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang").where("doc_id is not null").withColumn(
        "row", F.when(F.col("text").isNull(), F.lit((1 << 63) - 1)).otherwise(F.xxhash64("text")))
    first = F.min(F.struct("row", "lang"))
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long")).distinct()
    trusted = docs.join(good, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("f")).select("doc_id", "f.row", "f.lang").checkpoint()
    sizes = trusted.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("kn")), F.lit(1_000_000))
    share = F.lit(1.0) if docs_per_lang is None else F.least(F.lit(1.0), docs_per_lang / (0.75 * F.col("c")))
    split = (trusted.join(sizes.withColumnRenamed("lang", "l"), F.expr("lang <=> l")).select(
        "doc_id", "row", "lang", (part < 750_000).alias("train"),
        (part < 750_000 * share).alias("use")))
    sample = split.where("train and use").select("doc_id", "row")
    path = scratch_path(spark, "trusted")
    text = _written(docs.join(sample, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id"]), path)
    vocabulary, others = _vocabulary(text, min(vocabulary_size, MOST_WORDS))
    words = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n, buckets = _plan(spark.sparkContext.defaultParallelism, words // 6, chunk_words)
    model = learn(text, vocabulary, buckets)
    spark.createDataFrame([], text.schema).write.mode("overwrite").parquet(path)  # its files are not read again
    scored = perplexities(docs, vocabulary, model, others, n)
    scored = (scored.groupBy("doc_id").agg(F.min(F.struct("row", "lang", "log_ppl", "n_tokens")).alias("s"))
              .select("doc_id", "s.lang", "s.n_tokens", "s.log_ppl").checkpoint())
    bins = (scored.join(split.where("not use").select("doc_id"), "doc_id", "left_semi")
            .groupBy("lang", F.ceil(F.col("log_ppl") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("c")).checkpoint())
    every = bins.groupBy("bin").agg(F.sum("c").alias("c"))

    def limits(hist, by):
        w = Window.partitionBy(*by)
        run = F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return (hist.withColumn("run", run).withColumn("all", F.sum("c").over(w)).where(F.col("run") >= F.col("all") * quantile)
                .groupBy(*by).agg((F.min("bin") / 1000).alias("limit")))

    common = limits(every.withColumn("k", F.lit(0)), ["k"]).select(F.col("limit").alias("common"))
    own = limits(bins, ["lang"]).withColumnRenamed("lang", "l")
    out = scored.join(own, F.expr("lang <=> l"), "left").join(F.broadcast(common), F.lit(True), "left")
    limit = F.coalesce("limit", "common")
    return out.select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), F.col("log_ppl")).alias("perplexity"),
                      F.pow(F.lit(10.0), limit).alias("threshold"), F.coalesce(F.col("log_ppl") <= limit, F.lit(True)).alias("kept"))
