"""N-gram Jaccard join by vertical partitioning.

Documents become sets of distinct word n-grams. Sets are ordered by one global order (rarest first),
the order is cut into fragments of about equal weight, overlaps are counted fragment by fragment and
summed per pair. What keeps the pairs few, without losing one:

* Equal word sequences are one class; only its first document takes part.
* A linked document shares at least ``threshold`` of its n-grams with other classes. One pass over
  short hashes tells which n-grams occur in two classes; documents below that share are done.
* Two linked documents share an n-gram among the rarest ``n - ceil(threshold * n) + 1`` of each
  (prefix filter). Every such n-gram names its hub, the smallest document that has it in its prefix,
  so linked documents have a hub in common. Documents are compared with their hubs first; a group of
  thousands of near copies becomes one component by a star of links, not by all its pairs.
* Only documents with a common hub that are not yet in one component are compared further, in blocks
  of ``block`` documents; a block pair emits links only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellselect.llm import chunks as C
from cellselect.llm.components import components
from cellselect.llm.words import mix, words_of
from cellselect.session import shared_dir

_SETS = "doc_id long, n long, grams binary"


def word_keys(docs: DataFrame, lower: bool = True) -> DataFrame:
    """(doc_id, n_words, k1, k2): word count and 128-bit hash of each text's word sequence."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def keys(batches):
        for batch in batches:
            for row, stop, words in words_of(batch["text"], lower):
                k1 = words.whole()
                twisted = mix(words.hash ^ np.uint64(0x5851F42D4C957F2D))
                sums = np.r_[np.uint64(0), np.cumsum(twisted * np.arange(1, len(twisted) + 1, dtype=np.uint64), dtype=np.uint64)]
                plain = np.r_[np.uint64(0), np.cumsum(twisted, dtype=np.uint64)]
                a, b = words.first[:-1], words.first[1:]
                k2 = mix((sums[b] - sums[a]) - (plain[b] - plain[a]) * a.astype(np.uint64))
                yield pa.record_batch([batch["doc_id"][row:stop], pa.array(words.counts, pa.int64()),
                                       pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(keys, "doc_id long, n_words long, k1 long, k2 long")


def classes(keys: DataFrame) -> DataFrame:
    """(doc_id, n_words, k1, k2, rep): rep is the smallest doc_id with the same word sequence. A doc_id
    that occurs with several texts counts with one of them (the smallest hash)."""
    one = keys.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_words")).alias("k")).select("doc_id", "k.*")
    least = one.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    return one.join(least, ["k1", "k2"])


class _Sets:
    """Distinct n-grams of the wanted documents of one chunk."""

    def __init__(self, docs: pa.Table, side: pa.Table, n: int, lower: bool):
        kind = side["bucket"].to_numpy()
        ask, told = side.filter(pa.array(kind < 0)), side.filter(pa.array(kind >= 0))
        wanted = dict(zip(ask["doc_id"].to_pylist(), ask["k1"].to_pylist()))
        self.buckets, self.replies = told["bucket"].to_pylist(), told["reply"].to_pylist()
        ids = docs["doc_id"].to_numpy()
        self.ids, grams = [], []
        texts = docs["text"].combine_chunks()
        for row, stop, words in words_of(texts, lower):
            k1 = words.whole().view(np.int64)
            hashes, doc, _ = words.windows(n)
            cut = np.searchsorted(doc, np.arange(stop - row + 1))
            for i in range(stop - row):
                doc_id = int(ids[row + i])
                if wanted.get(doc_id) != int(k1[i]):
                    continue
                del wanted[doc_id]
                mine = np.unique(hashes[cut[i]:cut[i + 1]])
                if not len(mine) and words.counts[i]:
                    mine = k1[i:i + 1].view(np.uint64).copy()
                self.ids.append(doc_id)
                grams.append(mine)
        self.sizes = np.array([len(g) for g in grams], np.int64)
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(grams)), self.sizes)
        self.keys, self.inverse, self.count = np.unique(self.grams, return_inverse=True, return_counts=True)


def _shared_sets(docs: DataFrame, reps: DataFrame, n: int, percent: int, n_chunks: int, buckets: int,
                 lower: bool, width: int) -> DataFrame:
    """(doc_id, n, grams): set size and, where enough n-grams occur in other classes too, those."""
    text = C.with_chunk(docs.select("doc_id", "text").where("doc_id is not null"), n_chunks)
    side = C.with_chunk(reps.select("doc_id", "k1"), n_chunks).select(
        "chunk", F.lit(-1).alias("bucket"), "doc_id", "k1", F.lit(None).cast("binary").alias("reply"))

    def send(key, left, right):
        sets = _Sets(left, right, n, lower)
        return C.post(key[0].as_py(), sets.keys, (sets.count > 1).astype(np.uint8), buckets, width)

    postings = text.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(send, C.POSTING)
    replies = C.seen_elsewhere(postings, width).select(
        "chunk", "bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("k1"), "reply")

    def keep(key, left, right):
        sets = _Sets(left, right, n, lower)
        hit = C.read_reply(sets.buckets, sets.replies, sets.keys, buckets)[sets.inverse]
        cut = np.r_[0, np.cumsum(sets.sizes)]
        shared = np.bincount(sets.doc[hit], minlength=len(sets.sizes))
        grams = [sets.grams[cut[i]:cut[i + 1]][hit[cut[i]:cut[i + 1]]].tobytes()
                 if 100 * shared[i] >= percent * sets.sizes[i] > 0 else None for i in range(len(sets.sizes))]
        return pa.table({"doc_id": pa.array(sets.ids, pa.int64()), "n": pa.array(sets.sizes, pa.int64()),
                         "grams": pa.array(grams, pa.binary())})

    return (text.groupBy("chunk").cogroup(side.unionByName(replies).groupBy("chunk"))
            .applyInArrow(keep, _SETS))


def _ordered(sets: DataFrame, n_chunks: int, buckets: int) -> DataFrame:
    """(doc_id, n, grams array<long>, freq array<long>): n-grams with their document frequency."""
    parts = C.with_chunk(sets, n_chunks)

    def arrays(table):
        grams = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        return np.unique(np.concatenate(grams), return_inverse=True, return_counts=True), [len(g) for g in grams]

    def send(key, table):
        (keys, _, count), _ = arrays(table)
        return C.post(key[0].as_py(), keys, count.astype(np.int64), buckets)

    replies = C.totals(parts.groupBy("chunk").applyInArrow(send, C.POSTING))

    def order(key, left, right):
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()),
                             "grams": pa.array([], pa.list_(pa.int64())), "freq": pa.array([], pa.list_(pa.int64()))})
        (keys, inverse, _), sizes = arrays(left)
        freq = C.read_reply(right["bucket"].to_pylist(), right["reply"].to_pylist(), keys, buckets, np.int64)[inverse]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.lexsort((keys[inverse], freq, doc))
        cut = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.table({"doc_id": left["doc_id"], "n": left["n"],
                         "grams": pa.ListArray.from_arrays(cut, pa.array(keys[inverse][rank].view(np.int64))),
                         "freq": pa.ListArray.from_arrays(cut, pa.array(freq[rank]))})

    return (parts.groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(order, "doc_id long, n long, grams array<long>, freq array<long>"))


def _fragments(sets: DataFrame, count: int) -> list[int]:
    """Cut points on log2 of the frequency, so that fragments weigh about the same (at most 64 rows
    come to the driver)."""
    level = F.floor(F.log2(F.col("f").cast("double"))).cast("int")
    rows = sorted((r[0], r[1]) for r in sets.select(F.explode("freq").alias("f")).groupBy(level.alias("level"))
                  .agg(F.count(F.lit(1)).alias("c")).collect())
    total, run, cuts = sum(c for _, c in rows), 0, []
    for lv, c in rows:
        run += c
        if run * count >= total * (len(cuts) + 1) and len(cuts) < count - 1:
            cuts.append(2 ** (lv + 1))
    return cuts


def _linked(overlap, n_a, n_b, percent):
    return F.lit(100) * overlap >= F.lit(percent) * (n_a + n_b - overlap)


def _star_links(pairs: DataFrame, sets: DataFrame, cuts: list[int], percent: int) -> DataFrame:
    """Linked (a, b) among the given pairs: overlaps counted per fragment, then summed."""
    frag = F.lit(0)
    for c in cuts:
        frag = frag + (F.col("g.freq") >= c).cast("int")
    segments = (sets.select("doc_id", F.explode(F.arrays_zip("grams", "freq")).alias("g"))
                .groupBy("doc_id", frag.alias("fragment")).agg(F.collect_list("g.grams").alias("seg")))
    left = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("seg").alias("seg_a"))
    right = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("seg").alias("seg_b"))
    partial = (pairs.join(right, "b").join(left, ["a", "fragment"])
               .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("seg_a", "seg_b")).alias("part")))
    return (partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
            .where(_linked(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))


def _block_links(rest: DataFrame, percent: int, cuts: list[int]) -> DataFrame:
    """Linked (a, b) of different components between the two sides of each block pair."""

    def link(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, comp, n = (table[c].to_numpy() for c in ("doc_id", "component", "n"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        grams = table["grams"].combine_chunks()
        freq = table["freq"].combine_chunks()
        flat, weight = grams.values.to_numpy(), freq.values.to_numpy()
        offsets = grams.offsets.to_numpy()
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        flat, weight = flat[offsets[0]:offsets[-1]], weight[offsets[0]:offsets[-1]]
        place = np.zeros(len(ids), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        total = np.zeros((len(left), len(right)), np.int64)
        edges = [0, *cuts, np.iinfo(np.int64).max]
        for low, high in zip(edges[:-1], edges[1:]):
            inside = (weight >= low) & (weight < high)
            keys, col = np.unique(flat[inside], return_inverse=True)
            for at in range(0, len(keys), 4096):
                now = (col >= at) & (col < at + 4096)
                one = np.zeros((len(left), 4096), np.float32)
                two = np.zeros((len(right), 4096), np.float32)
                d, c = doc[inside][now], col[now] - at
                a = side[d] == 0
                one[place[d[a]], c[a]] = 1
                two[place[d[~a]], c[~a]] = 1
                total += np.rint(one @ two.T).astype(np.int64)
        union = n[left][:, None] + n[right][None, :] - total
        ok = (100 * total >= percent * union) & (comp[left][:, None] != comp[right][None, :])
        i, j = np.nonzero(ok)
        return pa.table({"a": pa.array(ids[left][i], pa.int64()), "b": pa.array(ids[right][j], pa.int64())})

    return rest.groupBy("hub", "g", "o", "home").applyInArrow(link, "a long, b long").distinct()


def _rest_blocks(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Rows of block pairs that still need comparing: per hub, guests (not in the hub's component)
    against members of the hub's component (home) and against guests."""
    m = members.withColumn("home", (F.col("component") == F.col("hub_component")).cast("int"))
    counts = m.groupBy("hub").agg(F.sum(F.lit(1) - F.col("home")).alias("guests"), F.sum("home").alias("homes"))
    m = m.join(counts.where("guests > 0"), "hub")
    g_blocks = F.ceil(F.col("guests") / F.lit(block)).cast("int")
    h_blocks = F.ceil(F.col("homes") / F.lit(block)).cast("int")
    spot = F.pmod(F.xxhash64("doc_id"), F.when(F.col("home") == 1, h_blocks).otherwise(g_blocks).cast("long")).cast("int")
    m = m.withColumn("spot", spot)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = ["hub", "doc_id", "component"]
    home = m.where("home = 1").select(*base, each(g_blocks).alias("g"), F.col("spot").alias("o"), F.lit(1).alias("home"), F.lit(1).alias("side"))
    guest_home = m.where("home = 0").select(*base, F.col("spot").alias("g"), each(h_blocks).alias("o"), F.lit(1).alias("home"), F.lit(0).alias("side"))
    guest_a = m.where("home = 0").select(*base, F.col("spot").alias("g"), F.explode(F.sequence(F.lit(0), F.col("spot"))).alias("o"), F.lit(0).alias("home"), F.lit(0).alias("side"))
    guest_b = m.where("home = 0").select(*base, F.explode(F.sequence(F.col("spot"), g_blocks - 1)).alias("g"), F.col("spot").alias("o"), F.lit(0).alias("home"), F.lit(1).alias("side"))
    rows = home.unionByName(guest_home).unionByName(guest_a).unionByName(guest_b)
    return rows.join(sets.select("doc_id", "n", "grams", "freq"), "doc_id")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75, fragments: int = 4, lower: bool = True,
                     chunk_words: int = 1_000_000, block: int = 256, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) per distinct doc_id of ``docs`` (doc_id, text).

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct ``n``-word
    shingles (a shorter text is one shingle; a text without words, or null, has none and links with
    nothing). ``component_id`` is the smallest doc_id reachable by links. Rows without doc_id are left
    out; repeated rows give one result; a doc_id with several texts counts with one of them; other
    columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keys = classes(word_keys(docs.where("doc_id is not null"), lower)).checkpoint()
    words = keys.agg(F.sum("n_words")).first()[0] or 0
    n_chunks, buckets = C.plan(docs, words, chunk_words)
    reps = keys.where("rep = doc_id and n_words > 0")
    sets = _shared_sets(docs, reps, n, percent, n_chunks, buckets, lower, width).checkpoint()
    close = sets.where("grams is not null")
    grams = close.agg(F.sum(F.length("grams")) / 8).first()[0] or 0
    ordered = _ordered(close, *C.plan(docs, grams, chunk_words)).checkpoint()
    cuts = _fragments(ordered, fragments)
    least = F.ceil(F.col("n") * percent / F.lit(100))  # shared n-grams a link needs at least
    skip = F.col("n") - F.size("grams")
    head = F.greatest(F.lit(0), F.least(F.size("grams"), F.col("n") - least + 1 - skip)).cast("int")
    prefix = (ordered.select("doc_id", "n", F.explode(F.slice(F.arrays_zip("grams", "freq"), F.lit(1), head)).alias("g"))
              .where("g.freq > 1").select("doc_id", "n", F.col("g.grams").alias("gram")))
    hubs = prefix.groupBy("gram").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = prefix.join(hubs.drop("c"), "gram").groupBy("hub", "doc_id").agg(F.first("n").alias("n")).checkpoint()
    heads = ordered.select(F.col("doc_id").alias("hub"), F.col("n").alias("n_a"))
    pairs = (members.where("hub <> doc_id").join(heads, "hub")
             .where(F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent)
             .select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "n_a", F.col("n").alias("n_b")))
    stars = _star_links(pairs, ordered, cuts, percent).checkpoint()
    labels = components(stars)
    named = members.select("hub", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    named = named.withColumn("component", F.coalesce("component", "doc_id"))
    hub_label = labels.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    named = named.join(hub_label, "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub"))
    more = _block_links(_rest_blocks(named, ordered, block), percent, cuts)
    final = components(stars.union(more))
    out = (keys.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
           .join(sets.select(F.col("doc_id").alias("rep"), "n"), "rep", "left"))
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"),
                      F.when(F.col("n_words") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
