"""The prefix trie of conversations: every distinct sequence of first turns and who starts with it.

Turns are narrow rows (digest, length) in one global order; a running digest over each conversation names
its prefixes. A count-min sketch over all prefix digests then screens them: an estimate of one proves
that a single conversation has the prefix, so its node is complete where it stands and is emitted there;
only prefixes that may be shared are shuffled and grouped exactly. The sketch only keeps rows from
travelling: one that is too small for the data proves less and changes no result.

Nothing here is a row per conversation with all its turns: conversations of any length run through the
sorted partitions in batches, and what is open at a partition's end is handed to the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellselect.llm import words as W
from cellselect.session import shared_dir

_BASES = (0x9E3779B97F4A7C1B, 0xD1B54A32D192ED0B)
#: Cells of the sketch: 8 a prefix between these bounds, in four rows.
_CELLS = (1 << 16, 1 << 28)
_BLOCK = 1 << 18
_ROWS = 4
_IDS_A_PACK = 4096
#: The root's digest: every conversation starts with a mark of this digest.
_ROOT = 1
_MASK = (1 << 64) - 1


def rebuilt_turns(conversations: DataFrame, heads_every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, section, place, h1, h2, chars): the turns of the rebuilt conversations and, as section -1,
    a mark for each conversation. Conversation c takes the first h turns of c - c % ``heads_every`` and its
    own after its first h, h = crc32(c as text) % ``most``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    # equal starts of 32 characters stay in one partition, so its bounds are short
    turns = (turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
             .select("conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.length("text").cast("long").alias("chars")))
    turns = scan(turns.checkpoint()).select("conv_id", (F.col("depth") + 1).alias("place"), "h1", "h2", "chars")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    turns = turns.checkpoint()
    ids = turns.where("place = 1").select("conv_id")
    heads = turns.where((F.col("place") < most) & (F.col("conv_id") % heads_every == 0)).withColumnRenamed("conv_id", "head")
    taken = (ids.withColumn("head", F.col("conv_id") - F.col("conv_id") % heads_every).withColumn("h", h).join(heads, "head")
             .where(F.col("place") <= F.col("h")).select("conv_id", F.lit(0).alias("section"), "place", "h1", "h2", "chars"))
    own = turns.where(F.col("place") > h).select("conv_id", F.lit(1).alias("section"), "place", "h1", "h2", "chars")
    mark = ids.select("conv_id", F.lit(-1).alias("section"), *[F.lit(v).cast("long").alias(c) for c, v in (("place", 0), ("h1", _ROOT), ("h2", _ROOT), ("chars", 0))])
    return mark.unionByName(taken).unionByName(own)


def _runs(conv: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])


def scan(rows: DataFrame, sketch: np.ndarray | None = None) -> DataFrame:
    """``rows`` (conv_id, h1, h2, chars, sorted by conversation over the partitions and checkpointed) with depth
    (from 0), the digests k1, k2 of the sequence up to the row, p1, p2 of that before it, and last. With a
    sketch also single and above: whether the prefix and the one before it are proven to occur once.

    A first pass gives one row per partition: its first conversation and what it holds of its last one. Put
    together in order they tell each partition the depth and digests it starts with.
    """
    columns = ["conv_id", "h1", "h2", "chars"]

    def ends(batches):
        first = conv = None
        depth, digests = 0, [0, 0]
        for batch in batches:
            ids = batch["conv_id"].to_numpy()
            if not len(ids):
                continue
            start = int(_runs(ids)[-1])
            if first is None:
                first = int(ids[0])
            if conv != int(ids[-1]):
                conv, depth, digests = int(ids[-1]), 0, [0, 0]
            n = len(ids) - start
            for i, name in enumerate(("h1", "h2")):
                h = batch[name].to_numpy()[start:].view(np.uint64)
                up = W._powers(_BASES[i], n)[0]
                digests[i] = (digests[i] * pow(_BASES[i], n, 1 << 64) + int((h * up[::-1]).sum(dtype=np.uint64))) & _MASK
            depth += n
        if first is not None:
            yield pa.record_batch([pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), first, conv, depth)]
                                  + [pa.array([x.to_bytes(8, "little")]) for x in digests], names=["part", "first", "conv", "depth", "d1", "d2"])

    parts = rows.select("conv_id", "h1", "h2").mapInArrow(ends, "part long, first long, conv long, depth long, d1 binary, d2 binary").collect()
    start: dict[int, tuple] = {}
    follow: dict[int, int] = {}
    open_ = (None, 0, [0, 0])
    for r, after in zip(parts := sorted(parts), [*parts[1:], None]):
        start[r["part"]] = open_
        if after:
            follow[r["part"]] = after["first"]
        mine = [int.from_bytes(r[c], "little") for c in ("d1", "d2")]
        if r["first"] == r["conv"] == open_[0]:  # the whole partition goes on with the open conversation
            mine = [(d * pow(b, r["depth"], 1 << 64) + m) & _MASK for d, b, m in zip(open_[2], _BASES, mine)]
            open_ = (r["conv"], open_[1] + r["depth"], mine)
        else:
            open_ = (r["conv"], r["depth"], mine)
    shared = rows.sparkSession.sparkContext.broadcast((start, follow, sketch))

    def run(batches):
        start, follow, sketch = shared.value
        part = TaskContext.get().partitionId()
        conv, depth, digests = start.get(part, (None, 0, [0, 0]))
        held = None
        for batch in batches:
            ids = batch["conv_id"].to_numpy()
            if not len(ids):
                continue
            runs = _runs(ids)
            begin = np.zeros(len(ids), np.int64)
            begin[runs] = runs
            begin = np.maximum.accumulate(begin)
            goes_on = conv == int(ids[0])
            at = np.arange(len(ids)) - begin
            first = len(ids) if len(runs) == 1 else runs[1]  # rows of the first conversation here
            key, before = [], []
            for i, name in enumerate(("h1", "h2")):
                h = batch[name].to_numpy().view(np.uint64)
                up, down = W._powers(_BASES[i], len(ids) + 1)
                sums = np.r_[np.uint64(0), np.cumsum(h * down[:-1], dtype=np.uint64)]
                k = (sums[1:] - sums[begin]) * up[:-1]
                if goes_on:
                    k[:first] += np.uint64(digests[i]) * up[1:first + 1]
                p = np.r_[np.uint64(digests[i] if goes_on else 0), k[:-1]]
                p[runs if not goes_on else runs[1:]] = 0
                key.append(k)
                before.append(p)
            place = at.copy()
            if goes_on:
                place[:first] += depth
            conv, depth, digests = int(ids[-1]), int(place[-1]) + 1, [int(k[-1]) for k in key]
            out = [*[batch[c] for c in columns], pa.array(place), *[pa.array(x.view(np.int64)) for x in (*key, *before)]]
            if sketch is not None:
                out += [pa.array(proven(sketch, *key)), pa.array(proven(sketch, *before))]
            last = np.r_[ids[1:] != ids[:-1], False]
            now = (out, last)
            if held is not None:
                held[1][-1] = held[0][0][-1].as_py() != int(ids[0])
                yield _batch(*held)
            held = now
        if held is not None:
            held[1][-1] = follow.get(part) != conv
            yield _batch(*held)

    names = [*columns, "depth", "k1", "k2", "p1", "p2", *(["single", "above"] if sketch is not None else []), "last"]

    def _batch(out, last):
        return pa.record_batch([*out, pa.array(last)], names=names)

    return rows.select(*columns).mapInArrow(run, ", ".join(f"{c} {'boolean' if c in ('single', 'above', 'last') else 'long'}" for c in names))


def _cells(k1: np.ndarray, k2: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """The cell of every digest in each row of the sketch."""
    width = cells // _ROWS
    for i in range(_ROWS):
        yield (W.mix(k1 + np.uint64(i) * (k2 | np.uint64(1))) & np.uint64(width - 1)).astype(np.int64) + i * width


def build_sketch(prefixes: DataFrame, rows: int, bounds: tuple[int, int] = _CELLS) -> np.ndarray:
    """Bits of the count-min cells that count two or more, of (k1, k2). Counts stop at two, as an estimate
    of one is all that is asked; tasks keep two bit planes ("one or more", "two or more")."""
    cells = int(np.clip(1 << (8 * max(rows, 1) - 1).bit_length(), *bounds))
    block = min(cells, _BLOCK)

    def add(planes, one, two):
        planes[1] |= (planes[0] & one) | two
        planes[0] |= one

    def count(batches):
        planes = np.zeros((2, cells // 8), np.uint8)
        for batch in batches:
            k1, k2 = (batch[c].to_numpy().view(np.uint64) for c in ("k1", "k2"))
            for at in _cells(k1, k2, cells):
                at, n = np.unique(at, return_counts=True)
                byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
                edge = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(at) else np.zeros(0, int)
                if len(edge):
                    spot = byte[edge]
                    one, two = np.bitwise_or.reduceat(bit, edge), np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), edge)
                    planes[1][spot] |= (planes[0][spot] & one) | two
                    planes[0][spot] |= one
        for i, (one, two) in enumerate(zip(*(p.reshape(-1, block // 8) for p in planes))):
            if one.any():
                yield pa.record_batch([pa.array([i]), pa.array([one.tobytes()]), pa.array([two.tobytes()])], names=["block", "one", "two"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.zeros((2, block // 8), np.uint8)
        for batch in batches:
            for one, two in zip(batch["one"].to_pylist(), batch["two"].to_pylist()):
                add(planes, np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8))
        yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([planes[1].tobytes()])], names=["block", "bits"])

    merge.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    out = np.zeros(cells // 8, np.uint8)
    sums = prefixes.select("k1", "k2").mapInArrow(count, "block long, one binary, two binary")
    for r in sums.groupBy("block").applyInArrow(merge, "block long, bits binary").toLocalIterator():
        out[r["block"] * (block // 8):(r["block"] + 1) * (block // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def proven(sketch: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Whether the estimate (the least of a digest's cells) is one."""
    out = np.zeros(len(k1), bool)
    for at in _cells(k1, k2, 8 * len(sketch)):
        out |= (sketch[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
    return out


def _streamed(fold: Callable, schema: str) -> Callable:
    """mapInArrow function over rows sorted by node: ``fold`` sees a node's rows in order, in batches."""
    def run(batches):
        node, state = None, None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("depth", "k1", "k2"))))
            out = []
            for i, key in enumerate(keys):
                if key != node:
                    if node is not None:
                        out += [(*node, *r) for r in fold.close(state)]
                    node, state = key, fold.open()
                out += [(*node, *r) for r in fold.step(state, batch, i)]
            if out:
                yield _table(out, schema)
        if node is not None:
            out = [(*node, *r) for r in fold.close(state)]
            if out:
                yield _table(out, schema)

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")))
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


class _Pack:
    """Ids in order → comma-joined packs with their first id."""

    open = staticmethod(list)

    @staticmethod
    def step(ids: list, batch, i):
        ids.append(batch["conv_id"][i].as_py())
        if len(ids) == _IDS_A_PACK:
            full = [(ids[0], ",".join(map(str, ids)))]
            ids.clear()
            return full
        return ()

    @staticmethod
    def close(ids: list):
        return [(ids[0], ",".join(map(str, ids)))] if ids else ()


class _Hash:
    """Packs in order → SHA-256 of all ids."""

    open = staticmethod(lambda: [hashlib.sha256(), b""])

    @staticmethod
    def step(state: list, batch, i):
        state[0].update(state[1] + batch["ids"][i].as_py().encode())
        state[1] = b","
        return ()

    @staticmethod
    def close(state: list):
        return [(state[0].hexdigest(),)]


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of (depth, k1, k2, conv_id): the hash of a node's ids in ascending order.

    The ids of a node may fill many range partitions; each packs its part, and a node's packs then stream
    through one hash, which SHA-256 cannot do otherwise, without being held."""
    node = ["depth", "k1", "k2"]
    packs = (ends.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
             .mapInArrow(_streamed(_Pack, s := "depth long, k1 long, k2 long, first long, ids string"), s))
    return (packs.repartition(*node).sortWithinPartitions(*node, "first")
            .mapInArrow(_streamed(_Hash, s := "depth long, k1 long, k2 long, ends_sha256 string"), s))


def prefix_trie(conversations: DataFrame, cells: tuple[int, int] = _CELLS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of
    the trie of rebuilt conversations (``rebuilt_turns``), the root among them.

    Turns are ordered by turn (null first), then role and text, null role and text being empty; equal rows are
    turns of their own. Rows without conv_id belong to no conversation and are left out. A node is named by
    its smallest member and its depth, which no other node shares. An empty table has no node. Other columns
    are ignored.
    """
    shared_dir(conversations.sparkSession)
    turns = rebuilt_turns(conversations).repartitionByRange("conv_id", "section", "place").sortWithinPartitions("conv_id", "section", "place").checkpoint()
    sketch = build_sketch(scan(turns), turns.count(), cells)
    rows = scan(turns, sketch).checkpoint()
    node, up = ["depth", "k1", "k2"], ["pd", "p1", "p2"]
    parent = (F.col("depth") - 1).alias("pd")
    maybe, alone = rows.where("not single"), rows.where("single")
    groups = (maybe.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
                                       F.first("chars").alias("chars"), F.first("above").alias("above")).checkpoint())
    heads = alone.where("depth > 0 and not above")
    kids = (groups.where("depth > 0 and not above").select(parent, "p1", "p2").unionByName(heads.select(parent, "p1", "p2"))
            .groupBy(*up).agg(F.count(F.lit(1)).alias("n_children")))
    groups = (groups.join(kids.toDF(*node, "n_children"), node, "left").fillna(0, ["n_children"])).checkpoint()
    # a leaf counts at every prefix of its smallest member; so does what a node saves
    leaf = alone.where("last").select("conv_id").unionByName(groups.where("n_children = 0").select("conv_id"))
    leaves = maybe.join(leaf, "conv_id", "left_semi").groupBy(*node).agg(F.count(F.lit(1)).alias("n_leaves"))
    saves = groups.where("n_convs > 1 and chars > 0").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("w"))
    saved = _from_below(maybe.select("conv_id", *node), saves).groupBy(*node).agg(F.sum("below").alias("saved_tokens"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    shared = (groups.join(leaves, node, "left").join(saved, node, "left").join(end_hashes(maybe.where("last").select(*node, "conv_id")), node, "left")
              .select("conv_id", "depth", "p1", "p2", "above", "n_convs", "n_children", "n_leaves", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
                      F.coalesce("ends_sha256", nothing).alias("ends_sha256")))
    tails = alone.select("conv_id", "depth", "p1", "p2", "above", F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"),
                         F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                         F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"))
    every = shared.unionByName(tails)
    root = rows.agg(F.min("conv_id")).first()[0]  # the root's smallest member; half of all nodes may hang below it
    known = every.where("depth < 2 or above").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 0, F.lit(None)).when(F.col("above"), F.col("conv_id")).otherwise(F.lit(root)).cast("long"))
    names = groups.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    asked = every.where("depth > 1 and not above").join(names, ["depth", "p1", "p2"])
    return known.unionByName(asked.select(*known.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _from_below(rows: DataFrame, saves: DataFrame, block: int = 1024) -> DataFrame:
    """``rows`` (conv_id, depth, …) of the conversations of ``saves`` (conv_id, depth, w) with below: their sum of w
    at this depth and deeper. Summed by blocks of depths first, so that no window holds a whole conversation."""
    rows = rows.join(saves.select("conv_id").distinct(), "conv_id", "left_semi").join(saves, ["conv_id", "depth"], "left").withColumn(
        "b", F.floor(F.col("depth") / block)).fillna(0, ["w"])
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "b").agg(F.sum("w").alias("w")).select("conv_id", "b", F.coalesce(F.sum("w").over(deeper), F.lit(0)).alias("rest"))
    inside = Window.partitionBy("conv_id", "b").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("here", F.sum("w").over(inside)).join(blocks, ["conv_id", "b"]).withColumn("below", F.col("here") + F.col("rest"))
