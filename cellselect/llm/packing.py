"""Token packing by best-fit decreasing.

Texts are tokenised where they are read; overlong documents are cut into full windows at once, so only
piece sizes travel. Pieces are dealt by hash into groups of bounded size; each group is packed on its
own, longest piece first, into the open window with the least room that still takes it. A segment tree
over the remaining capacities finds that window; a group leaves a window or so unfilled, whatever the
number of groups.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellselect.llm import words as W
from cellselect.session import shared_dir

#: Ids kept per worker for words seen before; beyond it only words asked for again stay.
CACHE_IDS = 8_000_000
#: Words tokenised in one call.
_RUN = 4000
_ENCODERS: dict = {}


class WordEncoder:
    """Token ids of white-space separated words, remembered by word hash.

    Exact for tokenizers that never join across white space: words are encoded in runs with a special
    token between them and cut apart there; words that hold special token text are encoded alone.
    The memory is sorted arrays of hashes (a large one and a recent one that is merged into it); when it is
    full, the words that were not met again since it was last full are forgotten.
    """

    def __init__(self, path: str, cache_ids: int = CACHE_IDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.mark_id, self.mark = special[-1]
        self.special = [content.encode() for _, content in special]
        self.between = f" {self.mark} ".encode()
        self.cache_ids = cache_ids
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Remember exactly these words: sorted keys, number of ids of each, all ids."""
        self.old = (keys, np.arange(len(keys)))
        self.new = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.n, self.used = len(keys), len(flat)
        self.size, self.start = size, np.cumsum(size) - size
        self.flat, self.again = flat, np.zeros(len(keys), bool)

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.r_[x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key in the memory, -1 where it is not there."""
        out = np.full(len(keys), -1)
        for have, slot in (self.old, self.new):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = slot[at[hit]]
        return out

    def _forget(self) -> None:
        keys, slot = (np.concatenate(x) for x in zip(self.old, self.new))
        stay = self.again[slot]
        if 2 * self.size[slot[stay]].sum() > self.cache_ids:
            stay[:] = False
        keys, slot = keys[stay], slot[stay]
        order = np.argsort(keys)
        keys, slot = keys[order], slot[order]
        size = self.size[slot]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[slot], size)
        self._keep(keys, size, self.flat[place])

    def _tokens(self, words: W.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids) of the words at ``at``."""
        length = words.end[at] - words.start[at]
        gap = len(self.between)
        ends = np.cumsum(length + gap)
        joined = np.empty(int(ends[-1]), np.uint8)
        first = ends - length - gap
        inside = np.arange(int(length.sum()))
        shift = np.repeat(np.cumsum(length) - length, length)
        joined[np.repeat(first, length) + inside - shift] = words.data[np.repeat(words.start[at], length) + inside - shift]
        joined[(ends - gap)[:, None] + np.arange(gap)] = np.frombuffer(self.between, np.uint8)
        whole = joined.tobytes()
        if sum(whole.count(s) for s in self.special) > len(at):  # some word holds special text: one by one
            ids = [np.array(self.tokenizer.encode(whole[a:a + n].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                   for a, n in zip(first.tolist(), length.tolist())]
            return np.array([len(x) for x in ids]), np.concatenate(ids)
        ids = np.array(self.tokenizer.encode_batch_fast([whole.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        mark = ids == self.mark_id
        cut = np.flatnonzero(mark)
        return np.diff(np.r_[-1, cut]) - 1, ids[~mark]

    def _add(self, keys: np.ndarray, words: W.Words, at: np.ndarray) -> None:
        for a in range(0, len(at), _RUN):
            size, ids = self._tokens(words, at[a:a + _RUN])
            n = self.n + len(size)
            self.size, self.start, self.again = (self._grown(x, n) for x in (self.size, self.start, self.again))
            self.flat = self._grown(self.flat, self.used + len(ids))
            self.size[self.n:n] = size
            self.start[self.n:n] = self.used + np.cumsum(size) - size
            self.flat[self.used:self.used + len(ids)] = ids
            self.n, self.used = n, self.used + len(ids)
        slots = np.arange(self.n - len(at), self.n)
        self.new = self._merged(self.new, (keys, slots))
        if len(self.new[0]) > max(50_000, len(self.old[0]) // 4):
            self.old, self.new = self._merged(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys, slots = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        return keys[order], slots[order]

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and the word each belongs to."""
        if self.used > self.cache_ids:
            self._forget()
        keys, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        slots = self._slots(keys)
        new = np.flatnonzero(slots < 0)
        self.again[slots[slots >= 0]] = True
        if len(new):
            self._add(keys[new], words, at[new])
            slots[new] = np.arange(self.n - len(new), self.n)
        slot = slots[inverse]
        size = self.size[slot]
        word = np.repeat(np.arange(len(slot)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + self.start[slot][word]
        return self.flat[place], word


def encoder(path: str) -> WordEncoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each row's ids, then ``end_id``, cut into
    full windows and a rest. Null text is empty and has the end id only."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for row, stop, words in W.words_of(batch["text"]):
                flat, word = enc.encode(words)
                doc = np.repeat(np.arange(stop - row), words.counts)[word]
                ids = np.full(len(flat) + stop - row, end_id, np.uint32)
                ids[np.arange(len(flat)) + doc] = flat
                total = np.bincount(doc, minlength=stop - row) + 1
                first = np.cumsum(total) - total
                out = []
                for i in range(stop - row):
                    mine = ids[first[i]:first[i] + total[i]]
                    for a in range(0, len(mine), window):
                        part = mine[a:a + window]
                        out.append((doc_ids[row + i], a, len(part), zlib.crc32(part.tobytes()), int(total[i]), *([part] if with_ids else [])))
                for a in range(0, len(out), 20_000):
                    yield pa.record_batch([pa.array(c, pa.int64() if n != "ids" else pa.list_(pa.int32()))
                                           for n, c in zip(names, zip(*out[a:a + 20_000]))], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class CapacityTree:
    """Open windows by remaining capacity; leaf c counts the windows with room c, inner nodes their sums."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = defaultdict(list)

    def _change(self, room: int, by: int):
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, name: int):
        if room:
            self.open[room].append(name)
            self._change(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and gives (room, name) of the window with the least room of at least ``need``."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, pieces given longest first."""
    tree, sequences = CapacityTree(window), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        found = tree.tightest(need) if need < window else None
        if found is None:
            found, sequences = (window, sequences), sequences + 1
        room, name = found
        sequence[i], offset[i] = name, window - room
        tree.put(room - need, name)
    return sequence, offset


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, group_pieces: int = 20_000,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) with sequence_id and offset.

    One set of pieces for each row, so repeated rows are packed as often as they occur; a null doc_id
    stays null; null or empty text gives the end id only. Ties in length go by doc_id, start and
    checksum, so a rerun packs alike. ``path``: the tokenizer file, at the same place on every executor.
    ``with_ids`` adds the piece's ids. Other columns are ignored.
    """
    shared_dir(docs.sparkSession)
    cut = pieces(docs, path, window, end_id, with_ids).checkpoint()
    groups = max(1, -(-cut.count() // group_pieces))
    names = [*cut.columns, "sequence_id", "offset"]

    def place(key, table):
        table = table.drop_columns(["group"]).sort_by([("length", "descending"), ("doc_id", "ascending"),
                                                       ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(table["length"].to_numpy(), window)
        return pa.table([*table.columns, pa.array(sequence + (key[0].as_py() << 32)), pa.array(offset)], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    return (cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
            .groupBy("group").applyInArrow(place, schema))
