"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks.

Repetitive text shrinks too far, incompressible text hardly at all; what is normal depends on the
length, so every length band has its own limits. One pass, no shuffle, and only one block of text at
a time in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cellselect.llm import words as W

#: (bytes from, least ratio, greatest ratio, greatest ratio of wide texts) of whole texts; compressed
#: size over size in bytes. Below the first band the frame's own bytes decide the ratio, so nothing is
#: asked there. The greatest ratios lie above the prose of four languages (at most 0.92, 0.75, 0.70,
#: 0.59, 0.52, 0.48 and 0.43 in these bands) and from 256 bytes up below base64 and random letters and
#: digits (0.71 or more at any length). Chinese prose has up to 0.81 at 800 bytes and 0.77 at 1100, so
#: random ideographs (0.72 or more) can be told from it only in texts of 4 KB and more.
BANDS = (
    (128, 0.30, 0.96, 1.10),
    (256, 0.20, 0.80, 1.05),
    (512, 0.16, 0.74, 0.95),
    (1024, 0.12, 0.68, 0.85),
    (2048, 0.12, 0.66, 0.76),
    (4096, 0.10, 0.65, 0.70),
    (16384, 0.08, 0.62, 0.67),
)
#: Limits of a chunk, the last for wide texts, and the share of a text's chunks that may lie outside.
CHUNK_LIMITS = (0.10, 0.68, 0.85)
#: A text is wide from this share of characters of three or more bytes (Chinese, Japanese and others):
#: such a character holds more than a Latin letter, and few of them come twice in a short text.
WIDE_SHARE = 0.2
CHUNK_SHARE = 0.25

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COLUMNS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
            ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_bytes", pa.int64()), ("ratio", pa.float64()),
            ("odd_chunks", pa.float64()), ("kept", pa.bool_()))


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each (text, hash) occurs twice or more, and whether it occurred before."""
    order = np.lexsort((hashes, doc))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again, before = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    before[order[1:]] = same
    again[order[1:]] = same
    again[order[:-1]] |= same
    return again, before


def _lines(data: np.ndarray, offsets: np.ndarray, words: W.Words) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.r_[breaks + 1, offsets[:-1]])
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.r_[start[1:], len(data)], offsets[doc + 1])
    end = end - (data[np.maximum(end - 1, 0)] == 10) * (end > start)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[filled], end[filled], doc[filled]
    _, before = _repeats(W.byte_hash(data, start, end), doc)
    return np.bincount(doc[before], minlength=len(offsets) - 1)


def measure(data: np.ndarray, offsets: np.ndarray, repeat_words: int = 8, chunk: int = 4096, level: int = 3,
            bands=BANDS, chunk_limits=CHUNK_LIMITS, chunk_share: float = CHUNK_SHARE) -> list[np.ndarray]:
    """Columns of ``_COLUMNS`` for one block of texts. A band or chunk limit without a value of its own
    for wide texts holds for them as well."""
    words = W.split(data, offsets, False)
    n = words.counts
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    chars = _per_doc((np.cumsum(inside)[:-1] > 0) & ((data & 0xC0) != 0x80), offsets)
    hashes, doc, pos = words.windows(repeat_words)
    again, _ = _repeats(hashes, doc)
    step = np.zeros(len(words.start) + repeat_words + 1, np.int64)
    at = (words.first[:-1][doc] + pos)[again]
    step[at] += 1
    step[at + repeat_words] -= 1
    repeated = _per_doc(np.cumsum(step)[:len(words.start)] > 0, words.first)
    failed = (n < 20) | (100 * repeated > 30 * n)
    wide = _per_doc(data >= 0xE0, offsets) >= WIDE_SHARE * np.maximum(_per_doc((data & 0xC0) != 0x80, offsets), 1)
    packer = zstandard.ZstdCompressor(level=level)
    raw = memoryview(data.tobytes())
    ratio, odd, kept = np.zeros(len(n)), np.zeros(len(n)), ~failed
    for i in range(len(n)):
        text = raw[offsets[i]:offsets[i + 1]]
        if not len(text):
            continue
        ratio[i] = len(packer.compress(text)) / len(text)
        parts = [text[a:a + chunk] for a in range(0, len(text), chunk)]
        parts = [p for p in parts if 4 * len(p) >= chunk]
        most = -1 if wide[i] else 1
        bad = sum(not chunk_limits[0] <= len(packer.compress(p)) / len(p) <= chunk_limits[most] for p in parts)
        odd[i] = bad / len(parts) if parts else 0.0
        limits = [b for b in bands if len(text) >= b[0]]
        most = -1 if wide[i] else 2
        if limits and not limits[-1][1] <= ratio[i] <= limits[-1][most] or odd[i] > chunk_share:
            kept[i] = False
    return [n, chars, _per_doc(_SYMBOL[data], offsets), _lines(data, offsets, words), repeated, failed,
            np.diff(offsets), ratio, odd, kept]


def compression_rules(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` (text and any other columns) with the base counts, ratios and the verdict ``kept``.

    One row for each row; null text counts as empty (ratio 0, not kept). ``odd_chunks`` is the share of
    ``chunk``-byte pieces (a last one under a quarter is left out) outside ``chunk_limits``. Existing
    columns of these names are replaced. ``limits``: see ``measure``.
    """
    base = docs.drop(*[n for n, _ in _COLUMNS])

    def run(batches):
        for batch in batches:
            for row, stop, data, offsets in W.blocks(batch["text"]):
                values = measure(data, offsets, **limits)
                new = [pa.array(v, t) for v, (_, t) in zip(values, _COLUMNS)]
                yield pa.record_batch([*(batch[c][row:stop] for c in batch.schema.names), *new],
                                      names=[*batch.schema.names, *(n for n, _ in _COLUMNS)])

    kinds = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + [f"{n} {kinds[t]}" for n, t in _COLUMNS]
    return base.mapInArrow(run, ", ".join(out))
