"""Language identification by word-first backoff.

A known word scores its log frequency in each language. A word that no language knows is scored by
its character n-grams: the longest length at which any n-gram is known, averaged over those n-grams.
A document's score is the mean over its words; the best language wins.

The model is fitted on a sample of labelled rows of bounded size (``docs_per_lang``) and keeps every word
and n-gram of it, so its broadcast size is bounded by the sample, whatever the corpus holds. Prediction reads every row once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellselect.llm import words as W

LENGTHS = (6, 5, 4, 3, 2, 1)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# Word breaks: all ASCII but letters. Other scripts' characters count as letters here.
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[65:91] = _BREAK[97:123] = False
_CP_BASE = 0x8CB92BA72F3D8DD7


def held_out(modulus: int, rest: int):
    """Rows whose crc32(doc_id as text) leaves ``rest``; false without a doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def _split(texts: pa.Array):
    for row, stop, data, offsets in W.blocks(pc.utf8_lower(texts.fill_null(""))):
        spaced = np.where(_BREAK[data], np.uint8(32), data)
        yield row, stop, W.split(spaced, offsets, False)


def _unique_words(words: W.Words):
    keys, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    return keys, at, inverse


def _spell(words: W.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (zero padded) of the words at ``at``, with a space before and after; and lengths."""
    raw = words.data.tobytes()
    texts = [" " + raw[s:e].decode("utf-8", "replace") + " " for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]
    size = np.array([len(t) for t in texts], np.int64)
    points = np.zeros((len(texts), int(size.max())), np.uint64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    points[np.repeat(np.arange(len(texts)), size), col] = flat
    return points, size


def _grams(points: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of all character n-grams of one length."""
    width = points.shape[1] - n + 1
    if width <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros((len(points), width), np.uint64)
    for k in range(n):
        h = h * np.uint64(_CP_BASE) + points[:, k:k + width] + np.uint64(1)
    word, col = np.nonzero(np.arange(width)[None, :] <= (size - n)[:, None])
    return W.mix(h[word, col] + np.uint64(n * 0xA24BAED4963EE407 % 2**64)), word


def _pieces(words: W.Words, at: np.ndarray, todo: np.ndarray, cells: int = 400_000):
    """Runs of ``todo`` (places in ``at``) of like word length, so that a run's matrix of characters stays
    at about ``cells`` whatever the longest word."""
    size = words.end[at[todo]] - words.start[at[todo]] + 2
    order = np.argsort(size, kind="stable")
    todo, size = todo[order], size[order]
    row = 0
    while row < len(todo):
        stop = row + 1 + int(np.searchsorted(size[row + 1:] * np.arange(2, len(todo) - row + 1), cells, "right"))
        yield todo[row:stop]
        row = stop


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, length, key, count) over the training rows, languages as numbers; length 0 stands for whole words."""
    schema = pa.schema([("lang", pa.int32()), ("length", pa.int32()), ("key", pa.int64()), ("count", pa.int64())])

    def count(batches):
        for batch in batches:
            langs = batch["lang"].to_numpy()
            for row, stop, words in _split(batch["text"]):
                doc = np.repeat(np.arange(stop - row), words.counts)
                for lang in sorted(set(langs[row:stop])):
                    mine = np.flatnonzero(langs[row:stop][doc] == lang)
                    keys, at, n = np.unique(words.hash[mine], return_index=True, return_counts=True)
                    found = [(0, keys, n)]
                    for part in _pieces(words, mine[at], np.arange(len(keys))):
                        points, size = _spell(words, mine[at[part]])
                        for length in LENGTHS:
                            h, word = _grams(points, size, length)
                            k, inv = np.unique(h, return_inverse=True)
                            found.append((length, k, np.bincount(inv, weights=n[part][word], minlength=len(k)).astype(np.int64)))
                    for length, k, c in found:
                        yield pa.record_batch([pa.array(np.full(len(k), lang, np.int32)), pa.array(np.full(len(k), length, np.int32)),
                                               pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], schema=schema)

    return (docs.select("lang", "text").mapInArrow(count, "lang int, length int, key long, count long")
            .groupBy("lang", "length", "key").agg(F.sum("count").alias("count")))


@dataclass
class Model:
    """Per n-gram length (0: words) the sorted keys and one log10 frequency per language."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def find(self, length: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[length]
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def words(self, words: W.Words, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score per distinct word and language, and whether the word could be scored."""
        scores = np.zeros((len(keys), len(self.langs)), np.float32)
        place, known = self.find(0, keys)
        scores[known] = self.logs[0][place[known]]
        for todo in _pieces(words, at, np.flatnonzero(~known)):
            points, size = _spell(words, at[todo])
            for length in LENGTHS:
                h, word = _grams(points, size, length)
                place, hit = self.find(length, h)
                word = word[hit]
                n = np.bincount(word, minlength=len(todo))
                got = n > 0
                for i in range(len(self.langs)):
                    total = np.bincount(word, weights=self.logs[length][place[hit], i], minlength=len(todo))
                    scores[todo[got], i] = (total[got] / n[got]).astype(np.float32)
                known[todo[got]] = True
                todo, points, size = todo[~got], points[~got], size[~got]
                if not len(todo):
                    break
        return scores, known


def fit(labelled: DataFrame, docs_per_lang: int = 2000, penalty: float = 1.0) -> Model:
    """Model of the rows (doc_id, text, lang) with text and lang.

    At most about ``docs_per_lang`` rows of each language are used, chosen by a hash of the id, with every
    word and n-gram that they have. A key that a language lacks costs ``penalty`` more than the rarest key
    of any language.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = dict(rows.groupBy("lang").count().collect())
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {})
    by_lang = lambda of: F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(of(lang)))])[F.col("lang")]
    share = by_lang(lambda lang: min(1.0, docs_per_lang / sizes[lang]))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).withColumn("lang", by_lang(langs.index).cast("int"))
    table = _counts(chosen).toArrow()  # as many keys as the sample has
    lang, length, key = table["lang"].to_numpy(), table["length"].to_numpy(), table["key"].to_numpy().view(np.uint64)
    count = table["count"].to_numpy()
    total = np.zeros((len(langs), max(LENGTHS) + 1))
    np.add.at(total, (lang, length), count)
    freq = np.log10(count / total[lang, length])
    keys, logs = {}, {}
    for n in (0, *LENGTHS):
        mine = length == n
        keys[n], at = np.unique(key[mine], return_inverse=True)
        floor = (freq[mine].min() if mine.any() else 0.0) - penalty
        logs[n] = np.full((len(keys[n]), len(langs)), floor, np.float32)
        logs[n][at, lang[mine]] = freq[mine]
    return Model(langs, keys, logs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (share of the best language, 0 to 1), one row for each row.

    Null text, text without a letter, or an empty model gives ``und`` and score 0. Ties go to the
    first language in code point order. Existing columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "score")
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch["text"]
            preds, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            letters = np.fromiter((x is not None and _LETTER.search(x) is not None for x in map(pa.StringScalar.as_py, texts)), bool, len(texts))
            for row, stop, words in _split(texts) if model.langs else ():
                keys, at, inverse = _unique_words(words)
                if not len(keys):
                    continue
                table, known = model.words(words, at, keys)
                doc = np.repeat(np.arange(stop - row), words.counts)
                ok = known[inverse]
                doc, inverse = doc[ok], inverse[ok]
                n = np.bincount(doc, minlength=stop - row)
                mean = np.stack([np.bincount(doc, weights=table[inverse, i], minlength=stop - row) for i in range(len(model.langs))], 1)
                mean /= np.maximum(n, 1)[:, None]
                best = mean.argmax(1)
                share = 1 / np.power(10.0, mean - mean.max(1, keepdims=True)).sum(1)
                some = (n > 0) & letters[row:stop]
                preds[row:stop][some] = np.array(model.langs, object)[best[some]]
                scores[row:stop][some] = share[some]
            yield pa.record_batch([*(batch[c] for c in batch.schema.names), pa.array(preds.tolist(), pa.string()), pa.array(scores)],
                                  names=[*batch.schema.names, *schema.names])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{out}, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, rest: int = 2, **options) -> DataFrame:
    """Learn from the rows outside the held-out part, predict all of (doc_id, text, lang). Every row is
    predicted for itself, repeated ids and rows without one too; those without one are not learnt from."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(modulus, rest))
    model = fit(rows.where("not held_out and doc_id is not null"), **options)
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
