"""Toxicity by two class-conditional Kneser-Ney models.

One interpolated, modified Kneser-Ney bigram model is counted on toxic documents and one on ordinary
ones. Each falls back from its own pairs to its own continuation counts and from those to continuation
counts that both classes share. Expressions that do not tell the classes apart, rare ones above all
(see ``train``), are left to the shared counts alone. A text's evidence is the difference of the two log-likelihoods per token; a logistic curve, fitted
on labelled documents that no count comes from, turns it into a score.

The models learn from a bounded sample (``docs_per_class`` documents and ``chars_per_class`` characters
a class), which bounds the broadcast tables. Scoring is one pass over every row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellselect.llm import words as W
from cellselect.llm.langid import held_out
from cellselect.session import shared_dir

#: Stands for the end of a text; words' hashes are mixed, so none is likely to equal it.
_STOP = np.uint64(1)


@dataclass
class Model:
    """``form``: sorted hashes of the words and word beginnings the models tell apart; ``low`` (probability
    without context) and ``lam`` (weight of ``low`` after this form) have a row each for them, for all
    other words together and, ``lam`` only, for the start. ``pair``: sorted keys of pairs of those rows
    with their discounted share ``alpha``. Columns: toxic, ordinary. ``curve``: weights of the evidence's
    features, None where a class has no documents; ``rate``: share of toxic labels."""

    form: np.ndarray
    low: np.ndarray
    lam: np.ndarray
    pair: np.ndarray
    alpha: np.ndarray
    curve: np.ndarray | None = None
    rate: float = 0.0


def _forms(words: W.Words) -> list[np.ndarray]:
    """Hashes of every word, of its first six and of its first four bytes (a whole word's differs)."""
    return [words.hash, *(W.mix(W.byte_hash(words.data, words.start, np.minimum(words.end, words.start + n)) ^ np.uint64(n)) for n in (6, 4))]


def _numbers(form: np.ndarray, words: W.Words) -> np.ndarray:
    """Row of each word's longest form among ``form``; the row after the last where there is none."""
    out = np.full(len(words.hash), len(form))
    for have in reversed(_forms(words)) if len(form) else ():
        at = np.minimum(np.searchsorted(form, have), len(form) - 1)
        out = np.where(form[at] == have, at, out)
    return out


def _tokens(words: W.Words, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, row before, row) of every word and end of a block's texts."""
    counts = words.counts
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    last = np.cumsum(counts + 1) - 1
    row = np.full(len(doc), np.searchsorted(form, _STOP))  # the end is a form of its own
    inner = np.ones(len(doc), bool)
    inner[last] = False
    row[inner] = _numbers(form, words)
    before = np.empty_like(row)
    before[1:] = row[:-1]
    before[last - counts] = len(form) + 1
    return doc, before, row


def sample(docs: DataFrame, labels: DataFrame, docs_per_class: int, chars_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, toxic, use, text), labelled documents by class); the first of at most about ``docs_per_class`` labelled documents a class, chosen by
    a hash of the id, together no longer than ``chars_per_class``; a fifth of them has ``use`` 'curve', the
    others 'counts'. A doc_id labelled twice is toxic if any label says so; one with several rows counts
    with its smallest text."""
    marks = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("toxic").alias("toxic")))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    found = sizes.groupBy("doc_id").agg(F.max("chars").alias("chars")).join(marks, "doc_id").checkpoint()
    totals = found.groupBy("toxic").agg(F.count(F.lit(1)).alias("c"))  # two rows
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    upto = Window.partitionBy("toxic").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ids = (found.withColumn("place", place).join(totals, "toxic")
           .where(F.col("place") < (1 << 30) * F.least(F.lit(1.0), docs_per_class / F.col("c")))  # bounds the window's rows
           .withColumn("so_far", F.sum("chars").over(upto)).where(F.col("so_far") <= chars_per_class)
           .select("doc_id", "toxic", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, "curve").otherwise("counts").alias("use")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return (texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("use").alias("use"), F.min("text").alias("text")),
            dict(totals.collect()))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and above, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (int((n == i).sum()) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0] + [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))])


def _cut(n: np.ndarray) -> np.ndarray:
    """What is discounted from each count."""
    return _discounts(n)[np.minimum(n, 3).astype(int)]


def _share(n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Discounted shares of counts, what is left over spread by ``back``."""
    total = n.sum()
    return (n - _cut(n) + _cut(n).sum() * back) / total if total else back


def telling_forms(texts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, z) of the words and word beginnings whose shares of toxic and of ordinary documents
    differ by ``least`` standard errors or more."""
    def run(batches):
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False) == 1
            for row, stop, words in W.words_of(batch["text"], True):
                doc = np.repeat(np.arange(stop - row), words.counts)
                some, class_ = [], []
                for hashes in _forms(words):
                    order = np.lexsort((hashes, doc))
                    h, d = hashes[order], doc[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                    some.append(h[new])
                    class_.append(toxic[row:stop][d[new]])
                keys, at = np.unique(np.concatenate(some), return_inverse=True)
                ones = np.bincount(at, weights=np.concatenate(class_), minlength=len(keys)).astype(np.int64)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ones), pa.array(np.bincount(at, minlength=len(keys)) - ones)],
                                      names=["form", "n1", "n0"])

    size = dict(texts.groupBy("toxic").count().collect())
    d1, d0 = max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    both = (F.col("n1") + F.col("n0")) / (d1 + d0)
    # a form that all or no documents have has no spread; half a document keeps the test away from that
    spread = F.sqrt((F.greatest(both * (1 - both), F.lit(0.5 / (d1 + d0)))) * (1 / d1 + 1 / d0))
    z = F.abs(F.col("n1") / d1 - F.col("n0") / d0) / spread
    rows = (texts.select("toxic", "text").mapInArrow(run, "form long, n1 long, n0 long").groupBy("form").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
            .where(F.col("n1") + F.col("n0") >= 3).select("form", z.alias("z")).where(F.col("z") >= least).toArrow())
    form, z = rows["form"].to_numpy().view(np.uint64), rows["z"].to_numpy()
    order = np.argsort(form)
    return form[order], z[order]


def train(texts: DataFrame, limits: tuple[float, ...], pair_least: int = 20) -> list[Model]:
    """Both classes' models from (toxic, text), once for each of ``limits``.

    A word whose ``telling_forms`` z lies below the limit is known by its beginning, or, if that tells
    the classes apart no better, left to the shared counts with all other such words. A pair that occurs
    fewer than ``pair_least`` times in both classes together is left to them too.
    """
    form, z = telling_forms(texts, min(limits))
    vocabulary = [np.union1d(form[z >= least], np.array([_STOP])) for least in limits]
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False) == 1
            for row, stop, words in W.words_of(batch["text"], True):
                for i, form in enumerate(shared.value):
                    doc, before, word = _tokens(words, form)
                    key, at, n = np.unique(before * (len(form) + 2) + word, return_inverse=True, return_counts=True)
                    ones = np.bincount(at, weights=toxic[row:stop][doc], minlength=len(key)).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(key), i)), pa.array(key // (len(form) + 2)), pa.array(key % (len(form) + 2)),
                                           pa.array(ones), pa.array(n - ones)], names=["i", "before", "word", "n1", "n0"])

    pairs = (texts.select("toxic", "text").mapInArrow(run, "i long, before long, word long, n1 long, n0 long")
             .groupBy("i", "before", "word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).checkpoint())
    both = F.col("n1") + F.col("n0")
    # what leaves Spark has a row per form, or per pair that is not rare
    follows = pairs.groupBy("i", "word").agg(*[F.sum((c > 0).cast("long")).alias(a) for a, c in (("n1", F.col("n1")), ("n0", F.col("n0")), ("n", both))]).toPandas()
    totals = pairs.groupBy("i", "before").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()
    often = pairs.where(both >= pair_least).toPandas()
    spread = {c: pairs.where(F.col(c).between(1, 4)).groupBy("i", c).count().toPandas() for c in ("n1", "n0")}
    models = []
    for i, form in enumerate(vocabulary):
        own = lambda rows, i=i: rows[rows["i"] == i]
        size = len(form) + 1
        n = np.zeros((size, 3))
        rows = own(follows)
        n[rows["word"]] = rows[["n1", "n0", "n"]]
        common = _share(n[:, 2], np.full(size, 1 / size))
        low = np.stack([_share(n[:, c], common) for c in (0, 1)], 1)
        total = np.zeros((size + 1, 2))
        rows = own(totals)
        total[rows["before"]] = rows[["n1", "n0"]]
        rows = own(often)
        u, w = rows["before"].to_numpy(), rows["word"].to_numpy()
        alpha = np.stack([(rows[c] - _discounts(np.repeat(own(spread[c])[c], own(spread[c])["count"]))[np.minimum(rows[c], 3)])
                          / np.maximum(total[u, k], 1) for k, c in enumerate(("n1", "n0"))], 1)
        lam = np.clip(1 - np.stack([np.bincount(u, weights=alpha[:, c], minlength=size + 1) for c in (0, 1)], 1), 1e-9, 1)
        key = u * (size + 1) + w
        order = np.argsort(key)
        models.append(Model(form, low.astype(np.float32), lam.astype(np.float32), key[order], alpha[order].astype(np.float32)))
    return models


def log_likelihoods(model: Model, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(natural log-likelihood per token under both classes, tokens) of every text of a block."""
    doc, before, row = _tokens(words, model.form)
    p = model.lam[before] * model.low[row]
    if len(model.pair):
        key = before * (len(model.form) + 2) + row
        spot = np.minimum(np.searchsorted(model.pair, key), len(model.pair) - 1)
        hit = model.pair[spot] == key
        p[hit] += model.alpha[spot[hit]]
    n = words.counts + 1
    logs = np.log(np.maximum(p, 1e-30, dtype=np.float64))
    return np.stack([np.bincount(doc, weights=logs[:, c], minlength=len(n)) / n for c in (0, 1)], 1), n


def evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs`` (columns ``keep``) with n_tokens, ll_toxic and ll_ordinary (per token)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema

    def run(batches):
        for batch in batches:
            for row, stop, words in W.words_of(batch["_text"], True):
                ll, n = log_likelihoods(shared.value, words)
                yield pa.record_batch([*[batch[c][row:stop] for c in keep], pa.array(n, pa.int64()), pa.array(ll[:, 0]), pa.array(ll[:, 1])],
                                      names=[*keep, "n_tokens", "ll_toxic", "ll_ordinary"])

    out = docs.select(*keep, F.col("text").alias("_text"))
    return out.mapInArrow(run, schema.add("n_tokens", "long").add("ll_toxic", "double").add("ll_ordinary", "double"))


def features(ll_toxic: np.ndarray, ll_ordinary: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Evidence per token, the same in units of its spread (which falls with the root of the length), and
    a constant."""
    x = ll_toxic - ll_ordinary
    return np.stack([x, x * np.sqrt(n), np.ones(len(n))], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps, each halved until it does not hurt; (weights, loss)."""
    w, scale = np.zeros(x.shape[1]), np.maximum(np.abs(x).max(0), 1e-9)
    z, weight = x / scale, weight / weight.sum()

    def loss(w):
        m = z @ w
        return (weight * (np.logaddexp(0, m) - y * m)).sum() + ridge * 1e-3 * (w @ w)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 2e-3 * ridge * np.eye(len(w)),
                               z.T @ (weight * (p - y)) + 2e-3 * ridge * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w / scale, loss(w)


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 6000, chars_per_class: int = 16_000_000,
        limits: tuple[float, ...] = (3.0, 4.0, 5.0, 7.0, 10.0)) -> Model:
    """Both models and the curve, from ``labels`` (doc_id, toxic) of ``docs``. Of the ``limits``
    of ``train`` the one whose scores fit the set-aside documents best is taken."""
    shared_dir(docs.sparkSession)
    texts, totals = sample(docs.where("doc_id is not null"), labels, docs_per_class, chars_per_class)
    texts = texts.checkpoint()
    rate = totals.get(1, 0) / max(1, sum(totals.values()))
    models = train(texts.where("use = 'counts'"), limits)
    seen = {(r["use"], r["toxic"]): r["count"] for r in texts.groupBy("use", "toxic").count().collect()}
    if len(seen) < 4:
        models[0].rate = rate
        return models[0]
    best = None
    for model in models:
        rows = evidence(texts.where("use = 'curve'"), model, ["toxic"]).toArrow()
        y = rows["toxic"].to_numpy().astype(float)
        weight = np.where(y == 1, rate / seen['curve', 1], (1 - rate) / seen['curve', 0])  # the classes' shares among all labels
        model.rate = rate
        model.curve, lost = fit_curve(features(rows["ll_toxic"].to_numpy(), rows["ll_ordinary"].to_numpy(), rows["n_tokens"].to_numpy()), y, weight)
        if best is None or lost < best[0]:
            best = lost, model
    return best[1]


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Every row of ``docs`` (columns ``keep``) with n_tokens, ll_toxic, ll_ordinary and score (0 to 1)."""
    out = evidence(docs, model, keep)
    if model.curve is None:
        return out.withColumn("score", F.lit(float(model.rate)))
    x, z, c = (float(v) for v in model.curve)
    d = F.col("ll_toxic") - F.col("ll_ordinary")
    return out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), d * x + d * F.sqrt("n_tokens") * z + F.lit(c)))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """(doc_id, held_out, n_tokens, ll_toxic, ll_ordinary, score, predicted) of every row of ``docs``.

    Learns only from labelled documents whose crc32(doc_id as text) mod 4 is not 2. A null or empty text
    has its end only and is scored like any other; rows without doc_id are scored and learnt from by no
    one; repeated rows are scored each. Without labels of both classes the score is the share of toxic
    labels (0 without any). Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fit(docs.where(~held_out(4, 2)), labels, **bounds)
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "n_tokens", "ll_toxic", "ll_ordinary", "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
