"""Class-conditional Kneser-Ney scores against a plain version, held-out labels and odd rows."""

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from llm_fixtures import documents, edge, empty  # noqa: E402, F401

from cellselect.llm import toxicity as T  # noqa: E402
from cellselect.llm import words as W  # noqa: E402


def plain_models(rows, vocabulary, pair_least, size):
    """P(word | word before) under (toxic, ordinary), for (toxic, words) with words outside ``vocabulary`` as '*'."""
    pairs = (Counter(), Counter())
    for toxic, words in rows:
        seq = ["<s>", *[w if w in vocabulary else "*" for w in words], "</s>"]
        for pair in zip(seq, seq[1:]):
            pairs[0 if toxic else 1][pair] += 1
    every = set(pairs[0]) | set(pairs[1])

    def discount(counts):
        n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]

    def share(follow, back):
        d, total = discount(follow.values()), sum(follow.values())
        if not total:
            return back
        left = sum(d[min(n, 3)] for n in follow.values()) / total
        return lambda w: (follow[w] - d[min(follow[w], 3)]) / total + left * back(w)

    common = share(Counter(w for _, w in every), lambda w: 1 / size)
    out = []
    for mine in pairs:
        low, d, total = share(Counter(w for _, w in mine), common), discount(mine.values()), Counter()
        for (u, _), n in mine.items():
            total[u] += n
        kept = {p: (mine[p] - d[min(mine[p], 3)]) / total[p[0]] if total[p[0]] else 0 for p in every if pairs[0][p] + pairs[1][p] >= pair_least}
        used = Counter()
        for (u, _), a in kept.items():
            used[u] += a
        out.append(lambda u, w, kept=kept, used=used, low=low: kept.get((u, w), 0) + (1 - used[u]) * low(w))
    return out


def test_likelihoods_match_a_plain_model(spark):
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(240):
        text = list(rng.choice(common, 30))
        if i % 3 == 0:
            for spot in rng.integers(0, 30, 4):
                text[spot] = str(rng.choice(["foul", "vile"]))
        rows.append((i % 3 == 0, text))
    texts = spark.createDataFrame([(int(t), " ".join(w)) for t, w in rows], "toxic int, text string")
    model = T.train(texts, (6.0,), 5)[0]
    hashes = {w: W.split(*blk[2:], False).hash[0] for w in [*common, "foul", "vile"] for blk in W.blocks(pa.array([w]))}
    vocabulary = {w for w, h in hashes.items() if h in model.form}
    assert vocabulary == {"foul", "vile"}
    # the words' beginnings are forms too and share in the uniform part
    plain = plain_models(rows, vocabulary, 5, len(model.form) + 1)
    some = ["w1 foul w2 w3 vile vile", "", "foul", "w1 unseen w2 " * 9]
    got, n = next((T.log_likelihoods(model, words)) for _, _, words in W.words_of(pa.array(some), True))
    for text, ll, k in zip(some, got, n):
        seq = ["<s>", *[w if w in vocabulary else "*" for w in text.split()], "</s>"]
        assert k == len(seq) - 1
        for c in (0, 1):
            want = sum(math.log(plain[c](u, w)) for u, w in zip(seq, seq[1:])) / k
            assert math.isclose(ll[c], want, rel_tol=1e-5)


def test_probabilities_sum_to_one(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = documents.join(labels, "doc_id").select("toxic", "text")
    for model in T.train(texts, (2.0, 4.0), 5):
        size = len(model.form) + 1
        for before in (0, size - 1, size):
            for c in (0, 1):
                p = model.lam[before, c] * model.low[:, c].astype(float)
                for key, a in zip(model.pair, model.alpha):
                    if key // (size + 1) == before:
                        p[key % (size + 1)] += a[c]
                assert abs(p.sum() - 1) < 1e-4


def test_held_out_labels(spark):
    from cellselect.llm.queries import QUERIES
    path = "/root/testdata/sf0.1"
    rows = QUERIES["op11_toxicity"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_labels_beyond_the_split_change_nothing(spark, documents):
    """Neither held-out labels nor lang or source are inputs."""
    from pyspark.sql import functions as F
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = T.toxicity(documents, labels).select("doc_id", "score").collect()
    b = T.toxicity(documents.drop("lang").withColumn("source", F.lit("x")), flipped).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_odd_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (3, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = T.toxicity(edge, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in edge.collect())
    assert all(0 <= r.score <= 1 and r.n_tokens == len(brute.words(t, True)) + 1
               for r, t in [(r, next(e.text for e in edge.collect() if e.doc_id == r.doc_id)) for r in out])
    assert {r.score for r in T.toxicity(edge, labels.limit(0)).collect()} == {0.0}
    assert T.toxicity(empty, labels).collect() == []
