"""Perplexities against a plain modified Kneser-Ney model, and doc_ids with several texts."""

import math
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from cellselect.llm import kn_quality as Q  # noqa: E402
from cellselect.llm.words import split  # noqa: E402


def discounts(counts):
    n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]


def plain_perplexity(trained, texts):
    """Mean perplexity per word and end of each text under an interpolated model of the trained texts' words."""
    three = Counter()
    seqs = [["<s>", "<s>", *brute.words(t, True), "</s>"] for t in trained]
    for s in seqs:
        three.update(zip(s, s[1:], s[2:]))
    before, total = defaultdict(set), Counter()
    for (a, b, c), n in three.items():
        before[b, c].add(a)
        total[b, c] += n
    two = {bc: total[bc] if bc[0] == "<s>" else len(before[bc]) for bc in total}
    one = Counter(c for _, c in two)
    size = len({w for s in seqs for w in s[2:-1]}) + 3

    def level(counts, context):
        d = discounts(counts.values())
        cut = {k: d[min(n, 3) - 1] for k, n in counts.items()}
        sums, gone = Counter(), Counter()
        for k, n in counts.items():
            sums[context(k)] += n
            gone[context(k)] += cut[k]
        return {k: (n - cut[k]) / sums[context(k)] for k, n in counts.items()}, {c: gone[c] / sums[c] for c in sums}

    a3, g3 = level(three, lambda k: k[:2])
    a2, g2 = level(two, lambda k: k[0])
    a1, g1 = level(one, lambda k: 0)

    def p(a, b, c):
        low = a1.get(c, 0) + g1[0] / size
        return a3.get((a, b, c), 0) + g3.get((a, b), 1) * (a2.get((b, c), 0) + g2.get(b, 1) * low)

    out = []
    for t in texts:
        s = ["<s>", "<s>", *[w if w in one else "?" for w in brute.words(t, True)], "</s>"]
        out.append(10 ** (-sum(math.log10(p(*x)) for x in zip(s, s[1:], s[2:])) / (len(s) - 2)))
    return out


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(11)
    words, weight = [f"w{i}" for i in range(40)], 1 / np.arange(1, 41)
    return [" ".join(rng.choice(words, rng.integers(1, 60), p=weight / weight.sum())) for _ in range(80)]


def test_perplexity_is_that_of_a_plain_model(spark, prose):
    docs = [(i, t, "en") for i, t in enumerate(prose)] + [(200, "", "en"), (201, "W1 w2\tnever w3 seen", "de"), (202, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    part = F.pmod(F.xxhash64("doc_id", F.lit("kn")), F.lit(1_000_000)) < 750_000
    trained = [r.text for r in df.where("doc_id < 60").where(part).collect()]
    got = {r.doc_id: r for r in Q.quality(df, labels).collect()}
    want = plain_perplexity(trained, [t or "" for _, t, _ in docs])
    assert 30 < len(trained) < 60 and set(got) == {i for i, _, _ in docs}
    for (i, t, lang), w in zip(docs, want):
        assert got[i].n_tokens == len(brute.words(t)) + 1 and got[i].lang == lang
        assert math.isclose(got[i].perplexity, w, rel_tol=0.01), (i, got[i].perplexity, w)


def test_a_doc_id_with_two_texts_is_one_of_its_rows(spark, prose):
    """Text, lang and perplexity belong together, whatever the order of the rows; the same row trains."""
    junk = " ".join(f"zz{i}q" for i in range(40))
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(900, junk, "zz"), (900, prose[3], "en"), (901, prose[4], "de"), (901, prose[4], "aa"), (902, None, "zz"), (902, prose[5], "en")]
    alone = [(1000 + k, t, lang) for k, (_, t, lang) in enumerate(rows[-6:])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(900, 1, 0)], "doc_id long, quality int, toxic int")
    results = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([*order, *alone], "doc_id long, text string, lang string").repartition(5)
        results.append({r.doc_id: r for r in Q.quality(df, labels).collect()})
    assert results[0] == results[1]
    out = results[0]
    single = {(t, lang): out[i] for i, t, lang in alone}
    for i in (900, 901, 902):
        mine = [single[t, lang] for d, t, lang in rows if d == i]
        assert any((out[i].lang, out[i].n_tokens, out[i].perplexity) == (m.lang, m.n_tokens, m.perplexity) for m in mine)
    assert out[901].lang == "aa" and out[902].lang == "en"  # equal texts: smallest lang; a null text comes last


def test_all_training_documents_are_counted(spark, monkeypatch):
    """More trusted documents of a language than any sample held: three quarters of them train."""
    from pyspark.sql import functions as F
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    seen = []

    class Seen(Exception):
        pass

    def vocabulary(text, size):
        seen.append(text.count())
        raise Seen

    monkeypatch.setattr("cellselect.llm.kn_quality._vocabulary", vocabulary)
    for bound in (None, 1000):
        try:
            Q.quality(docs, labels, **({} if bound is None else {"docs_per_lang": bound}))
        except Seen:
            pass
    assert 4300 < seen[0] < 4700 and 800 < seen[1] < 1200


def test_word_numbers_and_keys_travel_short(spark):
    """Prose over a large vocabulary takes under two bytes a word (four before), and comes back whole."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(i), 79_999)}" for i in rng.zipf(1.3, 500)) for _ in range(40)] + [None, "", "never seen"]
    spelt = np.frombuffer(" ".join(f"w{i}" for i in range(80_000)).encode(), np.uint8)
    known = split(spelt, np.array([0, len(spelt)]), True).hash
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.ids for r in Q.encode(docs, known, ("doc_id",)).orderBy("doc_id").collect()]
    assert sum(map(len, got)) < 2 * 500 * 40
    doc, _, _, word = Q._trigrams(got)
    for i, t in enumerate(texts):
        want = [int(w[1:]) + Q.FIRST_WORD if w[1:].isdigit() else Q.UNKNOWN for w in (t or "").split()]
        assert word[doc == i].tolist() == [*want, Q.STOP]
    for depth in (1, 2, 3):
        keys = np.unique(rng.integers(0, 1 << 21 * depth, 1000, dtype=np.uint64))
        assert (Q._keys(Q._trie(keys, 21, depth), 21) == keys).all()
    assert len(Q._keys(Q._trie(np.zeros(0, np.uint64), 21, 3), 21)) == 0
    numbers = np.array([0, 1 << 40, 7], np.uint64)
    assert (Q._unpacked(Q._packed(numbers)) == numbers).all()
