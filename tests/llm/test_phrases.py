"""Collocations against a plain version, and the quicksort against a counter."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_fixtures import edge, empty  # noqa: E402, F401

from cellselect.llm import phrases as P  # noqa: E402

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, part) for (lang, w), a in cand.items() for size in range(2, len(w)) for part in (w[i:i + size] for i in range(len(w) - size + 1))
            if cand.get((lang, part)) == a}
    out = []
    for lang in n:
        scored = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in gone:
                cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    common = ["the", "of", "New", "york", "größe", "x-y", "ha"]
    text = lambda n: " ".join(rng.choice(common + [f"r{rng.randrange(300)}"]) + rng.choice(["", "", "", ",", ".\n", "\t", "!"]) for _ in range(n))
    out = [(rng.choice(["en", "de", None, "und", ""]), text(rng.randrange(0, 80))) for _ in range(300)]
    out += [("en", "one long line that is everywhere. " * 3)] * 40 + [("de", "ha ha ha ha ha ha ha ha"), ("de", None), (None, ""), ("fr", " \t\n.,")]
    out += [("en", "York;new york:new york\x0bnew\x0cyork\ryork new")] * 12
    return out


@pytest.mark.parametrize("hot,bits", [(1 << 20, P._FILTER_BITS), (5, (1 << 16, 1 << 28)), (1 << 20, (64, 64))])
def test_against_a_plain_version(spark, rows, monkeypatch, hot, bits):
    """Also with every pair spread, and with filters that let nearly all through."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(P, "_FILTER_BITS", bits)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("words", "n", "bucket", "word", "doc_id")})
    got = sorted(tuple(r) for r in P.collocations(df, least=6, top=25, hot_weight=hot).collect())
    want = plain(rows, 6, 25)
    assert got == want and len({r[0] for r in want}) >= 4 and any(len(r[2].split()) == 5 for r in want)


def test_all_without_a_top(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in P.collocations(df, least=8, top=None).collect()) == plain(rows, 8, None)


@pytest.mark.parametrize("least", [1, 3])
def test_quicksort_counts_prefixes(least):
    rng = np.random.default_rng(2)
    length = rng.integers(1, 6, 400)
    columns = np.zeros((P.LONGEST + 2, 400), np.uint64)
    columns[0] = rng.integers(1, 3, 400)
    for d in range(1, 6):
        columns[d] = np.where(length >= d, rng.integers(1, 4, 400), 0)
    columns[-1] = rng.integers(1, 3, 400)
    want = Counter()
    for c in columns.T:
        for d in range(2, 6):
            if c[d]:
                want[tuple(c[:d + 1])] += int(c[-1])
    at, depth, n = P.quicksort_counts(columns, least, True)
    got = {tuple(columns[:d + 1, i]): int(c) for i, d, c in zip(at, depth, n)}
    assert got == {k: v for k, v in want.items() if v >= least} and len(at) == len(got)


def test_odd_rows(spark, edge, empty):
    assert sorted(tuple(r) for r in P.collocations(edge, least=20, top=5).collect()) == plain([(r.lang, r.text) for r in edge.collect()], 20, 5)
    assert P.collocations(empty).collect() == []


def test_words_of_a_batch_are_cut_in_little_memory():
    """Working arrays stay in tens of MB whatever the batch holds."""
    import tracemalloc

    import pyarrow as pa
    texts = ["some words of a text, and more of them. " * 5000] * 30  # 6 MB
    batch = pa.record_batch([pa.array(texts), pa.array([1] * 30, pa.int64())], names=["text", "lang_key"])
    tracemalloc.start()
    n = sum(len(words.hash) for _, _, words, _ in P._blocks(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30 * 5000 * 9 and peak < 60 << 20
