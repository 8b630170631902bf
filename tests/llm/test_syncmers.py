"""Anchors against a plain definition of closed syncmers; likeness by positions, without a jump at any length."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from cellselect.llm import syncmers as S  # noqa: E402


def hashed(spark, items):
    """Spark's 64-bit hash of each string."""
    return dict(spark.createDataFrame([(x,) for x in dict.fromkeys(items)], "x string").select("x", F.xxhash64("x")).collect())


@pytest.mark.parametrize("n", [0, 8, 9, 30, 59, 60, 200])
def test_word_anchors_are_closed_syncmers(spark, n):
    rng = random.Random(n)
    words = [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n)]
    h = hashed(spark, words or ["-"])
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    smers = [signed((h[a] << 1) & ((1 << 64) - 1)) ^ h[b] for a, b in zip(words, words[1:])]
    want = []
    for i in range(max(0, n - 8)):  # k-mers of nine words hold eight s-mers of two
        inner = smers[i:i + 8]
        if min(inner) in (inner[0], inner[-1]):
            want.append(i)
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(S.parts(F.col("t")).alias("p")).first().p
    own = [x for x in got.words if x["at"] >= 0]
    assert [x["at"] for x in own] == want
    assert bool(got.chars) == (5 <= len(" ".join(words)) and 0 < n < 60)
    # the same nine words have the same anchor anywhere
    seen = {}
    for x in own:
        assert seen.setdefault(tuple(words[x["at"]:x["at"] + 9]), x["hash"]) == x["hash"]


def alike(spark, pairs):
    m = lambda c: F.struct(S.marks(S.parts(F.col(c))["words"]).alias("words"), S.marks(S.parts(F.col(c))["chars"]).alias("chars"))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"ma": m("a"), "mb": m("b")})
    return [r.x for r in df.select(S.matched(F.col("ma"), F.col("mb")).alias("x")).collect()]


def test_likeness_does_not_jump_at_a_length(spark):
    rng = random.Random(5)
    text = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    cut = lambda n: " ".join(text[:n])
    got = alike(spark, [(cut(n), cut(n + 2)) for n in range(50, 70)])
    assert min(got) > 0.6, got


def test_positions_count(spark):
    """The same passages in another order keep their anchors but lose the distances between them."""
    rng = random.Random(6)
    blocks = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(20)]
    text, moved = " ".join(blocks), " ".join(rng.sample(blocks, 20))
    later = "some words before " * 5 + text
    same, shuffled, shifted, other = alike(spark, [(text, text), (text, moved), (text, later), (text, " ".join(f"v{i}" for i in range(240)))])
    assert same == 1 and other == 0 and shifted > 0.8 and 0 < shuffled < 0.5


def test_odd_texts(spark):
    got = alike(spark, [("", ""), ("", "one two"), ("a", "a"), (" \t", ""), ("x" * 9000, "x" * 9001)])
    assert got[0] == 1 and got[2] == 1 and all(0 <= x <= 1 for x in got)
