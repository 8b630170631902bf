"""Prefix trie against a plain version: long, tied, absent and copied conversations, many partitions, a tiny sketch."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cellselect.llm import prefix_trie as P  # noqa: E402

SCHEMA = "conv_id long, turn int, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in turns.items()}
    built = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = int(c / 100) * 100
        built[c] = tuple(seqs.get(head, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = {}
    for seq in sorted(members, key=len, reverse=True):
        kids = [out[k] for k in {k for k in members if len(k) == len(seq) + 1 and k[:-1] == seq}]
        ends = ",".join(str(c) for c in sorted(members[seq]) if len(built[c]) == len(seq))
        n = len(members[seq])
        out[seq] = dict(conv_id=min(members[seq]), depth=len(seq), parent_conv_id=min(members[seq[:-1]]) if seq else None, n_convs=n, n_children=len(kids),
                        n_leaves=sum(k["n_leaves"] for k in kids) or 1, saved_tokens=(n - 1) * (len(seq[-1][1]) if seq else 0) + sum(k["saved_tokens"] for k in kids),
                        ends_sha256=hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(tuple, (o.values() for o in out.values())), key=lambda r: r[:2])


def got(df, **kw):
    return sorted((tuple(r) for r in P.prefix_trie(df, **kw).collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "long " * 9]))
            for c in [*range(-205, -95, 7), *range(0, 12), *range(98, 140), 300, 5001] for t in rng.sample([None, 0, 1, 1, 2, 3, 4, 5], rng.randrange(1, 8))]
    rows += [(7000, t, "user", f"turn {t % 3}") for t in range(700)] + [(7001, t, "user", f"turn {t % 3}") for t in range(900)]  # one long one, and one that goes on
    rows += [(c, t, "user", "copied") for c in range(8000, 8060) for t in range(3)]  # copies
    rows += [(400, 0, "user", "only turn"), (401, 0, "user", "gone")]
    rows += [(None, 0, "user", "no conversation"), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells,partitions", [((64, 64), 23), ((1 << 16, 1 << 28), 8)])
def test_odd_conversations(spark, odd_rows, cells, partitions):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "k1", "single", "last", "place")})
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        assert got(df, cells=cells) == plain(odd_rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_turnless_and_empty_table(spark):
    # conversation 7 takes its first turns from conversation 0, which is absent, and has no more of its own
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "x")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows) and len(plain(rows)) == 1
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_sketch_never_proves_a_shared_prefix(spark):
    keys = [(i, i * 7) for i in range(3000)] + [(i, i * 7) for i in range(0, 3000, 3)]
    df = spark.createDataFrame(keys, "k1 long, k2 long").repartition(6)
    sketch = P.build_sketch(df, len(keys), (1 << 15, 1 << 15))
    k = np.arange(3000)
    alone = P.proven(sketch, k.astype(np.uint64), (k * 7).astype(np.uint64))
    assert not alone[::3].any() and alone[np.flatnonzero(k % 3)].mean() > 0.9


def test_scan_over_any_partitioning(spark):
    rows = [(c, i * 3 + c, i - c, 1) for c in (1, 2, 5) for i in range(200 if c == 2 else 3)]
    digests = set()
    for n in (1, 4, 9):
        df = spark.createDataFrame(rows, "conv_id long, h1 long, h2 long, chars long").withColumn("i", __import__("pyspark").sql.functions.monotonically_increasing_id())
        df = df.repartitionByRange(n, "conv_id", "i").sortWithinPartitions("conv_id", "i").drop("i")
        P.shared_dir(spark)
        out = P.scan(df.checkpoint()).collect()
        assert sorted((r.conv_id, r.depth) for r in out) == sorted((c, i) for c in (1, 2, 5) for i in range(200 if c == 2 else 3))
        assert sorted(r.conv_id for r in out if r["last"]) == [1, 2, 5]
        by = {(r.conv_id, r.depth): r for r in out}
        assert all(r.p1 == (by[r.conv_id, r.depth - 1].k1 if r.depth else 0) for r in out)
        digests.add(tuple(sorted((r.conv_id, r.depth, r.k1, r.k2) for r in out)))
    assert len(digests) == 1
