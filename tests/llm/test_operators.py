"""The ten operators against plain versions, on small tables and on odd rows."""

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from llm_fixtures import documents, edge, empty  # noqa: E402, F401

PUBLIC = "word_bpe_49k.json"


def texts(df):
    """doc_id → text as the operators count it: one per id, rows without id left out."""
    return {r[0]: r[1] for r in df.where("doc_id is not null").select("doc_id", "text").distinct().collect()}.items()


# --- words --------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_words_at_any_block_size(block):
    from cellselect.llm.words import words_of
    rows = ["Hello  world\tA b", "", None, "x", "éa b c\nd", "  lead ", "Hello world", " ", "ÄB\x0bc\x0cd\re"]
    got, hashes = [], []
    for row, stop, w in words_of(pa.array(rows), True, block):
        for d in range(stop - row):
            span = range(w.first[d], w.first[d + 1])
            got.append([bytes(w.data[w.start[i]:w.end[i]]).decode() for i in span])
            hashes.append(tuple(w.hash[list(span)].tolist()))
    assert got == [brute.words(t, True) for t in rows]
    assert hashes[0][:2] == hashes[6] and len(set(hashes)) == 7


def test_bucket_follows_key_order():
    from cellselect.llm.chunks import bucket_of
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    b = bucket_of(keys, 37)
    assert (np.diff(b.astype(int)) >= 0).all() and b.max() <= 36


# --- 1 ------------------------------------------------------------------------------------------

def joined(df, **kw):
    from cellselect.llm.ngram_join import ngram_components
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df, **kw).collect()}


def test_ngram_join_odd_rows(edge, empty):
    assert joined(edge) == brute.components(texts(edge))
    assert joined(empty) == {}


@pytest.mark.parametrize("block", [3, 256])
def test_ngram_join_chains_and_blocks(spark, block):
    """A drifting chain of near copies, groups at the threshold's edge, and a passage all share."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    docs, text, common = [], list(rng.choice(vocabulary, 80)), list(rng.choice(vocabulary, 40))
    for i in range(70):
        spot = rng.integers(0, 80, rng.integers(1, 4))
        for s in spot:
            text[s] = str(rng.choice(vocabulary))
        docs.append((i, " ".join(text)))
    for i in range(70, 100):
        docs.append((i, " ".join([*common, *rng.choice(vocabulary, rng.integers(0, 25))])))
    want = brute.components(docs)
    got = joined(spark.createDataFrame(docs, "doc_id long, text string"), block=block, chunk_words=500)
    assert got == want and 1 < len({c for _, c in want.values()}) < 100


# --- 2 ------------------------------------------------------------------------------------------

def test_preferences_odd_conversations(spark):
    from cellselect.llm.preferences import format_preferences, swapped_tails
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, None, None), (2, None, "user", "q"),
            (None, 0, "user", "lost"), (3, 0, "assistant", "z"), (5, 0, "user", "a"), (5, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = {r.pair_id: r for r in format_preferences(swapped_tails(table)).collect()}
    assert set(out) == {1, 2, 3, 5}
    for r in out.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            for s in spans:
                assert text[s.start:s.end].endswith("<|im_end|>") and text[:s.start].endswith("assistant\n")
    assert out[5].n_common == 1 and out[5].rejected == "" and out[5].chosen_spans
    assert format_preferences(swapped_tails(table.limit(0))).count() == 0
    same = spark.sql("SELECT 1 pair_id, array(struct('user' role, 'x' text)) chosen, array(struct('user' role, 'x' text)) rejected")
    r = format_preferences(same.unionByName(same.selectExpr("2 pair_id", "chosen", "null rejected"))).orderBy("pair_id").collect()
    assert (r[0].n_common, r[0].chosen, r[0].rejected) == (1, "", "") and (r[1].n_common, r[1].prompt) == (0, "")


# --- 3 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("source", ["edge", "documents"])
def test_packing_round_trip(source, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cellselect.llm.packing import pack
    df = request.getfixturevalue(source)
    path = public_tokenizers.path(PUBLIC)
    rows = pack(df, path, group_pieces=40, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.collect())
    built: dict = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes()) and len(r.ids) == r.length
        built.setdefault((r.doc_id, r.start, tuple(r.ids)), 0)
        built[(r.doc_id, r.start, tuple(r.ids))] += 1
    for (doc_id, ids), n in want.items():
        for a in range(0, len(ids), 2048):
            assert built.pop((doc_id, a, ids[a:a + 2048])) == n
    assert not built
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_empty_and_special_words(empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from cellselect.llm.packing import encoder, pack
    from cellselect.llm.words import words_of
    path = public_tokenizers.path(PUBLIC)
    assert pack(empty, path).count() == 0
    tokenizer = Tokenizer.from_file(path)
    tricky = ["a<|endoftext|>b <|ENDOFTEXT|> it's don't", "ΑΣ ΟΔΟΣ é  x", "<|startoftext|>"]
    for _, _, w in words_of(pa.array(tricky)):
        ids, word = encoder(path).encode(w)
        for d, text in enumerate(tricky):
            mine = ids[(word >= w.first[d]) & (word < w.first[d + 1])]
            assert mine.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    from cellselect.llm.packing import best_fit_decreasing
    lengths = np.sort(np.random.default_rng(3).integers(1, 101, 400))[::-1]
    sequence, offset = best_fit_decreasing(lengths, 100)
    room, opened = {}, 0
    for need, s, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        fits = [r for r in room.values() if r >= need]
        assert (min(fits) if fits else 100) == room.get(s, 100) == 100 - at
        room[s] = 100 - at - need
    assert len(room) <= 1.1 * lengths.sum() / 100 + 1


# --- 4 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kw", [{}, {"chunk_words": 300}, {"window": 3}, {"window": 25, "width": 2}])
def test_substring_dedup(edge, empty, documents, kw):
    from cellselect.llm.substring_dedup import drop_repeats
    for df in (edge, documents) if not kw else (edge,):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in drop_repeats(df, **kw).collect()}
        assert got == brute.without_repeats(texts(df), kw.get("window", 13))
    assert drop_repeats(empty, **kw).count() == 0


# --- 5 ------------------------------------------------------------------------------------------

def test_bloom_filter_never_misses():
    from cellselect.llm import bloom_lm as B
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    count = rng.zipf(1.5, 5000).clip(max=10**6)
    part = B.build_part(keys & B._SHORT, count, 1 << 22, 12, 4)
    got = B.Filter({0: part}, 1, 4, 0, 0).levels(keys)
    assert (got >= B.level(count)).all() and (got == B.level(count)).mean() > 0.98
    other = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    assert (B.Filter({0: part}, 1, 4, 0, 0).levels(other) > 0).mean() < 0.02
    least = np.frombuffer(B.build_part(keys, count, 1 << 13, 12, 4)[:8], np.int64)[0]
    assert least > 1 and len(B.build_part(keys, count, 1 << 13, 12, 4)) <= (1 << 10) + 16


def test_lm_scores(edge, empty, documents):
    from cellselect.llm.bloom_lm import score
    assert score(empty).count() == 0
    rows = score(edge, chunk_words=100).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    got = {r.doc_id: r for r in score(documents).collect()}
    tokens = {i: [*brute.words(t, True), None] for i, t in texts(documents)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(t for i in train for t in tokens[i])
    total, distinct = sum(count.values()), len(count)
    for i, mine in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(mine), sum(count[t] > 0 for t in mine), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in mine))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("filter_bits", [1 << 28, 1 << 14])
def test_lm_scores_use_every_counted_ngram(documents, filter_bits):
    """A filter too small for the rare levels gives the scores of the counts all the same."""
    from cellselect.llm import bloom_lm as B
    got = {r.doc_id: r.score for r in B.score(documents, filter_bits=filter_bits, bits_per_item=40, probes=8, chunk_words=2000).collect()}
    tokens = {i: [None, *brute.words(t, True), None] for i, t in texts(documents)}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
    total = sum(one.values()) + len(one) + 1
    count = lambda n: float(B.level_count(B.level(np.array([n])))[0])
    for i, t in tokens.items():
        want = 0.0
        for a, b in zip(t, t[1:]):
            before, single = count(one[a]), (count(one[b]) + 1) / total
            want += math.log10(0.6 * min(count(two[a, b]), before) / before + 0.4 * single if before else single)
        assert got[i] == pytest.approx(want, rel=1e-3)


# --- 6 ------------------------------------------------------------------------------------------

def test_mixing_meets_targets_and_reruns_agree(spark, documents):
    from cellselect.llm.mixing import mix, sizes
    docs = sizes(documents.select("doc_id", "source", "text")).drop("text")
    docs = docs.withColumn("source", F.when(F.col("source") != "src3", F.substring("source", 1, 4)))
    rows = mix(docs).collect()
    assert sorted(rows, key=str) == sorted(mix(docs.repartition(5)).collect(), key=str)
    weight, size = dict(zip(sorted({r.source for r in rows if r.source}), [5, 2, 1] * 10)), Counter()
    weight[None] = [5, 2, 1][len(weight) % 3]
    for r in rows:
        size[r.source] += r.size
        assert 0 <= r.copies <= 2
    left, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.copies * r.size
    for s in size:
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 60)


def test_mixing_odd_rows(edge, empty):
    from cellselect.llm.mixing import mix, sizes
    out = mix(sizes(edge)).select("doc_id", "size", "copies", "rank").collect()
    assert len(out) == edge.count() and all(0 <= r.copies <= 2 and r["rank"] == "extra" for r in out)
    assert mix(sizes(empty)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------

def test_kneser_ney_sums_to_one_and_separates(spark):
    from cellselect.llm import kn_quality as Q
    rng = np.random.default_rng(8)
    good = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], 60, p=[.4, .3, .15, .1, .05])), "en") for i in range(60)]
    bad = [(i, " ".join(f"z{rng.integers(1e6)}" for _ in range(60)), "en") for i in range(60, 70)]
    docs = spark.createDataFrame([*good, *bad, (70, None, None), (71, "", "xx"), (None, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(60, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.quality(docs, labels, vocabulary_size=100, quantile=0.95).collect()}
    assert set(out) == set(range(72))
    assert sum(out[i].kept for i in range(60)) >= 54 and not any(out[i].kept for i in range(60, 70))
    trusted = docs.where("doc_id < 50")
    vocabulary, others = Q._vocabulary(trusted, 100)
    table, unigram = Q.train(trusted, vocabulary)
    model = {r.key: (r.alpha, r.gamma) for r in table.collect()}
    assert unigram[:, 0].sum() == pytest.approx(1, abs=1e-5)
    for a in (Q.START, 3, 4, 5):
        for b in (3, 4, 5):
            p = 0.0
            for c in range(len(unigram)):
                low = model.get((1 << 48) | (b << 16) | c, (0, 1))[0] + unigram[b, 1] * unigram[c, 0]
                p += model.get((a << 32) | (b << 16) | c, (0, 1))[0] + model.get((1 << 48) | (a << 16) | b, (0, 1))[1] * low
            assert p == pytest.approx(1, abs=1e-4)


def test_kneser_ney_knows_every_word_and_uses_every_trusted_row(spark):
    """A small language's words, each seen twice, count beside 70,000 frequent ones of another; trusted
    rows above the sample set thresholds."""
    from cellselect.llm import kn_quality as Q
    big = [(i, " ".join(f"w{j}" for j in range(i % 100 * 700, i % 100 * 700 + 700)), "aa") for i in range(600)]
    small = [(1000 + i, f"dies ist ein kleiner satz nummer{i // 20}", "zz") for i in range(200)]
    odd = [(2000, "klein zq xq yq vq uq", "zz")]
    docs = spark.createDataFrame([*big, *small, *odd], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], 1, 0) for d in [*big, *small]], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    mean = lambda lang: np.mean([math.log10(r.perplexity) for r in out.values() if r.lang == lang and r.doc_id < 2000])
    assert mean("zz") < 1 and mean("aa") < 1 and not out[2000].kept
    few = {r.doc_id: r for r in Q.quality(docs.where("lang = 'zz'"), labels, docs_per_lang=20, quantile=1.0).collect()}
    worst = max(r.perplexity for i, r in few.items() if i < 2000)
    assert few[1000].threshold == pytest.approx(worst, rel=0.01)


def test_kn_without_trusted_rows(edge, empty, spark):
    from cellselect.llm.kn_quality import quality
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality(edge, none).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in texts(edge)} and all(r.kept for r in rows)
    assert quality(empty, none).count() == 0


# --- 8 ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("source", ["edge", "documents"])
def test_compression_base_counts(source, request):
    from cellselect.llm.compression_rules import compression_rules
    df = request.getfixturevalue(source)
    rows = compression_rules(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(r.text)
        assert not (r.base_failed and r.kept)


def test_compression_verdicts(spark, empty):
    from cellselect.llm.compression_rules import compression_rules
    rng = np.random.default_rng(4)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 40)) for _ in range(200))
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(2000))
    stutter = " ".join(f"item {i} is {'very ' * 5}{i % 3} fine" for i in range(400))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, stutter)], "doc_id long, text string")
    got = {r.doc_id: r for r in compression_rules(df, bands=((128, 0.2, 0.6),)).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept
    assert compression_rules(empty).count() == 0


CHINESE = (
    "今天早上下了一场小雨，街上的行人不多，只有几个学生撑着伞往学校走。我在路口的小店里买了一杯热豆浆和两个包子，坐在窗边慢慢地吃。"
    "店主是一位六十多岁的老人，他告诉我这家店已经开了三十年，最早的时候只卖油条，后来孩子们长大了，才加上了面条和馄饨。"
    "他说做生意最要紧的是诚实，材料要新鲜，价钱要公道，客人吃得放心，明天自然还会再来。吃完早饭，雨也停了，我沿着河边走到图书馆，"
    "打算查一些关于古代水利工程的资料。馆里很安静，书架上摆满了各个朝代的地方志，我翻开其中一本，里面详细记载了当地修建堤坝的经过，"
    "包括用了多少工人、花了多少银两，以及完工以后粮食产量的变化。中午的时候，一位研究历史的朋友打来电话，约我下午一起去看新发现的石碑。"
    "石碑立在村子东边的山坡上，字迹虽然模糊，但仍可以认出年号和几个人名。我们拍了照片，又向村里的长辈请教，才知道这里从前有一座书院，"
    "许多读书人曾在此讲学。傍晚回家的路上，天边出现了一道彩虹，孩子们高兴得又跳又叫，我也觉得这一天过得很有意思。")


def test_compression_production_limits(spark, documents):
    """The limits as registered: random text of any alphabet goes, prose stays."""
    import base64
    import string

    from cellselect.llm.compression_rules import compression_rules
    rng = np.random.default_rng(4)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 40)) for _ in range(200))
    some = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(n // 5))[:n]
    bad = [noise]
    for n in (700, 2000, 6000, 20000):
        bad += [base64.encodebytes(rng.bytes(max(n, 2000))).decode()[:max(n, 2000)], some(string.ascii_letters + string.digits + string.punctuation, n),
                some(string.ascii_letters + string.digits, n)]
    bad.append(some(string.ascii_lowercase[:9], 9000) + " " + base64.encodebytes(rng.bytes(6000)).decode())  # a third is base64
    spaced = " ".join(CHINESE[i:i + 9] for i in range(0, len(CHINESE), 9))  # twenty words or more, as the base rules ask
    good = [spaced[:n] for n in (220, 280, 400, len(spaced))]
    rows = [(i, t) for i, t in enumerate(bad)] + [(100 + i, t) for i, t in enumerate(good)]
    got = {r.doc_id: r for r in compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in got if got[i].kept] == [100 + i for i in range(len(good))]
    prose = compression_rules(documents.where("lang is not null")).where("not base_failed and n_bytes >= 128 and ratio > 0.35").collect()
    assert len(prose) > 100 and all(r.kept for r in prose)


# --- 9 ------------------------------------------------------------------------------------------

def test_syncmers_are_context_free(spark):
    from cellselect.llm.syncmers import anchors, likeness, hashes
    rng = np.random.default_rng(6)
    core = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 200))
    rows = [(1, core), (2, "some words before " + core), (3, core + " and after"), (4, " ".join(f"q{i}" for i in range(200)))]
    df = spark.createDataFrame(rows, "id long, text string").select("id", anchors(F.col("text")).alias("a"), hashes(F.col("text")).alias("h"))
    got = {r.id: r for r in df.collect()}
    shifted = {(x.hash, x.at + 3) for x in got[1].a}
    assert shifted <= {(x.hash, x.at) for x in got[2].a} and {(x.hash, x.at) for x in got[1].a} <= {(x.hash, x.at) for x in got[3].a}
    assert 0.15 < len(got[1].a) / 192 < 0.35
    near = {r.j: r.v for r in df.alias("x").where("id = 1").join(df.select(F.col("id").alias("j"), F.col("h").alias("g")))
            .select("j", likeness(F.col("h"), F.col("g")).alias("v")).collect()}
    assert near[1] == 1 and near[2] > 0.9 and near[3] > 0.9 and near[4] < 0.05


@pytest.mark.parametrize("source", ["edge", "documents"])
def test_fingerprints_and_edits(source, request):
    from cellselect.llm.syncmers import fingerprints_and_edits
    df = request.getfixturevalue(source)
    docs = sorted(((i, t or "") for i, t in texts(df)), reverse=True)
    got = {r.doc_id: r for r in fingerprints_and_edits(df).collect()}
    assert len(got) == len(docs)
    by_text: dict = {}
    for at, (i, text) in enumerate(docs):
        after, half = docs[(at + 1) % len(docs)][1], len(text) // 2
        assert got[i].n_chars == len(text) and got[i].edited_text == text[:len(text) - half] + after[:half]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_fingerprints_empty_and_positions(spark, empty):
    from cellselect.llm.syncmers import fingerprints_and_edits, match_positions
    assert fingerprints_and_edits(empty).count() == 0
    words = [f"w{i * i % 997}" for i in range(120)]
    left = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    right = spark.createDataFrame([(9, " ".join(["pre"] * 4 + words))], "doc_id long, text string")
    best = max(match_positions(left, right).collect(), key=lambda r: r.n)
    assert (best.a, best.b, best["shift"]) == (1, 9, 4)


def test_short_and_unspaced_texts_are_near_their_edits(spark):
    from cellselect.llm.syncmers import fingerprints_and_edits
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 9)))
    rows = [" ".join(word() for _ in range(n)) for n in (4, 6, 8, 9, 12, 17, 18, 25, 40, 59, 61, 80)]
    rows += ["".join(chr(c) for c in rng.integers(a, b, n)) for a, b in ((0x4E00, 0x9000), (0x3041, 0x3090), (0x0E01, 0x0E2F)) for n in (30, 300, 2000)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in fingerprints_and_edits(df).collect():
        assert r.near_edited > 0 and r.near_edited > r.near_next, r


# --- 10 -----------------------------------------------------------------------------------------

def test_language_held_out_accuracy(documents):
    from cellselect.llm.langid import identify
    out = identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] >= 0.95 and 0 <= held[1] <= held[2] <= 1


def test_language_odd_rows(edge, empty, spark):
    from cellselect.llm.langid import fit, identify, predict
    rows = identify(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if r.doc_id in (4, 5, 6, 11):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert identify(empty).count() == 0
    silent = identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in silent} == {"und"}
    model = fit(spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund lag", "de")], "doc_id long, text string, lang string"))
    out = predict(spark.createDataFrame([(1, "catsat"), (2, "hundlag")], "doc_id long, text string"), model)
    assert [r.lang_pred for r in out.orderBy("doc_id").collect()] == ["en", "de"]  # by character n-grams


def test_mixing_raises_when_it_does_not_converge(spark):
    from cellselect.llm.mixing import tilt
    cells = spark.createDataFrame([("a", 10, 5), ("a", 400, 3)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 700.0)], "source string, target double")
    assert abs(tilt(cells, targets).count()) == 1
    with pytest.raises(RuntimeError, match="still off its target"):
        tilt(cells, targets, rounds=1)


def test_language_model_keeps_every_word_of_its_sample(spark):
    from cellselect.llm.langid import fit
    words = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(15_000)]
    rows = [(i, " ".join(words[i * 50:(i + 1) * 50]), "aa") for i in range(300)]
    assert len(fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).keys[0]) == len(set(words))


@pytest.mark.parametrize("room", [10, 400, 10**7])
def test_remembered_words_encode_as_the_tokenizer_does(room):
    """With a memory that holds nothing, some or all of the words; special token text, odd bytes, growing blocks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from cellselect.llm import words as W
    from cellselect.llm.packing import WordEncoder
    path = public_tokenizers.path(PUBLIC)
    enc, plain = WordEncoder(path, room), Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}é" for i in range(300)] + [enc.mark, f"a{enc.mark}b", "naïve", "x" * 500, "日本語"]
    for n in (1, 40, 200, 200, 3, 500):
        texts = [" ".join(rng.choice(vocabulary, n)) for _ in range(3)] + ["", None, "one"]
        for row, stop, words in W.words_of(pa.array(texts)):
            ids, word = enc.encode(words)
            for d in range(row, stop):
                mine = ids[(word >= words.first[d - row]) & (word < words.first[d - row + 1])]
                want = [i for w in brute.words(texts[d]) for i in plain.encode(w, add_special_tokens=False).ids]
                assert mine.tolist() == want
