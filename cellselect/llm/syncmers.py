"""Document fingerprints from closed syncmers over words.

A k-mer (k consecutive words) is an anchor when the smallest hash among its inner s-mers stands at its
first or its last place. The rule looks at the k-mer alone, so an anchor is chosen wherever its words
stand, whatever surrounds them, and two texts can be matched anchor by anchor in order. Only DataFrame
functions: every step is one pass over a document's word array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellselect.operators.scale import global_rank
from cellselect.session import shared_dir

_SPACE = r"[\x20\x09-\x0D]+"
#: Characters of scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, ideographs): words of their own.
_UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u312F\u31A0-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"
#: Texts of fewer words have anchors over characters too (k-mers of ``2**_CHAR_WIDTH + 1``).
_SHORT, _CHAR_WIDTH = 60, 2


def _let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(text: Column, width: int = 3) -> Column:
    """struct<words, chars>, both array<struct<hash:int, at:int>>: the anchors of ``text`` over words, and those
    over characters that short texts have besides (see ``anchors``)."""
    return _found(text, width, lambda words, chars, alone: F.when(
        F.size(words) + F.size(chars) > 0, F.struct(words.alias("words"), chars.alias("chars"))).otherwise(
        F.struct(alone.alias("words"), F.slice(alone, 1, 0).alias("chars"))))


def anchors(text: Column, width: int = 3) -> Column:
    """array<struct<hash:int, at:int>> of the closed syncmers of ``text`` in order; ``at`` is the word
    position. A k-mer of ``2**width + 1`` words is an anchor when the smallest of its ``2**width``
    two-word s-mers is the first or the last. Hashes have 24 bits. In scripts without spaces each
    character is a word. A text under 60 words also has, after those, the anchors of its 5-character
    k-mers (``at``: character position). A text without an anchor is its own single anchor at -1 (the
    plain text hashed)."""
    return _found(text, width, lambda words, chars, alone: _let(F.concat(words, chars), lambda a: F.when(F.size(a) > 0, a).otherwise(alone)))


def _found(text: Column, width: int, build) -> Column:
    """``build(anchors over words, anchors over characters, the text's own anchor)``."""
    low = lambda h: F.shiftrightunsigned(h, 40).cast("int")
    ahead = lambda x, n: F.slice(x, F.lit(n + 1), F.size(x))
    alone = F.array(F.struct(low(F.xxhash64(text)).alias("hash"), F.lit(-1).alias("at")))
    pairs = lambda h: F.zip_with(h, ahead(h, 1), lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))

    def doubled(least, n):
        return _let(least, lambda m: F.zip_with(m, ahead(m, n), lambda a, b: F.least(a, b)))

    def pick(h, smers, width):
        inner, k, least = 2 ** width, 2 ** width + 1, smers
        for step in range(width):  # minimum of 1, 2, 4 ... s-mers from each place on
            least = doubled(least, 2 ** step)
        return _let(least, lambda m: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(h) - k), lambda i: (m[i] == smers[i]) | (m[i] == smers[i + (inner - 1)])),
            lambda i: F.struct(low(F.xxhash64(F.slice(h, i + 1, F.lit(k)))).alias("hash"), i.alias("at"))))

    def found(h, width):
        return F.when(F.size(h) <= 2 ** width, F.slice(alone, 1, 0)).otherwise(_let(pairs(h), lambda m: pick(h, m, width)))

    spaced = F.regexp_replace(text, _UNSPACED, " $1 ")
    words = F.transform(F.split(F.btrim(spaced, F.lit(" \t\n\x0b\x0c\r")), _SPACE), lambda w: F.xxhash64(w))
    chars = F.transform(F.split(text, ""), lambda c: F.xxhash64(c))
    none = F.slice(alone, 1, 0)
    return _let(words, lambda h: _let(
        F.struct(found(h, width).alias("w"), F.when(F.size(h) < _SHORT, _let(chars, lambda c: found(c, _CHAR_WIDTH))).otherwise(none).alias("c")),
        lambda x: build(x["w"], x["c"], alone)))


def hashes(text: Column, width: int = 3) -> Column:
    """Anchor hashes of ``text`` in order, repeats kept."""
    return F.transform(anchors(text, width), lambda a: a["hash"])


def fingerprint(anchor_hashes: Column) -> Column:
    """Anchors as text, six hex digits each."""
    return F.array_join(F.transform(anchor_hashes, lambda h: F.lpad(F.lower(F.hex(h)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over all anchors (distinct), 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared)


def pack(found: Column) -> Column:
    """struct of anchors (``parts``) with each anchor as one long, the position above the hash: a struct costs four
    times as much on its way."""
    one = lambda side: F.transform(found[side], lambda x: F.shiftleft((x["at"] + 1).cast("long"), 24).bitwiseOR(x["hash"].cast("long"))).alias(side)
    return F.struct(one("words"), one("chars"))


def unpack(packed: Column) -> Column:
    """What ``pack`` packed."""
    one = lambda side: F.transform(packed[side], lambda x: F.struct(
        x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("hash"), (F.shiftright(x, 24) - 1).cast("int").alias("at"))).alias(side)
    return F.struct(one("words"), one("chars"))


def marks(found: Column) -> Column:
    """array<bigint>: anchors' hashes, and for each two neighbouring anchors a hash of both and of the distance
    between their positions. Texts share a neighbour mark where they have the same anchors equally far
    apart, wherever that is in either text."""
    near = F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.when(
        b["hash"].isNotNull(), F.xxhash64(a["hash"], b["hash"], b["at"] - a["at"])))
    return F.array_distinct(F.concat(F.transform(found, lambda x: x["hash"].cast("long")), F.array_compact(near)))


def matched(a: Column, b: Column) -> Column:
    """Share of common marks (0 to 1) of two structs of ``words`` and ``chars`` marks: anchors and their relative
    positions. Marks over characters count where both texts have them, so a text just short of having
    them is compared with one just beyond over words alone."""
    both = (F.size(a["chars"]) > 0) & (F.size(b["chars"]) > 0)
    shared = F.size(F.array_intersect(a["words"], b["words"])) + F.when(both, F.size(F.array_intersect(a["chars"], b["chars"]))).otherwise(0)
    size = lambda x: F.size(x["words"]) + F.when(both, F.size(x["chars"])).otherwise(0)
    return F.coalesce(F.try_divide(shared, size(a) + size(b) - shared), F.lit(0.0))


def print_of(found: Column) -> Column:
    """Fingerprint text of ``parts``: each anchor's six hex digits with its distance from the one before after a dot;
    anchors over characters after a bar."""
    def listed(x: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(x, lambda s: s["at"]))
        return F.array_join(F.zip_with(x, F.slice(before, F.lit(1), F.size(x)), lambda s, at: F.concat(
            F.lpad(F.lower(F.hex(s["hash"])), 6, "0"), F.lit("."), (s["at"] - at).cast("string"))), ",")

    return F.when(F.size(found["chars"]) > 0, F.concat(listed(found["words"]), F.lit("|"), listed(found["chars"]))).otherwise(listed(found["words"]))


def match_positions(left: DataFrame, right: DataFrame, width: int = 3) -> DataFrame:
    """(a, b, shift, n): per pair of documents of ``left`` and ``right`` (doc_id, text) that share
    anchors, how many agree at each distance of positions. Frequent anchors meet once per pair and
    distance; the sum is combined before the shuffle."""
    rows = lambda d, name: d.select(F.col("doc_id").alias(name), F.explode(anchors(F.coalesce("text", F.lit("")), width)).alias("x")).select(
        name, F.col("x.hash").alias("hash"), F.col("x.at").alias(f"at_{name}"))
    return (rows(left, "a").join(rows(right, "b"), "hash")
            .groupBy("a", "b", (F.col("at_b") - F.col("at_a")).alias("shift")).agg(F.count(F.lit(1)).alias("n")))


def fingerprints_and_edits(docs: DataFrame, width: int = 3) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many (or
    all) of the next document in descending doc_id (after the last: the first). One row per distinct
    doc_id (a repeated one counts with its smallest text); null text is empty; rows without doc_id are
    left out; other columns are ignored. Texts cross the network once by id and, cut to the needed
    length, once more to the document they are spliced into.
    """
    shared_dir(docs.sparkSession)
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    order = (global_rank(ids.select(F.bitwise_not("doc_id").alias("down"), "n"), "down", name="rank")
             .select(F.bitwise_not("down").alias("doc_id"), "n", "rank").checkpoint())
    total = max(order.count(), 1)
    after = order.select(F.pmod(F.col("rank") - 1, F.lit(total)).alias("rank"), F.col("doc_id").alias("next_id"))
    chain = order.join(after, "rank").select("doc_id", "next_id", F.floor(F.col("n") / 2).cast("int").alias("need")).checkpoint()
    base = (docs.withColumn("h", pack(parts(F.col("text"), width))).groupBy("doc_id").agg(F.min(F.struct("text", "h")).alias("x"))
            .select("doc_id", F.col("x.text").alias("text"), F.col("x.h").alias("h")))
    given = base.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), F.col("h").alias("next_h"))
    half = F.floor(F.length("text") / 2).cast("int")
    heads = chain.join(given, "next_id").select("doc_id", F.substring("next_text", F.lit(1), F.col("need")).alias("next_text"), "next_h")
    both = base.join(heads, "doc_id").select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "h", "next_h",
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    return both.withColumns({"h": unpack(F.col("h")), "next_h": unpack(F.col("next_h")), "eh": parts(F.col("edited"), width)}).withColumns({f"m_{c}": F.struct(
        marks(F.col(c)["words"]).alias("words"), marks(F.col(c)["chars"]).alias("chars")) for c in ("h", "eh", "next_h")}).select(
        "doc_id", "n_chars", F.col("edited").alias("edited_text"), print_of(F.col("h")).alias("fingerprint"),
        print_of(F.col("eh")).alias("edited_fingerprint"), matched(F.col("m_h"), F.col("m_eh")).alias("near_edited"),
        matched(F.col("m_h"), F.col("m_next_h")).alias("near_next"))
