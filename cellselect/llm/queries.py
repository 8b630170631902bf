"""Registered queries of the training-data operators and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellselect.llm import oracles
from cellselect.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if hasattr(oracles, name.upper()):
            ORACLES[name] = getattr(oracles, name.upper())
        return fn

    return add


@query("op1_ngram_join")
def op1(spark, table):
    """Near-duplicate classes of all documents: 5-word shingles, Jaccard 0.75."""
    from cellselect.llm.ngram_join import ngram_components
    return ngram_components(table("documents"), n=5, percent=75)


@query("op4_substring_dedup")
def op4(spark, table):
    """Removes 13-word windows that an earlier document has; digest of what is kept."""
    from pyspark.sql import functions as F

    from cellselect.llm.substring_dedup import drop_repeats
    out = drop_repeats(table("documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_language_id")
def op10(spark, table):
    """Language of every document by word-first backoff."""
    from cellselect.llm.langid import identify
    return identify(table("documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_mixing")
def op6(spark, table):
    """Words taken from every document when sources are mixed to their targets."""
    from pyspark.sql import functions as F

    from cellselect.llm.mixing import mix, sizes
    docs = sizes(table("documents").select("doc_id", "source", "text")).drop("text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op3_packing")
def op3(spark, table):
    """All documents as pieces of 2048-token sequences."""
    import public_tokenizers

    from cellselect.llm.packing import pack
    return pack(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_preferences")
def op2(spark, table):
    """Prompt and masked completions of every conversation against one with a swapped tail."""
    from pyspark.sql import functions as F

    from cellselect.llm.preferences import format_preferences, swapped_tails
    out = format_preferences(swapped_tails(table("conversations")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s.start, s.end)), ",").alias(c)
    return out.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", flat("chosen_spans"), "rejected", flat("rejected_spans"))


@query("op9_fingerprints")
def op9(spark, table):
    """Syncmer fingerprints of every document and of its edited text, and their likeness."""
    from pyspark.sql import functions as F

    from cellselect.llm.syncmers import fingerprints_and_edits
    out = fingerprints_and_edits(table("documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")


@query("op8_compression_rules")
def op8(spark, table):
    """Base counts of every document and the verdict of the compression bands."""
    from cellselect.llm.compression_rules import compression_rules
    return compression_rules(table("documents").select("doc_id", "text")).drop("text")


@query("op5_lm_scoring")
def op5(spark, table):
    """Log10 probability of every document under the filter's model and under exact word shares."""
    from cellselect.llm.bloom_lm import score
    return score(table("documents"))


@query("op7_kn_quality")
def op7(spark, table):
    """Perplexity of every document under the trusted text's model and the verdict by language."""
    from cellselect.llm.kn_quality import quality
    return quality(table("documents"), table("labels"))


@query("op11_toxicity")
def op11(spark, table):
    """Toxicity of every document by two Kneser-Ney models with shared backoff counts."""
    from cellselect.llm.toxicity import toxicity
    return toxicity(table("documents"), table("labels"))


@query("op12_prefix_trie")
def op12(spark, table):
    """Every node of the prefix trie of the rebuilt conversations."""
    from cellselect.llm.prefix_trie import prefix_trie
    return prefix_trie(table("conversations"))


@query("op13_collocations")
def op13(spark, table):
    """Each language's 2,000 best collocations of two to five words."""
    from cellselect.llm.phrases import collocations
    return collocations(table("documents"), least=100, top=2000)


def _pipeline() -> None:
    import corpus_pipeline
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


_pipeline()
