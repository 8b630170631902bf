"""A training corpus from documents: language, near duplicates, repeated passages, mixture, packing.

Each stage takes what its predecessor kept, as Parquet, and all but the last return the columns of
documents. A doc_id stands for one document; rows without one pass every stage unchanged until they are
packed. Extra columns travel along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellselect.llm.langid import UNKNOWN, fit, held_out, predict
from cellselect.llm.mixing import mix, sizes
from cellselect.llm.ngram_join import ngram_components
from cellselect.llm.packing import pack
from cellselect.llm.substring_dedup import drop_repeats
from cellselect.session import scratch_path, tune

#: Share of the best language below which a text counts as of no known language.
LEAST_LANGUAGE_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language (null, letterless, or too close a call). Without
    any labelled row there is no language to recognise and all documents stay."""
    model = fit(docs.where("doc_id is not null").where(~held_out(4, 2)))
    if not model.langs:
        return docs
    scored = predict(docs.select("*"), model)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group linked at Jaccard 0.75 over 5-word shingles."""
    gone = ngram_components(docs, n=5, percent=75).where("component_id <> doc_id").select("doc_id")
    one = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 13-word windows that an earlier document has; a document left without words goes. A text
    that loses nothing stays as it was, another is its kept words joined by spaces."""
    cut = drop_repeats(docs, window=13).where("n_removed > 0").select(F.col("doc_id").alias("_id"), "kept_text")
    out = docs.join(cut, F.col("doc_id") == F.col("_id"), "left").where("kept_text is null or kept_text <> ''")
    changed = F.col("kept_text").isNotNull()
    return out.select(*[
        F.coalesce("kept_text", "text").alias("text") if c == "text"
        else F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars"
        else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target words (weights 5, 2, 1 in turn)."""
    sized = sizes(docs.where("doc_id is not null").select("doc_id", "source", "text")).drop("text")
    copies = mix(sized).where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    out = docs.join(copies, F.col("doc_id") == F.col("_id")).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: Language models, tokenisation and rounding have no SQL form; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of each is written to the shared folder and read again."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
