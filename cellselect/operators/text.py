"""Guides, read text, consistency rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellselect.functions import constants as K
from cellselect.functions import text as T
from cellselect.functions.columns import literal_map

_FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _field(head: Column, name: str) -> Column:
    value = _strip(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*([^\n]*)$", 1))
    return F.nullif(F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def _list_field(head: Column, name: str) -> Column:
    inner = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*\[([^\]\n]*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), _strip), lambda x: x != "")


def parse_front_matter(guides: DataFrame) -> DataFrame:
    """(stem, raw) → typed front-matter columns, ``body`` and ``bad`` (no front-matter block)."""
    g = guides.withColumn("_head", F.regexp_extract("raw", _FRONT, 1))
    head = F.col("_head")
    bad = ~F.col("raw").rlike(_FRONT)
    return g.select(
        "stem", bad.alias("bad"), F.upper(F.coalesce(_field(head, "country_code"), "stem")).alias("country_code"),
        _field(head, "country_name").alias("country_name"), _field(head, "driving_side").alias("driving_side"),
        _list_field(head, "languages").alias("languages"), _list_field(head, "scripts").alias("scripts"),
        _field(head, "source").alias("source"), _field(head, "last_updated").alias("last_updated"),
        F.regexp_extract("raw", _FRONT, 2).alias("body"))


def explode_sections(parsed: DataFrame, key: str = "stem") -> DataFrame:
    """(key, section, text) per ``## name``; text before the first header and empty sections go, a
    later section of the same name wins."""
    header = r"(?m)^##\s+(?=\S[^\n]*\n)"
    parts = parsed.where(~F.col("bad")).select(key, F.posexplode(F.split("body", header, -1)).alias("pos", "part"))
    name = F.regexp_replace(F.lower(F.trim(F.substring_index("part", "\n", 1))), " ", "_")
    text = _strip(F.regexp_replace("part", r"^[^\n]*\n", ""))
    rows = parts.where(F.col("pos") > 0).select(key, name.alias("section"), text.alias("text"), "pos").where(F.col("text") != "")
    return rows.groupBy(key, "section").agg(F.max_by("text", "pos").alias("text"))


def guide_report(countries: DataFrame, sections: DataFrame) -> DataFrame:
    return countries.agg(F.count_distinct("country_code").alias("countries")).withColumn(
        "sections", sections.agg(F.count(F.lit(1)).alias("n")).scalar())


def guide_sections(rows: DataFrame, sections: DataFrame, key: str = "country_code") -> DataFrame:
    """Sections of each row's country as a sorted array of (section, text)."""
    s = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "text"))).alias("sections"))
    return rows.join(s, key, "left")


# --- read text --------------------------------------------------------------------------------

def merge_tiles(lines: DataFrame, by: str, floor: float = 0.5) -> DataFrame:
    """Lines of overlapping tiles → one text per ``by``: cleaned, exact repeats keep the first place."""
    kept = (lines.where(T.ocr_filter("text", "confidence", floor)).select(by, "tile", "pos", T.clean_line("text").alias("line"))
            .groupBy(by, "line").agg(F.min(F.struct("tile", "pos")).alias("at")))
    return (kept.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))
            .select(by, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("raw")))


def language_name(iso) -> tuple[Column, Column]:
    """(translation code, display name); an unmapped code falls through."""
    iso = F.col(iso) if isinstance(iso, str) else iso
    code = F.try_element_at(literal_map(K.language_codes()), iso)
    name = F.coalesce(F.try_element_at(literal_map(K.language_names()), code), iso)
    return F.coalesce(code, iso), name


def finalise_extract(df: DataFrame) -> DataFrame:
    """(raw, iso, confidence, translation) → extract struct, null without text. The translation is
    used for mapped languages other than English; a missing one keeps the raw text."""
    code = F.try_element_at(literal_map(K.language_codes()), F.col("iso"))
    known = code.isNotNull() & (code != K.ENGLISH)
    full, name = language_name("iso")
    extract = F.struct(F.col("raw").alias("raw_text"), full.alias("language_code"), name.alias("language_name"),
                       F.col("confidence").alias("language_confidence"),
                       F.when(known, F.coalesce("translation", "raw")).otherwise(F.col("raw")).alias("english_translation"))
    return df.withColumn("extract", F.when(T.has_text("raw"), extract))


def annotate(df: DataFrame, text: str, langid: Callable[[pd.Series], pd.DataFrame],
             translate: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Add iso, confidence and translation from user functions that see Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                words = part.column(text).to_pandas()
                found = langid(words)
                added = (pa.array(found["iso"], pa.string(), from_pandas=True), pa.array(found["confidence"], pa.float64(), from_pandas=True),
                         pa.array(translate(words, found["iso"]), pa.string(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, "iso", "confidence", "translation"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", iso string, confidence double, translation string"
    return df.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text, at least one row each: pandas holds a text several times
    over, so what a worker holds follows the run and not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


# --- consistency ------------------------------------------------------------------------------

def script_rules(spark: SparkSession) -> DataFrame:
    """(script, country) rule table: a fixed set of a few dozen rows."""
    return spark.createDataFrame(K.script_rules(), "script string, country string")


def contradictions(rows: DataFrame, rules: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """Add ``contradictions``: the row's script is not plausible in its country, or its driving side
    is another. Scripts without a rule, the free script and missing values contradict nothing."""
    anchored = rules.where(F.col("script") != K.FREE_SCRIPT).select("script").distinct().withColumn("_rule", F.lit(True))
    fits = rules.select("script", "country").distinct().withColumn("_fits", F.lit(True))
    out = rows.join(anchored, "script", "left").join(fits, ["script", "country"], "left")
    odd_script = F.when(F.col("_rule") & F.col("_fits").isNull() & F.col("country").isNotNull(),
                        F.concat("script", F.lit(" is not used in "), "country"))
    odd_side = F.lit(None).cast("string")
    if sides is not None:
        out = out.join(sides.select("country", F.col("driving_side").alias("_side")), "country", "left")
        odd_side = F.when(F.col("driving_side") != F.col("_side"),
                          F.concat(F.lit("drives on the "), "driving_side", F.lit(", "), "country", F.lit(" on the "), "_side"))
    found = F.filter(F.array(odd_script, odd_side), lambda c: c.isNotNull())
    return out.withColumn("contradictions", found).drop("_rule", "_fits", "_side")
