"""Scalar expressions on text: lines, labels, queries, prompts, status, answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellselect.functions import constants as K
from cellselect.functions.columns import literal_map
from cellselect.functions.geo import _c


def clean_line(text) -> Column:
    """Strip layout tags and collapse white space."""
    # Fixed value: the tags that readers leave in lines.
    untagged = F.regexp_replace(_c(text), r"(?i)<(br|sup|sub|/[a-z]+)\s*/?>", " ")
    return F.trim(F.regexp_replace(untagged, r"(?U)\s+", " "))


def has_text(text) -> Column:
    return F.coalesce(F.length(F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")) >= 2, F.lit(False))


def ocr_filter(text, confidence, floor: float = 0.5) -> Column:
    return (_c(confidence) >= floor) & (F.length(clean_line(text)) > 0)


def country_iso2(name) -> Column:
    return F.try_element_at(literal_map(K.COUNTRY_ISO2), F.lower(_c(name)))


def not_na(name) -> Column:
    return F.nullif(_c(name), F.lit("NA"))


def hub_label(admin1, country) -> Column:
    """``admin1, country`` with leading commas and blanks cut."""
    raw = F.concat(F.coalesce(not_na(admin1), F.lit("")), F.lit(", "), F.coalesce(_c(country), F.lit("unknown")))
    return F.regexp_replace(raw, "^[, ]+", "")


def hub_country(hub) -> Column:
    return F.lower(F.trim(F.substring_index(_c(hub), ",", -1)))


def is_area_centroid(place_type) -> Column:
    """True for a ``category=type`` whose coordinate is an area's centre."""
    category = F.substring_index(_c(place_type), "=", 1)
    kind = F.when(F.instr(_c(place_type), "=") > 0,
                  F.regexp_replace(_c(place_type), "^[^=]*=", "")).otherwise("")
    return category.isin(*K.AREA_CATEGORIES) | kind.isin(*K.AREA_TYPES)


def explanation(reasoning, display_name, query, used, reason) -> Column:
    """One line for a tooltip: the model's reason, the place found, why the pin stayed."""
    match = F.concat(F.lit("place found: "), F.substring_index(_c(display_name), ",", 1), F.lit(" (searched "), _c(query), F.lit(")"))
    skip = F.when(~_c(used), F.concat(F.lit("pin kept: "), _c(reason)))
    line = F.concat_ws("; ", F.nullif(_c(reasoning), F.lit("")), match, skip)
    return F.coalesce(F.nullif(line, F.lit("")), F.lit("no reason given"))


def query_list(primary, alternates) -> Column:
    return F.concat(F.array(_c(primary)), F.coalesce(_c(alternates), F.array().cast("array<string>")))


def even_subsample(items, n: int) -> Column:
    """``n`` of the items at even steps (all of them when there are fewer)."""
    items = _c(items)
    m = F.size(items)
    k = F.least(F.lit(n), m)
    picks = F.transform(F.sequence(F.lit(0), k - 1),
                        lambda i: F.element_at(items, F.floor(i * (m / k)).cast("int") + 1))
    return F.when(k > 0, picks).otherwise(F.slice(items, 1, 0))


def build_prompt(lat, lng, hub, language, raw_text, translation) -> Column:
    """Prompt of a batch visual job: the coarse guess, then the read text or a note without it."""
    guess = F.format_string("Coarse guess\nlatitude %.6f\nlongitude %.6f\nregion %s\n\n",
                            _c(lat), _c(lng), _c(hub))
    read = F.concat(F.lit("Text in the image\nlanguage "), _c(language), F.lit("\nraw "), _c(raw_text),
                    F.lit('\nEnglish "'), _c(translation), F.lit('"\n\n'))
    ask = ("Name the most specific feature and answer in the JSON schema. "
           "If only the country is sure, use precision country and the coarse coordinates.")
    return F.concat(guess, F.when(_c(raw_text).isNotNull(), read)
                    .otherwise("Text in the image: none\n\n"), F.lit(ask))


def verification_prompt(lat, lng, hub, language, raw_text, translation) -> Column:
    """Prompt that asks a visual model to check a coordinate guess against the image and the read text."""
    guess = F.format_string("Guess to check\nlatitude %.6f\nlongitude %.6f\nregion %s\n\n", _c(lat), _c(lng), _c(hub))
    read = F.concat(F.lit("Text read in the image\nlanguage "), _c(language), F.lit("\nraw "), _c(raw_text),
                    F.lit('\nEnglish "'), _c(translation), F.lit('"\n\n'))
    ask = ("Compare script, signs and driving side in the image with the guess, list every contradiction, "
           "and answer in the JSON schema.")
    return F.concat(guess, F.when(_c(raw_text).isNotNull(), read).otherwise("Text read in the image: none\n\n"), F.lit(ask))


def image_mode(width, height, mode) -> Column:
    """``panorama`` or ``single``; auto decides by aspect ratio; other modes are an error."""
    aspect = _c(width) / _c(height)
    mode = _c(mode)
    return (F.when(mode == "auto", F.when(aspect.between(1.85, 2.25), "panorama").otherwise("single"))
            .when(mode.isin("panorama", "single"), mode)
            .otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), mode)).cast("string")))


def shown_text(text) -> Column:
    """Text as events carry it: at most ``EVENT_TEXT_CHARS`` characters."""
    return F.left(_c(text), F.lit(K.EVENT_TEXT_CHARS))


def _filled(template: str, field) -> Column:
    """A template of ``K.EVENT_LABELS`` with its {field} places filled."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[field(part) if i % 2 else F.lit(part) for i, part in enumerate(parts)])


def event_status(event, data) -> Column:
    """Progress event → status label by ``K.EVENT_LABELS``; null for heartbeats, empty for events without
    a label. A missing field shows as ``?``; where a label has a second wording, a missing first field
    selects that."""
    event, data = _c(event), _c(data)

    def raw(name: str) -> Column:
        return F.nullif(F.get_json_object(data, f"$.{name}"), F.lit(""))

    def field(name: str) -> Column:
        if name == "chars":
            number = [F.coalesce(raw(f"{kind}_chars").try_cast("long"), F.lit(0)) for kind in ("content", "thinking")]
            return (number[0] + number[1]).cast("string")
        if name == "hit":
            return F.coalesce(F.substring_index(raw("hit"), ",", 1), F.lit("?"))
        return F.coalesce(shown_text(F.regexp_replace(raw(name), r"\s+", " ")), F.lit("?"))

    out = F.when(event == "heartbeat", F.lit(None).cast("string"))
    for name, full, bare in K.EVENT_LABELS:
        label = _filled(full, field)
        if bare is not None:
            first = re.search(r"\{(\w+)\}", full).group(1)
            label = F.when(raw(first).isNotNull(), label).otherwise(bare)
        out = out.when(event == name, label)
    return out.otherwise("")


# --- model answers ----------------------------------------------------------------------------

PINPOINT_SCHEMA = ("queryable_name string, alternate_queries array<string>, refined_lat string, "
                   "refined_lng string, precision_level string, confidence string, "
                   "confirmed_country string, reasoning string")
VERDICT_SCHEMA = ("is_guess_plausible boolean, confidence_score string, confirmed_country_or_state string, "
                  "primary_script_detected string, contradictions_found array<string>, reasoning_summary string")


def _valid_json(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _block(raw: Column, key: str) -> Column:
    # A fenced JSON block, else the first flat object that names the key.
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(raw, r'(?s)(\{[^{}]*"' + key + r'"[^{}]*\})', 1), F.lit(""))
    return F.coalesce(fenced, bare)


def parse_pinpoint(raw, lat, lng, hub) -> Column:
    """Model answer → struct; direct JSON, else a fenced or bare block, else the coarse guess."""
    raw = _c(raw)
    direct = F.when(F.ltrim(raw).startswith("{"), _valid_json(F.trim(raw)))
    block = _block(raw, "precision_level")
    text = F.coalesce(direct, _valid_json(block))

    def build(r: Column) -> Column:
        o = F.from_json(r["text"], PINPOINT_SCHEMA)
        level = F.lower(F.coalesce(F.nullif(o["precision_level"], F.lit("")), F.lit("none")))
        fallback_country = F.coalesce(F.nullif(F.trim(F.substring_index(r["hub"], ",", -1)), F.lit("")),
                                      F.lit("unknown"))
        found = r["text"].isNotNull()
        return F.struct(
            F.coalesce(o["queryable_name"], F.lit("")).alias("queryable_name"),
            F.coalesce(o["alternate_queries"], F.array().cast("array<string>")).alias("alternate_queries"),
            F.coalesce(o["refined_lat"].try_cast("double"), r["lat"]).alias("refined_lat"),
            F.coalesce(o["refined_lng"].try_cast("double"), r["lng"]).alias("refined_lng"),
            F.when(level.isin(*K.PRECISIONS), level).otherwise("none").alias("precision_level"),
            F.coalesce(o["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence"),
            F.when(found, F.coalesce(F.nullif(o["confirmed_country"], F.lit("")), F.lit("unknown")))
            .when(r["block"].isNull(), fallback_country).otherwise("unknown").alias("confirmed_country"),
            F.when(found, F.coalesce(o["reasoning"], F.lit("")))
            .when(r["block"].isNull(), "answer without JSON").otherwise("unreadable JSON").alias("reasoning"))

    packed = F.struct(text.alias("text"), block.alias("block"), _c(lat).cast("double").alias("lat"),
                      _c(lng).cast("double").alias("lng"), _c(hub).alias("hub"))
    return F.element_at(F.transform(F.array(packed), build), 1)


def parse_verdict(raw) -> Column:
    """Verifier answer → struct; anything unreadable is implausible."""
    raw = _c(raw)
    block = _block(raw, "is_guess_plausible")
    text = _valid_json(block)

    def build(r: Column) -> Column:
        o = F.from_json(r["text"], VERDICT_SCHEMA)
        found = r["text"].isNotNull()

        def named(field: Column) -> Column:
            return F.coalesce(F.nullif(field, F.lit("")), F.lit("unknown"))

        problem = F.when(r["block"].isNull(), "answer without JSON").otherwise("unreadable JSON")
        return F.struct(
            F.coalesce(o["is_guess_plausible"], F.lit(False)).alias("is_plausible"),
            F.coalesce(o["confidence_score"].try_cast("double"), F.lit(0.0)).alias("confidence"),
            named(o["confirmed_country_or_state"]).alias("confirmed_country"),
            named(o["primary_script_detected"]).alias("primary_script"),
            F.when(found, F.coalesce(o["contradictions_found"], F.array().cast("array<string>")))
            .otherwise(F.array(problem)).alias("contradictions"),
            F.when(found, F.coalesce(o["reasoning_summary"], F.lit("")))
            .otherwise(F.right(r["raw"], F.lit(500))).alias("reasoning"))

    packed = F.struct(text.alias("text"), block.alias("block"), raw.alias("raw"))
    return F.element_at(F.transform(F.array(packed), build), 1)
