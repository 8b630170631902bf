"""Guides, read text, model answers, consistency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cellselect.functions import text as T
from cellselect.operators import catalog as O
from cellselect.operators import text as G
from cellselect.plans.registry import query

_FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"


def _f(name: str) -> str:
    return rf"nullif(trim(regexp_extract(head, '(?m)^{name}:[ \t]*([^\n]*)$', 1)), '')"


_PARSED = rf"""
parsed AS (SELECT doc_id, stem, head = '' AS bad, upper(coalesce({_f('country_code')}, stem)) AS country_code, {_f('country_name')} AS country_name,
       {_f('driving_side')} AS driving_side, replace(regexp_extract(head, '(?m)^languages:[ \t]*\[([^\]\n]*)\]', 1), ', ', '|') AS languages,
       {_f('last_updated')} AS last_updated, body
FROM (SELECT *, regexp_extract(raw, '{_FRONT}', 1) AS head, regexp_extract(raw, '{_FRONT}', 2) AS body FROM guides))"""
_SECTIONS = rf"""{_PARSED},
parts AS (SELECT stem, country_code, pos, part FROM (
   SELECT stem, country_code, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS pos
   FROM (SELECT stem, country_code, string_split_regex(body, '(?m)^##\s+') AS p FROM parsed WHERE NOT bad)) WHERE pos > 1),
named AS (SELECT stem, country_code, pos, replace(lower(trim(split_part(part, chr(10), 1))), ' ', '_') AS section,
       regexp_replace(regexp_replace(part, '^[^\n]*\n', ''), '^\s+|\s+$', '', 'g') AS text FROM parts),
sections AS (SELECT stem, any_value(country_code) AS country_code, section, arg_max(text, pos) AS text FROM named WHERE text <> '' GROUP BY stem, section)"""


@query("t1_front_matter", f"WITH {_PARSED} SELECT stem, bad, country_code, country_name, driving_side, languages, last_updated FROM parsed", "guides")
def t1(t):
    p = G.parse_front_matter(t.guides)
    return p.select("stem", "bad", "country_code", "country_name", "driving_side",
                    F.array_join("languages", "|").alias("languages"), "last_updated")


@query("t2_sections", f"WITH {_SECTIONS} SELECT stem, section, length(text) AS chars, md5(text) AS digest FROM sections", "guides")
def t2(t):
    s = G.explode_sections(G.parse_front_matter(t.guides))
    return s.select("stem", "section", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("a12_guide_report", f"""WITH {_SECTIONS}
SELECT (SELECT count(DISTINCT country_code) FROM parsed WHERE NOT bad) AS countries, (SELECT count(*) FROM sections) AS sections""", "guides")
def a12(t):
    p = G.parse_front_matter(t.guides).where(~F.col("bad"))
    return G.guide_report(p, G.explode_sections(p))


_LATEST = """
latest AS (SELECT country_code, arg_max(stem, doc_id) AS stem FROM parsed WHERE NOT bad GROUP BY country_code)"""


@query("j23_guide_sections", f"""WITH {_SECTIONS}, {_LATEST}
SELECT d.doc_id, (SELECT string_agg(section, ',' ORDER BY section) FROM sections s JOIN latest l USING (stem) WHERE l.country_code = upper(concat(d.source, d.lang))) AS sections
FROM documents d""", "guides")
def j23(t):
    """Guides keyed by country: the last file of a country wins; each document takes its sections."""
    p = G.parse_front_matter(t.guides.withColumn("stem", F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), "stem")))
    good = p.where(~F.col("bad"))
    last = good.groupBy("country_code").agg(F.max("stem").alias("stem"))
    sections = G.explode_sections(good).join(last, "stem").select("country_code", "section", "text")
    rows = t.read("documents").select("doc_id", F.upper(F.concat("source", "lang")).alias("country_code"))
    out = G.guide_sections(rows, sections)
    return out.select("doc_id", F.array_join(F.transform("sections", lambda s: s["section"]), ",").alias("sections"))


_CLEAN = r"trim(regexp_replace(regexp_replace(text, '(?i)<(br|sup|sub|/[a-z]+)\s*/?>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("t3_clean_line", f"SELECT doc_id, pos, {_CLEAN} AS line FROM (SELECT doc_id, pos, concat(text, '<br/>  x</b>', chr(9), ' ') AS text FROM ocr_lines)", "ocr_lines")
def t3(t):
    raw = F.concat("text", F.lit("<br/>  x</b>\t "))
    return t.ocr_lines.select("doc_id", "pos", T.clean_line(raw).alias("line"))


_MERGED = f"""
merged AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY tile, pos) AS raw FROM (
  SELECT doc_id, line, tile, pos, row_number() OVER (PARTITION BY doc_id, line ORDER BY tile, pos) AS rn
  FROM (SELECT doc_id, tile, pos, {_CLEAN} AS line FROM ocr_lines WHERE confidence >= 0.5) WHERE line <> '') WHERE rn = 1 GROUP BY doc_id)"""


@query("t4_merge_tiles", f"WITH {_MERGED} SELECT doc_id, length(raw) AS chars, md5(raw) AS digest FROM merged", "ocr_lines")
def t4(t):
    m = G.merge_tiles(t.ocr_lines, "doc_id")
    return m.select("doc_id", F.length("raw").cast("long").alias("chars"), F.md5("raw").alias("digest"))


@query("t5_finalise_extract", f"""WITH {_MERGED}
SELECT doc_id, CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'es' THEN 'spa_Latn' WHEN 'de' THEN 'deu_Latn' END AS code,
       CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'de' THEN 'German' END AS name,
       md5(CASE WHEN lang = 'en' OR doc_id % 3 = 0 THEN raw ELSE reverse(raw) END) AS digest
FROM documents JOIN merged USING (doc_id) WHERE length(trim(raw)) >= 2""", "ocr_lines")
def t5(t):
    lang = t.read("documents").select("doc_id", F.col("lang").alias("iso"))
    df = G.merge_tiles(t.ocr_lines, "doc_id").join(lang, "doc_id").withColumns(
        {"confidence": F.lit(0.9), "translation": F.when(F.col("doc_id") % 3 != 0, F.reverse("raw"))})
    e = G.finalise_extract(df).where(F.col("extract").isNotNull())
    return e.select("doc_id", F.col("extract.language_code").alias("code"), F.col("extract.language_name").alias("name"),
                    F.md5("extract.english_translation").alias("digest"))


@query("j20_language_name", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'xx' WHEN lang = 'en' THEN 'eng_Latn' WHEN lang = 'fr' THEN 'fra_Latn' WHEN lang = 'es' THEN 'spa_Latn' ELSE 'deu_Latn' END AS code,
       CASE WHEN doc_id % 4 = 0 THEN 'xx' WHEN lang = 'en' THEN 'English' WHEN lang = 'fr' THEN 'French' WHEN lang = 'es' THEN 'Spanish' ELSE 'German' END AS name FROM documents""")
def j20(t):
    code, name = G.language_name(F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")))
    return t.read("documents").select("doc_id", code.alias("code"), name.alias("name"))


@query("p2_annotate", """
SELECT doc_id, CASE WHEN share > 0.02 THEN 'fr' ELSE 'en' END AS iso, round(1 - share, 6) AS confidence, md5(replace(text, 'e', 'E')) AS digest
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^éèçê]', '', 'g')) / greatest(length(text), 1) AS share FROM documents)""")
def p2(t):
    """User functions: a letter-share language guess and a 'translation' that raises one letter."""
    def langid(text: pd.Series) -> pd.DataFrame:
        accents = text.str.count("[éèçê]") / text.str.len().clip(lower=1)
        return pd.DataFrame({"iso": accents.gt(0.02).map({True: "fr", False: "en"}), "confidence": (1 - accents).astype(float)})

    def translate(text: pd.Series, iso: pd.Series) -> pd.Series:
        return text.str.replace("e", "E", regex=False)

    out = G.annotate(t.read("documents").select("doc_id", "text"), "text", langid, translate)
    return out.select("doc_id", "iso", F.round("confidence", 6).alias("confidence"), F.md5("translation").alias("digest"))


@query("t6_parse_pinpoint", """
SELECT answer_id, CASE turn % 4 WHEN 0 THEN concat('supplier#', lpad(cast(conv_id % 100 AS varchar), 9, '0')) WHEN 1 THEN 'x' ELSE '' END AS queryable_name,
  CASE turn % 4 WHEN 0 THEN 3 ELSE 0 END AS alternates, CASE turn % 4 WHEN 0 THEN 1.5 ELSE 10.0 END::double AS refined_lat, 20.0::double AS refined_lng,
  CASE turn % 4 WHEN 0 THEN 'street' WHEN 1 THEN 'city' ELSE 'none' END AS precision_level,
  CASE turn % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.9 ELSE 0 END::double AS confidence,
  CASE turn % 4 WHEN 0 THEN 'Japan' WHEN 3 THEN 'Peru' ELSE 'unknown' END AS confirmed_country,
  CASE turn % 4 WHEN 0 THEN 'r' WHEN 1 THEN '' WHEN 2 THEN 'unreadable JSON' ELSE 'answer without JSON' END AS reasoning
FROM answers""", "answers")
def t6(t):
    p = t.answers.select("answer_id", T.parse_pinpoint("raw", F.lit(10.0), F.lit(20.0), F.lit("Cusco, Peru")).alias("p")).select("answer_id", "p.*")
    return p.withColumn("alternates", F.size("alternate_queries").cast("long")).drop("alternate_queries")


@query("t7_parse_verdict", """
SELECT conv_id, turn, turn % 3 = 0 AS is_plausible, CASE turn % 3 WHEN 0 THEN 0.75 ELSE 0 END::double AS confidence,
  CASE turn % 3 WHEN 0 THEN 'Peru' ELSE 'unknown' END AS confirmed_country, CASE turn % 3 WHEN 0 THEN 'Latin' ELSE 'unknown' END AS primary_script,
  CASE turn % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'unreadable JSON' ELSE 'answer without JSON' END AS contradictions,
  CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN right(concat('{"is_guess_plausible": ', role, '}'), 500) ELSE right(text, 500) END AS reasoning
FROM conversations""")
def t7(t):
    k = F.col("turn") % 3
    good = F.lit('ok ```json {"is_guess_plausible": true, "confidence_score": 0.75, "confirmed_country_or_state": "Peru", '
                 '"primary_script_detected": "Latin", "contradictions_found": ["none"]} ``` end')
    raw = F.when(k == 0, good).when(k == 1, F.concat(F.lit('{"is_guess_plausible": '), "role", F.lit("}"))).otherwise(F.col("text"))
    p = t.read("conversations").select("conv_id", "turn", T.parse_verdict(raw).alias("v")).select("conv_id", "turn", "v.*")
    return p.withColumn("contradictions", F.array_join("contradictions", ";"))


_SEEN = """
seen AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Thai' WHEN 1 THEN 'Latin' WHEN 2 THEN 'Greek' WHEN 3 THEN 'Runic' END AS script,
         CASE lang WHEN 'fr' THEN 'Thailand' WHEN 'es' THEN 'Cyprus' WHEN 'de' THEN 'Japan' ELSE 'Peru' END AS country,
         CASE WHEN length(source) = 4 THEN 'left' ELSE 'right' END AS side FROM documents),
odd AS (SELECT doc_id, country, concat_ws(';',
   CASE WHEN (script = 'Thai' AND country <> 'Thailand') OR (script = 'Greek' AND country <> 'Cyprus') THEN concat(script, ' is not used in ', country) END,
   CASE WHEN country <> 'Peru' AND side <> 'left' THEN concat('drives on the right, ', country, ' on the left') END) AS odd FROM seen)"""


def seen(t):
    k = F.col("doc_id") % 5
    rows = t.read("documents").select(
        "doc_id", F.when(k == 0, "Thai").when(k == 1, "Latin").when(k == 2, "Greek").when(k == 3, "Runic").alias("script"),
        F.when(F.col("lang") == "fr", "Thailand").when(F.col("lang") == "es", "Cyprus").when(F.col("lang") == "de", "Japan")
        .otherwise("Peru").alias("country"), F.when(F.length("source") == 4, "left").otherwise("right").alias("driving_side"))
    sides = t.spark.createDataFrame([("Thailand", "left"), ("Cyprus", "left"), ("Japan", "left")], "country string, driving_side string")
    return G.contradictions(rows, G.script_rules(t.spark), sides)


@query("j16_contradictions", f"WITH {_SEEN} SELECT doc_id, odd FROM odd")
def j16(t):
    return seen(t).select("doc_id", F.array_join("contradictions", ";").alias("odd"))
