"""File sources and sinks: CSV, JSON feeds, GeoJSON, Markdown, Parquet layouts, NDJSON, images."""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellselect.functions import geo
from cellselect.operators.catalog import dedupe_priority
from cellselect.operators.scale import first_n, with_chunks
from cellselect.sources.json_objects import json_objects
from cellselect.sources.named_files import is_local, list_named, local_path, read_named

log = logging.getLogger(__name__)


# --- metadata, feeds, logs --------------------------------------------------------------------

def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of (pano_id, lat, lng); rows whose coordinates do not parse are skipped."""
    raw = spark.read.schema("pano_id string, lat string, lng string").csv(path, header=True)
    out = raw.select("pano_id", F.trim("lat").try_cast("double").alias("lat"), F.trim("lng").try_cast("double").alias("lng"))
    return (out.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
            .withColumn("valid_coord", geo.valid_coord("lat", "lng")))


def index_files(paths: DataFrame, label: str | Column | None = None) -> DataFrame:
    """(path, priority) → (pano_id, source_dir, path): only ``.jpg``, the least priority wins. The tag is the
    label, a text or a column of ``paths``, or the file's folder."""
    stem = F.regexp_extract("path", r"([^/]+)\.jpg$", 1)
    tag = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) if label is None or isinstance(label, str) and not label else F.lit(label)
    rows = (paths.where(F.col("path").endswith(".jpg"))
            .select(stem.alias("pano_id"), tag.alias("source_dir"), "path", "priority"))
    return dedupe_priority(rows, "pano_id", ["priority", "path"])


def list_images(spark: SparkSession, roots: Sequence[str], label: str | None = None, nested: bool = False) -> DataFrame:
    """File index of image folders, earlier roots first; a missing root is a warning. Contents are never read.
    Tasks list folders on disks and mounts (``nested``: with the folders below them, under the root's name), so
    the driver holds no listing there; Spark lists other file systems."""
    local, parts = {}, []
    for i, root in enumerate(roots):
        if is_local(root):
            if os.path.isdir(local_path(root)):
                local[i] = root
            else:
                log.warning("no such image folder: %s", root)
            continue
        try:
            files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", nested).load(root))
        except AnalysisException:
            log.warning("no such image folder: %s", root)
            continue
        parts.append(files.select(F.lit(i).alias("priority"), "path"))
    out = list_named(spark, local, "*.jpg", nested)
    for p in parts:
        out = out.unionByName(p)
    if label or not nested:
        return index_files(out, label)
    tags = F.create_map(*[F.lit(v) for i, r in enumerate(roots) for v in (i, r.rstrip("/").rsplit("/", 1)[-1])]) if roots else F.lit(None)
    return index_files(out, tags[F.col("priority")])


def read_feed(spark: SparkSession, path: str, seen: DataFrame, limit: int | None = None,
              multi_line: bool = True, large: bool = False) -> DataFrame:
    """Coordinate feed: explode, skip uploads (``CAo…``) and seen ids, each id once (its least
    coordinate). All rows come back unless the caller names a ``limit``; then the first ids in order.
    Files are whole objects or one per line; ``large`` cuts a whole object's coordinates by many tasks."""
    point = "struct<panoId:string,lat:double,lng:double>"
    if large:
        found = json_objects(spark, path).select(F.from_json("value", point).alias("c"))
    else:
        found = spark.read.schema(f"customCoordinates array<{point}>").json(path, multiLine=multi_line).select(F.explode("customCoordinates").alias("c"))
    rows = found.select(F.col("c.panoId").alias("pano_id"), "c.lat", "c.lng")
    fresh = (rows.where(F.col("pano_id").isNotNull() & ~F.col("pano_id").startswith("CAo"))
             .join(seen.select("pano_id").distinct(), "pano_id", "left_anti"))
    once = fresh.groupBy("pano_id").agg(F.min(F.struct("lat", "lng")).alias("c")).select("pano_id", "c.lat", "c.lng")
    return once if limit is None else first_n(once, ["pano_id"], limit)


def seen_ids(spark: SparkSession, ids_json: str | None = None, log_csv: str | None = None,
             files: DataFrame | None = None) -> DataFrame:
    """Ids of the JSON checkpoint, the CSV log and the saved images, each once."""
    parts = []
    if ids_json:
        parts.append(read_ids(spark, ids_json))
    if log_csv:
        parts.append(spark.read.schema("pano_id string, lat string, lng string").csv(log_csv, header=True).select("pano_id"))
    if files is not None:
        parts.append(files.select("pano_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("pano_id").isNotNull()).distinct()


def write_log(df: DataFrame, path: str) -> None:
    """Append to the CSV progress log (one header per file)."""
    df.select("pano_id", "lat", "lng").write.mode("append").csv(path, header=True)


def write_ids(df: DataFrame, path: str) -> None:
    """Id checkpoint: JSON arrays of bounded length, one per line and hash chunk."""
    chunk = with_chunks(df.select("pano_id", F.lit(0).alias("_g")), ["_g"], ["pano_id"], 10_000)
    (chunk.groupBy("_g", "chunk").agg(F.to_json(F.collect_list("pano_id")).alias("value"))
     .select("value").write.mode("overwrite").text(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of JSON arrays: one or many per file, each on a line of its own or spread over lines."""
    inside = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return spark.read.text(path).select(F.explode(F.coalesce(F.from_json("value", "array<string>"), inside)).alias("pano_id"))


# --- geometry ---------------------------------------------------------------------------------

_POINT = "array<double>"
_GEOMETRY = "struct<type:string,coordinates:string>"


def _rings(geometry: Column) -> Column:
    """Rings of a Polygon or MultiPolygon as array<array<struct(x, y)>>; null for a feature without
    geometry, an error for geometries that have no area."""
    polygon = F.from_json(geometry["coordinates"], f"array<array<{_POINT}>>")
    multi = F.flatten(F.from_json(geometry["coordinates"], f"array<array<array<{_POINT}>>>"))
    rings = F.when(geometry["type"] == "Polygon", polygon).when(geometry["type"] == "MultiPolygon", multi)
    other = F.concat(F.lit("no polygon but "), geometry["type"])
    rings = rings.when(geometry["type"].isNotNull(), F.raise_error(other).cast("array<array<array<double>>>"))
    # the closing vertex repeats the first and is dropped
    return F.transform(rings, lambda r: F.transform(
        F.when(F.element_at(r, 1) == F.element_at(r, -1), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r),
        lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))))


def read_geojson(spark: SparkSession, path: str, multi_line: bool = True, large: bool = False) -> DataFrame:
    """FeatureCollection, Feature or bare geometry → (layer, ord, admin columns, rings). All parts
    together are the region; rings of a file stay separate rows. ``large`` is for FeatureCollections
    that one task should not read: their features are cut out by many."""
    schema = (f"type string, coordinates string, geometry {_GEOMETRY}, properties map<string,string>, "
              f"features array<struct<geometry:{_GEOMETRY},properties:map<string,string>>>")
    raw = spark.read.schema(schema).json(path, multiLine=multi_line)
    own = F.struct(F.when(F.col("geometry").isNotNull(), F.col("geometry"))
                   .otherwise(F.struct("type", "coordinates")).alias("geometry"), F.col("properties").alias("properties"))
    f = raw.select(F.explode(F.coalesce("features", F.array(own))).alias("f")).select("f.geometry", "f.properties")
    if large:
        one = F.from_json("value", f"type string, geometry {_GEOMETRY}, properties map<string,string>").alias("f")
        f = json_objects(spark, path).select(one).where("f.type = 'Feature'").select("f.geometry", "f.properties")
    prop = F.col("properties")

    def text(name: str) -> Column:
        return F.try_element_at(prop, F.lit(name))

    return f.select(
        F.coalesce(text("layer").try_cast("int"), F.lit(0)).alias("layer"),
        F.coalesce(text("ord").try_cast("long"), F.xxhash64(F.to_json("geometry"))).alias("ord"),
        text("GID_0").alias("gid_0"), text("COUNTRY").alias("country"), text("GID_1").alias("gid_1"),
        text("NAME_1").alias("name_1"), text("GID_2").alias("gid_2"), text("NAME_2").alias("name_2"),
        _rings(F.col("geometry")).alias("rings"))


def read_boundaries(layers: dict[int, DataFrame]) -> DataFrame:
    """Boundary layers (0 finest) as one table; only the admin columns and rings are read."""
    cols = ["ord", "gid_0", "country", "gid_1", "name_1", "gid_2", "name_2", "rings"]
    out = None
    for layer, df in layers.items():
        part = df.select(F.lit(layer).alias("layer"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


# --- guides -----------------------------------------------------------------------------------

def read_guides(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """One row per guide file: (stem, raw). The stem is the file's name, or its ``stem=…`` folder. Tasks list and
    read folders on disks and mounts; Spark does so on other file systems."""
    if not is_local(path):
        files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
        named = F.regexp_extract("_metadata.file_name", r"(.+)\.[^.]+$", 1)
        return files.select((F.col("stem") if "stem" in files.columns else named).alias("stem"), F.col("value").alias("raw"))
    root = local_path(path)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no folder of guides: {path}")
    below = F.substring("path", len(root) + 2, 1 << 20)
    folder = F.regexp_extract(below, r"^stem=([^/]+)/[^/]+$", 1)
    files = list_named(spark, {0: root}, glob, nested=True).where(~below.contains("/") | (folder != ""))
    stem = F.when(folder != "", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(F.regexp_extract(below, r"([^/]+)\.[^.]+$", 1))
    return read_named(files).select(stem.alias("stem"), F.col("content").cast("string").alias("raw"))


# --- tables -----------------------------------------------------------------------------------

def write_cells(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").partitionBy("level").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_country_dist(spark: SparkSession, path: str, levels: Sequence[int] = geo.LEVELS) -> DataFrame:
    """P(country | cell) stored by level; missing levels are skipped, none at all is an error."""
    df = spark.read.parquet(path).where(F.col("level").isin(*levels))
    if df.isEmpty():
        raise FileNotFoundError(f"no country distribution in {path}")
    return df


def write_prototypes(protos: DataFrame, path: str, pack: int = 512) -> None:
    """Index sink: rows of a cell lie together (sorted inside files, so a cell's row groups are found
    by their statistics); a hot cell spreads over chunks instead of one file."""
    (with_chunks(protos, ["cell_idx"], ["vec_id"], pack).sortWithinPartitions("cell_idx", "chunk")
     .write.mode("overwrite").parquet(path))


def write_shard(protos: DataFrame, path: str, shard: int, level: int) -> None:
    protos.withColumns({"shard": F.lit(shard), "level": F.lit(level)}).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    out = None
    for p in paths:
        part = spark.read.parquet(p).withColumn("file", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``{"codes": [...]}`` objects in index order, one per line and block of 10,000 codes (a country
    list is one line); each line tells where it starts."""
    start = (F.floor(F.col("idx") / 10_000) * 10_000).alias("start")
    codes = F.transform(F.sort_array(F.collect_list(F.struct("idx", "code"))), lambda s: s["code"])
    (vocab.groupBy(start).agg(codes.alias("codes")).select(F.to_json(F.struct("codes", "start")).alias("value"))
     .write.mode("overwrite").text(path))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("codes array<string>, start long").json(path)
    return rows.select("start", F.posexplode("codes").alias("at", "code")).select((F.coalesce("start", F.lit(0)) + F.col("at")).alias("idx"), "code")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Country weights: nested under ``weights`` or at top level; keys starting ``_`` are comments."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    inner = F.coalesce(F.from_json(F.try_element_at("m", F.lit("weights")), "map<string,string>"), F.col("m"))
    return (text.select(F.explode(inner).alias("code", "w")).where(~F.col("code").startswith("_"))
            .select("code", F.col("w").cast("double").alias("weight")))


def write_events(df: DataFrame, path: str) -> None:
    """NDJSON of ``{event, data}`` rows; values JSON cannot hold are written as text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


EVENT_SCHEMA = "request_id long, ts timestamp, event_id long, event string, data string"


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(EVENT_SCHEMA)
    return reader.json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images with their size and aspect; a file that does not decode keeps its row, with ``error``."""
    img = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    broken = F.col("height") < 0
    size = {c: F.when(~broken, F.col(c)) for c in ("height", "width", "nChannels", "mode", "data")}
    return img.withColumn("error", F.when(broken, "undecodable")).withColumns(size).withColumn("aspect", F.col("width") / F.col("height"))
