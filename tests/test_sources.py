import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellselect.functions import text as T
from cellselect.operators import images as I
from cellselect.operators import spatial as S
from cellselect.operators import text as G
from cellselect.plans import load
from cellselect.sources import files


def png(path, arr):
    h, w, _ = arr.shape
    raw = b"".join(b"\0" + arr[r].tobytes() for r in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_metadata_skips_bad_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("pano_id,lat,lng\na,1.5,2\nb,x,2\nc,95,2\n")
    got = {r.pano_id: r.valid_coord for r in files.read_metadata(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"a": True, "c": False}


def test_list_images_first_root_wins(spark, tmp_path):
    for root, names in (("pool", ["a.jpg", "b.JPG", "n.txt"]), ("extra", ["a.jpg", "c.jpg"])):
        (tmp_path / root).mkdir()
        for n in names:
            (tmp_path / root / n).write_bytes(b"x")
    roots = [str(tmp_path / r) for r in ("pool", "missing", "extra")]
    got = {r.pano_id: r.source_dir for r in files.list_images(spark, roots).collect()}
    assert got == {"a": "pool", "c": "extra"}
    assert {r.source_dir for r in files.list_images(spark, roots, "tag").collect()} == {"tag"}


def test_feed_and_seen(spark, tmp_path):
    feed = {"customCoordinates": [{"panoId": p, "lat": 1.0, "lng": 2.0} for p in ("a", "CAoX", "b", "c")]}
    (tmp_path / "feed.json").write_text(json.dumps(feed, indent=1))
    (tmp_path / "ids.json").write_text(json.dumps(["b", "z"]))
    (tmp_path / "log.csv").write_text("pano_id,lat,lng\nc,1,2\n")
    seen = files.seen_ids(spark, str(tmp_path / "ids.json"), str(tmp_path / "log.csv"), spark.createDataFrame([("q",)], "pano_id string"))
    assert {r.pano_id for r in seen.collect()} == {"b", "z", "c", "q"}
    assert [r.pano_id for r in files.read_feed(spark, str(tmp_path / "feed.json"), seen).collect()] == ["a"]


def test_geojson_collection_feature_and_geometry(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    multi = {"type": "MultiPolygon", "coordinates": [square, [[[10, 10], [12, 10], [12, 12], [10, 12], [10, 10]]]]}
    docs = {"fc": {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"GID_0": "A"}, "geometry": multi}]},
            "f": {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": square}},
            "g": {"type": "Polygon", "coordinates": square}}
    for name, want in (("fc", {1, 2}), ("f", {1}), ("g", {1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(docs[name]))
        polys = files.read_geojson(spark, str(tmp_path / f"{name}.json"))
        pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 11.0, 11.0), (3, 7.0, 7.0)], "id int, lat double, lng double")
        assert {r.id for r in S.within_any(pts, polys).where("inside").collect()} == want


def test_guides(spark, tmp_path):
    (tmp_path / "AND.md").write_text("---\ncountry_name: Andorra\nlanguages: [Catalan, Spanish]\nscripts: []\n---\nintro\n## A b\n\none\ntwo\n## empty\n\n## a b\nlast\n")
    (tmp_path / "bad.md").write_text("no header")
    p = G.parse_front_matter(files.read_guides(spark, str(tmp_path)))
    rows = {r.stem: r for r in p.collect()}
    assert rows["bad"].bad and rows["AND"].country_code == "AND" and rows["AND"].languages == ["Catalan", "Spanish"] and rows["AND"].scripts == []
    assert [(r.section, r.text) for r in G.explode_sections(p).collect()] == [("a_b", "last")]


def test_weights_top_level_and_nested(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_comment": "x", "JPN": 2}')
    (tmp_path / "b.json").write_text('{"weights": {"_c": 0, "BRA": 1.5}, "other": 1}')
    assert [(r.code, r.weight) for r in files.read_weights(spark, str(tmp_path / "a.json")).collect()] == [("JPN", 2.0)]
    assert [(r.code, r.weight) for r in files.read_weights(spark, str(tmp_path / "b.json")).collect()] == [("BRA", 1.5)]


def test_country_dist_missing(spark, tmp_path):
    df = spark.createDataFrame([(3, 0, "A", 1.0)], "level int, idx long, country string, p double")
    df.write.partitionBy("level").parquet(str(tmp_path / "d"))
    assert files.read_country_dist(spark, str(tmp_path / "d")).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_country_dist(spark, str(tmp_path / "d"), levels=(6,))


def test_image_source_views_and_trim(spark, tmp_path):
    flat = np.full((16, 32, 3), 77, np.uint8)
    framed = np.zeros((10, 12, 3), np.uint8)
    framed[2:7, 3:9] = 200
    black = np.zeros((4, 6, 3), np.uint8)
    for name, arr in (("flat", flat), ("framed", framed), ("black", black)):
        png(tmp_path / f"{name}.png", arr)
    imgs = files.read_images(spark, str(tmp_path)).withColumn("pano_id", F.regexp_extract("origin", r"([^/]+)\.png$", 1))
    assert {r.pano_id: round(r.aspect, 2) for r in imgs.collect()} == {"flat": 2.0, "framed": 1.2, "black": 1.5}
    v = I.render_views(imgs.where("pano_id = 'flat'"), size=8).collect()
    assert len(v) == 4 and all(set(r.data) == {77} for r in v) and v[0].path == "fl/flat_000.jpg"
    got = {r.pano_id: (r.height, r.width) for r in I.trim_black(imgs).collect()}
    assert got == {"flat": (16, 32), "framed": (5, 6), "black": (4, 6)}
    done = spark.createDataFrame([("flat", 270)], "pano_id string, heading int")
    assert I.render_views(imgs.where("pano_id = 'flat'"), done=done).count() == 0


def test_view_heading_turns_right():
    """Columns hold their longitude: the middle of a view shows its heading."""
    w = 360
    img = np.tile(np.arange(w, dtype=np.float32)[None, :, None] / 2, (180, 1, 1))
    for heading in (0, 90, 270):
        view = I.bilinear(img, *I.view_grid(180, w, heading, 90.0, 9, 0.0))
        want = ((heading + 180) % 360 - 0.5) / 2
        assert abs(float(view[4, 4, 0]) - want) <= 1
        assert heading == 180 or view[4, 8, 0] != view[4, 0, 0]


def test_broken_image_gives_error_row(spark):
    bad = spark.createDataFrame([("x", 4, 4, 3, bytearray(b"12"))], "pano_id string, height int, width int, nChannels int, data binary")
    r = I.render_views(bad, size=4).first()
    assert r.error and r.heading is None


def test_parse_edges(spark):
    raws = ["", "{}", '{"precision_level": "CITY", "confidence": null}', 'text {"precision_level": "street", "refined_lat": "3.5"} tail', "```json\n{bad}\n```"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    out = {r.i: r.p for r in df.select("i", T.parse_pinpoint("raw", F.lit(1.0), F.lit(2.0), F.lit("")).alias("p")).collect()}
    assert out[0].precision_level == "none" and out[0].confirmed_country == "unknown" and out[0].refined_lat == 1.0
    assert out[1].precision_level == "none" and out[1].queryable_name == ""
    assert out[2].precision_level == "city" and out[2].confidence == 0.0
    assert out[3].precision_level == "street" and out[3].refined_lat == 3.5
    assert out[4].reasoning == "unreadable JSON"


def test_unknown_image_mode_is_an_error(spark):
    with pytest.raises(Exception, match="unknown mode"):
        spark.range(1).select(T.image_mode(F.lit(2.0), F.lit(1.0), F.lit("odd"))).collect()


def test_guides_are_read_as_they_are(spark, tmp_path):
    """Many guides of one folder are listed and read by tasks; empty ones and folders named by stem count."""
    for i in range(300):
        (tmp_path / f"g{i}.txt").write_bytes(f"text {i}\n".encode() * (i % 3))
    (tmp_path / "g.md").write_text("another suffix")
    (tmp_path / "stem=a%3Ab").mkdir()
    (tmp_path / "stem=a%3Ab" / "part-0.txt").write_text("folder")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.txt").write_text("not a guide")
    out = files.read_guides(spark, str(tmp_path), "*.txt")
    assert "FileScan" not in out._jdf.queryExecution().toString()  # such a scan lists in the driver
    want = {f"g{i}": f"text {i}\n" * (i % 3) for i in range(300)} | {"a:b": "folder"}
    assert {r.stem: r.raw for r in out.collect()} == want and out.count() == 301


def test_list_images_of_nested_folders_and_empty_files(spark, tmp_path):
    for name in ("one/00/a.jpg", "one/00/_b.jpg", "one/c.jpg", "one/.d.jpg", "two/01/02/a.jpg", "two/01/e.jpg", "two/01/f.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    roots = [f"file:{tmp_path}/one", str(tmp_path / "missing"), f"{tmp_path}/two/"]
    out = files.list_images(spark, roots, nested=True)
    assert "FileScan" not in out._jdf.queryExecution().toString()
    assert {r.pano_id: r.source_dir for r in out.collect()} == {"a": "one", "_b": "one", "c": "one", "e": "two"}
    assert {r.pano_id for r in files.list_images(spark, roots).collect()} == {"c"}
    assert {r.source_dir for r in files.list_images(spark, roots, "tag", nested=True).collect()} == {"tag"}


def test_listed_files_need_no_inode_each(spark, tmp_path, monkeypatch):
    """s2_list_images writes a name per sample and more: at 50 million samples, more than a disk has inodes."""
    monkeypatch.setattr("cellselect.plans.q_sources.scratch_path", lambda _, name: str(tmp_path / name))
    out = load()[0]["s2_list_images"](spark, "/root/testdata/sf0.001")
    found = [p.stat() for p in (tmp_path / "pools").rglob("*") if p.is_file()]
    assert len(found) == 1800 and len({s.st_ino for s in found}) <= 32
    assert out.count() == 1300
