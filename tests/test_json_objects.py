"""One large JSON file cut by many tasks gives the objects that a whole parse gives."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from cellselect.sources import files
from cellselect.sources.json_objects import json_objects


@pytest.fixture(params=[200, 3000, 1 << 20])
def small_splits(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], str(request.param))
    spark.conf.set(keys[1], "1")
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def odd_objects(n):
    rng = random.Random(n)
    texts = ['a "b" c', "}{][", "back\\slash", '\\"}', "ünï}", "\n}\n", "", 'x\\\\"', "long " * 60]
    return [{"i": i, "t": rng.choice(texts) + rng.choice(texts), "deep": {"a": [{"b": [1, {"c": "}"}]}]}, rng.choice(texts) or "k": None} for i in range(n)]


def test_objects_of_a_large_file(spark, tmp_path, small_splits):
    some, others = odd_objects(300), odd_objects(40)
    (tmp_path / "one.json").write_text(json.dumps({"meta": {"note": "} \" {"}, "rows": some, "more": others}, indent=2, ensure_ascii=False))
    (tmp_path / "two.json").write_text(json.dumps({"rows": others}))
    out = json_objects(spark, str(tmp_path)).collect()
    got = sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in out)
    assert got == sorted(json.dumps(x, sort_keys=True) for x in [*some, *others, *others])
    if small_splits < 10_000:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_depth_one_and_empty(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps(odd_objects(50)))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    assert len(json_objects(spark, str(tmp_path), depth=1).collect()) == 50


def test_a_cut_file_is_an_error(spark, tmp_path, small_splits):
    text = json.dumps({"rows": odd_objects(20)})
    (tmp_path / "a.json").write_text(text[:-30])
    with pytest.raises(PySparkException, match="ends inside an object"):
        json_objects(spark, str(tmp_path)).collect()


def test_readers_give_the_same_rows_either_way(spark, tmp_path, small_splits):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    features = [{"type": "Feature", "properties": {"GID_0": f"G{i}", "ord": i, "COUNTRY": "a}b\""}, "geometry": {"type": "Polygon", "coordinates": [ring] * (1 + i % 3)}} for i in range(60)]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features}))
    key = lambda r: str(r)
    whole, cut = (sorted(files.read_geojson(spark, str(tmp_path / "f.json"), large=large).collect(), key=key) for large in (False, True))
    assert whole == cut and len(cut) == 60
    points = [{"panoId": f"{i % 70:022d}" if i % 9 else f"CAo{i}", "lat": i / 7, "lng": -i / 3, "extra": {"x": [1]}} for i in range(400)]
    (tmp_path / "p.json").write_text(json.dumps({"name": "m", "customCoordinates": points}))
    seen = spark.createDataFrame([("0" * 21 + "5",)], "pano_id string")
    whole, cut = (sorted(files.read_feed(spark, str(tmp_path / "p.json"), seen, large=large).collect()) for large in (False, True))
    assert whole == cut and len(cut) == 69
