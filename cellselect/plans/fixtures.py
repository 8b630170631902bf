"""Derived views as DataFrames over the given tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellselect.functions import columns as X
from cellselect.functions import geo
from cellselect.operators import cells as C
from cellselect.operators.spatial import raster_blocks
from cellselect.session import tune

NL, TICKS = "\n", "```"


def cluster(key: str, mul: int, span: int, low: int):
    return (F.col(key) % 97 * mul % span).cast("double") / 1000 - low


def jitter(key: str, mul: int):
    return (F.col(key) * mul % 1000).cast("double") / 5000 - 0.1


class Tables:
    """Reads of one data folder; every derived view stays lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        return self.spark.sql("""
            SELECT CASE WHEN o_orderkey % 10 = 3 THEN concat('CAo', lpad(cast(o_orderkey AS string), 40, '0'))
                        ELSE lpad(cast(o_orderkey AS string), 22, '0') END AS pano_id,
                   o_orderkey AS sample_key, o_custkey AS cust_key,
                   cast(o_custkey % 97 * 7919 % 120000 AS double) / 1000 - 60
                     + cast(o_orderkey * 31 % 1000 AS double) / 5000 - 0.1D AS lat,
                   cast(o_custkey % 97 * 104729 % 340000 AS double) / 1000 - 170
                     + cast(o_orderkey * 17 % 1000 AS double) / 5000 - 0.1D AS lng,
                   CASE WHEN o_orderkey % 14 <> 0 THEN n_name END AS country_code,
                   CASE o_orderkey % 4 WHEN 0 THEN 1664 WHEN 1 THEN 6656 WHEN 2 THEN 8192 END AS height,
                   CASE o_orderstatus WHEN 'F' THEN 'launch' WHEN 'P' THEN 'scout' END AS source,
                   date_format(o_orderdate, 'yyyy-MM') AS capture_month
            FROM {o} JOIN {c} ON o_custkey = c_custkey JOIN {n} ON c_nationkey = n_nationkey""",
            o=self.read("orders"), c=self.read("customer"), n=self.read("nation"))

    @cached_property
    def split_samples(self) -> DataFrame:
        return (self.samples.withColumn("u", X.hash_uniform("pano_id", "country_code"))
                .withColumn("split", X.split_label("u", p_val=0.2, p_test=0.1)))

    @cached_property
    def s2_samples(self) -> DataFrame:
        return C.with_cells(self.split_samples)

    @cached_property
    def vocab(self) -> DataFrame:
        return C.cell_vocab(C.cell_stats(self.s2_samples))

    @cached_property
    def countries(self) -> DataFrame:
        return C.country_vocab(self.split_samples)

    @cached_property
    def crops(self) -> DataFrame:
        return (self.read("lineitem")
                .select(F.col("l_orderkey").alias("sample_key"),
                        ((F.col("l_linenumber") - 1) % 4 * 90).cast("long").alias("heading")).distinct())

    @cached_property
    def timeline(self) -> DataFrame:
        o = self.read("orders").select("o_orderkey", "o_custkey")
        anchors = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("anchor_key"))
        return (o.join(anchors, "o_custkey").where("o_orderkey <> anchor_key")
                .select("anchor_key", F.col("o_orderkey").alias("sibling_key")))

    @cached_property
    def coverage(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("point_id"),
            (cluster("c_custkey", 7919, 120000, 60) + jitter("c_custkey", 13)).alias("lat"),
            (cluster("c_custkey", 104729, 340000, 170) + jitter("c_custkey", 29)).alias("lng"))

    @cached_property
    def boundaries(self) -> DataFrame:
        """Polygons with rings; a triangular hole in every fourth box."""
        k = F.col("n_nationkey")
        box = self.read("nation").select(
            F.col("n_name").alias("gid_0"), F.col("n_name").alias("country"),
            F.concat(F.col("n_name"), F.lit(".1")).alias("gid_1"), F.lit("Region").alias("name_1"),
            F.concat(F.col("n_name"), F.lit(".1.1")).alias("gid_2"), F.lit("NA").alias("name_2"),
            (k % 3).cast("int").alias("layer"), k.cast("long").alias("ord"),
            (k % 5 * 68 - 170).cast("double").alias("x0"), (F.floor(k / 5) * 24 - 60).cast("double").alias("y0"),
            (k % 5 * 68 - 110).cast("double").alias("x1"), (F.floor(k / 5) * 24 - 40).cast("double").alias("y1"),
            (k % 4 == 0).alias("has_hole"))

        def pt(x, y):
            return F.struct(x.alias("x"), y.alias("y"))

        x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
        outer = F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))
        hole = F.array(pt(x0 + 20, y0 + 5), pt(x0 + 40, y0 + 5), pt(x0 + 30, y0 + 15))
        return box.withColumn("rings", F.when(F.col("has_hole"), F.array(outer, hole)).otherwise(F.array(outer))) \
                  .drop("x0", "y0", "x1", "y1", "has_hole")

    @cached_property
    def raster(self) -> DataFrame:
        r = self.spark.range(180).select(F.col("id").alias("row_idx"),
                                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(359).cast("long"))).alias("col_idx"))
        return r.withColumn("value", (F.col("row_idx") * 7 + F.col("col_idx") * 3) % 31)

    @cached_property
    def raster_blocks(self) -> DataFrame:
        return raster_blocks(self.raster, 64)

    @cached_property
    def gazetteer(self) -> DataFrame:
        s, n = self.read("supplier"), self.read("nation")
        k = F.col("s_suppkey")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.lower("s_name").alias("name"), F.col("n_name").alias("country"),
            ((k * 7919 % 120000).cast("double") / 1000 - 60).alias("lat"),
            ((k * 104729 % 340000).cast("double") / 1000 - 170).alias("lng"),
            ((k * 37 % 100).cast("double") / 100).alias("importance"),
            F.when(k % 4 == 0, "amenity=bank").when(k % 4 == 1, "place=city")
            .when(k % 4 == 2, "boundary=administrative").otherwise("highway=residential").alias("place_type"))

    # --- vectors, scores ---

    @cached_property
    def vectors(self) -> DataFrame:
        v = F.col("vec_id")
        base = self.read("embeddings").select(
            "vec_id", F.when((F.col("label") == 9) & (v >= 15), 10).otherwise(F.col("label")).cast("long").alias("l9"),
            F.col("embedding").cast("array<double>").alias("embedding"))
        l9 = F.col("l9")
        return base.select(
            "vec_id", "l9", F.floor(l9 / 2).alias("l6"), F.floor(l9 / 4).alias("l3"), (l9 * 4 + v % 4).alias("l12"),
            "embedding", (l9 * 10 - 45 + (v * 31 % 1000).cast("double") / 10000).alias("lat"),
            (l9 * 30 - 150 + (v * 17 % 1000).cast("double") / 10000).alias("lng"),
            F.concat(F.lit("C"), ((l9 + F.when(v % 5 == 0, 1).otherwise(0)) % 6).cast("string")).alias("country"))

    @cached_property
    def protos(self) -> DataFrame:
        return self.vectors.select("vec_id", F.col("l9").alias("cell_idx"), "embedding", "lat", "lng")

    @cached_property
    def probes(self) -> DataFrame:
        e = F.col("embedding")
        return self.vectors.select(F.col("vec_id").alias("query_id"),
                                   F.zip_with(e, X.rotate_views(e, F.lit(16)), lambda a, b: a + b * 0.5).alias("embedding"))

    @cached_property
    def label_long(self) -> DataFrame:
        cols = [F.struct(F.lit(n).alias("level"), i.cast("long").alias("idx")) for n, i in (
            (3, F.col("l3")), (6, F.col("l6")), (9, F.col("l9")),
            (12, F.when(F.col("l12") == 43, -1).otherwise(F.col("l12"))))]
        return (self.vectors.select(F.col("vec_id").alias("query_id"), F.explode(F.array(*cols)).alias("c"),
                                    "lat", "lng", "country")
                .select("query_id", "c.level", "c.idx", "lat", "lng", "country"))

    @cached_property
    def cells(self) -> DataFrame:
        cols = [F.struct(F.lit(n).alias("level"), F.col(f"l{n}").cast("long").alias("idx")) for n in geo.LEVELS]
        return (self.vectors.select(F.explode(F.array(*cols)).alias("c"), "lat", "lng")
                .groupBy("c.level", "c.idx")
                .agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("centroid_lat"), F.avg("lng").alias("centroid_lng")))

    @cached_property
    def pmap(self) -> DataFrame:
        idx = F.col("idx")

        def up(level: int, to: int, parent):
            return F.when(F.col("level") == level, F.struct(F.lit(to).alias("parent_level"), parent.cast("long").alias("parent_idx")))

        ups = F.array(up(12, 9, F.when(idx == 43, -1).otherwise(F.floor(idx / 4))), up(12, 6, F.floor(idx / 8)),
                      up(12, 3, F.floor(idx / 16)), up(9, 6, F.floor(idx / 2)), up(9, 3, F.floor(idx / 4)),
                      up(6, 3, F.floor(idx / 2)))
        return (self.cells.select(F.col("level").alias("child_level"), idx.alias("child_idx"),
                                  F.explode(F.filter(ups, lambda s: s.isNotNull())).alias("p"))
                .select("child_level", "child_idx", "p.parent_level", "p.parent_idx"))

    @cached_property
    def scores(self) -> DataFrame:
        """One row per (query, level, cell): each vector is scored against the whole vocabulary."""
        every = self.cells.select(F.struct("level", "idx").alias("s")).agg(F.collect_list("s").alias("cells")).scalar()
        v, lv, i = F.col("query_id"), F.col("level"), F.col("idx")
        return (self.vectors.select(F.col("vec_id").alias("query_id"), F.explode(every).alias("s"))
                .select("query_id", "s.level", "s.idx")
                .withColumn("logit", ((v * 37 + lv * 53 + i * i * 7 + i) % 17).cast("double") / 4))

    # --- text, events ---

    @cached_property
    def ocr_lines(self) -> DataFrame:
        lines = self.read("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
        pos = F.col("pos").cast("long")
        return lines.select("doc_id", pos.alias("pos"), (pos % 8).alias("tile"), "text",
                            ((F.col("doc_id") * 13 + pos * 7) % 100 / 100.0).alias("confidence"))

    @cached_property
    def guides(self) -> DataFrame:
        k, lang = F.col("doc_id"), F.col("lang")
        head = F.concat(
            F.lit("---\n"), F.when(k % 9 == 4, "").otherwise(F.concat(F.lit("country_code: "), "source", lang, F.lit(NL))),
            F.lit("country_name: Land of "), lang, F.lit("\ndriving_side: "),
            F.when(k % 3 == 0, "left").otherwise("right"), F.lit("\nlanguages: ["), lang,
            F.lit(", Other]\nscripts: [Latin, Thai]\nsource: corpus\nlast_updated: 2026-01-"),
            F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("\n---\n"))
        body = F.concat(F.lit("dropped intro\n## General Clues\n"), "text", F.lit("\n## spotlight\n"),
                        F.when(k % 5 == 0, "").otherwise(lang), F.lit("\n## general clues\n"),
                        F.when(k % 7 == 0, F.concat(F.lit("again "), lang)).otherwise(" "), F.lit(NL))
        return self.read("documents").select(
            "doc_id", F.concat(F.lit("doc"), k.cast("string")).alias("stem"),
            F.when(k % 50 == 7, F.col("text")).otherwise(F.concat(head, body)).alias("raw"))

    @cached_property
    def progress(self) -> DataFrame:
        k = F.col("event_id")
        names = ("fetch_pano_start", "fetch_pano_done", "stage1_start", "stage1_done",
                 "stage2_extract_start", "stage2_extract_done", "stage2_pinpoint_start", "stage2_pinpoint_done",
                 "stage2_geocode_start", "stage2_geocode_done", "heartbeat")
        last = F.when(k % 132 == 11, "heartbeat").when(F.col("event_type") == "error", "error").otherwise("done")
        event = last
        for i, name in enumerate(names):
            event = F.when(k % 12 == i, name).otherwise(event)
        return self.read("events").select(F.floor(k / 12).alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                                          event.alias("event"), F.col("props").alias("data"))

    @cached_property
    def answers(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        good = F.concat(
            F.lit('{"queryable_name":"supplier#'), F.lpad((c % 100).cast("string"), 9, "0"),
            F.lit('","alternate_queries":["a","supplier#'), F.lpad((t % 10).cast("string"), 9, "0"),
            F.lit('","c"],"refined_lat":1.5,"refined_lng":null,"precision_level":"Street","confidence":0.8,'
                  '"confirmed_country":"Japan","reasoning":"r"}'))
        fenced = F.lit(f'thinking {TICKS}json {{"queryable_name":"x","precision_level":"city","confidence":0.9}} {TICKS}')
        return self.read("conversations").select(
            (c * 1000 + t).alias("answer_id"), "conv_id", "turn",
            F.when(t % 4 == 0, good).when(t % 4 == 1, fenced).when(t % 4 == 2, '{"precision_level": broken}')
            .otherwise(F.concat(F.lit("no answer "), "text")).alias("raw"))
