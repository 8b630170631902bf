"""Catalogue and sampling jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import columns as X
from cellselect.operators import catalog as O
from cellselect.operators import sampling as P
from cellselect.operators import spatial as S
from cellselect.plans.registry import query
from cellselect.plans.views import hav, sha_uniform, tile


@query("s11_insert_ignore", """
SELECT p_partkey, p_name FROM (SELECT l_partkey AS p_partkey, concat('new', cast(min(l_orderkey) AS varchar)) AS p_name FROM lineitem GROUP BY l_partkey)
WHERE p_partkey NOT IN (SELECT p_partkey * 2 FROM part)""")
def s11(t):
    new = t.read("lineitem").select(F.col("l_partkey").alias("p_partkey"),
                                    F.concat(F.lit("new"), F.col("l_orderkey").cast("string")).alias("p_name"), "l_orderkey")
    old = t.read("part").select((F.col("p_partkey") * 2).alias("p_partkey"), "p_name")
    return O.insert_ignore(new, old, "p_partkey", ["l_orderkey"]).select("p_partkey", "p_name")


_UPSERT = """
SELECT coalesce(p_partkey, k) AS p_partkey, coalesce(n.price, p_retailprice) AS price FROM part FULL JOIN (
  SELECT l_partkey * 2 AS k, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem GROUP BY l_partkey) n
ON k = p_partkey"""


def _upsert(t):
    old = t.read("part").select("p_partkey", F.col("p_retailprice").alias("price"))
    new = t.read("lineitem").select(
        (F.col("l_partkey") * 2).alias("p_partkey"), F.col("l_extendedprice").alias("price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return O.upsert(old, new, ["p_partkey"], "o")


@query("s12_replace", _UPSERT)
def s12(t):
    return _upsert(t)


@query("s13_update_on_conflict", f"SELECT round(sum(price), 2) AS total, count(*) AS n FROM ({_UPSERT})")
def s13(t):
    return _upsert(t).agg(F.round(F.sum("price"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("s14_prune", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey * 2 FROM lineitem)")
def s14(t):
    seen = t.read("lineitem").select((F.col("l_partkey") * 2).alias("p_partkey"))
    return O.prune(t.read("part").select("p_partkey"), seen, ["p_partkey"])


@query("s15_run_ledger", """
SELECT user_id AS run_id, arg_max(CASE WHEN event_type = 'purchase' THEN 'complete' ELSE 'running' END, ts) AS status, min(ts) AS started_at,
       max(CASE WHEN event_type = 'purchase' THEN ts END) AS completed_at, max(event_type) AS label, max(event_id) AS target FROM events GROUP BY user_id""")
def s15(t):
    status = F.when(F.col("event_type") == "purchase", "complete").otherwise("running")
    e = t.read("events").select(F.col("user_id").alias("run_id"), "ts", status.alias("status"),
                                F.col("event_type").alias("label"), F.col("event_id").alias("target"))
    return O.run_ledger(e)


def _files(t):
    """Every order line's key, doubled: half of the files have no sample, half of the samples no file."""
    return t.read("lineitem").select((F.col("l_orderkey") * 2).alias("sample_key")).distinct()


_FILES = "SELECT DISTINCT l_orderkey * 2 AS sample_key FROM lineitem"


@query("j1_match_files", f"""
SELECT state, count(*) AS n FROM (
  SELECT CASE WHEN s.sample_key IS NOT NULL AND f.sample_key IS NOT NULL THEN 'both' WHEN s.sample_key IS NOT NULL THEN 'csv_only' ELSE 'file_only' END AS state
  FROM (SELECT sample_key FROM samples) s FULL JOIN ({_FILES}) f USING (sample_key)) GROUP BY state""", "samples")
def j1(t):
    return O.match_files(t.samples.select("sample_key"), _files(t), "sample_key").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("j2_skip_known", f"SELECT sample_key FROM samples WHERE sample_key NOT IN ({_FILES})", "samples")
def j2(t):
    return O.skip_known(t.samples, _files(t), "sample_key").select("sample_key")


@query("j3_pending_crops", """
SELECT sample_key FROM samples s WHERE NOT EXISTS (SELECT 1 FROM crops c WHERE c.sample_key = s.sample_key AND c.heading = 270)""", "samples crops")
def j3(t):
    return O.pending_crops(t.samples.select("sample_key"), t.crops, "sample_key")


@query("j4_complete_samples", """
SELECT sample_key FROM samples s WHERE (SELECT count(*) FROM crops c WHERE c.sample_key = s.sample_key) = 4""", "samples crops")
def j4(t):
    return O.complete_samples(t.samples.select("sample_key"), t.crops, "sample_key")


@query("j18_timeline_edges", """
SELECT anchor_key AS anchor, sibling_key AS sibling FROM timeline""", "timeline")
def j18(t):
    """Each order lists its customer's first order, itself and a gap as a timeline entry of that anchor."""
    o = t.read("orders").select("o_custkey", "o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("anchor"))
    h = F.array("anchor", "o_orderkey", F.lit(None).cast("long"), "o_orderkey")
    return O.timeline_edges(o.join(first, "o_custkey").select("anchor", h.alias("h")), "anchor", "h")


_LOC = "min(s.sample_key) OVER (PARTITION BY cust_key - CASE WHEN cust_key % 3 = 1 THEN 1 ELSE 0 END)"


@query("j19_location_split", f"""
SELECT sample_key, location, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split FROM (
  SELECT sample_key, location, {sha_uniform('cast(location AS varchar)', "'loc'")} AS u
  FROM (SELECT s.sample_key, {_LOC} AS location FROM samples s))""", "samples")
def j19(t):
    """Timelines that name only their next entry: each order its customer's next order, and the last order of
    every third customer the first one of the next customer, so locations are chains over two customers."""
    from pyspark.sql import Window
    s = t.samples.select("sample_key", "cust_key")
    after = F.lead("sample_key").over(Window.partitionBy("cust_key").orderBy("sample_key"))
    steps = s.withColumn("next_key", after).where("next_key IS NOT NULL").select("sample_key", "next_key")
    ends = s.groupBy("cust_key").agg(F.min("sample_key").alias("first"), F.max("sample_key").alias("last"))
    over = ends.where("cust_key % 3 = 0").select((F.col("cust_key") + 1).alias("cust_key"), F.col("last").alias("sample_key")).join(
        ends.select("cust_key", F.col("first").alias("next_key")), "cust_key").select("sample_key", "next_key")
    g = O.location_groups(s.select("sample_key"), steps.unionByName(over), "sample_key", "sample_key", "next_key")
    u = X.hash_uniform(F.col("location").cast("string"), F.lit("loc"))
    return g.select("sample_key", "location", X.split_label(u, 0.2, 0.1).alias("split"))


@query("a7_ingest_report", f"""
WITH m AS (SELECT sample_key, height IS NOT NULL AS valid FROM samples), f AS ({_FILES}),
k AS (SELECT o_orderkey * 3 AS sample_key FROM orders)
SELECT (SELECT count(*) FROM m) AS seen,
  (SELECT count(*) FROM m WHERE sample_key IN (FROM k)) AS skipped,
  (SELECT count(*) FROM m WHERE valid AND sample_key NOT IN (FROM k) AND sample_key IN (FROM f)) AS ingested,
  (SELECT count(*) FROM m WHERE sample_key NOT IN (FROM k) AND sample_key NOT IN (FROM f)) AS csv_without_file,
  (SELECT count(*) FROM f WHERE sample_key NOT IN (FROM k) AND sample_key NOT IN (SELECT sample_key FROM m WHERE valid)) AS file_without_csv
""", "samples")
def a7(t):
    meta = t.samples.select("sample_key", F.col("height").isNotNull().alias("valid"))
    known = t.read("orders").select((F.col("o_orderkey") * 3).alias("sample_key"))
    return O.ingest_report(meta, _files(t), known, "sample_key")


_TX, _TY = tile("lat", "lng", 12)


@query("a8_reject_report", f"""
WITH cov AS (SELECT DISTINCT p.sample_key FROM (SELECT *, {_TX} AS tx, {_TY} AS ty FROM samples) p
  JOIN (SELECT *, {_TX} AS tx, {_TY} AS ty FROM coverage) c USING (tx, ty) WHERE {hav('p.lat', 'p.lng', 'c.lat', 'c.lng', '6371000.0')} <= 2500)
SELECT CASE WHEN c.sample_key IS NULL THEN 'no_coverage'
            WHEN length(pano_id) = 22 AND (height IS NULL OR height <> 1664) AND (source IS NULL OR source = 'launch') THEN 'collected' ELSE 'filter' END AS reason,
       count(*) AS n FROM samples LEFT JOIN cov c USING (sample_key) GROUP BY reason""", "samples coverage")
def a8(t):
    near = S.covered(t.samples.select("sample_key", "lat", "lng"), t.coverage, 2500, 12).select("sample_key", F.lit(True).alias("cov"))
    s = t.samples.join(near, "sample_key", "left").withColumns(
        {"cov": F.coalesce("cov", F.lit(False)), "ok": X.passes_filter()})
    return O.reject_report(s, "cov", "ok")


@query("a9_split_report", "SELECT split, count(*) AS n FROM split_samples GROUP BY split", "split_samples")
def a9(t):
    return O.split_report(t.split_samples)


@query("w4_dedupe_priority", """
SELECT l_partkey, l_orderkey, l_linenumber FROM (
  SELECT l_partkey, l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey) AS rn FROM lineitem) WHERE rn = 1""")
def w4(t):
    rows = t.read("lineitem").select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return O.dedupe_priority(rows, "l_partkey", ["l_linenumber", "l_orderkey"])


@query("w5_cap_per_group", """
SELECT cust_cluster, sample_key FROM (
  SELECT cust_key % 97 AS cust_cluster, sample_key, row_number() OVER (PARTITION BY cust_key % 97 ORDER BY sample_key) AS rn FROM samples) WHERE rn <= 16""", "samples")
def w5(t):
    rows = t.samples.select((F.col("cust_key") % 97).alias("cust_cluster"), "sample_key")
    return P.cap_per_group(rows, ["cust_cluster"], 16, ["sample_key"])


@query("w6_stride_shard", """
SELECT sample_key FROM (SELECT sample_key, row_number() OVER (ORDER BY sample_key) - 1 AS r FROM samples) WHERE r % 4 = 1""", "samples")
def w6(t):
    return P.stride_shard(t.samples.select("sample_key"), "sample_key", 4, 1)


_U = sha_uniform("cast(sample_key AS varchar)", "'42'")


@query("w7_sample_n", f"SELECT sample_key FROM samples ORDER BY {_U}, sample_key LIMIT 500", "samples")
def w7(t):
    return P.sample_n(t.samples, "sample_key", 500).select("sample_key")


@query("w8_random_eval_set", f"""
SELECT sample_key FROM samples WHERE sample_key IN (SELECT sample_key FROM crops GROUP BY sample_key HAVING count(*) = 4)
ORDER BY {_U}, sample_key LIMIT 400""", "samples crops")
def w8(t):
    return P.random_eval_set(t.samples.select("sample_key"), t.crops, "sample_key", 400)


_B = "cast(floor(" + sha_uniform("cast(o_orderkey AS varchar)", "'43'") + " * 4096) AS bigint)"
_DRAW = sha_uniform("cast(draw AS varchar)", "'42'")


@query("w9_weighted_resample", f"""
WITH s AS (SELECT o_orderkey, coalesce(sum(o_totalprice) OVER (ORDER BY {_B}, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM orders WHERE o_totalprice > 0),
d AS (SELECT draw, {_DRAW} * (SELECT sum(o_totalprice) FROM orders) AS x FROM range((SELECT count(*) FROM orders)) AS r(draw))
SELECT draw, o_orderkey FROM d ASOF JOIN s ON d.x >= s.lo""")
def w9(t):
    """As many draws as orders, in proportion to price; rows are the drawn order keys."""
    o = t.read("orders").select("o_orderkey", "o_totalprice")
    return P.weighted_resample(o, "o_orderkey", "o_totalprice", o.count())


@query("w10_stratified", f"""
SELECT country_code, sample_key FROM (
  SELECT country_code, sample_key, row_number() OVER (PARTITION BY country_code ORDER BY {_U}, sample_key) AS rn
  FROM samples WHERE country_code IS NOT NULL) WHERE rn <= 40""", "samples")
def w10(t):
    rows = t.samples.where("country_code IS NOT NULL").select("country_code", "sample_key")
    return P.stratified(rows, "country_code", 40, "sample_key")


@query("l1_total_order", "SELECT DISTINCT country_code FROM samples WHERE country_code IS NOT NULL", "samples")
def l1(t):
    return t.samples.where("country_code IS NOT NULL").select("country_code").distinct().orderBy("country_code")


@query("l2_head_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def l2(t):
    rows = t.read("orders").select("o_orderkey", "o_totalprice")
    return O.head_n(rows.withColumn("neg", -F.col("o_totalprice")), 100, "neg", "o_orderkey").drop("neg")


@query("u1_union_distinct", "SELECT l_partkey * 2 AS k FROM lineitem UNION SELECT p_partkey FROM part")
def u1(t):
    a = t.read("lineitem").select((F.col("l_partkey") * 2).alias("k"))
    return a.union(t.read("part").select("p_partkey")).distinct()


@query("u4_set_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey * 2 FROM customer")
def u4(t):
    a = t.read("orders").select(F.col("o_custkey").alias("k")).distinct()
    b = t.read("customer").select((F.col("c_custkey") * 2).alias("k"))
    return a.join(b, "k", "left_anti")


@query("f2_prefix_and_seen", f"SELECT sample_key FROM samples WHERE NOT starts_with(pano_id, 'CAo') AND sample_key NOT IN ({_FILES})", "samples")
def f2(t):
    fresh = t.samples.where(~F.col("pano_id").startswith("CAo")).select("sample_key")
    return O.skip_known(fresh, _files(t), "sample_key")
