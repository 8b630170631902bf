"""DuckDB text of the derived views (the Spark side is in fixtures.py): name → (needs, text)."""

from __future__ import annotations


def hav(lat1: str, lng1: str, lat2: str, lng2: str, radius: str = "6371.0") -> str:
    """Great-circle distance as SQL."""
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lng2} - {lng1}) / 2), 2)")
    return f"2 * {radius} * asin(least(1.0, sqrt({a})))"


def tile(lat: str, lng: str, zoom: int) -> tuple[str, str]:
    """Slippy tile x and y as SQL."""
    n = float(2 ** zoom)
    return (f"cast(trunc(({lng} + 180.0) / 360.0 * {n}) AS bigint)",
            f"cast(trunc((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * {n}) AS bigint)")


U64 = "18446744073709551616.0"


def sha_uniform(key: str, salt: str) -> str:
    return (f"cast(cast(('0x' || substr(sha256(coalesce({salt}, '_unk') || ':' || {key}), 1, 16)) AS ubigint) "
            f"AS double) / {U64}")


VIEWS: dict[str, tuple[str, str]] = {}

VIEWS["samples"] = ("", """
SELECT CASE WHEN o_orderkey % 10 = 3 THEN concat('CAo', lpad(cast(o_orderkey AS varchar), 40, '0'))
            ELSE lpad(cast(o_orderkey AS varchar), 22, '0') END AS pano_id,
       o_orderkey AS sample_key, o_custkey AS cust_key,
       cast((o_custkey % 97 * 7919) % 120000 AS double) / 1000 - 60 + cast((o_orderkey * 31) % 1000 AS double) / 5000 - 0.1 AS lat,
       cast((o_custkey % 97 * 104729) % 340000 AS double) / 1000 - 170 + cast((o_orderkey * 17) % 1000 AS double) / 5000 - 0.1 AS lng,
       CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE n_name END AS country_code,
       CASE o_orderkey % 4 WHEN 0 THEN 1664 WHEN 1 THEN 6656 WHEN 2 THEN 8192 END AS height,
       CASE o_orderstatus WHEN 'F' THEN 'launch' WHEN 'P' THEN 'scout' END AS source,
       substr(cast(o_orderdate AS varchar), 1, 7) AS capture_month
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

VIEWS["split_samples"] = ("samples", f"""
SELECT *, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, {sha_uniform('pano_id', 'country_code')} AS u FROM samples)""")

VIEWS["s2_ij"] = ("split_samples", """
SELECT sample_key, f,
       cast(least(greatest(floor((CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END) * 1073741824), 0), 1073741823) AS bigint) AS i,
       cast(least(greatest(floor((CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END) * 1073741824), 0), 1073741823) AS bigint) AS j
FROM (SELECT *, CASE f WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
             CASE f WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v
      FROM (SELECT *, CASE WHEN abs(x) > abs(y) AND abs(x) > abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END
                           WHEN abs(x) <= abs(y) AND abs(y) > abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END
                           WHEN z < 0 THEN 5 ELSE 2 END AS f
            FROM (SELECT sample_key, cos(radians(lat)) * cos(radians(lng)) AS x, cos(radians(lat)) * sin(radians(lng)) AS y,
                         sin(radians(lat)) AS z FROM split_samples)))""")

VIEWS["s2_walk"] = ("s2_ij", """
SELECT sample_key, f, i, j, 29 AS k, f % 2 AS s, cast(0 AS ubigint) AS pos FROM s2_ij
UNION ALL
SELECT sample_key, f, i, j, k - 1, xor(s, [1, 0, 0, 3][p + 1]), pos * 4 + cast(p AS ubigint)
FROM (SELECT *, list_position([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]][s + 1], q) - 1 AS p
      FROM (SELECT *, cast((i >> k) & 1 AS integer) * 2 + cast((j >> k) & 1 AS integer) AS q FROM s2_walk WHERE k >= 0))""")


def _anc(level: int) -> str:
    lsb = 1 << 2 * (30 - level)
    return f"cast((leaf // {2 * lsb}) * cast({2 * lsb} AS hugeint) + {lsb} AS varchar)"


VIEWS["s2_samples"] = ("split_samples s2_walk", f"""
SELECT s.*, {_anc(3)} AS s2_l3, {_anc(6)} AS s2_l6, {_anc(9)} AS s2_l9, {_anc(12)} AS s2_l12
FROM split_samples s JOIN (SELECT sample_key, cast(f AS hugeint) * 2305843009213693952 + cast(pos AS hugeint) * 2 + 1 AS leaf
                           FROM s2_walk WHERE k = -1) USING (sample_key)""")

VIEWS["long_cells"] = ("s2_samples", """
SELECT sample_key, lat, lng, split, country_code, 3 AS level, s2_l3 AS cell FROM s2_samples
UNION ALL SELECT sample_key, lat, lng, split, country_code, 6, s2_l6 FROM s2_samples
UNION ALL SELECT sample_key, lat, lng, split, country_code, 9, s2_l9 FROM s2_samples
UNION ALL SELECT sample_key, lat, lng, split, country_code, 12, s2_l12 FROM s2_samples""")

VIEWS["cell_stats"] = ("long_cells", """
SELECT level, cell, count(*) AS n, avg(lat) AS centroid_lat, avg(lng) AS centroid_lng
FROM long_cells WHERE split = 'train' GROUP BY level, cell""")

VIEWS["vocab"] = ("cell_stats", """
SELECT level, cell, row_number() OVER (PARTITION BY level ORDER BY cell) - 1 AS idx, n, centroid_lat, centroid_lng
FROM cell_stats WHERE n >= CASE level WHEN 9 THEN 2 WHEN 12 THEN 5 ELSE 1 END""")

VIEWS["countries"] = ("split_samples", """
SELECT code, row_number() OVER (ORDER BY code) - 1 AS idx
FROM (SELECT DISTINCT country_code AS code FROM split_samples WHERE split = 'train' AND country_code IS NOT NULL)""")

VIEWS["crops"] = ("", """
SELECT DISTINCT l_orderkey AS sample_key, cast((l_linenumber - 1) % 4 * 90 AS bigint) AS heading FROM lineitem""")

VIEWS["timeline"] = ("", """
SELECT anchor_key, o_orderkey AS sibling_key
FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS anchor_key FROM orders)
WHERE o_orderkey <> anchor_key""")

VIEWS["coverage"] = ("", """
SELECT c_custkey AS point_id,
       cast((c_custkey % 97 * 7919) % 120000 AS double) / 1000 - 60 + cast((c_custkey * 13) % 1000 AS double) / 5000 - 0.1 AS lat,
       cast((c_custkey % 97 * 104729) % 340000 AS double) / 1000 - 170 + cast((c_custkey * 29) % 1000 AS double) / 5000 - 0.1 AS lng
FROM customer""")

VIEWS["boundaries"] = ("", """
SELECT n_name AS gid_0, n_nationkey % 3 AS layer, cast(n_nationkey AS bigint) AS ord,
       cast(n_nationkey % 5 * 68 - 170 AS double) AS x0, cast(floor(n_nationkey / 5.0) * 24 - 60 AS double) AS y0,
       cast(n_nationkey % 5 * 68 - 110 AS double) AS x1, cast(floor(n_nationkey / 5.0) * 24 - 40 AS double) AS y1,
       n_nationkey % 4 = 0 AS has_hole
FROM nation""")

VIEWS["edges"] = ("boundaries", """
SELECT gid_0, layer, ord, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_ FROM boundaries
UNION ALL SELECT gid_0, layer, ord, x1, y0, x1, y1 FROM boundaries
UNION ALL SELECT gid_0, layer, ord, x1, y1, x0, y1 FROM boundaries
UNION ALL SELECT gid_0, layer, ord, x0, y1, x0, y0 FROM boundaries
UNION ALL SELECT gid_0, layer, ord, x0 + 20, y0 + 5, x0 + 40, y0 + 5 FROM boundaries WHERE has_hole
UNION ALL SELECT gid_0, layer, ord, x0 + 40, y0 + 5, x0 + 30, y0 + 15 FROM boundaries WHERE has_hole
UNION ALL SELECT gid_0, layer, ord, x0 + 30, y0 + 15, x0 + 20, y0 + 5 FROM boundaries WHERE has_hole""")


def pip(points: str, key: str) -> str:
    """First polygon (by layer, order) strictly holding each point, by crossing number over all edges."""
    return f"""
SELECT {key}, arg_min(gid_0, layer * 1000000 + ord) AS gid_0, min(layer * 1000000 + ord) AS pos FROM (
  SELECT {key}, gid_0, layer, ord,
         sum(CASE WHEN (ay > p.lat) <> (by_ > p.lat) AND p.lng < (bx - ax) * (p.lat - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END) AS hits,
         max(CASE WHEN (bx - ax) * (p.lat - ay) = (by_ - ay) * (p.lng - ax) AND p.lng BETWEEN least(ax, bx) AND greatest(ax, bx)
                   AND p.lat BETWEEN least(ay, by_) AND greatest(ay, by_) THEN 1 ELSE 0 END) AS on_edge
  FROM {points} p JOIN edges e ON true GROUP BY {key}, gid_0, layer, ord)
WHERE hits % 2 = 1 AND on_edge = 0 GROUP BY {key}"""


VIEWS["sample_geo"] = ("samples edges", f"""
SELECT s.sample_key, g.gid_0, cast(g.pos // 1000000 AS bigint) AS layer
FROM samples s LEFT JOIN ({pip('samples', 'sample_key')}) g USING (sample_key)""")

VIEWS["raster"] = ("", """
SELECT cast(r AS bigint) AS row_idx, cast(c AS bigint) AS col_idx, cast((r * 7 + c * 3) % 31 AS bigint) AS value
FROM range(180) AS a(r) CROSS JOIN range(360) AS b(c)""")

VIEWS["moll"] = ("samples", """
SELECT sample_key, 2 * sqrt(2) / pi() * 6378137.0 * radians(lng) * cos(th) AS x, sqrt(2) * 6378137.0 * sin(th) AS y
FROM (SELECT sample_key, lng, list_reduce(list_prepend(radians(lat), list_transform(range(8), lambda i: radians(lat))),
             lambda th, phi: th - (2 * th + sin(2 * th) - pi() * sin(phi)) / (2 + 2 * cos(2 * th))) AS th FROM samples)""")

VIEWS["gazetteer"] = ("", """
SELECT lower(s_name) AS name, n_name AS country,
       cast((s_suppkey * 7919) % 120000 AS double) / 1000 - 60 AS lat,
       cast((s_suppkey * 104729) % 340000 AS double) / 1000 - 170 AS lng,
       cast((s_suppkey * 37) % 100 AS double) / 100 AS importance,
       CASE s_suppkey % 4 WHEN 0 THEN 'amenity=bank' WHEN 1 THEN 'place=city' WHEN 2 THEN 'boundary=administrative' ELSE 'highway=residential' END AS place_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")

# vectors: label is the level-9 cell; most of label 9 moves to cell 10, so cell 9 keeps two
VIEWS["vectors"] = ("", """
SELECT vec_id, l9, l9 // 2 AS l6, l9 // 4 AS l3, l9 * 4 + vec_id % 4 AS l12, e,
       l9 * 10 - 45 + cast((vec_id * 31) % 1000 AS double) / 10000 AS lat,
       l9 * 30 - 150 + cast((vec_id * 17) % 1000 AS double) / 10000 AS lng,
       concat('C', cast((l9 + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 6 AS varchar)) AS country
FROM (SELECT vec_id, cast(CASE WHEN label = 9 AND vec_id >= 15 THEN 10 ELSE label END AS bigint) AS l9,
             list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings)""")

VIEWS["probes"] = ("vectors", """
SELECT vec_id AS query_id, list_transform(range(1, len(e) + 1), lambda i: e[i] + 0.5 * e[(i + 15) % len(e) + 1]) AS q FROM vectors""")

VIEWS["label_long"] = ("vectors", """
SELECT vec_id AS query_id, 3 AS level, l3 AS idx, lat, lng, country FROM vectors
UNION ALL SELECT vec_id, 6, l6, lat, lng, country FROM vectors
UNION ALL SELECT vec_id, 9, l9, lat, lng, country FROM vectors
UNION ALL SELECT vec_id, 12, CASE WHEN l12 = 43 THEN -1 ELSE l12 END, lat, lng, country FROM vectors""")

VIEWS["cells"] = ("vectors", """
SELECT level, idx, count(*) AS n, avg(lat) AS centroid_lat, avg(lng) AS centroid_lng
FROM (SELECT 3 AS level, l3 AS idx, lat, lng FROM vectors UNION ALL SELECT 6, l6, lat, lng FROM vectors
      UNION ALL SELECT 9, l9, lat, lng FROM vectors UNION ALL SELECT 12, l12, lat, lng FROM vectors)
GROUP BY level, idx""")

VIEWS["tree"] = ("cells", """
SELECT idx AS l12, CASE WHEN idx = 43 THEN -1 ELSE idx // 4 END AS l9, idx // 8 AS l6, idx // 16 AS l3 FROM cells WHERE level = 12""")

VIEWS["pmap"] = ("cells tree", """
SELECT 12 AS child_level, l12 AS child_idx, 9 AS parent_level, l9 AS parent_idx FROM tree
UNION ALL SELECT 12, l12, 6, l6 FROM tree UNION ALL SELECT 12, l12, 3, l3 FROM tree
UNION ALL SELECT 9, idx, 6, idx // 2 FROM cells WHERE level = 9
UNION ALL SELECT 9, idx, 3, idx // 4 FROM cells WHERE level = 9
UNION ALL SELECT 6, idx, 3, idx // 2 FROM cells WHERE level = 6""")

VIEWS["scores"] = ("vectors cells", """
SELECT vec_id AS query_id, c.level, c.idx,
       cast((vec_id * 37 + c.level * 53 + c.idx * c.idx * 7 + c.idx) % 17 AS double) / 4 AS logit
FROM vectors JOIN cells c ON true""")

VIEWS["probs"] = ("scores", """
SELECT *, exp(logit - max(logit) OVER w) / z AS prob, logit - mx - ln(z) AS logp,
       row_number() OVER (PARTITION BY query_id, level ORDER BY logit DESC, idx) AS rnk
FROM (SELECT *, max(logit) OVER w AS mx, sum(exp(logit - mx0)) OVER w AS z
      FROM (SELECT *, max(logit) OVER w AS mx0 FROM scores WINDOW w AS (PARTITION BY query_id, level))
      WINDOW w AS (PARTITION BY query_id, level))
WINDOW w AS (PARTITION BY query_id, level)""")

VIEWS["country_dist"] = ("label_long", """
SELECT level, idx, country, n / sum(n) OVER (PARTITION BY level, idx) AS p
FROM (SELECT level, idx, country, count(*) AS n FROM label_long WHERE idx >= 0 GROUP BY level, idx, country)""")

VIEWS["posterior"] = ("probs country_dist", """
SELECT query_id, country, sum(prob * p) AS p FROM probs JOIN country_dist USING (level, idx) WHERE level = 6 GROUP BY query_id, country""")

# in-cell retrieval: every candidate cell's prototypes by cosine
VIEWS["unit_protos"] = ("vectors", """
SELECT vec_id, l9 AS cell_idx, lat, lng, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM vectors""")
VIEWS["unit_probes"] = ("probes", """
SELECT query_id, list_transform(q, lambda x: x / sqrt(list_sum(list_transform(q, lambda y: y * y)))) AS u FROM probes""")
VIEWS["sims"] = ("unit_protos unit_probes probs", """
SELECT query_id, cell_idx, vec_id, sim, lat, lng,
       row_number() OVER (PARTITION BY query_id, cell_idx ORDER BY sim DESC, vec_id) AS rn,
       count(*) OVER (PARTITION BY query_id, cell_idx) AS n_prototypes
FROM (SELECT q.query_id, p.cell_idx, p.vec_id, list_dot_product(q.u, p.u) AS sim, p.lat, p.lng
      FROM unit_probes q JOIN unit_protos p ON true)""")
VIEWS["refined"] = ("sims", """
SELECT query_id, cell_idx, sum(w * lat) / sum(w) AS lat, sum(w * lng) / sum(w) AS lng, max(n_prototypes) AS n_prototypes,
       count(*) AS n_used, max(sim) AS top_similarity
FROM (SELECT *, exp((sim - max(sim) OVER (PARTITION BY query_id, cell_idx)) / 0.1) AS w
      FROM sims WHERE n_prototypes >= 3 AND rn <= 5)
GROUP BY query_id, cell_idx""")
VIEWS["selected"] = ("refined probs", """
SELECT query_id, cell_idx, lat, lng, top_similarity, rnk FROM (
  SELECT r.*, p.rnk, row_number() OVER (PARTITION BY r.query_id ORDER BY r.top_similarity DESC, p.rnk) AS pick
  FROM refined r JOIN probs p ON p.query_id = r.query_id AND p.level = 9 AND p.idx = r.cell_idx WHERE p.rnk <= 5)
WHERE pick = 1""")

VIEWS["ocr_lines"] = ("", r"""
SELECT doc_id, cast(pos - 1 AS bigint) AS pos, cast((pos - 1) % 8 AS bigint) AS tile, line AS text,
       cast((doc_id * 13 + (pos - 1) * 7) % 100 AS double) / 100 AS confidence
FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")

VIEWS["guides"] = ("", """
SELECT doc_id, concat('doc', cast(doc_id AS varchar)) AS stem,
       CASE WHEN doc_id % 50 = 7 THEN text
            ELSE concat('---', chr(10), CASE WHEN doc_id % 9 = 4 THEN '' ELSE concat('country_code: ', source, lang, chr(10)) END,
                        'country_name: Land of ', lang, chr(10), 'driving_side: ', CASE WHEN doc_id % 3 = 0 THEN 'left' ELSE 'right' END, chr(10),
                        'languages: [', lang, ', Other]', chr(10), 'scripts: [Latin, Thai]', chr(10), 'source: corpus', chr(10),
                        'last_updated: 2026-01-', lpad(cast(doc_id % 28 + 1 AS varchar), 2, '0'), chr(10), '---', chr(10),
                        'dropped intro', chr(10), '## General Clues', chr(10), text, chr(10), '## spotlight', chr(10),
                        CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END, chr(10), '## general clues', chr(10),
                        CASE WHEN doc_id % 7 = 0 THEN concat('again ', lang) ELSE ' ' END, chr(10)) END AS raw
FROM documents""")

VIEWS["progress"] = ("", """
SELECT cast(floor(event_id / 12.0) AS bigint) AS request_id, ts, event_id,
       CASE event_id % 12 WHEN 0 THEN 'fetch_pano_start' WHEN 1 THEN 'fetch_pano_done' WHEN 2 THEN 'stage1_start'
            WHEN 3 THEN 'stage1_done' WHEN 4 THEN 'stage2_extract_start' WHEN 5 THEN 'stage2_extract_done'
            WHEN 6 THEN 'stage2_pinpoint_start' WHEN 7 THEN 'stage2_pinpoint_done' WHEN 8 THEN 'stage2_geocode_start' WHEN 9 THEN 'stage2_geocode_done'
            WHEN 10 THEN 'heartbeat' ELSE CASE WHEN event_id % 132 = 11 THEN 'heartbeat' WHEN event_type = 'error' THEN 'error' ELSE 'done' END END AS event,
       props AS data
FROM events""")

VIEWS["answers"] = ("", """
SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn,
       CASE turn % 4
         WHEN 0 THEN concat('{"queryable_name":"supplier#', lpad(cast(conv_id % 100 AS varchar), 9, '0'), '","alternate_queries":["a","supplier#', lpad(cast(turn % 10 AS varchar), 9, '0'), '","c"],"refined_lat":1.5,"refined_lng":null,"precision_level":"Street","confidence":0.8,"confirmed_country":"Japan","reasoning":"r"}')
         WHEN 1 THEN concat('thinking ', repeat(chr(96), 3), 'json {"queryable_name":"x","precision_level":"city","confidence":0.9} ', repeat(chr(96), 3))
         WHEN 2 THEN '{"precision_level": broken}'
         ELSE concat('no answer ', text) END AS raw
FROM conversations""")
