"""Queries over events and pixels: projections, joins, samples, aggregations, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import expressions as X
from shardloom.operators import augment, metrics, neighbors, relational, sampling
from shardloom.plans import standins as S
from shardloom.plans.standins import EVENTS, PIXELS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {PIXELS} SELECT event_idx, channel - 800 AS channel, tick, CAST(charge AS FLOAT) AS charge FROM px WHERE channel >= 800 AND channel < 1600")
def view_filter(spark, d):
    low, high = X.view_range("v")
    return S.pixels(spark, d).where((F.col("channel") >= low) & (F.col("channel") < high)).select("event_idx", (F.col("channel") - low).alias("channel"), "tick", F.col("charge").cast("float").alias("charge"))


@query(f"""WITH {EVENTS}, c AS (SELECT event_idx, CASE WHEN nu_ccnc = 1 THEN 2 WHEN abs(nu_pdg) = 14 AND nu_ccnc = 0 THEN 0 WHEN abs(nu_pdg) = 12 AND nu_ccnc = 0 THEN 1 ELSE -1 END AS label FROM ev)
SELECT event_idx, label, CASE label WHEN 0 THEN 'numuCC' WHEN 1 THEN 'nueCC' WHEN 2 THEN 'NC' ELSE CAST(label AS VARCHAR) END AS flavour FROM c""")
def classify_events(spark, d):
    rows = S.events(spark, d).select("event_idx", X.event_class(F.col("nu_pdg"), F.col("nu_ccnc")).alias("label"))
    return rows.withColumn("flavour", X.code_name(F.col("label"), X.FLAVOURS))


@query(f"""WITH {EVENTS}, t AS (SELECT * FROM ev WHERE nu_energy > 200000)
SELECT ev.event_key, coalesce(t.nu_pdg, 0) AS nu_pdg, coalesce(t.nu_ccnc, -1) AS nu_ccnc, coalesce(t.nu_energy, 0.0) AS nu_energy FROM ev LEFT JOIN t USING (event_key)""")
def event_truth_default(spark, d):
    from shardloom.sources.tables import with_unknown

    ev = S.events(spark, d)
    return with_unknown(ev.select("event_key"), ev.where("nu_energy > 200000").select("event_key", "nu_pdg", "nu_ccnc", "nu_energy"))


@query(f"""WITH {PIXELS} SELECT pixel_idx, line, round(log10(1 + greatest(charge, 0)), 9) AS plain,
  round(2 * (log10(greatest(charge, 0) + 1) - log10(1)) / (log10(1 + 60000) - log10(1)) - 1, 9) AS trained FROM px""")
def charge_transform(spark, d):
    q = F.col("charge")
    return S.pixels(spark, d).select("pixel_idx", "line", F.round(X.log_charge(q), 9).alias("plain"), F.round(X.log_charge(q, 1.0, 60000.0), 9).alias("trained"))


@query(f"""WITH {PIXELS} SELECT pixel_idx, line, label <> 0 AS truth, CASE WHEN label <> 0 THEN round(least(greatest(1 - energyfrac, 0), 1), 9) ELSE 0 END AS contamination,
  abs(trackid) AS instance, label <> 0 AND trackid <> 0 AS has_instance, label - 1 AS class FROM px""")
def pixel_truth_masks(spark, d):
    lab, tr = F.col("label"), F.col("trackid")
    return S.pixels(spark, d).select("pixel_idx", "line", (lab != 0).alias("truth"), F.round(X.contamination(lab, F.col("energyfrac")), 9).alias("contamination"),
                                     F.abs(tr).alias("instance"), X.has_instance(lab, tr).alias("has_instance"), (lab - 1).alias("class"))


@query(f"""WITH {PIXELS}, t AS (SELECT event_idx, channel, tick, max_by(l_tax * 100 + 0.5, l_linenumber) AS v FROM (SELECT l_orderkey AS event_idx, l_partkey AS channel, l_suppkey AS tick, l_tax, l_linenumber FROM lineitem WHERE l_returnflag <> 'A') GROUP BY ALL)
SELECT px.pixel_idx, px.line, CAST(coalesce(round_even(t.v, 0), 0) AS INTEGER) AS truth FROM px LEFT JOIN t USING (event_idx, channel, tick)""".replace("GROUP BY ALL", "GROUP BY event_idx, channel, tick"))
def truth_join(spark, d):
    raw = S.table(spark, d, "lineitem").where("l_returnflag <> 'A'").selectExpr("l_orderkey AS event_idx", "l_partkey AS channel", "l_suppkey AS tick", "l_tax * 100 + 0.5 AS truth", "l_linenumber")
    return relational.truth_join(S.pixels(spark, d), raw, ["event_idx", "channel", "tick"], {"truth": "int"}, [F.col("l_linenumber")]).select("pixel_idx", "line", "truth")


@query(f"""WITH {PIXELS}, t AS (SELECT k, max_by(v, p) AS v FROM (SELECT s_suppkey AS k, s_nationkey + 1 AS v, 0 AS p FROM supplier UNION ALL SELECT s_suppkey - 40 AS k, 100 + s_nationkey AS v, 1 AS p FROM supplier WHERE s_suppkey < 60) GROUP BY k)
SELECT px.pixel_idx, px.line, CASE WHEN trackid = 0 THEN 0 ELSE coalesce(a.v, b.v, 0) END AS pdg FROM px LEFT JOIN t a ON px.trackid = a.k LEFT JOIN t b ON abs(px.trackid) = b.k""")
def pdg_lookup(spark, d):
    s = S.table(spark, d, "supplier")
    low = s.selectExpr("s_suppkey AS k", "s_nationkey + 1 AS v")
    high = s.where("s_suppkey < 60").selectExpr("s_suppkey - 40 AS k", "100 + s_nationkey AS v")
    return relational.lookup_with_fallback(S.pixels(spark, d), "trackid", high, low, "k", "v", "pdg").select("pixel_idx", "line", "pdg")


@query(f"""WITH {PIXELS}, s AS (SELECT DISTINCT event_idx, channel // 4 AS x, tick // 4 AS y FROM px), t AS (SELECT event_idx, channel // 4 AS x, tick // 4 AS y, max(charge) AS q FROM px WHERE label > 2 GROUP BY 1, 2, 3),
m AS (SELECT DISTINCT event_idx, channel // 4 AS x, tick // 4 AS y FROM px WHERE label = 3)
SELECT s.event_idx, s.x, s.y, t.q, m.x IS NOT NULL AS is_marked FROM s JOIN t USING (event_idx, x, y) LEFT JOIN m ON m.event_idx = s.event_idx AND m.x = s.x AND m.y = s.y""")
def match_rows(spark, d):
    keys = ["event_idx", "x", "y"]
    px = relational.floored(S.pixels(spark, d).withColumnsRenamed({"channel": "x", "tick": "y"}), ["x", "y"], 4)
    right = px.where("label > 2").groupBy(*keys).agg(F.max("charge").alias("q"))
    return relational.match_rows(px.select(*keys).distinct(), right, keys, px.where("label = 3"))


@query(f"""WITH {PIXELS}, c AS (SELECT event_idx, channel // 8 AS x, tick // 8 AS y, min(charge) AS q FROM px GROUP BY 1, 2, 3)
SELECT px.pixel_idx, px.line, c.q FROM px JOIN c ON c.event_idx = px.event_idx AND c.x = px.channel // 8 AND c.y = px.tick // 8""")
def upcast_to_parent(spark, d):
    px = S.pixels(spark, d).withColumnsRenamed({"channel": "x", "tick": "y"})
    coarse = relational.floored(px, ["x", "y"], 8).groupBy("event_idx", "x", "y").agg(F.min("charge").alias("q"))
    return relational.upcast(px, coarse, ["event_idx"], ["x", "y"], 8, "q").select("pixel_idx", "line", "q")


@query(f"""WITH {PIXELS} SELECT event_idx, channel // 4 AS x, tick // 4 AS y FROM px WHERE label > 3 EXCEPT SELECT event_idx, channel // 4, tick // 4 FROM px WHERE label <= 1""")
def new_cells(spark, d):
    px = S.pixels(spark, d).withColumnsRenamed({"channel": "x", "tick": "y"})
    skip = relational.floored(px.where("label <= 1"), ["x", "y"], 4).select("event_idx", "x", "y").distinct()
    return relational.new_cells(px.where("label > 3"), skip, ["event_idx"], ["x", "y"], 4)


@query(f"""WITH {PIXELS} SELECT event_idx, channel, count(DISTINCT label) AS roles FROM px GROUP BY 1, 2 HAVING count(DISTINCT label) > 1""")
def role_collisions(spark, d):
    return relational.collisions(S.pixels(spark, d), ["event_idx", "channel"], "label")


@query(f"""WITH {PIXELS}, b AS (SELECT DISTINCT event_idx, channel FROM px WHERE label < 2), r AS (SELECT event_idx, channel, min(label) AS label FROM px WHERE label >= 2 GROUP BY 1, 2 HAVING count(DISTINCT label) = 1)
SELECT event_idx, channel, 'base' AS role FROM b UNION ALL SELECT event_idx, channel, CAST(label AS VARCHAR) FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.event_idx = r.event_idx AND b.channel = r.channel)""")
def inject_rows(spark, d):
    px = S.pixels(spark, d)
    asked = px.where("label >= 2").select("event_idx", "channel", F.col("label").cast("string").alias("role"))
    sound = asked.join(relational.collisions(asked, ["event_idx", "channel"], "role"), ["event_idx", "channel"], "left_anti")
    return relational.inject(px.where("label < 2").select("event_idx", "channel").distinct(), sound, ["event_idx", "channel"], "role")


@query(f"""WITH {PIXELS}, g AS (SELECT DISTINCT event_idx, channel // 16 AS x, tick // 16 AS y FROM px), c AS (SELECT DISTINCT event_idx, channel // 16 AS x, tick // 16 AS y FROM px WHERE energyfrac > 0.8)
SELECT g.*, c.x IS NOT NULL AS occupied FROM g LEFT JOIN c ON c.event_idx = g.event_idx AND c.x = g.x AND c.y = g.y""")
def occupied_cells(spark, d):
    px = S.pixels(spark, d).withColumnsRenamed({"channel": "x", "tick": "y"})
    cells = relational.floored(px, ["x", "y"], 16).select("event_idx", "x", "y").distinct()
    return relational.occupied(cells, px.where("energyfrac > 0.8"), ["event_idx"], ["x", "y"], 16)


@query(f"""WITH {PIXELS} SELECT event_idx, count(*) AS n FROM (SELECT event_idx FROM px WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = px.tick AND s_acctbal > 0)) GROUP BY 1""")
def gather_misses(spark, d):
    rows = S.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("tick"))
    return relational.misses(S.pixels(spark, d), rows, ["tick"]).groupBy("event_idx").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS key, CAST((n_regionkey * n_nationkey) % 5 AS VARCHAR) AS v FROM nation WHERE n_nationkey > 4)
SELECT key, coalesce(a.v, '<absent>') AS "left", coalesce(b.v, '<absent>') AS "right" FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v""")
def full_difference(spark, d):
    n = S.table(spark, d, "nation")
    a = n.where("n_nationkey < 20").selectExpr("n_name AS key", "cast(n_regionkey AS string) AS v")
    b = n.where("n_nationkey > 4").selectExpr("n_name AS key", "cast((n_regionkey * n_nationkey) % 5 AS string) AS v")
    return relational.full_difference(a, b, "key", "v")


@query(f"""WITH {EVENTS}, {PIXELS}, v AS (SELECT event_idx, CAST(floor(nu_energy) AS BIGINT) % 2000 AS vc, (nu_energy % 97) * 1.0 AS vt FROM ev), k AS (SELECT row_number() OVER () AS k, * FROM px)
SELECT any_value(pixel_idx) AS pixel_idx, any_value(line) AS line, round(least(coalesce(min(sqrt((channel - vc) * (channel - vc) + (tick - round_even(vt, 0)) * (tick - round_even(vt, 0)))), 200), 200), 6) AS distance
FROM k LEFT JOIN v USING (event_idx) GROUP BY k""")
def vertex_distance(spark, d):
    v = S.events(spark, d).selectExpr("event_idx", "cast(floor(nu_energy) AS bigint) % 2000 AS v_channel", "(nu_energy % 97) * 1.0 AS v_tick")
    return relational.vertex_distance(S.pixels(spark, d), v).select("pixel_idx", "line", F.round("distance", 6).alias("distance"))


@query("""WITH seg AS (SELECT n_nationkey AS pos, n_nationkey * 300.0 AS ay, n_regionkey * 1000.0 AS az, n_nationkey * 280.0 + 500 AS by_, n_regionkey * 900.0 + 2000 AS bz FROM nation),
p AS (SELECT c_custkey AS id, c_acctbal AS y, c_nationkey * 250.0 AS z FROM customer),
t AS (SELECT id, pos, y, z, ay, az, by_, bz, least(greatest(coalesce(((y - ay) * (by_ - ay) + (z - az) * (bz - az)) / nullif((by_ - ay) * (by_ - ay) + (bz - az) * (bz - az), 0), 0), 0), 1) AS t FROM p, seg),
r AS (SELECT id, pos, round((y - (ay + t * (by_ - ay))) * (y - (ay + t * (by_ - ay))) + (z - (az + t * (bz - az))) * (z - (az + t * (bz - az))), 4) AS d2 FROM t)
SELECT id, pos AS channel, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, pos) AS n FROM r) WHERE n = 1""")
def nearest_segment(spark, d):
    seg = S.table(spark, d, "nation").selectExpr("n_nationkey AS pos", "n_nationkey AS channel", "n_nationkey * 300.0d AS ay", "n_regionkey * 1000.0d AS az", "n_nationkey * 280.0d + 500 AS by", "n_regionkey * 900.0d + 2000 AS bz")
    pts = S.table(spark, d, "customer").selectExpr("c_custkey AS id", "c_acctbal AS y", "c_nationkey * 250.0d AS z")
    return relational.nearest(pts, seg, ["id"], "y", "z", "pos", "channel").select("id", "channel", F.round("d2", 4).alias("d2"))


@query(f"""WITH {EVENTS}, v AS (SELECT event_idx, view, view = 0 AS is_global, view = 2 AS injected, view % 2 = 0 AS masked, 3 AS n_views FROM ev, (VALUES (0), (1), (2)) t(view))
SELECT a.event_idx, a.view AS student, b.view AS teacher FROM v a JOIN v b USING (event_idx) WHERE b.is_global AND (a.view <> b.view OR (a.injected AND a.masked) OR a.n_views = 1)""")
def view_pairs(spark, d):
    views = S.events(spark, d).select("event_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("view"))
    return relational.view_pairs(views.selectExpr("*", "view = 0 AS is_global", "view = 2 AS injected", "view % 2 = 0 AS masked", "3 AS n_views"))


@query(f"""WITH {PIXELS}, q AS (SELECT event_idx, channel AS x, tick AS y, min(pixel_idx) AS id FROM px GROUP BY 1, 2, 3)
SELECT a.event_idx, a.id AS query, b.id AS neighbour, row_number() OVER (PARTITION BY a.event_idx, a.id ORDER BY b.id) - 1 AS slot FROM q a JOIN q b ON a.event_idx = b.event_idx
  AND CAST(a.x - b.x AS FLOAT) * CAST(a.x - b.x AS FLOAT) + CAST(a.y - b.y AS FLOAT) * CAST(a.y - b.y AS FLOAT) < CAST(14400 AS FLOAT)""")
def ball_query(spark, d):
    q = S.pixels(spark, d).groupBy("event_idx", F.col("channel").alias("x"), F.col("tick").alias("y")).agg(F.min("pixel_idx").alias("id"))
    return neighbors.ball(q, q, 120.0, ["event_idx"])


@query(f"""WITH {PIXELS}, q AS (SELECT event_idx, channel AS x, tick AS y, min(pixel_idx) AS id, min(label) AS l FROM px GROUP BY 1, 2, 3), a AS (SELECT * FROM q WHERE l < 3), b AS (SELECT * FROM q WHERE l >= 3),
o AS (SELECT event_idx, avg(m) AS m FROM (SELECT a.event_idx, a.id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS m FROM a JOIN b USING (event_idx) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT event_idx, avg(m) AS m FROM (SELECT b.event_idx, b.id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS m FROM b JOIN a USING (event_idx) GROUP BY 1, 2) GROUP BY 1)
SELECT round(avg(o.m + p.m), 6) AS chamfer FROM o JOIN p USING (event_idx)""")
def chamfer(spark, d):
    q = S.pixels(spark, d).groupBy("event_idx", F.col("channel").alias("x"), F.col("tick").alias("y")).agg(F.min("pixel_idx").alias("id"), F.min("label").alias("l"))
    return neighbors.chamfer(q.where("l < 3"), q.where("l >= 3")).select(F.round("chamfer", 6).alias("chamfer"))


@query(f"""WITH {PIXELS}, c AS (SELECT event_idx, count(*) AS n FROM px GROUP BY 1) SELECT event_idx, n, CAST(sum(n) OVER (ORDER BY event_idx) AS BIGINT) AS stop, CAST(sum(n) OVER (ORDER BY event_idx) - n AS BIGINT) AS start FROM c""")
def offsets(spark, d):
    counts = S.pixels(spark, d).groupBy("event_idx").agg(F.count(F.lit(1)).alias("n"))
    return metrics.offsets(counts, "event_idx")


@query("SELECT sha256(CASE WHEN count(url) > 0 THEN string_agg(url, chr(10) ORDER BY url) || chr(10) ELSE '' END) AS digest, count(url) AS n FROM pages")
def key_digest(spark, d):
    return metrics.key_digest(S.table(spark, d, "pages"), "url")


_H = "md5('7:' || event_idx)"


@query(f"""WITH {EVENTS}, r AS (SELECT event_idx, row_number() OVER (ORDER BY {_H}, event_idx) AS r, count(*) OVER () AS n FROM ev) SELECT event_idx, r <= floor(0.8 * n) AS is_train FROM r""")
def event_split(spark, d):
    return sampling.event_split(S.events(spark, d), 7, 0.8)


@query(f"""WITH {EVENTS}, {PIXELS}, r AS (SELECT event_idx, row_number() OVER (ORDER BY {_H}, event_idx) AS r, count(*) OVER () AS n FROM ev)
SELECT r <= floor(0.8 * n) AS is_train, count(*) AS n FROM px JOIN r USING (event_idx) GROUP BY 1""")
def pixel_split(spark, d):
    return S.pixels(spark, d).join(sampling.event_split(S.events(spark, d), 7, 0.8), "event_idx").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 100""")
def balanced_pool(spark, d):
    return sampling.per_group(S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], 100, 42, "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5('43:' || o_orderkey), o_orderkey LIMIT 500")
def natural_pool(spark, d):
    return sampling.lowest(S.table(spark, d, "orders").select("o_orderkey"), 500, 43, "o_orderkey")


@query(f"""WITH {PIXELS} SELECT event_idx, pixel_idx, line FROM (SELECT *, row_number() OVER (PARTITION BY event_idx ORDER BY md5('5:' || pixel_idx || ':' || line), pixel_idx, line) AS r FROM px) WHERE r <= 3""")
def event_sample(spark, d):
    return sampling.per_event(S.pixels(spark, d), ["event_idx"], 3, 5, "pixel_idx", "line").select("event_idx", "pixel_idx", "line")


@query(f"""WITH {PIXELS}, c AS (SELECT *, row_number() OVER (PARTITION BY event_idx, label ORDER BY md5('9:' || pixel_idx), pixel_idx, line) AS r FROM px WHERE label > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('9:' || event_idx), event_idx, md5('9:' || pixel_idx), pixel_idx, line) AS k FROM c WHERE r <= 1) SELECT label, event_idx, pixel_idx FROM q WHERE k <= 200""")
def quota_pool(spark, d):
    return sampling.quota_pool(S.pixels(spark, d), 200, sampling.image_cap(200, 15000), 9, "pixel_idx").select("label", "event_idx", "pixel_idx")


@query(f"""WITH {EVENTS}, a AS (SELECT event_idx AS pixel_idx FROM ev ORDER BY md5('1:' || event_idx), event_idx LIMIT 300), b AS (SELECT event_idx AS pixel_idx FROM ev ORDER BY md5('2:' || event_idx), event_idx LIMIT 300)
SELECT pixel_idx, row_number() OVER (ORDER BY pixel_idx) - 1 AS row_idx FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def row_space(spark, d):
    ev = S.events(spark, d).select("event_idx")
    pools = sampling.lowest(ev, 300, 1, "event_idx").unionByName(sampling.lowest(ev, 300, 2, "event_idx")).withColumnRenamed("event_idx", "pixel_idx")
    return sampling.row_space(pools).select("pixel_idx", "row_idx")


@query(f"""WITH {EVENTS}, r AS (SELECT event_key, row_number() OVER (ORDER BY md5('3:' || event_key), event_key) - 1 AS r FROM ev) SELECT event_key, r // 4000 AS shard, r % 4000 AS pos FROM r""")
def exact_shards(spark, d):
    return sampling.exact_shards(S.events(spark, d), 4000, 3).select("event_key", "shard", "pos")


@query("""WITH o AS (SELECT n_nationkey AS shard, row_number() OVER (ORDER BY md5('12:' || n_nationkey), n_nationkey) - 1 AS p, count(*) OVER () AS n FROM nation)
SELECT ((p - 1 * CAST(ceil(n / 3.0) AS BIGINT)) % n + n) % n AS turn, shard FROM o WHERE ((p - 1 * CAST(ceil(n / 3.0) AS BIGINT)) % n + n) % n < ceil(n / 3.0)""")
def epoch_shards(spark, d):
    return sampling.epoch_shards(S.table(spark, d, "nation").select(F.col("n_nationkey").alias("shard")), 5, 3, 11)


@query("""WITH o AS (SELECT n_nationkey AS shard, row_number() OVER (ORDER BY md5('12:' || n_nationkey), n_nationkey) - 1 AS p, count(*) OVER () AS n FROM nation),
a AS (SELECT shard, p FROM o UNION ALL SELECT shard, p + n FROM o WHERE p < 4 * CAST(ceil(n / 4.0) AS BIGINT) - n) SELECT p % 4 AS reader, p // 4 AS turn, shard FROM a""")
def reader_shards(spark, d):
    return sampling.reader_shards(S.table(spark, d, "nation").select(F.col("n_nationkey").alias("shard")), 4, 1, 11)


@query("""WITH b AS (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 8 AS batch_id FROM customer)
SELECT c_nationkey, c_custkey, batch_id FROM b QUALIFY count(*) OVER (PARTITION BY c_nationkey, batch_id) = 8""")
def batches(spark, d):
    return sampling.batches(S.table(spark, d, "customer").select("c_nationkey", "c_custkey"), 8, [F.col("c_custkey")], ["c_nationkey"])


@query(f"""WITH {PIXELS}, r AS (SELECT *, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_idx) AS p, row_number() OVER (PARTITION BY event_idx, label = 1 ORDER BY md5('4:' || pixel_idx), pixel_idx) AS r FROM px)
SELECT event_idx, pixel_idx, line, label = 1 AS positive FROM r WHERE label = 1 OR r <= least(round_even(p * 1.5, 0), 4)""")
def cap_negatives(spark, d):
    pos = F.col("label") == 1
    return sampling.cap_negatives(S.pixels(spark, d), "event_idx", pos, 4, "pixel_idx", 1.5, 4).select("event_idx", "pixel_idx", "line", pos.alias("positive"))


@query(f"""WITH {PIXELS}, r AS (SELECT event_idx, pixel_idx, count(*) OVER (PARTITION BY event_idx) AS n, row_number() OVER (PARTITION BY event_idx ORDER BY md5('6:' || pixel_idx), pixel_idx) AS r FROM px)
SELECT event_idx, pixel_idx, r <= least(floor(n * 0.6), n - 1) AS masked FROM r""")
def random_mask(spark, d):
    return sampling.random_mask(S.pixels(spark, d).select("event_idx", "pixel_idx"), "event_idx", 0.6, 6, "pixel_idx", keep_one=True)


@query(f"""WITH {PIXELS}, r AS (SELECT event_idx, pixel_idx, row_number() OVER (PARTITION BY event_idx ORDER BY md5('8:' || pixel_idx), pixel_idx) AS r FROM px WHERE charge > 20000)
SELECT event_idx, pixel_idx, row_number() OVER (PARTITION BY event_idx ORDER BY pixel_idx) - 1 AS slot FROM r WHERE r <= 2""")
def thin_points(spark, d):
    return sampling.thin(S.pixels(spark, d), "event_idx", F.col("charge") > 20000, 2, 8, "pixel_idx").select("event_idx", "pixel_idx", "slot")


@query(f"""WITH RECURSIVE {PIXELS}, o(i) AS (VALUES (-1), (0), (1)), c0 AS (SELECT DISTINCT event_idx, channel // 16 AS x, tick // 16 AS y FROM px),
c1 AS (SELECT DISTINCT event_idx, greatest(x * 2 + a.i, 0) AS x, greatest(y * 2 + b.i, 0) AS y FROM c0, o a, o b), c2 AS (SELECT DISTINCT event_idx, greatest(x + a.i, 0) AS x, greatest(y + b.i, 0) AS y FROM c1, o a, o b)
SELECT event_idx, count(*) AS n, CAST(sum(x * 31 + y) AS BIGINT) AS s FROM c2 GROUP BY 1""")
def grow_candidates(spark, d):
    cells = augment.grow(S.pixels(spark, d).withColumnsRenamed({"channel": "x", "tick": "y"}), 16, 8, 2)
    return cells.groupBy("event_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 31 + F.col("y")).alias("s"))


@query(f"""WITH {PIXELS} SELECT event_idx, count(DISTINCT (channel // 4, tick // 4)) AS n FROM px GROUP BY 1""")
def strided_counts(spark, d):
    return S.pixels(spark, d).groupBy("event_idx").agg(F.count_distinct(F.floor(F.col("channel") / 4), F.floor(F.col("tick") / 4)).alias("n"))


@query(f"""WITH {PIXELS}, c AS (SELECT event_idx, channel // 200 AS cx, tick // 20 AS cy, count(*) AS n FROM px GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY event_idx) AS total, sum(n) OVER (PARTITION BY event_idx ORDER BY md5('2:' || event_idx || ':' || cx || ':' || cy), cx, cy) AS s, row_number() OVER (PARTITION BY event_idx ORDER BY md5('2:' || event_idx || ':' || cx || ':' || cy), cx, cy) AS r FROM c),
j AS (SELECT px.*, cx, cy, total, (s <= total * 0.5 OR r = 1) AS taken FROM px JOIN t ON t.event_idx = px.event_idx AND t.cx = px.channel // 200 AND t.cy = px.tick // 20),
k AS (SELECT *, row_number() OVER (PARTITION BY event_idx, taken ORDER BY md5('3:' || pixel_idx), pixel_idx) AS rk, sum(CASE WHEN taken THEN 1 ELSE 0 END) OVER (PARTITION BY event_idx) AS nt FROM j),
m AS (SELECT *, taken AND rk > greatest(nt - floor(total * 0.5), 0) AS masked FROM k)
SELECT event_idx, pixel_idx, masked, taken AND bool_and(masked) OVER (PARTITION BY event_idx, cx, cy) AS dense FROM m""")
def wipe_cells(spark, d):
    return augment.wipe_cells(S.pixels(spark, d).withColumnsRenamed({"channel": "x", "tick": "y"}), 200, 20, 0.5, 2, "pixel_idx").select("event_idx", "pixel_idx", "masked", "dense")


@query(f"""WITH {PIXELS}, c AS (SELECT DISTINCT channel // 4 AS cx, tick // 4 AS cy FROM px) SELECT cx * 4 + a.i AS x, cy * 4 + b.i AS y FROM c, range(4) a(i), range(4) b(i)""")
def densify_cells(spark, d):
    cells = S.pixels(spark, d).select(F.floor(F.col("channel") / 4).alias("cx"), F.floor(F.col("tick") / 4).alias("cy")).distinct()
    return augment.densify(cells, 4, 4)


@query(f"""WITH {PIXELS}, {EVENTS}, b AS (SELECT event_idx, least(greatest(CAST(round_even(nu_energy % 2000 - 400 / 2.0, 0) AS BIGINT), 0), 2000 - 400) AS l FROM ev) SELECT px.event_idx, px.pixel_idx FROM px JOIN b USING (event_idx) WHERE channel >= l AND channel < l + 400""")
def crop_box(spark, d):
    box = S.events(spark, d).select("event_idx", X.clamped_box(F.col("nu_energy") % 2000, F.lit(0.0), F.lit(400), F.lit(100), 2000, 100)[0].alias("l"))
    inside = X.in_box(F.col("channel"), F.lit(0), F.col("l"), F.lit(0), F.lit(400), F.lit(100))
    return S.pixels(spark, d).join(box, "event_idx").where(inside).select("event_idx", "pixel_idx")


# A row's block of the least rank is found once; then only shares, counts and K go from event to event of a batch.
@query(f"""WITH RECURSIVE {PIXELS}, q AS (SELECT event_idx, pixel_idx AS id, min(channel) AS x, min(tick) AS y FROM px GROUP BY 1, 2),
o AS (SELECT *, event_idx % 64 AS batch, row_number() OVER (PARTITION BY event_idx ORDER BY md5('1:' || event_idx || ':' || id), id) AS r, count(*) OVER (PARTITION BY event_idx) AS n FROM q),
m AS (SELECT a.event_idx, a.id, a.r, a.n, a.batch, min(b.r) AS least FROM o a JOIN o b ON a.event_idx = b.event_idx AND abs(a.x - b.x) <= 200 AND abs(a.y - b.y) <= 20 GROUP BY 1, 2, 3, 4, 5),
ks AS (SELECT event_idx, k, count(*) FILTER (WHERE least <= k) AS masked, count(*) AS n FROM m, (SELECT unnest(range(1, 20)) AS k) WHERE k < n GROUP BY 1, 2),
ev AS (SELECT event_idx, batch, max(n) AS n, row_number() OVER (PARTITION BY batch ORDER BY event_idx) AS pos FROM o GROUP BY 1, 2),
w(batch, pos, share, event_idx, k) AS (SELECT DISTINCT batch, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM ev UNION ALL
 SELECT batch, pos, CASE WHEN seen IS NULL THEN share WHEN share IS NULL THEN seen ELSE 0.9 * share + 0.1 * seen END, event_idx, k FROM (
  SELECT s.*, CASE WHEN s.k > 0 AND ks.masked > 0 THEN 1 - power(1 - least(ks.masked, ks.n - 1) / ks.n::DOUBLE, 1 / s.k::DOUBLE) END AS seen FROM (
   SELECT ev.batch, ev.pos, w.share, ev.event_idx, least(CAST(ceil(ln(0.5::DOUBLE) / ln(1 - greatest(1e-6::DOUBLE, least(coalesce(w.share, least(401 * 41, ev.n) / ev.n::DOUBLE), 1 - 1e-6::DOUBLE)))) AS BIGINT), ev.n - 1) AS k
   FROM w JOIN ev ON ev.batch = w.batch AND ev.pos = w.pos + 1) s LEFT JOIN ks ON ks.event_idx = s.event_idx AND ks.k = s.k)),
c AS (SELECT event_idx, k FROM w WHERE event_idx IS NOT NULL), f AS (SELECT m.*, k, least <= k AS near, bool_and(least <= k) OVER (PARTITION BY event_idx) AS every FROM m JOIN c USING (event_idx))
SELECT event_idx % 64 AS batch, event_idx, id, k > 0 AND near AND NOT (every AND r = n) AS masked FROM f""")
def block_mask(spark, d):
    rows = S.pixels(spark, d).groupBy("event_idx", F.col("pixel_idx").alias("id")).agg(F.min("channel").alias("x"), F.min("tick").alias("y"))
    return augment.block_mask(rows.withColumn("batch", F.col("event_idx") % 64), 200, 20, 0.5, 1).select("batch", "event_idx", "id", "masked")


# Draws, boxes and counts of all attempts; the first that holds two rows counts, then the centre box, then the first row.
_U = "CAST(('0x' || substr(md5('1:' || event_idx || ':' || crop || ':' || attempt || ':{0}'), 1, 13)) AS BIGINT) / 4503599627370496::DOUBLE"
_CROPS = f"""{PIXELS}, p AS (SELECT event_idx, pixel_idx AS id, min(channel // 32) AS x, min(tick) AS y FROM px GROUP BY 1, 2), cells AS (SELECT event_idx, list(c ORDER BY c) AS cs FROM (SELECT DISTINCT event_idx, least(greatest(y, 0), 99) * 64 + least(greatest(x, 0), 63) AS c FROM p) GROUP BY 1),
w0 AS (SELECT i, exp(-0.5::DOUBLE * (i / 2.0::DOUBLE) * (i / 2.0::DOUBLE)) AS g FROM (SELECT unnest(range(-6, 7)) AS i)), kn AS (SELECT list(i ORDER BY i) AS shifts, list(c ORDER BY i) AS steps FROM (SELECT i, sum(g) OVER (ORDER BY i) / sum(g) OVER () AS c FROM w0)),
dr AS (SELECT event_idx, cs, crop, attempt, {", ".join(f"{_U.format(k)} AS u{k}" for k in range(5))} FROM cells, (SELECT unnest(range(0, 2)) AS crop), (SELECT unnest(range(0, 51)) AS attempt)),
sz AS (SELECT event_idx, crop, attempt, cs[1 + CAST(floor(u0 * len(cs)) AS BIGINT)] AS cell, shifts[1 + least(len(list_filter(steps, lambda c: c <= u1)), 12)] AS dx, shifts[1 + least(len(list_filter(steps, lambda c: c <= u2)), 12)] AS dy,
 CAST(greatest(1, least(round_even(sqrt((0.3::DOUBLE + (0.6::DOUBLE - 0.3::DOUBLE) * u3) * 6400 * exp(ln(0.7::DOUBLE) + (ln(1.4::DOUBLE) - ln(0.7::DOUBLE)) * u4)), 0), 64)) AS BIGINT) AS w,
 CAST(greatest(1, least(round_even(sqrt((0.3::DOUBLE + (0.6::DOUBLE - 0.3::DOUBLE) * u3) * 6400 / exp(ln(0.7::DOUBLE) + (ln(1.4::DOUBLE) - ln(0.7::DOUBLE)) * u4)), 0), 100)) AS BIGINT) AS h FROM dr, kn),
mv AS (SELECT *, (cell % 64 + dx + 126) % 126 AS mx, (cell // 64 + dy + 198) % 198 AS my FROM sz),
bx AS (SELECT event_idx, crop, attempt, w, h, CASE WHEN attempt = 50 THEN (64 - w) // 2 ELSE CAST(greatest(0, least(round_even(least(mx, 126 - mx) - w / 2.0::DOUBLE, 0), 64 - w)) AS BIGINT) END AS l,
 CASE WHEN attempt = 50 THEN (100 - h) // 2 ELSE CAST(greatest(0, least(round_even(least(my, 198 - my) - h / 2.0::DOUBLE, 0), 100 - h)) AS BIGINT) END AS t FROM mv),
hit AS (SELECT bx.event_idx, crop, attempt, p.id FROM bx JOIN p ON p.event_idx = bx.event_idx AND x >= l AND x < l + w AND y >= t AND y < t + h),
ok AS (SELECT event_idx, crop, min(attempt) AS attempt FROM (SELECT event_idx, crop, attempt FROM hit GROUP BY 1, 2, 3 HAVING count(*) >= 2 OR attempt = 50) GROUP BY 1, 2),
cr AS (SELECT event_idx, crop, id FROM hit JOIN ok USING (event_idx, crop, attempt) UNION ALL
 SELECT event_idx, crop, min(id) FROM (SELECT p.*, unnest(range(0, 2)) AS crop FROM p) q ANTI JOIN ok USING (event_idx, crop) GROUP BY 1, 2)"""


def _crops(spark, d):
    rows = S.pixels(spark, d).groupBy("event_idx", F.col("pixel_idx").alias("id")).agg(F.min(F.expr("cast(channel div 32 AS int)")).alias("x"), F.min(F.expr("cast(tick AS int)")).alias("y"))
    return augment.crops(rows, 64, 100, 2, (0.3, 0.6), (0.7, 1.4), 2, 1)


@query(f"WITH {_CROPS} SELECT event_idx, crop, id FROM cr")
def crop_rows(spark, d):
    return _crops(spark, d)


@query(f"""WITH {_CROPS}, v AS (SELECT event_idx, crop * 2 + m AS view, id FROM cr, (SELECT unnest(range(0, 2)) AS m)),
r AS (SELECT *, count(*) OVER (PARTITION BY event_idx, view) AS n, row_number() OVER (PARTITION BY event_idx, view ORDER BY md5('1:' || event_idx || ':' || view || ':' || id), event_idx || ':' || view || ':' || id) AS k FROM v)
SELECT event_idx, view, id, k <= least(floor(n * 0.5), n - 1) AS masked FROM r""")
def crop_views(spark, d):
    return augment.views(_crops(spark, d), 2, 0.5, 1)
