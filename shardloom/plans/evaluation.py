"""Queries over evaluation sets, pools, probes, sources and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.functions import expressions as X
from shardloom.operators import collectors, extract, metrics, neighbors, pools, probes, relational, report, sampling, series, settings, vertices
from shardloom.plans import standins as S
from shardloom.plans.more import _POINTS, _points
from shardloom.plans.standins import EVENTS, FEATURES, LOG, PIXELS
from shardloom.sources import evalset, logstream, npz, tables
from shardloom.sources.tables import cut, shared_dir
from shardloom.streaming import dumps

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


SPEC = {"seed": 7, "per_class": 50, "overlap_thresholds": [0.22, 0.12, 0.32], "overlap_train_per_class": 60, "overlap_val_pixels": 500, "vertex_radii_px": [20, 10, 30], "vertex_train_per_class": 70,
        "vertex_val_pixels": 300, "instance_max_queries": 200, "event_max_per_event": 2, "knn_max_per_class": 80, "of_a_later_version": 1}


def _truth(spark, d):
    distance = F.when(F.col("label") > 0, F.abs(F.col("tick") - 50).cast("double"))
    return S.pixels(spark, d).select("event_idx", "channel", "tick", "charge", "label", "energyfrac", "trackid", (F.col("pixel_idx") * 10 + F.col("line")).alias("row"), distance.alias("distance"))


_ORDER = "md5('{0}:' || row), row"


def _ranked(name: str, rows: str, by: str, n: int, seed: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT '{name}' AS pool, row FROM (SELECT *, row_number() OVER ({part}ORDER BY {_ORDER.format(seed)}) AS k FROM {rows}) WHERE k <= {n}"


@query(
    f"""WITH {EVENTS}, {PIXELS}, t AS (SELECT event_idx, label, energyfrac, trackid, pixel_idx * 10 + line AS row, CASE WHEN label > 0 THEN CAST(abs(tick - 50) AS DOUBLE) END AS distance,
 CASE WHEN label <> 0 THEN least(greatest(1 - energyfrac, 0), 1) ELSE 0 END AS share FROM px),
sp AS (SELECT event_idx, row_number() OVER (ORDER BY md5('7:' || event_idx), event_idx) <= floor(0.8 * count(*) OVER ()) AS is_train FROM ev), a AS (SELECT t.*, is_train FROM t JOIN sp USING (event_idx)),
tr AS (SELECT * FROM a WHERE is_train), va AS (SELECT * FROM a WHERE NOT is_train), iq AS ({_ranked("instance_queries", "(SELECT * FROM t WHERE label <> 0 AND trackid <> 0)", "", 200, 7)}),
kn AS (SELECT *, row_number() OVER (PARTITION BY event_idx, label ORDER BY {_ORDER.format(7)}) AS r FROM t WHERE label > 0)
{_ranked("pid_train", "(SELECT * FROM tr WHERE label > 0)", "label", 50, 7)} UNION ALL {_ranked("pid_val", "(SELECT * FROM va WHERE label > 0)", "label", 50, 8)}
UNION ALL SELECT 'knn_pool', row FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || event_idx), event_idx, {_ORDER.format(7)}) AS k FROM kn WHERE r <= 1) WHERE k <= 80
UNION ALL {_ranked("event_sample", "t", "event_idx", 2, 7)} UNION ALL {_ranked("overlap_val", "(SELECT * FROM va WHERE label <> 0)", "", 500, 7)}
"""
    + "".join(f"UNION ALL {_ranked(f'overlap_train_{i}', '(SELECT * FROM tr WHERE label <> 0)', f'share > {x}', 60, 7)} " for i, x in enumerate((0.22, 0.12, 0.32)))
    + "UNION ALL SELECT * FROM iq UNION ALL SELECT 'instance_event_rows', row FROM t WHERE label <> 0 AND trackid <> 0 AND event_idx IN (SELECT event_idx FROM t WHERE row IN (SELECT row FROM iq)) "
    + f"UNION ALL {_ranked('vertex_val', '(SELECT * FROM va WHERE distance IS NOT NULL)', '', 300, 7)} "
    + "".join(f"UNION ALL {_ranked(f'vertex_train_{i}', '(SELECT * FROM tr WHERE distance IS NOT NULL)', f'distance <= {x}', 70, 7)} " for i, x in enumerate((20, 10, 30)))
)
def draw_pools(spark, d):
    spec = pools.PoolSpec.from_dict(SPEC)
    spec.check("every probe", overlap_thresholds=(0.22, 0.12, 0.32), per_class=50)
    return pools.draw_pools(_truth(spark, d), S.events(spark, d), spec, "row")


@query(
    f"""WITH {EVENTS}, {PIXELS}, t AS (SELECT event_idx, label, pixel_idx * 10 + line AS row FROM px), sp AS (SELECT event_idx, row_number() OVER (ORDER BY md5('7:' || event_idx), event_idx) <= floor(0.8 * count(*) OVER ()) AS is_train FROM ev)
SELECT row FROM ({_ranked("pid_val", "(SELECT * FROM t JOIN sp USING (event_idx) WHERE NOT is_train AND label > 0)", "label", 50, 8)})"""
)
def drawn_pool(spark, d):
    """One pool of those that were drawn."""
    return pools.pool(draw_pools(spark, d), "pid_val")


@query("""WITH f AS (SELECT p_partkey AS id, p_brand || '/' || p_partkey || '_pixeldata-anode0.h5' AS path FROM part) SELECT id, replace(path, '_pixeldata-anode0.h5', '_metadata.h5') AS metadata, replace(path, '_pixeldata-anode0.h5', '_trackid_pid_map.h5') AS particles FROM f""")
def companion_paths(spark, d):
    files = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), "p_partkey", F.lit("_pixeldata-anode0.h5")).alias("path"))
    return files.select("id", tables.companion(F.col("path")).alias("metadata"), tables.companion(F.col("path"), kind="trackid_pid_map").alias("particles"))


@query("""WITH g AS (SELECT p_size, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS name FROM part)
SELECT p_size, name, row_number() OVER (PARTITION BY p_size ORDER BY coalesce(TRY_CAST(name AS INTEGER), 1073741824), name) AS place FROM g""")
def ordered_groups(spark, d):
    """Groups of a file in the order in which they are read."""
    rows = S.table(spark, d, "part").select("p_size", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", "p_partkey")).otherwise(F.col("p_partkey").cast("string")).alias("name"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("p_size").orderBy(*tables.group_order(F.col("name")))).cast("long"))


@query(f"WITH {PIXELS} SELECT event_idx, 1 / count(DISTINCT nullif(label, 0))::DOUBLE AS chance FROM px GROUP BY 1 HAVING count(DISTINCT nullif(label, 0)) > 0 UNION ALL SELECT event_idx, NULL FROM px GROUP BY 1 HAVING count(DISTINCT nullif(label, 0)) = 0")
def chance_levels(spark, d):
    """The accuracy of guessing among an event's classes."""
    classes = F.collect_set(F.when(F.col("label") > 0, F.col("label")))
    return S.pixels(spark, d).groupBy("event_idx").agg(classes.alias("c")).select("event_idx", report.uniform_chance(F.col("c")).alias("chance"))


@query(f"WITH {FEATURES} SELECT DISTINCT CASE WHEN label % 2 = 0 THEN 'student' ELSE 'teacher' END AS source, 'block' || label % 3 AS tap FROM ft")
def available_taps(spark, d):
    store, rows = tables.FeatureStore(spark, _scratch(spark, "taps")), S.features(spark, d)
    for source, k in (("student", 0), ("teacher", 1)):
        own = rows.where(F.col("label") % 2 == k).select(F.col("id").alias("row_idx"), "vec", F.concat(F.lit("block"), F.col("label") % 3).alias("tap"), F.lit(0).alias("block"))
        store.write_blocks(own, source)
    return store.available()


def _samples(spark, d):
    """Feature rows with a class and a number, in two halves."""
    rows = S.features(spark, d).withColumn("class", F.col("label") % 3).withColumn("number", (F.col("label") / 10.0) + F.col("vec")[0].cast("double") * 0)
    split = sampling.event_split(rows.select(F.col("id").alias("event_idx")), 3, 0.7)
    rows = cut(rows.join(split, F.col("id") == F.col("event_idx")))
    return rows.where("is_train"), rows.where("not is_train")


@query()
def probe_pid(spark, d):
    train, val = _samples(spark, d)
    return probes.pid_scores(train.select("id", "vec", "class"), val.select("id", "vec", "class"), [0, 1, 2], [1, 2], 1)[0]


@query()
def probe_overlap(spark, d):
    train, val = _samples(spark, d)
    own = [sampling.per_group(train.withColumn("over", F.col("number") > t), ["over"], 100, 1, "id") for t in (0.25, 0.55)]
    return probes.threshold_probe(own, val, "number", [0.25, 0.55], 1)


@query()
def probe_vertex(spark, d):
    train, val = _samples(spark, d)
    return probes.threshold_probe([train], val, "number", [0.35], 1, above=False)


@query("""WITH e AS (SELECT 'o' || o_orderkey AS k FROM orders) SELECT 'orders' AS id, sha256(string_agg(k, chr(10) ORDER BY k) || chr(10)) AS key_hash, count(*) AS n_events, (SELECT count(*) FROM lineitem) AS n_pixels,
 (SELECT CAST(sum(l_suppkey) AS BIGINT) FROM lineitem) AS ticks FROM e""")
def eval_set(spark, d):
    root = _scratch(spark, "set")
    evalset.EvalSet.create(spark, root, "orders", S.events(spark, d), _truth(spark, d).drop("distance"))
    own = evalset.EvalSet.load(spark, root)
    own.verify(spark, root)
    return own.read(spark, root, "pixels.tick").agg(F.sum("tick").alias("ticks")).select(F.lit(own.id).alias("id"), F.lit(own.key_hash).alias("key_hash"), F.lit(own.n_events).alias("n_events"), F.lit(own.n_pixels).alias("n_pixels"), "ticks")


@query("""WITH e AS (SELECT o_orderkey AS event_idx, nullif(o_custkey, 5) AS event_key FROM orders), k AS (SELECT event_key, count(*) AS n FROM e GROUP BY 1), p AS (SELECT l_orderkey + 3 AS event_idx, CASE WHEN l_quantity > 10 THEN l_tax END AS truth FROM lineitem)
SELECT * FROM (SELECT 'event without key' AS problem, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM k WHERE event_key IS NULL UNION ALL SELECT 'repeated event key', count(*) FROM k WHERE event_key IS NOT NULL AND n > 1
UNION ALL SELECT 'pixel of no event', count(*) FROM p WHERE event_idx NOT IN (SELECT event_idx FROM e) UNION ALL SELECT 'truth column truth is short', count(*) - count(truth) FROM p) WHERE n > 0""")
def eval_violations(spark, d):
    events = S.table(spark, d, "orders").selectExpr("o_orderkey AS event_idx", "nullif(o_custkey, 5) AS event_key")
    pixels = S.table(spark, d, "lineitem").selectExpr("l_orderkey + 3 AS event_idx", "CASE WHEN l_quantity > 10 THEN l_tax END AS truth")
    return evalset.violations(events, pixels, ["truth"])


@query(f"""WITH {EVENTS}, {PIXELS}, e AS (SELECT event_idx, event_key, event_idx // 16 AS batch_id FROM ev), p AS (SELECT e.batch_id, px.event_idx, channel, tick, charge, label FROM px JOIN e USING (event_idx)), o AS (SELECT e.batch_id, e.event_idx, e.event_key, count(p.channel) AS n FROM e LEFT JOIN p USING (event_idx) GROUP BY 1, 2, 3)
SELECT batch_id, count(*) AS n_events, min(event_key) AS first_key, CAST(sum(n) AS BIGINT) AS n_pixels, (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT sum(n) OVER (ORDER BY event_idx) AS c FROM o x WHERE x.batch_id = o.batch_id)) AS offset_sum,
 (SELECT CAST(sum(channel * k) AS BIGINT) FROM (SELECT channel, row_number() OVER (ORDER BY event_idx, channel, tick, charge, label) AS k FROM p WHERE p.batch_id = o.batch_id)) AS place_sum FROM o GROUP BY batch_id""")
def collate_batches(spark, d):
    ev = S.events(spark, d).select("event_idx", "event_key", F.floor(F.col("event_idx") / 16).alias("batch_id"))
    rows = evalset.require_batches(evalset.collated(ev, S.pixels(spark, d).select("event_idx", "channel", "tick", "charge", "label")))
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "batch_id", F.size("event_idx").cast("long").alias("n_events"), F.array_min("event_key").alias("first_key"), F.size("coords").cast("long").alias("n_pixels"), total(F.col("offsets")).alias("offset_sum"),
        F.nullif(total(F.transform("coords", lambda c, i: c["channel"].cast("long") * (i + 1))), F.lit(0)).alias("place_sum"),
    )


@query(f"""WITH {EVENTS}, {PIXELS}, e AS (SELECT *, event_idx // 16 AS batch_id, row_number() OVER (PARTITION BY event_idx // 16 ORDER BY event_idx) AS k FROM ev), p AS (SELECT e.batch_id, e.k, count(*) AS n, CAST(sum(px.label * r) AS BIGINT) AS s FROM
 (SELECT *, row_number() OVER (PARTITION BY event_idx ORDER BY channel, tick, charge, label) AS r FROM px) px JOIN e USING (event_idx) GROUP BY 1, 2),
q AS (SELECT batch_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s * k) AS BIGINT) AS s FROM p GROUP BY 1)
SELECT e.batch_id, CAST(sum(nu_pdg * k) AS BIGINT) AS pdg_sum, round(sum(CAST(CAST(nu_energy AS FLOAT) AS DOUBLE) * k), 2) AS energy_sum, CAST(count(*) AS INTEGER) AS n_keys, coalesce(any_value(q.n), 0) AS n_pixels, coalesce(any_value(q.s), 0) AS label_sum FROM e LEFT JOIN q USING (batch_id) GROUP BY 1""")
def collate_truth(spark, d):
    ev = S.events(spark, d).select("event_idx", "event_key", "nu_pdg", "nu_energy", F.floor(F.col("event_idx") / 16).alias("batch_id"))
    rows = evalset.collated_meta(ev, S.pixels(spark, d).select("event_idx", "channel", "tick", "charge", F.col("label").alias("pixel_labels")))
    placed = lambda v, zero: F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(zero).cast("double" if isinstance(zero, float) else "long"), lambda a, x: a + x)
    labels = F.transform("pixel_labels", lambda v: placed(F.transform(v, lambda x: x.cast("long")), 0))
    energies = F.transform("nu_energy", lambda x: x.cast("double"))
    return rows.select(
        "batch_id", placed("nu_pdg", 0).alias("pdg_sum"), F.round(placed(energies, 0.0), 2).alias("energy_sum"), F.size("event_key").alias("n_keys"),
        F.size(F.flatten("pixel_labels")).cast("long").alias("n_pixels"), placed(labels, 0).alias("label_sum"),
    )


@query(f"""WITH {PIXELS}, o AS (SELECT event_idx, count(*) AS found FROM (SELECT DISTINCT event_idx, channel // 4 AS x, tick // 4 AS y FROM px WHERE label <> 2) GROUP BY 1), s AS (SELECT event_idx, count(*) AS expected FROM (SELECT DISTINCT event_idx, channel // 4 AS x, tick // 4 AS y FROM px) GROUP BY 1)
SELECT event_idx, coalesce(found, 0) AS found, expected FROM s LEFT JOIN o USING (event_idx) WHERE coalesce(found, 0) <> expected""")
def misaligned_counts(spark, d):
    px = S.pixels(spark, d)
    out = px.where("label <> 2").select("event_idx", F.floor(F.col("channel") / 4).alias("channel"), F.floor(F.col("tick") / 4).alias("tick")).distinct()
    return evalset.misaligned(out, px, 4)


@query(f"""WITH {PIXELS}, u AS (SELECT DISTINCT event_idx, channel, tick FROM px), s AS (SELECT *, row_number() OVER (PARTITION BY event_idx ORDER BY channel, tick) - 1 AS pos FROM u), o AS (SELECT event_idx, channel, tick, row_number() OVER (PARTITION BY event_idx ORDER BY channel, tick) - 1 AS pos FROM u WHERE channel % 7 <> 0)
SELECT *, 'output' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'source' FROM (SELECT * FROM s EXCEPT SELECT * FROM o)""")
def misaligned_rows(spark, d):
    px = S.pixels(spark, d).select("event_idx", "channel", "tick").distinct()
    return evalset.misaligned(evalset.numbered(px.where("channel % 7 <> 0")), evalset.numbered(px))


@query("""SELECT s_suppkey AS n, 'run' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN ':best' ELSE ':ep' || s_suppkey % 9 END || CASE WHEN s_suppkey % 2 = 0 THEN ':student' ELSE ':student:mid' END AS label FROM supplier""")
def run_labels(spark, d):
    s = S.table(spark, d, "supplier").selectExpr("s_suppkey AS n", "concat('/data/run', s_nationkey, '/features/', CASE WHEN s_suppkey % 3 = 0 THEN 'best' ELSE concat('epoch', s_suppkey % 9) END, '/') AS p", "CASE WHEN s_suppkey % 2 = 0 THEN 'out' ELSE 'mid' END AS tap")
    return s.select("n", report.run_label(F.col("p"), F.lit("student"), F.col("tap")).alias("label"))


@query("""WITH c AS (SELECT 'r' || n_regionkey AS run, 'k' || n_nationkey % 3 AS key, CAST(max(n_nationkey % 2) AS VARCHAR) AS value FROM nation WHERE NOT (n_regionkey = 4 AND n_nationkey % 3 = 2) GROUP BY 1, 2),
k AS (SELECT key FROM c GROUP BY 1 HAVING count(DISTINCT value) > 1 OR count(DISTINCT run) < 5), l AS (SELECT DISTINCT run, run || ':ep1:student' AS label FROM c)
SELECT label, key, coalesce(value, '-') AS value FROM l CROSS JOIN k LEFT JOIN c USING (run, key)""")
def config_columns(spark, d):
    n = S.table(spark, d, "nation").where("NOT (n_regionkey = 4 AND n_nationkey % 3 = 2)")
    configs = n.groupBy(F.concat(F.lit("r"), "n_regionkey").alias("run"), F.concat(F.lit("k"), (F.col("n_nationkey") % 3).cast("string")).alias("key")).agg(F.max(F.col("n_nationkey") % 2).cast("string").alias("value"))
    labels = configs.select(F.concat("run", F.lit(":ep1:student")).alias("label")).unionByName(spark.createDataFrame([("other:ep1:student",)], "label string"))
    return report.config_columns(labels, configs)


@query(f"""WITH {PIXELS}, o AS (SELECT event_idx, line AS row, row_number() OVER (PARTITION BY event_idx ORDER BY line) - 1 AS pos FROM (SELECT DISTINCT event_idx, line FROM px WHERE line > 1)), i AS (SELECT event_idx, pos AS at, row_number() OVER (PARTITION BY event_idx ORDER BY pos DESC) - 1 AS pos FROM o WHERE pos % 2 = 0)
SELECT i.event_idx, i.pos, o.row AS "of" FROM i JOIN o ON o.event_idx = i.event_idx AND o.pos = i.at""")
def composed_selections(spark, d):
    at = lambda c: (F.row_number().over(Window.partitionBy("event_idx").orderBy(c)) - 1).alias("pos")
    outer = S.pixels(spark, d).where("line > 1").select("event_idx", F.col("line").alias("of")).distinct().select("event_idx", "of", at(F.col("of")))
    inner = outer.where("pos % 2 = 0").select("event_idx", F.col("pos").alias("of")).select("event_idx", "of", at(F.desc("of")))
    return relational.composed(outer, inner)


@query(f"WITH {FEATURES} SELECT id AS event_idx, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS value FROM (SELECT id, list_transform(vec[1:3] || vec[5:6], lambda x: round(x, 6)) AS v FROM ft)")
def concatenated_lists(spark, d):
    part = lambda a, n: F.transform(F.slice("vec", a, n), lambda x: F.round(x.cast("double"), 6))
    rows = S.features(spark, d).select(F.col("id").alias("event_idx"), F.array(part(1, 3), part(5, 2)).alias("parts"))
    return relational.concatenated(rows, "parts").withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {FEATURES}, m AS (SELECT id, vec, list_avg(vec) AS m, list_var_pop(vec) AS s FROM ft) SELECT id, round((vec[1] - m) / sqrt(s + 1e-5), 6) AS first, round((vec[64] - m) / sqrt(s + 1e-5), 6) AS last FROM m".replace("list_var_pop(vec)", "list_aggregate(vec, 'var_pop')"))
def row_norm(spark, d):
    rows = S.features(spark, d).select("id", metrics.row_norm(F.col("vec")).alias("v"))
    return rows.select("id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("""WITH p AS (SELECT l_orderkey % 100 AS g, l_linenumber AS line, l_orderkey AS k, CASE WHEN l_quantity < 30 THEN l_extendedprice END AS v FROM lineitem), m AS (SELECT g, avg(v) AS m, var_pop(v) AS s FROM p GROUP BY 1)
SELECT k, line, count(*) AS n, round(sum((v - m) / sqrt(s)), 4) AS z FROM p JOIN m USING (g) GROUP BY 1, 2""")
def masked_norm_by_group(spark, d):
    rows = S.table(spark, d, "lineitem").selectExpr("l_orderkey % 100 AS g", "l_linenumber AS line", "l_orderkey AS k", "CASE WHEN l_quantity < 30 THEN l_extendedprice END AS v")
    return metrics.masked_norm(rows, "v", ["g"]).groupBy("k", "line").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z"))


@query(f"""WITH {PIXELS} SELECT event_idx, channel, tick, min(charge) AS charge, min(label) AS pixel_labels FROM px WHERE event_idx % 4 IN (1, 3) AND event_idx > 10 GROUP BY 1, 2, 3""")
def direct_source(spark, d):
    root, px = _scratch(spark, "direct"), S.pixels(spark, d).withColumn("group", (F.col("event_idx") % 4).cast("string"))
    px = px.groupBy("group", "event_idx", "channel", "tick").agg(F.min("charge").alias("charge"), F.min("label").alias("label"))
    keys = ["group", "event_idx", "channel", "tick"]
    px.select(*keys, "charge").write.partitionBy("group").parquet(f"{root}/pixels")
    px.select(*keys, F.col("label").alias("pixel_labels")).write.partitionBy("group").parquet(f"{root}/truth")
    return tables.build(spark, "direct", root, groups=["1", "3"], events="event_idx > 10", pixel=True)


def _tiered(spark, d):
    px = S.pixels(spark, d)
    return px.select("event_idx", "channel", "tick", "charge", F.col("label").alias("pixel_labels"), F.col("energyfrac").alias("pixel_energyfrac"), F.col("trackid").alias("pixel_trackid"), F.col("charge").alias("pixel_truth_q"), (F.col("event_idx") % 8).alias("shard"))


@query(f"WITH {PIXELS} SELECT event_idx, channel, tick, charge, label AS pixel_labels, energyfrac AS pixel_energyfrac, trackid AS pixel_trackid, charge AS pixel_truth_q FROM px WHERE event_idx < 100")
def packed_source(spark, d):
    root = _scratch(spark, "packed")
    _tiered(spark, d).drop("shard").write.parquet(root)
    return tables.build(spark, "packed", root, events="event_idx < 100", extra=True)


_TIERED = "event_idx, channel, tick, CAST(CAST(charge AS FLOAT) AS DOUBLE) AS charge, label AS pixel_labels, CAST(CAST(energyfrac AS FLOAT) AS DOUBLE) AS pixel_energyfrac, trackid AS pixel_trackid"


def _packed(spark, d):
    """The pixels and events of the tables, packed as npz."""
    root = _scratch(spark, "npz")
    npz.pack(S.events(spark, d), _tiered(spark, d).drop("shard"), root)
    return root


@query(f"WITH {PIXELS} SELECT {_TIERED} FROM px WHERE event_idx < 100 OR event_idx % 7 = 0")
def npz_pixels(spark, d):
    rows = npz.read(spark, _packed(spark, d), tiers="extra").where("event_idx < 100 OR event_idx % 7 = 0")
    return rows.selectExpr("event_idx", "cast(channel AS long) AS channel", "cast(tick AS long) AS tick", "cast(charge AS double) AS charge", "cast(pixel_labels AS int) AS pixel_labels", "cast(pixel_energyfrac AS double) AS pixel_energyfrac", "cast(pixel_trackid AS long) AS pixel_trackid")


@query(f"WITH {EVENTS}, {PIXELS}, c AS (SELECT event_idx, count(*) AS n FROM px GROUP BY 1) SELECT ev.event_idx, event_key, coalesce(n, 0) AS n, nu_pdg, nu_ccnc, CAST(CAST(nu_energy AS FLOAT) AS DOUBLE) AS nu_energy FROM ev LEFT JOIN c USING (event_idx) WHERE ev.event_idx BETWEEN 50 AND 5000")
def npz_events(spark, d):
    rows = npz.read(spark, _packed(spark, d), "events", events=(50, 5000))
    return rows.selectExpr("event_idx", "event_key", "n", "nu_pdg", "nu_ccnc", "cast(nu_energy AS double) AS nu_energy")


@query(f"WITH {PIXELS} SELECT event_idx % 8 AS shard, event_idx, channel, tick, charge, label AS pixel_labels FROM px WHERE event_idx % 8 IN (2, 5)")
def sharded_source(spark, d):
    root = _scratch(spark, "sharded")
    tables.write_shards(_tiered(spark, d).withColumn("pos", F.col("event_idx")), root)
    return tables.build(spark, "sharded", root, shards=[2, 5], pixel=True).withColumn("shard", F.col("shard").cast("long"))


@query(f"WITH {PIXELS} SELECT event_idx, CAST(label AS TINYINT) AS pixel_labels, CAST(0 AS INTEGER) AS pixel_pdg, count(*) AS n FROM px GROUP BY 1, 2")
def zero_filled_columns(spark, d):
    px = _tiered(spark, d)
    names = {"event_idx": dict(px.dtypes)["event_idx"], **{k: tables.PIXEL_TYPES[k] for k in ("pixel_labels", "pixel_pdg")}}
    return tables.zero_filled(px, names).groupBy("event_idx", "pixel_labels", "pixel_pdg").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT 'key' AS key, count(*) AS n FROM lg UNION ALL SELECT 'step', count(*) FROM lg UNION ALL SELECT 'value', count(*) FROM lg WHERE step % 3 <> 0")
def log_columns(spark, d):
    path = _scratch(spark, "log")
    tables.write_log(S.log(spark, d).select("step", "key", F.when(F.col("step") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")), path)
    return tables.log_schema(tables.read_log(spark, path))


@query(f"WITH {LOG} SELECT key, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps, round(sum(value), 4) AS total FROM lg GROUP BY 1")
def log_stream(spark, d):
    """The log as a stream by byte offsets, into a table."""
    path, sink = _scratch(spark, "log"), _scratch(spark, "sink")
    tables.write_log(S.log(spark, d).select("step", "key", "value"), path)
    rows = logstream.read_stream(spark, path).select(F.variant_get("rec", "$.key", "string").alias("key"), F.variant_get("rec", "$.step", "bigint").alias("step"), F.variant_get("rec", "$.value", "double").alias("value"))
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {LOG} SELECT key, count(*) AS n, max(step) AS last FROM lg WHERE step < 700 GROUP BY 1")
def resumed_log(spark, d):
    """The log that a run goes on with when it resumes at a step."""
    path, to = _scratch(spark, "log"), _scratch(spark, "resumed")
    tables.write_log(S.log(spark, d).select("step", "key", "value"), path)
    logstream.resume(spark, path, to, 700)
    rows = logstream.read(spark, to).select(F.variant_get("rec", "$.key", "string").alias("key"), F.variant_get("rec", "$.step", "bigint").alias("step"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last"))


@query("""WITH s AS (SELECT label AS step, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || label || ':' || vec_id), vec_id) AS r FROM embeddings),
ex AS (SELECT step, unnest(e) AS v, generate_subscripts(e, 1) AS p FROM s WHERE r <= 40), t AS (SELECT step, sum(v) AS trace FROM (SELECT step, p, var_samp(v) AS v FROM ex GROUP BY 1, 2) GROUP BY 1)
SELECT step, count(*) AS n, round(any_value(trace), 6) AS trace, round(covar_samp(e[1], e[2]), 6) AS first FROM s JOIN t USING (step) WHERE r <= 40 GROUP BY 1""")
def array_dump(spark, d):
    """Covariances of a stream's steps, dumped by batch."""
    root = _scratch(spark, "arrays")
    rows = spark.readStream.schema(S.table(spark, d, "embeddings").schema).parquet(f"{d}/embedding[s].parquet")
    rows = rows.select(F.col("label").alias("step"), F.lit("features").alias("name"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    dumps.dump(rows, root, f"{root}-checkpoint", most=40, seed=3, sample=False).awaitTermination()
    trace = F.aggregate(F.sequence(F.lit(0), F.size("cov") - 1), F.lit(0.0), lambda a, i: a + F.get(F.get("cov", i), i))
    return dumps.read(spark, root).select("step", "n", F.round(trace, 6).alias("trace"), F.round(F.col("cov")[0][1], 6).alias("first"))


@query("""WITH s AS (SELECT event_id AS step, k AS key, event_id * CAST(0.001 AS DOUBLE) AS value FROM events, (VALUES ('lr'), ('weight_decay')) v(k)), g AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'lr' ELSE 'weight_decay' END AS key, n_regionkey * CAST(0.5 AS DOUBLE) AS scale FROM nation)
SELECT step, key, round(value, 6) AS value FROM s UNION ALL SELECT step, s.key || '/' || name, round(value * scale, 6) FROM s JOIN g ON s.key = g.key AND scale <> 1""")
def scaled_schedules(spark, d):
    steps = S.table(spark, d, "events").select(F.col("event_id").alias("step"), F.explode(F.array(F.lit("lr"), F.lit("weight_decay"))).alias("key")).withColumn("value", F.col("step") * F.lit(0.001))
    groups = S.table(spark, d, "nation").selectExpr("n_name AS name", "IF(n_nationkey % 2 = 0, 'lr', 'weight_decay') AS key", "n_regionkey * 0.5d AS scale")
    return series.applied(steps, groups).withColumn("value", F.round("value", 6))


@query("""WITH s AS (SELECT 'r' || p_partkey % 500 AS run, CASE p_size % 3 WHEN 0 THEN 'loader' WHEN 1 THEN 'schedule' ELSE 'nowhere' END AS section, CASE p_partkey % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'total' WHEN 2 THEN 'base' ELSE 'odd' END AS key, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS value FROM part),
k(section, key, kind, required) AS (VALUES ('loader', 'size', 'long', TRUE), ('schedule', 'base', 'double', TRUE), ('schedule', 'total', 'long', TRUE)),
w AS (SELECT s.run, s.section, s.key, CASE WHEN s.section = 'nowhere' THEN 'unknown section' WHEN k.key IS NULL THEN 'unknown key' WHEN (kind = 'long' AND NOT regexp_full_match(value, '[+-]?[0-9]+')) OR (kind = 'double' AND TRY_CAST(value AS DOUBLE) IS NULL) THEN 'not a ' || kind END AS problem FROM s LEFT JOIN k ON k.section = s.section AND k.key = s.key)
SELECT * FROM w WHERE problem IS NOT NULL UNION ALL SELECT b.run, b.section, k.key, 'missing' FROM (SELECT DISTINCT run, section FROM s) b JOIN k ON k.section = b.section WHERE required AND NOT EXISTS (SELECT 1 FROM s WHERE s.run = b.run AND s.section = b.section AND s.key = k.key)""")
def settings_violations(spark, d):
    settings.register_framework()
    rows = S.table(spark, d, "part").selectExpr("concat('r', p_partkey % 500) AS run", "CASE p_size % 3 WHEN 0 THEN 'loader' WHEN 1 THEN 'schedule' ELSE 'nowhere' END AS section", "CASE p_partkey % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'total' WHEN 2 THEN 'base' ELSE 'odd' END AS key", "IF(p_partkey % 5 = 0, p_brand, cast(p_size AS string)) AS value")
    return settings.violations(rows, settings.schema(spark))


def _backbone():
    """A fixed linear model of whole numbers."""
    import numpy as np

    weights = np.arange(64)[:, None] * np.array([1, 3]) % 5 - 2

    def run(x):
        out = np.floor(x * 256) @ weights
        return {"out": out, "size": np.abs(np.floor(x * 256)).sum(axis=1, keepdims=True)}

    return run


@query(f"""WITH {FEATURES}, w AS (SELECT id, list_transform(vec, lambda x: floor(256 * x)) AS v FROM ft) SELECT id AS row_idx, CAST(list_sum(list_transform(v, lambda x, i: x * ((i - 1) % 5 - 2))) AS BIGINT) AS a,
CAST(list_sum(list_transform(v, lambda x, i: x * ((i - 1) * 3 % 5 - 2))) AS BIGINT) AS b, CAST(list_sum(list_transform(v, lambda x: abs(x))) AS BIGINT) AS size FROM w""")
def extracted_features(spark, d):
    """Two taps of a model, written in blocks by a run that stops and one that goes on."""
    store, rows = tables.FeatureStore(spark, _scratch(spark, "extracted")), S.features(spark, d).select(F.col("id").alias("row_idx"), F.col("vec").alias("x"))
    for part in (rows.where("row_idx < 200"), rows):
        extract.extract(store, part, _backbone, "student", ["out", "size"], block=100)
    out = store.features("student", "out").join(store.features("student", "size").withColumnRenamed("vec", "size"), "row_idx")
    return out.select("row_idx", F.col("vec")[0].cast("long").alias("a"), F.col("vec")[1].cast("long").alias("b"), F.col("size")[0].cast("long").alias("size"))


@query(f"""WITH {FEATURES} SELECT id AS row_idx, label, len(vec) + 2 AS dims, round(vec[1], 5) AS first, CAST(1.5 AS DOUBLE) AS last FROM ft WHERE id % 2 = 0""")
def feature_store(spark, d):
    store, rows = tables.FeatureStore(spark, _scratch(spark, "store")), S.features(spark, d).where("id % 2 = 0")
    store.write_features(rows.select(F.col("id").alias("row_idx"), "vec"), "student", "a")
    for _ in range(2):  # a block that is written twice is there once
        store.write_features(rows.select(F.col("id").alias("row_idx"), F.array(F.lit(0.5), F.lit(1.5)).alias("vec")), "student", "b")
    store.write_table("row_space", rows.select(F.col("id").alias("row_idx"), F.col("id").alias("pixel_idx")))
    px = rows.select(F.col("id").alias("pixel_idx"), F.col("id").alias("event_idx"))
    out = store.load("student", "a+b", px, rows.select(F.col("id").alias("event_idx"), "label"))
    return out.select("row_idx", "label", F.size("vec").cast("long").alias("dims"), F.round(F.col("vec")[0].cast("double"), 5).alias("first"), F.element_at("vec", -1).cast("double").alias("last"))


class _Mean(collectors.Collector):
    def compute(self, rows):
        return {"mean": float(rows["value"].mean()), "n": float(len(rows))}


@query(f"""WITH {LOG}, s AS (SELECT step // 50 AS step, value FROM lg), a AS (SELECT step, avg(value) AS m, count(*) AS n FROM s GROUP BY 1), b AS (SELECT step, 'all/mean' AS key, m AS value FROM a UNION ALL SELECT step, 'all/n', n FROM a UNION ALL SELECT step, 'some/mean', m FROM a WHERE step % 4 = 0
 UNION ALL SELECT step, 'some/n', n FROM a WHERE step % 4 = 0 UNION ALL SELECT step, 'last/mean', m FROM a WHERE step = (SELECT max(step) FROM a) UNION ALL SELECT step, 'last/n', n FROM a WHERE step = (SELECT max(step) FROM a)) SELECT step, key, round(value, 6) AS value FROM b""")
def collected_metrics(spark, d):
    own = {"all": _Mean("step"), "some": _Mean(4), "last": _Mean("epoch"), "unmet": _Mean("step", ("gradient",))}
    rows = S.log(spark, d).select(F.floor(F.col("step") / 50).alias("step"), "value")
    return collectors.collect(rows, own).withColumn("value", F.round("value", 6))


@query("""SELECT CAST(s_suppkey % 5 AS BIGINT) AS step, count(DISTINCT s_nationkey % 3) = 3 AS complete FROM supplier WHERE s_suppkey % 5 <> 3 OR s_nationkey % 3 <> 1 GROUP BY 1""")
def complete_steps(spark, d):
    rows = S.table(spark, d, "supplier").where("s_suppkey % 5 <> 3 OR s_nationkey % 3 <> 1").selectExpr("cast(s_suppkey % 5 AS bigint) AS step", "s_nationkey % 3 AS rank")
    return series.rows_with_material(rows, 3)


@query("SELECT key, value FROM (VALUES ('early', 'loss'), ('late', 'acc')) t(key, value)")
def unmapped_metrics(spark, d):
    results = spark.createDataFrame([("r:ep1:s", "loss", "1"), ("r:ep1:s", "hidden", "2"), ("r:ep2:s", "acc", "3")], "label string, metric string, body string")
    path = _scratch(spark, "results")
    report.write_results(results, path)
    back = report.merge_results(spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias("text")))
    rest = report.unmapped(back, ["hidden"])
    return rest.select(F.when(F.col("metric") == "loss", "early").otherwise("late").alias("key"), F.col("metric").alias("value"))


@query("""SELECT 's' AS sweep_id, CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS point, substr(sha256('lr=' || CASE a WHEN 0 THEN '0.1' ELSE '0.2' END || chr(10) || 'seed=' || b), 1, 8) AS hash FROM range(2) t(a), range(3) u(b)""")
def stored_manifest(spark, d):
    path = _scratch(spark, "manifest")
    report.write_manifest(report.manifest(spark, "s", ["lr=0.1,0.2", "seed=range(0,3)"]), path)
    return report.read_manifest(spark, path).select("sweep_id", "point", "hash")


@query(f"""WITH {FEATURES} SELECT count(DISTINCT label) AS n_events, count(*) AS n_pixels, 64 AS feature_dim, 'student' AS feature_source, 'all' AS "rows", 'trained' AS raw_charge_transform, 'in-sample' AS sample FROM ft""")
def run_header(spark, d):
    prov = {"use_log_transform": True}
    return report.run_header(S.features(spark, d), prov, "student", "out", ["label"], 1, 10, "label").select("n_events", "n_pixels", "feature_dim", "feature_source", "rows", "raw_charge_transform", "sample")


@query(f"""WITH {_POINTS}, n AS (SELECT event_idx, id, x, y, row_number() OVER (PARTITION BY event_idx ORDER BY id) AS r FROM pt), p0 AS (SELECT * FROM n WHERE r = 1),
d1 AS (SELECT n.*, (n.x - p0.x) ** 2 + (n.y - p0.y) ** 2 AS d FROM n JOIN p0 USING (event_idx)), p1 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY event_idx ORDER BY d DESC, r) = 1 AND count(*) OVER (PARTITION BY event_idx) > 1),
d2 AS (SELECT d1.event_idx, d1.id, d1.r, least(d1.d, (d1.x - p1.x) ** 2 + (d1.y - p1.y) ** 2) AS d FROM d1 JOIN p1 USING (event_idx)), p2 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY event_idx ORDER BY d DESC, r) = 1 AND count(*) OVER (PARTITION BY event_idx) > 2)
SELECT event_idx, id, 0 AS pick FROM p0 UNION ALL SELECT event_idx, id, 1 FROM p1 UNION ALL SELECT event_idx, id, 2 FROM p2""")
def farthest_points(spark, d):
    return neighbors.farthest_points(_points(spark, d).select("event_idx", "id", "x", "y"), 3)


_NEAR150 = "CAST(a.x - b.x AS FLOAT) * CAST(a.x - b.x AS FLOAT) + CAST(a.y - b.y AS FLOAT) * CAST(a.y - b.y AS FLOAT) < CAST(22500 AS FLOAT)"
_KEPT = f"""{_POINTS}, c AS (SELECT a.event_idx, a.id, a.x, a.y, count(*) AS n_near FROM pt a JOIN pt b ON a.event_idx = b.event_idx AND {_NEAR150} GROUP BY 1, 2, 3, 4),
walk AS (SELECT event_idx, id, x, y, n_near, first_value(id) OVER w AS lid, first_value(x) OVER w AS lx, first_value(y) OVER w AS ly FROM c WINDOW w AS (PARTITION BY event_idx ORDER BY n_near DESC, id)
 UNION ALL SELECT event_idx, id, x, y, n_near, first_value(id) OVER w, first_value(x) OVER w, first_value(y) OVER w FROM walk WHERE NOT ({_NEAR150.replace("a.x", "x").replace("a.y", "y").replace("b.x", "lx").replace("b.y", "ly")}) WINDOW w AS (PARTITION BY event_idx ORDER BY n_near DESC, id)),
kp AS (SELECT DISTINCT event_idx, lid AS id FROM walk)"""


@query(f"WITH RECURSIVE {_KEPT} SELECT c.event_idx, c.id, c.n_near, kp.id IS NOT NULL AS kept FROM c LEFT JOIN kp ON kp.event_idx = c.event_idx AND kp.id = c.id")
def suppress_points(spark, d):
    return neighbors.suppress(_points(spark, d).select("event_idx", "id", "x", "y"), 150.0)


@query(f"""WITH RECURSIVE {_KEPT}, m AS (SELECT a.event_idx, a.id AS centre, b.id, b.x - a.x AS dx, b.y - a.y AS dy, row_number() OVER (PARTITION BY a.event_idx, a.id ORDER BY b.q DESC, b.id) - 1 AS slot FROM pt a JOIN kp ON kp.event_idx = a.event_idx AND kp.id = a.id JOIN pt b ON a.event_idx = b.event_idx AND {_NEAR150})
SELECT event_idx, centre, slot, id, dx, dy FROM m WHERE slot < 4""")
def group_tokens(spark, d):
    return neighbors.tokens(_points(spark, d).select("event_idx", "id", "x", "y", "q"), 150.0, 4)


@query(f"""WITH {FEATURES}, ex AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM ft), c AS (SELECT a.p AS i, b.p AS j, covar_samp(a.v, b.v) AS c FROM ex a JOIN ex b ON a.id = b.id GROUP BY 1, 2)
SELECT round(sum(CASE WHEN i = j THEN c ELSE 0 END) ** 2 / sum(c * c), 5) AS participation_ratio, round(sum(CASE WHEN i <> j THEN c * c ELSE 0 END) / sum(c * c), 9) AS off_diagonal FROM c""")
def spectrum_traces(spark, d):
    return metrics.spectrum(S.features(spark, d)).select(F.round("participation_ratio", 5).alias("participation_ratio"), F.round("off_diagonal", 9).alias("off_diagonal"))


def _wires(spark, d):
    end = lambda k: F.named_struct(F.lit("x"), F.when(F.col("n_regionkey") % 2 == 0, 10.0).otherwise(-10.0), F.lit("y"), F.lit(1000.0 * k), F.lit("z"), F.col("n_nationkey") * 40.0 + k * 3)
    wires = S.table(spark, d, "nation").select(F.lit(0).alias("anode"), F.explode(F.array(F.lit(0), F.lit(1))).alias("face"), (F.col("n_regionkey") % 3).alias("plane"), F.col("n_nationkey").alias("seg_pos"), (F.col("n_nationkey") + 100).alias("channel"), end(1).alias("head"), end(0).alias("tail"))
    points = S.table(spark, d, "supplier").selectExpr("s_suppkey AS id", "0 AS anode", "s_acctbal / 100 - 40 AS x", "cast(s_suppkey % 100 AS double) AS y", "s_nationkey * 4.0d AS z")
    return vertices.wire_segments(wires), points


_SEGMENTS = """w AS (SELECT n_nationkey AS pos, n_regionkey % 3 AS plane, CASE WHEN n_regionkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS x, n_nationkey * 4.0 AS az, n_nationkey * 4.0 + 0.3 AS bz FROM nation),
pl AS (SELECT plane, median(x) AS px FROM w GROUP BY 1), pts AS (SELECT s_suppkey AS id, s_acctbal / 100 - 40 AS x, CAST(s_suppkey % 100 AS DOUBLE) AS y, s_nationkey * 4.0 AS z FROM supplier)"""


@query(f"""WITH {_SEGMENTS}, f AS (SELECT pts.*, CASE WHEN pts.x * (SELECT px FROM pl WHERE plane = 2) >= 0 THEN 0 ELSE 1 END AS face FROM pts),
t AS (SELECT f.id, w.plane, w.pos, y, z, az, bz, least(greatest((y * 100.0 + (z - az) * (bz - az)) / (100.0 * 100.0 + (bz - az) * (bz - az)), 0), 1) AS t FROM f, w),
r AS (SELECT id, plane, pos, (y - t * 100.0) * (y - t * 100.0) + (z - (az + t * (bz - az))) * (z - (az + t * (bz - az))) AS d2 FROM t), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id, plane ORDER BY round(d2, 9), pos) = 1)
SELECT f.id, f.face, (SELECT pos + 100 FROM b WHERE b.id = f.id AND plane = 0) AS u, (SELECT pos + 100 FROM b WHERE b.id = f.id AND plane = 1) AS v, (SELECT pos + 100 FROM b WHERE b.id = f.id AND plane = 2) AS w, round(abs(f.x - (SELECT px FROM pl WHERE plane = 2)) / 0.321126 - 0.649, 6) AS tick FROM f""")
def project_points(spark, d):
    """Suppliers as 3-D points onto the wires that nations span."""
    seg, points = _wires(spark, d)
    return vertices.project(points, seg).withColumn("tick", F.round("tick", 6))


@query(f"""WITH {_SEGMENTS} SELECT id, y BETWEEN 50.0 - 5 AND 50.0 + 5 AND z BETWEEN (SELECT min((az + bz) / 2) FROM w) - 5 AND (SELECT max((az + bz) / 2) FROM w) + 5 AND abs(x) < 360 AS inside FROM pts""")
def points_in_volume(spark, d):
    seg, points = _wires(spark, d)
    return vertices.in_volume(points, vertices.wire_boxes(seg)).select("id", "inside")


@query(f"""WITH {PIXELS} SELECT label, count(*) FILTER (WHERE label % 2 = 1) AS removed, count(*) FILTER (WHERE label % 2 = 0) AS kept FROM px GROUP BY 1""")
def split_masked(spark, d):
    from shardloom.operators.augment import split_masked as split

    kept, removed = split(S.pixels(spark, d).withColumn("masked", F.col("label") % 2 == 1))
    rows = removed.select("label", F.lit(1).alias("r"), F.lit(0).alias("k")).unionByName(kept.select("label", F.lit(0).alias("r"), F.lit(1).alias("k")))
    return rows.groupBy("label").agg(F.sum("r").alias("removed"), F.sum("k").alias("kept"))


@query("SELECT n_name AS tap, CASE WHEN n_nationkey % 2 = 0 THEN 'ep' || n_nationkey END AS tag FROM nation")
def checkpoint_tags(spark, d):
    rows = S.table(spark, d, "nation").selectExpr("n_name AS tap", "n_nationkey", "concat('epoch', n_nationkey, '.ckpt') AS file")
    return rows.select("tap", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("ep"), X.digits_of(F.col("file")).cast("string"))).alias("tag"))
