"""Further queries: neighbours within an event, interpolation, projections, vertices, losses of distributions, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import expressions as X
from shardloom.operators import metrics, neighbors, report, vertices
from shardloom.plans import standins as S
from shardloom.plans.standins import EVENTS, FEATURES, PIXELS, RUN_LABELS

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_POINTS = f"{PIXELS}, pt AS (SELECT event_idx, pixel_idx AS id, min(channel) AS x, min(tick) AS y, max(charge) AS q, min(label) AS label FROM px GROUP BY 1, 2)"


def _points(spark, d):
    px = S.pixels(spark, d)
    return px.groupBy("event_idx", F.col("pixel_idx").alias("id")).agg(F.min("channel").alias("x"), F.min("tick").alias("y"), F.max("charge").alias("q"), F.min("label").alias("label"))


_NEAR = f"""{_POINTS}, nb AS (SELECT a.event_idx, a.id AS query, b.id AS neighbour, b.label AS other, b.q AS oq, round(-(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS score FROM pt a JOIN pt b ON a.event_idx = b.event_idx AND a.id <> b.id),
tk AS (SELECT *, row_number() OVER (PARTITION BY event_idx, query ORDER BY score DESC, neighbour) AS rank FROM nb QUALIFY rank <= 3)"""


def _near(spark, d):
    """Points as rows of ``near_in_group``."""
    vec = F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("vec")
    return _points(spark, d).select("event_idx", "id", vec, "label", F.col("q").alias("value"))


@query(f"WITH {_NEAR}, v AS (SELECT event_idx, query, other, count(*) AS n, row_number() OVER (PARTITION BY event_idx, query ORDER BY count(*) DESC, other) AS r FROM tk GROUP BY 1, 2, 3) SELECT event_idx, query, other AS predicted, n AS votes FROM v WHERE r = 1")
def event_knn_vote(spark, d):
    return neighbors.vote_in_group(_near(spark, d).drop("value"), 3, "event_idx")


@query(f"WITH {_NEAR} SELECT event_idx, query, round(sum(oq / (-score + 1e-8)) / sum(1 / (-score + 1e-8)), 4) AS value FROM tk GROUP BY 1, 2")
def interpolate(spark, d):
    return neighbors.interpolate_in_group(_near(spark, d).drop("label"), 3, "event_idx").withColumn("value", F.round("value", 4))


@query(f"WITH {_NEAR} SELECT pt.event_idx, pt.id, round(coalesce(avg(tk.oq), 0), 4) AS value, count(tk.oq) > 0 AS covered FROM pt LEFT JOIN tk ON tk.event_idx = pt.event_idx AND tk.neighbour = pt.id GROUP BY 1, 2".replace("avg(tk.oq)", "avg(tk.score)").replace("count(tk.oq)", "count(tk.score)"))
def local_features(spark, d):
    """Mean of what the groups that hold a point say of it; points in no group have 0."""
    return neighbors.said_in_group(_near(spark, d).drop("label", "value"), 3, "event_idx").withColumn("value", F.round("value", 4))


@query(f"""WITH {_POINTS}, n AS (SELECT event_idx, row_number() OVER (PARTITION BY event_idx ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY event_idx) AS n FROM pt),
g AS (SELECT event_idx, pos, slot, CAST(floor(CAST(('0x' || substr(md5('7:' || event_idx || ':' || pos || ':' || slot), 1, 13)) AS BIGINT) / 4503599627370496.0 * (n - 1)) AS BIGINT) AS drawn FROM n, (VALUES (0), (1)) v(slot) WHERE n > 1)
SELECT event_idx, pos AS query, slot, CASE WHEN drawn >= pos THEN drawn + 1 ELSE drawn END AS neighbour FROM g""")
def random_neighbours(spark, d):
    from pyspark.sql import Window

    rows = _points(spark, d).select("event_idx", (F.row_number().over(Window.partitionBy("event_idx").orderBy("id")) - 1).alias("pos"))
    return neighbors.random_neighbours(rows, 2, 7)


@query(f"""WITH {FEATURES}, z AS (SELECT id, label, unnest(vec) * 4 AS t, unnest(list_reverse(vec)) * 2 AS s, generate_subscripts(vec, 1) AS p FROM ft), m AS (SELECT id, max(t) AS mt, max(s) AS ms FROM z GROUP BY 1),
e AS (SELECT z.id, z.label, exp(t - mt) AS et, s - ms AS ds, exp(s - ms) AS es FROM z JOIN m USING (id)), n AS (SELECT id, sum(et) AS zt, sum(es) AS zs FROM e GROUP BY 1),
r AS (SELECT e.id, any_value(e.label) AS label, -sum(et / zt * (ds - ln(zs))) AS loss, -sum(et / zt * ln(et / zt)) AS te FROM e JOIN n USING (id) GROUP BY 1)
SELECT round((SELECT avg(x) FROM (SELECT avg(loss) AS x FROM r GROUP BY id % 50)), 8) AS loss, round((SELECT avg(x) FROM (SELECT avg(te) AS x FROM r GROUP BY id % 50)), 8) AS teacher_entropy,
 round((SELECT avg(x) FROM (SELECT avg(loss - te) AS x FROM r GROUP BY id % 50)), 8) AS kl, round((SELECT avg(x) FROM (SELECT avg(loss) AS x FROM r WHERE label < 5 GROUP BY id % 50)), 8) AS loss_masked""")
def distribution_loss(spark, d):
    times = lambda v, k: F.transform(v, lambda x: x.cast("double") * k)
    rows = S.features(spark, d).select((F.col("id") % 50).alias("event_idx"), (F.col("label") < 5).alias("is_masked"), times(F.reverse("vec"), 2.0).alias("student"), times("vec", 4.0).alias("teacher"))
    out = metrics.distribution_loss(rows)
    return out.select(*[F.round(c, 8).alias(c) for c in ("loss", "teacher_entropy", "kl", "loss_masked")])


@query(f"""WITH {RUN_LABELS}, p AS (SELECT 'run' || n_nationkey || '_seed0' AS run, n_regionkey AS lr FROM nation) SELECT rl.label, rl.n, p.lr FROM rl LEFT JOIN p ON p.run = split_part(rl.label, ':', 1)""")
def sweep_columns(spark, d):
    points = S.table(spark, d, "nation").select(F.concat(F.lit("run"), "n_nationkey", F.lit("_seed0")).alias("run"), F.col("n_regionkey").alias("lr"))
    return S.labels_of_runs(spark, d).withColumn("run", X.run_of(F.col("label"))).join(points, "run", "left").select("label", "n", "lr")


@query("SELECT n_nationkey AS epoch, n_nationkey IN (SELECT CAST(s_nationkey AS INTEGER) FROM supplier WHERE s_acctbal > 5000) AS present FROM nation WHERE n_nationkey % 2 = 0")
def requested_epochs(spark, d):
    asked = S.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("epoch"))
    found, missing = report.requested(asked, S.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("epoch")))
    return found.withColumn("present", F.lit(True)).unionByName(missing.withColumn("present", F.lit(False)))


@query(f"""WITH {EVENTS} SELECT event_idx, CAST(least(greatest(round_even(sqrt(0.3 * 64 * 100 * exp(nu_energy / 1000000)), 0), 1), 64) AS BIGINT) AS width, CAST(least(greatest(round_even(sqrt(0.3 * 64 * 100 / exp(nu_energy / 1000000)), 0), 1), 100) AS BIGINT) AS height FROM ev""")
def crop_sizes(spark, d):
    w, h = X.crop_size(F.lit(0.3), F.col("nu_energy") / 1000000, 64, 100)
    return S.events(spark, d).select("event_idx", w.alias("width"), h.alias("height"))


@query()
def derive_vertices(spark, d):
    """Line items of an order as its particles."""
    parts = S.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS event_idx", "l_linenumber AS pos", "l_linenumber AS trackid", "CASE l_returnflag WHEN 'A' THEN 13 WHEN 'N' THEN 22 ELSE 2212 END AS pid", "l_linenumber - 1 AS motherid", "l_linenumber - 1 AS proc",
        "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 15 END AS endproc", "0.0d AS start_x", "l_quantity / 10 AS start_y", "double(l_linenumber) AS start_z", "0.0d AS end_x", "l_quantity / 10 AS end_y", "l_linenumber + 1.0d AS end_z", "l_tax AS start_ke", "l_discount / 50 AS end_ke",
    )
    ev = S.events(spark, d).selectExpr("event_idx", "0.0d AS vertex_x", "0.0d AS vertex_y", "0.0d AS vertex_z")
    return vertices.derive_vertices(parts, ev, S.pixels(spark, d).selectExpr("event_idx", "line AS trackid"))
