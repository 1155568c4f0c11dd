"""Queries over features, logs, results and campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import expressions as X
from shardloom.operators import metrics, neighbors, report, series
from shardloom.plans import standins as S
from shardloom.plans.standins import FEATURES, LOG, PIXELS, RUN_LABELS
from shardloom.streaming import logs

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


KNN = f"""{FEATURES}, fn AS (SELECT id, label, vec, greatest(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 1e-8) AS n FROM ft),
nb AS (SELECT a.id AS query, a.label, b.id AS neighbour, b.label AS other, round(list_dot_product(a.vec, b.vec) / (a.n * b.n), 6) AS score FROM fn a JOIN fn b ON a.id <> b.id),
tk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM nb QUALIFY rank <= 20),
vt AS (SELECT query, label, other AS predicted, count(*) AS votes, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, other) AS r FROM tk WHERE rank <= 10 GROUP BY query, label, other)"""


def _neighbours(spark, d, k):
    rows = S.features(spark, d)
    return neighbors.top_k(rows, rows, k), rows


def _votes(spark, d):
    found, rows = _neighbours(spark, d, 10)
    return neighbors.vote(found, rows, ["query"]).join(rows.select(F.col("id").alias("query"), "label"), "query")


@query(f"WITH {KNN} SELECT query, label, predicted, votes FROM vt WHERE r = 1")
def knn_vote(spark, d):
    return _votes(spark, d).select("query", "label", "predicted", "votes")


@query(f"""WITH {KNN} SELECT query, label, CAST(k AS INTEGER) AS k, round(avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END), 9) AS purity FROM tk, (VALUES (1), (5), (10), (20)) v(k) WHERE rank <= k GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY query, label, k"))
def knn_purity(spark, d):
    found, rows = _neighbours(spark, d, 20)
    return neighbors.purity(found, rows, [1, 5, 10, 20]).withColumn("purity", F.round("purity", 9))


_MATRIX = """cm AS (SELECT label AS truth, predicted, count(*) AS n FROM vt WHERE r = 1 GROUP BY 1, 2),
sup AS (SELECT truth AS class, sum(n) AS support FROM cm GROUP BY 1), gs AS (SELECT predicted AS class, sum(n) AS guessed FROM cm GROUP BY 1), ht AS (SELECT truth AS class, n AS hit FROM cm WHERE truth = predicted),
sc AS (SELECT class, CAST(coalesce(support, 0) AS BIGINT) AS support, coalesce(coalesce(hit, 0)::DOUBLE / nullif(guessed, 0), 0) AS precision, coalesce(coalesce(hit, 0)::DOUBLE / nullif(support, 0), 0) AS recall,
 coalesce(2 * coalesce(hit, 0)::DOUBLE / nullif(coalesce(guessed, 0) + coalesce(support, 0), 0), 0) AS f1, coalesce(coalesce(hit, 0)::DOUBLE / nullif(coalesce(guessed, 0) + coalesce(support, 0) - coalesce(hit, 0), 0), 0) AS iou FROM sup FULL JOIN gs USING (class) LEFT JOIN ht USING (class))"""


@query(f"WITH {KNN}, {_MATRIX} SELECT class, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(iou, 9) AS iou FROM sc")
def knn_class_scores(spark, d):
    scores = metrics.class_scores(metrics.confusion(_votes(spark, d), "label"))
    return scores.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query(f"""WITH {KNN}, {_MATRIX} SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(avg(iou), 9) AS macro_iou, count(*) AS n_classes,
 (SELECT round(sum(CASE WHEN truth = predicted THEN n ELSE 0 END)::DOUBLE / sum(n), 9) FROM cm) AS accuracy FROM sc WHERE support > 0""")
def knn_macro_scores(spark, d):
    out = metrics.macro_scores(metrics.confusion(_votes(spark, d), "label"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns if c != "n_classes"], "n_classes")


@query("""SELECT count_if(t AND p) AS tp, count_if(NOT t AND p) AS fp, count_if(t AND NOT p) AS fn, round(count_if(t AND p) / count_if(p), 9) AS precision, round(count_if(t AND p) / count_if(t), 9) AS recall,
 round(2 * count_if(t AND p) / (2 * count_if(t AND p) + count_if(t <> p)), 9) AS f1, round(count_if(t = p) / count(*), 9) AS accuracy, round(count_if(p) / count(*), 9) AS positive_rate
 FROM (SELECT quality = 1 AS t, n_chars > 800 AS p FROM labels JOIN documents USING (doc_id))""")
def binary_scores(spark, d):
    rows = S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = rows.agg(*metrics.binary_scores(F.col("quality") == 1, F.col("n_chars") > 800))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_SCORES = """count_if(t AND p) AS tp, count_if(NOT t AND p) AS fp, count_if(t AND NOT p) AS fn, round(coalesce(count_if(t AND p) / nullif(count_if(p), 0), 0), 9) AS precision, round(coalesce(count_if(t AND p) / nullif(count_if(t), 0), 0), 9) AS recall,
 round(coalesce(2 * count_if(t AND p) / nullif(2 * count_if(t AND p) + count_if(t <> p), 0), 0), 9) AS f1, round(count_if(t = p) / count(*), 9) AS accuracy, round(count_if(p) / count(*), 9) AS positive_rate"""


@query(f"""WITH {PIXELS}, s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CASE WHEN label <> 0 THEN least(greatest(1 - energyfrac, 0), 1) ELSE 0 END > threshold AS t, charge > 30000 AS p FROM px, (VALUES (0.22), (0.12), (0.32)) v(threshold))
SELECT threshold, round(avg(CASE WHEN t THEN 1.0 ELSE 0.0 END), 9) AS prevalence, {_SCORES} FROM s GROUP BY threshold""")
def overlap_sweep(spark, d):
    rows = S.pixels(spark, d).withColumn("c", X.contamination(F.col("label"), F.col("energyfrac")))
    out = metrics.sweep(rows, "c", F.col("charge") > 30000, [0.22, 0.12, 0.32])
    return out.select(*[F.round(c, 9).alias(c) if t == "double" and c != "threshold" else F.col(c) for c, t in out.dtypes])


@query(f"""WITH {PIXELS}, s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, abs(tick - 50) <= threshold AS t, label >= 3 AS p FROM px, (VALUES (20), (10), (30)) v(threshold))
SELECT threshold, round(avg(CASE WHEN t THEN 1.0 ELSE 0.0 END), 9) AS prevalence, {_SCORES} FROM s GROUP BY threshold""")
def vertex_sweep(spark, d):
    rows = S.pixels(spark, d).withColumn("r", F.abs(F.col("tick") - 50))
    out = metrics.sweep(rows, "r", F.col("label") >= 3, [20, 10, 30], strict=False)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" and c != "threshold" else F.col(c) for c, t in out.dtypes])


@query(f"""WITH {PIXELS}, s AS (SELECT event_idx // 8 AS e, tick // 8 AS inst, label = 3 AS ok FROM px), z AS (SELECT *, count(*) OVER (PARTITION BY e, inst) AS size FROM s)
SELECT CASE WHEN size <= 1 THEN 0 WHEN size <= 3 THEN 1 WHEN size <= 9 THEN 2 WHEN size <= 99 THEN 3 WHEN size <= 999 THEN 4 ELSE 5 END AS bin, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END), 9) AS singletons FROM z GROUP BY 1""")
def instance_size_bins(spark, d):
    rows = S.pixels(spark, d).select(F.floor(F.col("event_idx") / 8).alias("e"), F.floor(F.col("tick") / 8).alias("inst"), (F.col("label") == 3).alias("ok"))
    sized = rows.join(rows.groupBy("e", "inst").agg(F.count(F.lit(1)).alias("size")), ["e", "inst"])
    return sized.groupBy(X.size_bin(F.col("size")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("accuracy"), F.round(F.avg((F.col("size") == 1).cast("double")), 9).alias("singletons"))


@query(f"""WITH {FEATURES}, c AS (SELECT label, count(*) AS n FROM ft GROUP BY 1), k AS (SELECT list(label ORDER BY label) AS l, count(*) AS m, max(n) AS mx, sum(n) AS total FROM c)
SELECT (SELECT min(label) FROM c, k WHERE n = mx) AS majority, (SELECT count(*) > 1 FROM c, k WHERE n = mx) AS tied, round(mx / total, 9) AS majority_accuracy,
 (SELECT round(avg(CASE WHEN k.l[1 + CAST(floor(CAST(('0x' || substr(md5('7:' || id), 1, 13)) AS BIGINT) / 4503599627370496.0 * k.m) AS INTEGER)] = label THEN 1.0 ELSE 0.0 END), 9) FROM ft) AS uniform_accuracy, m AS n_classes FROM k""")
def trivial_scores(spark, d):
    out = metrics.trivial_scores(S.features(spark, d), "label", 7, "id")
    return out.select("majority", "tied", F.round("majority_accuracy", 9).alias("majority_accuracy"), F.round("uniform_accuracy", 9).alias("uniform_accuracy"), "n_classes")


@query(f"""WITH {FEATURES}, ex AS (SELECT label, unnest(vec) AS v, generate_subscripts(vec, 1) AS pos FROM ft), m AS (SELECT label, pos, avg(v) AS m FROM ex GROUP BY 1, 2),
ev2 AS (SELECT DISTINCT label FROM ft UNION SELECT -1) SELECT ev2.label, round(list_sum(list(m.m ORDER BY pos)) FILTER (WHERE m.m IS NOT NULL), 6) AS total, count(m.m) AS dims FROM ev2 LEFT JOIN m USING (label) GROUP BY 1""".replace("round(list_sum(list(m.m ORDER BY pos)) FILTER (WHERE m.m IS NOT NULL), 6)", "round(sum(m.m), 6)"))
def mean_pool(spark, d):
    rows = S.features(spark, d)
    groups = rows.select("label").distinct().unionByName(spark.createDataFrame([(-1,)], "label int"))
    out = metrics.mean_pool(rows.select("label", "vec"), groups, "label")
    return out.select("label", F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.coalesce(F.size("mean"), F.lit(0)).cast("long").alias("dims"))


@query(f"""WITH {FEATURES}, ex AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS p FROM ft) SELECT CAST(a.p AS INTEGER) AS i, CAST(b.p AS INTEGER) AS j, round(covar_samp(a.v, b.v), 9) AS cov FROM ex a JOIN ex b ON a.id = b.id AND a.p <= b.p GROUP BY 1, 2""")
def covariance(spark, d):
    return metrics.covariance(S.features(spark, d)).select("i", "j", F.round("cov", 9).alias("cov"))


@query()
def spectrum(spark, d):
    return metrics.spectrum(S.features(spark, d))


@query(f"""WITH {FEATURES}, p AS (SELECT list_dot_product(a.vec, b.vec) AS d, sqrt(list_dot_product(a.vec, a.vec)) AS na, sqrt(list_dot_product(b.vec, b.vec)) AS nb FROM ft a JOIN ft b ON b.id = a.id + 1), c AS (SELECT d / (na * nb) AS c, na / nb AS r FROM p WHERE na > 0 AND nb > 0)
SELECT round(avg(c), 9) AS mean, round(stddev_pop(c), 9) AS std, round(quantile_cont(c, 0.05), 9) AS p05, round(quantile_cont(c, 0.5), 9) AS p50, round(quantile_cont(c, 0.95), 9) AS p95, round(avg(r), 9) AS norm_ratio, count(*) AS n FROM c""")
def teacher_cosine(spark, d):
    a = S.features(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    out = metrics.pair_cosine(a.join(b, "id"), "vec", "other")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns if c != "n"], "n")


@query(f"""WITH {FEATURES}, ex AS (SELECT id, label, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM ft), m AS (SELECT label, p, avg(v) AS m FROM ex GROUP BY 1, 2),
w AS (SELECT label, avg(dd) AS dd FROM (SELECT ex.id, ex.label, sqrt(sum((v - m) * (v - m))) AS dd FROM ex JOIN m USING (label, p) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT a.label AS x, b.label AS y, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dd FROM m a JOIN m b ON a.p = b.p AND a.label < b.label GROUP BY 1, 2)
SELECT round((SELECT avg(dd) FROM w), 6) AS within, round((SELECT avg(dd) FROM b), 6) AS between, round((SELECT avg(dd) FROM b) / (SELECT avg(dd) FROM w), 6) AS separation, (SELECT x FROM b ORDER BY dd LIMIT 1) AS closest_a, (SELECT y FROM b ORDER BY dd LIMIT 1) AS closest_b""")
def class_separation(spark, d):
    out = metrics.class_separation(S.features(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in ("within", "between", "separation")], "closest_a", "closest_b")


@query(f"""WITH {FEATURES}, v AS (SELECT id % 50 AS event_idx, label % 2 AS l, abs(vec[1] - vec[2]) AS x FROM ft) SELECT round(avg(m), 9) AS mean FROM (SELECT event_idx, avg(x) AS m FROM v GROUP BY 1)""")
def charge_loss(spark, d):
    rows = S.features(spark, d).withColumn("event_idx", F.col("id") % 50)
    loss = F.abs(F.col("vec")[0].cast("double") - F.col("vec")[1].cast("double"))
    return metrics.two_stage_mean(rows, loss, "event_idx").select(F.round("mean", 9).alias("mean"))


@query(f"""WITH {FEATURES}, v AS (SELECT id % 50 AS e, vec[1] * 5 AS x, CAST(label % 2 AS DOUBLE) AS t FROM ft), w AS (SELECT e, t, greatest(x, 0) - x * t + ln(1 + exp(-abs(x))) AS bce, 1 / (1 + exp(-x)) AS p FROM v),
f AS (SELECT e, (0.25 * t + 0.75 * (1 - t)) * pow(1 - (p * t + (1 - p) * (1 - t)), 2) * bce AS l FROM w) SELECT round(avg(m), 9) AS mean FROM (SELECT e, avg(l) AS m FROM f GROUP BY 1)""")
def occupancy_loss(spark, d):
    rows = S.features(spark, d).withColumn("e", F.col("id") % 50)
    loss = X.focal_loss(F.col("vec")[0].cast("double") * 5, (F.col("label") % 2).cast("double"), 0.25, 2.0)
    return metrics.two_stage_mean(rows, loss, "e").select(F.round("mean", 9).alias("mean"))


@query(f"""WITH {FEATURES}, v AS (SELECT a.id % 50 AS e, 1 - list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) AS l FROM ft a JOIN ft b ON b.id = a.id + 1) SELECT round(avg(m), 9) AS mean FROM (SELECT e, avg(l) AS m FROM v GROUP BY 1)""")
def distill_loss(spark, d):
    a = S.features(spark, d)
    rows = a.join(a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id").withColumn("e", F.col("id") % 50)
    return metrics.two_stage_mean(rows, 1 - X.cosine(F.col("vec"), F.col("other")), "e").select(F.round("mean", 9).alias("mean"))


@query(f"""WITH {FEATURES}, ex AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) AS p FROM ft) SELECT round(avg(greatest(1 - sqrt(var + 1e-4), 0)), 9) AS var_penalty, (SELECT round(sum(c * c) / 64, 9) FROM (SELECT covar_samp(a.v, b.v) AS c FROM ex a JOIN ex b ON a.id = b.id AND a.p <> b.p GROUP BY a.p, b.p)) AS cov_penalty FROM (SELECT p, var_samp(v) AS var FROM ex GROUP BY 1)""")
def spread_penalties(spark, d):
    cov = metrics.covariance(S.features(spark, d).select("id", "vec"))
    var = F.avg(F.when(F.col("i") == F.col("j"), F.greatest(1 - F.sqrt(F.col("cov") + 1e-4), F.lit(0.0))))
    off = F.sum(F.when(F.col("i") != F.col("j"), 2 * F.col("cov") * F.col("cov")).otherwise(0.0)) / 64
    return cov.agg(F.round(var, 9).alias("var_penalty"), F.round(off, 9).alias("cov_penalty"))


_SINK = "".join(f", k{r} AS (SELECT id, p, q / greatest(sum(q) OVER (PARTITION BY p), 1e-30) / 64 AS q FROM r{r - 1}), r{r} AS (SELECT id, p, q / sum(q) OVER (PARTITION BY id) / n AS q FROM k{r}, (SELECT count(*) AS n FROM ft))" for r in (1, 2, 3))


@query(f"""WITH {FEATURES}, e0 AS (SELECT id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS p FROM ft), r0 AS (SELECT id, p, exp((v - (SELECT max(v) FROM e0)) / 0.5) AS q FROM e0){_SINK}
SELECT id AS "row", p AS col, round(q * (SELECT count(*) FROM ft), 9) AS p FROM r3""")
def sinkhorn(spark, d):
    return metrics.sinkhorn(S.features(spark, d).select(F.col("id").alias("row"), "vec"), 0.5, 3).select("row", F.col("col").cast("long").alias("col"), F.round("p", 9).alias("p"))


@query(f"""WITH {LOG}, g AS (SELECT key AS term, run AS coord, sum(value * CASE WHEN step % 2 = 0 THEN 1 ELSE -1 END) AS g FROM lg GROUP BY 1, 2), n AS (SELECT term, sqrt(sum(g * g)) AS n FROM g GROUP BY 1)
SELECT x.term AS a, y.term AS b, round(sum(x.g * y.g) / (min(na.n) * min(nb.n)), 6) AS cosine, round(avg(CASE WHEN x.g <> 0 AND y.g <> 0 THEN CASE WHEN x.g * y.g < 0 THEN 1.0 ELSE 0.0 END END), 9) AS conflict
FROM g x JOIN g y ON x.coord = y.coord AND x.term < y.term JOIN n na ON na.term = x.term JOIN n nb ON nb.term = y.term GROUP BY 1, 2""")
def term_gradients(spark, d):
    signed = F.col("value") * F.when(F.col("step") % 2 == 0, 1).otherwise(-1)
    parts = S.log(spark, d).groupBy(F.col("key").alias("term"), F.col("run").alias("coord")).agg(F.sum(signed).alias("g"))
    return metrics.pairwise_cosine(parts).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("conflict", 9).alias("conflict"))


@query("""WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '.') || CASE WHEN p_size % 5 = 0 THEN '.bias' ELSE '' END AS name, CAST(floor(p_retailprice) AS BIGINT) AS v FROM part), g(prefix, grp) AS (VALUES ('red', 'warm'), ('red.w', 'warm_w'), ('small', 'size'), ('blue', 'cold'))
SELECT coalesce((SELECT grp FROM g WHERE starts_with(n.name, prefix) ORDER BY length(prefix) DESC LIMIT 1), 'other') AS grp, name LIKE '%bias' OR name LIKE '%norm%' OR name LIKE '%bn%' AS plain, count(*) AS n, round(sqrt(sum(v * v)), 6) AS norm FROM n GROUP BY 1, 2""")
def gradient_groups(spark, d):
    rows = S.table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.when(F.col("p_size") % 5 == 0, ".bias").otherwise("")).alias("name"), F.floor("p_retailprice").alias("v"))
    groups = spark.createDataFrame([("red", "warm"), ("red.w", "warm_w"), ("small", "size"), ("blue", "cold")], "prefix string, grp string")
    named = rows.join(metrics.longest_prefix(rows.select("name").distinct(), groups), "name")
    return named.groupBy("grp", X.is_bias_or_norm(F.col("name")).alias("plain")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm"))


@query(f"WITH {LOG} SELECT key, min(value) AS min, round(quantile_cont(value, 0.05), 9) AS p05, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95, max(value) AS max, round(avg(value), 9) AS mean FROM lg GROUP BY 1")
def order_statistics(spark, d):
    out = metrics.order_statistics(S.log(spark, d), "value", ["key"])
    return out.select("key", "min", "max", *[F.round(c, 9).alias(c) for c in ("p05", "median", "p95", "mean")])


@query(f"WITH {LOG} SELECT run, key, step, round(avg(value) OVER (PARTITION BY run, key ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS smooth FROM lg")
def smooth_series(spark, d):
    return series.smooth(S.log(spark, d), 4, ["run", "key"], ["step"]).select("run", "key", "step", F.round("smooth", 9).alias("smooth"))


@query(f"""WITH {LOG} SELECT run, 'props/k' AS key, step, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM lg""")
def json_series(spark, d):
    rows = S.log(spark, d).select("run", "step", F.parse_json("props").alias("rec"))
    return series.long_form(rows, ["run", "step"]).select("run", F.concat(F.lit("props/"), "key").alias("key"), "step", "value")


@query(f"WITH {LOG} SELECT DISTINCT array_to_string(string_split('loss/' || key || '/run' || run % 3, '/')[1:2], '/') AS family FROM lg")
def key_families(spark, d):
    rows = S.log(spark, d).select(F.concat(F.lit("loss/"), "key", F.lit("/run"), (F.col("run") % 3).cast("string")).alias("key"))
    return series.families(rows, "loss/", 2)


@query(f"WITH {LOG} SELECT run, key, step FROM lg WHERE (key = 'click' AND step < 5000) OR (key <> 'click' AND step <= 5000)")
def resume_truncation(spark, d):
    rows = S.log(spark, d).withColumn("stream", F.when(F.col("key") == "click", "step").otherwise("epoch"))
    return series.truncate(rows, "stream", "step", 5000).select("run", "key", "step")


@query(f"WITH {LOG} SELECT run, max_by(value, step) AS last, max(step) AS last_step, count(*) AS n_steps FROM lg GROUP BY 1")
def last_of_epoch(spark, d):
    return series.last_of_epoch(S.log(spark, d), ["run"], "step", "value")


@query(f"WITH {LOG}, r AS (SELECT step // 5 AS step, key, sum(value) AS v FROM lg GROUP BY 1, 2) SELECT step, key, round(v / 5, 9) AS value FROM r")
def reduce_ranks(spark, d):
    rows = S.log(spark, d).select(F.floor(F.col("step") / 5).alias("step"), "key", "value")
    return series.reduce_ranks(rows, 5, "mean").withColumn("value", F.round("value", 9))


@query(f"WITH {LOG} SELECT key, min(abs(value)) FILTER (WHERE value <> 0) AS floor, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes, min(step) AS first_step, max(step) AS last_step FROM lg GROUP BY 1")
def log_summary(spark, d):
    rows = S.log(spark, d)
    return series.summary(rows, ["key"], "step", F.length("props")).join(rows.groupBy("key").agg(series.smallest_magnitude("value").alias("floor")), "key")


_MOVING = f"""WITH {LOG}, r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY step) AS i, count(*) OVER (PARTITION BY key) AS n FROM lg) SELECT key, max(n) AS n, round(sum(pow(0.9, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.1 END * value), 6) AS mean FROM r GROUP BY 1"""


@query(_MOVING)
def moving_mean(spark, d):
    out = logs.moving_mean_batch(S.log(spark, d), 0.9)
    return out.select("key", "n", F.round("mean", 6).alias("mean"))


@query("""SELECT o_orderkey AS step, CASE WHEN o_orderkey >= 10000 THEN 0.01 WHEN o_orderkey < 100 THEN 0.0 WHEN o_orderkey < 1100 THEN round(0.001 + (1.0 - 0.001) * (o_orderkey - 100) / 999, 9) ELSE round(0.01 + 0.5 * (1.0 - 0.01) * (1 + cos(pi() * (o_orderkey - 1100) / 8900)), 9) END AS lr,
 round(0.04 + (0.07 - 0.04) * least(o_orderkey / 3000, 1), 9) AS temperature, o_orderkey % 50 = 0 AS fires, o_orderkey = 14999 OR o_orderkey IN (10, 20) OR o_orderkey % 1000 = 0 AS saves FROM orders""")
def schedules(spark, d):
    step = F.col("o_orderkey")
    return S.table(spark, d, "orders").select(
        step.alias("step"), F.round(X.cosine_schedule(step, 1.0, 0.01, 10_000, 1000, 0.001, 100), 9).alias("lr"), F.round(X.linear_warmup(step, 0.04, 0.07, 3000), 9).alias("temperature"),
        X.fires(step, 50).alias("fires"), X.should_save(step, 14999, 1000, (10, 20)).alias("saves"),
    )


@query(f"""WITH {RUN_LABELS} SELECT n, CAST(regexp_extract(label, 'ep([0-9]+)', 1) AS INTEGER) AS epoch, split_part(label, ':', 1) AS run, split_part(label, ':', 3) AS source,
 regexp_replace(split_part(label, ':', 1), '[_-](seed|s)[0-9]+$', '') || ':ep' || regexp_extract(label, 'ep([0-9]+)', 1) || ':' || split_part(label, ':', 3) AS family, CAST(trunc(score) AS BIGINT)::VARCHAR AS shown FROM rl""")
def label_parts(spark, d):
    c = F.col("label")
    return S.labels_of_runs(spark, d).select("n", X.epoch_of(c).alias("epoch"), X.run_of(c).alias("run"), X.source_of(c).alias("source"), X.seed_group_of(c).alias("family"), X.formatted(F.col("score"), 0).alias("shown"))


@query(f"""WITH {RUN_LABELS}, f AS (SELECT regexp_replace(split_part(label, ':', 1), '[_-](seed|s)[0-9]+$', '') AS family, score, eval_set_id FROM rl)
SELECT family, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std, array_to_string(list_sort(list(DISTINCT eval_set_id)), '/') AS eval_set_id, count(*) AS n FROM f GROUP BY 1""")
def seed_groups(spark, d):
    rows = S.labels_of_runs(spark, d).withColumn("family", F.regexp_replace(X.run_of(F.col("label")), "[_-](?:seed|s)[0-9]+$", ""))
    out = report.group_seeds(rows, "family", ["score"], ["eval_set_id"])
    return out.withColumn("score_mean", F.round("score_mean", 6)).withColumn("score_std", F.round("score_std", 6))


@query(f"WITH {RUN_LABELS} SELECT 'eval_set_id' AS axis, count(DISTINCT eval_set_id) AS n_values, 'refuse' AS action FROM rl HAVING count(DISTINCT eval_set_id) > 1 UNION ALL SELECT 'label', count(DISTINCT label), 'warn' FROM rl HAVING count(DISTINCT label) > 1")
def comparability(spark, d):
    return metrics.single_valued(S.labels_of_runs(spark, d), ["eval_set_id"], ["label"])


@query("""WITH c AS (SELECT 'r' || n_regionkey AS run, 'k' || n_nationkey % 3 AS key, CAST(max(n_nationkey % 2) AS VARCHAR) AS value FROM nation WHERE NOT (n_regionkey = 4 AND n_nationkey % 3 = 2) GROUP BY 1, 2)
SELECT key, count(DISTINCT value) AS n_values, count(DISTINCT run) AS n_runs FROM c GROUP BY 1 HAVING count(DISTINCT value) > 1 OR count(DISTINCT run) < (SELECT count(DISTINCT run) FROM c)""")
def differing_keys(spark, d):
    n = S.table(spark, d, "nation").where("NOT (n_regionkey = 4 AND n_nationkey % 3 = 2)")
    configs = n.groupBy(F.concat(F.lit("r"), "n_regionkey").alias("run"), F.concat(F.lit("k"), (F.col("n_nationkey") % 3).cast("string")).alias("key")).agg(F.max(F.col("n_nationkey") % 2).cast("string").alias("value"))
    return report.differing_keys(configs)


@query("""WITH m AS (SELECT 'run' || e.event_id % 40 AS label, CASE WHEN e.event_id < 5000 THEN 'early' ELSE 'late' END AS metric, max_by(value, event_id) AS v, max_by(CAST(json_extract(props, '$.k') AS DOUBLE), event_id) AS k FROM events e GROUP BY 1, 2)
SELECT label, max(v) FILTER (WHERE metric = 'early') AS early_f1, max(k) FILTER (WHERE metric = 'late') AS late_k FROM m GROUP BY 1""")
def merge_and_pivot(spark, d):
    rows = S.table(spark, d, "events")
    text = F.to_json(F.create_map(F.concat(F.lit("run"), (F.col("event_id") % 40).cast("string")), F.create_map(F.when(F.col("event_id") < 5000, "early").otherwise("late"), F.struct(F.struct(F.col("value").alias("f1")).alias("0.2"), F.get_json_object("props", "$.k").cast("double").alias("k")))))
    results = report.merge_results(rows.select(F.col("event_id").alias("ord"), text.alias("text")))
    return report.pivot_metrics(results, {"early_f1": ("early", ["0.2", "f1"]), "late_k": ("late", "k")})


@query("""SELECT o_orderkey AS id, substr(sha256(array_to_string(list_sort(['a=' || o_custkey, 'b=' || o_orderstatus, 'seed=' || o_orderkey % 3]), chr(10))), 1, 8) AS hash, 'a=' || o_custkey || ',b=' || o_orderstatus AS replica FROM orders""")
def point_hash(spark, d):
    rows = S.table(spark, d, "orders").selectExpr("o_orderkey AS id", "array(concat('a=', o_custkey), concat('b=', o_orderstatus), concat('seed=', o_orderkey % 3)) AS o", "map('a', string(o_custkey), 'b', o_orderstatus, 'seed', string(o_orderkey % 3)) AS m")
    return rows.select("id", report.point_hash(F.col("o")).alias("hash"), report.replica_label(F.col("m")).alias("replica"))


@query("""SELECT 's' AS sweep_id, CAST(row_number() OVER (ORDER BY a, b) - 1 AS BIGINT) AS point, substr(sha256('lr=' || CASE a WHEN 0 THEN '0.1' ELSE '0.2' END || chr(10) || 'seed=' || b), 1, 8) AS hash, substr(sha256('lr=' || CASE a WHEN 0 THEN '0.1' ELSE '0.2' END), 1, 8) AS replica_group FROM range(2) t(a), range(3) u(b)""")
def sweep_manifest(spark, d):
    return report.manifest(spark, "s", ["lr=0.1,0.2", "seed=range(0,3)"]).select("sweep_id", "point", "hash", "replica_group")


@query(f"WITH {LOG}, a AS (SELECT run FROM lg GROUP BY run HAVING count(*) > 100) SELECT run FROM (SELECT DISTINCT run FROM lg) WHERE run NOT IN (SELECT run FROM a)")
def silent_runs(spark, d):
    rows = S.log(spark, d)
    return series.silent(rows, rows.groupBy("run").count().where("count > 100"))


@query(f"""WITH {LOG}, s AS (SELECT step // 100 AS x, key, max(value) AS v FROM lg GROUP BY 1, 2), r AS (SELECT x, max(v) - min(v) AS d FROM s GROUP BY x HAVING count(DISTINCT key) > 1) SELECT coalesce(bool_and(d <= 1e-9), TRUE) AS agree FROM r""")
def curves_agree(spark, d):
    rows = S.log(spark, d).groupBy(F.floor(F.col("step") / 100).alias("x"), "key").agg(F.max("value").alias("v"))
    return series.agree(rows, "key", "x", "v")


@query("""WITH p AS (SELECT l_orderkey AS event_idx, l_suppkey // 10 AS coord, l_extendedprice AS v FROM lineitem WHERE l_quantity < 10), m AS (SELECT avg(v) AS m, var_pop(v) AS s FROM p)
SELECT coord, count(*) AS n, round(avg((v - m) / sqrt(s)), 6) AS z FROM p, m GROUP BY 1""")
def masked_norm(spark, d):
    rows = S.table(spark, d, "lineitem").select(F.floor(F.col("l_suppkey") / 10).alias("coord"), F.when(F.col("l_quantity") < 10, F.col("l_extendedprice")).alias("v"))
    return metrics.masked_norm(rows, "v").where("v is not null").groupBy("coord").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 6).alias("z"))


@query("""WITH s AS (SELECT event_id // 100 AS step, value AS wait, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events) SELECT step, round(sum(n) / sum(wait), 6) AS samples_per_s, round(coalesce(sum(CASE WHEN n % 2 = 0 THEN wait ELSE 0 END) / nullif(sum(wait), 0), 0), 6) AS wait_share FROM s GROUP BY 1""")
def throughput(spark, d):
    rows = S.table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("step"), F.col("value").alias("wait"), F.get_json_object("props", "$.k").cast("long").alias("n"))
    waits = F.sum(F.when(F.col("n") % 2 == 0, F.col("wait")).otherwise(0.0))
    return rows.groupBy("step").agg(F.round(X.ratio(F.sum("n"), F.sum("wait")), 6).alias("samples_per_s"), F.round(X.ratio(waits, F.sum("wait")), 6).alias("wait_share"))


@query(_MOVING)
def stream_moving_mean(spark, d):
    """The moving mean as a stream over the events table, step by step, equal to the batch answer."""
    import uuid

    from shardloom.sources.tables import shared_dir

    name = f"mm_{uuid.uuid4().hex[:8]}"
    rows = spark.readStream.schema(S.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    out = logs.moving_mean(rows.selectExpr("event_type AS key", "event_id AS step", "value"), 0.9)
    run = out.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).groupBy("key").agg(F.max_by(F.struct("n", "mean"), "n").alias("b")).select("key", "b.n", F.round("b.mean", 6).alias("mean"))
