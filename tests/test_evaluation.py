"""Evaluation sets, pools, probes, sources and reports on small tables."""

import math
import random
from importlib import metadata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import collectors, pools, probes, report
from shardloom.sources import evalset, tables

EVENTS, PIXELS = "event_idx long, event_key string, label int", "event_idx long, channel int, tick int, charge double, pixel_labels int"


@pytest.fixture(scope="module")
def small(spark):
    events = spark.createDataFrame([(i, f"e{i}", i % 3) for i in range(5)], EVENTS)
    pixels = spark.createDataFrame([(i, 10 * i + k, k, float(k), k % 2) for i in range(5) for k in range(i)], PIXELS)
    return events, pixels


def test_eval_set_is_written_once_and_verified(spark, small, tmp_path):
    events, pixels = small
    root = f"file://{tmp_path}/set"
    with pytest.raises(FileNotFoundError):
        evalset.EvalSet.load(spark, root)
    made = evalset.EvalSet.create(spark, root, "small", events, pixels)
    own = evalset.EvalSet.load(spark, root)
    assert own == made and (own.n_events, own.n_pixels) == (5, 10)
    own.verify(spark, root)
    assert own.read(spark, root, "pixels.tick", "pixels.charge").columns == ["event_idx", "tick", "charge"]
    for names, error in ((("pixels.none",), KeyError), (("pixels.tick", "events.label"), ValueError)):
        with pytest.raises(error):
            own.read(spark, root, *names)
    with pytest.raises(Exception, match="already exists"):
        evalset.EvalSet.create(spark, root, "again", events, pixels)
    events.withColumn("event_key", F.concat("event_key", F.lit("x"))).write.mode("overwrite").parquet(f"{root}/events")
    with pytest.raises(ValueError, match="changed"):
        own.verify(spark, root)


def test_eval_set_refuses_what_spoils_it(spark, small, tmp_path):
    events, pixels = small
    bad = {"repeated": (events.unionByName(events.limit(1)), pixels), "no event": (events, pixels.withColumn("event_idx", F.col("event_idx") + 1)),
           "short": (events, pixels.withColumn("pixel_labels", F.when(F.col("tick") > 0, 1))), "without key": (events.withColumn("event_key", F.nullif("event_key", F.lit("e1"))), pixels), "needs events": (events.limit(0), pixels.limit(0))}
    for k, (message, (e, p)) in enumerate(bad.items()):
        with pytest.raises(ValueError, match=message):
            evalset.EvalSet.create(spark, f"file://{tmp_path}/bad{k}", "bad", e, p)
    some = evalset.EvalSet.create(spark, f"file://{tmp_path}/some", "some", events, pixels, most=3)
    assert (some.n_events, some.n_pixels) == (3, 3)


def test_batches(spark, small):
    events, pixels = small
    rows = {r["batch_id"]: r for r in evalset.require_batches(evalset.collated(events.withColumn("batch_id", F.floor(F.col("event_idx") / 2)), pixels)).collect()}
    assert rows[0]["offsets"] == [0, 0, 1] and rows[1]["offsets"] == [0, 2, 5] and rows[1]["event_key"] == ["e2", "e3"]
    assert [tuple(c) for c in rows[1]["coords"]] == [(20, 0), (21, 1), (30, 0), (31, 1), (32, 2)] and rows[1]["pixel_labels"] == [0, 1, 0, 1, 0]
    wrong = spark.createDataFrame([([1, 2], [0, 3], [(1, 1), (2, 2)], [1.0, 2.0])], "event_idx array<int>, offsets array<int>, coords array<struct<a: int, b: int>>, charge array<double>")
    with pytest.raises(Exception, match="disagree"):
        evalset.require_batches(wrong).collect()


def test_alignment(spark, small):
    pixels = evalset.numbered(small[1])
    evalset.require_aligned(pixels, pixels)
    evalset.require_aligned(pixels.select("event_idx", F.floor(F.col("channel") / 2).alias("channel"), F.floor(F.col("tick") / 2).alias("tick")).distinct(), pixels, 2)
    for bad, stride in ((pixels.where("tick <> 1"), 1), (pixels.withColumn("pos", F.col("pos") * 2), 1), (pixels, 2)):
        with pytest.raises(RuntimeError, match="not those of the source"):
            evalset.require_aligned(bad, pixels, stride)


def test_pools_are_checked_and_never_redrawn(spark, small):
    spec = pools.PoolSpec.from_dict({**pools.PoolSpec(seed=3, per_class=2).as_dict(), "newer": 1})
    assert spec == pools.PoolSpec(seed=3, per_class=2)
    spec.check("pid", per_class=2, overlap_thresholds=[0.2, 0.1, 0.3])
    with pytest.raises(ValueError, match="per_class"):
        spec.check("pid", per_class=3)
    pixels = small[1].withColumnRenamed("pixel_labels", "label").withColumn("pixel_idx", F.col("channel"))
    drawn = pools.draw_pools(pixels, small[0], spec)
    assert set(spec.notes) == {"overlap", "instance", "vertex"} and pools.pool(drawn, "event_sample").count() == 10
    with pytest.raises(KeyError, match="overlap_val"):
        pools.pool(drawn, "overlap_val")
    bare = pools.PoolSpec()
    assert pools.draw_pools(pixels.drop("label"), small[0], bare).count() == 0 and bare.notes.keys() == {"all"}


def blobs(spark, n, classes, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(5) * [1, 5, 1, 1, 0] + [3 * (i % classes), 0, 1 - i % 2, 7, 4]).tolist(), i % classes) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>, class int")


def test_standardised_is_by_training_rows(spark):
    a, b = blobs(spark, 50, 2, 0), blobs(spark, 20, 2, 1)
    x, y = (np.array([r["vec"] for r in t.orderBy("id").collect()]) for t in (a, b))
    scale = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1)
    for got, want in zip(probes.standardised(a, b), ((x - x.mean(axis=0)) / scale, (y - x.mean(axis=0)) / scale), strict=True):
        assert np.array([r["vec"] for r in got.orderBy("id").collect()]) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="no training rows"):
        probes.standardised(a.limit(0), b)


def test_linear_head_against_a_plain_fit(spark):
    train, val = probes.standardised(blobs(spark, 200, 2, 0).withColumn("y", F.col("class")), blobs(spark, 100, 2, 1).withColumn("y", F.col("class")))
    x, t = (np.array([r[c] for r in train.orderBy("id").collect()], float) for c in ("vec", "y"))
    w, b, sign = np.zeros(5), 0.0, 2 * t - 1
    for step in range(1, 4001):  # subgradients of the mean hinge loss and the ridge of cost 1
        on = sign * (x @ w + b) < 1
        w = w - (w / (len(x) * probes.COST) - (sign[on, None] * x[on]).sum(axis=0) / len(x)) / math.sqrt(step)
        b += sign[on].sum() / len(x) / math.sqrt(step)
    got = probes.svm_predictions(train, val).orderBy("id").collect()
    same = [(np.dot(w, r["vec"]) + b > 0) == (r["predicted"] == 1) for r in got]
    assert np.mean(same) >= 0.97 and np.mean([r["predicted"] == r["y"] for r in got]) >= 0.85


def test_probes_score_separable_classes(spark):
    train, val = blobs(spark, 240, 3, 2), blobs(spark, 120, 3, 3)
    each, macro = probes.pid_scores(train, val, [0, 1, 2], [0, 2], 1)
    assert {(r["head"], r["class"]): r["support"] for r in each.collect()} == {(h, c): 40 for h in ("svm", "mlp") for c in range(3)}
    rows = {r["head"]: r for r in macro.collect()}
    assert rows["mlp"]["accuracy"] >= 0.8 and rows["mlp"]["n_classes"] == 2
    named = {r["head"]: r["by_name"] for r in probes.named_scores(each, {0: "a", 1: "b", 2: "c"}, "f1").collect()}
    assert set(named["svm"]) == {"a", "b", "c"}
    out = probes.threshold_probe([train, train], val.withColumn("class", F.col("class").cast("double")), "class", [0.5, 1.5], 1).collect()
    assert {(r["threshold"], round(r["prevalence"], 3)) for r in out} == {(0.5, 0.667), (1.5, 0.333)} and min(r["accuracy"] for r in out) >= 0.85
    with pytest.raises(ValueError, match="one class"):
        probes.binary_probe(train, val, F.col("class") > 9, 1)


def test_stages_go_on_after_a_failure():
    done, failed = probes.run_stages({"ok": lambda s: s + 1, "bad": lambda s: 1 / 0}, {"a": 1, "b": 2})
    assert done == {("a", "ok"): 2, ("b", "ok"): 3} and set(failed) == {("a", "bad"), ("b", "bad")} and "ZeroDivisionError" in failed["a", "bad"]


def test_sources_refuse_what_they_lack(spark, tmp_path):
    px = spark.createDataFrame([(1, 2, 3, 1.0, 1, 0)], "event_idx long, channel int, tick int, charge double, pixel_labels int, shard int")
    px.write.partitionBy("shard").parquet(f"{tmp_path}/s")
    px.drop("shard", "pixel_labels").withColumn("group", F.lit("g1")).write.partitionBy("group").parquet(f"{tmp_path}/d/pixels")
    for options, message in (({"backend": "sharded", "path": f"{tmp_path}/s", "shards": [0, 4]}, "no shards"), ({"backend": "sharded", "path": f"{tmp_path}/s", "rich": True}, "lacks"), ({"backend": "direct", "path": f"{tmp_path}/d", "groups": ["g2"]}, "no groups")):
        with pytest.raises(ValueError, match=message):
            tables.build(spark, **options)
    assert tables.build(spark, "direct", f"{tmp_path}/d", groups=["g1"]).columns == ["event_idx", "channel", "tick", "charge"]


def test_results_with_quotes_come_back(spark, tmp_path):
    results = spark.createDataFrame([('run"1\\:ep1:s', 'm"x', '{"f1": 0.5}'), ('run"1\\:ep1:s', "n", "[1]")], "label string, metric string, body string")
    report.write_results(results, f"{tmp_path}/r")
    back = report.merge_results(tables.read_results(spark, [str(next((tmp_path / "r").glob("part-*.txt")))]) if len(list((tmp_path / "r").glob("part-*.txt"))) == 1 else spark.read.text(f"{tmp_path}/r").select(F.lit(0).alias("ord"), F.col("value").alias("text")))
    assert sorted((r["label"], r["metric"]) for r in back.select("label", "metric").collect()) == [('run"1\\:ep1:s', 'm"x'), ('run"1\\:ep1:s', "n")]
    with pytest.raises(FileNotFoundError):
        report.read_manifest(spark, f"{tmp_path}/none")


def test_small_helpers(spark, tmp_path, monkeypatch):
    assert report.charge_spec({"min_val": 1, "max_val": 2e4}) == ("log[1,20000]", {"kind": "log", "min_val": 1.0, "max_val": 20000.0})
    assert report.charge_spec({"min_val": 1}) == report.charge_spec(None) == report.charge_spec({"enabled": False, "min_val": 1, "max_val": 2}) == ("none", {})
    assert report.take_option(["a", "x=1", "--x", "x", "2", "b"], "x") == ("2", ["a", "--x", "b"]) and report.take_option([], "x", "d") == ("d", [])
    meta = report.run_metadata(spark, {"a": {"b": [1, 2]}}, ["x=1"])
    assert {(r["section"], r["key"]) for r in meta.collect()} >= {("config", "a.b[1]"), ("launch", "args"), ("environment", "spark")}
    report.write_run(meta, f"{tmp_path}/run")
    with pytest.raises(Exception, match="already exists"):
        report.write_run(meta, f"{tmp_path}/run")
    prov = spark.sql("SELECT named_struct('apa', 0, 'view', 'w', 'rows', 'all', 'eval_set_id', 's', 'event_key_hash', 'h', 'checkpoint', 'c', 'checkpoint_sha256', 'x', 'git_sha', 'g', 'charge_transform', 'log', 'extract_seconds', 1.0, 'events_per_second', 2.0, 'params', named_struct('kind', 'log', 'min_val', 1, 'max_val', 9), 'extra', named_struct('epoch', 4, 'module', named_struct('backbone', 'b'))) AS p")
    flat = prov.select(report.flat_provenance(F.col("p"), F.lit("in-sample")).alias("f")).first()["f"].asDict()
    assert (flat["epoch"], flat["backbone_name"], flat["use_log_transform"], flat["feat_max_val"], flat["sample"]) == ("4", "b", True, 9.0, "in-sample")
    (tmp_path / "runs/a/probes").mkdir(parents=True)
    (tmp_path / "runs/a/probes/x.json").write_text("{}")
    (tmp_path / "runs/a/other.json").write_text("{}")
    found = report.result_files(spark, [f"{tmp_path}/runs"]).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["x.json"]
    import hashlib

    assert report.file_digest(spark, found[0]["path"]).first()["sha256"] == hashlib.sha256(b"{}").hexdigest()
    assert [r[0] for r in spark.sql("SELECT array(1, 2, 3, 4) AS c UNION ALL SELECT array()").select(report.uniform_chance(F.col("c"))).collect()] == [0.25, None]

    class Found(collectors.Collector):
        pass

    point = type("P", (), {"name": "found", "load": lambda self: Found})()
    monkeypatch.setattr(metadata, "entry_points", lambda group: [point] if group == "shardloom.collectors" else [])
    assert collectors.load_plugins() == ["found"] and isinstance(collectors.build({"found": {}})["found"], Found)
    point.load = lambda: random.Random
    with pytest.raises(ValueError, match="two collectors"):
        collectors.load_plugins()
    assert collectors.STEP.names == ["step", "epoch", "end_of_epoch", "key", "value"]
