"""Operators on small hand-made tables, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.functions import expressions as X
from shardloom.operators import augment, collectors, metrics, neighbors, relational, report, sampling, series, vertices
from shardloom.sources import tables
from shardloom.streaming import logs


def one(df):
    return df.first().asDict()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_event_class_puts_neutral_currents_first(spark):
    df = spark.createDataFrame([(14, 0), (-14, 1), (12, 0), (16, 0), (16, 1)], "pdg int, ccnc int")
    assert [r[0] for r in df.select(X.event_class(F.col("pdg"), F.col("ccnc"))).collect()] == [0, 2, 1, -1, 2]


def test_views(spark):
    assert X.view_range("w") == (1600, 2650)
    with pytest.raises(ValueError):
        X.view_range("x")


def test_truth_join_last_wins_and_rounds_half_even(spark):
    px = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "event_idx int, channel int")
    truth = spark.createDataFrame([(1, 5, 1.0, 0), (1, 5, 2.5, 1), (1, 7, 3.5, 0)], "event_idx int, channel int, label double, pos int")
    got = relational.truth_join(px, truth, ["event_idx", "channel"], {"label": "int"}, [F.col("pos")])
    assert rows(got, "channel") == [(1, 5, 2), (1, 6, 0), (1, 7, 4)]


def test_lookup_order(spark):
    ids = spark.createDataFrame([(1,), (-7,), (7,), (0,), (9,)], "id int")
    high = spark.createDataFrame([(-7, 22), (1, 13)], "k int, v int")
    low = spark.createDataFrame([(1, 99), (7, 11), (0, 5)], "k int, v int")
    got = relational.lookup_with_fallback(ids, "id", high, low, "k", "v", "pdg")
    assert rows(got, "id") == [(-7, 22), (0, 0), (1, 13), (7, 11), (9, 0)]


def test_gather_refuses_misses(spark):
    ask = spark.createDataFrame([(1,), (2,)], "k int")
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(relational.gather(ask, have, ["k"], "drop"), "k") == [(1, "a")]
    with pytest.raises(Exception, match="no row at 2"):
        relational.gather(ask, have, ["k"]).collect()


def test_ball_is_strict(spark):
    q = spark.createDataFrame([(0, 0, 0, 0)], "event_idx int, id int, x int, y int")
    r = spark.createDataFrame([(0, 1, 3, 4), (0, 2, 5, 0), (0, 3, 4, 2), (0, 4, -3, 3)], "event_idx int, id int, x int, y int")
    assert [x[2] for x in rows(neighbors.ball(q, r, 5.0, ["event_idx"]), "neighbour")] == [3, 4]


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_blocks_agree_with_brute_force(spark, block):
    v = np.random.default_rng(0).standard_normal((40, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = [(i, j, r + 1) for i in range(40) for r, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (-s[i, j], j))[:3])]
    got = neighbors.top_k(df, df, 3, block=block).select("query", "neighbour", "rank")
    assert rows(got, "query", "rank") == want


def test_vote_ties_to_smallest(spark):
    nb = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 4)], "query long, neighbour long")
    lab = spark.createDataFrame([(1, 5), (2, 5), (3, 2), (4, 2)], "id long, label int")
    assert rows(neighbors.vote(nb, lab, ["query"]), "query") == [(0, 2, 2)]


def test_farthest_and_suppress(spark):
    pts = spark.createDataFrame([(0, i, x, 0) for i, x in enumerate([0, 1, 9, 10, 5])], "event_idx long, id long, x long, y long")
    assert [r[1] for r in rows(neighbors.farthest_points(pts, 3), "pick")] == [0, 3, 4]
    got = rows(neighbors.suppress(pts, 2.0), "id")
    assert [r[1] for r in got if r[3]] == [0, 2, 4] and [r[2] for r in got] == [2, 2, 2, 2, 1]


def test_class_scores_without_predictions(spark):
    m = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (2, 0, 2)], "truth int, predicted int, n long")
    got = {r["class"]: r for r in metrics.class_scores(m).collect()}
    assert got[2]["precision"] == 0 and got[2]["f1"] == 0 and got[0]["recall"] == 0.75 and got[1]["support"] == 0
    assert one(metrics.macro_scores(m))["n_classes"] == 2 and one(metrics.macro_scores(m))["accuracy"] == 0.5


def test_offsets_of_counts(spark):
    c = spark.createDataFrame([(0, 3), (1, 2), (2, 0), (70000, 4)], "e long, n long")
    assert [(r["start"], r["stop"]) for r in metrics.offsets(c, "e").orderBy("e").collect()] == [(0, 3), (3, 5), (5, 5), (5, 9)]


def test_mean_pool_of_empty_event(spark):
    v = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0])], "event_idx int, vec array<double>")
    e = spark.createDataFrame([(0,), (1,)], "event_idx int")
    assert rows(metrics.mean_pool(v, e), "event_idx") == [(0, [2.0, 4.0]), (1, None)]


def test_spectrum_against_numpy(spark):
    v = np.random.default_rng(1).standard_normal((60, 4)) * [3, 1, 0.5, 0.1]
    got = one(metrics.spectrum(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")))
    w = np.linalg.eigvalsh(np.cov(v.T))[::-1]
    p = w / w.sum()
    assert got["participation_ratio"] == pytest.approx(w.sum() ** 2 / (w**2).sum()) and got["rank_me"] == pytest.approx(math.exp(-(p * np.log(p)).sum()))
    assert got["dims_90"] == int(np.searchsorted(np.cumsum(p), 0.9) + 1) and got["condition_number"] == pytest.approx(w[0] / w[-1])


def test_key_digest_of_nothing(spark):
    import hashlib

    assert one(metrics.key_digest(spark.createDataFrame([], "k string"), "k"))["digest"] == hashlib.sha256(b"").hexdigest()
    assert one(metrics.key_digest(spark.createDataFrame([("b",), ("a",)], "k string"), "k"))["digest"] == hashlib.sha256(b"a\nb\n").hexdigest()


def test_comparability_refuses(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("", "y")], "eval_set_id string, tag string")
    with pytest.raises(ValueError, match="eval_set_id"):
        metrics.require_comparable(df, ["eval_set_id"], ["tag"])
    assert metrics.require_comparable(df.where("eval_set_id <> 'b'"), ["eval_set_id"], ["tag"]) == ["2 values of tag"]


def test_event_split_and_shards(spark):
    ev = spark.range(101).withColumnRenamed("id", "event_idx")
    assert sampling.event_split(ev, 3, 0.8).where("is_train").count() == 80
    shards = sampling.exact_shards(ev, 25, 3, "event_idx").groupBy("shard").count()
    assert rows(shards, "shard") == [(0, 25), (1, 25), (2, 25), (3, 25), (4, 1)]


def test_readers_get_equal_shares(spark):
    got = sampling.reader_shards(spark.range(10).withColumnRenamed("id", "shard"), 4, 1, 0)
    assert rows(got.groupBy("reader").count(), "reader") == [(i, 3) for i in range(4)] and got.select("shard").distinct().count() == 10


def test_smooth_even_window(spark):
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([1, 2, 6, 3])], "run string, step int, value double")
    assert [r[-1] for r in rows(series.smooth(df, 2, ["run"], ["step"]), "step")] == [1.5, 3.0, pytest.approx(11 / 3), 4.5]
    assert [r[-1] for r in rows(series.smooth(df, 1, ["run"], ["step"]), "step")] == [1, 2, 6, 3]


def test_truncation_boundaries(spark):
    df = spark.createDataFrame([(s, k) for s in ("step", "epoch") for k in (9, 10, 11, None)], "stream string, step long")
    got = rows(series.truncate(df, "stream", "step", 10), "stream", "step")
    assert got == [("epoch", None), ("epoch", 9), ("epoch", 10), ("step", None), ("step", 9)]


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None, [1] * 3), (2, 0.5, True, [1] * 99)], "step long, loss double, ok boolean, a array<int>")
    tables.write_log(df, str(tmp_path / "log"))
    (tmp_path / "log" / "half.txt").write_text('\n{"step": 3, "lo')
    log = tables.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 2
    assert rows(series.long_form(log, ["line"]).select("key", "value"), "key", "value") == [("loss", 0.5), ("step", 1.0), ("step", 2.0)]
    assert rows(tables.log_schema(log), "key") == [("a", 1), ("loss", 1), ("ok", 1), ("step", 2)]
    assert tables.read_log(spark, str(tmp_path / "none")).count() == 0


def test_results_merge_and_dig(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"r:ep3:s": {"pid": {"0.2": {"f1": 0.5}}, "knn": {"acc": 1}}}')
    (tmp_path / "b.json").write_text('{"r:ep3:s": {"pid": {"0.2": {"f1": 0.7}}}, "q:ep1:s": {"knn": {"acc": 2}}}')
    (tmp_path / "c.json").write_text("broken")
    files = tables.read_results(spark, [str(tmp_path / n) for n in ("a.json", "b.json", "c.json")])
    merged = report.merge_results(files)
    got = report.pivot_metrics(merged, {"f1": ("pid", ["0.2", "f1"]), "acc": ("knn", "acc"), "none": ("x", "y")})
    assert rows(got, "label") == [("q:ep1:s", None, 2.0, None), ("r:ep3:s", 0.7, 1.0, None)]
    assert report.populated(got, ["f1", "acc", "none"]) == ["f1", "acc"] and rows(report.unmapped(merged, ["pid"]), "metric") == [("knn",)]


def test_labels(spark):
    df = spark.createDataFrame([("run_seed3:ep12:teacher",), ("ep4x:best:s",), ("plain",)], "l string")
    c = F.col("l")
    got = [tuple(r) for r in df.select(X.epoch_of(c), X.run_of(c), X.source_of(c), X.seed_group_of(c)).collect()]
    assert got == [(12, "run_seed3", "teacher", "run:ep12:teacher"), (4, "ep4x", "s", "ep4x:ep4:s"), (-1, "plain", "", "plain:ep-1:")]


def test_seed_groups_of_rounded_values(spark):
    df = spark.createDataFrame([("a", 0.12344), ("a", 0.12346), ("b", 1.0)], "family string, f1 double").withColumn("t", F.lit("x"))
    got = {r["family"]: r for r in report.group_seeds(df, "family", ["f1"], ["t"]).collect()}
    assert got["a"]["f1_mean"] == pytest.approx((0.1234 + 0.1235) / 2) and got["b"]["f1_std"] is None and got["a"]["n"] == 2


def test_config_difference_and_manifest(spark):
    assert report.flatten({"a": {"b": [1, {"c": 2}]}}) == {"a.b[0]": 1, "a.b[1].c": 2}
    table = report.config_table(spark, {"x": {"lr": 1, "run": {"name": "x"}, "only": 1}, "y": {"lr": 2, "run": {"name": "y"}}})
    assert [r[0] for r in rows(report.differing_keys(table), "key")] == ["lr", "only"]
    m = report.manifest(spark, "s", ["lr=1,2", "seed=range(0,2)"])
    assert m.count() == 4 and m.select("replica_group").distinct().count() == 2
    with pytest.raises(ValueError):
        report.manifest(spark, "s", ["seed=range(0,9)"], most=5)


def test_vertices_of_a_decay(spark):
    cols = "event_idx long, pos int, trackid int, pid int, motherid int, proc int, endproc int, start_x double, start_y double, start_z double, end_x double, end_y double, end_z double, start_ke double, end_ke double"
    parts = spark.createDataFrame([(1, 0, 1, 13, 0, 0, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, 0.1, 0.0), (1, 1, 2, 11, 1, 2, 0, 0.0, 0.0, 10.2, 0.0, 0.0, 14.0, 0.03, 0.01)], cols)
    ev = spark.createDataFrame([(1, 5.0, 5.0, 5.0)], "event_idx long, vertex_x double, vertex_y double, vertex_z double")
    both = spark.createDataFrame([(1, 1), (1, -2)], "event_idx long, trackid int")
    got = rows(vertices.derive_vertices(parts, ev, both).select("pos", "z", "type", "parent"), "pos")
    assert got == [(0, 0.0, 0, 0), (1, 10.0, 1, 1)]
    got = rows(vertices.derive_vertices(parts, ev, both.where("trackid = 1")).select("pos", "z", "type", "parent"), "pos")
    assert got == [(0, 0.0, 0, 0), (1, 10.0, 5, 1)]


def test_merge_is_greedy():
    place, identity = vertices.merged(np.array([[0.0, 0, 0], [0.9, 0, 0], [1.8, 0, 0]]), np.array([2, 1, 0]))
    assert place.tolist() == [0, 2] and identity.tolist() == [1, 2]
    assert vertices.apart(np.array([[0.0, 0, 0], [4, 0, 0], [8, 0, 0]])).tolist() == [True, False, True]


def slow_vertices(parts, vertex, pixels):
    """The rules one by one, over lists of dicts; starts, ends and energies in single precision."""
    f, dist = (lambda x: float(np.float32(x))), (lambda a, b: math.dist(a, b))
    start, end = (lambda p: [f(p[f"start_{a}"]) for a in "xyz"]), (lambda p: [f(p[f"end_{a}"]) for a in "xyz"])
    shown = Counter(abs(t) for t in pixels if t)
    primary = [start(p) for p in parts if p["proc"] == 0]
    found = [([float(np.median(x)) for x in zip(*primary, strict=True)] if primary else list(vertex), 0, 0)]
    for p in parts:
        kind = vertices.END_PROCESS.get(p["endproc"])
        near = [d for d in parts if p["trackid"] and d["motherid"] == p["trackid"] and dist(start(d), end(p)) <= 1.0]
        if kind in vertices.LISTED and near and len({abs(q["trackid"]) for q in [p, *near]} & set(shown)) >= 2:
            if kind != 2 or sum(f(d["start_ke"]) for d in near if abs(d["pid"]) in vertices.CHARGED) >= 0.02:
                found.append((end(p), kind, p["trackid"]))
    found += [(end(p), 5, p["trackid"]) for p in parts if abs(p["pid"]) in vertices.STOPPING and f(p["end_ke"]) <= 0.002 and dist(end(p), start(p)) >= 3 and abs(p["trackid"]) in shown]
    seeds = []
    for p in parts:
        n = shown[abs(p["trackid"])] + sum(shown[abs(d["trackid"])] for d in parts if d["motherid"] == p["trackid"])
        if p["pid"] == 22 and f(p["start_ke"]) >= f(0.01) and dist(end(p), vertex) > 2 and n >= 50:
            seeds.append((-n, p["pos"], end(p), p["trackid"]))
    far = []
    for _, _, at, parent in sorted(seeds):
        if all(dist(at, x[0]) > 5 for x in far):
            far.append((at, 3, parent))
    out = []
    for at, kind, parent in found + far:
        near = [i for i, x in enumerate(out) if dist(x[0], at) <= 1.0]
        if not near:
            out.append((at, kind, parent))
        elif kind < out[near[0]][1]:
            out[near[0]] = (out[near[0]][0], kind, parent)
    return [(round(at[0], 4), kind, parent) for at, kind, parent in out]


def test_vertices_against_the_rules(spark):
    rng, parts, pixels = random.Random(4), [], []
    for e in range(60):
        for k in range(rng.choice([0, 1, 4, 9])):
            at = [rng.randrange(12) for _ in range(6)]
            parts.append({"event_idx": e, "pos": k, "trackid": k + 1, "pid": rng.choice([13, 22, 22, 211, 11, 2212]), "motherid": rng.randint(0, k), "proc": rng.choice([0, 1, 2]), "endproc": rng.choice([1, 15, 9, 7, 0]),
                          **{f"{s}_{a}": float(at[i]) for i, (s, a) in enumerate((s, a) for s in ("start", "end") for a in "xyz")}, "start_ke": rng.choice([0.001, 0.015, 0.1]), "end_ke": rng.choice([0.0, 0.01])})
            if k and rng.random() < 0.6:
                parts[-1] |= {f"start_{a}": parts[-1 - k + parts[-1]["motherid"] - 1][f"end_{a}"] for a in "xyz"} if parts[-1]["motherid"] else {}
            pixels += [(e, rng.choice([1, -1]) * (k + 1))] * rng.choice([0, 3, 40, 70])
    ev = [(e, 1.0, 2.0, 3.0) for e in range(61)]
    cols = ", ".join(f"{c} {'long' if c == 'event_idx' else 'double' if '_' in c else 'int'}" for c in parts[0])
    got = vertices.derive_vertices(spark.createDataFrame([tuple(p.values()) for p in parts], cols), spark.createDataFrame(ev, "event_idx long, vertex_x double, vertex_y double, vertex_z double"), spark.createDataFrame(pixels, "event_idx long, trackid int"))
    found = {}
    for r in got.orderBy("event_idx", "pos").collect():
        found.setdefault(r["event_idx"], []).append((round(r["x"], 4), r["type"], r["parent"]))
    assert found == {e: slow_vertices([p for p in parts if p["event_idx"] == e], (1.0, 2.0, 3.0), [t for x, t in pixels if x == e]) for e in range(61)}
    assert {k for v in found.values() for _, k, _ in v} == {0, 1, 2, 3, 4, 5}


def test_null_groups_are_one(spark):
    pts = spark.createDataFrame([(None, i, float(i), 0.0) for i in range(4)] + [(0, 9, 1.0, 1.0), (2**53 + 1, 7, 1.0, 1.0), (2**53, 8, 1.0, 1.0)], "event_idx long, id long, x double, y double")
    got = sorted(map(tuple, neighbors.farthest_points(pts, 2).collect()), key=repr)
    assert got == sorted([(None, 0, 0), (None, 3, 1), (0, 9, 0), (2**53 + 1, 7, 0), (2**53, 8, 0)], key=repr)


def test_percentiles_of_ties_and_groups(spark):
    rng = random.Random(1)
    values = [(rng.choice(["a", "b", None]), float(rng.choice([1, 1, 1, 2, 5, 9.5, rng.random()]))) for _ in range(400)] + [("c", 4.0), ("d", None)]
    got = {r["k"]: (r["p"], r["q"]) for r in metrics.percentiles(spark.createDataFrame(values, "k string, v double"), "v", {"p": 0.05, "q": 0.5}, ["k"]).collect()}
    want = {k: tuple(np.percentile([v for x, v in values if x == k], [5, 50])) for k in ("a", "b", None, "c")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_nearest_in_blocks(spark):
    rng = random.Random(2)
    segs = [(i, i % 3, *[rng.uniform(0, 9) for _ in range(4)]) for i in range(50)]
    pts = [(i, i % 3, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(40)] + [(99, 7, 1.0, 1.0)]
    s = spark.createDataFrame(segs, "pos int, g int, ay double, az double, by double, bz double").withColumn("channel", F.col("pos") + 100)
    p = spark.createDataFrame(pts, "id int, g int, y double, z double")
    found = [sorted(map(tuple, relational.nearest(p, s, ["id"], "y", "z", "pos", "channel", ["g"], most).collect())) for most in (1000, 7)]
    assert found[0] == found[1] and found[0][-1] == (99, None, None)
    joined = p.join(s, "g").withColumn("d2", relational.segment_distance2(*[F.col(c) for c in ("y", "z", "ay", "az", "by", "bz")])).groupBy("id").agg(F.min(F.struct("d2", "pos")).alias("b"))
    assert {r["id"]: (r["b"]["pos"] + 100, pytest.approx(r["b"]["d2"])) for r in joined.collect()} == {i: (c, d) for i, c, d in found[0] if c is not None}


def test_row_norm(spark):
    got = one(spark.createDataFrame([([1.0, 2.0, 6.0],)], "v array<double>").select(metrics.row_norm(F.col("v"), 0.0).alias("n"), metrics.row_norm(F.lit(None).cast("array<double>")).alias("none")))
    x = np.array([1.0, 2.0, 6.0])
    assert got["n"] == pytest.approx(((x - x.mean()) / x.std()).tolist()) and got["none"] is None


def test_projection(spark):
    wires = spark.createDataFrame([(0, 0, p, i, 100 * p + i, (10.0, 0.0, 100.0 * i), (10.0, 1000.0, 100.0 * i)) for p in range(3) for i in range(5)],
                                  "anode int, face int, plane int, seg_pos int, channel int, head struct<x:double,y:double,z:double>, tail struct<x:double,y:double,z:double>")
    seg = vertices.wire_segments(wires)
    pts = spark.createDataFrame([(1, 0, 5.0, 50.0, 21.0), (2, 0, 5.0, 50.0, 15.0)], "id long, anode int, x double, y double, z double")
    assert rows(vertices.project(pts, seg, 0.5, 0.0), "id") == [(1, 0, 2, 102, 202, 8.0), (2, 0, 1, 101, 201, 8.0)]
    assert [r[-1] for r in rows(vertices.in_volume(pts.withColumn("y", F.col("y") + 6), vertices.wire_boxes(seg)), "id")] == [False, False]


def test_wires_from_json(spark, tmp_path):
    import bz2
    import json

    from shardloom.sources.wires import read_wires

    points = [{"Point": {"x": 10.0, "y": y, "z": 100.0 * k}} for k in range(4) for y in (0.0, 1000.0)]
    wires_ = [{"Wire": {"channel": 7 + k, "tail": 2 * k, "head": 2 * k + 1}} for k in range(4)]
    store = {"anodes": [{"Anode": {"faces": [0]}}], "faces": [{"Face": {"planes": [0, 1]}}], "planes": [{"Plane": {"wires": [2, 0]}}, {"Plane": {"wires": [3]}}], "wires": wires_, "points": points}
    (tmp_path / "w.json.bz2").write_bytes(bz2.compress(json.dumps({"Store": store}).encode()))
    got = vertices.wire_segments(read_wires(spark, str(tmp_path / "w.json.bz2"))).select("plane", "seg_pos", "channel", "az", "by", "plane_x")
    assert rows(got, "plane", "seg_pos") == [(0, 0, 9, 20.0, 100.0, 1.0), (0, 1, 7, 0.0, 100.0, 1.0), (1, 0, 10, 30.0, 100.0, 1.0)]


def test_wipe_keeps_survivors(spark):
    pts = spark.createDataFrame([(0, i, i % 10, i // 10) for i in range(60)], "event_idx long, id long, x long, y long")
    got = augment.wipe_cells(pts, 5, 2, 0.4, 1, "id")
    assert 0 < got.where("masked").count() <= 24 and got.where("dense and not masked").count() == 0
    assert got.where("masked").count() + got.where("not masked").count() == 60


def test_block_mask_and_crops(spark):
    pts = spark.createDataFrame([(0, e, e * 100 + i, i % 8, i // 8) for e in range(3) for i in range(40)], "batch long, event_idx long, id long, x long, y long")
    got = augment.block_mask(pts, 1, 1, 0.5, 0)
    assert got.count() == 120 and all(0 < r["m"] < 40 for r in got.groupBy("event_idx").agg(F.sum(F.col("masked").cast("int")).alias("m")).collect())
    found = augment.crops(pts, 8, 8, 2, (0.3, 0.5), (0.8, 1.2), 3, 0)
    assert found.groupBy("event_idx", "crop").count().where("count < 3").count() == 0
    assert augment.views(found, 2, 0.5, 0).select("event_idx", "view").distinct().count() == 12


def test_collectors(spark):
    @collectors.register("mean_of_x")
    class MeanOfX(collectors.Collector):
        def compute(self, part):
            return {"x": part["x"].mean()}

    own = collectors.build({"mean_of_x": {"cadence": 2, "needs": ("x",)}})
    df = spark.createDataFrame([(s, float(s + i)) for s in range(4) for i in range(2)], "step long, x double")
    assert rows(collectors.collect(df, own), "step") == [(0, "mean_of_x/x", 0.5), (2, "mean_of_x/x", 2.5)]
    assert own["mean_of_x"].unmet(["y"]) == {"x"}
    with pytest.raises(ValueError):
        collectors.build({"none": {}})


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("k", i, float(i * i)) for i in range(9)] + [("z", 1, 4.0)], "key string, step long, value double")
    df.orderBy("step").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = logs.read_stream(spark, str(tmp_path / "in"), df.schema)
    run = logs.moving_mean(stream, 0.9).writeStream.outputMode("update").format("memory").queryName("ema_test").trigger(availableNow=True).start()
    run.awaitTermination()
    want = rows(logs.moving_mean_batch(df, 0.9).select("key", "n", F.round("mean", 9)), "key")
    assert rows(spark.table("ema_test").select("key", "n", F.round("mean", 9)), "key") == want
    done = logs.append(logs.due(logs.read_stream(spark, str(tmp_path / "in"), df.schema), "step", 2), str(tmp_path / "out"), str(tmp_path / "check"))
    done.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_feature_store(spark, tmp_path):
    store = tables.FeatureStore(spark, str(tmp_path / "s"))
    store.write_features(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row_idx long, vec array<double>"), "teacher", "a")
    store.write_features(spark.createDataFrame([(0, [5.0]), (1, [6.0])], "row_idx long, vec array<double>"), "teacher", "b")
    store.write_table("row_space", spark.createDataFrame([(0, 7), (1, 9)], "row_idx long, pixel_idx long"))
    store.write_provenance({"run": "r"})
    assert store.provenance()["run"] == "r" and rows(store.available(), "tap") == [("teacher", "a"), ("teacher", "b")]
    px = spark.createDataFrame([(7, 1), (9, 2)], "pixel_idx long, event_idx long")
    ev = spark.createDataFrame([(1, "e"), (2, "f")], "event_idx long, event_key string")
    assert [r["vec"] for r in store.load("teacher", "a+b", px, ev).orderBy("row_idx").collect()] == [[1.0, 5.0], [2.0, 6.0]]
    with pytest.raises(Exception, match="no pixel"):
        store.load("teacher", "a", px.limit(1), ev).collect()


def test_tiers(spark, tmp_path):
    assert tables.tier_columns(extra=True) == ["pixel_labels", "pixel_energyfrac", "pixel_trackid", "pixel_truth_q"]
    spark.createDataFrame([(1, 2, 3, 4.0, 1)], "event_idx long, channel int, tick int, charge double, pixel_labels int").write.parquet(str(tmp_path / "p"))
    assert tables.build(spark, "packed", str(tmp_path / "p"), pixel=True).columns[-1] == "pixel_labels"
    with pytest.raises(ValueError, match="pixel_trackid"):
        tables.build(spark, "packed", str(tmp_path / "p"), extra=True)
    with pytest.raises(ValueError, match="unknown backend"):
        tables.build(spark, "other", "x")
