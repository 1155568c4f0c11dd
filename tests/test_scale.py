"""Operators that no longer take a group, a class or an event as one sorted or quadratic piece, on large groups."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.functions.expressions import md5_order
from shardloom.operators import independent, lattice, neighbors, pools, sampling


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_nearest(x, y, k, own):
    out = []
    for i, p in enumerate(x):
        away = sorted((round(float(((p - q) ** 2).sum()), 6), j) for j, q in enumerate(y) if not (own and i == j) and np.isfinite(q).all() and np.isfinite(p).all())
        out += [(i, j, r) for r, (_, j) in enumerate(away[:k])]
    return sorted(out)


@pytest.mark.parametrize("few", [1 << 14, 0])
def test_nearest_by_rings_is_exact(monkeypatch, few):
    monkeypatch.setattr(lattice, "FEW", few)
    monkeypatch.setattr(lattice, "PAIRS", 500)
    rng = np.random.default_rng(1)
    clouds = [rng.integers(0, 12, (150, 2)), rng.normal(size=(80, 3)), np.stack([np.arange(90) ** 2, np.zeros(90)], 1), np.zeros((40, 2)), rng.normal(size=(60, 1)), np.concatenate([rng.normal(size=(70, 2)), 1e6 + rng.normal(size=(3, 2))])]
    for c in clouds:
        c = c.astype(float)
        for k in (1, 4, 200):
            got = lattice.nearest(c, c, k, skip_own=True)
            assert sorted(zip(got[0].tolist(), got[1].tolist(), got[3].tolist(), strict=True)) == brute_nearest(c, c, k, True)
        other = np.concatenate([c[::3] + 0.5, np.full((1, c.shape[1]), np.nan), np.full((1, c.shape[1]), -500.0)])
        got = lattice.nearest(other, c, 3)
        assert sorted(zip(got[0].tolist(), got[1].tolist(), got[3].tolist(), strict=True)) == brute_nearest(other, c, 3, False)
    assert not len(lattice.nearest(np.zeros((0, 2)), np.zeros((3, 2)), 2)[0])


def test_nearest_of_a_large_event(spark):
    rng = np.random.default_rng(2)
    xy = rng.permutation(np.unique(rng.integers(0, 600, (60_000, 2)), axis=0))[:52_000].astype(float)
    began = time.time()
    row, col, away, rank = lattice.nearest(xy, xy, 5, skip_own=True)
    assert time.time() - began < 30 and len(row) == 5 * len(xy)
    some = rng.choice(len(xy), 40, replace=False)
    for i in some.tolist():
        d = np.round(((xy - xy[i]) ** 2).sum(axis=1), 6)
        d[i] = np.inf
        assert col[row == i].tolist() == np.lexsort((np.arange(len(xy)), d))[:5].tolist()


def greedy(n, edges):
    gone = set()
    for i in range(n):
        if i not in gone:
            gone |= {b for a, b in edges if a == i}
    return gone


def test_first_independent_set_against_the_pass(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (60, 200), (60, 900)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        gone, _ = independent.dominated(spark.createDataFrame(sorted(edges) + sorted(edges)[:5], "a long, b long"))
        assert {r["node"] for r in gone.collect()} == greedy(n, edges)
    star = spark.range(1, 5000).selectExpr("0L AS a", "id AS b")
    gone, rounds = independent.dominated(star)
    assert gone.count() == 4999 and rounds == 1
    assert independent.dominated(star.limit(0))[0].count() == 0


def test_suppression_of_a_large_event_in_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xy = rng.permutation(np.unique(rng.integers(0, 600, (62_000, 2)), axis=0))[:52_000]
    pts = spark.createDataFrame([(None if i < 0 else 1, i, int(x), int(y)) for i, (x, y) in enumerate(xy.tolist())], "event_idx long, id long, x long, y long").repartition(8)
    rounds, plain = [], neighbors.dominated
    monkeypatch.setattr(neighbors, "dominated", lambda e: (out := plain(e), rounds.append(out[1]))[0])
    got = {r["id"]: (r["n_near"], r["kept"]) for r in neighbors.suppress(pts, 4.0).collect()}
    assert len(got) == 52_000 and rounds[0] < 20
    cells = {}
    for i, (x, y) in enumerate(xy.tolist()):
        cells[x, y] = i
    ring = [(dx, dy) for dx in range(-4, 5) for dy in range(-4, 5) if dx * dx + dy * dy < 16]
    near = [[cells[x + dx, y + dy] for dx, dy in ring if (x + dx, y + dy) in cells] for x, y in xy.tolist()]
    gone, kept = set(), set()
    for i in sorted(range(len(near)), key=lambda i: (-len(near[i]), i)):
        if i not in gone:
            kept.add(i)
            gone.update(near[i])
    assert {i for i, (_, k) in got.items() if k} == kept and all(got[i][0] == len(near[i]) for i in range(len(near)))


def test_suppression_of_null_events(spark):
    pts = spark.createDataFrame([(None, 1, 0.0, 0.0), (None, 2, 1.0, 0.0), (7, 3, 0.0, 0.0), (7, 4, 9.0, 9.0), (7, 5, None, 1.0)], "event_idx int, id int, x double, y double")
    got = {r["id"]: (r["event_idx"], r["n_near"], r["kept"]) for r in neighbors.suppress(pts, 2.0).collect()}
    assert got == {1: (None, 2, True), 2: (None, 2, False), 3: (7, 1, True), 4: (7, 1, True), 5: (7, 0, True)}


def digest(seed, *keys):
    return hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()


def test_draws_against_sorting(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), i % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, m string, head int")  # names that the draws use themselves
    wanted = [
        sampling.Draw("all", 10_000, md5_order(1, F.col("id"))),
        sampling.Draw("some", 700, md5_order(1, F.col("id")), F.col("head") > 0),
        sampling.Draw("none", 0, md5_order(1, F.col("id"))),
        sampling.Draw("each", 300, md5_order(2, F.col("id")), by=F.col("m")),
        sampling.Draw("exactly", 3000, md5_order(3, F.col("id"))),
    ]
    got = {}
    for r in sampling.draws(df, wanted, ["id"]).collect():
        got.setdefault(r["draw"], []).append((r["id"], r["m"], r["head"]))
    first = lambda seed, of, n: sorted(of, key=lambda r: (digest(seed, r[0]), r[0]))[:n]
    want = {"all": rows, "exactly": rows, "some": first(1, [r for r in rows if r[2] > 0], 700), "each": [r for m in ("a", "b", None) for r in first(2, [r for r in rows if r[1] == m], 300)]}
    assert got.keys() == want.keys() and all(sorted(got[k], key=lambda r: r[0]) == sorted(v, key=lambda r: r[0]) for k, v in want.items())


def test_draws_of_ties(spark):
    df = spark.range(1000).withColumn("one", F.lit("abcd"))
    assert {r["id"] for r in sampling.draws(df, [sampling.Draw("x", 17, F.col("one"))], ["id"]).collect()} == set(range(17))


def test_pools_at_their_default_sizes_rank_no_class(spark):
    pixels = spark.range(40_000).selectExpr("id AS pixel_idx", "id % 500 AS event_idx", "cast(id % 7 AS int) AS label", "0.8d AS energyfrac", "cast(id % 5 AS int) AS trackid", "cast(id % 60 AS double) AS distance")
    events = spark.range(500).withColumnRenamed("id", "event_idx")
    spec = pools.PoolSpec()
    seen, plain = [], sampling.draws
    try:
        sampling.draws = lambda rows, wanted, keys: (out := plain(rows, wanted, keys), seen.append((len(wanted), plan(out))))[0]
        drawn = pools.draw_pools(pixels, events, spec)
        assert drawn.select("pool").distinct().count() == 14
    finally:
        sampling.draws = plain
    assert seen[0][0] == 11  # all but the pools by event, together
    assert all("Range" not in text and "Join" not in text for _, text in seen)  # windows are over what was taken, which is stored
    space = pools.row_space(drawn)
    assert space.count() == drawn.where("pool <> 'event_sample'").select("pixel_idx").distinct().count()
    got = space.orderBy("pixel_idx").collect()
    assert [r["row_idx"] for r in got] == [*range(len(got))]


def test_softmax_of_many_prototypes_is_linear(spark):
    from shardloom.operators import metrics

    began = time.time()
    rows = spark.range(10_000).select((F.col("id") % 50).alias("event_idx"), (F.col("id") % 2 == 0).alias("is_masked"), F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda i: F.sin(i * F.col("id"))).alias("student"))
    got = metrics.distribution_loss(rows.withColumn("teacher", F.transform("student", lambda x: 2 * x))).first()
    assert time.time() - began < 60
    x = np.sin(np.arange(1, 1025) * np.arange(10_000)[:, None])
    soft = lambda v: np.exp(v) / np.exp(v).sum(axis=1, keepdims=True)
    loss = -(soft(2 * x) * np.log(soft(x))).sum(axis=1)
    assert got["loss"] == pytest.approx(np.mean([loss[i::50].mean() for i in range(50)]), rel=1e-9)
    spread = rows.select(metrics.row_norm(F.col("student")).alias("v")).agg(F.max(F.abs(F.aggregate("v", F.lit(0.0), lambda a, v: a + v))).alias("m")).first()["m"]
    assert spread < 1e-6


def test_taps_of_unequal_rows_are_refused(spark, tmp_path):
    from shardloom.sources import tables

    store = tables.FeatureStore(spark, str(tmp_path))
    rows = spark.range(10).selectExpr("id AS row_idx", "array(cast(id AS double)) AS vec")
    store.write_features(rows, "student", "a")
    store.write_features(rows, "student", "b")
    store.write_features(rows.where("row_idx < 7"), "student", "c")
    store.write_table("row_space", rows.selectExpr("row_idx", "row_idx AS pixel_idx"))
    pixels, events = rows.selectExpr("row_idx AS pixel_idx", "row_idx AS event_idx"), rows.selectExpr("row_idx AS event_idx")
    assert {tuple(r["vec"]) for r in store.load("student", "a+b", pixels, events).collect()} == {(float(i), float(i)) for i in range(10)}
    for taps in ("a+c", "c+a"):
        with pytest.raises(Exception, match="don't have the same rows"):
            store.load("student", taps, pixels, events).collect()


def test_partition_values_are_folders(spark, tmp_path):
    from shardloom.sources import tables

    spark.range(6).selectExpr("id", "concat('a b/', id % 2) AS group").write.partitionBy("group").parquet(str(tmp_path / "t"))
    assert tables.partition_values(spark, str(tmp_path / "t"), "group") == {"a b/0", "a b/1"}


def test_draws_take_one_digest_a_row_and_quotas_rank_few_events(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr("id AS k", "id DIV 3 AS event_idx", "cast(id % 4 AS int) AS label")
    plans, ranked, kept, each = [], [], sampling.cut, sampling.per_event
    monkeypatch.setattr(sampling, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    order = md5_order(1, F.col("k"))
    drawn = sampling.draws(rows, [sampling.Draw(str(i), 40, order, F.col("label") > i) for i in range(3)], ["k"])
    assert plans[0].count("md5(") == 1 and plans[1].count("md5(") == 2  # to take: to leave rows out, and of those that are left
    first = lambda seed, of, n, key: sorted(of, key=lambda r: (digest(seed, key(r)), r))[:n]
    every = [(i, i // 3, i % 4) for i in range(30_000)]
    assert sorted((r["draw"], r["k"]) for r in drawn.collect()) == sorted((str(i), r[0]) for i in range(3) for r in first(1, [r for r in every if r[2] > i], 40, lambda r: r[0]))

    monkeypatch.setattr(sampling, "per_event", lambda rows, *a: (ranked.append(rows.count()), each(rows, *a))[1])
    got = sorted((r["label"], r["k"]) for r in sampling.quota_pool(rows, 50, 1, 7, "k").collect())
    assert ranked[0] < 1000
    want = []
    for label in (1, 2, 3):
        of = sorted((digest(7, e), e, digest(7, k), k) for k, e, x in every if x == label)
        best = {}
        for _, e, _, k in of:
            best.setdefault(e, k)
        want += [(label, k) for k in list(best.values())[:50]]
    assert got == sorted(want)


@pytest.mark.parametrize("share", [0, 0.2, 0.8, 1])
def test_split_ranks_only_the_range_of_the_cut(spark, share):
    events = spark.range(3000).selectExpr("CASE WHEN id > 2 THEN id END AS event_idx")  # three null events, of one digest
    got = sampling.event_split(events, 5, share)
    assert got.count() == 3000 and got.where("is_train").count() == int(share * 3000)
    want = sorted(range(3, 3000), key=lambda i: digest(5, i))
    train = {r["event_idx"] for r in got.where("is_train AND event_idx IS NOT NULL").collect()}
    assert train == set(want[: len(train)]) and "Join" not in plan(got)


def test_vertices_of_many_events_are_merged_at_once(spark, monkeypatch):
    from shardloom.operators import vertices

    rng = np.random.default_rng(6)
    sizes = [0, 1, 40, 0, 7, 300, 2, 90, 0]
    at = np.concatenate([[0], np.cumsum(sizes)])
    xyz, kind = rng.integers(0, 5, (at[-1], 3)) / 2, rng.integers(0, 5, at[-1])
    place, identity = [], []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        open_ = list(range(a, b))
        while open_:
            members = [i for i in open_ if ((xyz[i] - xyz[open_[0]]) ** 2).sum() <= 1]
            place.append(members[0])
            identity.append(min(members, key=lambda i: (kind[i], i)))
            open_ = [i for i in open_ if i not in members]
    for solo in (1024, 50):
        monkeypatch.setattr(vertices, "SOLO", solo)
        got = vertices.merged(xyz, kind, at=at)
        assert got[0].tolist() == place and got[1].tolist() == identity
    # 200,000 events of some primaries and vertices, of which each cost a loop of its own
    n, began = 200_000, time.time()
    got = vertices.merged(rng.integers(0, 4, (4 * n, 3)).astype(float), np.zeros(4 * n, int), at=np.arange(0, 4 * n + 1, 4))
    assert time.time() - began < 8 and n <= len(got[0]) < 4 * n
    values = np.array([3.0, np.nan, 1.0, 7.0, 2.0, np.nan])
    assert np.array_equal(vertices.medians(values, np.array([0, 0, 0, 2, 2, 3]), 5), [2.0, np.nan, 4.5, np.nan, np.nan], equal_nan=True)


def test_interaction_of_missing_starts(spark):
    from shardloom.operators import vertices

    cols = "event_idx long, pos int, trackid int, pid int, motherid int, proc int, endproc int, start_x double, start_y double, start_z double, end_x double, end_y double, end_z double, start_ke double, end_ke double"
    part = lambda e, pos, x, y: (e, pos, pos + 1, 11, 0, 0, 0, x, y, 0.5, 9.0, 9.0, 9.0, 0.1, 0.1)
    parts = spark.createDataFrame([part(1, 0, 1.0, None), part(1, 1, 2.0, None), part(1, 2, 4.0, None), part(1, 3, None, None), part(2, 0, 1.0, 5.0), part(2, 1, 2.0, 6.0), part(None, 0, 3.0, 3.0)], cols)
    ev = spark.createDataFrame([(1, 7.0, 8.0, 9.0), (2, 7.0, 8.0, 9.0), (3, 7.0, 8.0, 9.0), (None, 4.0, 4.0, 4.0)], "event_idx long, vertex_x double, vertex_y double, vertex_z double")
    got = vertices.derive_vertices(parts, ev, spark.createDataFrame([], "event_idx long, trackid int")).collect()
    assert sorted((r["event_idx"] or 0, r["x"], r["y"], r["z"], r["type"]) for r in got) == [(0, 4.0, 4.0, 4.0, 0), (1, 2.0, 8.0, 0.5, 0), (2, 1.5, 5.5, 0.5, 0), (3, 7.0, 8.0, 9.0, 0)]


def test_best_scores_are_those_of_sorting_all():
    rng = np.random.default_rng(8)
    for k, width in ((1, 640), (5, 700), (20, 1500), (20, 64), (3, 2)):
        score = np.where(rng.random((30, width)) < 0.05, -np.inf, rng.integers(-40, 40, (30, width)) * 1e-6 + rng.integers(-6, 6, (30, width)) * 1e-7)
        score[0], score[1], score[2, 7:] = -np.inf, 0.25, -np.inf
        row, col, found = neighbors._best(score, k)
        want = [(i, j, float(np.round(score[i, j], 6)) + 0.0) for i in range(30) for j in sorted(np.flatnonzero(score[i] > -np.inf).tolist(), key=lambda j: (-np.round(score[i, j], 6), j))[:k]]
        assert [*zip(row.tolist(), col.tolist(), found.tolist(), strict=True)] == want


def test_pairs_of_blocks_have_room_of_their_own_and_unknown_vectors_no_place(spark):
    rng = np.random.default_rng(9)
    vec = rng.integers(-2, 3, (300, 3)).astype(float)
    vec[:3, 1], vec[3, 0] = np.nan, np.inf
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vec.tolist())] + [(7, [9.0, 9.0, 9.0])], "id long, vec array<double>")  # an id twice
    for metric in ("cosine", "l2"):
        out = neighbors.top_k(rows, rows, 4, metric, block=50)
        assert "REPARTITION_BY_NUM" in plan(out)
        x = np.concatenate([vec, [[9.0, 9.0, 9.0]]])
        ids = [*range(300), 7]
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8) if metric == "cosine" else x
        known = np.isfinite(x).all(axis=1)
        score = lambda i, j: round(float(unit[i] @ unit[j] if metric == "cosine" else -((x[i] - x[j]) ** 2).sum()), 6)
        got = {}
        for r in out.collect():
            got.setdefault(r["query"], []).append(r["neighbour"])
        want = {ids[i]: [b for _, b in sorted((-score(i, j), ids[j]) for j in range(301) if known[j] and ids[j] != ids[i])[:4]] for i in range(300) if known[i] and i != 7}
        assert {q: sorted(v) for q, v in got.items() if q != 7} == {q: sorted(v) for q, v in want.items()}
