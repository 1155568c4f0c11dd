"""Small groups are done whole, many to a task; large ones in cells, with the same results."""

import random

import pytest

from shardloom.operators import augment, neighbors


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(e if e else None, e * 1000 + i, rng.randrange(12), rng.randrange(12), rng.choice([1.0, 2.0, float("nan"), None])) for e in range(30) for i in range(rng.randrange(1, 40))]
    return spark.createDataFrame(rows, "event_idx long, id long, x long, y long, q double").repartition(3)


def answers(points):
    xy, order = points.drop("q"), lambda df: sorted(map(repr, df.collect()))
    return [order(f) for f in (
        neighbors.suppress(xy, 3.0), neighbors.ball(xy, xy, 3.0, ["event_idx"]), neighbors.ball(xy.where("x < 4"), xy.where("y > 2"), 3.0, ["event_idx"], 2),
        *[neighbors.tokens(points, 3.0, 3, reduce=r) for r in ("charge", "first", "farthest")],
    )]


def test_small_groups_meet_in_no_cells(spark, points, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(neighbors, "SOLO", 0)
        want = answers(points)
    with monkeypatch.context() as m:
        m.setattr(neighbors, "SOLO", 20)
        assert answers(points) == want
    assert answers(points) == want
    monkeypatch.setattr(neighbors, "_within", lambda *a: pytest.fail("points of small groups were repeated for nine cells"))
    xy = points.drop("q")
    assert neighbors.suppress(xy, 3.0).count() == points.count()
    neighbors.ball(xy, xy, 3.0, ["event_idx"]).count()
    neighbors.tokens(points, 3.0, 3).count()


def test_crops_without_rows_in_the_image_need_no_attempts(spark):
    rows = [(1, 5, 100, 3), (1, 4, 50, 60), (2, 7, 4, 4), (2, 6, 90, 4), (None, 9, -1, 0)]
    df = spark.createDataFrame(rows, "event_idx long, id long, x int, y int")
    found = augment.crops(df, 8, 8, 2, (0.9, 0.9), (1.0, 1.0), 2, 0, attempts=20_000_000)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, k, 4) for k in (0, 1)] + [(2, k, 7) for k in (0, 1)] + [(None, k, 9) for k in (0, 1)], key=str)


def test_means_and_votes_of_near_points_need_no_joins(spark, monkeypatch):
    from pyspark.sql import functions as F

    from shardloom.operators import lattice

    rng = random.Random(5)
    rows = [(e or None, e * 1000 + i, [float(rng.randrange(9)), float(rng.randrange(9)) if i != 3 else float("nan")], rng.randrange(3), rng.choice([None, 1.0, 2.5])) for e in range(12) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "event_idx long, id long, vec array<double>, label int, value double").repartition(3)
    order = lambda d: sorted(map(repr, d.collect()))
    near = neighbors.near_in_group(df.select("event_idx", "id", "vec"), 3, "event_idx")
    means = near.groupBy("event_idx", F.col("neighbour").alias("id")).agg(F.avg("score").alias("m")).select("id", "m")
    want = [
        order(neighbors.vote(near, df, ["event_idx", "query"])), order(neighbors.interpolate(near, df.select("id", "value"), ["event_idx", "query"]).withColumn("value", F.round("value", 6))),
        order(df.join(means, "id", "left").select("event_idx", "id", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("value"), F.col("m").isNotNull().alias("covered"))),
    ]
    got = [neighbors.vote_in_group(df.drop("value"), 3, "event_idx"), *[f(df, 3, "event_idx").withColumn("value", F.round("value", 6)) for f in (neighbors.interpolate_in_group, neighbors.said_in_group)]]
    assert [order(d) for d in got] == want
    assert all("Join" not in d._jdf.queryExecution().executedPlan().toString() for d in got)


def test_near_points_of_small_and_large_groups(monkeypatch):
    import numpy as np

    from shardloom.operators import lattice

    rng = np.random.default_rng(1)
    x, at, side = rng.integers(0, 9, (300, 2)).astype(float), np.array([0, 1, 5, 60, 260, 300]), rng.integers(0, 2, 300)
    found = lambda s: sorted(zip(*(z.tolist() for z in lattice.nearest_in_groups(x, at, 3, s)), strict=True))
    monkeypatch.setattr(lattice, "FEW", 1 << 20)
    want = found(None), found(side)
    monkeypatch.setattr(lattice, "FEW", 100)
    assert (found(None), found(side)) == want


def test_cells_of_small_events_are_grown_whole(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(e or None, rng.randrange(200), rng.randrange(80) if i else None) for e in range(20) for i in range(rng.randrange(2, 30))]
    df = spark.createDataFrame(rows, "event_idx long, x long, y long").repartition(3)
    order = lambda d: sorted(map(repr, d.collect()))
    want = None
    for solo in (0, 12, 1024):
        monkeypatch.setattr(neighbors, "SOLO", solo)
        for args in ((16, 8, 2), (4, 4, 1), (8, 2, 3)):
            got = augment.grow(df, *args)
            want = want or {}
            assert order(got) == want.setdefault(args, order(got))
    assert augment.grow(df, 16, 8, 2)._jdf.queryExecution().executedPlan().toString().count("Generate") == 0


def test_tasks_that_sort_groups_grow_in_number_not_in_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from shardloom.operators import grouped, sampling

    df = spark.range(2_000).selectExpr("id % 500 AS event_idx", "id", "id % 13 AS x", "id % 7 AS y", "if(id % 9 = 0, null, id % 3 = 0) AS positive").coalesce(1)
    monkeypatch.setattr(grouped, "A_TASK", 100)
    for out in (augment.wipe_cells(df, 4, 3, 0.5, 1, "id"), sampling.cap_negatives(df, "event_idx", F.col("positive"), 1, "id", 1.5, 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("hashpartitioning(event_idx") == 1 and ", 20)" in plan and "Join" not in plan
