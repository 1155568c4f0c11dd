"""The mini-batch head against numpy on the same batches, and extraction that goes on where it was."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import extract, mlp
from shardloom.sources.tables import FeatureStore


def test_fit_equals_numpy_on_the_same_batches(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(90)] + [(None, 1), ([0.0] * 4, None)], "vec array<double>, y int").repartition(3)
    data, n = mlp.numbered(df)
    assert n == 90
    rows = data.select("vec", "y", *[mlp.batch_of("row", e, 5, 3).alias(f"e{e}") for e in range(4)]).collect()
    got = mlp.fit(df, 3, 5, epochs=4, rate=0.01, batch=30, hidden=6)
    want = mlp.Head.start(4, 3, 5, 6)
    m = [np.zeros_like(p) for p in want.parts()]
    v = [np.zeros_like(p) for p in want.parts()]
    step = 0
    for e in range(4):
        for k in range(3):
            some = [r for r in rows if r[f"e{e}"] == k]
            a, b = np.array([r["vec"] for r in some]), np.array([r["y"] for r in some])
            h = np.maximum(a @ want.w1 + want.b1, 0)
            z = np.exp(h @ want.w2 + want.b2)
            d = z / z.sum(axis=1, keepdims=True) - np.eye(3)[b]
            back = d @ want.w2.T * (h > 0)
            step += 1
            for i, g in enumerate([a.T @ back, back.sum(0), h.T @ d, d.sum(0)]):
                g = g / len(some)
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                want.parts()[i][...] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    for a, b in zip(got.parts(), want.parts(), strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    out = mlp.predictions(got, df).collect()
    assert all(r["predicted"] is None if r["vec"] is None else r["predicted"] == int(np.argmax(want.logits(np.array([r["vec"]])))) for r in out)
    with pytest.raises(ValueError, match="no training rows"):
        mlp.fit(df.limit(0), 3, 5)


def test_many_rows_come_in_larger_batches(spark, monkeypatch):
    df = spark.range(300).selectExpr("array(double(id % 7), double(id % 3)) AS vec", "int(id % 2) AS y")
    steps, update = [], mlp.Adam.update
    monkeypatch.setattr(mlp.Adam, "update", lambda self, g: (steps.append(1), update(self, g))[1])
    monkeypatch.setattr(mlp, "STEPS", 3)
    got = mlp.fit(df, 2, 1, epochs=2, batch=10, hidden=4)
    assert len(steps) == 6
    want = mlp.fit(df, 2, 1, epochs=2, batch=100, hidden=4)
    for a, b in zip(got.parts(), want.parts(), strict=True):
        assert a == pytest.approx(b, abs=1e-12)


def linear():
    w = np.arange(12).reshape(3, 4) - 5.0

    def run(x):
        return {"out": x @ w, "norm": np.abs(x).sum(axis=1, keepdims=True)}

    return run


def test_extraction_goes_on_where_it_was(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    rows = spark.range(1000).select(F.col("id").alias("row_idx"), F.array(*[(F.col("id") * k % 7).cast("float") for k in (1, 2, 3)]).alias("x"))
    broken = rows.withColumn("x", F.when(F.col("row_idx") == 777, F.raise_error(F.lit("lost")).cast("array<float>")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        extract.extract(store, broken.where("row_idx < 700").unionByName(broken.where("row_idx >= 700")), linear, "student", ["out", "norm"], block=100, at_once=3)
    had = store.blocks("student", "out")
    rest = extract.extract(store, rows, linear, "student", ["out", "norm"], block=100, at_once=3)
    assert len(had) + rest == 10 and extract.extract(store, rows, linear, "student", ["out", "norm"], block=100) == 0
    for tap in ("out", "norm"):
        got = {r["row_idx"]: r["vec"] for r in store.features("student", tap).collect()}
        assert store.features("student", tap).count() == 1000 == len(got)
        x = np.array([[i * k % 7 for k in (1, 2, 3)] for i in range(1000)], float)
        assert np.array([got[i] for i in range(1000)]) == pytest.approx(linear()(x)[tap])
    assert extract.extract(store, rows.limit(0), linear, "student", ["x"]) == 0
    with pytest.raises(ValueError, match="no row_idx"):
        extract.extract(store, rows.withColumn("x", F.lit(None).cast("array<float>")), linear, "student", ["y"])
