"""Growing logs by byte offsets, and array dumps that are written once."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.sources import logstream
from shardloom.streaming import dumps


def records(rng, n, step):
    return [json.dumps({"step": step + i, "loss": rng.random(), "note": "é" * rng.randint(0, 30)}, ensure_ascii=False) for i in range(n)]


def run(stream, sink, checkpoint):
    stream.select("file", "place", "line").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_a_stream_over_a_growing_log_is_the_batch(spark, tmp_path):
    rng, log, sink, checkpoint = random.Random(1), tmp_path / "log", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    log.mkdir()
    assert logstream.read(spark, str(log)).count() == logstream.read(spark, str(tmp_path / "absent")).count() == 0
    want = records(rng, 50, 0)
    half = json.dumps({"step": 50, "loss": 0.5})
    (log / "a.jsonl").write_text("\n".join(want) + "\n\n" + half[:9], encoding="utf-8")
    (log / "_aside.jsonl").write_text("{}\n")
    run(logstream.read_stream(spark, str(log)), sink, checkpoint)
    assert sorted(r["line"] for r in spark.read.parquet(sink).collect()) == sorted(want)  # the half line is left
    more = records(rng, 20, 51)
    with (log / "a.jsonl").open("a", encoding="utf-8") as f:
        f.write(half[9:] + "\n" + "not json\n" + "\n".join(more) + "\n")
    (log / "b.jsonl").write_text("\n".join(other := records(rng, 7, 0)) + "\n", encoding="utf-8")
    run(logstream.read_stream(spark, str(log)), sink, checkpoint)
    got = spark.read.parquet(sink).collect()
    assert sorted(r["line"] for r in got) == sorted([*want, half, *more, *other])
    assert sorted(map(tuple, got)) == sorted(map(tuple, logstream.read(spark, str(log)).select("file", "place", "line").collect()))
    run(logstream.read_stream(spark, str(log)), sink, checkpoint)
    assert spark.read.parquet(sink).count() == len(got)
    (log / "a.jsonl").write_text("\n".join(want[:5]) + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="a log that was cut"):
        run(logstream.read_stream(spark, str(log)), sink, checkpoint)


@pytest.mark.parametrize("size", [1, 2, 7, 40, 1000])
def test_parts_have_the_lines_that_begin_in_them(tmp_path, monkeypatch, size):
    monkeypatch.setattr(logstream, "SPLIT", size)
    monkeypatch.setattr(logstream, "BLOCK", 5)
    text = b"one\n\ntwo two\n\n\nthree\nfour four four four\n5\n"
    path = str(tmp_path / "x.jsonl")
    open(path, "wb").write(text + b"half")
    files = logstream.log_files(path)
    assert [*files.values()] == [len(text)]
    for first in (0, 4, 5):  # a batch begins where a line begins
        got = [row for p in logstream.splits({k: first for k in files}, files) for row in logstream.lines(path, p)]
        assert [line for _, line in got] == text[first:].split(b"\n")[:-1]
        assert all(text[at : at + len(line)] == line for at, line in got)


def test_resumed_log(spark, tmp_path):
    lines = [json.dumps({"step": s}) for s in (1, 2, 3, 4, 5)] + [json.dumps({"epoch": 1})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + '\n{"step": 6')
    logstream.resume(spark, str(tmp_path / "log.jsonl"), str(tmp_path / "steps"), 4)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "steps")).collect()) == sorted([*lines[:3], lines[5]])
    logstream.resume(spark, str(tmp_path / "log.jsonl"), str(tmp_path / "epochs"), 4, "epoch")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "epochs")).collect()) == sorted([*lines[:4], lines[5]])


def test_dumps_are_written_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    rows = [(s, name, i, x[i].tolist()) for s in (10, 20) for name in ("a", "b") for i in range(40 if s == 10 else 30)] + [(10, "one", 0, [1.0, 2.0, 3.0]), (10, "a", 99, None)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], "step long, name string, id long, vec array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("step long, name string, id long, vec array<double>").parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # without the checkpoint the batch is replayed
        dumps.dump(stream(), str(tmp_path / "out"), str(tmp_path / checkpoint), most=20, seed=3, keys=["a", "one"]).awaitTermination()
        got = {(r["step"], r["name"]): (r["n"], r["cov"], r["batch"]) for r in dumps.read(spark, str(tmp_path / "out")).collect()}
        assert got.keys() == {(10, "a"), (20, "a")} and all(v[0] == 20 and v[2] == 0 for v in got.values())
    sample = dumps.read(spark, str(tmp_path / "out"), "sample")
    for step in (10, 20):
        ids = [r["id"] for r in sample.where((F.col("step") == step) & (F.col("name") == "a")).collect()]
        assert np.array(got[step, "a"][1]) == pytest.approx(np.cov(x[ids].T))
    assert dumps.read(spark, str(tmp_path / "out"), "files").count() == 2


def test_a_stream_in_any_order_within_a_batch(spark, tmp_path):
    """More rows of a key than an Arrow batch has, and than are held, in no order: as the batch answer."""
    import math

    from shardloom.streaming import logs

    rows = spark.range(60_000).selectExpr("if(id % 6 = 0, 'a', 'b') AS key", "id AS step", "if(id % 7 = 0, null, double(pmod(xxhash64(id), 1000))) AS value")
    rows = rows.unionByName(spark.createDataFrame([("c", i, math.inf if i == 3 else 1.0) for i in range(40_000)], rows.schema))
    rows.repartition(5).sortWithinPartitions("value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = logs.moving_mean(logs.read_stream(spark, str(tmp_path / "in"), rows.schema), 0.9)
    run = stream.writeStream.outputMode("update").format("memory").queryName("any_order").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["key"]: (r["n"], r["mean"]) for r in spark.table("any_order").collect()}
    want = {r["key"]: (r["n"], r["mean"]) for r in logs.moving_mean_batch(rows.where("key <> 'c'"), 0.9).collect()}
    assert got.pop("c") == (40_000, math.inf)
    assert {k: (n, round(m, 9)) for k, (n, m) in got.items()} == {k: (n, round(m, 9)) for k, (n, m) in want.items()}
