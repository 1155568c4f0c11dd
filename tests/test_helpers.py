"""Plug-ins, digests, caches, repositories, schedules and settings."""

import hashlib
import json
import os
import subprocess
import warnings

import pytest
from pyspark.sql import functions as F

from shardloom.operators import collectors, pools, report, series, settings
from shardloom.sources import wires


def test_a_broken_plugin_is_left_out(monkeypatch):
    class Point:
        def __init__(self, name, f):
            self.name, self.load = name, f

    class Fine(collectors.Collector):
        pass

    def broken():
        raise ImportError("no such module")

    monkeypatch.setattr("importlib.metadata.entry_points", lambda group: [Point("broken", broken), Point("fine_one", lambda: Fine)])
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert collectors.load_plugins() == ["fine_one"]
    assert "broken" in str(said[0].message) and "no such module" in str(said[0].message)


def test_step_rows(spark):
    lines = [json.dumps(x) for x in ({"step": 0, "loss": 1.5, "name": "x"}, {"step": 3, "loss": None, "lr": 2}, {"epoch": 1, "loss": 9.0})]
    got = collectors.step_rows(spark.createDataFrame([(x,) for x in lines], "line string"), 4)
    assert [f.dataType for f in got.schema] == [f.dataType for f in collectors.STEP] and got.columns == collectors.STEP.names
    assert sorted(map(tuple, got.collect())) == [(0, 0, False, "loss", 1.5), (3, 0, True, "lr", 2.0)]


def test_digest_of_files_in_blocks(spark, tmp_path):
    want = {}
    for name, size in (("a b.bin", 20_000_000), ("empty.bin", 0)):
        data = os.urandom(1000) * (size // 1000)
        (tmp_path / name).write_bytes(data)
        want[name] = hashlib.sha256(data).hexdigest()
    got = {os.path.basename(r["path"]): r["sha256"] for r in report.file_digest(spark, str(tmp_path)).collect()}
    assert got == want


def test_repository_of_a_run(spark, tmp_path, monkeypatch):
    for k in ("GIT_SHA", "GIT_BRANCH", "GIT_DIRTY"):
        monkeypatch.delenv(k, raising=False)
    assert report.repository(str(tmp_path)) == {}
    monkeypatch.setenv("GIT_SHA", "abc")
    assert report.repository(str(tmp_path)) == {"sha": "abc", "branch": "", "dirty": "unknown"}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("commit", "-q", "--allow-empty", "-m", "x")
    got = report.repository(str(tmp_path))
    assert len(got["sha"]) == 40 and got["branch"] == "main" and got["dirty"] == "false"
    (tmp_path / "new").write_text("x")
    assert report.repository(str(tmp_path))["dirty"] == "true"
    rows = {(r["section"], r["key"]): r["value"] for r in report.run_metadata(spark, {}, ["x"], folder=str(tmp_path), data={"backend": "npz", "split": {"id": "s1"}}).collect()}
    assert rows["git", "sha"] == got["sha"] and rows["data", "split.id"] == "s1"


def test_wires_are_read_once(spark, tmp_path, monkeypatch):
    point = lambda z, y: {"Point": {"x": 10.0, "y": y, "z": z}}
    store = {"Store": {"anodes": [{"Anode": {"faces": [0]}}], "faces": [{"Face": {"planes": [0]}}], "planes": [{"Plane": {"wires": [0, 1]}}], "wires": [{"Wire": {"channel": 7 + i, "head": 2 * i, "tail": 2 * i + 1}} for i in range(2)], "points": [point(float(i), 1.0) for i in range(4)]}}
    (tmp_path / "w.json").write_text(json.dumps(store))
    reads, plain = [], wires.read_wires
    monkeypatch.setattr(wires, "read_wires", lambda *a: (reads.append(a), plain(*a))[1])
    one, two = (sorted(map(tuple, wires.cached_wires(spark, str(tmp_path / "w.json"), str(tmp_path / "cache")).collect())) for _ in range(2))
    assert one == two == sorted(map(tuple, plain(spark, str(tmp_path / "w.json")).collect())) and len(reads) == 1
    store["Store"]["wires"][0]["Wire"]["channel"] = 1234
    (tmp_path / "w.json").write_text(json.dumps(store))
    assert {r["channel"] for r in wires.cached_wires(spark, str(tmp_path / "w.json"), str(tmp_path / "cache")).collect()} == {1234, 8} and len(reads) == 2


def test_schedules_with_group_scales(spark):
    schedule = spark.createDataFrame([(0, "lr", 2.0), (1, "lr", 1.0), (0, "weight_decay", 4.0)], "step long, key string, value double")
    groups = spark.createDataFrame([("head", "lr", 0.5), ("head", "weight_decay", 1.0), (None, "lr", 3.0), ("body", "lr", None)], "name string, key string, scale double")
    assert sorted(map(tuple, series.applied(schedule, groups).collect())) == [(0, "lr", 2.0), (0, "lr/head", 1.0), (0, "weight_decay", 4.0), (1, "lr", 1.0), (1, "lr/head", 0.5)]


def test_settings_against_their_schemas(spark):
    assert {"pools", "loader", "schedule", "data"} <= set(settings.register_framework()) and settings.register_framework()
    with pytest.raises(ValueError, match="another schema"):
        settings.register("pools", {"seed": "string"})
    kinds = {r["key"]: r["kind"] for r in settings.schema(spark).where("section = 'pools'").collect()}
    assert kinds["seed"] == "long" and kinds["train_frac"] == "double" and kinds["overlap_thresholds"] == "list" and len(kinds) == len(pools.PoolSpec.__dataclass_fields__)
    rows = [("a", "pools", "seed", "7"), ("a", "pools", "seed2", "7"), ("a", "pools", "train_frac", "much"), ("a", "pools", "overlap_thresholds", "[0.1, 0.2]"), ("a", "pools", "vertex_radii_px", "10"),
            ("b", "loader", "drop_last", "True"), ("b", "loader", "seed", "1.5"), ("b", "loader", "size", None), ("c", "odd", "x", "1")]
    got = settings.violations(spark.createDataFrame(rows, "run string, section string, key string, value string"), settings.schema(spark))
    assert sorted(map(tuple, got.collect())) == [
        ("a", "pools", "seed2", "unknown key"), ("a", "pools", "train_frac", "not a double"), ("a", "pools", "vertex_radii_px", "not a list"),
        ("b", "loader", "seed", "not a long"), ("b", "loader", "size", "missing"), ("c", "odd", "x", "unknown section"),
    ]
    assert settings.violations(spark.createDataFrame(rows[:0], "run string, section string, key string, value string"), settings.schema(spark)).count() == 0


def test_typed_collation(spark):
    from shardloom.sources import evalset

    events = spark.createDataFrame([(2, "k2", 14, 2.5, [1.0, 2.0, 3.0], [7, 8], 0), (1, "k1", -12, 0.1, None, [], 0), (5, "k5", None, 1.0, [0.0, 0.0, 0.0], [9], 1)], "event_idx int, event_key string, nu_pdg int, nu_energy double, vertex_xyz array<double>, t_pdg array<int>, batch_id int")
    pixels = spark.createDataFrame([(2, 9, 1, 1.0, 3, 0.5), (2, 4, 1, 1.0, 1, 0.25), (1, 1, 1, 1.0, 2, None), (7, 1, 1, 1.0, 2, 1.0)], "event_idx int, channel int, tick int, charge double, pixel_labels int, pixel_energyfrac double")
    got = {r["batch_id"]: r for r in evalset.collated_meta(events, pixels).collect()}
    kinds = dict(evalset.collated_meta(events, pixels).dtypes)
    assert kinds["nu_pdg"] == "array<bigint>" and kinds["nu_energy"] == "array<float>" and kinds["vertex_xyz"] == "array<array<float>>" and kinds["pixel_labels"] == "array<array<tinyint>>" and kinds["t_pdg"] == "array<array<int>>"
    assert got[0]["event_key"] == ["k1", "k2"] and got[0]["nu_pdg"] == [-12, 14] and got[0]["vertex_xyz"] == [None, [1.0, 2.0, 3.0]] and got[0]["t_pdg"] == [[], [7, 8]]
    assert got[0]["pixel_labels"] == [[2], [1, 3]] and got[0]["pixel_energyfrac"] == [[None], [0.25, 0.5]] and got[1]["pixel_labels"] == [[]] and got[1]["nu_pdg"] == [None]
    assert evalset.collated_meta(events.select("event_idx", "batch_id"), pixels.select("event_idx", "channel", "tick", "charge")).columns == ["batch_id"]
    assert evalset.collated_meta(events.limit(0), pixels).count() == 0
