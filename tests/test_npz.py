"""The npz Data Source: round trips, numpy's own files, pruning, and failed writes."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.sources import npz


@pytest.fixture(scope="module")
def tables(spark):
    events = spark.range(60).selectExpr("id AS event_idx", "concat('e', id) AS event_key", "cast(id % 3 AS int) AS label", "cast(id AS float) AS nu_energy", "IF(id % 2 = 0, array(1f, 2f, cast(id AS float)), null) AS vertex_xyz")
    pixels = spark.range(5000).selectExpr("id % 50 AS event_idx", "cast(id AS int) AS channel", "cast(-id % 7 AS int) AS tick", "id / 3 AS charge", "cast(id % 7 AS tinyint) AS pixel_labels", "IF(id % 5 = 0, null, 0.5f) AS pixel_energyfrac", "cast(id AS int) AS pixel_trackid", "1f AS pixel_truth_q")
    return events, pixels


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("npz") / "pack")
    npz.pack(*tables, path, parts=4)
    return path


def test_pack_gives_its_tables_back(spark, tables, folder):
    events, pixels = tables
    got = npz.read(spark, folder, tiers="extra")
    want = pixels.withColumn("charge", F.col("charge").cast("float")).withColumn("pixel_energyfrac", F.coalesce("pixel_energyfrac", F.lit(0.0).cast("float"))).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = {r["event_idx"]: r for r in npz.read(spark, folder, "events").collect()}
    assert len(rows) == 60 and rows[55]["n"] == 0 and rows[7]["n"] == 100 and rows[4]["vertex_xyz"] == [1.0, 2.0, 4.0] and np.isnan(rows[5]["vertex_xyz"]).all()
    assert (rows[8]["labels"], rows[8]["nu_pdg"], rows[8]["nu_ccnc"], rows[8]["event_key"]) == (2, 0, -1, "e8")
    assert len(glob.glob(f"{folder}/*.npz")) == 4 and not glob.glob(f"{folder}/_*")


def test_numpy_reads_parts_and_its_files_are_read(spark, folder, tmp_path):
    parts = [np.load(f) for f in sorted(glob.glob(f"{folder}/*.npz"))]
    assert np.concatenate([p["event_idx"] for p in parts]).tolist() == [*range(60)] and sum(len(p["coords"]) for p in parts) == 5000
    for save in (np.savez, np.savez_compressed):  # without event_idx, events are numbered
        path = str(tmp_path / f"{save.__name__}.npz")
        save(path, **{k: v for k, v in parts[1].items() if k != "event_idx"})
        got = npz.read(spark, path, tiers="pixel", events=(2, 3)).collect()
        a, b = parts[1]["offsets"][[2, 4]]
        assert [(r["channel"], r["tick"]) for r in got] == [tuple(x) for x in parts[1]["coords"][a:b].tolist()] and {r["event_idx"] for r in got} == {2, 3}


def test_only_asked_arrays_and_events_are_read(folder, monkeypatch):
    monkeypatch.setattr(npz, "EVENTS", 5)
    seen = []
    plain = npz.Part.rows
    monkeypatch.setattr(npz.Part, "rows", lambda self, name, a, b: (seen.append((name, b - a)), plain(self, name, a, b))[1])
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    reader = npz.Reader({"path": folder, "tiers": "pixel"})
    filters = [GreaterThanOrEqual(("event_idx",), 10), LessThan(("event_idx",), 12)]
    assert [*reader.pushFilters(filters)] == filters  # Spark applies them again
    parts = reader.partitions()
    assert sum(p.stop - p.start for p in parts) <= 3
    seen.clear()
    for p in parts:
        assert {i for b in reader.read(p) for i in b.column(0).to_pylist()} <= {10, 11, 12}
    assert {n for n, _ in seen} == {"event_idx", "offsets", "coords", "features", "pixel_labels"} and max(b for _, b in seen) <= 300


def test_missing_tiers_and_second_writes_are_refused(spark, tables, folder):
    with pytest.raises(Exception, match="lacks pixel_labels2"):
        npz.read(spark, folder, tiers="rich").count()
    with pytest.raises(Exception, match="written once"):
        npz.pack(*tables, folder)


def test_a_failed_write_leaves_nothing(spark, tables, tmp_path):
    events, pixels = tables
    bad = pixels.withColumn("charge", F.when(F.col("event_idx") == 45, F.raise_error(F.lit("broken pixel")).cast("double")).otherwise(F.col("charge")))
    with pytest.raises(Exception, match="broken pixel"):
        npz.pack(events, bad, str(tmp_path / "bad"))
    assert not glob.glob(f"{tmp_path}/bad/*")


def test_parts_are_bounded_and_empty_tables_are_packs(spark, tables, tmp_path, monkeypatch):
    npz.pack(tables[0].limit(0), tables[1], str(tmp_path / "none"))
    assert npz.read(spark, str(tmp_path / "none")).count() == 0


def test_a_part_is_written_a_piece_at_a_time(tmp_path):
    import zipfile

    import pyarrow as pa

    pixel = pa.struct([("channel", pa.int64()), ("tick", pa.int64()), ("charge", pa.float64()), ("pixel_trackid", pa.int64())])
    pixels = pa.array([[{"channel": i, "tick": j, "charge": i / 2, "pixel_trackid": j} for j in range(i % 4)] if i % 5 else None for i in range(23)], pa.list_(pixel))
    own = {c: pa.array(range(23), pa.float32() if k == "float" else pa.int64()) for c, k in npz.EVENT_TYPES.items()}
    batch = pa.RecordBatch.from_pydict({"event_idx": pa.array(range(23)), "event_key": pa.array(["k" * (1 + i % 7) for i in range(23)]), **own, "vertex_xyz": pa.array([None, [1.0, 2.0, 3.0]] + [None] * 21, pa.list_(pa.float32())), "pixels": pixels})
    spool = npz.Spool()
    for start in range(0, 23, 6):
        spool.add(npz._arrays([batch.slice(start, 6)]))
    with zipfile.ZipFile(tmp_path / "a.npz", "w") as z:
        spool.write(z)
    got, want = np.load(tmp_path / "a.npz"), npz._arrays([batch])
    assert set(got) == set(want)
    for name, value in want.items():
        assert got[name].dtype == value.dtype and np.array_equal(got[name], value, equal_nan=value.dtype.kind == "f")
