"""Packed events as npz parts: a Data Source that reads and writes them in parallel.

A part is a zip of arrays in the numpy format, events as CSR: ``offsets`` (E + 1), ``coords`` (n, 2), ``features`` (n, 1), one array for each
truth tier's column, and the event's own columns. A folder of parts, or one part, is a table: ``table`` "pixels" has a row per
pixel, "events" a row per event. Members are read by ranges of rows: a task opens only the arrays of its columns, and
of those only the rows of its events; tiers that are not asked for are never read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from shardloom.sources.tables import PIXEL_TYPES, tier_columns

#: Events of a task and pixels of a batch when reading; pixels of a part when writing.
EVENTS, ROWS, PART = 4096, 1 << 16, 1 << 22
#: Events whose arrays a writing task holds.
AT_ONCE = 1024
# An event's arrays and their types.
EVENT_TYPES = {"labels": "bigint", "nu_pdg": "bigint", "nu_ccnc": "bigint", "nu_intType": "bigint", "nu_energy": "float"}
NUMPY = {"bigint": np.int64, "int": np.int32, "float": np.float32, "tinyint": np.int8}


def _files(path: str) -> tuple:
    """A file system, and the parts of a folder in order, or the one file."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return system, [root]
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))


class Part:
    """One npz file, of whose arrays ranges of rows are read."""

    def __init__(self, system, path: str) -> None:
        self.zip = zipfile.ZipFile(system.open_input_file(path))
        self.names = {n.removesuffix(".npy") for n in self.zip.namelist()}
        self.read_names: list[str] = []

    def _open(self, name: str):
        from numpy.lib import format as npy

        f = self.zip.open(f"{name}.npy")
        header = npy.read_array_header_1_0 if npy.read_magic(f) == (1, 0) else npy.read_array_header_2_0
        shape, fortran, kind = header(f)
        if fortran and len(shape) > 1 or kind.hasobject:
            raise ValueError(f"array {name} is stored by columns or as objects")
        return f, shape, kind

    def length(self, name: str) -> int:
        return self._open(name)[1][0]

    def rows(self, name: str, start: int, stop: int) -> np.ndarray:
        self.read_names.append(name)
        f, shape, kind = self._open(name)
        stop = min(stop, shape[0])
        width = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
        f.seek(f.tell() + start * width)
        return np.frombuffer(f.read(max(0, stop - start) * width), kind).reshape(-1, *shape[1:])


def _columns(options: dict) -> dict[str, str]:
    """The columns of the asked table, and their types."""
    if options.get("table", "pixels") == "events":
        return {"event_idx": "bigint", "event_key": "string", "n": "bigint", **EVENT_TYPES, "vertex_xyz": "array<float>"}
    tier = options.get("tiers", "")
    asked = tier_columns(**{tier: True}) if tier else []
    return {"event_idx": "bigint", "channel": "int", "tick": "int", "charge": "float", **{c: PIXEL_TYPES[c] for c in asked}}


class Range(InputPartition):
    def __init__(self, path: str, base: int, start: int, stop: int) -> None:
        self.path, self.base, self.start, self.stop = path, base, start, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.columns, self.low, self.high = dict(options), _columns(options), float("-inf"), float("inf")

    def pushFilters(self, filters):
        """Bounds of event_idx choose the events; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("event_idx",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
                if isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        system, paths = _files(self.options["path"])
        found, base = [], 0
        for path in paths:
            part = Part(system, path)
            n = part.length("offsets") - 1
            if lost := [c for c in self.columns if c in PIXEL_TYPES and c not in part.names]:
                raise ValueError(f"{path} lacks {', '.join(lost)}; pack it with these tiers")
            ids = part.rows("event_idx", 0, n) if "event_idx" in part.names else np.arange(base, base + n)
            first, last = int(np.searchsorted(ids, self.low, "left")), int(np.searchsorted(ids, self.high, "right"))
            found += [Range(path, base, a, min(a + EVENTS, last)) for a in range(first, last, EVENTS)]
            base += n
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        if partition.start >= partition.stop:
            return
        part = Part(fs.FileSystem.from_uri(self.options["path"])[0], partition.path)
        start, stop = partition.start, partition.stop
        ids = part.rows("event_idx", start, stop) if "event_idx" in part.names else np.arange(partition.base + start, partition.base + stop)
        offsets = part.rows("offsets", start, stop + 1)
        if "charge" not in self.columns:
            own = {"event_idx": pa.array(ids), "event_key": pa.array([str(k) for k in part.rows("event_key", start, stop)]), "n": pa.array(np.diff(offsets))}
            own |= {c: pa.array(part.rows(c, start, stop).astype(NUMPY[k])) for c, k in EVENT_TYPES.items()}
            yield pa.RecordBatch.from_pydict(own | {"vertex_xyz": pa.array(part.rows("vertex_xyz", start, stop).astype(np.float32).tolist(), pa.list_(pa.float32()))})
            return
        at = np.repeat(ids, np.diff(offsets))
        for a in range(int(offsets[0]), int(offsets[-1]), ROWS):
            b = min(a + ROWS, int(offsets[-1]))
            coords = part.rows("coords", a, b)
            own = {"event_idx": at[a - int(offsets[0]) : b - int(offsets[0])], "channel": coords[:, 0].astype(np.int32), "tick": coords[:, 1].astype(np.int32), "charge": part.rows("features", a, b)[:, 0].astype(np.float32)}
            own |= {c: part.rows(c, a, b).astype(NUMPY[k]) for c, k in self.columns.items() if c in PIXEL_TYPES}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in own.items()})


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class Spool:
    """The arrays of a part that is being written, on the task's disk, as a part may be larger than what a task can hold."""

    def __init__(self) -> None:
        self.arrays: dict[str, tuple] = {}
        self.pixels = 0

    def add(self, arrays: dict) -> None:
        offsets = arrays["offsets"]
        arrays = arrays | {"offsets": offsets[1 if self.arrays else 0 :] + self.pixels}
        self.pixels += int(offsets[-1])
        for name, value in arrays.items():
            if name not in self.arrays:
                self.arrays[name] = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None), []
            file, chunks = self.arrays[name]
            file.write(np.ascontiguousarray(value).tobytes())
            chunks.append((value.dtype, value.shape))

    def write(self, out: zipfile.ZipFile) -> None:
        for name, (file, chunks) in self.arrays.items():
            kind = np.result_type(*{k for k, _ in chunks})  # strings are as wide as the widest
            shape = (sum(n[0] for _, n in chunks), *chunks[0][1][1:])
            file.seek(0)
            with out.open(f"{name}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
                for own, n in chunks:
                    f.write(np.frombuffer(file.read(own.itemsize * int(np.prod(n, dtype=np.int64))), own).astype(kind).tobytes())
            file.close()


class Writer(DataSourceArrowWriter):
    """One row per event in, with ``pixels``, an array of structs. Parts are written aside and moved when all tasks are done, so
    neither a failed job nor a task that runs twice leaves anything."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        from pyarrow import fs

        system, self.root = fs.FileSystem.from_uri(options["path"])
        if overwrite or _files(options["path"])[1]:
            raise ValueError(f"{options['path']} is there already, or 'overwrite' was asked for; packs are written once")
        self.path, self.aside = options["path"], f"{self.root}/_aside-{uuid.uuid4().hex}"
        system.create_dir(self.aside, recursive=True)

    def write(self, iterator) -> WriterCommitMessage:
        from pyarrow import fs
        from pyspark import TaskContext

        context, held, files = TaskContext.get(), Spool(), []
        system = fs.FileSystem.from_uri(self.path)[0]

        def flush() -> None:
            files.append(f"part-{context.partitionId():05d}-{len(files):04d}-{context.taskAttemptId()}.npz")
            with system.open_output_stream(f"{self.aside}/{files[-1]}") as out, zipfile.ZipFile(out, "w") as z:
                held.write(z)

        for batch in iterator:
            for start in range(0, batch.num_rows, AT_ONCE):
                held.add(_arrays([batch.slice(start, AT_ONCE)]))
            if held.pixels >= PART:
                flush()
                held = Spool()
        if held.arrays:
            flush()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0]
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{self.aside}/{name}", f"{self.root}/{name.rsplit('-', 1)[0]}.npz")
        system.delete_dir(self.aside)

    def abort(self, messages) -> None:
        from pyarrow import fs

        fs.FileSystem.from_uri(self.path)[0].delete_dir(self.aside)


def _arrays(batches: list) -> dict:
    """The arrays of a part."""
    import pyarrow as pa

    table = pa.Table.from_batches(batches).combine_chunks()
    pixels = table.column("pixels").combine_chunks()
    pixels = pixels if isinstance(pixels, pa.ListArray) else pixels.chunk(0)
    sizes = pixels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = pixels.flatten()
    column = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
    out = {"offsets": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), "event_idx": table.column("event_idx").to_numpy(), "event_key": np.array(table.column("event_key").to_pylist(), dtype=str)}
    out |= {c: np.nan_to_num(table.column(c).to_numpy()).astype(NUMPY[k]) for c, k in EVENT_TYPES.items()}
    out["vertex_xyz"] = np.array([v or [np.nan] * 3 for v in table.column("vertex_xyz").to_pylist()], np.float32).reshape(-1, 3)
    out["coords"] = np.stack([column("channel"), column("tick")], 1).astype(np.int32)
    out["features"] = column("charge").astype(np.float32)[:, None]
    names = {flat.type.field(i).name for i in range(flat.type.num_fields)}
    return out | {c: np.nan_to_num(column(c)).astype(NUMPY[k]) for c, k in PIXEL_TYPES.items() if c in names}


class PackedNpz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_npz"

    def schema(self) -> str:
        return ", ".join(f"{c} {k}" for c, k in _columns(self.options).items())

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read(spark: SparkSession, path: str, table: str = "pixels", tiers: str = "", events: tuple[int, int] | None = None) -> DataFrame:
    """The pixels, or the events, of a pack. ``tiers``: "pixel", "extra" or "rich", each with those before it; one that a part lacks is
    an error. ``events``: first and last event; others are not read (a filter on event_idx does the same)."""
    spark.dataSource.register(PackedNpz)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("packed_npz").option("table", table).option("tiers", tiers).load(path)
    return df if events is None else df.where(F.col("event_idx").between(*events))


def pack(events: DataFrame, pixels: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes events (event_idx, event_key, and as far as known label, nu_pdg, nu_ccnc, nu_intType, nu_energy, vertex_xyz) and their
    pixels (event_idx, channel, tick, charge, and columns of tiers) as parts, in the order of event_idx.

    Unknown event columns are -1 or 0 as elsewhere, a vertex that is not known is NaN; missing truth of a pixel is 0. Events without pixels
    are events. Pixels of an event are in the order of their coordinates, and in one part; a task holds PART pixels, after which
    it begins a new part. Pixels of no event are left out.
    """
    from shardloom.sources.tables import UNKNOWN_EVENT

    known = {"labels": "label", **{c: c for c in EVENT_TYPES if c != "labels"}}
    filled = [F.coalesce(F.col(c), F.lit(UNKNOWN_EVENT[c])).cast(EVENT_TYPES[name]).alias(name) if c in events.columns else F.lit(UNKNOWN_EVENT[c]).cast(EVENT_TYPES[name]).alias(name) for name, c in known.items()]
    vertex = F.col("vertex_xyz") if "vertex_xyz" in events.columns else F.lit(None)
    own = events.select(F.col("event_idx").cast("bigint").alias("event_idx"), F.col("event_key").cast("string").alias("event_key"), *filled, vertex.cast("array<float>").alias("vertex_xyz"))
    columns = ["channel", "tick", "charge", *[c for c in PIXEL_TYPES if c in pixels.columns]]
    lists = pixels.groupBy(F.col("event_idx").cast("bigint").alias("event_idx")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("pixels"))
    spark = events.sparkSession
    rows = own.join(lists, "event_idx", "left")
    rows = (rows.repartitionByRange(parts, "event_idx") if parts else rows.repartitionByRange("event_idx")).sortWithinPartitions("event_idx")
    spark.dataSource.register(PackedNpz)
    rows.write.format("packed_npz").mode("append").save(path)
