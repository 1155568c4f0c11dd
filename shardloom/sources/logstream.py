"""Metrics logs that are still being written, as a stream: a Data Source that reads JSON lines by byte offsets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shardloom.operators import series

#: Bytes of a task's part of a log; bytes that are read at once.
SPLIT, BLOCK = 32 << 20, 1 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def whole_lines(system, path: str, size: int) -> int:
    """The place after the last line break of a file, found from its end; a line that is half written is not counted."""
    with system.open_input_file(path) as f:
        while size:
            start = max(0, size - BLOCK)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


def log_files(path: str) -> dict[str, int]:
    """The files of a log and the bytes of whole lines in each. A log that isn't there yet has none."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if info.type == fs.FileType.Directory else []
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p.removeprefix(root).split("/"))
    return {f.path: whole_lines(system, f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path)}


class Bytes(InputPartition):
    """Lines that begin from ``start`` to ``stop``, of the lines of a batch, which are those from ``first`` to ``end``."""

    def __init__(self, path: str, start: int, stop: int, first: int, end: int) -> None:
        self.path, self.start, self.stop, self.first, self.end = path, start, stop, first, end


def splits(start: dict, end: dict) -> list[Bytes]:
    """Parts of what is new. A part has the lines that begin in it, so a file is read by many tasks wherever its lines break."""
    found = []
    for path, to in sorted(end.items()):
        at = start.get(path, 0)
        if to < at:
            raise ValueError(f"{path} has {to} bytes of lines, {at} were read; a log that was cut is read anew, with another checkpoint")
        found += [Bytes(path, a, min(a + SPLIT, to), at, to) for a in range(at, to, SPLIT)]
    if lost := set(start) - set(end):
        raise ValueError(f"{', '.join(sorted(lost))} was read and is gone; a log that was cut is read anew, with another checkpoint")
    return found


def lines(uri: str, part: Bytes) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a part."""
    system, _ = _system(uri)
    with system.open_input_file(part.path) as f:
        skip = part.start > part.first  # a line that began before is of the part before; the byte before says if one did
        at, held = part.start - skip, b""
        f.seek(at)
        while at < part.end:
            block = f.read(min(BLOCK, part.end - at - len(held)))
            if not block:
                return
            held += block
            *whole, held = held.split(b"\n")
            for line in whole:
                if skip:
                    skip = False
                elif at >= part.stop:
                    return
                else:
                    yield at, line
                at += len(line) + 1


class _Lines:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def _read(self, part: Bytes) -> Iterator:
        import pyarrow as pa

        rows: list = []

        def batch():
            own = [r for r in rows if r[1].strip()]
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(own), pa.string()), pa.array([r[0] for r in own], pa.int64()), pa.array([r[1].decode(errors="replace") for r in own], pa.string())], ["file", "place", "line"])

        size = 0
        for row in lines(self.path, part):
            rows.append(row)
            size += len(row[1])
            if size > BLOCK:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class StreamReader(_Lines, DataSourceStreamReader):
    """Offsets are the bytes of each file; what is read between two offsets is the same whenever it is read again."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return log_files(self.path)

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        return splits(start, end)

    def read(self, partition: Bytes) -> Iterator:
        return self._read(partition)


class BatchReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Bytes]:
        return splits({}, log_files(self.path)) or [Bytes("", 0, 0, 0, 0)]

    def read(self, partition: Bytes) -> Iterator:
        return self._read(partition) if partition.path else iter(())


class MetricsLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metrics_log"

    def schema(self) -> str:
        return "file string, place bigint, line string"

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def _records(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rec", F.try_parse_json("line")).where("rec is not null")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line, rec VARIANT) of a log's whole lines: of a file, or of all files of a folder but those that begin with ``_`` or
    ``.``. ``place`` is the line's first byte. Blank lines and lines that are no JSON are left out, and so is a last line
    without its break, which may be half written; a log that isn't there yet is empty."""
    spark.dataSource.register(MetricsLog)
    return _records(spark.read.format("metrics_log").load(path))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over a log that grows: a batch has the lines that were finished since the last one, a half-written line is left
    for the batch after it is finished. A restart goes on at the byte where the checkpoint is. A log that was cut, as a
    resumed run does, is an error for whoever has read what was cut off."""
    spark.dataSource.register(MetricsLog)
    return _records(spark.readStream.format("metrics_log").load(path))


def resume(spark: SparkSession, path: str, to: str, step: int, stream: str = "step") -> None:
    """Writes the log that a run goes on with when it resumes at ``step`` to the new folder ``to``: half lines are gone, the step stream loses
    records from ``step`` on, others those after it (see ``series.truncate``). Lines stay in the order of files and places."""
    rows = read(spark, path).select("file", "place", "line", F.try_variant_get("rec", "$.step", "bigint").alias("at"), F.lit(stream).alias("stream"))
    kept = series.truncate(rows, "stream", "at", step)
    kept.repartitionByRange("file", "place").sortWithinPartitions("file", "place").select("line").write.mode("error").text(to)
