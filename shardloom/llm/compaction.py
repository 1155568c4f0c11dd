"""Sharding by size-tiered compaction: arrivals are appended as small immutable shards, runs of shards of similar size are
merged into files of a target size, and every change is one atomically committed version of a manifest.

A version's file has the shards that it adds and the paths that it removes; every SNAPSHOT-th has all its shards instead, so
that a commit writes little and a reader needs few files. The schema of the store's rows is in every version.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a finished shard, and shards of a tier that make a run.
TARGET, FANOUT = 128 << 20, 4
#: Compression of shards, which are written twice or more and kept.
CODEC = "zstd"
#: Share of the target that the parts of a merged shard fill.
ROOM = 0.9
#: Versions from one complete list of shards to the next; seconds for which files of no version are kept, as a writer may be about to commit them.
SNAPSHOT, GRACE = 32, 24 * 3600
#: Runs that one job merges, and jobs in which shards over the target are cut: what is on disk twice meanwhile is a STEPS-th of them.
AT_ONCE, STEPS = 200, 8


@dataclass(frozen=True)
class Shard:
    """An immutable file: its path below the store's root, its bytes and rows."""

    path: str
    bytes: int
    rows: int


def tier(size: int, target: int = TARGET, fanout: int = FANOUT) -> int:
    """0 for a shard of target / fanout or more, which is finished; k for sizes down to target / fanout ** (k + 1)."""
    k, low = 0, target / fanout
    while size < low and k < 40:
        k, low = k + 1, low / fanout
    return k


def plan(shards: list[Shard], target: int = TARGET, fanout: int = FANOUT) -> list[list[Shard]]:
    """Runs to merge now: of the shards of one tier, smallest first, as many as stay within ROOM of the target, as a merged file may
    be larger than its parts together; only tiers with ``fanout`` shards or more."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        tiers.setdefault(tier(s.bytes, target, fanout), []).append(s)
    out = []
    for k, members in sorted(tiers.items()):
        if k == 0 or len(members) < fanout:
            continue
        run: list[Shard] = []
        for s in sorted(members, key=lambda s: (s.bytes, s.path)):
            if run and sum(x.bytes for x in run) + s.bytes > target * ROOM:
                out.append(run)
                run = []
            run.append(s)
        out.append(run)
    return [run for run in out if len(run) > 1]


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """A folder with ``data/`` and ``manifest/``, reached through Spark's file systems only. Readers see a version or the next, never a mixture.

    Rows keep their values, nulls and repetitions; texts of any length are rows like any other. Appends may bring further
    columns, which older rows have as null; another type of a known column is an error.
    A store without rows reads as an empty table of its schema; one without any version can't be read.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """The committed versions that are still kept."""
        folder = self._path("manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default the newest."""
        v = self.version() if version is None else version
        steps = []
        while v:
            steps.append(self._manifest(v))
            if "all" in steps[-1]:
                break
            v -= 1
        found: dict[str, Shard] = {}
        for step in reversed(steps):
            for path in step.get("remove", ()):
                found.pop(path)
            found |= {s["path"]: Shard(**s) for s in step.get("all", step.get("add"))}
        return list(found.values())

    def schema(self, version: int | None = None) -> T.StructType:
        """The schema of a version's rows."""
        v = self.version() if version is None else version
        return T.StructType.fromJson(self._manifest(v)["schema"]) if v else T.StructType()

    def commit(self, add: list[Shard], after: int, remove: list[str] | tuple = (), schema: T.StructType | None = None) -> int:
        """Makes the shards of version ``after``, less ``remove``, and ``add`` the next version; Conflict if there is one already.
        The manifest is written aside and renamed without overwriting, which file systems do at once."""
        aside, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{after + 1:08d}.json")
        body = {"version": after + 1, "schema": (self.schema(after) if schema is None else schema).jsonValue()}
        if after % SNAPSHOT == 0:
            gone = set(remove)
            body["all"] = [asdict(s) for s in [*(self.shards(after) if after else ()), *add] if s.path not in gone]
        else:
            body |= {"add": [asdict(s) for s in add], "remove": [*remove]}
        out = self.fs.create(aside)
        out.write(json.dumps(body).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.getFileSystem(self.conf).getUri(), self.conf).rename(
                self.fs.makeQualified(aside), self.fs.makeQualified(final), options
            )
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(final):
                raise Conflict(f"version {after + 1} exists") from e
            raise
        return after + 1

    def _written(self, folder: str) -> list[Shard]:
        """The shards with rows of a folder that a job has written."""
        files, found = self.fs.listFiles(self._path(folder), True), {}
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found[f.getPath().toUri().getPath().partition(f"/{folder}/")[2]] = f.getLen()
        if not found:
            return []
        name = F.substring_index(F.col("_metadata.file_path"), f"/{folder}/", -1)
        # a row per file, as many as the manifest holds
        rows = {r["name"]: r["count"] for r in self.spark.read.parquet(f"{self.root}/{folder}").groupBy(name.alias("name")).count().collect()}
        return [Shard(f"{folder}/{n}", size, rows[n]) for n, size in sorted(found.items()) if rows.get(n)]

    def _write(self, df: DataFrame, target: int) -> list[Shard]:
        """Writes a shard per partition; those over the target are cut by rows, again and again, but for single rows over it,
        some at a time."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", CODEC).parquet(f"{self.root}/{folder}")
        done = self._written(folder)
        while large := [s for s in done if s.bytes > target and s.rows > 1]:
            gone = {s.path for s in large}
            done = [s for s in done if s.path not in gone]
            several = -(-len(large) // STEPS)
            for k in range(0, len(large), several):
                done += self._cut(large[k : k + several], df.schema, target)
        return done

    def _cut(self, large: list[Shard], schema: T.StructType, target: int) -> list[Shard]:
        """Writes shards that no version has again in parts, by rows, and deletes them."""
        folder = f"data/{uuid.uuid4().hex}"
        per_file = max(1, min(s.rows * target // (s.bytes + s.bytes // 4 + 1) or s.rows // 2 for s in large))
        per_file = min(per_file, max(s.rows for s in large) // 2)
        self._read(large, schema).write.options(maxRecordsPerFile=max(1, per_file), compression=CODEC).parquet(f"{self.root}/{folder}")
        parts = self._written(folder)
        for s in large:
            self.fs.delete(self._path(s.path), False)
        return parts

    def append(self, df: DataFrame, target: int = TARGET) -> int:
        """Adds the rows as small shards, none over ``target``; returns the version that has them."""
        new = self._write(df, target)
        while True:
            at = self.version()
            try:
                return self.commit(new, at, schema=self._joint(self.schema(at), df.schema))
            except Conflict:
                continue

    @staticmethod
    def _joint(old: T.StructType, new: T.StructType) -> T.StructType:
        kinds = {f.name: f.dataType for f in old.fields}
        if wrong := [f.name for f in new.fields if f.name in kinds and kinds[f.name].simpleString() != f.dataType.simpleString()]:
            raise ValueError(f"columns {wrong} have other types in the store")
        return T.StructType([*old.fields, *[T.StructField(f.name, f.dataType, True) for f in new.fields if f.name not in kinds]])

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> int:
        """Merges runs until no tier has ``fanout`` shards; returns the version.

        Commits that come in meanwhile stand: if they leave the merged shards in place, as appends do, the merge is committed
        after them; else its files are deleted and the rest is planned anew.
        """
        while runs := plan(self.shards(at := self.version()), target, fanout):
            merged, gone = self._merge(runs, target), [s.path for run in runs for s in run]
            while not set(gone) - {s.path for s in self.shards(at)}:
                try:
                    at = self.commit(merged, at, gone)
                    break
                except Conflict:
                    at = self.version()
            else:
                for s in merged:
                    self.fs.delete(self._path(s.path), False)
        return at

    def _merge(self, runs: list[list[Shard]], target: int) -> list[Shard]:
        """A file for each run: a run is read by one task, which holds rows of at most the target size, and nothing is shuffled.
        A job takes AT_ONCE runs."""
        out, schema = [], self.schema()
        for k in range(0, len(runs), AT_ONCE):
            parts = [self._read(run, schema).coalesce(1) for run in runs[k : k + AT_ONCE]]
            out += self._write(reduce(DataFrame.unionByName, parts), target)
        return out

    def _read(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        v = self.version() if version is None else version
        if not v:
            raise ValueError(f"{self.root} has no version yet")
        found, schema = self.shards(v), self.schema(v)
        return self._read(found, schema) if found else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Deletes the files that none of the last ``keep`` versions has, those of no version only if they are older than
        ``grace`` seconds, such as a failed job's; and the manifests before the complete list that the kept versions build on."""
        every = self.versions()
        if not every:
            return
        live = {s.path for v in every[-keep:] for s in self.shards(v)}
        base = next(v for v in reversed(every[: len(every[:-keep]) + 1]) if "all" in self._manifest(v))
        known = {s["path"] for v in every for m in [self._manifest(v)] for s in m.get("all", m.get("add"))}
        for v in every:
            if v < base:
                self.fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        files, old = self.fs.listFiles(self._path("data"), True), (time.time() - grace) * 1000
        while files.hasNext():
            f = files.next()
            path = "data/" + f.getPath().toUri().getPath().rpartition("/data/")[2]
            if path not in live and (path in known or f.getModificationTime() < old):
                self.fs.delete(f.getPath(), False)
