"""Sources and sinks: tables by tier, metrics logs, result files, shards, feature stores."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the truth tiers, each of which has those before it.
PIXEL = ("pixel_labels",)
EXTRA = ("pixel_energyfrac", "pixel_trackid", "pixel_truth_q")
RICH = ("pixel_labels2", "pixel_trackid2", "pixel_energyfrac2", "pixel_pdg", "pixel_vertex_dist")
PIXEL_TYPES = {"pixel_labels": "tinyint", "pixel_energyfrac": "float", "pixel_trackid": "int", "pixel_truth_q": "float", "pixel_labels2": "tinyint",
               "pixel_trackid2": "int", "pixel_energyfrac2": "float", "pixel_pdg": "int", "pixel_vertex_dist": "float"}
UNKNOWN_EVENT = {"label": -1, "nu_pdg": 0, "nu_ccnc": -1, "nu_intType": -1, "nu_energy": 0.0}

METRICS = T.StructType([T.StructField("stream", T.StringType()), T.StructField("step", T.LongType()), T.StructField("epoch", T.LongType()), T.StructField("rec", T.StringType())])
FORMAT_VERSION = 2


def tier_columns(pixel: bool = False, extra: bool = False, rich: bool = False) -> list[str]:
    """Columns of the asked tiers; a tier brings those before it."""
    return [*(PIXEL if pixel or extra or rich else ()), *(EXTRA if extra or rich else ()), *(RICH if rich else ())]


def read_pixels(spark: SparkSession, path: str, **tiers: bool) -> DataFrame:
    """Pixels with the asked tiers only, which the scan prunes; a tier that the table lacks is an error."""
    df = spark.read.parquet(path)
    if missing := [c for c in tier_columns(**tiers) if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}; write it with these tiers")
    return df.select("event_idx", "channel", "tick", "charge", *tier_columns(**tiers))


def zero_filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a table; one that it lacks is zero."""
    return df.select(*[F.coalesce(F.col(c).cast(k), F.lit(0).cast(k)).alias(c) if c in df.columns else F.lit(0).cast(k).alias(c) for c, k in columns.items()])


def with_unknown(events: DataFrame, truth: DataFrame, key: str = "event_key") -> DataFrame:
    """``events`` with event truth; an event without any is unknown."""
    return events.join(truth, key, "left").na.fill({k: v for k, v in UNKNOWN_EVENT.items() if k in truth.columns})


def list_files(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """(root, path) of the files below several roots, in the order of roots, then paths; nothing is opened."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(r).select(F.lit(i).alias("root"), "path") for i, r in enumerate(roots)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("root", "path")


def companion(path, suffix: str = "_pixeldata-anode0", kind: str = "metadata"):
    """Path of the companion file of a pixel file."""
    return F.concat(F.regexp_replace(path, f"{suffix}[.]h5$", ""), F.lit(f"_{kind}.h5"))


def group_order(name) -> list:
    """Numeric names by value, others last by name."""
    number = name.try_cast("int")
    return [F.coalesce(number, F.lit(1 << 30)), F.when(number.isNull(), name).otherwise("")]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines log as (line, rec VARIANT); blank and half-written lines are skipped, a missing log is empty."""
    try:
        text = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "line string").select("line", F.try_parse_json("line").alias("rec"))
    rows = text.select(F.col("value").alias("line"), F.try_parse_json("value").alias("rec"))
    return rows.where("rec is not null and trim(line) <> ''")


def write_log(records: DataFrame, path: str, most: int = 64) -> None:
    """Appends records as JSON lines: null, NaN, infinite and long array fields are left out."""
    records.select(F.to_json(F.struct(*[jsonable(records, c, most).alias(c) for c in records.columns])).alias("value")).write.mode("append").text(path)


def jsonable(df: DataFrame, name: str, most: int = 64):
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return F.when(F.size(c) <= most, c) if isinstance(kind, T.ArrayType) else c


def log_schema(log: DataFrame) -> DataFrame:
    """(key, n): names that the records of a log have, and how often."""
    return log.select(F.explode(F.json_object_keys("line")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, text) of whole result files, numbered in the order of ``paths``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).makeQualified(jvm.org.apache.hadoop.fs.Path(p)).toUri().getPath()
    order = spark.createDataFrame([(i, whole(p)) for i, p in enumerate(paths)], "ord int, file string")
    plain = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^[a-z0-9]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    text = spark.read.option("wholetext", True).text(paths).select("value", plain.alias("file"))
    return text.join(order, "file").select("ord", F.col("value").alias("text"))


def write_shards(df: DataFrame, path: str) -> None:
    """One gzip Parquet folder per ``shard``; the committer makes the write all or nothing."""
    df.repartition("shard").sortWithinPartitions("shard", "pos").write.mode("error").option("compression", "gzip").partitionBy("shard").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file, ``-`` for missing values."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in df.columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class FeatureStore:
    """Vectors by (source, tap), event means, pools and the provenance that makes them comparable, below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def write_features(self, df: DataFrame, source: str, tap: str, block: int = 0) -> None:
        """``df``: row_idx, vec; stored as float32, partitioned by source, tap and block. A block that is written again is replaced,
        so a job that runs twice leaves its rows once."""
        rows = df.select("row_idx", F.col("vec").cast("array<float>").alias("vec"), F.lit(source).alias("source"), F.lit(tap).alias("tap"), F.lit(block).alias("block"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "tap", "block").parquet(f"{self.root}/features")

    def write_blocks(self, df: DataFrame, source: str) -> None:
        """``df``: row_idx, vec, tap, block; several blocks in one job, each of which is there as a whole or not at all."""
        rows = df.select("row_idx", F.col("vec").cast("array<float>").alias("vec"), F.lit(source).alias("source"), "tap", "block")
        rows.repartition("tap", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "tap", "block").parquet(f"{self.root}/features")

    def blocks(self, source: str, tap: str) -> set[int]:
        """The blocks of a tap that are there: names of folders, no data is read."""
        try:
            return {int(b) for b in partition_values(self.spark, f"{self.root}/features/source={source}/tap={tap}", "block")}
        except Exception as e:
            if "FileNotFoundException" not in str(e):
                raise
            return set()

    def features(self, source: str, tap: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/features").where((F.col("source") == source) & (F.col("tap") == tap)).select("row_idx", "vec")

    def available(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/features").select("source", "tap").distinct()

    def write_table(self, name: str, df: DataFrame) -> None:
        df.write.mode("error").parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write_provenance(self, values: dict[str, str]) -> None:
        row = {**values, "format_version": str(FORMAT_VERSION), "id": uuid.uuid4().hex}
        self.spark.createDataFrame([row]).write.mode("overwrite").json(f"{self.root}/provenance")

    def provenance(self) -> dict[str, str]:
        """Provenance; another format version is an error."""
        row = self.spark.read.json(f"{self.root}/provenance").first().asDict()
        if row["format_version"] != str(FORMAT_VERSION):
            raise ValueError(f"format {row['format_version']}; this library reads {FORMAT_VERSION}")
        return row

    def load(self, source: str, taps: str, pixels: DataFrame, events: DataFrame) -> DataFrame:
        """Features with the truth of their pixels and events; taps joined by ``+`` are put side by side. A row without a pixel is an
        error, and so are taps that don't have the same rows."""
        first, *rest = taps.split("+")
        rows = self.features(source, first)
        for tap in rest:
            rows = rows.join(self.features(source, tap).withColumnRenamed("vec", "__more"), "row_idx", "full")
            lost = F.raise_error(F.concat(F.lit(f"taps {taps} of {source} don't have the same rows; row "), F.col("row_idx").cast("string"), F.lit(" is not in all of them")))
            both = F.col("vec").isNotNull() & F.col("__more").isNotNull()
            rows = rows.select("row_idx", F.when(both, F.concat("vec", "__more")).otherwise(lost.cast("array<float>")).alias("vec"))
        joined = rows.join(self.table("row_space"), "row_idx", "left").join(pixels, "pixel_idx", "left").join(events, "event_idx", "left")
        return joined.where(F.when(F.col("event_idx").isNotNull(), True).otherwise(F.raise_error(F.lit("a feature row has no pixel")).cast("boolean")))


def partition_values(spark: SparkSession, path: str, column: str) -> set[str]:
    """The values of a table's first partition column: names of folders, no data is read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = [f.getPath().getName() for f in found]
    return {unquote(n.removeprefix(f"{column}=")) for n in names if n.startswith(f"{column}=")}


def read_direct(spark: SparkSession, path: str, groups: list[str] | None = None, events: str | None = None, **tiers: bool) -> DataFrame:
    """Pixels of a folder with a table per tier (``pixels``, ``truth``, ``extra``, ``rich``), joined by event_idx, channel and tick
    for the asked tiers only. ``groups``: only these values of a partition column ``group``, which the scan prunes; asking for one
    that is not there is an error. ``events``: a filter on event_idx, pushed to every tier."""
    def table(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        if groups is not None:
            df = df.where(F.col("group").isin(groups))
        return df if events is None else df.where(events)

    rows = table("pixels")
    if groups is not None and (missing := sorted(set(groups) - partition_values(spark, f"{path}/pixels", "group"))):
        raise ValueError(f"{path} has no groups {missing}")
    keys = ["event_idx", "channel", "tick"]
    for name, columns, asked in (("truth", PIXEL, True), ("extra", EXTRA, tiers.get("extra") or tiers.get("rich")), ("rich", RICH, tiers.get("rich"))):
        if asked and any(tiers.values()):
            rows = rows.join(table(name).select(*keys, *columns), keys, "left")
    return rows.select(*keys, "charge", *tier_columns(**tiers))


def read_packed(spark: SparkSession, path: str, events: str | None = None, **tiers: bool) -> DataFrame:
    """Pixels of one table that has all its tiers."""
    rows = read_pixels(spark, path, **tiers)
    return rows if events is None else rows.where(events)


def read_sharded(spark: SparkSession, path: str, shards: list[int] | None = None, events: str | None = None, **tiers: bool) -> DataFrame:
    """Pixels of a table in partitions ``shard``; ``shards``: only these, which the scan prunes; one that is not there is an error."""
    df = spark.read.parquet(path)
    if missing := [c for c in tier_columns(**tiers) if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}; write it with these tiers")
    if shards is not None:
        df = df.where(F.col("shard").isin(shards))
        if lost := sorted(set(shards) - {int(s) for s in partition_values(spark, path, "shard")}):
            raise ValueError(f"{path} has no shards {lost}")
    df = df if events is None else df.where(events)
    return df.select("shard", "event_idx", "channel", "tick", "charge", *tier_columns(**tiers))


#: Sources by name: (spark, path, options, tiers) to a table.
BACKENDS: dict[str, Callable[..., DataFrame]] = {"packed": read_packed, "sharded": read_sharded, "direct": read_direct}


def build(spark: SparkSession, backend: str, path: str, **options) -> DataFrame:
    """The table of a backend, with its options and the tiers asked for; an unknown name is an error."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; known: {', '.join(BACKENDS)}")
    return BACKENDS[backend](spark, path, **options)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode,
    an error on a cluster."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="shardloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, for what is used several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
