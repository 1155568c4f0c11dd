"""Reports across runs: results merged from JSON, pivoted, grouped by seed; configs and campaigns compared."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.expressions import formatted

#: Keys of a config that differ between runs without meaning.
NOISE = ("run.name", "run.output_root", "hydra.")
#: Names under which campaigns vary the seed.
SEED_KEYS = ("seed", "run.seed", "data.seed")


def merge_results(files: DataFrame) -> DataFrame:
    """(label, metric, body VARIANT) of result files (ord, text): a later file replaces a whole metric of a label; text that is no JSON object is skipped."""
    parsed = files.select("ord", F.try_parse_json("text").alias("v")).where("v is not null")
    rows = files.sparkSession.sql(
        "SELECT f.ord, l.key AS label, m.key AS metric, to_json(m.value) AS body FROM {f} f, LATERAL variant_explode(f.v) l, LATERAL variant_explode(l.value) m "
        "WHERE schema_of_variant(f.v) LIKE 'OBJECT%' AND schema_of_variant(l.value) LIKE 'OBJECT%'",
        f=parsed,
    )
    last = rows.groupBy("label", "metric").agg(F.max_by("body", "ord").alias("body"))
    return last.select("label", "metric", F.parse_json("body").alias("body"))


def dig(variant: Column, *paths: list[str] | str) -> Column:
    """The first path that leads to a number: dotted, or a list of keys, which may hold dots themselves."""
    steps = lambda p: "".join(f'["{k}"]' for k in (p.split(".") if isinstance(p, str) else p))
    return F.coalesce(*[F.try_variant_get(variant, "$" + steps(p), "double") for p in paths])


def pivot_metrics(results: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per label, a column for each name of ``columns`` (name: metric, path); null where a label lacks it."""
    cell = lambda metric, path: F.max(F.when(F.col("metric") == metric, dig(F.col("body"), path)))
    return results.groupBy("label").agg(*[cell(m, p).alias(name) for name, (m, p) in columns.items()])


def populated(table: DataFrame, names: list[str]) -> list[str]:
    """The columns that have a value anywhere."""
    counts = table.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if counts[c]]


def unmapped(results: DataFrame, known: list[str]) -> DataFrame:
    """Metrics of the results that no column shows."""
    return results.select("metric").distinct().where(~F.col("metric").isin(known))


def group_seeds(table: DataFrame, family: str, numbers: list[str], texts: list[str], decimals: int = 4) -> DataFrame:
    """Replica groups: means and sample deviations of the numbers as shown (rounded), texts in common or joined by ``/``, and n."""
    shown = lambda c: formatted(F.col(c), decimals).try_cast("double")
    parts = [x for c in numbers for x in (F.avg(shown(c)).alias(f"{c}_mean"), F.stddev_samp(shown(c)).alias(f"{c}_std"))]
    return table.groupBy(family).agg(*parts, *[F.array_join(F.array_sort(F.collect_set(c)), "/").alias(c) for c in texts], F.count(F.lit(1)).alias("n"))


def differing_keys(configs: DataFrame, include_noise: bool = False) -> DataFrame:
    """Keys (of run, key, value) whose value differs between runs, absence being a value: (key, n_values, n_runs); none with under two runs."""
    n = configs.agg(F.count_distinct("run").alias("n_all"))
    rows = configs if include_noise else configs.where(~F.array_contains(F.array(*[F.col("key").startswith(p) for p in NOISE]), True))
    counts = rows.groupBy("key").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("run").alias("n_runs"))
    return counts.crossJoin(F.broadcast(n)).where("n_all >= 2 and (n_values > 1 or n_runs < n_all)").drop("n_all")


def flatten(node, prefix: str = "") -> dict[str, object]:
    """Nested mappings and lists to dotted keys with ``[i]``."""
    if isinstance(node, dict):
        parts = [(f"{prefix}.{k}" if prefix else str(k), v) for k, v in node.items()]
    elif isinstance(node, list):
        parts = [(f"{prefix}[{i}]", v) for i, v in enumerate(node)]
    else:
        return {prefix: node}
    return {k: v for p in parts for k, v in flatten(p[1], p[0]).items()}


def config_table(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """(run, key, value) of nested configs."""
    rows = [(run, k, str(v)) for run, c in configs.items() for k, v in flatten(c).items()]
    return spark.createDataFrame(rows, "run string, key string, value string")


def point_hash(overrides: Column) -> Column:
    """First 8 hex digits of the SHA-256 over sorted overrides, a line each."""
    return F.substring(F.sha2(F.array_join(F.array_sort(overrides), "\n"), 256), 1, 8)


def axis_values(override: str) -> list[str]:
    """Values of a sweep override: ``a,b`` choices or ``range(start, stop[, step])``."""
    if found := re.fullmatch(r"range\((.*)\)", override.strip()):
        return [str(i) for i in range(*(int(x) for x in found[1].split(",")))]
    return [x.strip() for x in override.split(",")]


def manifest(spark: SparkSession, sweep: str, overrides: list[str], most: int = 10_000) -> DataFrame:
    """(sweep_id, point, overrides, hash, replica_group): the product of all axes; a replica group leaves the seed axis out. More than ``most`` points are refused."""
    axes = [(key, axis_values(values)) for key, _, values in (o.partition("=") for o in overrides)]
    n = 1
    for _, values in axes:
        n *= len(values)
    if n > most:
        raise ValueError(f"{n} points; at most {most}")
    points = [[f"{k}={v}" for (k, _), v in zip(axes, p, strict=True)] for p in itertools.product(*[v for _, v in axes])]
    rows = spark.createDataFrame([(sweep, i, p) for i, p in enumerate(points)], "sweep_id string, point long, overrides array<string>")
    seedless = F.filter("overrides", lambda o: ~F.split_part(o, F.lit("="), F.lit(1)).isin(*SEED_KEYS))
    return rows.select("*", point_hash(F.col("overrides")).alias("hash"), point_hash(seedless).alias("replica_group"))


def replica_label(axes: Column, seed_keys: tuple[str, ...] = SEED_KEYS) -> Column:
    """``k=v,..`` of a map of axes without the seed, keys sorted."""
    kept = F.map_filter(axes, lambda k, v: ~k.isin(*seed_keys))
    return F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def render(header: list[str], rows: list[list[str]], markdown: bool = False) -> str:
    """A small table as text with padded columns."""
    widths = [max(len(str(r[i])) for r in [header, *rows]) for i in range(len(header))]
    line = lambda r: (" | " if markdown else "  ").join(str(c).ljust(w) for c, w in zip(r, widths, strict=True))
    out = [line(header), line(["-" * w for w in widths]), *map(line, rows)]
    return "\n".join(f"| {x} |" if markdown else x.rstrip() for x in out)


def requested(asked: DataFrame, present: DataFrame, key: str = "epoch") -> tuple[DataFrame, DataFrame]:
    """(found in order, missing) of what is asked for."""
    return asked.join(present.select(key).distinct(), key, "left_semi").orderBy(key), asked.select(key).exceptAll(present.select(key).distinct().join(asked.select(key), key, "left_semi"))


def run_label(store: Column, source: Column, tap: Column) -> Column:
    """``<run>:ep<N>:<source>``, and ``:<tap>`` for taps but 'out', of a store's path ``<run>/features/epoch<N>``."""
    parts = F.filter(F.split(store, "/"), lambda x: x != "")
    name = F.try_element_at(parts, F.lit(-1))
    run = F.coalesce(F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2)), F.lit(""))
    epoch = F.when(name.startswith("epoch"), F.concat(F.lit("ep"), F.substr(name, F.lit(6)))).otherwise(name)
    return F.concat_ws(":", run, epoch, source, F.when(tap != "out", tap))


def flat_provenance(prov: Column, sample: Column) -> Column:
    """What a probe reads of an extraction's provenance, a struct; ``prov`` has the fields named here, ``params`` (kind, min_val,
    max_val) of a log transform and ``extra`` (epoch, module.backbone)."""
    log = prov["params"]["kind"] == "log"
    plain = ("apa", "view", "rows", "eval_set_id", "event_key_hash", "checkpoint", "checkpoint_sha256", "git_sha", "charge_transform", "extract_seconds", "events_per_second")
    return F.struct(
        F.coalesce(prov["extra"]["epoch"].cast("string"), F.lit("?")).alias("epoch"), F.coalesce(prov["extra"]["module"]["backbone"], F.lit("?")).alias("backbone_name"), *[prov[c].alias(c) for c in plain], sample.alias("sample"),
        F.when(log, True).alias("use_log_transform"), F.when(log, prov["params"]["min_val"].cast("double")).alias("feat_min_val"), F.when(log, prov["params"]["max_val"].cast("double")).alias("feat_max_val"),
    )


def run_header(features: DataFrame, provenance: dict, source: str, tap: str, truth: list[str], seed: int, per_class: int, group: str = "event_idx") -> DataFrame:
    """One row beside every metric: sizes of the features (group, vec), what they were made of, and how pools are drawn."""
    fixed = {"feature_source": source, "tap": tap, "truth_channels": ",".join(sorted(truth)), "seed": seed, "pool_per_class": per_class,
             "raw_charge_transform": "trained" if provenance.get("use_log_transform") else "log10_1p", "rows": provenance.get("rows") or "all",
             **{k: provenance.get(k) or "" for k in ("eval_set_id", "event_key_hash", "checkpoint_sha256")}, "sample": provenance.get("sample") or "in-sample"}
    sizes = features.agg(F.count_distinct(group).alias("n_events"), F.count(F.lit(1)).alias("n_pixels"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("feature_dim"))
    return sizes.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])


def write_results(results: DataFrame, path: str) -> None:
    """Results (label, metric, body as JSON text) as one nested JSON object per file; the committer renames whole files into place,
    so that readers see all of a write or nothing. One label's metrics make a line."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^.(.*).$", 1)
    parts = F.array_join(F.array_sort(F.collect_list(F.concat(quoted(F.col("metric")), F.lit(":"), F.col("body")))), ",")
    line = F.concat(F.lit("{"), quoted(F.col("label")), F.lit(":{"), parts, F.lit("}}"))
    results.groupBy("label").agg(line.alias("value")).select("value").write.mode("error").text(path)


def write_manifest(points: DataFrame, path: str) -> None:
    """A campaign's points (of ``manifest``) as JSON lines in one file; a manifest that is there is replaced as a whole."""
    points.orderBy("point").coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The points of a campaign (sweep_id, point, overrides, hash, replica_group); a folder without a manifest is an error."""
    try:
        return spark.read.schema("sweep_id string, point long, overrides array<string>, hash string, replica_group string").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"{path} has no manifest; a sweep writes one") from e


def config_columns(results: DataFrame, configs: DataFrame) -> DataFrame:
    """(label, key, value) of the config keys that differ between the runs of the results' labels (``<run>:..``); '-' where a run
    with a config lacks the key. A run without config has no rows."""
    from shardloom.functions.expressions import run_of

    runs = results.select("label").distinct().withColumn("run", run_of(F.col("label")))
    own = configs.join(runs.select("run").distinct(), "run", "left_semi")
    keys = differing_keys(own).select("key")
    rows = runs.join(own.select("run").distinct(), "run").crossJoin(F.broadcast(keys))  # a table of runs and config keys is small
    return rows.join(own.select("run", "key", "value"), ["run", "key"], "left").select("label", "key", F.coalesce("value", F.lit("-")).alias("value"))


def result_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, path) of the probe results below run folders: JSON files in a folder ``probes``, which may be a root itself."""
    from shardloom.sources.tables import list_files

    return list_files(spark, roots, "*.json").where(F.element_at(F.split("path", "/"), -2) == "probes")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of a file, or of the files of a folder, of any size: a task reads a file in blocks. Files are dealt out one by one."""

    def digest(batches):
        import hashlib
        import re
        from urllib.parse import quote

        from pyarrow import fs

        for part in batches:
            found = []
            for p in part["path"]:
                local = re.match("file:/+(.*)", p)
                system, own = (fs.LocalFileSystem(), f"/{local[1]}") if local else fs.FileSystem.from_uri(quote(p, safe=":/"))
                sums = hashlib.sha256()
                with system.open_input_stream(own) as f:
                    while block := f.read(1 << 23):
                        sums.update(block)
                found.append(sums.hexdigest())
            yield part.assign(sha256=found)

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)  # with the empty ones, which a scan leaves out
    names = [(f.getPath().toString(),) for f in listed if f.isFile()]
    return spark.createDataFrame(names, "path string").repartition(F.col("path")).mapInPandas(digest, "path string, sha256 string")


def uniform_chance(classes: Column) -> Column:
    """The accuracy of guessing among the classes of a list at random; null without any."""
    return F.try_divide(F.lit(1.0), F.nullif(F.size(classes), F.lit(0)))


def charge_spec(config: dict | None) -> tuple[str, dict]:
    """('log[low,high]', parameters) of a normalisation's settings; 'none' if it is off or incomplete."""
    if not config or not config.get("enabled", True) or any(config.get(k) is None for k in ("min_val", "max_val")):
        return "none", {}
    low, high = float(config["min_val"]), float(config["max_val"])
    return f"log[{low:g},{high:g}]", {"kind": "log", "min_val": low, "max_val": high}


def take_option(args: list[str], name: str, default: str | None = None) -> tuple[str | None, list[str]]:
    """(value, other arguments) of ``name=value`` or ``name value``; of several the last counts."""
    value, rest, at = default, [], 0
    while at < len(args):
        key, eq, own = args[at].partition("=")
        if key == name and eq:
            value = own
        elif key == name and at + 1 < len(args):
            at += 1
            value = args[at]
        else:
            rest.append(args[at])
        at += 1
    return value, rest


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions that a result depends on, and where it ran."""
    import platform

    import numpy
    import pandas
    import pyarrow

    sc = spark.sparkContext
    return {"python": platform.python_version(), "spark": spark.version, "java": sc._jvm.System.getProperty("java.version"), "numpy": numpy.__version__, "pandas": pandas.__version__,
            "pyarrow": pyarrow.__version__, "master": sc.master, "application": sc.applicationId, "parallelism": str(sc.defaultParallelism)}


def repository(folder: str = ".") -> dict[str, str]:
    """Commit, branch and state of the repository that a run was started in; without one, what GIT_SHA, GIT_BRANCH and GIT_DIRTY (0 or 1) say, as
    a job sees that was sent there without its repository; without these, nothing."""
    import os
    import subprocess

    def said(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    sha = said("rev-parse", "HEAD")
    if sha:
        return {"sha": sha, "branch": said("rev-parse", "--abbrev-ref", "HEAD") or "", "dirty": str(bool(said("status", "--porcelain"))).lower()}
    if not os.environ.get("GIT_SHA"):
        return {}
    dirty = {"0": "false", "1": "true"}.get(os.environ.get("GIT_DIRTY", ""), "unknown")
    return {"sha": os.environ["GIT_SHA"], "branch": os.environ.get("GIT_BRANCH", ""), "dirty": dirty}


def run_metadata(spark: SparkSession, config: dict, args: list[str], derived: dict | None = None, module: str = "", folder: str = ".", data: dict | None = None) -> DataFrame:
    """(section, key, value): what a run was started with, on which data and code, its environment and what follows from them."""
    parts = {"git": repository(folder), "data": flatten(data or {}), "config": flatten(config), "launch": {"args": " ".join(args), "module": module}, "environment": environment(spark), "derived": flatten(derived or {})}
    return spark.createDataFrame([(name, k, str(v)) for name, values in parts.items() for k, v in values.items()], "section string, key string, value string")


def write_run(metadata: DataFrame, folder: str) -> None:
    """A run's metadata below its folder; a run that is there already is an error."""
    metadata.coalesce(1).write.mode("error").json(f"{folder}/metadata")
