"""Series of a metrics log: long form, families of keys, smoothing, truncation and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(records: DataFrame, keep: list[str], rec: str = "rec") -> DataFrame:
    """Rows (keep.., key, value) of every finite number in a VARIANT record; booleans, text and absent keys are no rows."""
    kept = ", ".join(f"r.{c}" for c in keep)
    rows = records.sparkSession.sql(
        f"SELECT {kept}, e.key, try_variant_get(e.value, '$', 'double') AS value FROM {{records}} r, LATERAL variant_explode(r.{rec}) e "
        "WHERE schema_of_variant(e.value) NOT IN ('BOOLEAN', 'STRING')",
        records=records,
    )
    return rows.where("value is not null and not isnan(value) and abs(value) < double('infinity')")


def families(series: DataFrame, prefix: str, depth: int) -> DataFrame:
    """Distinct beginnings, of ``depth`` parts between slashes, of the keys with a prefix."""
    return series.where(F.col("key").startswith(prefix)).select(F.array_join(F.slice(F.split("key", "/"), 1, depth), "/").alias("family")).distinct()


def smooth(series: DataFrame, window: int, by: list[str], order: list[str], value: str = "value", out: str = "smooth") -> DataFrame:
    """Centred rolling mean over window // 2 rows on each side, fewer at the ends; a window of 1 or less changes nothing."""
    if window <= 1:
        return series.withColumn(out, F.col(value))
    half = window // 2
    return series.withColumn(out, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)))


def smallest_magnitude(value: str) -> Column:
    """Aggregate: the smallest magnitude that is not 0."""
    return F.min(F.when(F.col(value) != 0, F.abs(F.col(value))))


def agree(series: DataFrame, curve: str, x: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: do all curves have the same value wherever several have one?"""
    spread = series.groupBy(x).agg((F.max(value) - F.min(value)).alias("d"), F.count_distinct(curve).alias("n")).where("n > 1")
    return spread.agg(F.coalesce(F.bool_and(F.col("d") <= tolerance), F.lit(True)).alias("agree"))


def truncate(records: DataFrame, stream: str, step: str, resume: int) -> DataFrame:
    """Records to keep when a run resumes: the step stream loses steps from ``resume`` on, others those after it; a record without a step counts as -1."""
    at = F.coalesce(step, F.lit(-1))
    return records.where(F.when(F.col(stream) == "step", at < resume).otherwise(at <= resume))


def last_of_epoch(records: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """Per epoch the value at its last step, and its number of steps."""
    return records.groupBy(*by).agg(F.max_by(value, step).alias("last"), F.max(step).alias("last_step"), F.count(F.lit(1)).alias("n_steps"))


def reduce_ranks(produced: DataFrame, ranks: int, how: str) -> DataFrame:
    """Per (step, key) the sum, mean or max over ranks; a rank without the key counts 0."""
    n = F.count(F.lit(1))
    missing = n < ranks
    out = {"sum": F.sum("value"), "mean": F.sum("value") / ranks, "max": F.when(missing, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value"))}[how]
    return produced.groupBy("step", "key").agg(out.alias("value"))


def rows_with_material(produced: DataFrame, ranks: int) -> DataFrame:
    """(step, complete): have all ranks produced something?"""
    return produced.groupBy("step").agg((F.count_distinct("rank") == ranks).alias("complete"))


def silent(runs: DataFrame, series: DataFrame, key: str = "run") -> DataFrame:
    """Runs without any row of the series."""
    return runs.select(key).distinct().join(series, key, "left_anti")


def summary(records: DataFrame, by: list[str], step: str, size: Column) -> DataFrame:
    """Per stream: records, bytes, first and last step."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.min(step).alias("first_step"), F.max(step).alias("last_step"))


def applied(schedule: DataFrame, groups: DataFrame) -> DataFrame:
    """(step, key, value) of what schedules (step, key, value) come to for parameter groups (name, key, scale): the scheduled value, and
    ``<key>/<name>`` with the scaled value of each named group whose scale is not 1; a null scale is 1."""
    scaled = groups.where("name is not null and scale <> 1").select("key", "name", "scale")
    own = schedule.join(F.broadcast(scaled), "key")  # groups are a model's, some at most
    own = own.select("step", F.concat("key", F.lit("/"), "name").alias("key"), (F.col("value") * F.col("scale")).alias("value"))
    return schedule.select("step", "key", "value").unionByName(own)
