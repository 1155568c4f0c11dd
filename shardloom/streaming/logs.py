"""Metrics logs as streams: appended records, cadence, and moving means kept as state."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shardloom.operators.grouped import if_few
from shardloom.sources.tables import cut


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str):
    """Appends the stream as JSON lines, what is there now, then ends; ``checkpoint`` is where a restart goes on."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(stream: DataFrame, step: str, cadence: int) -> DataFrame:
    """Records of the steps at which something with this cadence fires."""
    return stream.where(F.pmod(F.col(step), F.lit(cadence)) == 0)


def _latest(rows: pd.DataFrame, step: str, n: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The ``n`` rows of the largest steps, and the others."""
    rows = rows.sort_values(step, kind="stable")
    return rows.iloc[-n:], rows.iloc[:-n]


def moving_mean(stream: DataFrame, momentum: float, by: str = "key", step: str = "step", value: str = "value") -> DataFrame:
    """(key, n, mean): exponential moving mean of a key's values, batch by batch in the order of steps. The first value is
    taken as it is; null values change nothing. The state of a key is two numbers.

    A key's rows of a batch come in parts, in any order. Only the last of them, by steps, are held: those whose weight is not zero in
    double precision, whatever they are (14,146 for a momentum of 0.9). An infinite value before them is not forgotten.
    """
    last = math.ceil(-2150 * math.log(2) / math.log(momentum)) + 1 if 0 < momentum < 1 else None if momentum else 1

    def update(key, parts, state: GroupState):
        mean, n = state.get if state.exists else (None, 0)
        held, before, lost = None, n, 0.0
        for part in parts:
            own = part[[step, value]].dropna(subset=[value])
            held, n = own if held is None else pd.concat([held, own], ignore_index=True), n + len(own)
            if last and len(held) > 2 * last:
                held, gone = _latest(held, step, last)
                lost += float(gone[value].astype(float).loc[lambda v: v.abs() == math.inf].sum())
        if held is not None and len(held):
            values = held.sort_values(step, kind="stable")[value].astype(float).tolist()
            if n - before > len(values) and (mean is None or math.isfinite(mean)):
                mean = None  # its weight is zero by now
            if lost or lost != lost:
                mean = lost if mean is None else mean + lost
            for v in values:
                mean = v if mean is None else momentum * mean + (1 - momentum) * v
        if mean is not None:
            state.update((mean, n))
        yield pd.DataFrame({by: [key[0]], "n": [n], "mean": [mean]})

    kind = dict(stream.dtypes)[by]
    return stream.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n long, mean double", "mean double, n long", "update", GroupStateTimeout.NoTimeout)


def moving_mean_batch(rows: DataFrame, momentum: float, by: str = "key", step: str = "step", value: str = "value") -> DataFrame:
    """The same over a finite table: mean = sum of (1 - m) m^(n - i) v_i for i > 1, and m^(n - 1) v_1. Sums need no order but the
    ranks, which are counted in ranges of steps, so that no task holds a key's rows."""
    from pyspark.sql import Window

    rows = rows.where(F.col(value).isNotNull()).select(F.col(by), F.col(step).alias("__step"), F.col(value).alias("__value"))
    dealt = cut(rows.repartitionByRange(by, "__step").withColumn("__part", F.spark_partition_id()))
    order, own = Window.partitionBy(by).orderBy("__part"), Window.partitionBy(by)
    parts = dealt.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__of"))
    parts = parts.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), (F.sum("__of").over(order) - F.col("__of")).alias("__before"), F.sum("__of").over(own).alias("__n"))
    ranked = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__part", by).orderBy("__step")))
    ranked = ranked.join(if_few(cut(parts)), (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by"))).withColumn("__i", F.col("__before") + F.col("__i"))
    weight = F.pow(F.lit(momentum), F.col("__n") - F.col("__i")) * F.when(F.col("__i") == 1, 1.0).otherwise(1 - momentum)
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col("__value")).alias("mean"))
