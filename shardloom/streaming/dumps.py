"""Arrays of a stream's steps as side tables: covariances and samples, written once however often a batch is replayed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.sampling import per_event

#: Rows that a dump is taken of at most.
ROWS = 4096


def covariances(rows: DataFrame, most: int = ROWS, seed: int = 0) -> DataFrame:
    """(step, name, n, cov): the sample covariance of each observable's rows (step, name, id, vec) at a step, as rows of a matrix.

    Of more than ``most`` rows those that come first in the seeded order are taken, so a step's rows are bounded where they meet. Null
    vectors don't count. Observables of fewer than two rows have none.
    """
    kind = dict(rows.dtypes)

    def dump(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["vec"]).astype(np.float64)
        return pd.DataFrame({"step": part["step"].iloc[:1], "name": part["name"].iloc[:1], "n": [len(x)], "cov": [np.atleast_2d(np.cov(x.T)).tolist()]})

    some = sampled(rows, most, seed)
    enough = some.groupBy("step", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("step", "name")
    return some.join(enough, ["step", "name"]).groupBy("step", "name").applyInPandas(dump, f"step {kind['step']}, name {kind['name']}, n long, cov array<array<double>>")


def sampled(rows: DataFrame, most: int = ROWS, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each observable at each step, in the order of ``md5(seed:step:id)``."""
    return per_event(rows.where("vec is not null"), ["step", "name"], most, seed, "step", "id")


def dump(stream: DataFrame, root: str, checkpoint: str, most: int = ROWS, seed: int = 0, keys: list[str] | None = None, sample: bool = True):
    """Dumps a stream of observables (step, name, id, vec): what is there now, then ends. ``keys``: only these names.

    A batch writes its tables into folders of its own number and replaces what is there, so a batch that is replayed after a lost
    driver leaves its arrays once. The log of what was dumped is the table ``files``.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if keys is None else batch.where(F.col("name").isin(keys))
        rows = rows.persist()
        try:
            cov = covariances(rows, most, seed)
            cov.write.mode("overwrite").parquet(f"{root}/cov/batch={number}")
            if sample:
                sampled(rows, most, seed).write.mode("overwrite").parquet(f"{root}/sample/batch={number}")
            files = batch.sparkSession.read.parquet(f"{root}/cov/batch={number}").select("step", "name", F.lit(f"cov/batch={number}").alias("file"))
            files.write.mode("overwrite").parquet(f"{root}/files/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, root: str, table: str = "cov") -> DataFrame:
    """A side table: ``cov``, ``sample`` or ``files``, with the number of the batch that wrote a row."""
    return spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
