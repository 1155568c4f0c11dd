"""Features of a frozen model, written to a feature store block by block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.sources.tables import FeatureStore

#: Rows of a block; blocks of a job; rows that the model sees at once.
BLOCK, AT_ONCE, BATCH = 1 << 16, 256, 1024


def extract(store: FeatureStore, rows: DataFrame, make_model: Callable, source: str, taps: list[str], block: int = BLOCK, at_once: int = AT_ONCE, batch: int = BATCH) -> int:
    """Writes the features that a model has for ``rows`` (row_idx from 0, x: an array of fixed length), and says how many blocks were written.

    ``make_model()`` is called once in each Python worker and gives a function of a matrix, some rows of ``x``, that returns a dict with a
    matrix for each of ``taps``; the model is run once for all of them. A block is a range of row_idx. Blocks that the store has in
    all taps are left out before anything is read or computed, and a job commits its blocks whole, so a run that was killed
    goes on where it was and leaves no row twice. No rows write nothing. A null row_idx or ``x`` is an error.
    """
    last = rows.agg(F.max("row_idx").alias("last"), F.count_if(F.col("row_idx").isNull() | F.col("x").isNull()).alias("null")).first()
    if last["null"]:
        raise ValueError(f"{last['null']} rows have no row_idx or no x")
    if last["last"] is None:
        return 0
    done = set.intersection(*[store.blocks(source, tap) for tap in taps])
    todo = [b for b in range(last["last"] // block + 1) if b not in done]

    def make() -> Callable:
        model = make_model()
        return lambda x: {tap: v.astype("float32") for tap, v in model(x).items()}

    dims = rows.select(F.size("x")).first()[0]
    kind = T.StructType([T.StructField(tap, T.ArrayType(T.FloatType())) for tap in taps])
    model = predict_batch_udf(make, return_type=kind, batch_size=batch, input_tensor_shapes=[[dims]])
    own = rows.withColumn("block", F.floor(F.col("row_idx") / block).cast("int"))
    for at in range(0, len(todo), at_once):
        some = todo[at : at + at_once]
        part = own.where(F.col("block").isin(some)).select("row_idx", "block", model("x").alias("out"))
        long = part.select("row_idx", "block", F.explode(F.array(*[F.struct(F.lit(tap).alias("tap"), F.col(f"out.{tap}").alias("vec")) for tap in taps])).alias("f"))
        store.write_blocks(long.select("row_idx", "block", "f.tap", "f.vec"), source)
    return len(todo)
