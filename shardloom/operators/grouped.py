"""Sequential steps over small groups, many groups to an Arrow batch; and joins whose small side is counted first."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of a few columns is broadcast (some MB).
FEW = 100_000
#: Rows of a task, on average, where groups are sorted several times.
A_TASK = 250_000


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows; beyond that a join shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` dealt out by group, with as many tasks as there are A_TASK rows: what a task sorts doesn't grow with the table."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / A_TASK)), group)


def by_size(rows: DataFrame, group: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to ``most`` rows, and those of larger groups, if there are any. A null group is a group."""
    from shardloom.sources.tables import cut

    key = F.struct(group).alias("__of")
    large = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("__of"))
    if large.isEmpty():
        return rows, None
    keyed, large = rows.withColumn("__of", key), if_few(large)
    return keyed.join(large, "__of", "left_anti").drop("__of"), keyed.join(large, "__of", "left_semi").drop("__of")


def by_packs(rows: DataFrame, group: str, sort: list[str], body: Callable[[dict[str, np.ndarray], np.ndarray], tuple[dict[str, np.ndarray], np.ndarray]], schema: str) -> DataFrame:
    """``body`` for many whole groups at once, each in the order of ``sort``: columns and the places where groups begin (and the last ends)
    in, columns of ``schema`` and each row's group, counted from 0, out.

    Groups are dealt out and sorted by Spark; a task cuts its sorted batches into groups, so that a group costs no frame
    of its own. A group that goes over batches is put together once. Rows with a null group are one group, for which
    ``body`` sees the type's zero and the result has null again.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kind = dict(rows.dtypes)[group]
    zero = F.lit("" if kind == "string" else 0).cast(kind)
    keyed = rows.withColumn("__null", F.col(group).isNull()).withColumn(group, F.coalesce(F.col(group), zero))

    def run(batches):
        held: list[pd.DataFrame] = []
        for frame in batches:
            if not len(frame):
                continue
            at = cuts(frame)
            same = bool(held) and all(held[-1][c].iloc[-1] == frame[c].iloc[0] for c in (group, "__null"))
            if held and (len(at) > 2 or not same):
                to = at[1] if same else 0
                yield pack(pd.concat([*held, frame.iloc[:to]], ignore_index=True))
                held, frame, at = [], frame.iloc[to:], [x - to for x in (at[1:] if same else at)]
            if len(at) > 2:
                yield pack(frame.iloc[: at[-2]])
            held.append(frame.iloc[at[-2] :])
        if held:
            yield pack(pd.concat(held, ignore_index=True))

    def cuts(frame: pd.DataFrame) -> list[int]:
        keys, null = frame[group].to_numpy(), frame["__null"].to_numpy()
        return np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1]), [True]))).tolist()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        columns, at = {c: frame[c].to_numpy() for c in frame.columns if c != "__null"}, np.array(cuts(frame))
        found, of = body(columns, at)
        out = pd.DataFrame({n: found[n] for n in names})
        null = frame["__null"].to_numpy()[at[:-1]]
        if group in names and null.any():
            out[group] = out[group].astype(object).where(~null[of], None)
        return out

    return keyed.repartition(group, "__null").sortWithinPartitions(group, "__null", *sort).mapInPandas(run, schema)


def by_runs(rows: DataFrame, group: str, sort: list[str], body: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``body`` for the rows of each group, in the order of ``sort``: columns in, columns of ``schema`` out; see ``by_packs``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def each(columns: dict, at: np.ndarray) -> tuple[dict, np.ndarray]:
        parts = [body({c: v[a:b] for c, v in columns.items()}) for a, b in zip(at, at[1:], strict=False)]
        of = np.repeat(np.arange(len(parts)), [len(p[names[0]]) for p in parts])
        return {n: np.concatenate([np.asarray(p[n]) for p in parts]) for n in names}, of

    return by_packs(rows, group, sort, each, schema)


def pairs(start: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of all pairs of rows of the same group, a row with itself included, in their order; a group's pairs come together,
    with those of others up to about ``most``."""
    ends = np.cumsum(size * size)
    edges = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:], strict=False):
        n = size[a:b]
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[a:b], n)
        of = np.repeat(n, n)
        column = np.arange(int(of.sum())) - np.repeat(np.cumsum(of) - of, of) + np.repeat(np.repeat(start[a:b], n), of)
        if len(column):
            yield np.repeat(rows, of), column
