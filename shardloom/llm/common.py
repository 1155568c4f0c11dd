"""What several of the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of a few numbers a row is broadcast (some MB).
FEW = 100_000
#: Edges of a graph for each task at least.
A_TASK = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode, an error on a
    cluster, on which no machine's own folder is shared."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="shardloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lost executors cost no recomputation of what led to it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet and read again: what ``cut`` does, in less room for wide tables of numbers."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def by_key(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``: broadcast if it has FEW rows at most, so that the rows of a
    frequent key stay where they are; else both are shuffled, and adaptive execution splits the partition of a frequent key."""
    return rows.join(F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table, key, how)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of the ``(a, b)`` edges; root is the least node of its component.

    Every round points each node at its least neighbour, follows the pointers until they end at local minima, and
    contracts the edges to those minima; the contracted graphs shrink until no edge is left. Only joins and ``min``
    aggregates are used, so a node with very many edges needs no task of its own: what is joined by ``root`` is the table of
    the roots that move, see ``by_key``. No edges give no rows. Null ends and loops are ignored.
    """
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    live = cut(edges.where("a <> b").select(*ends(F.col("a"), F.col("b"))).distinct())
    rounds: list[DataFrame] = []
    while n := live.count():
        few = lambda df: cut(df.coalesce(max(1, n // A_TASK)))  # noqa: E731, B023 - a graph that has shrunk needs fewer tasks
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = few(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            used = up.select("root").distinct()
            hop = few(used.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").where("next <> root"))
            if hop.isEmpty():
                break
            up = few(by_key(up, hop, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        rounds.append(up)
        left = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = few(live.join(left, "a").join(right, "b").where("ra <> rb").select(*ends(F.col("ra"), F.col("rb"))).distinct())
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = rounds.pop()
    while rounds:
        later = cut(label.select(F.col("node").alias("root"), F.col("root").alias("last")))
        label = by_key(rounds.pop(), later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return cut(label)


def in_cells(rows: DataFrame, key: str, spread: Column, most: int) -> DataFrame:
    """Adds ``cell`` and ``role``: tasks by (key, cell) together see every pair of rows of a key, and each sees a bounded number.

    A key of more than ``most`` rows is dealt into S slices by the hash ``spread``, and the pairs of slices are its
    cells: a row of slice s is in the S cells that pair s with any slice. Role 0: the cell compares its rows with each
    other; roles 1 and 2: rows with role 1 are compared with rows with role 2. Small keys have the one cell 0.
    The table of large keys is broadcast only when it is small.
    """
    large = cut(rows.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("slices")))
    n = large.limit(10_001).count()
    if not n:
        return rows.withColumn("cell", F.lit(0).cast("long")).withColumn("role", F.lit(0))
    dealt = rows.join(F.broadcast(large) if n <= 10_000 else large, key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("slice", F.pmod(spread, F.col("slices").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    low, high = F.least("slice", "other"), F.greatest("slice", "other")
    role = F.when(F.col("slice") == F.col("other"), 0).when(F.col("slice") < F.col("other"), 1).otherwise(2)
    return dealt.withColumn("cell", low.cast("long") * F.col("slices") + high).withColumn("role", role).drop("slices", "slice", "other")


def runs(batches, columns: list[str]):
    """Of pandas frames sorted by ``columns``: frames that hold whole runs of equal ``columns`` only, at least one run each.
    A run over many frames is put together once."""
    import pandas as pd

    held: list = []
    for frame in batches:
        if not len(frame):
            continue
        last = (frame[columns] == frame[columns].iloc[-1]).all(axis=1).to_numpy()
        start = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        if held and (start or not (held[0][columns].iloc[-1] == frame[columns].iloc[-1]).all()):
            yield pd.concat([*held, frame.iloc[:start]], ignore_index=True)
            held = []
        elif start:
            yield frame.iloc[:start]
        held.append(frame.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


class Links:
    """Union-find over a few numbers; keeps one edge for each union, enough to know the components."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.edges: list[tuple] = []

    def root(self, x):
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, x, y) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))
