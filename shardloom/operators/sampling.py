"""Seeded samples, splits and quotas. Order is the md5 of seed and keys, so a draw is the same on any cluster."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.expressions import md5_order
from shardloom.operators.grouped import dealt, if_few
from shardloom.sources.tables import cut

#: Events that a class's pool should spread over.
SPREAD = 200
#: Leading hex digits of a digest by which rows are counted: 4,096 ranges for each draw and group, so that a task's counts are few; 65,536 of events.
DIGITS, EVENT_DIGITS = 3, 4


@dataclass
class Draw:
    """Of the rows with ``where``, the ``n`` that come first in the order of the hex digest ``order``, of each value of ``by`` if given."""

    name: str
    n: int
    order: Column
    where: Column | None = None
    by: Column | None = None


def draws(rows: DataFrame, wanted: list[Draw], keys: list[str]) -> DataFrame:
    """The rows of all draws, with ``draw``, the draw's name; a row that several draws take comes as often. Equal digests go by ``keys``.

    Rows are never sorted or ranked as a whole: one pass counts them by draw, group and range of digests, which says in which range a
    group's n-th row lies; the next pass takes what is in lower ranges, and ranks only the rows of that range (of a group of N
    rows about N / 4,096). So a draw of millions of rows, or a group that holds most rows, is no single task. Draws that share
    an ``order`` (the same column object) share its digest. Where all draws are full, the next pass leaves out a row by its digests
    alone, which Spark does before the joins that ``rows`` may have.
    """
    orders = list({id(d.order): d.order for d in wanted}.values())
    digests = [f"__digest{next(k for k, o in enumerate(orders) if o is d.order)}" for d in wanted]
    own, whole = (lambda h: F.substring(h, 1, DIGITS)), F.lit("")
    group = [whole if d.by is None else F.coalesce(F.concat(F.lit("="), d.by.cast("string")), whole) for d in wanted]
    where = [F.lit(d.n > 0) if d.where is None else d.where & F.lit(d.n > 0) for d in wanted]

    def marked(rows: DataFrame, digest, only: list[Column]) -> DataFrame:
        """A row for each draw that a row is of: the row, the draw's number, its group and what is asked of its digest."""
        marks = F.array(*[F.when(w & o, F.struct(F.lit(i).alias("i"), g.alias("g"), F.col(h).alias("h"))) for i, (w, o, g, h) in enumerate(zip(where, only, group, digests, strict=True))])
        digested = rows.select("*", F.struct("*").alias("__row"), *[digest(o).alias(f"__digest{k}") for k, o in enumerate(orders)])
        # an array that Spark sees into; of a filtered one it would find the size first, and each digest once for each draw
        return digested.select(F.col("__row").alias("row"), F.explode(marks).alias("m")).where("m is not null").select("row", "m.*")

    ranges = marked(rows, own, [F.lit(True)] * len(wanted)).groupBy("i", "g", F.col("h").alias("head")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("i", "g").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.element_at(F.array(*[F.lit(d.n).cast("long") for d in wanted]), F.col("i") + 1)
    # the range in which a group's rows reach n, and how many of them are still to take in it; null for groups that don't have n rows
    reached = F.min(F.when((F.col("before") < F.col("n")) & (F.col("before") + F.col("c") >= F.col("n")), F.struct("head", (F.col("n") - F.col("before")).alias("left"))))
    ends = cut(ranges.withColumns({"before": before, "n": n}).groupBy("i", "g").agg(reached.alias("end")).select("i", "g", "end.*"))
    # the last range of each draw, a row a draw; "g" is after all hex digits
    last = {r["i"]: r["last"] for r in ends.groupBy("i").agg(F.max(F.coalesce("head", F.lit("g"))).alias("last")).collect()}
    lasts = {o: max((last.get(i, "") for i, d in enumerate(wanted) if d.order is o_), default="") for o, o_ in enumerate(orders)}
    low = reduce(or_, [own(o) <= lasts[k] for k, o in enumerate(orders)])
    near = rows if "g" in lasts.values() else rows.where(low)
    taken = marked(near, lambda o: o, [own(F.col(h)) <= last.get(i, "") for i, h in enumerate(digests)])
    taken = cut(taken.join(if_few(ends), ["i", "g"]).where(F.col("head").isNull() | (own(F.col("h")) <= F.col("head"))))
    tied = taken.where(own(F.col("h")) == F.col("head"))
    tied = tied.withColumn("r", F.row_number().over(Window.partitionBy("i", "g").orderBy("h", *[F.col(f"row.{k}") for k in keys]))).where("r <= left").drop("r")
    found = taken.where(F.col("head").isNull() | (own(F.col("h")) < F.col("head"))).unionByName(tied)
    name = F.element_at(F.array(*[F.lit(d.name) for d in wanted]), F.col("i") + 1)
    return found.select(name.alias("draw"), "row.*")


def lowest(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """The ``n`` rows that come first in the seeded order; all when there are no more."""
    return draws(rows, [Draw("", n, md5_order(seed, *map(F.col, keys)))], list(keys)).drop("draw")


def event_split(events: DataFrame, seed: int, share: float, key: str = "event_idx") -> DataFrame:
    """(key, is_train): int(share * n) events in seeded order are for training. The range of digests in which the cut lies is found first;
    only its events are ranked, the others are on one side of it."""
    head = F.substring("h", 1, EVENT_DIGITS)
    ordered = events.select(key, md5_order(seed, F.col(key)).alias("h"))
    counts = ordered.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"before": before, "train": F.floor(F.lit(share) * F.sum("n").over(Window.partitionBy()))})
    at = counts.where("before <= train and before + n > train").first()  # the range of the first event that is not for training
    if at is None:
        return ordered.select(key, F.lit(share >= 1).alias("is_train"))
    rank = F.row_number().over(Window.partitionBy(head).orderBy("h", key))
    tied = ordered.where(head == at["head"]).select(key, (rank <= at["train"] - at["before"]).alias("is_train"))
    return ordered.where(head != at["head"]).select(key, (head < at["head"]).alias("is_train")).unionByName(tied)


def per_group(rows: DataFrame, group: list[str], n: int, seed: int, *keys: str) -> DataFrame:
    """At most ``n`` rows of each group, in seeded order. For few groups of any size, such as classes; for events see ``per_event``."""
    by = F.to_json(F.struct(*group)) if len(group) > 1 else F.col(group[0])
    return draws(rows, [Draw("", n, md5_order(seed, *map(F.col, keys)), by=by)], list(keys)).drop("draw")


def per_event(rows: DataFrame, group: list[str], n: int, seed: int, *keys: str) -> DataFrame:
    """At most ``n`` rows of each of many small groups, in seeded order: a group's rows are ranked in one task."""
    cols = [F.col(k) for k in keys]
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(md5_order(seed, *cols), *cols)))
    return ranked.where(F.col("__r") <= n).drop("__r")


def image_cap(per_class: int, events: int) -> int:
    """Rows of one class to take from one event so that a pool spreads over about SPREAD events."""
    return max(1, -(-per_class // max(1, min(events, SPREAD))))


def quota_pool(rows: DataFrame, per_class: int, cap: int, seed: int, key: str, event: str = "event_idx", label: str = "label") -> DataFrame:
    """Events in seeded order give at most ``cap`` rows of each class until the class has ``per_class``. Label 0 is left out.

    Only events that may be needed are ranked: those of a range of digests give a class at least as many rows as it has there, or
    ``cap``, whichever is less, so a count by ranges says in which the class is full at the latest.
    """
    head = F.substring(md5_order(seed, F.col(event)), 1, EVENT_DIGITS)
    rows = rows.where(F.col(label) > 0)
    ranges = rows.groupBy(F.col(label).alias("__of"), head.alias("__head")).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__of").orderBy("__head").rowsBetween(Window.unboundedPreceding, 0))
    full = ranges.withColumn("__n", upto).groupBy("__of").agg(F.min(F.when(F.col("__n") >= per_class, F.col("__head"))).alias("__last"))
    needed = rows.join(if_few(cut(full)), F.col(label) == F.col("__of")).where(F.col("__last").isNull() | (head <= F.col("__last"))).drop("__of", "__last")
    capped = cut(per_event(needed, [event, label], cap, seed, key))
    order = F.concat(md5_order(seed, F.col(event)), md5_order(seed, F.col(key)))
    return draws(capped, [Draw("", per_class, order, by=F.col(label))], [event, key]).drop("draw")


def row_space(pools: DataFrame, key: str = "pixel_idx") -> DataFrame:
    """(row_idx, key): the union of the pools' rows, numbered in order. Keys are dealt out by ranges, so that a task numbers a range."""
    ranged = pools.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    ranged = cut(ranged.select(key, F.spark_partition_id().alias("__p")))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    rows = ranged.withColumn("__r", own).join(F.broadcast(sizes.withColumn("__b", before)), "__p")  # a row for each task
    return rows.select((F.col("__b") + F.col("__r")).alias("row_idx"), key)


def exact_shards(events: DataFrame, size: int, seed: int, key: str = "event_key") -> DataFrame:
    """``events`` with ``shard`` and ``pos``: all events in seeded order, cut into shards of exactly ``size``, the last one shorter."""
    ordered = events.withColumn("__h", md5_order(seed, F.col(key))).withColumn("__head", F.substring("__h", 1, 4))
    head = ordered.groupBy("__head").agg(F.count(F.lit(1)).alias("__n"))
    head = head.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__head").orderBy("__h", key)) - 1
    rows = ordered.withColumn("__r", rank).join(head, "__head").withColumn("__r", F.col("__r") + F.col("__before"))
    return rows.withColumn("shard", F.floor(F.col("__r") / size)).withColumn("pos", F.col("__r") % size).drop("__h", "__head", "__before", "__r")


def epoch_shards(shards: DataFrame, epoch: int, parts: int, seed: int, key: str = "shard") -> DataFrame:
    """(turn, shard): the slice of this epoch (from 1) of a seeded pass over all shards, ``parts`` slices a pass, the last wraps."""
    if parts == 1:
        return shards.select((F.row_number().over(Window.orderBy(key)) - 1).alias("turn"), key)
    passes, part = divmod(epoch - 1, parts)
    order = shards.select(key, (F.row_number().over(Window.orderBy(md5_order(seed + passes, F.col(key)), key)) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    per = F.ceil(F.col("n") / parts)
    turn = F.pmod(F.col("at") - part * per, F.col("n"))
    return order.withColumn("turn", turn).where(F.col("turn") < per).select("turn", key)


def reader_shards(shards: DataFrame, readers: int, epoch: int, seed: int, key: str = "shard") -> DataFrame:
    """(reader, turn, shard): shards in seeded order dealt out in turns; every reader gets as many, the first ones again to make up."""
    order = shards.select(key, (F.row_number().over(Window.orderBy(md5_order(seed + epoch, F.col(key)), key)) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    per = F.ceil(F.col("n") / readers)
    again = F.when(F.col("at") < readers * per - F.col("n"), F.array("at", F.col("at") + F.col("n"))).otherwise(F.array("at"))
    rows = order.withColumn("at", F.explode(again))
    return rows.select((F.col("at") % readers).alias("reader"), F.floor(F.col("at") / readers).alias("turn"), key)


def batches(rows: DataFrame, size: int, order: list[Column], by: list[str], drop_last: bool = True) -> DataFrame:
    """``rows`` with ``batch_id``: ``size`` rows each within ``by`` (a shard), in ``order``; the short last one is dropped."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    out = rows.withColumn("batch_id", F.floor(at / size))
    if not drop_last:
        return out
    full = out.groupBy(*by, "batch_id").count().where(F.col("count") == size).drop("count")
    return out.join(full, [*by, "batch_id"])


def cap_negatives(rows: DataFrame, group: str, positive: Column, seed: int, key: str, per_positive: float | None = None, most: int | None = None) -> DataFrame:
    """All positives, and of the negatives of a group at most ``per_positive`` times its positives and at most ``most``."""
    if per_positive is None and most is None:
        return rows
    whole = Window.partitionBy(group)
    n_pos = F.sum(positive.cast("int")).over(whole)
    budgets = [*([F.rint(n_pos * per_positive).cast("long")] if per_positive is not None else []), *([F.lit(most).cast("long")] if most is not None else [])]
    budget = F.least(*budgets) if len(budgets) == 2 else budgets[0]
    # One order for all: negatives, positives, rows of which neither is known.
    place = F.row_number().over(whole.orderBy(positive.asc_nulls_last(), md5_order(seed, F.col(key)), key))
    rank = F.when(positive.isNull(), F.col("__r") - F.count(positive).over(whole)).otherwise(F.col("__r"))
    return dealt(rows, group).withColumn("__r", place).withColumn("__b", budget).withColumn("__r", rank).where(positive | (F.col("__r") <= F.col("__b"))).drop("__b", "__r")


def random_mask(rows: DataFrame, group: str, ratio: float, seed: int, key: str, keep_one: bool = False) -> DataFrame:
    """``rows`` with ``masked``: int(ratio * n) of each group; ``keep_one``: at least one stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(md5_order(seed, F.col(key)), key))
    masked = F.floor(F.col("__n") * ratio)
    if keep_one:
        masked = F.least(masked, F.col("__n") - 1)
    return rows.withColumn("__n", n).withColumn("__r", rank).withColumn("masked", F.col("__r") <= masked).drop("__n", "__r")


def thin(rows: DataFrame, group: str, above: Column, most: int, seed: int, key: str) -> DataFrame:
    """Rows over a threshold, at most ``most`` of a group, numbered by ``slot`` in the order of the key."""
    kept = per_event(rows.where(above), [group], most, seed, key)
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1)


def tap_seed(tap: Column, seed: int) -> Column:
    return F.pmod(F.crc32(tap.cast("binary")) + seed, F.lit(2147483648))
