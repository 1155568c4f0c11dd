"""Joins of pixels, truth and coordinates, and the checks that go with them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators.grouped import FEW


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last in ``order``: what building a dictionary row by row keeps."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def truth_join(pixels: DataFrame, truth: DataFrame, keys: list[str], columns: dict[str, str], order: list[Column]) -> DataFrame:
    """``pixels`` with the columns of the truth row at the same coordinates.

    ``columns``: name to type; integers are rounded half to even, a miss is 0. Of truth rows with equal coordinates the
    last counts.
    """
    found = pixels.join(last_of(truth.select(*keys, *columns, *order), keys, order), keys, "left")
    cast = lambda c, kind: F.coalesce(F.rint(c).cast(kind) if kind in ("int", "bigint", "tinyint") else F.col(c).cast(kind), F.lit(0).cast(kind))
    return found.select(*pixels.columns, *[cast(c, kind).alias(c) for c, kind in columns.items()])


def lookup_with_fallback(rows: DataFrame, id_col: str, primary: DataFrame, fallback: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``out``: the value of the id, else of its absolute, else 0; rows of ``primary`` hide those of ``fallback``; id 0 gives 0."""
    both = primary.select(key, value, F.lit(1).alias("__p")).unionByName(fallback.select(key, value, F.lit(0).alias("__p")))
    table = both.groupBy(key).agg(F.max_by(value, "__p").alias(value))
    exact = table.select(F.col(key).alias("__k1"), F.col(value).alias("__v1"))
    plain = table.select(F.col(key).alias("__k2"), F.col(value).alias("__v2"))
    joined = rows.join(exact, F.col(id_col) == F.col("__k1"), "left").join(plain, F.abs(id_col) == F.col("__k2"), "left")
    return joined.select(*rows.columns, F.when(F.col(id_col) == 0, 0).otherwise(F.coalesce("__v1", "__v2", F.lit(0))).alias(out))


def match_rows(left: DataFrame, right: DataFrame, keys: list[str], marked: DataFrame) -> DataFrame:
    """Rows of both sides with equal keys, and whether ``marked`` has the keys."""
    flag = marked.select(*keys).distinct().withColumn("is_marked", F.lit(True))
    return left.join(right, keys).join(flag, keys, "left").withColumn("is_marked", F.coalesce("is_marked", F.lit(False)))


def gather(requests: DataFrame, rows: DataFrame, keys: list[str], on_miss: str = "raise") -> DataFrame:
    """The row of every request; a request without one is an error ('raise') or left out ('drop')."""
    if on_miss == "drop":
        return requests.join(rows, keys)
    if on_miss != "raise":
        raise ValueError(f"on_miss is 'raise' or 'drop', not {on_miss!r}")
    joined = requests.join(rows.withColumn("__hit", F.lit(True)), keys, "left")
    check = F.when(F.col("__hit"), True).otherwise(F.raise_error(F.concat(F.lit("no row at "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast("boolean"))
    return joined.where(check).drop("__hit")


def misses(requests: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(rows, keys, "left_anti")


def floored(rows: DataFrame, coords: list[str], factor: int) -> DataFrame:
    """Coordinates of the cells of width ``factor``."""
    return rows.withColumns({c: F.floor(F.col(c) / factor) for c in coords})


def upcast(fine: DataFrame, coarse: DataFrame, group: list[str], coords: list[str], factor: int, value: str) -> DataFrame:
    """``fine`` with the value of the coarse cell that holds each row; a missing cell is an error."""
    keys = {c: f"__cell_{c}" for c in coords}
    cells = coarse.select(*group, *[F.col(c).alias(k) for c, k in keys.items()], value)
    return gather(fine.withColumns({k: F.floor(F.col(c) / factor) for c, k in keys.items()}), cells, [*group, *keys.values()]).drop(*keys.values())


def new_cells(rows: DataFrame, skip: DataFrame, group: list[str], coords: list[str], factor: int) -> DataFrame:
    """Distinct cells of ``rows`` that ``skip`` (of cells) lacks."""
    return floored(rows, coords, factor).select(*group, *coords).distinct().join(skip, [*group, *coords], "left_anti")


def collisions(requests: DataFrame, keys: list[str], role: str) -> DataFrame:
    """Keys that are asked for under several roles."""
    return requests.groupBy(*keys).agg(F.count_distinct(role).alias("roles")).where("roles > 1")


def inject(base: DataFrame, requests: DataFrame, keys: list[str], role: str) -> DataFrame:
    """``base`` (role 'base') and the requested rows that it lacks, once per role; a key under two roles is an error."""
    asked = requests.groupBy(*keys).agg(F.min(role).alias(role), F.max(role).alias("__other"))
    sound = F.when(F.col(role) == F.col("__other"), True).otherwise(F.raise_error(F.lit("a coordinate has two roles")).cast("boolean"))
    new = asked.where(sound).drop("__other").join(base, keys, "left_anti")
    return base.select(*keys).withColumn(role, F.lit("base")).unionByName(new.select(*keys, role))


def member_flag(rows: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a flag: does ``other`` have the keys."""
    flag = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(flag, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def occupied(cells: DataFrame, clean: DataFrame, group: list[str], coords: list[str], stride: int) -> DataFrame:
    """``cells`` with ``occupied``: does any clean row fall into the cell."""
    return member_flag(cells, floored(clean, coords, stride), [*group, *coords], "occupied")


def full_difference(a: DataFrame, b: DataFrame, key: str, value: str, absent: str = "<absent>") -> DataFrame:
    """Keys of which the values of two tables differ, absence being a value: (key, left, right)."""
    left, right = a.select(key, F.col(value).alias("left")), b.select(key, F.col(value).alias("right"))
    both = left.join(right, key, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
    return both.select(key, F.coalesce("left", F.lit(absent)).alias("left"), F.coalesce("right", F.lit(absent)).alias("right"))


def nearest(points: DataFrame, segments: DataFrame, point: list[str], x: str, y: str, order: str, value: str, within: list[str] | None = None, most: int = FEW) -> DataFrame:
    """Per point (columns ``point``, which tell points apart) the ``value`` of the nearest segment (ay, az, by, bz), ties to the
    lowest ``order``, among those with equal columns ``within``; and the squared distance. No segment gives nulls.

    Segments go to the tasks in blocks of ``most``; points stay where they are, and some of them meet a block's segments at a time.
    """
    within = within or []
    rows = points.select(*point, *[c for c in within if c not in point], F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    wanted = segments.select(*within, *[F.col(c).cast("double").alias(c) for c in ("ay", "az", "by", "bz")], F.col(order).alias("__order"), F.col(value).alias("__value"))
    blocks = max(1, -(-wanted.count() // most))
    wanted = wanted.withColumn("__block", F.pmod(F.xxhash64("__order", *within), F.lit(blocks)))
    kinds = dict(points.dtypes) | {"__value": dict(wanted.dtypes)["__value"], "__order": dict(wanted.dtypes)["__order"]}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in point], "d2 double", f"__order {kinds['__order']}", f"__value {kinds['__value']}"])
    found = None
    for block in range(blocks):
        held = wanted.where(F.col("__block") == block).toPandas().sort_values("__order", kind="stable")  # ``most`` rows or about as many
        part = rows.mapInPandas(_nearest(rows.sparkSession.sparkContext.broadcast(held), point, within), schema)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy(*point).agg(F.min(F.when(F.col("d2").isNotNull(), F.struct("d2", "__order", "__value"))).alias("b")).select(*point, "b.*")
    return found.select(*point, F.col("__value").alias(value), "d2")


def _nearest(segments, point: list[str], within: list[str]):
    def run(batches):
        held = segments.value
        groups = {k: g for k, g in held.groupby(within, sort=False)} if within else {(): held}
        for part in batches:
            for key, own in part.groupby(within, sort=False) if within else [((), part)]:
                seg = groups.get(key)
                out = own[point].copy()
                if seg is None or not len(seg):
                    yield out.assign(d2=None, __order=None, __value=None)
                    continue
                best, least, step = [], [], max(1, (1 << 21) // len(seg))
                ay, az, by, bz = (seg[c].to_numpy()[None, :] for c in ("ay", "az", "by", "bz"))
                length2 = (by - ay) ** 2 + (bz - az) ** 2
                for i in range(0, len(own), step):
                    px, py = (own[c].to_numpy()[i : i + step, None] for c in ("__x", "__y"))
                    t = ((px - ay) * (by - ay) + (py - az) * (bz - az)) / np.where(length2 > 0, length2, 1)
                    t = np.where(length2 > 0, t, 0).clip(0, 1)
                    d2 = (px - (ay + t * (by - ay))) ** 2 + (py - (az + t * (bz - az))) ** 2
                    best.append(d2.argmin(axis=1))
                    least.append(d2.min(axis=1))
                at = np.concatenate(best)
                yield out.assign(d2=np.concatenate(least), __order=seg["__order"].to_numpy()[at], __value=seg["__value"].to_numpy()[at])

    return run


def segment_distance2(y: Column, z: Column, ay: Column, az: Column, by: Column, bz: Column) -> Column:
    """Squared distance from a point to a segment."""
    length2 = (by - ay) * (by - ay) + (bz - az) * (bz - az)
    t = F.least(F.greatest(F.coalesce(F.try_divide((y - ay) * (by - ay) + (z - az) * (bz - az), length2), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    dy, dz = y - (ay + t * (by - ay)), z - (az + t * (bz - az))
    return dy * dy + dz * dz


def vertex_distance(pixels: DataFrame, vertices: DataFrame, most: float | None = 200.0) -> DataFrame:
    """``pixels`` (event_idx, channel, tick) with ``distance`` to the event's nearest vertex (v_channel, v_tick), ticks
    rounded half to even and cut off at ``most``. ``most`` None: one vertex per event, its tick as it is, null without one."""
    if most is None:
        joined = pixels.join(vertices, "event_idx", "left")
        return joined.withColumn("distance", F.hypot(F.col("channel") - F.col("v_channel"), F.col("tick") - F.col("v_tick"))).select(*pixels.columns, "distance")
    ends = vertices.groupBy("event_idx").agg(F.collect_list(F.struct("v_channel", F.rint("v_tick").alias("v_tick"))).alias("__v"))
    away = F.array_min(F.transform("__v", lambda v: F.hypot(F.col("channel") - v["v_channel"], F.col("tick") - v["v_tick"])))
    return pixels.join(ends, "event_idx", "left").withColumn("distance", F.least(F.coalesce(away, F.lit(most)), F.lit(most))).drop("__v")


def view_pairs(views: DataFrame) -> DataFrame:
    """Pairs (student, teacher) of views of an event: every view with every global one but itself, which it meets only if it
    is injected and masked, or the only view. A handful of views per event."""
    teacher = views.where("is_global").select("event_idx", F.col("view").alias("teacher"), "n_views")
    pairs = views.drop("n_views").join(teacher, "event_idx")
    return pairs.where("view <> teacher or (injected and masked) or n_views = 1").select("event_idx", F.col("view").alias("student"), "teacher")


def composed(outer: DataFrame, inner: DataFrame, group: str = "event_idx") -> DataFrame:
    """Two selections one after the other: ``inner`` (group, pos, of: places in ``outer``) and ``outer`` (group, pos, of: rows) give
    (group, pos, of: rows)."""
    places = outer.select(group, F.col("pos").alias("__at"), F.col("of").alias("__of"))
    asked = inner.select(group, "pos", F.col("of").alias("__at"))
    return gather(asked, places, [group, "__at"]).select(group, "pos", F.col("__of").alias("of"))


def concatenated(rows: DataFrame, lists: str, group: str = "event_idx") -> DataFrame:
    """(group, pos, value) of a column of lists, or of lists of lists, put one after the other in their order."""
    nested = rows.schema[lists].dataType.elementType.typeName() == "array"
    return rows.select(group, F.posexplode(F.flatten(lists) if nested else F.col(lists)).alias("pos", "value"))
