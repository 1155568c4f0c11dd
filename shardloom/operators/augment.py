"""Masks, crops and candidate cells of sparse images as row operations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.expressions import md5_order
from shardloom.operators import neighbors
from shardloom.operators.grouped import by_packs, by_runs, by_size, dealt


#: Cells of a square that an event's task makes of a cell at most.
SQUARE = 64


def grow(rows: DataFrame, from_stride: int, to_stride: int, rounds: int, group: str = "event_idx") -> DataFrame:
    """Distinct cells (x, y) of width ``to_stride`` grown from the occupied cells of width ``from_stride``: halve the width
    and add the eight neighbours until the width is reached, then ``rounds`` - 1 more dilations; no coordinate under 0.

    Halving and dilating turn a cell into a square of cells, so every occupied cell is spread out once, to its last square. Where squares have
    up to SQUARE cells, small events are spread in one task each, so that no cell of a square is shuffled.
    """
    stages = (from_stride // to_stride).bit_length() - 1
    low = high = 0
    for step in range(stages + rounds - 1):
        double = 2 if step < stages else 1
        low, high = double * low - 1, double * high + 1
    span = lambda c: F.explode(F.sequence(F.greatest(F.col(c) * 2**stages + low, F.lit(0)), F.col(c) * 2**stages + high)).alias(c)
    cells = rows.select(group, F.floor(F.col("x") / from_stride).alias("x"), F.floor(F.col("y") / from_stride).alias("y")).distinct()
    spread = lambda own: own.select(group, span("x"), "y").distinct().select(group, "x", span("y")).distinct()
    if (high - low + 1) ** 2 > SQUARE:
        return spread(cells)
    few, many = by_size(rows.select(group, "x", "y").where("x is not null and y is not null"), group, neighbors.SOLO)
    cells = lambda own: own.select(group, F.floor(F.col("x") / from_stride).alias("x"), F.floor(F.col("y") / from_stride).alias("y"))
    reach = np.arange(low, high + 1)

    def squares(c: dict, at: np.ndarray) -> tuple[dict, np.ndarray]:
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for k in "xy":  # one axis after the other, without what is there twice
            other = "y" if k == "x" else "x"
            first, to = np.maximum(np.repeat(c[k] * 2**stages, len(reach)) + np.tile(reach, len(of)), 0), np.repeat(c[k] * 2**stages + high, len(reach)) >= 0
            of, own, rest = np.repeat(of, len(reach))[to], first[to], np.repeat(c[other], len(reach))[to]
            order = np.lexsort((own, rest, of))
            of, own, rest = of[order], own[order], rest[order]
            new = np.concatenate(([True], (of[1:] != of[:-1]) | (own[1:] != own[:-1]) | (rest[1:] != rest[:-1])))[: len(of)]
            of, c = of[new], {group: c[group], k: own[new], other: rest[new]}
        return {group: c[group][at[of]], "x": c["x"], "y": c["y"]}, of

    out = by_packs(cells(few), group, [], squares, f"{group} {dict(rows.dtypes)[group]}, x bigint, y bigint")
    return out if many is None else out.unionByName(spread(cells(many).distinct()))


def wipe_cells(rows: DataFrame, width: int, height: int, most: float, seed: int, key: str, group: str = "event_idx") -> DataFrame:
    """``rows`` with ``masked`` and ``dense``: grid cells are taken in seeded order while they hold at most ``most`` of the
    event's rows together; the first is always taken and its surplus released. dense: a taken cell that ends up empty."""
    cells = dealt(rows.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / height)).dropna(subset=[group, "cx", "cy"]), group)
    whole = Window.partitionBy(group)
    # A cell's rows are peers in the order, so the running count is that of whole cells.
    order = whole.orderBy(md5_order(seed, F.col(group), F.col("cx"), F.col("cy")), "cx", "cy")
    so_far = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = cells.withColumn("sum", so_far).withColumn("at", F.rank().over(order)).withColumn("total", F.count(F.lit(1)).over(whole))
    out = out.withColumn("taken", (F.col("sum") <= F.col("total") * most) | (F.col("at") == 1))
    rank = F.row_number().over(whole.orderBy(F.desc("taken"), md5_order(seed + 1, F.col(key)), key))  # of the rows of taken cells, which come first
    surplus = F.greatest(F.sum(F.col("taken").cast("int")).over(whole) - F.floor(F.col("total") * most), F.lit(0))
    out = out.withColumn("rank", rank).withColumn("surplus", surplus).withColumn("masked", F.col("taken") & (F.col("rank") > F.col("surplus")))
    left = F.bool_and(F.col("masked")).over(Window.partitionBy(group, "cx", "cy"))
    return out.withColumn("dense", F.col("taken") & left).drop("sum", "at", "taken", "total", "surplus", "rank")


def densify(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Every coordinate of each cell (cx, cy)."""
    x = F.explode(F.sequence(F.col("cx") * width, F.col("cx") * width + width - 1)).alias("x")
    rows = cells.select("*", x)
    return rows.select("*", F.explode(F.sequence(F.col("cy") * height, F.col("cy") * height + height - 1)).alias("y")).drop("cx", "cy")


def split_masked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by ``masked``."""
    return rows.where(~F.col("masked")).drop("masked"), rows.where("masked").drop("masked")


#: Pairs of rows and centres that are compared at once.
PAIRS = 1 << 22


def first_near(x: np.ndarray, y: np.ndarray, order: np.ndarray, k: int, half_x: int, half_y: int) -> np.ndarray:
    """Whether each point is in the block around one of the first ``k`` points of ``order``; some centres at a time, for the points not yet in one."""
    near, step, at = np.zeros(len(x), bool), max(1, PAIRS // max(1, len(x))), 0
    while at < k:
        left, some = np.flatnonzero(~near), order[at : min(k, at + step)]
        near[left] = ((np.abs(x[left, None] - x[some]) <= half_x) & (np.abs(y[left, None] - y[some]) <= half_y)).any(axis=1)
        at += step
    return near


def block_mask(rows: DataFrame, half_x: int, half_y: int, ratio: float, seed: int, group: str = "event_idx", batch: str = "batch") -> DataFrame:
    """``rows`` (batch, event, id, x, y) with ``masked``: rows within a block around one of the event's first K rows in seeded order. K comes
    from the share that one block covers, followed over the events of a batch as a moving mean, which is why a batch is one
    group. Of an event that would be masked whole the last row of the order stays."""

    names = rows.columns

    def mask(c: dict) -> dict:
        share, out = None, np.zeros(len(c["id"]), bool)
        cuts = np.flatnonzero(np.concatenate(([True], c[group][1:] != c[group][:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x, y, n = c["x"][a:b], c["y"][a:b], b - a
            p = share if share is not None else min((2 * half_x + 1) * (2 * half_y + 1), n) / n
            p = max(1e-6, min(p, 1 - 1e-6))
            k = min(math.ceil(math.log(1 - ratio) / math.log(1 - p)), n - 1)
            if k <= 0:
                continue
            masked = first_near(x, y, np.arange(n), k, half_x, half_y)  # rows come in seeded order
            if masked.all():
                masked[-1] = False
            if 0 < masked.mean() < 1:
                seen = 1 - (1 - masked.mean()) ** (1 / k)
                share = seen if share is None else 0.9 * share + 0.1 * seen
            out[a:b] = masked
        return {n: c[n] for n in names} | {"masked": out}

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", masked boolean"
    return by_runs(rows.withColumn("__h", md5_order(seed, F.col(group), F.col("id"))), batch, [group, "__h", "id"], mask, schema)


def kernel(sigma: float) -> list[tuple[int, float]]:
    """(shift, share of the kernel up to it) of the Gaussian by which activity is blurred."""
    reach = max(1, int(3 * sigma))
    weight = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    total, out = 0.0, []
    for i, w in zip(range(-reach, reach + 1), weight, strict=True):
        total += w
        out.append((i, total / sum(weight)))
    return out


def crops(rows: DataFrame, width: int, height: int, n: int, scale: tuple[float, float], aspect: tuple[float, float], least: int, seed: int, sigma: float = 2.0, attempts: int = 50, group: str = "event_idx") -> DataFrame:
    """(event, crop, id) of ``n`` crops of each event's image: boxes around anchors drawn by blurred activity, tried until one
    holds ``least`` rows, else the centre box; an empty centre box gives the first row.

    An anchor is an occupied cell, moved by the blur's kernel along both axes and reflected at the border: what would be drawn from the
    blurred image, without making it (but for its outermost pixels, which a reflected blur counts twice). All draws are ``uniform(seed, event, crop, attempt, k)`` for k from 0 to 4: the cell, in the order of y, then x, the
    two moves, the area and the aspect. So a crop is the same wherever it is made, and SQL can make it too.

    Boxes are within the image. So an event with fewer than ``least`` rows in it needs no attempts, and one with none no draws.
    """
    shifts, steps = [i for i, _ in kernel(sigma)], [c for _, c in kernel(sigma)]
    kinds = dict(rows.dtypes)

    def crop(x: np.ndarray, y: np.ndarray, event, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(crop, row) of an event some of whose rows are in the image."""
        import hashlib
        from bisect import bisect_right

        cells = np.unique(y.clip(0, height - 1) * width + x.clip(0, width - 1))

        def draws(k: int, attempt: int) -> list[float]:
            return [int(hashlib.md5(f"{seed}:{event}:{k}:{attempt}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) for i in range(5)]

        def size(u: list[float]) -> tuple[int, int]:
            area, a = (scale[0] + (scale[1] - scale[0]) * u[3]) * width * height, math.exp(math.log(aspect[0]) + (math.log(aspect[1]) - math.log(aspect[0])) * u[4])
            return max(1, min(round(math.sqrt(area * a)), width)), max(1, min(round(math.sqrt(area / a)), height))

        def moved(at: int, u: float, end: int) -> int:
            period = max(1, 2 * end - 2)
            to = (at + shifts[min(bisect_right(steps, u), len(shifts) - 1)]) % period
            return min(to, period - to) if end > 1 else 0

        def inside(left: int, top: int, w: int, h: int) -> np.ndarray:
            return seen[(x[seen] >= left) & (x[seen] < left + w) & (y[seen] >= top) & (y[seen] < top + h)]

        out = []
        for k in range(n):
            for attempt in range(attempts if len(seen) >= least else 0):
                u = draws(k, attempt)
                cell = int(cells[int(u[0] * len(cells))])
                (w, h), ax, ay = size(u), moved(cell % width, u[1], width), moved(cell // width, u[2], height)
                found = inside(max(0, min(round(ax - w / 2), width - w)), max(0, min(round(ay - h / 2), height - h)), w, h)
                if len(found) >= least:
                    break
            else:
                w, h = size(draws(k, attempts))
                found = inside((width - w) // 2, (height - h) // 2, w, h)
                found = found if len(found) else np.zeros(1, int)
            out.append((k, found))
        return np.repeat([k for k, _ in out], [len(f) for _, f in out]), np.concatenate([f for _, f in out])

    def pack(c: dict, at: np.ndarray) -> tuple[dict, np.ndarray]:
        x, y = c["x"], c["y"]
        seen = np.flatnonzero((x >= 0) & (x < width) & (y >= 0) & (y < height))
        cuts = np.searchsorted(seen, at)
        none = np.flatnonzero(np.diff(cuts) == 0) if least > 0 else np.zeros(0, int)
        numbers, rows = [np.repeat(np.arange(n), len(none))], [np.tile(at[none], n)]
        for i in np.setdiff1d(np.arange(len(at) - 1), none):
            low, high = at[i], at[i + 1]
            number, row = crop(x[low:high], y[low:high], c[group][low], seen[cuts[i] : cuts[i + 1]] - low)
            numbers.append(number)
            rows.append(row + low)
        row = np.concatenate(rows)
        return {group: c[group][row], "crop": np.concatenate(numbers), "id": c["id"][row]}, np.searchsorted(at, row, "right") - 1

    return by_packs(rows, group, ["id"], pack, f"{group} {kinds[group]}, crop bigint, id {kinds['id']}")


def views(crop_rows: DataFrame, masks: int, ratio: float, seed: int, group: str = "event_idx", truth: DataFrame | None = None) -> DataFrame:
    """Views = crops x masks: (event, view, id, masked), and the columns of ``truth`` (event, id, ..) of each row, null without any."""
    from shardloom.operators.sampling import random_mask

    rows = crop_rows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(masks - 1)))).withColumn("view", F.col("crop") * masks + F.col("mask"))
    rows = rows.withColumn("__g", F.concat_ws(":", F.col(group).cast("string"), F.col("view").cast("string"))).withColumn("__k", F.concat_ws(":", F.col("__g"), F.col("id").cast("string")))
    out = random_mask(rows, "__g", ratio, seed, "__k", keep_one=True).select(group, "view", "id", "masked")
    return out if truth is None else out.join(truth, [group, "id"], "left")
