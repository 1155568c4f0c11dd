"""Hard negatives by inner product, searched with a table of distances to pivots.

With M the largest norm of all vectors, x gets the further component sqrt(M^2 - |x|^2) and an anchor q a zero; then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so a large score is a small distance. The table has each vector's distances to a few pivots, and by
the triangle inequality |d(q, p) - d(x, p)| <= |q - x| <= d(q, p) + d(x, p) for every pivot p, which brackets the score. Only
vectors whose bracket meets what an anchor still looks for are multiplied with it. A batch of vectors has the least and
greatest of its distances, by which an anchor passes whole batches by; batches hold vectors near the same pivot.

Anchors are a stated set of queries: blocks of them meet slices of all vectors, which pass by as a stream.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import by_key, stored

#: Pivots, and vectors from which they are chosen (those with the least hashes of their ids); the index holds all vectors.
PIVOTS, SAMPLE = 8, 512
#: Anchors of a block; vectors of a slice at most, and those for which a further task pays.
ANCHORS, ROWS, A_TASK = 4096, 1 << 20, 4096
#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES, BAND = 5, 10, (30, 90)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; what is missing at a list's end is zero, a null component is not a number."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = values
    return out


def _lists(matrix: np.ndarray, kind):
    import pyarrow as pa

    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel(), kind))


def whole_numbers(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(id, label, vec, norm2) of the rows of which all components are finite, as whole numbers; see ``hard_negatives``."""
    import pyarrow as pa

    def batches(parts):
        for part in parts:
            x = np.floor(scale * _matrix(part.column(2), dim))
            norm2 = (x * x).sum(axis=1)
            good = np.isfinite(norm2) & (norm2 <= 2.0**62)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), _lists(x[good].astype(np.int64), pa.int64()), pa.array(norm2[good])], ["id", "label", "vec", "norm2"])

    return rows.mapInArrow(batches, "id long, label long, vec array<long>, norm2 double")


def choose_pivots(x: np.ndarray, most2: float, pivots: int) -> np.ndarray:
    """Of the vectors ``x``, with their further component, some that are far from each other, the first being the longest."""
    x = np.hstack([x, np.sqrt(np.maximum(most2 - (x * x).sum(axis=1), 0))[:, None]])
    found = [int((x[:, :-1] ** 2).sum(axis=1).argmax())]
    near = ((x - x[found[0]]) ** 2).sum(axis=1)
    while len(found) < min(pivots, len(x)):
        found.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[found[-1]]) ** 2).sum(axis=1))
    return x[found]


def distances(x: np.ndarray, further: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p[:-1]) ** 2).sum(axis=1) + (further - p[-1]) ** 2 for p in pivots], 1))


def pivot_table(good: DataFrame, dim: int, most2: float, pivots: np.ndarray) -> DataFrame:
    """``good`` with ``dist`` (to each pivot, as a stored vector), ``as_query`` (as an anchor) and ``region``, the nearest pivot."""
    import pyarrow as pa

    def batches(parts):
        for part in parts:
            x, norm2 = _matrix(part.column(2), dim), part.column(3).to_numpy()
            dist = distances(x, np.sqrt(np.maximum(most2 - norm2, 0)), pivots)
            query = distances(x, np.zeros(len(x)), pivots)
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(dist, pa.float64()), _lists(query, pa.float64()), pa.array(dist.argmin(axis=1), pa.int32())], [*part.schema.names, "dist", "as_query", "region"])

    return good.mapInArrow(batches, "id long, label long, vec array<long>, norm2 double, dist array<double>, as_query array<double>, region int")


class _Block:
    """Anchors of a cell, and the best that each has found for each of its goals so far.

    A goal is a range of scores of which ``want`` rows with the largest scores, then the smallest ids, are looked for.
    """

    def __init__(self, part, dim: int, most2: float, want: int, same_label: bool, exact_doubles: bool) -> None:
        self.kind = np.float64 if exact_doubles else np.int64
        self.dim, self.most2, self.want, self.same = dim, most2, want, same_label
        self.id, self.label = (part.column(c).to_numpy() for c in ("id", "label"))
        self.x = _matrix(part.column("vec"), dim).astype(self.kind) if exact_doubles else np.array(part.column("vec").to_pylist(), np.int64).reshape(len(self.id), -1)
        self.norm2 = part.column("norm2").to_numpy()
        self.dist = _matrix(part.column("dist"), len(part.column("dist")[0]))
        goals = part.column("goals").to_pylist()
        self.goals = [[(g["goal"], g["low"], g["high"], np.zeros(0, np.int64), np.zeros(0, np.int64)) for g in own] for own in goals]
        self.low, self.high = np.array([min(g["low"] for g in own) for own in goals], np.float64), np.array([max(g["high"] for g in own) for own in goals], np.float64)

    def meet(self, part) -> None:
        ids, labels = (part.column(c).to_numpy() for c in ("id", "label"))
        dist = _matrix(part.column("dist"), self.dist.shape[1])
        x = _matrix(part.column("vec"), self.dim) if self.kind == np.float64 else np.array(part.column("vec").to_pylist(), np.int64).reshape(len(ids), -1)
        whole = self.norm2 + self.most2  # |q|^2 + M^2, from which half the squared distance is taken
        slack = 1 + 1e-9 * whole
        least, most = dist.min(axis=0), dist.max(axis=0)
        nearest = np.maximum(np.maximum(least - self.dist, self.dist - most), 0).max(axis=1)
        farthest = (self.dist + most).min(axis=1)
        may = ((whole - nearest**2) / 2 + slack >= self.low) & ((whole - farthest**2) / 2 - slack <= self.high)
        columns = np.ascontiguousarray(dist.T)
        for a in np.flatnonzero(may).tolist():
            near, far = np.zeros(len(ids)), np.full(len(ids), np.inf)
            for own, column in zip(self.dist[a].tolist(), columns, strict=True):
                np.maximum(near, np.abs(own - column), out=near)
                np.minimum(far, own + column, out=far)
            fits = (near * near <= whole[a] - 2 * (self.low[a] - slack[a])) & (far * far >= whole[a] - 2 * (self.high[a] + slack[a]))
            fits &= (labels == self.label[a]) & (ids != self.id[a]) if self.same else labels != self.label[a]
            at = np.flatnonzero(fits)
            if len(at):
                self._take(a, (x[at] @ self.x[a]).astype(np.int64), ids[at])

    def _take(self, a: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for k, (goal, low, high, best, who) in enumerate(self.goals[a]):
            least = max(low, int(best[-1])) if len(best) == self.want else low
            new = np.flatnonzero((scores >= least) & (scores <= high))
            if not len(new):
                continue
            if len(new) > self.want:
                new = new[scores[new] >= np.partition(scores[new], -self.want)[-self.want]]
            best, who = np.concatenate([best, scores[new]]), np.concatenate([who, ids[new]])
            order = np.lexsort((who, -best))[: self.want]
            self.goals[a][k] = (goal, low, high, best[order], who[order])
        self.low[a] = min(int(best[-1]) if len(best) == self.want else low for _, low, _, best, _ in self.goals[a])

    def found(self):
        import pyarrow as pa

        rows = [(i, goal, w, s) for i, own in zip(self.id.tolist(), self.goals, strict=True) for goal, _, _, best, who in own for w, s in zip(who.tolist(), best.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["anchor", "goal", "id", "score"])


def _search(anchors: DataFrame, rows: DataFrame, dim: int, most2: float, want: int, same_label: bool) -> DataFrame:
    """(anchor, goal, id, score) of the best rows of each goal. Both frames have ``cell``; an anchor's cells hold each row once."""
    import pyarrow as pa

    exact = most2 < 2.0**53  # then sums of products of two vectors are exact in doubles

    def batches(parts):
        block, cell, held = None, None, []

        def ready():
            table = pa.Table.from_batches(held).combine_chunks()
            return _Block(table.to_batches()[0], dim, most2, want, same_label, exact)

        for part in parts:
            cells, roles = part.column("cell").to_numpy(), part.column("role").to_numpy()
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1])) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != cell:
                    if block is not None:
                        yield block.found()
                    block, cell, held = None, cells[a], []
                if roles[a] == 0:
                    held.append(part.slice(a, b - a))
                elif held or block is not None:
                    if block is None:
                        block, held = ready(), []
                    block.meet(part.slice(a, b - a))
        if block is not None:
            yield block.found()

    query = anchors.select("cell", F.lit(0).alias("role"), F.lit(0).alias("region"), "id", "label", "vec", "norm2", F.col("as_query").alias("dist"), "goals")
    other = rows.select("cell", F.lit(1).alias("role"), "region", "id", "label", "vec", "norm2", "dist", F.lit(None).cast(query.schema["goals"].dataType).alias("goals"))
    both = query.unionByName(other).repartition("cell").sortWithinPartitions("cell", "role", "region")
    out = both.mapInArrow(batches, "anchor long, goal long, id long, score long")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= want)


def _dealt(anchors: DataFrame, rows: DataFrame, key: str | None, blocks: Column, slices: Column) -> tuple[DataFrame, DataFrame]:
    """Both with a ``cell`` for each pair of a block of anchors and a slice of rows."""
    by = [F.col(key)] if key else []
    block, piece = F.pmod(F.xxhash64("id", F.lit(1)), blocks), F.pmod(F.xxhash64("id", F.lit(2)), slices)
    a = anchors.withColumn("block", block).withColumn("slice", F.explode(F.sequence(F.lit(0), slices.cast("int") - 1)))
    r = rows.withColumn("slice", piece).withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    cell = F.xxhash64(*by, F.col("block").cast("long"), F.col("slice").cast("long"))
    return a.withColumn("cell", cell), r.withColumn("cell", cell)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (rows of which ``is_anchor``, a
    condition on the column ``id``, holds) and each of its ``positives`` best other rows of the same label, the ``negatives`` best rows of
    other labels whose score is ``band`` percent of the positive's score; all there are, where there are fewer.

    A component x counts as floor(scale * x), a score is the whole inner product; equal scores go by the smaller id. Rows
    with a null id, label, vector or component, a non-finite component, or a square length over 2^62, beyond which scores don't fit a
    long, take no part. Shorter vectors end in zeros. Of rows that repeat an id the one with the least label, then vector, counts.
    Labels that are no whole numbers are told apart by a hash. Positives with negative scores have no negatives. Further columns
    are left out. No anchors, or an empty table, give no rows. Every row is searched; pivots are the only thing chosen from a sample.
    """
    spark = vectors.sparkSession
    label = F.col(label_col)
    if vectors.schema[label_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        label = F.when(label.isNotNull(), F.xxhash64(label))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).dropna()
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")
    dim = vectors.agg(F.max(F.size(vec_col))).first()[0] or 0
    nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dim < 1:
        return spark.createDataFrame([], nothing)
    good = stored(whole_numbers(rows, dim, scale))
    n, most2, n_anchors = good.agg(F.count(F.lit(1)), F.max("norm2"), F.count(F.when(is_anchor, 1))).first()
    if not n_anchors:
        return spark.createDataFrame([], nothing)
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()
    table = stored(pivot_table(good, dim, most2, choose_pivots(np.array([r["vec"] for r in sample], np.float64), most2, PIVOTS)))
    anchors = table.where(is_anchor)
    several = lambda count, each: F.greatest(F.ceil(count / each), F.lit(1)).cast("long")

    # positives: anchors and rows of one label meet
    labels = stored(table.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("n_anchors")).where("n_anchors > 0"))
    goals = F.array(F.struct(F.lit(0).cast("long").alias("goal"), F.lit(-(2**62)).cast("long").alias("low"), F.lit(2**62).cast("long").alias("high")))
    a, r = _dealt(by_key(anchors, labels, "label").withColumn("goals", goals), by_key(table, labels, "label"), "label", several(F.col("n_anchors"), ANCHORS), several(F.col("n"), ROWS))
    best = stored(_search(a, r, dim, most2, positives, True).select("anchor", F.col("id").alias("positive"), "score"))

    # negatives: every block of anchors meets every slice of rows
    # whole numbers within the band, without a product that might not fit a long or a quotient that a double rounds
    share = lambda p, up: F.expr(f"(score div 100) * {p} + ((score % 100) * {p} + {99 if up else 0}) div 100")
    low, high = share(band[0], True), share(band[1], False)
    goals = F.collect_list(F.struct(F.col("positive").alias("goal"), low.cast("long").alias("low"), high.cast("long").alias("high")))
    asked = best.where("score >= 0").groupBy(F.col("anchor").alias("id")).agg(goals.alias("goals"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-n // ROWS), min(tasks, -(-n // A_TASK)))
    a, r = _dealt(anchors.join(asked, "id"), table, None, F.lit(-(-n_anchors // ANCHORS)).cast("long"), F.lit(slices).cast("long"))
    found = _search(a, r, dim, most2, negatives, False)
    pair = best.select("anchor", F.col("positive").alias("goal"), F.col("score").alias("positive_score"))
    out = found.join(pair, ["anchor", "goal"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("goal").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
