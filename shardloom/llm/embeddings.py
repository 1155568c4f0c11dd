"""Near-duplicate vectors by collision counting over one-dimensional projections.

Two unit vectors with a cosine of at least c are at most sqrt(2 - 2c) apart, so on a Gaussian direction they mostly fall
into each other's window of a few times that width, and vectors that are not alike mostly don't. In a group of vectors
every one of many projections is sorted, each vector's window is found in each, and pairs that collide in as many
projections as alike vectors do (but for a calibrated miss rate) are verified by their cosine. A window holds a
constant share of all vectors, so counting over the whole table would be quadratic: groups are made first, by the side
of zero on which vectors fall on further directions, in as many tables as the same miss rate asks for. Links are
counted where they are found and only a spanning forest comes out, so large groups emit no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import Links, by_key, connected_components, cut, in_cells, runs

COSINE = 0.95
#: Share of links at the threshold that the tables, and that the count, may miss.
MISS = 1e-3
PROJECTIONS, WIDTHS, SEED = 24, 2.5, 7
#: Vectors in a group at about which the tables aim; in a task's comparison at most.
GROUP, MOST = 64, 1024


def tables_for(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): sides per key, so that n vectors make groups of about GROUP, and tables to miss ``miss`` of the links at the threshold."""
    bits = max(1, min(24, round(math.log2(max(n, 1) / GROUP)))) if n > 2 * GROUP else 0
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(miss) / math.log(1 - same))


def least_collisions(projections: int = PROJECTIONS, widths: float = WIDTHS, miss: float = MISS) -> int:
    """The largest count that vectors at the threshold reach with a probability of 1 - miss / 100 or more."""
    p, tail = math.erf(widths / math.sqrt(2)), 0.0
    for count in range(projections, 0, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= 1 - miss / 100:
            return count
    return 1


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or zero, without null and non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of every unit vector in every table: the side of zero on which it falls on each of the table's directions.

    The products are summed in one order, whatever else is in the batch: a vector has the same keys wherever they are derived.
    """
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    side = (np.einsum("nd,dk->nk", x, planes) >= 0).reshape(len(x), tables, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def _sides(bits: int, tables: int):
    def sides(batches):
        for part in batches:
            keys = np.zeros((len(part), tables), np.int64)
            for _, at in part.groupby(part["vec"].map(len), sort=False).indices.items():
                keys[at] = _keys(_unit(part["vec"].iloc[at]), bits, tables)
            yield part.assign(keys=list(keys))

    return sides


def collisions(projected: np.ndarray, width: float) -> np.ndarray:
    """How often, over the columns, each row's value lies in the window of ``width`` around each other row's."""
    n, m = projected.shape
    order = projected.argsort(axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    count = np.zeros((n, n), np.int8)
    for k in range(m):
        column = projected[order[:, k], k]
        low = np.searchsorted(column, projected[:, k] - width, "left")
        high = np.searchsorted(column, projected[:, k] + width, "right")
        count += (rank[None, :, k] >= low[:, None]) & (rank[None, :, k] < high[:, None])
    return count


def _compare(cosine: float, bits: int, tables: int):
    width, least = WIDTHS * math.sqrt(2 - 2 * cosine), least_collisions()

    def compare(batches):
        for frame in runs(batches, ["key", "dim", "cell"]):
            out, counted = Links(), []
            for (key, dim, _), group in frame.groupby(["key", "dim", "cell"], sort=False):
                n, table = len(group), int(key) >> 24
                if n < 2:
                    continue
                x = _unit(group["vec"])
                directions = np.random.default_rng([SEED, dim, 1]).standard_normal((dim, PROJECTIONS))
                a, b = np.nonzero(np.triu(collisions(x @ directions, width) >= least, 1))
                role = group["role"].to_numpy()
                a, b = (z[(role[a] == 0) | (role[a] != role[b])] for z in (a, b))
                alike = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= cosine
                a, b = a[alike], b[alike]
                if table and len(a):  # pairs that an earlier table has found
                    rows, at = np.unique(np.concatenate((a, b)), return_inverse=True)
                    keys = _keys(x[rows], bits, tables)[:, :table]
                    new = (keys[at[: len(a)]] != keys[at[len(a) :]]).all(axis=1)
                    a, b = a[new], b[new]
                if not len(a):
                    continue
                cid, copies = group["cid"].to_numpy(), group["copies"].to_numpy()
                links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
                counted += [(c, int(v)) for c, v in zip(cid.tolist(), links, strict=True) if v]
                out.up = {}
                for i, j in zip(cid[a].tolist(), cid[b].tolist(), strict=True):
                    out.join(i, j)
            rows = [(0, c, v) for c, v in counted] + [(1, i, j) for i, j in out.edges]
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 3), columns=["kind", "a", "b"])

    return compare


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors``: its id, n_links (other rows with a cosine of at least ``cosine``), component_id (smallest
    id reachable by links, itself included) and kept (id = component_id).

    Vectors that are null, empty, zero, or have null or non-finite components link with nothing, and vectors of different
    lengths not with each other. Equal vectors are one class that is compared once, and link with each other; repeated
    rows are such vectors. A row with a null id takes the smallest id of its component; alone it is kept. Whatever
    their labels, all rows are compared. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    good = rows.where(usable(F.col("vec")))
    classes = good.groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    bits, tables = tables_for(classes.count(), cosine)
    kind = classes.schema["vec"].dataType.simpleString()
    keyed = classes.select("cid", "copies", "vec").mapInPandas(_sides(bits, tables), f"cid long, copies long, vec {kind}, keys array<long>")
    keyed = keyed.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    keyed = keyed.withColumn("key", F.col("table").cast("long") * (1 << 24) + F.get("keys", F.col("table"))).withColumn("dim", F.size("vec")).drop("table", "keys")
    cells = in_cells(keyed, "key", F.xxhash64("cid"), MOST)
    found = cells.repartition("key", "dim", "cell").sortWithinPartitions("key", "dim", "cell").mapInPandas(_compare(cosine, bits, tables), "kind long, a long, b long")
    found = cut(found)
    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    label = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "cid")
    member = cut(label.join(classes.select("cid", "least"), "cid"))
    of_all = cut(member.groupBy("root").agg(F.min("least").alias("of_all")))
    linked = by_key(member, of_all, "root").join(links, "cid", "left").select("cid", "of_all", "links")
    classes = cut(
        classes.join(linked, "cid", "left").select(
            F.xxhash64("vec").alias("hash"),
            F.col("vec").alias("same"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("of_all", "least").alias("component"),
        )
    )
    out = rows.withColumn("hash", F.when(usable(F.col("vec")), F.xxhash64("vec")))
    equal = (out["hash"] == classes["hash"]) & (out["vec"] == classes["same"])
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component"))
    out = out.join(classes, equal, "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
