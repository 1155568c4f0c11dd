"""Near-duplicate documents: SimHash fingerprints, linked by searching BK-trees.

A fingerprint has 64 bits. Two that differ in at most r bits agree in two of any r + 2 blocks of bits, so the rows of
a shard are the fingerprints with equal values in two given blocks, and every link lies within some shard. Each shard's
BK-tree is built by the task that holds the shard, and meets the shard's fingerprints there: a tree of all
fingerprints that is sent to every executor would grow with the corpus. A large shard is dealt into slices whose trees
are sent to each of the shard's other slices, see ``common.in_cells``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.llm.common import Links, by_key, connected_components, cut, in_cells, runs

SEED, BITS = 42, 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text: lower-cased A-Z, word shingles with repeats, XXH64 of each; a bit is 1 if set in over half of them.

    Fewer words than ``width``: their whole sequence is the only shingle. Null, or no word: 0.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words)) - 1
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(words) - k
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + k : to + k].tolist(), strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    """The fingerprint's 64 bits as a signed long."""
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


class BKTree:
    """Numbers under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.top: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.top is None:
            self.top = (value, {})
            return
        node = self.top
        while (d := (node[0] ^ value).bit_count()) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = (value, {})

    def within(self, value: int, radius: int) -> list[int]:
        """The values at a distance of ``radius`` or less; only edges within the radius are followed."""
        found, stack = [], [self.top] if self.top else []
        while stack:
            own, children = stack.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            stack += [child for k, child in children.items() if d - radius <= k <= d + radius]
        return found


def shard_keys(fp: Column, radius: int) -> Column:
    """An array with a key for each two of ``radius + 2`` blocks of bits."""
    bounds = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(bounds, bounds[1:], strict=False)]
    most = max(b - a for a, b in zip(bounds, bounds[1:], strict=False))
    if 2 * most > 56:
        raise ValueError(f"radius {radius} leaves blocks of {most} bits; 1 is the least radius")
    return F.array(*[F.shiftleft(block[i], most).bitwiseOR(block[j]) + F.lit(c << (2 * most)) for c, (i, j) in enumerate(combinations(range(radius + 2), 2))])


def _tree_links(radius: int):
    def links(batches):
        for frame in runs(batches, ["key", "cell"]):
            key, cell = frame["key"].to_numpy(), frame["cell"].to_numpy()
            bounds = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), [True])))
            values, roles, out = frame["fp"].to_numpy().view(np.uint64), frame["role"].to_numpy(), Links()
            shared = np.flatnonzero(np.diff(bounds) > 1)
            for start, end in zip(bounds[shared].tolist(), bounds[shared + 1].tolist(), strict=True):
                tree, out.up = BKTree(), {}
                for value, role in zip(values[start:end].tolist(), roles[start:end].tolist(), strict=True):
                    if role != 1:
                        for other in tree.within(value, radius):
                            out.join(value, other)
                    if role != 2:
                        tree.add(value)
            yield pd.DataFrame(np.array(out.edges, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return links


def fingerprint_links(fps: DataFrame, radius: int = 4, most: int = 2048) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` (long) with at most ``radius`` differing bits.

    Of each shard only a spanning forest of its links comes out, so a group of near copies gives about as many edges
    as it has fingerprints, not all its pairs. ``most``: fingerprints in a task's tree.
    """
    rows = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("key"))
    cells = in_cells(rows, "key", F.xxhash64("fp"), most)
    return cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "role").mapInPandas(_tree_links(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Per row of ``docs``: its id, ``fp``, ``component_id``, the smallest id reachable over links of ``radius`` bits or fewer, and
    ``root``, the component's smallest fingerprint, which names it where no id does.

    Rows link by fingerprint only: equal ids don't link. Texts that are null or have no word have fingerprint 0 and
    link like any other. A row with a null id has the smallest known id of its component, null if there is none.
    Repeated rows are all returned. An empty table gives no rows.
    """
    own = cut(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    fps = cut(own.groupBy("fp").agg(F.min("id").alias("least")))
    label = connected_components(fingerprint_links(fps, radius)).withColumnRenamed("node", "fp")
    member = cut(label.join(fps, "fp"))
    linked = by_key(member, cut(member.groupBy("root").agg(F.min("least").alias("of_all"))), "root").select("fp", "of_all", "root")
    component = cut(fps.join(linked, "fp", "left").select("fp", F.coalesce("of_all", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return own.join(component, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root")


def keep_one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest ``doc_id`` stays.

    Of a component without any id the row with the smallest fingerprint stays, of several that with the smallest hash of its text. Of rows that repeat the id that stays, one
    stays. Texts that are null or have no word are near-duplicates of each other. Columns are those of ``docs``, whatever
    their names. An empty table gives no rows.
    """
    found = cut(simhash_components(docs, radius=radius))
    keep = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    nameless = docs.where("doc_id is null")
    if not nameless.isEmpty():
        alone = found.where("doc_id is null and component_id is null").select("fp", "root").distinct()
        rows = nameless.select(F.struct("*").alias("row"), fingerprint_udf("text").alias("fp"), F.xxhash64("text").alias("hash")).join(alone, "fp")
        rows = rows.groupBy("root").agg(F.min_by("row", F.struct("fp", "hash")).alias("row"))
        kept = kept.unionByName(rows.select("row.*"))
    return kept.select(*docs.columns)
