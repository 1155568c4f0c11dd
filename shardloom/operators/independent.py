"""The first maximal independent set of an ordered graph, by rounds of local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.sources.tables import cut


def dominated(edges: DataFrame) -> tuple[DataFrame, int]:
    """The nodes that a pass over all nodes in their order would leave out, which takes each node that is next to none taken before;
    and the number of rounds. ``edges``: rows (a, b), a before b in the order, of any type; each edge once, or repeated.

    A node that no undecided node comes before is taken, its later neighbours are left out, and the edges of all of them go. What
    a round decides is all that the pass would decide in the same way, so rounds are as many as the longest chain of decisions that
    wait for each other, some log of the nodes where the order is not the graph's own. Rounds are joins and a distinct on ends
    of edges: a node with very many edges needs no task of its own. No edges give no nodes and no round.
    """
    live, found, rounds = cut(edges), [], 0
    nodes = live.select("b")
    while not live.isEmpty():
        waits = live.select(F.col("b").alias("a")).distinct()
        out = cut(live.join(waits, "a", "left_anti").select("b").distinct())
        found.append(out)
        rounds += 1
        live = live.join(out, "b", "left_anti").join(out.withColumnRenamed("b", "a"), "a", "left_anti")
        live = cut(live.select("a", "b"))
    every = nodes.limit(0)
    for out in found:
        every = every.unionByName(out)
    return every.withColumnRenamed("b", "node"), rounds
