"""Connected components by alternating large-star and small-star steps, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import HOT_KEYS, HOT_ROWS, join_sizes, materialize


def _star(pairs: DataFrame, total: int, hubs: bool) -> DataFrame:
    """For pairs (u, v) of a node and its neighbour: the neighbour and the least of the node's neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_sizes(pairs, least, "u", total) if hubs else pairs.join(least.drop("n"), "u")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``id, component`` for every node of an edge list of integers; the component is its least node.

    Large-star hangs each node's larger neighbours on the least one, small-star the rest; both keep components, and the
    result is stars in a logarithmic number of rounds. Each round is written to the shared folder. A hub's least neighbour is
    broadcast to its pairs, so that no task gets all of them. Loops and repeated edges do no harm; an empty list has no nodes.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * now.count()
        most = both.groupBy("u").count().agg(F.max("count")).first()[0] or 0
        hubs = most > max(HOT_ROWS, total // HOT_KEYS)
        large = _star(both, total, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(materialize(large, "large") if hubs else large, total, hubs)
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        now = materialize(small.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
