"""Connected components of an undirected graph that is held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import durable

#: Rounds until the caller is told that something is wrong; the stars halve the depth each round.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node can reach.

    ``edges`` has the columns ``a`` and ``b`` of one ordered type, in any direction and
    repeated at will. The result has one row ``node, root`` for each node that an edge
    names. Alternating large-star and small-star rounds are used: every round is two
    aggregations over the edges, no neighbourhood is collected and the number of edges
    does not grow. Edges with a null end and loops add nothing, but a node that has
    only a loop is returned as its own root.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    current = durable(
        pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(current)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        current = durable(_small_star(_large_star(current)))
        before, state = state, _state(current)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    single = loops.join(roots.select("node").union(own.select("node")), "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.union(own).union(single)


def _state(edges: DataFrame) -> tuple:
    """A digest of the edge set; equal digests of two rounds mean a fixed point."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 20))).alias("h"),
        F.bit_xor(F.xxhash64("v", "u")).alias("x"),
    ).first()
    return (row["n"], row["h"], row["x"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins every smaller neighbour of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


