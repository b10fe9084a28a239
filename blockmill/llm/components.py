"""Connected components of a graph of any shape, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.sources.tables import with_checkpoints


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (a, b): component is its least node.

    Each round is two aggregates with partial combining and two joins; a node with very many edges is split by the
    skew handling of joins, and nothing is gathered in one task or the driver. Edges with a null or equal ends are
    left out. Rounds grow as the logarithm of the longest path; lineage is cut by checkpoint() after each.
    """
    with_checkpoints(edges.sparkSession)
    now = _ordered(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))).checkpoint()
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h"), F.sum(F.col("v") % 1000003).alias("s")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).union(low.select("u", "m"))
        now = _ordered(small).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
