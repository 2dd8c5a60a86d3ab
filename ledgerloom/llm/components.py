"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join


def _is_star_forest(pairs: DataFrame) -> tuple[bool, int]:
    """Whether every u has one v and no v is a u (then v is the smallest node of its component), and the number of pairs."""
    rows, nodes = pairs.agg(F.count("*"), F.countDistinct("u")).first()
    return rows == nodes and pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty(), rows


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node reachable from each node that has an edge.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then the smaller ones
    likewise, until only stars are left. The pairs of a node with many neighbours are spread over tasks. Nulls and loops are no edges; repeated pairs count once; an empty
    table gives an empty one.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null").distinct())
    for _ in range(rounds):
        done, n = _is_star_forest(pairs)
        if done:
            break
        both = pairs.unionByName(pairs.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count("*").alias("size"))
        large = materialize(spread_join(both, least, ["u"], 2 * n, "inner").where("v > u").select(v.alias("u"), m.alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = spread_join(large, least, ["u"], n, "inner").select(F.when(v != m, v).otherwise(u).alias("u"), m.alias("v"))
        pairs = materialize(small.distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(v.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(u.alias("node"), v.alias("component")).unionByName(roots)
