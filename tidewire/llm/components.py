"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b), component being the smallest node reachable.

    Alternates large-star and small-star steps until only stars are left: a logarithmic number of rounds, each a grouped
    minimum and a join, and never more rows than links. Loops, nulls and repeated links do no harm.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    for _ in range(rounds):
        if _stars(edges):
            break
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        linked = large.join(small, F.col("a") == F.col("c"))
        edges = materialize(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").limit(1).count()
