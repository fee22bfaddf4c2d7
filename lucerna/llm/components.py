"""Connected components by alternating large and small stars (Kiveris et al., 2014), a table per round.

Labels and edges stay distributed; the driver sees a count and two checksums a round. Each round's edges are written
to the shared checkpoint folder, so lineage stays short and a lost executor costs no recomputation; the edges of the
round before are removed then. A node's least neighbour comes from a partial aggregate; where very many edges of one
node meet it again, the join is a plain sort-merge join that a shuffle follows, whose skewed partitions Spark splits
(spark.sql.adaptive.skewJoin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import cut, remove

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges run from a larger a to a smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in either direction, repeated or not. One row (node, component) per node; the smallest node names it."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        after = cut(_small_star(_large_star(now)))
        name = F.xxhash64("a", "b")
        found = after.agg(F.count("*"), F.sum(name.cast("decimal(20,0)")), F.bit_xor(name)).first()
        remove(now)
        now = after
        if found == state or not found[0]:
            break
        state = found
    else:
        raise RuntimeError("components did not settle")
    pairs = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    return now.select(F.explode(pairs).alias("p")).select("p.node", "p.component").distinct()
