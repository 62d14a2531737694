"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, materialize, salted_join


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``edges`` of long ids -> (node, root), root being the smallest id of the node's component.

    Nodes without an edge to another node don't appear; null ids and self-links are ignored. Each round is
    a few shuffles of the edge list, and the number of rounds grows with the logarithm of its diameter.
    Hubs are dealt over several tasks. The result is a table; those of the rounds are deleted.
    """
    scratch = Scratch(edges.sparkSession)
    s, d = F.col(src).cast("long"), F.col(dst).cast("long")
    now = scratch.keep(edges.select(F.greatest(s, d).alias("hi"), F.least(s, d).alias("lo")).filter(s != d).distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        # large star: the larger neighbours of a node move to its smallest neighbour
        least = now.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
        large = salted_join(now, least, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            salted_join(large, least, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*")
            .filter("hi <> lo")
            .distinct()
        )
        now = scratch.keep(small, "edges")
        scratch.drop(but=1)
        if (sign := _signature(now)) == seen:
            break
        seen = sign
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = materialize(leaves.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()), "roots")
    scratch.drop()
    return roots
