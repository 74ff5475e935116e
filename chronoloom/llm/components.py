"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), root being the smallest node reachable.

    Each round links every node to the smallest of its neighbourhood; the
    rounds end when the edges stay as they are, at which point all are stars.
    The only state is the edge table, written to the shared folder each round;
    hub nodes are reduced by partial aggregation before the shuffle.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select(b.alias("a"), F.col("m").alias("b")).filter(a != b).unionByName(linked.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct(), "edges")
