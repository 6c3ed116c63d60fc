"""Connected components of a table of links, by alternating star contractions on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.common import stored

#: Rounds after which something must be wrong: each one at least halves the longest chain.
MOST_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that can be reached.

    Links of a node with itself make it known; nulls are left out. Each round hangs larger neighbours on the smallest
    one (large star), then neighbours below a node on the smallest of them (small star); what is left is a star per
    component. Neighbours are never gathered: a round is a minimum per node and a join by node, whose large keys
    Spark may split. Every round is a written table, so no lineage grows.
    """
    links = stored(links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "links")
    edges, before = links.where("a <> b"), None
    for _ in range(MOST_ROUNDS):
        pairs = _both_ways(edges)
        least = stored(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    nodes = _both_ways(links).select(F.col("a").alias("node")).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
